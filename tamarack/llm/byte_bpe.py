"""Byte-level BPE encoding and decoding by ranks, many words at a time.

A piece is a match of the split pattern. Its BPE state is a segment tree over its byte positions:
each leaf holds (rank of the pair that starts there, position), and the root so holds the leftmost
pair of least rank. A merge changes the leaves of the merged token, of its live left neighbour and
of the neighbour it swallowed, each by one logarithmic path to the root. Trees of all new pieces of
a block of texts are kept as the rows of one matrix and merged together; long pieces use a tree of
their own. Parts of texts between single spaces repeat, so their ids are kept in a bounded
dictionary, which is emptied when full: it saves time and changes no result.

Nulls and empty texts give no ids. Other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_batches

#: Entries of the dictionary of known parts, per Python worker (about 400 bytes each, pieces included).
CACHE_ENTRIES = 500_000
#: Bytes of these parts and their ids, about, from which it is emptied too.
CACHE_BYTES = 96 << 20
#: Longer pieces get a tree of their own.
WIDEST = 64
_NONE = np.int64(2**62)
#: White space as Unicode defines it; the regex module's own class differs in four control characters.
_WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        exact = pattern.replace(r"[^\s", "[^" + _WHITE).replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
        self.split = regex.compile(exact).findall
        self.white = regex.compile(f"[{_WHITE}]").match
        self.gap = regex.compile(f" (?:[{_WHITE}]|$)").search
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, whole = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(rank)
        self.base = np.int64(size)
        pairs = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(pairs)
        self.pairs, self.merged = pairs[order], np.array(whole, np.int64)[order]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.cache_entries, self.held = cache_entries, 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or _NONE."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], _NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit numbers, of pieces of at most `width` bytes (a power of two)."""
        n, shift = len(pieces), width.bit_length()
        sizes = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place < sizes[:, None]
        ids = np.where(live, self.single[text], -1)
        after = np.broadcast_to(place + 1, (n, width)).copy()
        after[after >= sizes[:, None]] = -1
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        first = np.full((n, width), _NONE, np.int64)
        first[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:] = np.where(first < _NONE, (first << shift) | place, _NONE)
        for at in range(width - 1, 0, -1):
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        flat, ids_, after_, before_ = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        low, levels = (1 << shift) - 1, width.bit_length() - 1
        while len(rows):
            own, root = rows * width, rows * (2 * width)
            top = flat[root + 1]
            at = top & low
            here = own + at
            gone = after_[here]
            there = own + gone
            made = top >> shift
            ids_[here] = made
            ids_[there] = -1
            new, prev = after_[there], before_[here]
            after_[here] = new
            has, had = new >= 0, prev >= 0
            before_[(own + new)[has]] = at[has]
            n_rows = len(rows)
            rank = self.pair_ranks(np.concatenate([made, np.where(had, ids_[own + prev], -1)]), np.concatenate([np.where(has, ids_[own + new], -1), made]))
            right, left = rank[:n_rows], rank[n_rows:]
            flat[root + width + at] = np.where(right < _NONE, (right << shift) | at, _NONE)
            flat[root + width + gone] = _NONE
            flat[(root + width + prev)[had]] = np.where(left < _NONE, (left << shift) | prev, _NONE)[had]
            nodes = np.concatenate([root + at + width, root + gone + width, (root + prev + width)[had]])
            base = np.concatenate([root, root, root[had]])
            node = nodes - base
            for _ in range(levels):
                node >>= 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
            rows = rows[flat[root + 1] < _NONE]
        out = ids.astype("<u4")
        keep = ids >= 0
        return [out[i, keep[i]].tobytes() for i in range(n)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, after, before = [self.ranks[piece[i : i + 1]] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        none = (2**62, 0)
        get, bytes_of = self.ranks.get, self.bytes_of
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                tree[width + i] = (rank, i)
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def put(leaf: int, value: tuple[int, int]) -> None:
            at = width + leaf
            tree[at] = value
            at >>= 1
            while at:
                best = min(tree[2 * at], tree[2 * at + 1])
                if best == tree[at]:
                    return
                tree[at] = best
                at >>= 1

        while tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = new = after[gone]
            put(gone, none)
            token = bytes_of[rank]
            if new < n:
                before[new] = at
                other = get(token + bytes_of[ids[new]])
                put(at, none if other is None else (other, at))
            else:
                put(at, none)
            if (prev := before[at]) >= 0:
                other = get(bytes_of[ids[prev]] + token)
                put(prev, none if other is None else (other, prev))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def pieces_to_ids(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for p in pieces:
            if (one := self.packed.get(p)) is not None:
                out[p] = one
            elif len(p) > WIDEST:
                out[p] = self.merge_long(p)
            else:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, own in by_width.items():
            for i in range(0, len(own), 20_000):
                out.update(zip(own[i : i + 20_000], self.merge_many(own[i : i + 20_000], width), strict=True))
        return out

    def learn(self, parts: set[str]) -> None:
        """Put the ids of these parts into the dictionary."""
        cut = {part: [p.encode() for p in self.split(part)] for part in parts}
        if len(self.known) + len(cut) > self.cache_entries or self.held > CACHE_BYTES:
            self.known, self.pieces, self.held = {}, {}, 0
        ids = self.pieces
        ids.update(self.pieces_to_ids({p for ps in cut.values() for p in ps if p not in ids}))
        for part, ps in cut.items():
            self.known[part] = b"".join([ids[p] for p in ps])
            self.held += 3 * len(part) + len(self.known[part])  # with its pieces, which are keys of their own

    def parts(self, text: str) -> list[str]:
        """The text cut where the pattern surely cuts: before a space that precedes other than white space."""
        own = text.split(" ")
        if not self.gap(text):
            return [own[0], *[" " + x for x in own[1:]]] if own[0] else [" " + x for x in own[1:]]
        white = self.white
        out, held = [], own[0]
        for x in own[1:]:
            if x and not white(x):
                if held:
                    out.append(held)
                held = " " + x
            else:
                held += " " + x
        return [*out, held] if held else out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.parts(t) if t else [] for t in texts]
        known = self.known
        if new := {p for ps in cut for p in ps if p not in known}:
            self.learn(new)
            if self.known is not known:  # emptied: what this block needs must all be there
                known = self.known
                if rest := {p for ps in cut for p in ps if p not in known}:
                    size, held = self.cache_entries, self.held
                    self.cache_entries, self.held = 1 << 62, 0
                    self.learn(rest)
                    self.cache_entries, self.held = size, self.held + held
        get = self.known.__getitem__
        return [b"".join(map(get, ps)) for ps in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder per table and Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with one more column: the ids as little-endian unsigned 32-bit numbers (a binary column).

    The binary form keeps a text of a million tokens at four bytes each; decode() takes it back.
    A column of that name is replaced.
    """

    text_batches(docs.sparkSession)

    def run(series: Iterator):
        import pandas as pd

        own = encoder(ranks_path, pattern)
        for s in series:
            values, out = s.tolist(), []
            for i in range(0, len(values), 256):
                out += own.encode_many(values[i : i + 256])
            yield pd.Series(out, dtype=object)

    return docs.withColumn(ids_col, F.pandas_udf(_typed(run), "binary")(F.col(quoted(text_col)).cast("string")))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """docs with one more binary column: the bytes that the ids stand for. Null ids give null."""

    def run(series: Iterator):
        import pandas as pd

        own = encoder(ranks_path, pattern)
        for s in series:
            yield pd.Series([None if x is None else own.decode(x) for x in s], dtype=object)

    return docs.withColumn(out_col, F.pandas_udf(_typed(run), "binary")(F.col(quoted(ids_col))))


def _typed(run):
    """run, marked as a function from an iterator of series to one (postponed annotations hide the types)."""
    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() of each text in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = own.encode_many(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(own.decode(x)) for x in ids])],
                    schema=schema,
                )

    text_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
