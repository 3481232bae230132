"""A Merkle manifest of a dataset: trees of 16, written in completion order, and proofs read from them.

Rows are leaves; the leaves of a group (a source) ascend by id and form a tree, and the roots of all
trees, by group, one more. A node is the hash of up to 16 consecutive nodes below it, as many as there
are at the right edge, even one.

A tree is cut into aligned blocks of BLOCK = 16**DEPTH leaves. A builder takes a block and appends its
nodes to a log in the order in which they are complete, which is postorder, so nothing is ever moved:
the node of height h over leaves up to number L stands at L + L // 16 + L // 16**2 + ... + h. Blocks
are whole subtrees, so they need nothing of one another; their roots are the leaves of the next round,
a BLOCK-th as many. Proofs go the other way: a block gets the siblings above its root from the round
above, finds those inside in its own log by their positions, and hands both to what lies below.

Numbers of leaves come from one sort by (group, id) over ranges, so a hot group lies in many
partitions and many blocks. What a task must know of the tasks before it is how many rows of its first
group they hold, which takes one row from each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import checkpointed, quoted, shuffle_width, text_batches

#: Nodes below a node; levels of a block, and its leaves.
FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def combined(nodes: list[bytes]) -> bytes:
    """The digest of a node, from those below it: SHA-256 of their hex texts."""
    return hashlib.sha256("".join([n.hex() for n in nodes]).encode()).digest()


def completed(leaf: int) -> int:
    """Nodes of a tree that are complete before leaf number `leaf` is appended: the leaves and all full subtrees before it."""
    total = 0
    while leaf:
        total, leaf = total + leaf, leaf // FAN
    return total


def position(index: int, height: int, leaves: int) -> int:
    """Place in the log of node `index` of a height, in a tree of so many leaves: its last leaf's place, and the nodes completed with that."""
    return completed(min((index + 1) * FAN**height, leaves) - 1) + height


def width_at(leaves: int, height: int) -> int:
    """Nodes of a height in a tree of so many leaves."""
    return -(-leaves // FAN**height)


def height_of(leaves: int) -> int:
    """Height of the root of a tree of so many leaves."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def appended(leaves: list[bytes], top: int) -> list[bytes]:
    """The log of a block: its nodes up to height `top`, each appended when the last leaf below it has come."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def append(node: bytes, height: int) -> None:
        log.append(node)
        open_[height].append(node)
        if height < top and len(open_[height]) == FAN:
            close(height)

    def close(height: int) -> None:
        node = combined(open_[height])
        open_[height].clear()
        append(node, height + 1)

    for leaf in leaves:
        append(leaf, 0)
    for height in range(top):  # the right edge
        if open_[height]:
            close(height)
    return log


@cache
def places(leaves: int, top: int) -> list[list[int]]:
    """Of a block with so many leaves: the places of the nodes of each height up to `top`."""
    return [[position(j, h, leaves) for j in range(width_at(leaves, h))] for h in range(top + 1)]


def siblings(log: list[str], leaves: int, top: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block: at each height below `top`, the hex digests left and right of its path."""
    at = places(leaves, top)
    runs = [[[log[p] for p in at[h][j : j + FAN]] for j in range(0, len(at[h]), FAN)] for h in range(top)]
    above: dict[int, list[tuple[str, str]]] = {}
    for leaf in range(leaves):
        parent = leaf // FAN
        if parent not in above and top:
            above = {parent: []}
            for h in range(1, top):
                run, k = divmod(leaf // FAN**h, FAN)
                above[parent].append(("".join(runs[h][run][:k]), "".join(runs[h][run][k + 1 :])))
        if top:
            run = runs[0][parent]
            yield [("".join(run[: leaf % FAN]), "".join(run[leaf % FAN + 1 :])), *above[parent]]
        else:
            yield []


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# --- rows in order -------------------------------------------------------------------------------


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows that agree in the first `keys` columns, and come together, are never apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.concat_batches(held)
            held = []
        last = edges(batch, keys)[-2]  # where the last run begins
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def edges(batch: pa.RecordBatch, keys: int) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in range(keys):
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return [*np.flatnonzero(new).tolist(), n]


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (tree, id, leaf, shown) with their number i within the tree, by id (null first) and leaf."""
    width = shuffle_width(leaves.sparkSession)
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("leaf")]
    rows = checkpointed(leaves.repartitionByRange(width, *order).sortWithinPartitions(*order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last tree of this task, and its rows of each."""
        first = last = None
        head = tail = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts, tree = edges(batch, 1), batch.column(0)
            for a, b in (pairwise(cuts) if len(cuts) < 4 else ((cuts[0], cuts[1]), (cuts[-2], cuts[-1]))):
                own = tree[a].as_py()
                first = own if first is None else first
                head += (b - a) * (own == first)
                tail = (tail if own == last else 0) + b - a
                last = own
        if first is not None:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "head": [head], "last": [last], "tail": [tail]})

    # One row for each task: how many rows of its first tree lie in tasks before it.
    before, base, tree, so_far = None, {}, None, 0
    for r in sorted(rows.select("tree").mapInArrow(ends, "task int, first string, head long, last string, tail long").collect()):
        base[r.task] = so_far if r.first == tree else 0
        so_far = r.tail + (base[r.task] if r.last == r.first else 0)
        tree = r.last
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, shared.value.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = edges(batch, 1)
            start = np.zeros(len(cuts) - 1, np.int64)
            own = batch.column(0)[0].as_py()
            start[0] = n if tree in (None, own) else 0
            size = np.diff(cuts)
            i = np.arange(batch.num_rows) - np.repeat(np.array(cuts[:-1]) - start, size)
            tree, n = batch.column(0)[-1].as_py(), int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i)], [*batch.schema.names, "i"])

    return rows.mapInArrow(number, StructType([*rows.schema.fields]).add("i", "long"))


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Forest:
    """Rounds of blocks of all trees, the leaves' first, and (tree, root, round): where each tree ends."""

    rounds: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame) -> Forest:
    """The trees of leaves (tree: string, never null; id: of any type that sorts; leaf, shown: binary digests)."""
    first = True
    at, rounds, roots = numbered(leaves), [], []
    while True:
        kept = [f for f in at.schema.fields if f.name in ("id", "shown")] if first else []
        schema = StructType.fromDDL("tree string, block long, n int, top int, log binary, root binary")
        for f in kept:
            schema.add(f.name + "s", ArrayType(f.dataType))

        def write(batches: Iterator[pa.RecordBatch], kept: tuple = tuple(f.name for f in kept), names: tuple = tuple(schema.names)) -> Iterator[pa.RecordBatch]:
            for batch in runs_of(batches, 2):
                cuts = edges(batch, 2)
                tree, block = (batch.column(k).take(pa.array(cuts[:-1])) for k in (0, 1))
                leaf = batch.column(3).to_pylist()
                n, top, log = [], [], []
                for (a, b), k in zip(pairwise(cuts), block.to_pylist(), strict=True):
                    n.append(b - a)
                    top.append(height_of(b - a) if k == 0 else DEPTH)  # a tree of one block ends at its root
                    log.append(appended(leaf[a:b], top[-1]))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(4 + k)) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([tree, block, pa.array(n, pa.int32()), pa.array(top, pa.int32()), pa.array([b"".join(x) for x in log]), pa.array([x[-1] for x in log]), *lists], list(names))

        rows = at.select("tree", F.shiftright("i", (FAN**DEPTH).bit_length() - 1).alias("block"), "i", "leaf", *[f.name for f in kept])
        done = (F.col("block") == 0) & (F.col("n") < BLOCK)
        blocks = checkpointed(rows.repartition(shuffle_width(at.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "i").mapInArrow(write, schema))
        rounds.append(blocks)
        roots.append(blocks.where(done).select("tree", "root", F.lit(len(rounds) - 1).alias("round")))
        at, first = blocks.where(~done).select("tree", F.col("block").alias("i"), F.col("root").alias("leaf")), False
        if at.isEmpty():
            return Forest(rounds, reduce(DataFrame.union, roots))


def descend(forest: Forest, above: DataFrame, last: Callable[[dict, list[str]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """What `last` makes of each block of leaves, with the siblings above it.

    above: (tree, and columns that go with it, among them left and right: array<string>, the siblings
    beyond the tree's root, from below). Each key of a join is there once on either side.
    """
    extra = [c for c in above.columns if c not in ("tree", "left", "right")]
    types = {f.name: f.dataType.simpleString() for f in above.schema.fields}
    asked = None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                log = digests(row["log"])
                paths = list(siblings(log, row["n"], row["top"]))
                left, right = ([[s[side] for s in path] + row[name] for path in paths] for side, name in ((0, "left"), (1, "right")))
                n = row["n"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * n), pa.array([row["block"] * BLOCK + k for k in range(n)], pa.int64()), pa.array(left, pa.list_(pa.string())), pa.array(right, pa.list_(pa.string())), *[pa.array([row[c]] * n, batch.schema.field(c).type) for c in extra]],
                    ["tree", "block", "left", "right", *extra],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                row["ids"] = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                yield from last(row, digests(row["log"]))

    names = f"tree string, block long, left array<string>, right array<string>{''.join(f', {c} {types[c]}' for c in extra)}"
    for r in range(len(forest.rounds) - 1, -1, -1):
        ends = forest.roots.where(F.col("round") == r).select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "left", "right", *extra)
        asked = ends if asked is None else asked.union(ends)
        met = forest.rounds[r].drop("root").join(asked, ["tree", "block"])
        asked = met.mapInArrow(emit, names) if r else met
    return asked.mapInArrow(leaves, schema)


def digests(log: bytes) -> list[str]:
    text = log.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


# --- datasets ------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """The trees of the groups, and the tree of their roots. id_type is the type of the rows' ids."""

    rows: Forest
    groups: Forest
    id_type: str

    def root(self) -> str | None:
        """The digest of the whole dataset; None if it has no rows."""
        found = self.groups.roots.first()
        return None if found is None else found.root.hex()

    def log(self) -> DataFrame:
        """(source, position, height, digest) of every node of every group's tree, in the order in which it was appended."""
        out = []
        sizes = self.rows.rounds[0].groupBy("tree").agg(F.sum("n").alias("leaves"))
        for r, blocks in enumerate(self.rows.rounds):

            def nodes(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
                scale = BLOCK**r
                for batch in batches:
                    for row in batch.to_pylist():
                        log, n, first = digests(row["log"]), row["n"], row["block"] * BLOCK
                        for h in range(row["top"] + 1) if r == 0 else range(1, row["top"] + 1):  # a later round's leaves are roots of the one before
                            at = places(n, row["top"])[h]
                            own = [position(first // FAN**h + j, h + DEPTH * r, row["leaves"]) for j in range(len(at))]
                            yield pa.RecordBatch.from_pydict({"tree": [row["tree"]] * len(at), "position": own, "height": pa.array([h + DEPTH * r] * len(at), pa.int32()), "digest": [log[p] for p in at]})

            out.append(blocks.select("tree", "block", "n", "top", "log").join(sizes, "tree").mapInArrow(nodes, "tree string, position long, height int, digest string"))
        return reduce(DataFrame.union, out).select(F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("source"), "position", "height", "digest")

    def _above(self) -> DataFrame:
        """(tree, subroot, root, left, right) of each group."""
        top = self.groups.roots.select("tree", F.lower(F.hex("root")).alias("root"), F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))

        def rows(row: dict, log: list[str]) -> Iterator[pa.RecordBatch]:
            paths = list(siblings(log, row["n"], row["top"]))
            sides = [[[s[side] for s in path] + row[name] for path in paths] for side, name in ((0, "left"), (1, "right"))]
            leaf = [log[p] for p in places(row["n"], row["top"])[0]]
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(leaf), pa.array([row["root"]] * row["n"]), *[pa.array(s, pa.list_(pa.string())) for s in sides]], ["tree", "subroot", "root", "left", "right"])

        return checkpointed(descend(self.groups, top, rows, "tree string, subroot string, root string, left array<string>, right array<string>"))

    def proofs(self, siblings_too: bool = True) -> DataFrame:
        """One row for each row of the dataset: (id, source, leaf, subroot, root, proof_sha256, folded_root, verified), and its proof.

        proof_sha256 is the digest of the siblings' hex texts, level by level up to the root, each
        level from left to right. folded_root is recomputed from the digest shown for the row and the
        siblings. With siblings_too, left and right hold the siblings' texts at each level, joined.
        """
        out = "id {}, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, left array<string>, right array<string>"
        kind = self.id_type

        def rows(row: dict, log: list[str]) -> Iterator[pa.RecordBatch]:
            n, up = row["n"], list(zip(row["left"], row["right"], strict=True))
            upper = "".join(a + b for a, b in up)
            leaf, proof, root, left, right = [log[p] for p in places(n, row["top"])[0]], [], [], [], []
            for own, shown, path in zip(leaf, row["showns"], siblings(log, n, row["top"]), strict=True):
                proof.append(hashlib.sha256(("".join([a + b for a, b in path]) + upper).encode()).hexdigest())
                root.append(folded(shown.hex() if shown else own, path + up))
                if siblings_too:
                    left.append([a for a, _ in path] + row["left"])
                    right.append([b for _, b in path] + row["right"])
            same = [r == row["root"] for r in root]
            paths = [pa.array(x if siblings_too else [None] * n, pa.list_(pa.string())) for x in (left, right)]
            yield pa.RecordBatch.from_arrays(
                [row["ids"], pa.array([row["tree"]] * n), pa.array(leaf), pa.array([row["subroot"]] * n), pa.array([row["root"]] * n), pa.array(proof), pa.array(root), pa.array(same), *paths],
                ["id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "left", "right"],
            )

        found = descend(self.rows, self._above(), rows, out.format(kind))
        return found.withColumn("source", F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))).drop("tree", *([] if siblings_too else ["left", "right"]))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value's UTF-8 bytes, a colon and the value, or - if it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[one(c) for c in values]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", shown: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of docs: leaves from `fields`, trees by group_col (null is a group, and comes first), leaves by id_col.

    Null ids come first, rows of one id by their digests; equal rows are leaves of their own. `shown`
    replaces fields in what proofs() holds against the tree, for the rows that `where` picks; for all
    others the row itself is shown. Other columns are not used. Texts move as digests only.
    """
    text_batches(docs.sparkSession)
    value = {f: F.col(quoted(f)) for f in fields}
    tree = F.coalesce(F.concat(F.lit("="), F.col(quoted(group_col)).cast("string")), F.lit(""))  # sorts as the group does, and null is a value
    other = F.when(where, leaf_digest([(shown or {}).get(f, value[f]) for f in fields])) if where is not None else F.lit(None).cast("binary")
    rows = build(checkpointed(docs.select(tree.alias("tree"), F.col(quoted(id_col)).alias("id"), leaf_digest(list(value.values())).alias("leaf"), other.alias("shown"))))
    groups = build(rows.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("shown")))
    return Manifest(rows, groups, docs.schema[id_col].dataType.simpleString())
