"""Encoding, packing, sharding, fingerprints, neighbours, languages and licences."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarack.llm import ann, byte_bpe, langid, licences, packing, sharding, winnowing

RANKS = P.path("byte_bpe_50k.tiktoken")
OWN = byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tabthe'sréß日😀01.,#\x1c\xa0 "), max_size=60))
def test_bpe_equals_the_library(text):
    ids = OWN.encode_many([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == REF.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_bpe_with_a_tiny_dictionary():
    own = byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), P.PATTERN, cache_entries=3)
    texts = ["the quick brown fox", "jumps over the lazy dog", "x" * 500, None, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == [REF.encode_ordinary(t or "") for t in texts]


def test_bpe_frames(docs, rows, nothing):
    got = {r.doc_id: r for r in byte_bpe.encode_digests(docs, RANKS, P.PATTERN).collect()}
    for d, t in rows:
        ids = np.array(REF.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert both.where("decode(decoded, 'utf-8') <> coalesce(text, '')").count() == 0
    assert byte_bpe.encode_digests(nothing, RANKS, P.PATTERN).count() == 0


def test_word_ids_with_a_tiny_dictionary():
    path = P.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), packing.WordIds(path, cache_entries=3)
    asked = []
    own.plain = lambda word, plain=own.plain: asked.append(word) or plain(word)
    odd = ["".join(chr(c) + " " for c in range(0xC0, 0x250)), "Stra\u00dfe, \u00e0\u00ed \u00c9t\u00e9! K\u212a e\u0301 \u0130", "don't 's dogs' <|endoftext|>x", "a\x1cb\x0bc\u2003d  ", None, ""]
    for texts in (["The the, the... THE! cat."] * 3, odd, ["a1b2 \u4e2d\u6587 ...x", "the cat"] * 2):
        flat, ends = own.encode(pa.array(texts, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked[:6] == ["the", "cat", "", ",", "...", "!"]  # a word of a block is asked for once, whatever its case and marks


def test_pieces_and_packing(docs, rows, nothing):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.token_pieces(docs, path, capacity=256)
    got = packing.pack(pieces, capacity=256).toPandas().sort_values(["doc_id", "piece"])
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == d]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes() and own.start.tolist() == list(range(0, len(ids), 256))
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.offset + placed.length
    assert ends.max() <= 256 and (placed.offset == ends.groupby(placed.sequence_id).shift(fill_value=0)).all()
    assert got.sequence_id.nunique() <= 1.1 * math.ceil(got.length.sum() / 256) + 1
    assert packing.pack(packing.token_pieces(nothing, path)).count() == 0


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(1)
    for limit in (0, 3000, packing.STEPS):
        histogram = {int(n): int(k) for n, k in zip(rng.integers(1, 101, 60), rng.integers(1, 200, 60), strict=True)}
        plan = packing.configurations(histogram, 100, limit)
        total = {}
        for config, times in plan:
            assert sum(n * a for n, a in config.items()) <= 100
            for n, a in config.items():
                total[n] = total.get(n, 0) + a * times
        assert total == histogram
        assert sum(t for _, t in plan) <= 1.25 * sum(n * k for n, k in histogram.items()) / 100 + 5


def fewest(sizes, capacity):
    """The least number of sequences, by trying all fillings."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_packing_against_all_fillings():
    rng = np.random.default_rng(3)
    for _ in range(25):
        sizes = sorted(rng.integers(1, 21, 11).tolist(), reverse=True)
        histogram = {n: sizes.count(n) for n in sizes}
        least = fewest(sizes, 20)
        assert least <= sum(t for _, t in packing.configurations(histogram, 20)) <= least + 1


def test_program_is_solved():
    """The fractional solution covers all demand, lies near its bound, and the plan lies near the bound of the tokens."""
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 4096, 3000), (rng.gamma(2, 500, 20000) + 1).astype(int) % 4095 + 1, np.full(500, 2049), np.array([1] * 900 + [4095] * 300)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        groups, x, bound = packing.program(histogram, 4096)
        held = sum(np.array(config) * amount for config, amount in x.items())
        assert (held >= np.array([sum(k for _, k in g) for g in groups]) - 1e-6).all()
        assert bound <= sum(x.values()) * (1 + 1e-9) and sum(x.values()) <= 1.05 * bound + 1
        left = dict(histogram)
        plan = packing.best_fit_decreasing(left, 4096, packing.rounded(left, 4096, packing.STEPS))
        plain = packing.best_fit_decreasing(dict(histogram), 4096)
        assert sum(t for _, t in plan) <= 1.01 * sum(t for _, t in plain) + 1


def test_shards(docs, rows, nothing, spark):
    out = sharding.shard(docs, 4, 0.02).toPandas()
    size = {d: len((t or "").encode()) + 1 for d, t in rows}
    assert out.set_index("doc_id")["size"].to_dict() == size and set(docs.columns) < set(out.columns)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    own = out.groupby("shard")["size"].sum()
    assert own.max() - own.min() <= max(size.values()) + 0.05 * sum(size.values())
    assert sharding.shard(nothing, 4).count() == 0
    hot = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}") for i in range(4000)], "doc_id long, text string")
    own = sharding.shard(hot, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(own) == 8 and own.max() <= 1.05 * own.mean()


def test_shards_in_parts(docs, rows, monkeypatch):
    """Slots stay gapless where a shard is numbered by many tasks."""
    monkeypatch.setattr(sharding, "PART_BYTES", 400)
    out = sharding.shard(docs, 4, 0.02).toPandas()
    assert sorted(out.doc_id) == sorted(d for d, _ in rows)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))

def test_fingerprints(docs, rows, nothing):
    out = winnowing.edited_pairs(docs).toPandas().set_index("doc_id")
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        r = out.loc[d]
        assert r.n_chars == len(t) and r.edited == t[: len(t) - half] + n[:half]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for d, t in rows:
        same.setdefault(t or "", set()).add(tuple(map(tuple, out.loc[d].fingerprint)))
    assert all(len(v) == 1 for v in same.values())
    assert winnowing.edited_pairs(nothing).count() == 0


def plain_winnowing(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """(position, hash) of the rightmost least run of each window, by the definition."""
    import struct

    import regex
    import xxhash

    long_hash = lambda v: xxhash.xxh64(struct.pack("<q", v), seed=42).intdigest()
    own = []
    for run in regex.findall(r"[^ \t-\r]+", (text or "").lower()):
        k = max(0, len(run) - winnowing.WIDEST) if len(run) > winnowing.WIDEST else 0
        own += [*run[:k], run[k:]]
    h = [xxhash.xxh64(u.encode(), seed=42).intdigest() & 0x3FFFFFFF for u in own]
    if not h:
        return []
    if len(h) < gram:
        seed = 42
        for v in h:
            seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
        signed = seed - 2**64 if seed >= 2**63 else seed
        return [(0, (long_hash(signed) >> 28) & (2**36 - 1))]
    runs = []
    for i in range(len(h) - gram + 1):
        total = 0
        for v in h[i : i + gram]:
            total = (total * winnowing.BASE + v) % winnowing.PRIME
        runs.append((long_hash(total) >> 28) & (2**36 - 1))
    out = []
    for i in range(max(1, len(runs) - window + 1)):
        part = runs[i : i + window]
        at = i + max(k for k, v in enumerate(part) if v == min(part))
        if not out or out[-1][0] != at:
            out.append((at, runs[at]))
    return out


def test_fingerprints_against_the_definition(docs, rows, spark):
    def like(x, y):
        a, b = {h for _, h in x}, {h for _, h in y}
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    wide = [(d + 100_000, t) for d, t in enumerate(["\u4e00\u8fd9\u662f" * 200 + "\u6d4b", "abcdefghij" * 100, "x" * 24, "x" * 25, "a " * 300, "\u0e01" * 77 + " b"])]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(wide, "doc_id long, text string"))
    out = {r.doc_id: r for r in winnowing.edited_pairs(every).collect()}
    order = sorted(rows + wide, reverse=True)
    for i, (d, t) in enumerate(order):
        r, after = out[d], order[(i + 1) % len(order)][1]
        own = plain_winnowing(t)
        assert [tuple(e) for e in r.fingerprint] == own, d
        assert [tuple(e) for e in r.edited_fingerprint] == plain_winnowing(r.edited)
        assert math.isclose(r.near_edited, like(own, plain_winnowing(r.edited))) and math.isclose(r.near_next, like(own, plain_winnowing(after)))
    assert out[100_001].near_edited > 0.2  # a text without spaces keeps half of itself


def test_fingerprint_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    texts = [f"{' '.join(f'{k}{j}' for j in range(10 + k))} {shared} {' '.join(f'{k}t{j}' for j in range(k))}" for k in range(12)]
    out = winnowing.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    common = set.intersection(*[{e["hash"] for e in r.fingerprint} for r in out])
    assert common
    for r in out:  # rightmost least of each window, so no gap between positions exceeds the window
        at = [e["position"] for e in r.fingerprint]
        assert all(0 < b - a <= winnowing.WINDOW for a, b in zip(at, at[1:]))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:500] = x[300]  # a crowd of equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0, None] * 6), (904, [1.0]), (905, [float("inf")] * 12)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 30 == 0).toPandas()
    hit = total = 0
    for q in range(0, 900, 30):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        want = np.lexsort((np.arange(900), far))[:10]
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[own.vec_id])
        hit, total = hit + len(set(own.vec_id) & set(want)), total + 10
        if 300 <= q < 500:
            assert own.vec_id.tolist() == want.tolist()
    assert hit / total >= 0.9 and out.vec_id.max() < 900
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") >= 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") == 0).count() == 1


def nearest_by_all(x, ids, queries, k=10):
    out = {}
    for i in queries:
        far = ann.distances(np.broadcast_to(x[i], x.shape), x)
        order = [j for j in np.lexsort((ids, far)).tolist() if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_neighbours_beside_huge_vectors(spark):
    """Large finite vectors take part and spoil nothing; distances do not overflow."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 8)), [[1e300] * 8, [1e300, -1e300] * 4, [1.7e308] * 8, [-1.7e308] * 8]])
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, vector double")
    out = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    want = nearest_by_all(x, np.arange(len(x)), range(0, len(x), 20))
    hit = 0
    for q, near in want.items():
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        hit += len(set(own.vec_id) & {i for i, _ in near})
    assert hit / (10 * len(want)) >= 0.9
    assert np.isclose(ann.distances(x[401:402], x[400:401])[0], 1e300 * 4) and ann.distances(x[402:403], x[403:404])[0] == np.inf  # beyond doubles


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    rows = [(i, x[i].tolist()) for i in range(60)] + [(5, x[5].tolist())] * 400 + [(7, x[8].tolist())]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 8)).toPandas()
    assert len(out) == 20 and not out.duplicated(["query_id", "vec_id"]).any()
    own = out[out.query_id == 8].sort_values("rank")
    assert own.vec_id.iloc[0] == 7 and own.score.iloc[0] == 0.0


def test_languages(spark, nothing):
    rng = np.random.default_rng(2)
    parts = {"xx": ["ka", "lo", "mi", "ru"], "yy": ["sch", "ein", "ung", "ter"], "zz": ["eau", "ion", "que", "les"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(n))
    rows = [(i, make(k, int(rng.integers(5, 60))), k) for i, k in enumerate(list(parts) * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()))
    odd = spark.createDataFrame([(1000, None, "xx"), (1001, "", None), (1002, "12 -- !", None), (1003, "Q7 w8Zx vvkq jhgwq wqjh xzvq " * 30, None)], df.schema)
    out = langid.identify(df.union(odd), model).toPandas().set_index("doc_id")
    own = out.loc[: len(rows) - 1]
    assert (own.lang == own.lang_pred).mean() > 0.99 and not own.rejected.any() and own.score.between(0, 1).all()
    assert out.loc[[1000, 1001, 1002]].lang_pred.tolist() == ["und"] * 3 and out.loc[1003].rejected
    assert langid.fit(nothing.withColumn("lang", F.lit("x"))) is None
    assert langid.identify(df.limit(2), None).select("lang_pred").distinct().collect()[0][0] == "und"


def plain_kneser_ney(texts, order=4):
    """log P(last | others) by the textbook's recursion over dictionaries, of one language."""
    from collections import Counter, defaultdict

    grams = Counter()
    for t in texts:
        own, _ = langid.units([t])
        u = own.tolist()
        for i in range(order - 1, len(u)):
            grams[tuple(u[i - order + 1 : i + 1])] += 1
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    symbols = len(counts[1]) + 1
    tables = {}
    for n, own in counts.items():
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in own.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables[n] = (own, total, kinds, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5)

    def p(g):
        if not g:
            return 1 / symbols
        own, total, kinds, discount = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return max(own[g] - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_language_probabilities_against_the_recursion():
    texts = ["abcab cab bca", "bca abc ccc a", "aab"]
    own, _ = langid.units(texts)
    one = plain_kneser_ney(texts)
    grams = langid.packed(own)
    starts = langid.units(texts)[1]
    inside = np.ones(len(grams), bool)
    for k in range(1, langid.ORDER):
        inside[starts[1:-1] - k] = False
    keys, n = np.unique(grams[inside], return_counts=True)
    model = langid.build(["a"], [keys], [n])
    asked = [(1, 1, 1, 97), (97, 98, 99, 97), (99, 99, 99, 98), (120, 121, 98, 99), (120, 120, 120, 97), (1, 1, 97, 122)]
    got = model.log_probabilities(np.array([sum(u << (16 * (3 - i)) for i, u in enumerate(g)) for g in asked], np.uint64))[:, 0]
    assert np.allclose(got, [math.log(one(g)) for g in asked], atol=1e-4)


def test_language_rejection_beside_wrong_labels(spark):
    """A few junk texts among the labelled rows, many copies of one text, and letters beyond the first planes."""
    rng = np.random.default_rng(6)
    parts = {"xx": ["ka", "lo", "mi", "ru"], "und": ["sch", "ein", "ung", "ter"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k], rng.integers(1, 4))) for _ in range(int(rng.integers(10, 40))))
    rows = [(i, make(k), k) for i, k in enumerate(list(parts) * 300)]
    rows += [(1000 + i, "Q7 w8Zx vvkq jhgwq wqjh xzvq " * 5, "xx") for i in range(4)] + [(2000 + i, rows[0][1], "xx") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_docs=400)
    odd = spark.createDataFrame([(1, "zzzqqq wwxxyy jjvvqq zzwwqq " * 10, None), (2, chr(0x30001) * 9, None), (3, make("und"), None), (4, make("xx"), None)], df.schema)
    out = {r.doc_id: r for r in langid.identify(odd.withColumn("__lang", F.lit(7)), model).collect()}
    assert out[1].rejected and out[2].lang_pred in ("xx", "und") and out[2].cross_entropy is not None
    assert (out[3].lang_pred, out[4].lang_pred) == ("und", "xx") and not out[3].rejected and not out[4].rejected and out[1]["__lang"] == 7


def test_scores_do_not_depend_on_the_batch():
    texts = ["abcab cab", "bca abc", "cab cab bac abba"]
    own, _ = langid.units(texts)
    keys, n = np.unique(langid.packed(own), return_counts=True)
    model = langid.build(["a"], [keys], [n])
    model.usual, model.excess = np.zeros(1), np.ones(4)
    alone = model.predict([texts[2]])[0]
    assert model.predict([*texts, *texts])[5] == alone and model.predict(["x" * 999, "", texts[2]])[2] == alone


def test_language_probabilities_sum_to_one():
    texts = ["abcab cab", "bca abc"]
    own, _ = langid.units(texts)
    keys, n = np.unique(langid.packed(own), return_counts=True)
    model = langid.build(["a"], [keys], [n])
    symbols = [97, 98, 99, 32, langid.PAD]
    ctx = (98 << 48) | (99 << 32) | (97 << 16)
    p = sum(math.exp(model.log_probabilities(np.array([ctx | s], np.uint64))[0, 0]) for s in symbols)
    assert p <= 1.0001


def licences_by_all_pairs(files):
    """Best (score, licence, line) of each path: every unit against every template, by plain cosine."""
    import re
    from collections import Counter, defaultdict

    words = lambda t: re.findall(licences.WORD, t.lower())
    known = [(name, Counter(words(t))) for name, t in licences.TEMPLATES]
    vocabulary = set().union(*[c for _, c in known])
    texts = [(p, t) for p, t in files if t is not None]
    df = Counter(w for _, t in texts for w in set(words(t)))
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in vocabulary}
    best = defaultdict(list)
    for path, text in texts:
        if path is None:
            continue
        lines = text.split("\n")
        units = [(i, False, x) for i, x in enumerate(lines)] + [(0, True, text)]
        head = next((i for i, x in enumerate(lines) if not re.search(licences.COMMENT, x)), len(lines))
        units.append((0, False, "\n".join(lines[:head])))
        at = 0
        for p in re.split("\n[ \t\r]*\n", text):
            units.append((at, False, p))
            at += p.count("\n") + 2
        for line, whole, unit in units:
            tf = Counter(words(unit))
            own = {w: (1 + math.log(n)) * idf[w] for w, n in tf.items() if w in idf}
            norm = math.sqrt(sum(x * x for x in own.values()) + sum(n for w, n in tf.items() if w not in idf))
            for name, c in known:
                theirs = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
                dot = sum(own.get(w, 0) * x for w, x in theirs.items())
                size = math.sqrt(sum(x * x for x in theirs.values()))
                if dot and round(dot / norm / size, 9) >= licences.THRESHOLD:
                    best[path].append((-round(dot / norm / size, 9), name, line, not whole))
    return {p: (min(b)[1], -min(b)[0], min(b)[2]) for p, b in best.items()}


def test_licences_against_all_pairs(spark):
    import textwrap

    text = {name: t for name, t in licences.TEMPLATES}
    longest = {name: max((t for n, t in licences.TEMPLATES if n == name), key=len) for name in text}
    comment = lambda t, mark: "\n".join(f"{mark} {x}" for x in textwrap.wrap(t, 60))
    prose = "the cat sat on the mat and looked at a long road of red houses near the old mill"
    files = [(f"r{i}/LICENSE", "Copyright (c) 2020 Someone\n\n" + textwrap.fill(longest[n], 70, break_on_hyphens=False)) for i, n in enumerate(sorted(longest))]
    files += [(f"h{i}/a.py", comment(longest[n], mark) + f"\n\nimport x\n{prose}\n" * 3) for i, (n, mark) in enumerate([("Apache-2.0", "#"), ("GPL-3.0", "//"), ("MPL-2.0", " *")])]
    files += [("l/a", f"{prose}. Released under the MIT License by the people of the mill. {prose}"), ("l/b", "\n".join([prose] * 40)), ("l/c", f"{prose}\n\n{textwrap.fill(longest['ISC'], 50)}\n\n{prose}")]
    files += [("l/d", "my license plate is lost in the long grass behind a house"), ("l/e", ""), ("l/f", None), (None, "MIT License"), ("l/g", " \n\n\n "), ("l/h", "Licensed under CC BY-SA 4.0.\n" * 3), ("l/i", "license " * 2000)]
    got = {r.path: (r.own_licence, r.own_score, r.licence_line) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect() if r.own_licence}
    want = licences_by_all_pairs(files)
    assert {p: (a, round(b, 6), c) for p, (a, b, c) in got.items()} == {p: (a, round(b, 6), c) for p, (a, b, c) in want.items()}
    assert {n: got[f"r{i}/LICENSE"][0] for i, n in enumerate(sorted(longest))} == {n: n for n in longest}
    assert [got[p][0] for p in ("h0/a.py", "h1/a.py", "h2/a.py", "l/c", "l/h")] == ["Apache-2.0", "GPL-3.0", "MPL-2.0", "ISC", "CC-BY-SA-4.0"]
    assert "l/b" not in got and "l/d" not in got and "l/e" not in got


def test_licences(spark, nothing):
    files = [
        ("a/LICENSE", "MIT License\nReleased under the MIT License."),
        ("a/b/c/x.py", "code"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/y.py", "# Licensed under CC BY-NC 4.0.\ncode code"),
        ("a/z.py", None),
        ("q/w.py", "no terms here, my license plate is lost in the long grass behind a house"),
        (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "licence int, path string, text string")
    got = {r.path: (r.own_licence, r.licence, r.licence_from) for r in licences.scan(df).collect()}
    assert got["a/b/c/x.py"] == (None, "Apache-2.0", "a/b/LICENSE") and got["a/z.py"] == (None, "MIT", "a/LICENSE")
    assert got["a/y.py"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/y.py") and got["q/w.py"] == (None, None, None) and got[None] == (None, None, None)
    assert licences.scan(nothing.withColumn("path", F.lit("x"))).count() == 0
