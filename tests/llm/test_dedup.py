"""Substring, line and n-gram deduplication against brute force."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tamarack.llm import graph, jaccard, line_dedup, substring_dedup
from tamarack.llm.graph import components


def words(text, fold=False):
    b = (text or "").encode()
    return (b.lower() if fold else b).split()


def spans_removed(rows, window):
    counts = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substrings(docs, rows):
    for window in (9, 35):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, window).collect()}
        assert got == spans_removed(rows, window)


def test_substrings_with_longer_prefixes(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_LEVEL", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, 12).collect()}
    assert got == spans_removed(rows, 12)


def test_substrings_keep_other_columns_and_spans(docs):
    out = substring_dedup.remove_repeats(docs, 35)
    assert set(docs.columns) < set(out.columns)
    assert out.where("n_removed <> aggregate(transform(repeats, r -> r[1] - r[0]), 0L, (a, x) -> a + x)").count() == 0


def test_repeated_rows_are_repeats(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(df).collect()) == [0, 0, 50, 50]


def test_nothing(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert line_dedup.remove_repeated_lines(nothing).count() == 0
    assert jaccard.link(nothing).count() == 0


def lines_gone(rows, percent=80):
    """Lines whose set of five-word runs has that Jaccard similarity with an earlier line's, of rows with different ids."""
    seen, out = [], {d: [] for d, _ in rows}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            w = words(line, True)
            if own := {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set():
                if any(100 * len(own & o) >= percent * len(own | o) for o in seen):
                    out[d].append(i)
                seen.append(own)
    return out


def test_lines(docs, rows):
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs).collect()}
    want = lines_gone(rows)
    for d, t in rows:
        assert got[d].removed_lines == want[d], d
        assert got[d].kept_text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


def test_lines_with_few_partners(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTNERS", 1)  # the full join must find the rest
    monkeypatch.setattr(line_dedup, "CLOSE", 0)
    got = {r.doc_id: r.removed_lines for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == lines_gone(rows)


def test_lines_with_hot_tokens(docs, rows, monkeypatch):
    want = lines_gone(rows)
    for held, gathered in ((2, 200_000), (3, 7), (1, 1)):  # tokens of more lines than are compared at a time, or than a task gathers
        monkeypatch.setattr(line_dedup, "HELD", held)
        monkeypatch.setattr(line_dedup, "GATHERED", gathered)
        assert {r.doc_id: r.removed_lines for r in line_dedup.remove_repeated_lines(docs).collect()} == want


def test_lines_of_repeated_rows(spark):
    first, second = (" ".join(f"{w}{i}" for i in range(9)) for w in "uv")
    rows = [(1, f"{first}\n{second}\n{first}"), (2, second), (None, f"{first} end"), (3, f"{second} more of it")]
    once = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((str(d), tuple(x)) for d, x in lines_gone([(-1 if d is None else d, t) for d, t in rows]).items())
    for docs in (once.union(once).coalesce(1), once.union(once)):  # in one partition and in two
        got = sorted((str(-1 if r.doc_id is None else r.doc_id), tuple(r.removed_lines)) for r in line_dedup.remove_repeated_lines(docs).collect())
        assert got == sorted(want + want)


def test_short_lines(spark, docs, rows, tmp_path):
    from tamarack.llm import queries

    menu = [(1000 + d, f"Share this\nhome\n\n{d} only\nRead on {d % 3} x\nhome\nshare  THIS") for d in range(40)]
    docs.select("doc_id", "text").union(spark.createDataFrame(menu, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed_lines for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: ",".join(map(str, x)) for d, x in lines_gone(rows + menu).items()}


def classes(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {d: d for d, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_classes(docs, rows):
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs, size, percent).collect()}
        assert got == classes(rows, size, percent)


def test_classes_without_stars(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 0)  # all links must come from the full join
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs, 4, 85).collect()}
    assert got == classes(rows, 4, 85)


def shuffles(df):
    """Exchanges of a plan that shuffle, those that are read again left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.split("== Initial Plan ==")[0].splitlines())


def test_components_deal_rows_once_by_node(spark, monkeypatch):
    made = []
    monkeypatch.setattr("tamarack.llm.graph.checkpointed", lambda df, keep=graph.checkpointed: made.append(shuffles(df)) or keep(df))
    got = dict(graph.components(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (60, 50)], "a long, b long")).collect())
    assert got == {k: 0 for k in range(31)} | {40: 40, 50: 40, 60: 40}
    assert max(made[1:]) <= 7  # a round: three shuffles of rows, each as often as the tree names it


def test_lines_are_looked_for_in_their_rows_only(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([7, 7, 8, 9]), pa.array(["a", "b", None, "d"])], ["a", "b", "text"])
    bitmap = line_dedup.lines_bitmap(spark.createDataFrame([(2, 7, 0), (4, 9, 5)], "a long, b long, line int"))
    assert line_dedup.sought(bitmap, batch).column(0).to_pylist() == [2, 4]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 10), (10, 11), (5, 5), (12, 11)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9, 11: 9, 12: 9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.link(df).collect()} == {1: 1, 2: 1, None: None}
    assert jaccard.link(df).where(F.col("doc_id").isNull()).count() == 1


def test_rows_without_an_id_whose_texts_agree_in_the_low_bits_of_their_hash(spark):
    """Two rows without an id, of different words, whose text hashes agree in 24 bits; one of them occurs elsewhere."""
    size, found = 4800, None
    while found is None:
        texts = spark.range(size).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(40)]).alias("text"))
        same = texts.groupBy(F.xxhash64("text").bitwiseAND(2**24 - 1).alias("h")).agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x <> y")
        found, size = same.first(), 2 * size
    df = spark.createDataFrame([(None, found.x), (None, found.y), (7, found.x)], "doc_id long, text string")
    out = {(r.doc_id, r["text"]): r.n_removed for r in substring_dedup.remove_repeats(df, 35).collect()}
    assert out == {(None, found.x): 40, (None, found.y): 0, (7, found.x): 40}
    out = {(r.doc_id, r["text"]): r.kept_text for r in line_dedup.remove_repeated_lines(df).collect()}
    assert out == {(None, found.x): found.x, (None, found.y): found.y, (7, found.x): ""}


def test_repeated_and_missing_ids_in_the_jaccard_join(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(40))
    near = a.replace("a59", "other")
    rows = [(1, a), (1, b), (2, near), (3, b), (None, a), (None, None), (4, None), (2, near)]
    out = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == [("1", 57, "1"), ("2", 57, "1"), ("3", 37, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 57, "None")]
