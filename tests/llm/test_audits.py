"""Exact deduplication, the filter audit and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tamarack.llm import exact_dedup, filter_audit, merkle

SPACE = re.compile("[\x20\x09-\x0d]")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, run string, `sha` int, `dot.ted` int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def documents():
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, a hot source, copies beyond number."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["UP", "Über", "中文", "a|b", "#x", " "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 30, 210, 400)))) for _ in range(90)]
    texts += [None, "", " \n", "A" * 5000, " ".join(f"n{i}" for i in range(6000)), "one two", "one\ttwo ", "onetwo", "\x0b\x0c\r", "x\x1cy", "xy"]
    rows = []
    for i in range(700):
        text = texts[7] if i % 3 == 0 else rng.choice(texts)
        if text and rng.random() < 0.2:
            text = text.replace(" ", rng.choice(("  ", "\n")), 3)
        lang = rng.choice(("en", "de", "", None, "en"))
        source = "hot" if i % 2 else rng.choice((None, "", "a", "ab", "Z", "é", "src10", "src9", f"s{i}"))
        rows.append((None if i % 97 == 5 else i * 3, text, lang, source, None if text is None else len(text), "r", 1, 2))
    rows += [rows[10], rows[10], (rows[11][0], *rows[12][1:]), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, documents):
    return spark.createDataFrame(documents, COLUMNS).repartition(37).cache()


@pytest.mark.parametrize("fan_bits", [1, 4])
def test_exact_dedup(table, documents, fan_bits):
    best, size = {}, {}
    for d, t, *_ in documents:
        own = SPACE.sub("", t or "")
        rank = (-len(t or ""), d is None, d or 0)
        best[own], size[own] = min(best.get(own, rank), rank), size.get(own, 0) + 1
    out = exact_dedup.groups(table, fan_bits=fan_bits).collect()
    keep = {own: None if r[1] else r[2] for own, r in best.items()}
    want = sorted((str(d), str(keep[own]), size[own], digest(own), len(t or "")) for d, t, *_ in documents for own in [SPACE.sub("", t or "")])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256, r.n_chars) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(best) and all(r.doc_id == r.keep_id for r in kept)
    assert {r.text_sha256: r.n_chars for r in kept} == {digest(own): -rank[0] for own, rank in best.items()}


def test_deduplicate_keeps_whole_rows(table, documents):
    out = exact_dedup.deduplicate(table)
    assert out.columns == table.columns
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) <= set(documents) and len(rows) == len({SPACE.sub("", r[1] or "") for r in documents})
    want = sorted((str(r.doc_id), r.text_sha256, r.n_chars) for r in exact_dedup.groups(table).where("kept").collect())
    assert sorted((str(r[0]), digest(SPACE.sub("", r[1] or "")), len(r[1] or "")) for r in rows) == want


def audited(rows, labels):
    """Counts by applying every order of the filters to every row."""
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = {}
    for d, t, lang, *_ in rows:
        words = [w for w in SPACE.split(t or "") if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 3 * len(t or ""),
            "D": any(c in "#$%&*|" for c in t or ""),
            "E": d is not None and d > least[t or ""],
        }
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == d and d is not None) for k in (1, 2))
        parts.setdefault(lang or "", []).append(({c for c, f in fails.items() if f}, good, toxic))
    out = []
    for part, own in parts.items():
        taken = {}
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                taken[order, s] = [r for r in own if f in r[0] and not r[0] & set(order[:s])]
        shapley = {f: sum(len(r) for (order, s), r in taken.items() if order[s] == f) for f in "ABCDE"}
        for (order, s), gone in taken.items():
            f, kept = order[s], len(own) - sum(len(taken[order, k]) for k in range(s + 1))
            out.append((part, "".join(order), s + 1, kept, len(gone), sum(f in r[0] for r in own) - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), shapley[f]))
    return sorted(out)


def test_filter_audit(spark, table, documents):
    rng = random.Random(3)
    labels = [(d, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for d, *_ in documents if d is not None and rng.random() < 0.5]
    labels += [(labels[0][0], 1, 1), (None, 1, 1), (10**9, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.mask_counts(table, known))
    assert sorted(tuple(r) for r in out.collect()) == audited(documents, labels)
    assert filter_audit.audit(filter_audit.mask_counts(table.where("false"), known)).count() == 0


def test_wide_counters_do_not_overflow(spark):
    n = 2**54 + 1  # a double can't tell it from its neighbours; 120 times as many still fit a long
    rows = [("x", 31, n, True, False), ("x", 31, n - 7, True, True), (None, 0, 5, False, False), ("y", 1, 1, True, True)]
    out = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, n long, good boolean, toxic boolean").repartition(4)).collect()
    assert len(out) == 1800
    for r in out:
        total = {"x": 2 * n - 7, "": 5, "y": 1}[r.part]
        first = {"x": r.step == 1, "": False, "y": r.filter_order[r.step - 1] == "A"}[r.part]
        assert r.removed == total * first and r.good_lost == r.removed
    assert filter_audit.fields(sum(filter_audit.step_outcomes("AB")) * 7, 5).tolist() == [14, 7, 14, 7, 28]


def climbed(nodes):
    """Levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        at = i // 16 * 16
        out.append((level[at:i], level[i + 1 : at + 16]))
        i //= 16
    return out


def proved(rows):
    leaf = lambda r, t: digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], t)])
    trees = {}
    for r in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower if tampered else r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in order:
        trees[s].sort(key=lambda x: x[:3])
        levels[s] = climbed([x[2] for x in trees[s]])
    top = climbed([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, shown, r) in enumerate(trees[s]):
            steps = path(levels[s], i) + path(top, k)
            for left, right in steps:
                shown = digest(*left, shown, *right)
            proof = digest(*[x for left, right in steps for x in left + right])
            out.append((str(r[0]), str(s), own, levels[s][-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return sorted(out), levels


def tampered_manifest(table):
    return merkle.manifest(table, shown={"text": F.translate("text", merkle.UPPER, merkle.UPPER.lower())}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def test_merkle_manifest(table, documents):
    want, levels = proved(documents)
    made = tampered_manifest(table)
    out = made.proofs().collect()
    got = sorted((str(r.id), str(r.source), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert got == want and made.root() == want[0][4]
    assert {r.verified for r in out} == {True, False}
    for r in out[:50]:
        assert digest(*[a + b for a, b in zip(r.left, r.right, strict=True)]) == r.proof_sha256
    log = {}
    for r in made.log().collect():
        log.setdefault(r.source, {})[r.position] = (r.height, r.digest)
    for source, own in levels.items():
        nodes = []  # in completion order

        def visit(h, i):
            if h:
                for j in range(16 * i, min(16 * i + 16, len(own[h - 1]))):
                    visit(h - 1, j)
            nodes.append((h, own[h][i]))

        visit(len(own) - 1, 0)
        assert [log[source][p] for p in range(len(log[source]))] == nodes


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000])
def test_merkle_trees_of_many_sizes(spark, n):
    rows = [(i, "t", None, "s" if i else "a", 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(df)
    out = made.proofs(siblings_too=False).collect()
    want = proved([r for r in rows])[0] if n else []
    assert made.root() == (want[0][4] if n else None)
    assert sorted((str(r.id), r.proof_sha256) for r in out) == sorted((w[0], w[5]) for w in want) and all(r.verified for r in out)


def test_empty_tables(table):
    none = table.where("false")
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0 and merkle.manifest(none).proofs().count() == 0
