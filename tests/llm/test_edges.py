"""What every operator does with clashing names, nulls in every column, and empty tables."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tamarack.llm import ann, byte_bpe, jaccard, langid, licences, line_dedup, packing, sharding, substring_dedup, winnowing

#: Names that operators use inside, in any spelling, and such as need quotes.
NAMES = ["a", "b", "d", "line", "lines", "token", "tokens", "bits", "unit", "part", "row", "rows", "hash", "id", "n", "rank", "place", "runs", "place x", "dot.ted", "tick`ed", "s1", "lang", "path2", "term", "w"]
NAMES += [f"__{x}" for x in ("a", "b", "text", "hash", "id", "size", "shard", "part", "base", "path", "dir", "d", "lang", "bucket", "row", "rank", "n", "k", "len", "from", "to", "each", "seq", "off", "may", "lost", "spans", "TEXT_2", "ROW_2")] + ["___A", "__May_x"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("ka lo mi ru ka lo", "xx"), ("sch ein ung ter ung", "yy")] * 40)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "ka lo mi ru\nka lo mi ru"), (2, None), (None, "ein ung ter"), (None, None), (4, ""), (1, "ka lo mi ru\nka lo mi ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.concat(F.lit("x/"), F.col("doc_id").cast("string")))
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


def operators(model):
    length = lambda: F.coalesce(F.length("text"), F.lit(0)) + 1
    return {
        "lines": lambda df: line_dedup.remove_repeated_lines(df),
        "substrings": lambda df: substring_dedup.remove_repeats(df, 9),
        "languages": lambda df: langid.identify(df, model),
        "licences": lambda df: licences.scan(df),
        "shards": lambda df: sharding.shard(df, 3),
        "packing": lambda df: packing.pack(df.withColumn("length", length()), 64, "length", ("doc_id", "text")),
        "fingerprints": lambda df: winnowing.with_fingerprint(df),
        "bpe": lambda df: byte_bpe.decode(byte_bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    }


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_other_columns_are_kept(wide, model, name):
    out = operators(model)[name](wide)
    got = out.collect()
    assert len(got) == 6 and len(set(out.columns)) == len(out.columns)
    for r in got:
        assert [r[c] for c in NAMES] == list(range(len(NAMES)))
    assert sorted((str(r.doc_id), str(r["text"])) for r in got) == sorted((str(r.doc_id), str(r["text"])) for r in wide.collect())


@pytest.mark.parametrize("name", sorted(operators(None)))
def test_empty_tables(wide, model, name):
    assert operators(model)[name](wide.where("false")).count() == 0


def test_operators_with_results_of_their_own(wide):
    assert {(r.doc_id, r.component_id) for r in jaccard.link(wide).collect()} == {(1, 1), (2, 2), (4, 4), (None, None)}
    assert sorted(str(r.doc_id) for r in winnowing.edited_pairs(wide).collect()) == ["1", "1", "2", "4", "None", "None"]
    assert byte_bpe.encode_digests(wide, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 6
    assert packing.token_pieces(wide, P.path("word_bpe_49k.json")).count() == 6
    vectors = wide.select("*", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    out = ann.search(vectors, F.col("vec_id") == 1, id_col="doc_id").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 1, 2, 1.0), (1, 2, 4, 3.0)]
