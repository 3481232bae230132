"""The registered queries of the text operators on the smallest tables, against their SQL and against plain Python."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tamarack.llm import ann, byte_bpe, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_op2(spark, texts):
    out = queries.op2_language_id(spark, SF).toPandas().set_index("doc_id")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    assert sorted(out.index) == sorted(texts) and out.score.between(0, 1).all()
    assert all(out.held_out[d] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in texts)
    fair = [d for d in texts if out.held_out[d] and lang[d] and any(c.isalpha() for c in texts[d] or "")]
    assert sum(out.lang_pred[d] == lang[d] for d in fair) >= 0.8 * len(fair)


def test_op6(spark, texts):
    out = queries.op6_sharding(spark, SF).toPandas().set_index("doc_id")
    for d, t in texts.items():
        raw = (t or "").encode()
        assert out["size"][d] == len(raw) + 1 and out.text_crc32[d] == zlib.crc32(raw) and 0 <= out["shard"][d] < 8
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(out.law) == {"bytes"} and len(out) == len(texts)


def test_op7(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = queries.op7_nearest(spark, SF).toPandas()
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = ann.distances(np.broadcast_to(x[i], x.shape), x)
        want = [ids[j] for j in np.lexsort((ids, far)) if j != i][:10]
        own = out[out.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, far[np.searchsorted(ids, own.vec_id)])
        hit, total = hit + len(set(want) & set(own.vec_id)), total + 10
    assert hit >= 0.9 * total


def test_op8(spark, texts):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in queries.op8_byte_bpe(spark, SF).collect():
        ids = np.array(ref.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_op10(spark, texts):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    out = queries.op10_packing(spark, SF).toPandas().sort_values(["doc_id", "piece"])
    for d, own in out.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[i : i + 4096].tobytes()) for i in range(0, len(ids), 4096)]
    placed = out.sort_values(["sequence_id", "offset"])
    ends = placed.offset + placed.length
    assert ends.max() <= 4096 and (placed.offset == ends.groupby(placed.sequence_id).shift(fill_value=0)).all()
    assert set(out.doc_id) == set(texts) and out.sequence_id.nunique() <= 1.02 * out.length.sum() / 4096 + 2


@pytest.mark.parametrize("name", ["op3_licences", "op4_winnowing"])
def test_all_documents(spark, texts, name):
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(texts)
