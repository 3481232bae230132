"""The pipeline against its stages by brute force, and stage by stage."""

import importlib.util
import os

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

_spec = importlib.util.spec_from_file_location("brute", os.path.join(os.path.dirname(__file__), "test_dedup.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    marked = [(d, t, "en", f"s{d % 3}", None if t is None else len(t)) for d, t in rows if t is None or len(t) != 3000]
    spark.createDataFrame(marked, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    own = [(d, t) for d, t, *_ in marked if t and any(c.isalpha() for c in t)]
    gone = brute.lines_gone(own)
    own = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, t in own]
    own = [(d, t) for d, t in own if t.split() or not gone[d]]
    kept = brute.classes(own, 5, 80)
    own = [(d, t) for d, t in own if kept[d][1] == d]
    cut = brute.spans_removed(own, 50)
    own = {d: (t if not cut[d][1] else cut[d][2]) for d, t in own if cut[d][1] < cut[d][0] or not cut[d][0]}
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in own.items()}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert (got.groupby("sequence_id").length.sum() <= 4096).all()


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 0
    assert np.array_equal(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count(), 0)
