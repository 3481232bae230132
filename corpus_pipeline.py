"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as a table that was written and read again. All but the
last return the columns of documents, COLUMNS; columns beside these are left out, and where a stage
changes texts, n_chars is counted anew. Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import jaccard, langid, line_dedup, packing, substring_dedup
from tamarack.llm.common import ensure_checkpoint_dir, text_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with the column named `text` as their text."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the models reject go.

    So do null texts and texts without letters. Repeated rows are judged alike.
    """
    model = langid.fit(docs)
    return langid.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; documents that had words and lost all of them go.

    Earlier is by (doc_id, line), a null id first. Rows that repeat an id and text keep the same lines;
    the near duplicates are the next stage's. Null, empty and blank texts stay as they are.
    """
    out = line_dedup.remove_repeated_lines(docs, percent=80)
    left = F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]") | (F.size("removed_lines") == 0)
    return with_text(out.where(left), "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near duplicates.

    Rows that repeat an id stand and fall together. Rows without an id, and texts without words, stay.
    """
    found = jaccard.link(docs, size=5, percent=80)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 50 words or more that occur more than once.

    Untouched texts stay as they are, null and empty ones too; a document that loses all its words goes.
    Repeated rows are repeats of one another, and go if they have 50 words.
    """
    out = substring_dedup.remove_repeats(docs, window=50)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return with_text(out.withColumn("kept_text", text).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0)), "kept_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096; a null or empty text is one end token. Every row gives its own pieces."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length"))


#: Rows of texts that Spark's reader holds as columns at a time, and that a batch for Python holds: both bound an executor's memory.
READ_ROWS, BATCH_ROWS = 256, 500


def in_small_batches(stage):
    """The stage, in a session that reads and sends few whole texts at a time; a stage may follow any other on the same executors."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
        text_batches(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, in_small_batches(stage))
    for name, stage in (
        ("language_id", language_id),
        ("line_dedup", lines),
        ("near_duplicates", near_duplicates),
        ("substring_dedup", substrings),
        ("packing", packed),
    )
]

#: Learned models and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents. Between them, texts lie as Parquet in the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
