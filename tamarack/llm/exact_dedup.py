"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame functions only.

Every partition of the input is a run: its rows are sorted by digest and equal neighbours merged (the
partial aggregate of a minimum over structs sorts), so a run has one entry for each digest, with the
best row and the number of rows. Runs are then merged in rounds along a tree: in round r, runs whose
numbers agree above the r-th digit of FAN_BITS bits meet, which is FAN_BITS steps of a binomial
exchange in one multiway merge. A merge is split by digest over tasks, so no task holds a whole run,
and a digest brings a task at most 2**FAN_BITS entries, however many rows have it. The root's entries
then go back down the same tree to the rows, so a row meets its group's answer within its own run.

Entries merge only if SHA-256, a second hash and the length of the normalised text all agree; this is
verified at every level, as all three are the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_prefix, quoted

#: log2 of the runs that meet in one merge.
FAN_BITS = 4
#: ASCII white space, as [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
KEY = ("sha", "second", "bytes")


def normalised(text_col: str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), SPACE, "")


def digests(rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """rows with the columns of KEY, under names that begin with prefix, of the column `text`, which is dropped."""
    t = F.col(text)
    values = (F.unhex(F.sha2(t.cast("binary"), 256)), F.xxhash64(t), F.octet_length(t))
    return rows.withColumns({prefix + name: v for name, v in zip(KEY, values, strict=True)}).drop(text)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS) -> DataFrame:
    """One row for each row of docs: (id_col, keep_id, group_size, kept, text_sha256, n_chars).

    Texts are equal if they are identical without their ASCII white space; null counts as empty. Of
    equal texts the row with the most code points stays, then the one with the smallest id (a null id
    after all others); of rows that agree in that too, exactly one. keep_id is the id of the row that
    stays, and null if that has none. Ids may be of any type that sorts. Other columns of docs are not
    used, whatever they are called. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    plain = docs.select(F.col(quoted(id_col)).alias("id"), F.char_length(text).cast("long").alias("n_chars"), normalised(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # The number of a row has the number of its partition, its run, in its high bits; the checkpoint holds on to both.
    rows = checkpointed(digests(plain, "text").withColumn("run", F.shiftright("row", 33)))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    levels = [rows.groupBy("run", *KEY).agg(best, F.count("*").alias("n"))]
    last = rows.agg(F.max("run")).first()[0] or 0
    while last:
        last >>= fan_bits
        levels.append(levels[-1].groupBy(F.shiftright("run", fan_bits).alias("run"), *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    answer = levels.pop()
    for level in reversed(levels):
        below = level.select("run", *KEY, F.shiftright("run", fan_bits).alias("above"))
        answer = below.join(answer.withColumnRenamed("run", "above"), ["above", *KEY]).drop("above")
    found = rows.join(answer, ["run", *KEY])
    return found.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns as they are.

    Which stays is as in groups(). Rows that agree in id, normalised text and number of code points
    are first cut to one in each partition, so a hot row moves once from each.
    """
    p = free_prefix(docs)
    keys = [p + "id", p + "n_chars", p + "sha"]
    kept = groups(docs, id_col, text_col).where("kept").select(F.struct(F.col(quoted(id_col))).alias(keys[0]), F.col("n_chars").alias(keys[1]), F.unhex("text_sha256").alias(keys[2]))
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    # A struct of one field takes a null id for a value.
    rows = docs.withColumns({keys[0]: F.struct(F.col(quoted(id_col)).alias(id_col)), keys[1]: F.char_length(text).cast("long"), keys[2]: F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))})
    return rows.dropDuplicates(keys).join(kept, keys, "left_semi").drop(*keys)
