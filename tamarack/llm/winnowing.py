"""Document fingerprints by winnowing, in DataFrame functions only.

The units of a text are its words, and the characters of runs of more than WIDEST characters without
white space, so scripts written without spaces are served too. Each run of GRAM units has a rolling
hash, the polynomial of its units' hashes modulo a prime. (Spark's array functions keep no state from
one element to the next, so the few terms that rolling would carry along are taken from the array anew.)
In each window of WINDOW runs the run of least hash is chosen, the rightmost of ties. A fingerprint is
the chosen runs' (position, hash). Any stretch of GRAM + WINDOW - 1 units that two texts share gives
them a common fingerprint hash, and nothing shorter than GRAM units does. Hashes of units have 30 bits
and those of runs 36, beside 27 bits of position in one number: two different runs agree by chance
once in 2**30 pairs or less often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, quoted, row_key, shuffle_width

GRAM, WINDOW = 4, 4
#: Longest run without white space that is one unit.
WIDEST = 24
#: Rows of a range of neighbours, about, while there are fewer ranges than RANGES; their bounds are on the driver.
RANGE_ROWS, RANGES = 20_000, 4096
#: A prime below 2**31 and a base, so that no product leaves 64 bits; bits that hold a position.
UNIT = f"[^ \\t-\\r]{{1,{WIDEST}}}+(?![^ \\t-\\r])|[^ \\t-\\r]"
PRIME, BASE, PLACE_BITS = 2_147_483_647, 1_000_003, 27


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """Words of a text, A to Z and the like in lower case; of a run of more than WIDEST characters, each character but those of its end."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(UNIT), F.lit(0))


def chosen_runs(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen runs of a text, in order: hash * 2**27 + (2**27 - 1 - position), so that the least is the rightmost of the least hashes."""
    hashes = F.transform(units(text), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x3FFFFFFF)))
    last = (1 << PLACE_BITS) - 1

    def spread(value: Column, at: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 28).bitwiseAND(F.lit((1 << 36) - 1)) * F.lit(1 << PLACE_BITS) + (F.lit(last) - at.cast("long"))

    def rolled(h: Column) -> Column:
        def run(i: Column) -> Column:
            total = h[i]
            for j in range(1, gram):
                total = (total * F.lit(BASE) + h[i + j]) % F.lit(PRIME)
            return spread(total, i)

        whole = F.array(spread(F.xxhash64(h), F.lit(0)))  # of fewer words than a run
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < gram, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - gram, F.lit(0))), run))

    def least(e: Column) -> Column:
        some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(e) - window, F.lit(0))), lambda i: F.least(*[e[i + j] for j in range(window)])))
        return F.when(F.size(e) <= window, F.filter(F.array(F.array_min(e)), lambda x: x.isNotNull())).otherwise(some)

    return let(let(hashes, rolled), least)


def fingerprint(runs: Column) -> Column:
    """array<struct<position, hash>> of chosen_runs()."""
    last = (1 << PLACE_BITS) - 1
    return F.transform(runs, lambda e: F.struct((F.lit(last) - e.bitwiseAND(F.lit(last))).cast("int").alias("position"), F.shiftright(e, PLACE_BITS).alias("hash")))


def likeness(x: Column, y: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; 1 of two empty ones."""
    hashes = lambda f: F.array_distinct(F.transform(f, lambda e: e["hash"]))
    both = lambda a, b: let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(let(hashes(x), lambda a: let(hashes(y), lambda b: F.when(F.size(a) + F.size(b) > 0, both(a, b)).otherwise(1.0))), F.lit(0.0)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with the fingerprint of text_col. Null and empty texts have an empty one; equal texts have equal ones.

    Texts of fewer words than a run have one entry, of the whole. A column of that name is replaced.
    """
    return docs.withColumn(out_col, fingerprint(chosen_runs(F.col(quoted(text_col)).cast("string"), gram, window)))


def place_in(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are value or less, by bisection."""
    if not bounds:
        return F.lit(0)
    own = F.array(*[F.lit(b) for b in bounds])

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        right = (state["lo"] < state["hi"]) & (F.get(own, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(state["lo"]).alias("lo"), F.when(right | (state["lo"] >= state["hi"]), state["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, runs, next_text, next_runs): each row and its chosen runs with those of the next in descending id; after the last comes the first.

    Rows that repeat an id follow each other by a hash of the text, copies in any order; a null id
    comes last. Texts move once, to ranges of ids of about equal size, and are fingerprinted there. The
    last of a range gets the first row of the next as a copy at its end; those rows are found on keys
    alone. The bounds of the ranges, RANGES or the session's shuffle width at most, are on the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(*row_key(id_col, text_col), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    parts = max(shuffle_width(spark), min(RANGES, -(-docs.count() // RANGE_ROWS)))
    cuts = rows.agg(F.percentile_approx("a", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    placed = rows.withColumn("part", place_in(sorted(set(cuts or [])), F.col("a")))
    key = F.struct("a", "b")
    heads = checkpointed(placed.groupBy("part").agg(F.max(key).alias("head")))  # a row for each range
    order = Window.orderBy(F.desc("part"))
    ends = heads.select(F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), "head.*")
    tails = rows.join(F.broadcast(ends), ["a", "b"]).select("a", "b", "doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("tail"))
    both = placed.withColumn("tail", F.lit(False)).unionByName(tails).repartition(parts, "part").withColumn("runs", chosen_runs(F.col("text")))
    after = Window.partitionBy("part").orderBy("tail", F.desc("a"), F.desc("b"))
    both = both.withColumns({"next_text": F.lead("text").over(after), "next_runs": F.lead("runs").over(after)})
    return both.where(~F.col("tail")).select("doc_id", "text", "runs", "next_text", "next_runs")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of
    the next document's text; a table of one row has itself as the next. A null text counts as empty.
    Other columns are left out. An empty table gives an empty result.
    """
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", n)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_runs", chosen_runs(F.col("edited")))
    prints = rows.select("doc_id", "n_chars", "text", "edited", *[fingerprint(F.col(c)).alias(name) for c, name in (("runs", "fingerprint"), ("edited_runs", "edited_fingerprint"), ("next_runs", "next_fingerprint"))])
    return prints.select("doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
