"""N-gram Jaccard join with several global token orders, and the classes of its links.

A document's set holds the hashes of its word shingles. Documents with equal sets are one class
before anything is joined. Two sets of Jaccard similarity t or more share a token among the first
|x| - ceil(t |x|) + 1 of each, under any global order of the tokens. Three orders are used. All put
rare tokens first, by tables of fixed size made over the whole corpus, and break ties by three
different hashes. Tokens of one document alone come first of all and are not joined; a document with
too many of them has no partner. The first order's prefixes are joined, with length and position filters; a
candidate must also share prefix tokens under the two other orders before it is verified.

Within a large group of similar documents all pairs would be candidates. So links are first looked
for along stars: in each bucket (documents that share a prefix token) each document is paired with
one member of another class, picked by a hash, over a few rounds, and found links merge classes.
What then remains, pairs of different classes, is joined in full (behind the filters, and a bound on
their sets' difference by parity bits), so no link between classes is lost: the classes are exactly the connected components of the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, checkpointed, grams, lists, mix, quoted, range_hashes, text_batches
from .graph import components
from .shared_tokens import Shared, shared_tokens
from .sketch import bitmap_of, inside

#: Rounds of stars, and partners of a document in each.
ROUNDS, PARTNERS = 1, 4
#: Words of 64 parity bits in a set's sketch.
SKETCH = 8
_U = np.uint64
_SEEDS = (_U(0), _U(0x243F6A8885A308D3), _U(0x13198A2E03707344))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, flat, and offsets into them."""
    words = Words(data, offsets, fold)
    all_grams = grams(words.hashes, size)
    out, ends, total = [], [0], 0
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.unique(all_grams[a : b - size + 1])
        elif b > a:
            own = range_hashes(words.hashes[a:b], np.array([0]), np.array([b - a]), 1)
        else:
            own = all_grams[:0]
        out.append(own)
        total += len(own)
        ends.append(total)
    return (np.concatenate(out) if out else np.zeros(0, _U)), np.array(ends)


def row_hash(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(_U)) ^ marks.view(_U)


def order_keys(tokens: np.ndarray, level: np.ndarray, which: int) -> np.ndarray:
    """Sort keys of a global order of tokens: rare ones first, ties by the order's own hash."""
    return (level.astype(_U) << _U(56)) | (mix(tokens ^ _SEEDS[which]) >> _U(8))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def find_shared(docs: DataFrame, text_col: str, size: int, fold: bool) -> Shared:
    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in blocks(batch.column(0)):
            yield shingle_sets(data, offsets, size, fold)[0]

    return shared_tokens(docs.select(F.col(text_col).cast("string")), tokens)


def link(docs: DataFrame, size: int = 5, percent: int = 80, fold: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id, and one for each row without an id: (doc_id, n_shingles, component_id).

    Texts are linked whose shingle sets (size words each; the whole sequence if shorter) have
    100 * |intersection| >= percent * |union|. component_id is the smallest id that links reach. Null
    and empty texts have no shingles and no links. Of rows that repeat an id one set is chosen, the
    largest (ties: by signature), and the id stands for that set alone. Rows without an id are linked
    with nothing, and their component_id is null.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    without, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    shared = spark.sparkContext.broadcast(find_shared(docs, "text", size, fold))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in blocks(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, size, fold)
                marks = [range_hashes(flat, ends[:-1], ends[1:], w) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(ends), pa.int64()), *[pa.array(m.view(np.int64)) for m in marks]], ["doc_id", "n_shingles", "s1", "s2"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in blocks(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, size, fold)
                marks = range_hashes(flat, ends[:-1], ends[1:], 0).view(np.int64)
                stands = inside(standing.value, row_hash(ids[a:b], marks))
                level = shared.value(flat)
                keys = order_keys(flat, level, 0)
                common = np.concatenate([[0], np.cumsum(level > 0)])
                n, may = np.diff(ends), common[ends[1:]] - common[ends[:-1]]
                tokens, places, of = [], [], []
                for i in np.flatnonzero(stands & (n > 0) & (100 * may >= percent * n)).tolist():  # a partner shares that many at least
                    lo, hi = ends[i], ends[i + 1]
                    own = np.argsort(keys[lo:hi])[: prefix_size(int(hi - lo), percent)]
                    place = np.flatnonzero(level[lo:hi][own] > 0)
                    tokens.append(flat[lo:hi][own][place])
                    places.append(place)
                    of.append(np.full(len(place), i))
                if tokens:
                    at = np.concatenate(of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(ids[a:b][at]), pa.array(np.concatenate(places).astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(marks[at])],
                        ["token", "doc", "place", "n", "s1"],
                    )

    signed = checkpointed(docs.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "s1", "s2")).alias("s")).select("doc_id", "s.*"))
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = checkpointed(classes.select(F.col("rep").alias("doc"), "s1"))
    # Only one row for each set is posted: a table of fixed size keeps copies back, and the join those that it lets through.
    standing = spark.sparkContext.broadcast(bitmap_of(reps, lambda t: iter([row_hash(t.column(0).to_numpy(), t.column(1).to_numpy())])))
    postings = docs.mapInArrow(post, "token long, doc long, place int, n int, s1 long").join(reps, ["doc", "s1"], "left_semi").distinct()
    over = Window.partitionBy("token")
    postings = postings.withColumns({"lo": F.min("doc").over(over), "hi": F.max("doc").over(over)}).where("lo <> hi")
    kept = checkpointed(postings.select("token", "doc", "place", "n", "s1"))
    asked = checkpointed(kept.select("doc", "s1").distinct())
    sought = spark.sparkContext.broadcast(bitmap_of(asked, lambda t: iter([row_hash(t.column(0).to_numpy(), t.column(1).to_numpy())])))

    def sought_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the sets in question, as far as a table of fixed size tells."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in blocks(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, size, fold)
                marks = range_hashes(flat, ends[:-1], ends[1:], 0).view(np.int64)
                some = pa.array(inside(sought.value, row_hash(ids[a:b], marks)) & (np.diff(ends) > 0))
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in (batch.column(0).slice(a, b - a), pa.array(marks), batch.column(1).slice(a, b - a))], ["doc_id", "s1", "text"])

    asked = asked.withColumnRenamed("doc", "doc_id")
    texts = checkpointed(docs.mapInArrow(sought_texts, "doc_id long, s1 long, text string").join(asked, ["doc_id", "s1"], "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))
    kept = kept.drop("s1")
    verified = classes_of = None
    for round_ in range(ROUNDS):
        found = verify(star_pairs(labelled(kept, classes_of), round_, percent), texts, size, percent, fold)
        verified = checkpointed(found if verified is None else verified.union(found))
        classes_of = components(verified)
    rest = residual_pairs(labelled(kept, classes_of), texts, shared, size, percent, fold)
    verified = checkpointed(verified.union(verify(rest, texts, size, percent, fold)))
    final = components(verified)
    smallest = classes.join(final, classes.rep == final.node, "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("c"))
    found = signed.join(smallest, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    alone = without.mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long")
    return found.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def labelled(postings: DataFrame, classes_of: DataFrame | None) -> DataFrame:
    """postings with the class of each document, without buckets that hold one class only."""
    if classes_of is None:
        out = postings.withColumn("class", F.col("doc"))
    else:
        out = postings.join(classes_of.withColumnRenamed("node", "doc"), "doc", "left").withColumn("class", F.coalesce("component", "doc")).drop("component")
    out = out.repartition("token")  # once, for all that goes by token
    open_ = out.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
    return out.join(open_, "token", "left_semi")


def may_link(a: str, b: str, percent: int):
    """Length and position filters: the sizes allow it, and so does what is left behind the shared token."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) >= need)


def star_pairs(postings: DataFrame, round_: int, percent: int) -> DataFrame:
    """(a, b), a > b: each document with up to PARTNERS members of other classes, one for each bucket."""
    leader = F.struct(F.xxhash64("token", "class", F.lit(round_)).alias("h"), F.xxhash64("token", "doc", F.lit(round_)).alias("g"), "class", "doc", "place", "n")
    # The two first classes of a bucket, by hash, each with its first member: whoever is not in the first takes that.
    first = postings.groupBy("token").agg(F.min(leader).alias("f"))
    rows = postings.join(first, "token")
    others = rows.where("class <> f.class").groupBy("token").agg(F.min(leader).alias("s"))
    rows = rows.join(others, "token").withColumn("l", F.when(F.col("class") != F.col("f.class"), F.col("f")).otherwise(F.col("s")))
    rows = rows.select(F.struct("doc", "place", "n").alias("x"), "l", "token").where(may_link("x", "l", percent))
    pairs = rows.select(F.col("x.doc").alias("doc"), F.col("l.doc").alias("other")).distinct()
    turn = F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("doc", "other", F.lit(round_)), "other"))
    pairs = pairs.withColumn("turn", turn).where(F.col("turn") <= PARTNERS)
    return pairs.select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b")).distinct()


def parities(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[sets, SKETCH]: 64 SKETCH bits of each set, each the parity of the tokens that hash to it.

    Bits in which two sets differ are at most as many as tokens that only one of them has.
    """
    bit = mix(flat + _U(5)) % _U(64 * SKETCH)
    out = np.zeros((len(ends) - 1, SKETCH), _U)
    some = np.flatnonzero(np.diff(ends))
    for k in range(SKETCH):
        if len(some):
            out[some, k] = np.bitwise_xor.reduceat(np.where(bit >> _U(6) == k, _U(1) << (bit & _U(63)), _U(0)), ends[some])
    return out


def other_prefixes(docs: DataFrame, shared: Broadcast, size: int, percent: int, fold: bool) -> DataFrame:
    """(doc, second, third, bits): prefixes of each document's set under the two other orders, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                flat, ends = shingle_sets(data, offsets, size, fold)
                level, out = shared.value(flat), []
                for which in (1, 2):
                    keys, own, stops = order_keys(flat, level, which), [], [0]
                    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        p = prefix_size(hi - lo, percent) if hi > lo else 0
                        own.append(flat[lo:hi][np.argsort(keys[lo:hi])[:p]])
                        stops.append(stops[-1] + p)
                    out.append(lists(np.concatenate(own) if own else flat[:0], np.array(stops)))
                bits = lists(parities(flat, ends).ravel(), np.arange(b - a + 1) * SKETCH)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out, bits], ["doc", "second", "third", "bits"])

    return docs.mapInArrow(run, "doc long, second array<long>, third array<long>, bits array<long>")


def residual_pairs(postings: DataFrame, texts: DataFrame, shared: Broadcast, size: int, percent: int, fold: bool) -> DataFrame:
    """(a, b), a > b: all candidates of different classes that pass the filters of all three orders."""
    postings = checkpointed(postings)
    asked = postings.select(F.col("doc").alias("doc_id"), "class").distinct()
    prefixes = checkpointed(other_prefixes(texts.join(asked, "doc_id", "left_semi"), shared, size, percent, fold))
    rows = postings.join(prefixes.select("doc", "bits"), "doc")
    for name in ("second", "third"):  # of each, what documents of other classes have too; who has none of it has no partner
        over = Window.partitionBy("t")
        t = prefixes.select("doc", F.explode(name).alias("t")).join(asked.withColumnRenamed("doc_id", "doc"), "doc")
        t = t.withColumns({"lo": F.min("class").over(over), "hi": F.max("class").over(over)}).where("lo <> hi")
        rows = rows.join(t.groupBy("doc").agg(F.collect_list("t").alias(name)), "doc")
    rows = checkpointed(rows.join(postings.groupBy("doc").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "token"))), lambda e: e["token"]).alias("first")), "doc"))
    x, y = rows.alias("x"), rows.alias("y")
    differing = F.lit(0)
    for k in range(SKETCH):
        differing = differing + F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k]))
    on = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.doc") > F.col("y.doc"))
        & (F.col("x.class") != F.col("y.class"))
        & may_link("x", "y", percent)
        & (differing <= F.col("x.n") + F.col("y.n") - 2 * F.ceil(percent * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent)))
        & F.arrays_overlap("x.second", "y.second")
        & F.arrays_overlap("x.third", "y.third")
        & (F.col("x.token") == F.try_element_at(F.array_intersect("x.first", "y.first"), F.lit(1)))  # at the first token in order: a pair leaves the join once
    )
    return x.join(y, on).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, fold: bool) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = []
                for c in (2, 3):
                    got = [(flat, ends) for _, _, data, offsets in blocks(part.column(c)) for flat, ends in [shingle_sets(data, offsets, size, fold)]]
                    sets.append([flat[lo:hi] for flat, ends in got for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
