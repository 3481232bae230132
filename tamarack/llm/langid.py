"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; runs of anything but letters become one space. Each language has a model of
order four. The n-grams of all languages lie in one sorted array of hashes per order (four 16-bit
code units packed in 64 bits, so equal hashes mean equal n-grams; characters beyond them share one
unit) beside a matrix of interpolated log probabilities, one column for each language; contexts have
such an array with their back-off weights. A text goes to the language of least cross-entropy per
character. It is rejected if that is far above what labelled texts of its length, kept out of the
counts, have: the calibrated threshold (a quantile).

The models are fitted on a bounded sample of the labelled rows: about `sample_docs` texts of each
language, whole texts, drawn by a hash. Predictions use the text alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, quoted, text_batches

#: Texts of each language that the models are fitted on, and the share of them kept for calibration.
SAMPLE_DOCS = 1500
CALIBRATION = 5  # one in so many
ORDER = 4
#: Characters of text that a task scores at a time, and texts that are Python strings at a time.
BLOCK_CHARS, ROWS = 1 << 17, 256
#: Lengths, in characters, between which thresholds are calibrated apart.
LENGTHS = (20, 100, 500)
#: A text is rejected if its excess is MARGIN times that of the QUANTILE of the calibration texts of its length or longer,
#: and over the least limit of its length. A few wrong labels or junk texts among the labelled rows do not move that.
QUANTILE, MARGIN, LEAST = 0.98, 1.5, (2.0, 1.5, 1.0, 1.0)
PAD, SPACE, UNKNOWN_LANG = 1, 32, "und"
_U = np.uint64
_LETTERS: list[np.ndarray] = []


def units_table() -> np.ndarray:
    """16-bit unit of each code point: itself if a letter, PAD for NUL, else SPACE."""
    if not _LETTERS:
        table = np.full(sys.maxunicode + 1, SPACE, np.uint64)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                table[c] = c if 0x20 < c < 0xFFFF else 0xFFFF
        table[0] = PAD
        _LETTERS.append(table)
    return _LETTERS[0]


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units of the texts, each after ORDER - 1 pads, and where each text's pads start (and the end)."""
    pad = "\0" * (ORDER - 1)
    lowered = [t.lower().replace("\0", " ") for t in texts]
    points = np.frombuffer((pad + pad.join(lowered)).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in lowered]) + ORDER - 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    own = units_table()[points]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != SPACE) | ((own[:-1] != SPACE) & (own[:-1] != PAD))
    before = np.concatenate([[0], np.cumsum(keep)])
    return own[keep], before[starts]


def packed(own: np.ndarray) -> np.ndarray:
    """The n-gram of ORDER units that ends at each unit from the ORDER-th on."""
    return (own[:-3] << _U(48)) | (own[1:-2] << _U(32)) | (own[2:-1] << _U(16)) | own[3:]


@dataclass
class Model:
    """Sorted hash arrays of all languages; order n is at index n - 1."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_weight: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # log probability of an unseen character
    usual: np.ndarray | None = None  # mean cross-entropy of each language
    excess: np.ndarray | None = None  # largest accepted cross-entropy over the usual, by length

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram, a column for each language: log P(last unit | the others)."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        rows, now = np.arange(len(grams)), grams
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                now = now & _U(2 ** (16 * n) - 1)
            keys = self.keys[n - 1]
            at = np.minimum(np.searchsorted(keys, now), len(keys) - 1)
            hit = keys[at] == now
            if n == ORDER:
                out[hit] = self.log_p[n - 1][at[hit]]
            else:
                out[rows[hit]] += self.log_p[n - 1][at[hit]]
            rows, now = rows[~hit], now[~hit]
            if not len(rows):
                return out
            ctx, own = now >> _U(16), self.contexts[n - 1]
            at = np.minimum(np.searchsorted(own, ctx), len(own) - 1)
            seen = own[at] == ctx
            out[rows[seen]] += self.log_weight[n - 1][at[seen]]
        out[rows] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, number of characters, number of letters."""
        own, starts = units(texts)
        scored = starts[1:] - starts[:-1] - (ORDER - 1)
        per = self.log_probabilities(packed(own))
        # In `per`, a text's first character is at its pads' start. Each text is summed alone, so equal texts have equal sums.
        cuts = np.stack([starts[:-1], starts[1:] - (ORDER - 1)], 1).ravel()
        sums = np.add.reduceat(np.concatenate([per, np.zeros((1, per.shape[1]), per.dtype)]).astype(np.float64), cuts, axis=0)[::2]
        sums[scored == 0] = 0
        letters = np.concatenate([[0], np.cumsum(own > SPACE)])
        return -sums / np.maximum(scored, 1)[:, None], scored, letters[starts[1:]] - letters[starts[:-1]]

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        x, n, letters = self.entropies(texts)
        best = x.argmin(axis=1)
        least = x[np.arange(len(x)), best]
        share = np.exp(-(x - least[:, None]) * np.minimum(n, 30)[:, None])
        score = 1 / share.sum(axis=1)
        limit = self.usual[best] + self.excess[np.searchsorted(LENGTHS, n)]
        return [
            (self.langs[b], float(s), float(e), bool(e > m)) if k else (UNKNOWN_LANG, 0.0, None, True)
            for b, s, e, m, k in zip(best.tolist(), score.tolist(), least.tolist(), limit.tolist(), letters.tolist(), strict=True)
        ]


def build(langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    """Interpolated Kneser-Ney models of n-gram counts, one array of sorted n-grams for each language."""
    model = Model(langs)
    width = len(langs)
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = []
    now = list(zip(grams, counts, strict=True))
    for n in range(ORDER, 0, -1):
        by_order.insert(0, now)
        if n > 1:  # lower orders count the distinct n-grams that end in each
            mask = _U(2 ** (16 * (n - 1)) - 1)
            now = [np.unique(k & mask, return_counts=True) for k, _ in now]
    symbols = len(np.unique(np.concatenate([k for k, _ in by_order[0]]))) + 1
    lower, lower_keys = np.full((1, width), 1 / symbols), None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in by_order[n - 1]]))
        ctx = keys >> _U(16) if n > 1 else np.zeros(len(keys), np.uint64)
        contexts = np.unique(ctx)
        p, weight = np.zeros((len(keys), width)), np.ones((len(contexts), width))
        suffix = np.searchsorted(lower_keys, keys & _U(2 ** (16 * (n - 1)) - 1)) if n > 1 else np.zeros(len(keys), np.int64)
        for i, (k, c) in enumerate(by_order[n - 1]):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            at_ctx = np.searchsorted(contexts, (k >> _U(16)) if n > 1 else np.zeros(len(k), np.uint64))
            total = np.bincount(at_ctx, c, len(contexts))
            kinds = np.bincount(at_ctx, minlength=len(contexts))
            has = total > 0
            weight[has, i] = discount * kinds[has] / total[has]
            p[np.searchsorted(keys, k), i] = (c - discount) / total[at_ctx]
            p[:, i] += weight[np.searchsorted(contexts, ctx), i] * lower[suffix, i]
        model.keys.append(keys)
        model.log_p.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
        model.contexts.append(contexts)
        model.log_weight.append(np.log(weight).astype(np.float32))
        lower, lower_keys = p, keys
    model.floor = np.full(width, -np.log(symbols), np.float32)
    return model


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Models of the languages of the labelled rows; None if no row has both a text and a language.

    Rows with null text or language are left out. About `sample_docs` rows of each language are drawn
    by a hash of id and text, so copies of a text are drawn one by one; the id is no input of the
    models. Spark counts the n-grams; the driver gets those of the bounded sample.
    """
    text_batches(labelled.sparkSession)
    text, lang, row = (F.col(quoted(c)) for c in (text_col, lang_col, id_col))
    rows = labelled.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"), row.cast("string").alias("id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))  # a row for each language, of which the models have a column each
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    draw = lambda salt: F.pmod(F.xxhash64("text", "id", F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.join(F.broadcast(sizes), "lang").where(draw(0) <= F.lit(sample_docs) / F.col("size")).select("lang", "text", (draw(1) < 1 / CALIBRATION).alias("kept"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kept:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for part in text_blocks(texts):
                    own, starts = units(part)
                    grams = packed(own)
                    inside = np.ones(len(grams), bool)
                    for k in range(1, ORDER):  # n-grams that end in a pad
                        inside[(starts[1:-1] - k)[starts[1:-1] - k >= 0]] = False
                    keys, n = np.unique(grams[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    table = sample.select("lang", "text", "kept").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = [x for x in langs if (table.lang == x).any()]
    if not langs:
        return None
    grams, counts = [], []
    for lang in langs:
        own = table[table.lang == lang]
        keys = own.gram.to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        grams.append(keys[order]), counts.append(own.n.to_numpy()[order])
    model = build(langs, grams, counts)
    calibrate(model, sample.where("kept").select("lang", "text"))
    return model


def calibrate(model: Model, kept: DataFrame) -> None:
    """Thresholds from labelled texts that the counts left out."""
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for part, to in text_parts(texts):
                x, n, letters = own.entropies(texts[part:to])
                rows = [(lang, int(k), float(x[i, own.langs.index(lang)])) for i, (lang, k) in enumerate(zip(langs[part:to], n, strict=True)) if letters[i] and lang in own.langs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "n", "x"])

    got = kept.mapInArrow(score, "lang string, n long, x double").toPandas()  # bounded: part of the sample
    mean = got.x.median() if len(got) else 3.0
    model.usual = np.array([own.x.median() if len(own := got[got.lang == lang]) else mean for lang in model.langs])
    over = got.x.to_numpy() - model.usual[[model.langs.index(x) for x in got.lang]] if len(got) else np.zeros(0)
    place = np.searchsorted(LENGTHS, got.n.to_numpy()) if len(got) else np.zeros(0, int)
    high = [np.quantile(own, QUANTILE) if len(own := over[place >= k]) else 0.0 for k in range(len(LENGTHS) + 1)]
    model.excess = np.maximum(MARGIN * np.array(high), LEAST)
    shared.unpersist()


def text_parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive runs of texts of about BLOCK_CHARS characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_blocks(texts: list[str]) -> Iterator[list[str]]:
    for a, b in text_parts(texts):
        yield texts[a:b]


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), cross_entropy and rejected.

    Null texts and texts without letters are `und`, with score 0, no cross-entropy, and rejected; so
    is everything if there is no model. Columns of those names are replaced; all others are kept.
    """
    made = "lang_pred string, score double, cross_entropy double, rejected boolean"
    names = [x.split()[0] for x in made.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(arrays):
        own = shared.value
        for array in arrays:
            rows = []
            for start in range(0, len(array), ROWS):  # few texts are Python strings at a time
                texts = ["" if t is None else t for t in array.slice(start, ROWS).to_pylist()]
                for a, b in text_parts(texts):
                    rows += own.predict(texts[a:b]) if own else [(UNKNOWN_LANG, 0.0, None, True)] * (b - a)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    own = free_prefix(docs) + "lang"
    out = docs.withColumn(own, F.arrow_udf(run, made)(F.col(quoted(text_col)).cast("string")))
    return out.select(*[F.col(quoted(c)) for c in docs.columns if c not in names], *[F.col(own)[c].alias(c) for c in names])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the registered query never learns from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
