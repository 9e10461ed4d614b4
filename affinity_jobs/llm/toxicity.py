"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a model of words in two orders. The higher one counts a word's tokens; the lower
one spells a word by its beginning (the first ``STEM`` bytes) and counts, as Kneser-Ney models do, not tokens but the
different words that it follows, so that compounds of a telling stem count though the word itself is new. Discounts
follow from how many counts are one, two, three and four. What is discounted goes down to the next order, and at last
to counts that both classes share: how many different words an expression follows in any of them. So an expression too
rare to say anything has about the same probability in both.

A text is compared by its log-likelihoods in both classes a word: over the whole text, and over its most toxic few
words, as a long text may hold a short passage. These differences become a probability by a logistic calibration on
out-of-fold training texts. Words are runs of letters, lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, LOWER, U, chunks, fold, labelled_sample, lean, logistic, mix64, prefix_hash, sigmoid, span_hash, text_bytes, text_chunks

#: Bounds of the training sample: rows of each label, bytes of a text (longer ones don't train), and bytes of all.
TOXIC_ROWS, ORDINARY_ROWS, TEXT_BYTES, SAMPLE_BYTES = 1500, 2500, 1 << 16, 24 << 20
STEM = 6
#: A text is also compared over so many of its words, the most toxic ones.
FEW = (1, 2, 4, 8)
#: Multiples of the formula's discounts that are tried.
SCALES = (1.0, 1.5, 2.0)
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``piece_words`` of the rows, a bounded piece at a time."""
    parts = [piece_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    if not parts:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(1, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased letter runs, of their beginnings, and the n+1 offsets of the rows' words."""
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    lower = LOWER[data]
    inside = LETTER[lower]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = prefix_hash(lower)
    return span_hash(prefix, start, end), span_hash(prefix, start, np.minimum(end, start + STEM)), np.searchsorted(start, offsets)


def discounts(counts: np.ndarray, scale: float) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3 on: modified Kneser-Ney's, from how many counts are 1 to 4, times ``scale``."""
    n1, n2, n3, n4 = (max(float((counts == i).sum()), 0.5) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    formula = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.r_[0.0, np.clip(formula * scale, 0.1, [0.98, 1.96, 2.94])]


def discounted(counts: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """Shares of the counts after discounting, and the share left over."""
    d = discounts(counts, scale)[np.minimum(counts, 3).astype(np.int64)]
    total = max(float(counts.sum()), 1.0)
    return (counts - d) / total, float(d.sum()) / total if counts.any() else 1.0


def distinct_before(units: np.ndarray, unit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many different words each of ``units`` (sorted) follows."""
    once = unit[np.unique(mix64(unit + before * U(0x9E3779B97F4A7C15)), return_index=True)[1]]
    return np.bincount(np.searchsorted(units, once), minlength=len(units)).astype(float)


class Models:
    """Both classes' models, as one log-ratio (toxic against ordinary) for each word and each stem seen."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, scale: float = 1.0):
        word, stem, at = letter_words(data, offsets)
        before = np.r_[U(0), word[:-1]].astype(U)
        before[at[:-1][at[:-1] < len(word)]] = 0
        label = np.repeat(labels, np.diff(at))
        self.words, first, place = np.unique(word, return_index=True, return_inverse=True)
        self.stems = np.unique(stem)
        of = np.searchsorted(self.stems, stem[first])  # each word's stem
        shared, shared_stem = distinct_before(self.words, word, before), distinct_before(self.stems, stem, before)
        bottom = (shared_stem + 0.5) / (shared_stem.sum() + 0.5 * (len(self.stems) + 1))
        # a word's share of its stem; one more word of each stem is yet to be seen
        inside = np.bincount(of, weights=shared, minlength=len(self.stems)) + 1.0
        spell = shared / inside[of]
        tokens, stems, fresh = [], [], []
        for c in (0, 1):
            own = label == c
            share, left = discounted(distinct_before(self.stems, stem[own], before[own]), scale)
            lower = share + left * bottom
            counts, rest = discounted(np.bincount(place[own], minlength=len(self.words)).astype(float), scale)
            tokens.append(np.log(counts + rest * lower[of] * spell))
            stems.append(np.log(rest * lower))
            fresh.append(np.log(rest * left))
        self.ratio, self.stem_ratio, self.new = tokens[1] - tokens[0], stems[1] - stems[0], fresh[1] - fresh[0]

    def ratios(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Each word's log-likelihood ratio, toxic against ordinary: its own, its stem's, or that of new stems."""
        if not len(self.words) or not len(word):
            return np.zeros(len(word))
        at = np.minimum(np.searchsorted(self.stems, stem), len(self.stems) - 1)
        out = np.where(self.stems[at] == stem, self.stem_ratio[at], self.new)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.ratio[at], out)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the difference of log-likelihoods a word, over all words and over the most toxic ``FEW``; 0 without words."""
        word, stem, at = letter_words(data, offsets)
        ratio, n = self.ratios(word, stem), np.diff(at)
        total = np.r_[0, np.cumsum(ratio)]
        falling = np.r_[0, np.cumsum(ratio[np.lexsort([-ratio, np.repeat(np.arange(len(n)), n)])])]
        some = [(falling[np.minimum(at[:-1] + k, at[1:])] - falling[at[:-1]]) / k for k in FEW]
        return np.stack([(total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), *some], axis=1)


class Classifier:
    """The two models and a logistic calibration of their differences, fitted on out-of-fold training texts."""

    def __init__(self, column: pa.Array, labels: np.ndarray):
        data, offsets = text_bytes(column)
        self.rate = float(labels.mean()) if len(labels) else 0.0
        self.models, self.weights, self.scale = None, None, np.ones(1 + len(FEW))
        if not 0 < self.rate < 1:
            return
        part = np.arange(len(labels)) % 4
        part[np.argsort(labels, kind="stable")] = part.copy()
        tried = [self.out_of_fold(column, labels, part, scale) for scale in SCALES]
        _, scale, self.scale, self.weights = min(tried, key=lambda t: t[0])
        self.models = Models(data, offsets, labels, scale)

    def out_of_fold(self, column: pa.Array, labels: np.ndarray, part: np.ndarray, scale: float) -> tuple[float, float, np.ndarray, np.ndarray]:
        """The calibrated log-loss of texts under models of the others, with ``scale`` and the calibration."""
        x = np.zeros((len(labels), 1 + len(FEW)))
        for p in range(4):
            known, rest = column.filter(pa.array(part != p)), column.filter(pa.array(part == p))
            x[part == p] = Models(*text_bytes(known), labels[part != p], scale).features(*text_bytes(rest))
        spread = np.maximum(x.std(axis=0), 1e-9)
        x = np.c_[np.ones(len(x)), x / spread]
        weights = logistic(x, labels)
        loss = float(np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ weights)).sum())
        return loss, scale, spread, weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.models is None:
            return np.full(len(offsets) - 1, self.rate)
        z = np.c_[np.ones(len(offsets) - 1), self.models.features(data, offsets) / self.scale] @ self.weights
        return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", ident: str = "doc_id") -> Classifier:
    """A classifier from a bounded sample of whole texts, see ``labelled_sample``: ``TOXIC_ROWS`` and ``ORDINARY_ROWS``, or all if fewer.

    If only one label is there, every text scores as often as it is toxic: 0 or 1; without labels, 0.
    """
    bounds = {1: TOXIC_ROWS, 0: ORDINARY_ROWS}
    texts, known = labelled_sample(docs, labels, bounds, text=text, label=label, ident=ident, text_bytes=TEXT_BYTES, sample_bytes=SAMPLE_BYTES)
    return Classifier(texts, known)


def toxicity(docs: DataFrame, model: Classifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text.

    Null and empty texts, and those without a letter, get the calibration's constant. Repeated rows and null ids
    have a row each, an empty table gives none, and other columns have no part in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's sample

    def run(batches):
        for batch in lean(batches):
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                score = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    return toxicity(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
