"""Text quality by compression: which of two dictionaries, of good or of bad text, makes a text smaller.

A zstandard dictionary is trained on labelled text of each class. A text is cut into pieces of ``PIECE`` bytes, as a
dictionary helps less the more of a text has gone by, and all pieces are compressed with either dictionary. The
features are the two sizes' difference over their sum (of the whole text, and of the piece that looks worst) and the
compressed share of the text: what is repeated endlessly fits no dictionary but hardly takes room. They become a
probability by a logistic calibration on out-of-fold training texts. The dictionaries and weights are a model of about
a quarter of a megabyte, whatever the corpus; scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, labelled_sample, lean, logistic, sigmoid, text_bytes

#: Bounds of the training sample: rows of each label, bytes of a text (longer ones don't train), and bytes of all.
ROWS, TEXT_BYTES, SAMPLE_BYTES = 2000, 1 << 16, 24 << 20
PIECE, DICTIONARY, LEVEL = 1024, 96 << 10, 3
#: Bytes added to sizes before they are compared, so that short texts aren't judged by the format's overhead.
PRIOR = 48
FOLDS, THRESHOLD = 4, 0.7


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def trained(texts: list[bytes]) -> bytes:
    """A dictionary of texts; of the texts themselves where they are too few to train one."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Sizes:
    """Compressed sizes of texts with a good and a bad dictionary, as features."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = compressor(good), compressor(bad)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Difference over sum of the whole text, the least one of a piece, and the compressed share."""
        good = bad = 0
        least = 1.0
        for part in pieces(text):
            x, y = (len(c.compress(part)) for c in self.both)
            good, bad, least = good + x, bad + y, min(least, (y - x) / (x + y + PRIOR))
        return (bad - good) / (good + bad + PRIOR), least, (good + bad) / (2 * (len(text) + PRIOR))


@dataclass
class Model:
    """Two dictionaries and the calibration; without texts of both labels, the constant ``rate``."""

    rate: float
    good: bytes = b""
    bad: bytes = b""
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scorer(self):
        """A function from a text's bytes to its probability of being good."""
        if self.weights is None:
            return lambda text: self.rate
        sizes = Sizes(self.good, self.bad)
        return lambda text: float(sigmoid(self.weights[0] + np.asarray(sizes.features(text)) / self.spread @ self.weights[1:]))


def learn(texts: list[bytes], labels: np.ndarray, share: float | None = None) -> Model:
    """A model of labelled texts. ``share`` is how many of all labels are good, if the texts have another mix."""
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model(rate)
    part = np.empty(len(labels), np.int64)
    part[np.argsort(labels, kind="stable")] = np.arange(len(labels)) % FOLDS
    x = np.zeros((len(labels), 3))

    def dictionaries(use: np.ndarray) -> tuple[bytes, bytes]:
        return tuple(trained([t for t, u, y in zip(texts, use, labels, strict=True) if u and y == c]) for c in (1, 0))

    for p in range(FOLDS):
        sizes = Sizes(*dictionaries(part != p))
        for i in np.flatnonzero(part == p):
            x[i] = sizes.features(texts[i])
    spread = np.maximum(x.std(axis=0), 1e-9)
    share = rate if share is None else share
    mix = np.where(labels == 1, share / rate, (1 - share) / (1 - rate))
    weights = logistic(np.c_[np.ones(len(x)), x / spread], labels, mix)
    return Model(rate, *dictionaries(np.ones(len(labels), bool)), spread, weights)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", ident: str = "doc_id") -> Model:
    """A model from a bounded sample of whole texts, see ``labelled_sample``: ``ROWS`` of each label, or all if fewer.

    The calibration weighs the sample's labels as often as all of ``labels`` has them. With one label only, every text
    scores 0 or 1 as that label says; without labels, 0.
    """
    counts = dict(labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    texts, known = labelled_sample(docs, labels, {0: ROWS, 1: ROWS}, text=text, label=label, ident=ident, text_bytes=TEXT_BYTES, sample_bytes=SAMPLE_BYTES)
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    return learn([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], known, counts.get(1, 0) / max(sum(counts.values()), 1))


def quality(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; ``predicted`` is 1 from ``THRESHOLD`` on.

    Null and empty texts score as an empty piece does. Equal texts have equal scores; repeated rows and null ids have a
    row each, an empty table gives none, and other columns have no part in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes and four weights

    def run(batches):
        score = shared.value.scorer()
        for batch in lean(batches):
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                found = np.array([score(data[s:e].tobytes()) for s, e in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return quality(docs, fit(docs, labels.where(~held))).select("doc_id", held.alias("held_out"), "score", "predicted")
