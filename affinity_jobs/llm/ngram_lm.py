"""Language-model scoring: an interpolated modified Kneser-Ney bigram model of the whole corpus.

Counting is a Spark job. Tasks reduce each chunk of text to sorted counts and send them, packed and
dealt by hash, to shards; a shard's task adds them up and writes sorted hash arrays to the shared
folder. From each shard's bigrams a second shuffle gathers, per word, its counts as a history and the
number of words it follows. Scoring tasks memory-map the arrays and look words up by binary search, so
their memory doesn't grow with the model. The shared folder must be mounted on all machines.

Words are known by 64-bit hashes. A bigram's key is 64 bits, 30 of its first word's hash and 34 of its
second's; the shard number holds further bits of the first, so fingerprints widen as shards are added.
"""

from __future__ import annotations

import os
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, checkpoint_dir, chunks, cut, fold, lean, mix64, text_chunks, words

#: Bytes of text counted or scored at once; they are hashed in smaller pieces.
CHUNK = 5 << 20
SHARD_BYTES = 1 << 23
#: Bits of the most shards, enough for 128 TB of text.
SHARD_BITS = 24
END, BEGIN = mix64(np.array([11, 12], dtype=U))
UNI, BI, HIST, CONT = range(4)
HIST_BITS, NEXT_BITS = 30, 34


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane: zeros stand together and compress."""
    parts = [np.diff(keys, prepend=U(0)), *columns]
    return struct.pack("<q", len(keys)) + b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    planes = np.frombuffer(blob, np.uint8, offset=8).reshape(-1, 8, n)
    out = [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]
    return [np.cumsum(out[0], dtype=U), *out[1:]]


def add_up(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and the sums of their columns."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], [np.add.reduceat(c[order], first) for c in columns]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows with an end after each, the words before them, and the rows' first places."""
    pieces = [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
    found = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, U)
    at = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in pieces]))] if pieces else np.zeros(1, np.int64)
    token = np.insert(found, at[1:], END)
    starts = at[:-1] + np.arange(len(at) - 1)
    before = np.r_[BEGIN, token[:-1]].astype(U)
    before[starts] = BEGIN
    return token, before, starts


class Keys:
    """How hashes are dealt to ``2**bits`` shards."""

    def __init__(self, bits: int):
        self.bits = bits

    def word(self, h: np.ndarray) -> np.ndarray:
        return (h & U((1 << self.bits) - 1)).astype(np.int64)

    def history(self, h: np.ndarray) -> np.ndarray:
        return h >> U(64 - HIST_BITS - self.bits)

    def following(self, h: np.ndarray) -> np.ndarray:
        return h >> U(64 - NEXT_BITS)

    def bigram(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.history(before), self.following(token)
        shard = (a >> U(HIST_BITS)) ^ (b & U((1 << self.bits) - 1))
        return shard.astype(np.int64), ((a & U((1 << HIST_BITS) - 1)) << U(NEXT_BITS)) | b

    def parts(self, shard: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The history and following words of a shard's bigram keys."""
        b = key & U((1 << NEXT_BITS) - 1)
        return (((b & U((1 << self.bits) - 1)) ^ U(shard)) << U(HIST_BITS)) | (key >> U(NEXT_BITS)), b


def dealt(kind: int, shard: np.ndarray, keys: np.ndarray, columns: list[np.ndarray]):
    """Rows ``(kind, shard, blob)`` of sorted keys; ``keys`` are sorted within equal shards after a stable sort."""
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    shard, keys, columns = shard[order], keys[order], [c[order] for c in columns]
    edges = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else np.zeros(1, int)
    return [(kind, int(shard[a]), pack(keys[a:b], *[c[a:b] for c in columns])) for a, b in zip(edges, edges[1:], strict=False)]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "shard", "blob"])


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; other stores than mounted ones can't be memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for memory-mapped models, not {uri}")
    return uri


def name_of(kind: int, shard: int) -> str:
    return f"{kind}-{shard:05d}.arrays"


def write_arrays(folder: str, kind: int, shard: int, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """Keys, then each column in the narrowest width that holds it. A repeated task writes the same file."""
    widths = [next(w for w in (1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << (8 * w)) for c in columns]
    temporary = f"{folder}/.{uuid.uuid4().hex}"
    with open(temporary, "wb") as file:
        file.write(struct.pack(f"<q{8}b", len(keys), *widths, *[0] * (8 - len(widths))))
        file.write(keys.astype("<u8").tobytes())
        for c, w in zip(columns, widths, strict=True):
            file.write(c.astype(f"<u{w}").tobytes() + b"\0" * (-len(c) * w % 8))
    os.replace(temporary, f"{folder}/{name_of(kind, shard)}")


@lru_cache(maxsize=1 << 14)
def mapped(folder: str, kind: int, shard: int) -> list[np.ndarray]:
    """Memory-mapped keys and columns of a shard; empty where it has none."""
    path = f"{folder}/{name_of(kind, shard)}"
    if not os.path.exists(path):
        return [np.zeros(0, U), *[np.zeros(0, np.uint8)] * 4]
    data = np.memmap(path, np.uint8, "r")
    n, *widths = struct.unpack_from("<q8b", data[:16].tobytes())
    at, out = 16 + 8 * n, [data[16 : 16 + 8 * n].view("<u8")]
    for w in filter(None, widths):
        out.append(data[at : at + n * w].view(f"<u{w}"))
        at += n * w + -n * w % 8
    return out


def look_up(folder: str, kind: int, shard: np.ndarray, keys: np.ndarray, columns: int) -> list[np.ndarray]:
    """Columns of keys (0 where absent), shard by shard; queries are sorted, so that lookups run in order."""
    out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
    order = np.argsort(keys)
    order = order[np.argsort(shard[order].astype(np.uint32), kind="stable")]
    shard, keys = shard[order], keys[order]
    edges = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)] if len(shard) else np.zeros(1, int)
    for a, b in zip(edges, edges[1:], strict=False):
        have, *values = mapped(folder, kind, int(shard[a]))
        if not len(have):
            continue
        at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
        hit = have[at] == keys[a:b]
        for o, v in zip(out, values, strict=False):
            o[order[a:b][hit]] = v[at[hit]]
    return out


def discounts(counts: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams occur once to four times."""
    n1, n2, n3, n4 = (float(max(c, 0)) for c in counts)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


class Model:
    """Where the arrays lie, and the corpus totals."""

    def __init__(self, folder: str, bits: int, total: int, distinct: int, bigram_counts: list[int], cont_counts: list[int], types: int, next_words: int):
        self.folder, self.keys, self.total, self.distinct = folder, Keys(bits), total, distinct
        self.d2, self.d1 = [0.0, *discounts(bigram_counts)], [0.0, *discounts(cont_counts)]
        n1, n2 = cont_counts[:2]
        self.types = types  # of bigrams
        self.left = (self.d1[1] * n1 + self.d1[2] * n2 + self.d1[3] * (next_words - n1 - n2)) / types if types else 1.0

    def score(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Per row: tokens, known tokens, unigram score and the model's log10 probability."""
        token, before, starts = tokens(data, offsets)
        k = self.keys
        distinct, inverse = np.unique(np.r_[token, BEGIN], return_inverse=True)
        (count,) = look_up(self.folder, UNI, k.word(distinct), distinct, 1)
        nexts = k.following(distinct)
        (cont,) = look_up(self.folder, CONT, k.word(nexts), nexts, 1)
        hist = k.history(distinct)
        c, n1, n2, n3 = look_up(self.folder, HIST, k.word(hist), hist, 4)
        d1, d2 = np.array(self.d1), np.array(self.d2)
        lower = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / max(self.types, 1) + self.left / (self.distinct + 1)
        back = np.where(c > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(c, 1), 1.0)
        at = inverse[:-1]
        prior = np.r_[inverse[-1], at[:-1]]
        prior[starts] = inverse[-1]
        shard, key = k.bigram(before, token)
        (pair,) = look_up(self.folder, BI, shard, key, 1)
        p = np.maximum(pair - d2[np.minimum(pair, 3)], 0) / np.maximum(c[prior], 1) + back[prior] * lower[at]
        base = np.log10((count[at] + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (np.log10(p), base, (count[at] > 0).astype(np.int64))]
        return {"n_tokens": np.diff(np.r_[starts, len(token)]), "n_known": sums[2], "base_score": sums[1], "score": sums[0]}


def fit(docs: DataFrame, *, text: str = "text") -> Model:
    """Count all of ``docs``' texts (null: empty) and store the model's arrays in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(SHARD_BITS, max(4, int(size // SHARD_BYTES).bit_length()))
    folder = f"{local_path(checkpoint_dir(spark))}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def count(batches):
        keys = Keys(bits)
        for batch in lean(batches):
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                token, before, _ = tokens(data, offsets)
                word, times = np.unique(token, return_counts=True)
                rows = dealt(UNI, keys.word(word), word, [times])
                shard, key = keys.bigram(before, token)
                order = np.argsort(key)
                order = order[np.argsort(shard[order].astype(np.uint32), kind="stable")]
                shard, key = shard[order], key[order]
                first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
                times = np.diff(np.r_[first, len(key)])
                yield as_batch(rows + dealt(BI, shard[first], key[first], [times]))

    def gather(table: pa.Table) -> tuple[int, int, np.ndarray, list[np.ndarray]]:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        parts = [unpack(b.as_buffer()) for chunk in table.column("blob").chunks for b in chunk]
        sums = add_up(np.concatenate([p[0] for p in parts]), [np.concatenate(c) for c in zip(*[p[1:] for p in parts], strict=True)])
        write_arrays(folder, kind, shard, *sums)
        return kind, shard, *sums

    def totals(kind: int, shard: int, counts: np.ndarray) -> tuple:
        """A row of totals: entries, sum, and how many are 1 to 4."""
        return (-1 - kind, shard, struct.pack("<6q", len(counts), int(counts.sum()), *[int((counts == i).sum()) for i in range(1, 5)]))

    def first_level(table: pa.Table) -> pa.Table:
        kind, shard, key, (times,) = gather(table)
        rows = [totals(kind, shard, times)]
        if kind == BI:
            keys = Keys(bits)
            a, b = keys.parts(shard, key)
            one = np.ones(len(key), np.uint64)
            a, sums = add_up(a, [times, *[(x).astype(np.uint64) for x in (times == 1, times == 2, times >= 3)]])
            b, cont = add_up(b, [one])
            rows += dealt(HIST, keys.word(a), a, sums) + dealt(CONT, keys.word(b), b, cont)
        return pa.Table.from_batches([as_batch(rows)])

    def second_level(table: pa.Table) -> pa.Table:
        kind, shard, _, sums = gather(table)
        return pa.Table.from_batches([as_batch([totals(kind, shard, sums[0])])])

    schema = "kind int, shard int, blob binary"
    level1 = docs.select(text).mapInArrow(count, schema).groupBy("kind", "shard").applyInArrow(first_level, schema)
    level1 = cut(level1, "lm-words")
    level2 = level1.where("kind >= 0").groupBy("kind", "shard").applyInArrow(second_level, schema)
    found = {kind: np.zeros(6, np.int64) for kind in range(4)}
    for row in level1.where("kind < 0").unionByName(level2).toLocalIterator():  # a row of 48 bytes for each shard
        found[-1 - row["kind"]] += np.array(struct.unpack("<6q", row["blob"]))
    uni, bi, cont = found[UNI], found[BI], found[CONT]
    return Model(folder, bits, int(uni[1]), int(uni[0]), bi[2:].tolist(), cont[2:].tolist(), int(bi[0]), int(cont[0]))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text (null: empty, one token, its end).

    Repeated rows and null ids have a row each; an empty table gives none; other columns have no part in it.
    """

    def run(batches):
        for batch in lean(batches):
            for a, b, data, offsets in text_chunks(batch.column(1), CHUNK):
                found = model.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"].astype(np.int64)), pa.array(np.full(b - a, model.total, np.int64)), pa.array(found["base_score"]), pa.array(found["score"])],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(fold(F.col("doc_id")) != 1))
    out = score(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
