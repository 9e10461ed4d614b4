"""Byte-pair encoding and decoding with a given byte-level vocabulary, by batched numpy merge rounds.

The vocabulary file's path is a parameter; each Python worker loads it once. A batch of texts is
split into pieces by the byte-level pattern, and its distinct pieces are merged together: their
symbols lie in one flat array, the rank of each neighbouring pair comes from a binary search over the
sorted pair keys, and a round applies every piece's lowest-ranked pair at all its places.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, lean, text_bytes

#: The byte-level splitting pattern (fixed by the vocabulary format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40
#: Characters of text encoded at once, and bytes of distinct pieces and their ids that a worker remembers.
BATCH_CHARS, CACHE_BYTES = 1 << 19, 24 << 20
#: What a remembered piece takes beside its characters and ids.
CACHE_ENTRY = 150
#: Rows of ids decoded at once.
ROWS = 256


def byte_chars() -> dict[str, int]:
    """The vocabulary writes each byte as a printable character: itself, or the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in printable else next(spare)): b for b in range(256)}


class Vocabulary:
    """A byte-level BPE vocabulary: sorted pair keys with rank and product, bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, chars = spec["model"], byte_chars()
        ids = model["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = special
        self.width = max([*ids.values(), *special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.first = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.first[b] = ids[c]
        spelled = [b""] * self.width
        for token, i in ids.items():
            spelled[i] = bytes(chars[c] for c in token)
        for token, i in special.items():
            spelled[i] = token.encode()
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.pieces = regex.compile(PATTERN)
        self.breaks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.gap = regex.compile(r"(?<=\S) (?=\S)") if not any(" " in x for x in special) else None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the sorted keys, -1 where a pair never merges."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many byte strings in one flat array, and each string's number of ids."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), length)
        done_ids, done_owner = [], []
        at = np.full(len(ids), -1, np.int64)
        if len(ids) > 1:
            at[:-1] = np.where(owner[:-1] == owner[1:], self.look_up(ids[:-1], ids[1:]), -1)
        while len(ids):
            rank = np.where(at >= 0, self.rank[at], NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NONE
            if over.any():  # pieces without a pair left are done
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, at, rank, least = ids[~over], owner[~over], at[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            hit = rank == least
            # the same pair in a row, as in "aaa": every second one counts, from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place)) - 1
            same = hit & (run % 2 == 1) & (np.r_[ids[1:], -1] == ids)
            hit &= ~same
            at_hit = np.flatnonzero(hit)
            ids[at_hit] = self.made[at[at_hit]]
            keep = np.ones(len(ids), bool)
            keep[at_hit + 1] = False
            new = np.cumsum(keep) - 1
            ids, owner, at = ids[keep], owner[keep], at[keep]
            fresh = new[at_hit]
            touched = np.unique(np.r_[fresh, fresh[fresh > 0] - 1])
            inner = touched[touched + 1 < len(ids)]
            at[touched] = -1
            same_piece = owner[inner] == owner[inner + 1]
            at[inner] = np.where(same_piece, self.look_up(ids[inner], ids[inner + 1]), -1)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def split(self, text: str) -> list[str]:
        if self.breaks is None or not self.breaks.search(text):
            return self.pieces.findall(text)
        out: list[str] = []
        for part in self.breaks.split(text):
            out.extend([part] if part in self.special else self.pieces.findall(part))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Special tokens written in a text become their ids."""
        return [self.encode_long(t) if len(t) > 2 * BATCH_CHARS else ids for t, ids in zip(texts, self.encode_short(texts), strict=True)]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a text encoded stretch by stretch, cut before single spaces between two words: pieces begin there anyway."""
        parts, at = [], 0
        while at < len(text):
            gap = self.gap.search(text, at + BATCH_CHARS) if self.gap else None
            end = gap.start() if gap else len(text)
            parts += self.encode_short([text[at:end]], longest=len(text))
            at = end
        return np.concatenate(parts)

    def encode_short(self, texts: list[str], longest: int = 2 * BATCH_CHARS) -> list[np.ndarray]:
        """Ids of each text of at most ``longest`` characters; none of others."""
        split = [self.split(t) if len(t) <= longest else [] for t in texts]
        if self.known_bytes > CACHE_BYTES:
            self.known, self.known_bytes = {}, 0
        known = self.known
        fresh = [p for p in {p for pieces in split for p in pieces} if p not in known]
        plain = [p for p in fresh if p not in self.special]
        ids, counts = self.merge([p.encode() for p in plain])
        ids = ids.astype("<u4")
        data, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        begin = 0
        for p, end in zip(plain, ends, strict=True):
            known[p] = data[begin:end]
            begin = end
        for p in fresh:
            if p in self.special:
                known[p] = np.array([self.special[p]], "<u4").tobytes()
        self.known_bytes += sum(CACHE_ENTRY + 2 * len(p) + len(known[p]) for p in fresh)
        return [np.frombuffer(b"".join([known[p] for p in pieces]), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        parts = []
        for at in range(0, len(ids), BATCH_CHARS):
            part = np.asarray(ids[at : at + BATCH_CHARS], dtype=np.int64)
            start, length = self.starts[part], self.starts[part + 1] - self.starts[part]
            before = np.cumsum(length) - length
            place = np.arange(int(length.sum())) + np.repeat(start - before, length)
            parts.append(self.spelled[place].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def id_batches(bpe: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The first column of ``(id, text)`` batches and the ids of the texts, a bounded run of rows at a time."""
    for batch in lean(batches):
        _, at = text_bytes(batch.column(1))
        for a, b in chunks(at, BATCH_CHARS):
            yield batch.column(0).slice(a, b - a), bpe.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text.

    A null or empty text has no ids, a null id or a repeated row a row like any other; an empty table gives no rows
    and other columns have no part in it.
    """

    def run(batches):
        for key, ids in id_batches(vocabulary(path), batches):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def id_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none where it is null."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, known in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        yield flat[at[i] : at[i + 1]] if known else flat[:0]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of the rows of ``encode``; null ids give an empty text."""

    def run(batches):
        bpe = vocabulary(path)
        for batch in lean(batches):
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = pa.array([bpe.decode(ids) for ids in id_rows(part.column(1))], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: digests of ``encode``'s ids and of their decoding.

    Nulls, empty texts, repeated rows, empty tables and other columns are as in ``encode``. Ids are decoded by the
    worker that made them.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        bpe = vocabulary(path)
        for key, rows in id_batches(bpe, batches):
            ids_sha = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in rows]
            text_sha = [hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in rows]
            columns = [pa.array([len(ids) for ids in rows], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([key, *columns], ["doc_id", *names])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = (T.LongType(), T.StringType(), T.StringType())
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
