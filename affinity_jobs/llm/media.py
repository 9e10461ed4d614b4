"""Media columns: byte payloads stored as 8-bit audio, and features of what was stored.

Features: polyphase resampling to half the rate, overlapped log-mel filter banks on it, and energy
segments with hysteresis. Log-mel frames are laid out as blocks of a fixed shape with the time span
of each, which ``tensor_batch`` turns into an Arrow fixed-shape tensor column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, lean, text_chunks

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
FRAME, HOP, MELS, BLOCK = 128, 64, 20, 16
HIGH, LOW, SEGMENT_MIN = 1.02, 0.98, 2
UNIT = 64
#: Outputs resampled at once, and bytes of text stored or measured at once.
STRIP, BATCH_BYTES = 1 << 16, 1 << 20


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + b"\0" * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def store(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def load(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAVE file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter dealt out to ``up`` phases of ``taps`` taps."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: output k is one phase's dot product with the inputs around it."""
    bank = phases(up, down, taps)
    n = -(-len(x) * up // down)
    half = taps // 2
    padded = np.concatenate([np.zeros(half, np.float32), x, np.zeros(taps + half, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for p in range(min(up, n)):  # outputs k, k + up, ... share a phase
        for a in range(p, n, up * STRIP):
            k = np.arange(a, min(n, a + up * STRIP), up)
            out[k] = windows[k * down // up] @ bank[(p * down) % up][::-1]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters at even distances on the mel scale, as (bins, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """Log-mel energies of frames that overlap by half; the last frame is filled with zeros."""
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)]) if (frames - 1) * HOP + FRAME > len(x) else x
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, 4096):
        power = np.abs(np.fft.rfft(view[a : a + 4096] * window, axis=1)).astype(np.float32) ** 2
        out[a : a + 4096] = np.log(power @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW, least: int = SEGMENT_MIN) -> np.ndarray:
    """Frame spans that begin at or above ``high`` times the mean energy and last until it is below ``low`` times.

    Frames between the two levels keep the state before them; spans under ``least`` frames are left out.
    """
    if not len(energy):
        return np.zeros((0, 2), np.int64)
    mean = float(energy.mean())
    sign = np.where(energy >= high * mean, 1, np.where(energy < low * mean, -1, 0))
    place = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    on = (place >= 0) & (sign[np.maximum(place, 0)] > 0)
    edge = np.flatnonzero(np.diff(np.r_[False, on, False]))
    spans = edge.reshape(-1, 2)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def features(samples: bytes, rate: int = RATE) -> dict:
    """Log-mel frames, energy segments in seconds, and the resampled rate."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    out_rate = rate * UP // DOWN
    mel = log_mel(y, out_rate)
    size = -(-len(y) // HOP) * HOP
    energy = np.concatenate([y, np.zeros(size - len(y), np.float32)]).reshape(-1, HOP)
    spans = segments((energy**2).mean(axis=1))
    return {"mel": mel, "spans": spans * HOP / out_rate, "rate": out_rate}


def feature_text(found: dict) -> str:
    """The features as one line: shape, segments, voiced seconds, mean and deviation of each band, checksum."""
    mel, spans = found["mel"], found["spans"]
    coarse = np.round(mel * 4).astype("<i2")
    mean, dev = mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)
    return f"mel{mel.shape[0]}x{mel.shape[1]};seg{len(spans)};on{float((spans[:, 1] - spans[:, 0]).sum()):.3f};mean{','.join(f'{v:.2f}' for v in mean)};dev{','.join(f'{v:.2f}' for v in dev)};crc{zlib.crc32(coarse.tobytes()):08x}"


def blocks(found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Frames in blocks of a fixed shape, the last filled with its least value, and each block's time span."""
    mel = found["mel"]
    n = -(-len(mel) // BLOCK)
    whole = np.full((n * BLOCK, MELS), mel.min() if len(mel) else 0, np.float32)
    whole[: len(mel)] = mel
    start = np.arange(n) * BLOCK * HOP / found["rate"]
    end = np.minimum((np.arange(n) + 1) * BLOCK, len(mel)) * HOP / found["rate"]
    return whole.reshape(n, BLOCK, MELS), np.stack([start, end], axis=1)


def tensor_batch(tensors: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """Blocks as an Arrow fixed-shape tensor column beside their time spans."""
    return pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)), pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["log_mel", "start_s", "end_s"])


def tensor_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes long, media binary``: each whole text's bytes, padded, as a WAVE file; a null text is empty.

    Repeated rows and null ids have a row each; an empty table gives none; other columns have no part in it.
    """

    def run(batches):
        for batch in lean(batches):
            for a, b, data, at in text_chunks(batch.column(1), BATCH_BYTES):
                raw = data.tobytes()
                media = [store(pad(raw[i:j])) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def measured(media: DataFrame, *, tensors: bool = True) -> DataFrame:
    """``media``'s columns ``doc_id, n_bytes`` with what follows from its stored bytes.

    These are ``payload_bytes, payload_sha256, tail_crc32`` of the samples read back, ``media_bytes, media_sha256`` of the
    file, ``feature``, and an Arrow stream of fixed-shape log-mel blocks with their time spans as ``tensors``, of
    which only the size, ``tensor_bytes``, is returned if ``tensors`` is false.
    """
    last = ("tensors", T.BinaryType(), pa.binary()) if tensors else ("tensor_bytes", T.LongType(), pa.int64())
    fields = [
        ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()),
        ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()), last,
    ]

    def measure(media: bytes) -> tuple:
        samples, rate = load(media)
        found = features(samples, rate)
        stream = tensor_bytes(tensor_batch(*blocks(found)))
        digests = len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()
        return *digests, feature_text(found), stream if tensors else len(stream)

    def run(batches):
        for batch in lean(batches):
            column = batch.column(2).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
            for a, b in chunks(at, BATCH_BYTES):
                rows = [measure(m) for m in column.slice(a, b - a).to_pylist()]
                columns = [pa.array(values, kind) for values, (_, _, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "n_bytes", *[f[0] for f in fields]])

    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["n_bytes"], *[T.StructField(name, kind) for name, kind, _ in fields]]))


def media_columns(docs: DataFrame, **columns) -> DataFrame:
    """``doc_id, media binary, tensors binary, feature string`` of each document, nulls and other cases as in ``stored``."""
    files = stored(docs, **columns)
    names = files.columns

    def run(batches):
        for batch in lean(batches):
            for i in range(batch.num_rows):
                media = batch.column(2)[i].as_py()
                found = features(*load(media))
                stream = tensor_bytes(tensor_batch(*blocks(found)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([stream], pa.binary()), pa.array([feature_text(found)])], [*names, "tensors", "feature"])

    kind = T.StructType([*files.schema.fields, T.StructField("tensors", T.BinaryType()), T.StructField("feature", T.StringType())])
    return files.mapInArrow(run, kind).select("doc_id", "media", "tensors", "feature")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measured(cut(stored(docs), "media"), tensors=False)
