"""Shared pieces of the corpus operators: Arrow text access, word hashing, shared folders.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D`` after lower-casing A-Z, so all of it
works on UTF-8 bytes and whole Arrow batches rather than on single strings.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are separated by these (fixed by the word definition).
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A pseudo-random 64-bit value for each byte, from a rule.
BYTE_CODE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n; kept for as many as a chunk of text needs."""
    if "p" not in _powers or len(_powers["p"]) < n:
        made = []
        for base in (BASE, BASE_INV):
            x = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U)
            x[0] = 1
            made.append(np.cumprod(x, dtype=U))
        if n > CHUNK_BYTES + 1:
            return made[0], made[1]
        _powers.update(p=made[0], q=made[1])
    return _powers["p"][:n], _powers["q"][:n]


def lean(batches: Iterable) -> Iterator:
    """The batches; at their end, memory that is no longer in use goes back to the system, as Spark reuses its workers."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def prefix_hash(data: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running polynomial hash of bytes, or of other letters by their ``codes``; ``span_hash`` reads any span's hash off it."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(codes[data] * p[:-1], dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes wherever they stand."""
    _, q = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * q[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8, int(at[-1])) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return data[at[0] :], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of a column, piece by piece."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk of rows, and the n+1 offsets of the rows' words."""
    if len(data) == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(LOWER[data]), start, end), np.searchsorted(start, offsets)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts and the n+1 offsets of them."""
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def free_names(names: Iterable[str], taken: Iterable[str]) -> dict[str, str]:
    """Each name with underscores after it until it clashes with none of ``taken`` (case doesn't count)."""
    used, out = {t.lower() for t in taken}, {}
    for name in names:
        out[name] = name
        while out[name].lower() in used:
            out[name] += "_"
        used.add(out[name].lower())
    return out


def carried(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row's own columns as the struct ``row``, where their names meet no others; never an empty struct."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*(own or [F.lit(0).alias("none")])).alias("row")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The folders that ``cut`` has written in this session and that are still there."""
    return list(_written)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders that ``cut`` wrote, once no result that reads them is needed any more."""
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int], *, text: str, label: str, ident: str, text_bytes: int, sample_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of a bounded sample: of each label the ``rows[label]`` ids of least hash, or all if fewer.

    The ids come from ``labels`` alone; as their number is bounded, they are broadcast to the documents. Of rows repeated
    with one id, the text of least hash counts; texts over ``text_bytes`` are left out, and, in the order of another
    hash, those beyond ``sample_bytes`` in all. Other labels, null ids and ids without a document are left out.
    """
    known = labels.where(F.col(label).isin(*rows)).select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL").distinct()
    chosen = None
    for y, n in rows.items():
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= text_bytes)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id", F.lit(3)), "id", "y"))  # the chosen rows
    found = one.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).orderBy("y", F.xxhash64("id"), "id").select("y", "text").toArrow()
    return found.column("text").combine_chunks(), found.column("y").to_numpy().astype(float)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, mix: np.ndarray | float = 1.0, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton steps with a small penalty; rows count ``mix`` times."""
    w, mix = np.zeros(x.shape[1]), np.broadcast_to(mix, len(y))
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (mix * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (mix * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
