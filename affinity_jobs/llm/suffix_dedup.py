"""Suffix-array deduplication: remove bytes inside strings of 100 bytes that also start earlier.

Suffix arrays are built in shards of bounded size. Every 100-byte window has a minimizer, its 24-byte gram
of least hash, so equal windows have equal minimizers, and a run of windows that share one minimizer
occurrence is a short segment of text. Segments whose minimizer occurs once are unique and end there. Equal
segments are aggregated to their first place; the others' windows all start earlier. Different segments of
one minimizer are compared in a shard: suffixes are sorted by induction, permuted common prefixes follow,
and among windows that share 100 bytes all but the first are repeats. Minimizers with very many different
segments are dealt anew by minimizers of longer grams, at last of whole windows, in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, carried, cut, lean, mix64, powers, prefix_hash, span_hash, text_bytes, text_chunks

LENGTH = 100
#: Minimizer grams: the first deals all windows; hot minimizers are dealt anew by longer ones, at last by whole windows.
GRAMS = (24, 64, 92, 100)
#: Longer documents are read in pieces that overlap by a window.
PIECE = 1 << 22
HOT = 64
SHARD_SEGMENTS = 8000
#: So few suffixes are put into their buckets one by one.
FEW = 24
#: Never a byte of UTF-8 text: it ends each segment of a shard.
STOP = 0xFF


def bucket_runs(source: np.ndarray, target: np.ndarray, letters: int, up: bool) -> list[tuple[int, int, bool]]:
    """Runs ``[a, b)`` of buckets, in scanning order, whose entries put nothing into the run; a bucket that feeds itself stands alone, as True.

    ``source`` and ``target`` are the buckets of each entry and of what it puts ahead.
    """
    if not up:  # the same with buckets counted from the other end
        runs = bucket_runs(letters - 1 - source, letters - 1 - target, letters, True)
        return [(letters - b, letters - a, loop) for a, b, loop in runs]
    own = source == target
    loops = np.zeros(letters, bool)
    loops[source[own]] = True
    nearest = np.full(letters, letters)
    np.minimum.at(nearest, source[~own], target[~own])
    runs, a, limit = [], 0, letters
    for c, (loop, near) in enumerate(zip(loops.tolist(), nearest.tolist(), strict=True)):
        if loop or c >= limit:
            if a < c:
                runs.append((a, c, False))
            a, limit = c, letters
        if loop:
            runs.append((c, c + 1, True))
            a = c + 1
        limit = min(limit, near)
        if loop:
            limit = letters
    if a < letters:
        runs.append((a, letters, False))
    return runs


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small numbers (bytes, or dense names) by induced sorting.

    Suffixes are L or S by whether they are greater or smaller than the next. The leftmost S of each run are
    sorted by their substrings (one induction) and named; the string of names is sorted in the same way, until all
    names differ; a second induction from their order gives all suffixes. An induction goes from bucket to bucket,
    a bucket holding the suffixes of one first letter; buckets that don't feed each other are gone through at once.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    letters = int(t.max()) + 1
    # narrow numbers: few letters sort by radix, and places take half the room
    t = t.astype(np.uint8 if letters <= 1 << 8 else np.uint16 if letters <= 1 << 16 else np.int32)
    kind = np.int32 if n < 1 << 31 else np.int64
    step = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    where = np.where(step != 0, np.arange(n - 1, dtype=kind), kind(n - 1))
    where = np.minimum.accumulate(where[::-1])[::-1]  # the next place where neighbours differ
    small = np.r_[np.r_[step, -1][where] > 0, False]
    left = np.flatnonzero(small & ~np.r_[True, small[:-1]])
    size = np.bincount(t, minlength=letters)
    head = np.cumsum(size) - size
    large = ~small
    large_at, small_at = np.flatnonzero(~small[:-1]), np.flatnonzero(small[:-1])
    upward = bucket_runs(t[large_at + 1].astype(np.int64), t[large_at].astype(np.int64), letters, True)
    downward = bucket_runs(t[small_at + 1].astype(np.int64), t[small_at].astype(np.int64), letters, False)

    def induce(order: np.ndarray) -> np.ndarray:
        out = np.full(n, -1, kind)
        lms = order[np.argsort(t[order], kind="stable")]
        count = np.bincount(t[lms], minlength=letters)
        rank = np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)
        out[(head + size - count)[t[lms]] + rank] = lms  # at the ends of their buckets
        fill = head.copy()
        out[fill[t[n - 1]]] = n - 1  # induced by the end of the string
        fill[t[n - 1]] += 1

        def put(source: np.ndarray, wanted: np.ndarray, way: int) -> None:
            """Append the left neighbours of the wanted type to their buckets, in order."""
            p = source[source > 0] - 1
            p = p[wanted[p]]
            if len(p) <= FEW:
                for i, c in zip(p.tolist(), t[p].tolist(), strict=True):
                    at = fill[c]
                    out[at] = i
                    fill[c] = at + way
                return
            c = t[p]
            by = c.argsort(kind="stable")
            p, c = p[by], c[by]
            edges = np.concatenate(([0], (c[1:] != c[:-1]).nonzero()[0] + 1, [len(c)]))
            start, many = edges[:-1], edges[1:] - edges[:-1]
            first = c[start]
            rank = np.arange(len(c)) - start.repeat(many)
            out[fill[first].repeat(many) + way * rank] = p
            fill[first] += way * many

        for a, b, loop in upward:
            done, end = head[a], head[b - 1] + size[b - 1]
            while loop and done < fill[a]:
                upto = fill[a]
                put(out[done:upto], large, 1)
                done = upto
            put(out[done:end], large, 1)
        out[np.arange(n) >= fill.repeat(size)] = -1  # behind the L parts
        fill = head + size - 1
        for a, b, loop in downward:
            done, end = head[b - 1] + size[b - 1] - 1, head[a]
            while loop and done > fill[a]:
                upto = fill[a]
                put(out[upto + 1 : done + 1][::-1], small, -1)
                done = upto
            put(out[end : done + 1][::-1], small, -1)
        return out

    if not len(left):
        return induce(left)
    order = induce(left)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = order[is_left[order]]
    stop = np.r_[left[1:] + 1, n]
    code = span_hash(prefix_hash(t, mix64(np.arange(letters, dtype=U) + U(1))), left, stop)
    place = np.empty(n, kind)
    place[left] = np.arange(len(left), dtype=kind)
    place = place[order]
    fresh = np.r_[True, code[place][1:] != code[place][:-1]]
    if not fresh.all():
        name = np.empty(len(left), np.int64)
        name[place] = np.cumsum(fresh) - 1
        order = left[suffix_array(name)]
    return induce(order)


def common_prefixes(t: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the one before it in the array (-1 for the first), in text order.

    Only irreducible values, whose suffixes are preceded by different bytes, are compared, eight bytes at a
    time; the others are one less than that of the place before.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[array[1:]] = array[:-1]
    i = np.arange(n)
    whole = (i > 0) & (phi > 0)
    whole[whole] = t[i[whole] - 1] == t[phi[whole] - 1]
    start = np.flatnonzero(~whole & (phi >= 0))
    word = np.zeros(n + 8, U)
    padded = np.r_[t, np.zeros(16, np.uint8)]
    for b in range(8):
        word |= padded[b : b + n + 8].astype(U) << U(8 * b)
    match = np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    while len(live):
        a, b = start[live] + match[live], phi[start[live]] + match[live]
        room = n - np.maximum(a, b)
        live, a, b, room = live[room > 0], a[room > 0], b[room > 0], room[room > 0]
        x = word[a] ^ word[b]
        same = np.minimum(np.where(x == 0, 8, np.bitwise_count((x & (~x + U(1))) - U(1)) // 8), room)
        match[live] += same
        live = live[(same == 8) & (room > 8)]
    value = np.full(n, -1, np.int64)
    value[start] = match
    last = np.maximum.accumulate(np.where(~whole, i, -1))
    return np.where(phi >= 0, np.where(whole, value[last] - (i - last), value), -1)


def window_repeats(segments: list[bytes], windows: list[int], length: int) -> list[tuple[int, int, int]]:
    """``(segment, first window, windows)`` of windows equal to one in an earlier segment or place."""
    text = np.frombuffer(b"".join(s + bytes([STOP]) for s in segments), np.uint8)
    size = np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(segments)), size)
    inside = np.arange(len(text)) - base[owner]
    valid = inside < np.asarray(windows)[owner]
    array = suffix_array(text)
    prefix = common_prefixes(text, array)[array]
    start = np.flatnonzero(prefix < length)
    least = np.minimum.reduceat(np.where(valid[array], array, len(text)), start)
    repeat = np.zeros(len(text), bool)
    repeat[array] = array > np.repeat(least, np.diff(np.r_[start, len(text)]))
    repeat &= valid
    edge = np.flatnonzero(np.diff(np.r_[0, repeat.astype(np.int8), 0])).reshape(-1, 2)
    return [(int(owner[a]), int(inside[a]), int(b - a)) for a, b in edge]


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer occurrence: row, start in the row, windows, gram hash, segment hash."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    prefix = prefix_hash(data)
    _, q = powers(n + 1)
    hashes = mix64((prefix[gram:] - prefix[:-gram]) * q[: n + 1 - gram] + U(gram))
    key = (hashes & ~U(0xFFFFFF)) | np.arange(len(hashes), dtype=U)  # ties go to the left
    span = length - gram + 1
    rows = -(-len(key) // span)
    block = np.full(rows * span, ~U(0), U)
    block[: len(key)] = key
    block = block.reshape(rows, span)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    low = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & U(0xFFFFFF)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    valid = np.arange(starts) + length <= offsets[1:][row]
    fresh = valid & np.r_[True, (low[1:] != low[:-1]) | ~valid[:-1]]
    last = valid & np.r_[(low[1:] != low[:-1]) | ~valid[1:], True]
    first, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return row[first], first - offsets[row[first]], end - first, hashes[low[first].astype(np.int64)], span_hash(prefix, first, end + length - 1)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Bytes and offsets of a chunk, a very long row in pieces; with the row and place of each piece."""
    if len(offsets) > 2 or len(data) <= PIECE:
        yield data, offsets, 0, 0
        return
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + length - 1]
        yield part, np.array([0, len(part)]), 0, at


def run_rows(docs: DataFrame, length: int, gram: int, only_keys: bool = False) -> DataFrame:
    def run(batches):
        for batch in lean(batches):
            ids = batch.column(0).to_numpy()
            for a, _, data, offsets in text_chunks(batch.column(1)):
                for part, at, first, place in pieces(data, offsets, length):
                    row, start, many, key, code = window_runs(part, at, length, gram)
                    columns = [pa.array(key.view(np.int64))]
                    if not only_keys:
                        columns = [pa.array(ids[a + first + row]), pa.array((start + place).astype(np.int64)), pa.array(many.astype(np.int32)), *columns, pa.array(code.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["mh"] if only_keys else ["doc_id", "start", "many", "mh", "code"])

    return docs.mapInArrow(run, "mh long" if only_keys else "doc_id long, start long, many int, mh long, code long")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, start, many``: windows (from ``start`` on, ``many``) that also start earlier. ``docs`` is ``doc_id, text``."""
    grams = [*[g for g in GRAMS if g < length], length]
    gram = grams[0]
    shared = run_rows(docs, length, gram, only_keys=True).groupBy("mh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("mh")
    shared = cut(shared, "shared")  # so that the join shuffles both sides and splits hot minimizers
    runs = cut(run_rows(docs, length, gram).join(shared, "mh", "left_semi"), "runs")
    later, rivals = sorted_out(runs, F.struct("doc_id", "start", "many"))
    rivals = cut(rivals, "rivals")
    wanted = rivals.groupBy("doc_id").agg(F.collect_list(F.struct("mh", "d", "start", "many")).alias("spans"))
    texts = wanted.join(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id")

    def read(batches):
        for batch in lean(batches):
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, spans in enumerate(batch.column("spans")):
                text, found = data[offsets[i] : offsets[i + 1]], spans.as_py()
                parts = [text[s["start"] : s["start"] + s["many"] + length - 1].tobytes() for s in found]
                columns = [pa.array([s[c] for s in found], k) for c, k in (("mh", pa.int64()), ("d", pa.int64()), ("start", pa.int64()), ("many", pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[i])), *columns, pa.array(parts, pa.binary())], ["doc_id", "mh", "d", "start", "many", "bytes"])

    rows = cut(texts.select("doc_id", "text", "spans").mapInArrow(read, "doc_id long, mh long, d long, start long, many int, bytes binary"), "rival-bytes")
    found = [later]
    for gram in [*grams[1:], length]:
        cold = rows.where(F.col("d") <= HOT)
        found.append(compared(cold, max(1, cold.count() // SHARD_SEGMENTS), length))
        hot = rows.where(F.col("d") > HOT)
        if hot.isEmpty():
            break
        later, rows = sorted_out(finer_runs(hot, length, gram), F.struct("doc_id", "start", "many", "bytes"))
        found.append(later)
        rows = cut(rows, "rival-bytes")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def sorted_out(runs: DataFrame, place) -> tuple[DataFrame, DataFrame]:
    """Runs equal to an earlier run, and the first ones of each minimizer that has different ones (``d`` of them).

    Runs are equal if their minimizers (64-bit hashes), lengths and 64-bit hashes of all their bytes are.
    """
    segments = cut(runs.groupBy("mh", "code", "many").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), "segments")
    copied = segments.where("c > 1").select(F.col("mh").alias("m"), F.col("code").alias("k"), F.col("many").alias("w"), F.col("first.doc_id").alias("d0"), F.col("first.start").alias("s0"))
    same = (F.col("mh") == F.col("m")) & (F.col("code") == F.col("k")) & (F.col("many") == F.col("w"))
    later = runs.join(copied, same & ((F.col("doc_id") != F.col("d0")) | (F.col("start") != F.col("s0")))).select("doc_id", "start", "many")
    different = cut(segments.groupBy("mh").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "different")
    return later, segments.join(different, "mh").select("mh", "d", "first.*")


def finer_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of rows' bytes by minimizers of longer grams; at ``length`` each window is its own run."""

    def run(batches):
        for batch in lean(batches):
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                blobs = part.column(2).to_pylist()
                data = np.frombuffer(b"".join(blobs), np.uint8)
                offsets = np.r_[0, np.cumsum([len(b) for b in blobs])].astype(np.int64)
                row, start, many, key, code = window_runs(data, offsets, length, gram)
                pieces = [blobs[r][s : s + m + length - 1] for r, s, m in zip(row.tolist(), start.tolist(), many.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(part.column(1).to_numpy()[row] + start), pa.array(many.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(code.view(np.int64)), pa.array(pieces, pa.binary())], ["doc_id", "start", "many", "mh", "code", "bytes"])

    return rows.select("doc_id", "start", "bytes").mapInArrow(run, "doc_id long, start long, many int, mh long, code long, bytes binary")


def compared(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """Repeats among different segments of one minimizer, by the suffix arrays of shards of segments."""

    def compare(table: pa.Table) -> pa.Table:
        ids, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        order = np.lexsort([start, ids])
        parts, many = table.column("bytes").to_pylist(), table.column("many").to_numpy()
        found = window_repeats([parts[i] for i in order], [int(many[i]) for i in order], length)
        k = order[[f[0] for f in found]] if found else np.zeros(0, np.int64)
        return pa.table({"doc_id": ids[k], "start": start[k] + np.array([f[1] for f in found], np.int64), "many": pa.array([f[2] for f in found], pa.int32())})

    return rows.withColumn("shard", F.pmod(F.xxhash64("mh"), F.lit(shards))).groupBy("shard").applyInArrow(compare, "doc_id long, start long, many int")


def marked(rows: DataFrame, length: int) -> DataFrame:
    """``rows(doc_id, text, ...)`` with ``spans``, the repeated windows of each.

    Of different texts of ``length`` bytes or more with one id, the one of least hash counts; the others have no spans.
    """
    code = F.when(F.octet_length("text") >= length, F.xxhash64("text"))
    texts = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(code).alias("_code"), F.max(code).alias("_last"))
    unlike = cut(texts.where("_code < _last").select("doc_id", "_code"), "unlike")  # ids with different texts, mostly none
    counts = code.isNotNull() & F.col("doc_id").isNotNull()
    if not unlike.isEmpty():
        rows = rows.join(unlike, "doc_id", "left")
        counts = counts & F.coalesce(code == F.col("_code"), F.lit(True))
    spans = repeats(rows.where(counts).select("doc_id", "text"), length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "many")).alias("spans"))
    return rows.join(spans, "doc_id", "left").withColumn("spans", F.when(counts, F.col("spans"))).drop("_code")


def covered(size: int, spans, length: int) -> np.ndarray:
    """Which bytes the windows cover."""
    edge = np.zeros(size + 1, np.int64)
    if spans:
        start = np.array([s["start"] for s in spans])
        np.add.at(edge, start, 1)
        np.add.at(edge, start + np.array([s["many"] for s in spans]) + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Null texts are empty, texts under ``length`` bytes are kept whole. Documents with a null id are kept whole;
    rows repeated with one id and text count as one document; of different texts of ``length`` bytes or more with one id,
    the one of least hash counts, and the others are kept whole. An empty table gives no rows; other columns have no part in it. Of equal strings the one in the document of least id, or first in the document, stays.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in lean(batches):
            data, offsets = text_bytes(batch.column(1))
            out: list[list] = [[], [], [], []]
            for i, spans in enumerate(batch.column(2)):
                part = data[offsets[i] : offsets[i + 1]]
                gone = covered(len(part), spans.as_py(), length)
                edges = int((gone & ~np.r_[False, gone[:-1]]).sum())
                values = len(part), int(gone.sum()), edges, hashlib.sha256(part[~gone].tobytes()).hexdigest()
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    return marked(rows, length).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, all columns kept, whatever their names.

    Where a cut splits a character, its remaining bytes go too. Documents of which nothing is left go; null and empty
    texts stay, as empty ones. Null ids, repeated rows, ties and empty tables are as in ``digests``.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, marks in lean(batches):
            data, offsets = text_bytes(column)
            texts = []
            for i, spans in enumerate(marks):
                part = data[offsets[i] : offsets[i + 1]]
                left = part[~covered(len(part), spans.as_py(), length)].tobytes().decode("utf-8", "ignore")
                texts.append(left if left or not len(part) else None)
            yield pa.array(texts, pa.string())

    rows = docs.select(carried(docs, without=(text,)), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kept = F.arrow_udf(run, "string").asNondeterministic()("text", "spans")
    rows = marked(rows, length).select("row", kept.alias("text")).where("text IS NOT NULL")
    return rows.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
