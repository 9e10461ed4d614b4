"""MinHash near-duplicates of documents with HyperMinHash registers.

A document's set is its distinct word shingles. Hashes fall into register buckets; a register keeps the
bucket's least hash compressed to its leading-zero count and a few mantissa bits, and buckets without a
hash borrow from others, so a register of two sets agrees about as often as their Jaccard index. Bands of
registers give candidates. The Jaccard index is estimated from all registers, corrected for chance
agreement of compressed values; pairs near or above the threshold are confirmed on their full sets.

Large groups: equal sets form one class first. In the star rounds each document meets a few of its buckets'
centres, and components form. What is left to decide are pairs of different components within a bucket;
these are compared in blocks, on full sets where the estimate allows a link, and only links leave a block.
Pairs inside a component cannot change the result and are never made. What is summed up for each bucket is
written before it is joined with the bucket's rows, so that the join shuffles both sides and a bucket with very
many rows is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, cut, lean, mix64, text_bytes, text_chunks, words
from .graph import components

BANDS, ROWS, MANTISSA = 32, 5, 10
REGISTERS = BANDS * ROWS
#: Deviations below the threshold down to which an estimate is verified. Sets of fewer shingles share hashes among
#: registers, so that their estimates say too little: those are always verified.
MARGIN, SMALL = 5.0, 64
#: Rows and bytes of text on each side of a block, unless one text alone is longer.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
STAR_ROUNDS, STAR_CENTRES = 2, 3

PROBES = (mix64(np.arange(REGISTERS * 64, dtype=U) + U(1 << 40)) % U(REGISTERS)).astype(np.int64).reshape(64, REGISTERS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``size`` make one shingle, none make none."""
    h, at = words(data, offsets)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        w = h[a:b]
        n = len(w)
        if n == 0:
            out.append(w)
            continue
        span = min(size, n)
        s = w[: n - span + 1] * U(0x9E3779B97F4A7C15)
        for i in range(1, span):
            s = (s ^ (s >> U(29))) * U(0xD6E8FEB86659FD93) + w[i : n - span + 1 + i]
        out.append(np.unique(mix64(s + U(span))))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set of at least one hash: leading zeros above, mantissa bits below."""
    bucket = (shingles % U(REGISTERS)).astype(np.int64)
    value = mix64(shingles ^ U(0xA5A5A5A5A5A5A5A5))
    order = np.argsort(value)[::-1]
    least = np.zeros(REGISTERS, U)
    filled = np.zeros(REGISTERS, bool)
    least[bucket[order]] = value[order]  # the last one written is the least
    filled[bucket] = True
    source = np.arange(REGISTERS)
    empty = np.flatnonzero(~filled)
    for probe in PROBES:
        if not len(empty):
            break
        hit = filled[probe[empty]]
        source[empty[hit]] = probe[empty[hit]]
        empty = empty[~hit]
    if len(empty):  # a fixed walk, the same for every set with the same filled buckets ahead
        where = np.flatnonzero(filled)
        source[empty] = where[np.searchsorted(where, empty) % len(where)]
    least = least[source]
    top = least >> U(1)
    zeros = 63 - np.frexp(top.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 53).astype(np.int64)
    mantissa = (least << (zeros + 1).astype(U)) >> U(64 - MANTISSA)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets of n and m hashes agree after compression."""
    i = np.arange(54)
    share = lambda k: np.maximum(np.asarray(k, float) / REGISTERS, 1.0)[..., None]
    cell = lambda k: (1 - 2.0 ** -(i + 1)) ** share(k) - (1 - 2.0**-i) ** share(k)
    return (cell(n) * cell(m)).sum(axis=-1) / 2**MANTISSA


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for chance agreement."""
    c = chance(n, m)
    return ((x == y).mean(axis=-1) - c) / (1 - c)


def near_enough(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and whether full sets must be compared: no estimate is trusted that can hide a link."""
    guess, share = estimate(x, y, n, m), percent / 100
    least, most = np.minimum(n, m), np.maximum(n, m)
    possible = 100 * least >= percent * most
    return guess, possible & ((guess >= share - MARGIN * (share * (1 - share) / REGISTERS) ** 0.5) | (least < SMALL))


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard index of two sets is ``percent`` hundredths or more."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, code, n, s1, s2, regs``: the text's hash, set size, two sums that identify the set, and registers."""

    def run(batches):
        for batch in lean(batches):
            for a, b, data, offsets in text_chunks(batch.column(2)):
                n, s1, s2, regs = [], [], [], []
                for s in shingle_sets(data, offsets, size):
                    n.append(len(s))
                    s1.append(s.sum(dtype=U).astype(np.int64))
                    s2.append(mix64(s ^ U(0x5555)).sum(dtype=U).astype(np.int64))
                    regs.append(registers(s).tobytes() if len(s) else None)
                sums = [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *sums], ["doc_id", "code", "n", "s1", "s2", "regs"])

    return docs.select("doc_id", "code", "text").mapInArrow(run, "doc_id long, code long, n long, s1 long, s2 long, regs binary")


def bands(sets: DataFrame) -> DataFrame:
    """``key, doc``: a 64-bit key for each band of a set's registers."""

    def run(batches):
        scale = mix64(np.arange(1, ROWS + 1, dtype=U))
        for batch in lean(batches):
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                regs = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint16).reshape(-1, BANDS, ROWS).astype(U)
                key = mix64((mix64(regs + U(1)) * scale).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "doc"])

    return sets.select("doc", "regs").mapInArrow(run, "key long, doc long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose estimate is near enough and whose full sets reach the threshold."""

    def run(batches):
        for batch in lean(batches):
            for begin in range(0, batch.num_rows, 128):
                part = batch.slice(begin, 128)
                x, y = (np.frombuffer(b"".join(v.as_py() for v in part.column(c)), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
                _, near = near_enough(x, y, part.column(4).to_numpy(), part.column(5).to_numpy(), percent)
                part = part.filter(pa.array(near))
                sets = [[s for _, _, data, offsets in text_chunks(part.column(c)) for s in shingle_sets(data, offsets, size)] for c in (6, 7)]
                hit = [linked(p, q, percent) for p, q in zip(*sets, strict=True)]
                part = part.filter(pa.array(hit, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    left = texts.select(F.col("doc").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb", "ta", "tb").mapInArrow(run, "a long, b long")


def block_links(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components within a bucket, enough to join all that any link joins.

    ``members`` is ``key, doc, label``. A bucket's largest component need not meet itself, so its rows stand
    once in each block of the others; the others stand in every block. A block confirms pairs on full sets,
    skips those that its links have already joined, and returns fewer links than it has rows.
    """
    members = members.join(texts.select("doc", F.octet_length("text").cast("long").alias("bytes")), "doc")
    members = cut(members, "block-rows")
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    about = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.sum("bytes").alias("bytes"), F.max(F.struct("c", "label", "bytes")).alias("top"))

    def many(rows, size):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")

    down, across = many(F.col("all"), F.col("bytes")), many(F.col("all") - F.col("top.c"), F.col("bytes") - F.col("top.bytes"))
    about = cut(about.select("key", down.alias("down"), across.alias("across"), F.col("top.label").alias("main")), "blocks")
    rows = members.join(about, "key").withColumn("h", F.xxhash64("doc"))
    own = rows.select("key", "doc", "label", F.pmod("h", F.col("down")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), F.lit(0).alias("side"))
    other = rows.where("label != main").select("key", "doc", "label", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod("h", F.col("across")).cast("int").alias("j"), F.lit(1).alias("side"))
    cells = own.unionByName(other).join(texts.select("doc", "n", "regs", "text"), "doc").select("key", "i", "j", "side", "doc", "label", "n", "regs", "text")

    def run(table: pa.Table) -> pa.Table:
        side, doc, label, n = (table.column(c).to_numpy() for c in ("side", "doc", "label", "n"))
        regs = np.frombuffer(b"".join(x.as_py() for x in table.column("regs")), np.uint16).reshape(-1, REGISTERS)
        text, sets, group = table.column("text"), {}, np.unique(label, return_inverse=True)[1]

        def full_set(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets(*text_bytes(text.slice(k, 1)), size)[0]
            return sets[k]

        links = []
        for k in np.flatnonzero(side == 1).tolist():
            near = np.flatnonzero((side == 0) & (group != group[k]))
            if not len(near):
                continue
            guess, may = near_enough(regs[near], regs[k], n[near], n[k : k + 1], percent)
            near, guess = near[may], guess[may]
            for i in near[np.argsort(-guess, kind="stable")].tolist():
                if group[i] == group[k] or not linked(full_set(i), full_set(k), percent):
                    continue
                links.append((min(doc[i], doc[k]), max(doc[i], doc[k])))
                group[group == group[i]] = group[k]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, code`` of every document; ``code`` is xxhash64 of its text.

    Documents link whose sets of ``size``-word shingles have a Jaccard index of ``percent`` hundredths or
    more. Null and empty texts have an empty set and are alone; a null id is kept with a null component. Each row is a
    document of its own: rows repeated with one id and text share a component, different texts with one id link as
    theirs do.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("code", F.xxhash64("text"))
    sketch = cut(sketches(rows, size), "sketches")
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "code", "regs")).alias("x")).select("n", "s1", "s2", "x.*")
    classes = cut(classes.withColumn("doc", F.monotonically_increasing_id()), "sets")  # numbered once, as they are written
    every = bands(classes)
    shared = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    members = cut(every.join(shared, "key"), "buckets")
    involved = members.select("doc").distinct()
    texts = cut(rows.join(classes.join(involved, "doc").select("doc", "doc_id", "code", "n", "regs"), ["doc_id", "code"]).dropDuplicates(["doc"]).select("doc", "n", "regs", "text"), "candidates")
    links = members.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(STAR_ROUNDS):
        labelled = label_of(members, links) if turn else members.withColumn("label", F.col("doc"))
        first = F.min(F.struct((F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")).alias("k"), "doc", "label"))
        centre = cut(labelled.groupBy("key").agg(first.alias("c")).select("key", F.col("c.doc").alias("centre"), F.col("c.label").alias("other")), "centres")
        meet = labelled.join(centre, "key").where("doc != centre AND label != other")
        votes = meet.groupBy("doc", "centre").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "centre"))).where(F.col("k") <= STAR_CENTRES if turn else F.col("k") == 1)
        pairs = best.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
        links = cut(links.unionByName(confirmed(pairs, texts, size, percent)), "doc-links")
    label = label_of(members, links)
    mixed = cut(label.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key"), "mixed")
    rest = cut(label.join(mixed, "key"), "open-buckets")
    links = cut(links.unionByName(block_links(rest, texts, size, percent)), "doc-links")
    found = components(links).join(classes.select(F.col("doc").alias("node"), "doc_id"), "node")
    least = cut(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "components")
    found = found.join(least, "component").select(F.col("node").alias("doc"), "component_id")
    about = classes.join(found, "doc", "left").select("n", "s1", "s2", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = some.select("doc_id", "code", "n", "s1", "s2").join(about, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "code")
    alone = sketch.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "code")
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "code")


def label_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component that ``links`` give their documents so far."""
    found = components(links)
    return members.join(found, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc")).drop("node", "component")


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2).drop("code")
