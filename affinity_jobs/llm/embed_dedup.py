"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors form a class first, so that copies cost one row. Each class representative is hashed by the
signs of its products with random planes, several bits a table; classes that share a bucket in some table
and differ in few bits of a longer sketch are candidates, and candidates are verified in double precision.
Bits grow with the log of the number of vectors, so buckets stay small, and tables are added to keep the
wanted recall at the threshold.

Large groups of close vectors aren't taken pair by pair. The least id of a bucket may lead a ball: the classes within
half the threshold's angle of it, by exact cosine. Any two of a ball are within the whole angle of each other, so they
are linked for sure: they are counted by the ball's size and meet through its leader. Only pairs of different balls
are candidates. Classes that no leader is near are balls of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .graph import components

#: 64-bit words of a sketch: candidates differ in few of its bits.
SKETCH_WORDS = 8


def plan(n: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """Bits a table, tables, and the most sketch bits in which a link may differ (5.5 deviations)."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2)))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    size = 64 * SKETCH_WORDS
    return bits, tables, math.ceil(size * (1 - agree) + 5.5 * math.sqrt(size * agree * (1 - agree)))


def planes(seed: int, count: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def sign_rows(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``key, id, s0..s3``: for each table a bucket key, and the sketch."""

    def run(batches):
        for batch in lean(batches):
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for begin in range(0, part.num_rows, 1024):
                    piece = part.slice(begin, 1024)
                    x = matrix(piece.column(1))
                    on = x @ planes(seed, bits * tables, int(dim)) > 0
                    code = on.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    key = (code << 33) | (np.arange(tables, dtype=np.int64) << 20)[None, :] | np.int64(dim & 0xFFFFF)
                    far = np.packbits(x @ planes(seed + 1, 64 * SKETCH_WORDS, int(dim)) > 0, axis=1).view(np.int64)
                    ids = np.repeat(piece.column(0).to_numpy(), tables)
                    sketch = np.repeat(far, tables, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)]], ["key", "id", *[f"s{i}" for i in range(SKETCH_WORDS)]])

    return classes.select("id", "v", F.size("v").cast("long").alias("dim")).mapInArrow(run, "key long, id long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)))


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of representatives whose cosine reaches ``threshold`` in double precision."""

    def run(batches):
        for batch in lean(batches):
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                x, y = part.column(2), part.column(3)
                same = np.array([len(p) == len(q) for p, q in zip(x, y, strict=True)], dtype=bool)
                part = part.filter(pa.array(same))
                if not part.num_rows:
                    continue
                sizes = np.array([len(p) for p in part.column(2)])
                for dim in np.unique(sizes):
                    rows = part.filter(pa.array(sizes == dim))
                    p, q = matrix(rows.column(2)), matrix(rows.column(3))
                    p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
                    cosine = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
                    hit = rows.filter(pa.array(cosine >= threshold))
                    yield pa.RecordBatch.from_arrays([hit.column(0), hit.column(1), pa.array(cosine[cosine >= threshold])], ["a", "b", "cosine"])

    left = pairs.join(classes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    both = left.join(classes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def balls(signs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``id, ball``: classes within half the threshold's angle of a leader, each with one such leader of lesser id."""
    half = max(math.acos(threshold) / 2 - 1e-6, 0.0)  # the margin is far above rounding
    words = [f"s{i}" for i in range(SKETCH_WORDS)]
    first = signs.groupBy("key").agg(F.min(F.struct("id", *words)).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"lead.{w}"))) for w in words), F.lit(0))
    likely = signs.join(first, "key").where((F.col("id") > F.col("lead.id")) & (differ <= int(64 * SKETCH_WORDS * half / math.pi)))
    one = likely.groupBy("id").agg(F.min("lead.id").alias("a")).select("a", F.col("id").alias("b"))
    return verified(one, classes, math.cos(half)).select(F.col("b").alias("id"), F.col("a").alias("ball"))


def near_duplicates(vectors: DataFrame, *, ident: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors that are null, empty, zero or hold null or non-finite components have no links, and neither have
    vectors of different lengths. Copies of a vector are linked with each other and with all that any links
    with; vectors are copies if two 64-bit hashes agree. A null id is kept alone with a null component. Rows repeated
    with one id count as copies; an empty table gives no rows; other columns have no part in it.
    """
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("v").isNotNull() & F.forall("v", value) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    # vectors are known by two hashes: those are what is shuffled by
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(seed), "v")})
    same = rows.where("good").groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = cut(same, "vectors")
    bits, tables, far = plan(classes.count(), threshold, recall)
    signs = cut(sign_rows(classes, bits, tables, seed), "signs")
    inside = cut(balls(signs, classes, threshold), "balls")
    tagged = signs.join(inside, "id", "left").withColumn("ball", F.coalesce("ball", "id"))
    left, right = tagged.alias("l"), tagged.alias("r")
    differ = sum((F.bit_count(F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.ball") != F.col("r.ball"))
    pairs = left.join(right, apart & (differ <= far)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    # a leader may itself be in another's ball: its own then is linked with it from outside
    moved = inside.join(inside.select(F.col("id").alias("ball")), "ball").select(F.col("ball").alias("a"), F.col("id").alias("b"))
    pairs = pairs.unionByName(moved).distinct()
    links = cut(verified(pairs, classes, threshold).select("a", "b"), "vector-links")
    found = components(links.unionByName(inside.select(F.col("ball").alias("a"), F.col("id").alias("b"))))
    size = classes.select("id", "m")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(size.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("m").alias("others"))
    in_ball = classes.join(inside, "id", "left").withColumn("ball", F.coalesce("ball", "id"))
    mass = in_ball.groupBy("ball").agg(F.sum("m").alias("mass"))
    about = in_ball.join(mass, "ball").join(degree, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("node"), "left")
    about = about.select("h", "g", (F.col("mass") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("good").join(about, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
