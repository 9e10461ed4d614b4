"""Exact, repeatable random splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def shuffled_ordinal(df: DataFrame, key: str, hashed: Column, limit: int, out: str = "ordinal") -> DataFrame:
    """Places from 0 in the order of ``hashed`` (0..limit-1), then key: counts of hash ranges, then places within them."""
    rows = df.withColumn("_h", hashed).withColumn("_r", F.floor(F.col("_h") * RANGES / limit))
    counts = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) - 1
    return rows.withColumn("_p", place).join(F.broadcast(counts), "_r").withColumn(out, (F.col("_first") + F.col("_p")).cast("long")).drop("_r", "_p", "_h", "_first")  # RANGES rows at most


def seeded(key: str, seed: int) -> tuple[Column, int]:
    """A hash of the key and seed, and its limit."""
    limit = 1 << 40
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(limit)), limit


def exact_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0, hashed: tuple[Column, int] | None = None) -> DataFrame:
    """``df`` with ``part``: "train" for exactly ``int(share * n)`` rows, "val" for the others."""
    n = df.count()
    rows = shuffled_ordinal(df, key, *(hashed or seeded(key, seed)))
    return rows.withColumn("part", F.when(F.col("ordinal") < int(share * n), "train").otherwise("val")).drop("ordinal")


def batches(df: DataFrame, key: str, size: int = 512, seed: int = 0, hashed: tuple[Column, int] | None = None) -> DataFrame:
    """``df`` with ``batch_id``: shuffled batches of ``size`` rows, the last one shorter."""
    rows = shuffled_ordinal(df, key, *(hashed or seeded(key, seed)))
    return rows.withColumn("batch_id", F.floor(F.col("ordinal") / size)).drop("ordinal")
