"""Running totals within groups of any size, by sorted ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .io import cut

#: Rows of a range, about.
RANGE_ROWS = 100_000


def same(keys: list[str], other: str = "_") -> Column:
    """Whether keys agree with those named ``other`` + key; null is a key like any other."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return out


def renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def numbered_groups(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the long ``_g`` in place of ``keys``, and the groups: ``keys, _g``. Groups are numbered once, as they are written."""
    groups = cut(df.select(*keys).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    rest = [c for c in df.columns if c not in keys]
    return df.join(groups.select(*renamed(keys), "_g"), same(keys)).select("_g", *rest), groups


def running_total(df: DataFrame, group: list[str], order: str, amount: str, out: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` (longs) over rows of the same ``group`` (longs) up to this one by ``order``.

    ``order`` differs among a group's rows. Rows are dealt to sorted ranges whose number follows from their count, and
    totals of ranges are added to those within; so a group takes as many tasks as its rows need, and no window holds one.
    """
    df = cut(df, "amounts")
    parts = max(1, -(-df.count() // (rows or RANGE_ROWS)))
    fields = df.columns
    places = [fields.index(c) for c in (*group, amount)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, many = (batch.column(i).to_numpy() for i in places)
            key = np.stack(keys)
            first = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
            start, place = np.flatnonzero(first), np.cumsum(first) - 1
            upto = np.cumsum(many)
            upto = upto - (upto - many)[start][place]
            if last is not None and (key[:, 0] == last).all():
                upto[place == 0] += total
            last, total = key[:, -1].copy(), int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto), pa.array(np.full(len(upto), pid, np.int32))], [*fields, out, "_pid"])

    schema = df.withColumns({out: F.lit(0).cast("long"), "_pid": F.lit(0)}).schema
    ranges = df.repartitionByRange(parts, *group, order) if parts > 1 else df.coalesce(1)
    found = ranges.sortWithinPartitions(*group, order).mapInArrow(run, schema)
    if parts == 1:
        return found.drop("_pid")
    found = cut(found, "ranges")
    torn = found.groupBy(*group).agg(F.min("_pid").alias("_lo"), F.max("_pid").alias("_hi")).where("_lo < _hi").select(*group)
    totals = found.join(F.broadcast(torn), group).groupBy(*group, "_pid").agg(F.max(out).alias("_all"))  # each range is in two torn groups at most
    before = (F.sum("_all").over(Window.partitionBy(*group).orderBy("_pid")) - F.col("_all")).alias("_before")
    totals = totals.select(*renamed(group), F.col("_pid").alias("_q"), before)
    whole = found.join(F.broadcast(totals), same(group) & (F.col("_pid") == F.col("_q")), "left")  # twice as many rows as ranges at most
    return whole.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).select(*fields, out)
