"""Vectors combined by group, place by place, as whole Arrow lists: they are never exploded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of one block of vectors that are combined at once.
BLOCK_VALUES = 1 << 20


def group_codes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal keys, in order of appearance, and each row's group."""
    codes = np.zeros(len(columns[0]), np.int64) if columns else np.zeros(0, np.int64)
    for column in columns:
        found = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        codes = np.unique(codes * (int(found.max(initial=0)) + 1) + found, return_inverse=True)[1]
    _, first, group = np.unique(codes, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[group]


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of ``width`` doubles, and where a value is there."""
    n = np.zeros(len(column), np.int64)
    if len(column):
        n = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    values = column.flatten().cast(pa.float64())
    there = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    numbers = (values.fill_null(0.0) if values.null_count else values).to_numpy()
    if len(n) and (n == width).all():
        return numbers.reshape(len(n), width), there.reshape(len(n), width)
    out, mask = np.zeros((len(n), width)), np.zeros((len(n), width), bool)
    row, place = np.repeat(np.arange(len(n)), n), np.arange(len(numbers)) - np.repeat(np.cumsum(n) - n, n)
    out[row, place], mask[row, place] = numbers, there
    return out, mask


def width_of(column: pa.Array) -> int:
    return int(column.value_lengths().fill_null(0).to_numpy().max(initial=0)) if len(column) else 0


def lists(values: np.ndarray, widths: np.ndarray, kind) -> pa.Array:
    """Rows cut to their widths as lists."""
    keep = np.arange(values.shape[1])[None, :] < widths[:, None]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(widths)].astype(np.int32)), pa.array(values[keep], kind))


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK_VALUES // max(width_of(batch.column(column)), 1))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def combine(df: DataFrame, keys: list[str], vector: str, how: str = "sum", weight: Column | None = None, tasks: int | None = None) -> DataFrame:
    """``keys, vector``: each group's vectors combined by place: "sum", "max", "mean", or "max_mean", one after the other.

    Vectors count ``weight`` times in sums. Vectors may differ in length; a result is as long as its group's longest, and a
    place counts the values that are there (null where none is). Groups without any place have no row; a null key is a
    group. Rows are combined within each batch, before partial results are shuffled, one row a group and batch; a group's
    partial results pass through a task in a stream. ``tasks`` is the number of these tasks, else Spark's choice.
    """
    rows = df.select(*keys, (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"), F.col(vector).alias("_v")).where(F.size("_v") > 0)
    k, fields = len(keys), [df.schema[c] for c in keys]
    number, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    middle = T.StructType([*fields, T.StructField("_sum", doubles), T.StructField("_max", doubles), T.StructField("_n", number)])

    def folded(group: np.ndarray, count: int, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(group, kind="stable")
        start = np.searchsorted(group[order], np.arange(count))
        return [op.reduceat(x[order], start, axis=0) for op, x in zip((np.add, np.maximum, np.add), parts, strict=True)]

    def record(names: list, parts: list[np.ndarray], widths: np.ndarray) -> pa.RecordBatch:
        arrays = [lists(x, widths, kind) for x, kind in zip(parts, (pa.float64(), pa.float64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*names, *arrays], [*keys, "_sum", "_max", "_n"])

    def partly(batches):
        for whole in batches:
            for batch in blocks(whole, k + 1):
                first, group = group_codes(batch.columns[:k] or [pa.array(np.zeros(batch.num_rows, np.int64))])
                width = width_of(batch.column(k + 1))
                x, there = dense(batch.column(k + 1), width)
                times = batch.column(k).to_numpy()[:, None]
                parts = folded(group, len(first), (np.where(there, x * times, 0.0), np.where(there, x, -np.inf), there.astype(np.int64)))
                widths = np.zeros(len(first), np.int64)
                np.maximum.at(widths, group, batch.column(k + 1).value_lengths().to_numpy())
                yield record([c.take(pa.array(first)) for c in batch.columns[:k]], parts, widths)

    def wholly(batches):
        """Sorted partial results of each group as one; the last group of a block waits for the next."""
        held = None
        for whole in batches:
            for batch in blocks(whole, k):
                if held is not None:
                    batch = pa.Table.from_batches([held.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
                first, group = group_codes(batch.columns[:k] or [pa.array(np.zeros(batch.num_rows, np.int64))])
                width = width_of(batch.column(k))
                given = [dense(batch.column(k + i), width)[0] for i in range(3)]
                given[1] = np.where(given[2] > 0, given[1], -np.inf)
                parts = folded(group, len(first), (given[0], given[1], given[2].astype(np.int64)))
                widths = np.zeros(len(first), np.int64)
                np.maximum.at(widths, group, batch.column(k).value_lengths().to_numpy())
                made = record([c.take(pa.array(first)) for c in batch.columns[:k]], parts, widths)
                held = made.slice(len(first) - 1)
                if len(first) > 1:
                    yield made.slice(0, len(first) - 1)
        if held is not None:
            yield held

    parts = rows.mapInArrow(partly, middle)
    dealt = parts.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    found = dealt.mapInArrow(wholly, middle)
    some = lambda c: F.transform(F.arrays_zip(c, "_n"), lambda e: F.when(e["_n"] > 0, e[c]))
    mean = F.transform(F.arrays_zip("_sum", "_n"), lambda e: F.when(e["_n"] > 0, e["_sum"] / e["_n"]))
    kinds = {"sum": [some("_sum")], "max": [some("_max")], "mean": [mean], "max_mean": [some("_max"), mean]}[how]
    return found.select(*keys, F.concat(*kinds).alias(vector))
