"""Plugging in users' parsers and models as batch functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 256
#: Atoms whose candidates (by their least atom) meet one copy of their sample.
ATOM_BLOCK = 16


def expand_distinct(df: DataFrame, key: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """``parse``'s rows for each distinct key; ``schema`` names the key first, then the parser's columns."""
    names = T._parse_datatype_string(schema).fieldNames()

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(k, *row) for k in frame[key] for row in parse(k)], columns=names)

    return df.select(key).distinct().mapInPandas(run, schema)


def score(df: DataFrame, make_predict: Callable[[], Callable], out: str = "prediction", batch_size: int = BATCH) -> DataFrame:
    """``df`` with a model's prediction of each row. The model is made once in each task."""

    def run(frames):
        predict = make_predict()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                yield part.assign(**{out: predict(part)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


class Sample:
    """A full sample: its fields, its feature rows, and which row an atom has."""

    def __init__(self, fields: dict, features: np.ndarray, ids: list | None):
        self.fields, self.features = fields, features
        self.row = {a: i for i, a in enumerate(range(len(features)) if ids is None else ids)}

    def masked(self, name: str, atoms: list[int]) -> dict:
        """The fields, with features outside the atoms as zeros and the ``mask`` (1 for atoms inside)."""
        mask = np.zeros(len(self.features))
        mask[[self.row[a] for a in atoms if a in self.row]] = 1.0
        return self.fields | {name: self.features * mask.reshape(-1, *[1] * (self.features.ndim - 1)), "mask": mask}


def feature_rows(column: pa.ListArray) -> list[np.ndarray]:
    """Each sample's features as doubles: slices of one array where they are vectors of one length without nulls."""
    rows = column.flatten()
    if column.null_count or not pa.types.is_list(rows.type) or not pa.types.is_floating(rows.type.value_type) or rows.null_count or rows.flatten().null_count:
        return [np.array(x, dtype=float) for x in column.to_pylist()]
    wide, ends = rows.value_lengths().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    if not len(wide) or (wide != wide[0]).any() or (np.diff(ends, prepend=0) == 0).any():
        return [np.array(x, dtype=float) for x in column.to_pylist()]
    return np.split(rows.flatten().to_numpy().astype(float).reshape(-1, wide[0]), ends[:-1])


def values(column: pa.Array) -> np.ndarray:
    """A field of samples: numbers as an array of numbers (a null as NaN), else objects."""
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    for i, x in enumerate(column.to_pylist()):
        out[i] = x
    return out


def stacked(features: np.ndarray, inside: np.ndarray, fields: dict[str, np.ndarray]) -> dict:
    """Each sample masked to each set, one sample after the other: ``features`` of samples of as many atoms, ``inside`` has a row for each set."""
    many, (sets, atoms), rest = len(features), inside.shape, features.shape[2:]
    masked = features[:, None] * inside.reshape(1, sets, atoms, *[1] * len(rest))
    mask = np.broadcast_to(inside, (many, sets, atoms)).reshape(-1, atoms)
    return {c: np.repeat(x, sets, axis=0) for c, x in fields.items()} | {"features": masked.reshape(-1, atoms, *rest), "mask": mask}


def of_samples(make_predict: Callable[[], Callable[[dict], np.ndarray]], fields: list[str]) -> Callable:
    """A model of stacked samples as one of lists of samples, as ``score_masked`` takes it; those of as many atoms are stacked."""

    def make():
        predict = make_predict()

        def run(rows: list[dict]) -> np.ndarray:
            out, atoms = np.zeros(len(rows)), np.array([len(x["mask"]) for x in rows])
            for n in np.unique(atoms):
                at = np.flatnonzero(atoms == n)
                given = {c: values(pa.array([rows[i][c] for i in at])) for c in fields}
                out[at] = predict(given | {c: np.stack([rows[i][c] for i in at]) for c in ("features", "mask")})
            return out

        return run

    return make


def full_samples(full: pa.StructArray, features: str, ids: str | None) -> list[Sample]:
    names = full.type.names
    fields = {name: full.field(name).to_pylist() for name in names if name != features}
    each = [dict(zip(fields, values, strict=True)) for values in zip(*fields.values(), strict=True)] if fields else [{}] * len(full)
    return [Sample(own, rows, own[ids] if ids else None) for own, rows in zip(each, feature_rows(full.field(features)), strict=True)]


def score_masked(candidates: DataFrame, samples: DataFrame, make_predict: Callable[[], Callable[[list[dict]], list[float]]], *, key: str = "sample_id", atoms: str = "atoms", features: str = "features", ids: str | None = None, out: str = "prediction", batch_size: int = BATCH) -> DataFrame:
    """``candidates`` with a model's prediction for their samples masked to their atoms.

    ``samples`` has a row for each ``key``: ``features``, a row for each atom (by number from 0, or by the list ``ids``), and
    what else the model wants. Candidates carry atom lists only; a sample's row stands before its candidates in the sorted
    stream, once for each ``ATOM_BLOCK`` atoms, and features are masked inside the batch. Batches of ``batch_size`` run
    across samples; the model is made once in each task. Candidates without a sample are left out, as are those with a
    null key.
    """
    number = F.array_max(ids) if ids else F.size(features) - 1
    copies = F.sequence(F.lit(0), F.greatest(F.floor(number / ATOM_BLOCK), F.lit(0)).cast("int"))
    fields = samples.select(F.col(key).alias("_k"), F.explode(copies).alias("_b"), F.lit(0).alias("_t"), F.struct(*samples.columns).alias("_s"))
    block = F.greatest(F.floor(F.coalesce(F.array_min(atoms), F.lit(0)) / ATOM_BLOCK), F.lit(0)).cast("int")
    rows = candidates.select(F.col(key).alias("_k"), block.alias("_b"), F.lit(1).alias("_t"), F.struct(*candidates.columns).alias("_c"))
    both = fields.unionByName(rows, allowMissingColumns=True).where("_k IS NOT NULL")
    stream = both.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_t").select("_k", "_b", "_t", "_s", "_c")
    names = candidates.columns

    def run(batches):
        predict, sample, at = make_predict(), None, None
        for batch in batches:
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            kinds = batch.column(2).to_numpy()
            full = iter(full_samples(batch.column(3).take(pa.array(np.flatnonzero(kinds == 0))), features, ids))
            given = batch.column(4).field(names.index(atoms)).to_pylist()
            rows, masked, found = [], [], []
            for i, kind in enumerate(kinds):
                if kind == 0:
                    sample, at = next(full), place[i]
                elif at == place[i]:
                    rows.append(i)
                    masked.append(sample.masked(features, given[i] or []))
                    if len(masked) == batch_size:
                        found += [float(x) for x in predict(masked)]
                        masked = []
            if masked:
                found += [float(x) for x in predict(masked)]
            kept = batch.column(4).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(found, pa.float64())], [*names, out])

    return stream.mapInArrow(run, T.StructType([*candidates.schema.fields, T.StructField(out, T.DoubleType())]))
