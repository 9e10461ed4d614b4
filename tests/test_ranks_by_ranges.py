"""Metrics of groups that lie in several sorted ranges: each row is sorted and written once, and ties may cross ranges."""

import numpy as np
import pytest

from affinity_jobs import io, metrics, totals


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def index(y, f):
    up = y[:, None] > y[None, :]
    return ((up & (f[:, None] > f[None, :])).sum() + 0.5 * (up & (f[:, None] == f[None, :])).sum()) / up.sum()


def test_distinct_rows_are_written_once(spark, monkeypatch):
    n, written = 3000, []
    rng = np.random.default_rng(5)
    y, f = rng.permutation(n) / 8, rng.integers(0, 5, n).astype(float)
    df = spark.createDataFrame([(None, float(a), float(b)) for a, b in zip(y, f, strict=True)], "k string, y double, f double")

    def counted(rows, name="step"):
        out = io.cut(rows, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(metrics, "TASK_ROWS", 300)
    monkeypatch.setattr(metrics, "SPLITS", 4)
    monkeypatch.setattr(totals, "RANGE_ROWS", 400)
    monkeypatch.setattr(metrics, "cut", counted)
    monkeypatch.setattr(totals, "cut", counted)
    found = metrics.evaluate(df, ["k"]).first()
    assert found.ci == pytest.approx(index(y, f)) and found.spearman == pytest.approx(np.corrcoef(ranks(y), ranks(f))[0, 1])
    assert sum(written) < 1.2 * n


def test_lesser_ranks_before_each_row():
    rng = np.random.default_rng(2)
    for size, top in ((1, 1), (2, 1), (257, 9), (300, 1000), (64, 2)):
        rank, n = rng.integers(0, top, size), rng.integers(1, 1 << 40, size)
        assert metrics.lesser_before(rank, n).tolist() == [int(n[:i][rank[:i] < rank[i]].sum()) for i in range(size)]
