"""Combined vectors against their exploded form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity_jobs import graphs, vectors


def exploded(df, keys, vector, how):
    """The same by one row a value."""
    x = F.col("x").cast("double")
    kinds = {"sum": [F.sum(x)], "max": [F.max(x)], "mean": [F.avg(x)], "max_mean": [F.max(x), F.avg(x)]}[how]
    cells = df.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(*[k.alias(f"x{i}") for i, k in enumerate(kinds)])
    rows = {}
    for r in cells.orderBy("at").collect():
        rows.setdefault(tuple(r[k] for k in keys), []).append([r[f"x{i}"] for i in range(len(kinds))])
    return {k: [v[i] for i in range(len(kinds)) for v in cell] for k, cell in rows.items()}


@pytest.mark.parametrize("how", ["sum", "max", "mean", "max_mean"])
def test_pool_equals_the_exploded_result(spark, monkeypatch, how):
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 40)
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][int(rng.integers(3))] if i % 3 else "a", int(rng.integers(4)), [float(x) if rng.random() > 0.1 else None for x in rng.normal(size=int(rng.integers(1, 9)))]) for i in range(300)]
    rows += [("null", 1, None), ("empty", 1, []), ("nothing", 1, [None, None]), ("nan", 1, [math.nan, 1.0]), ("nan", 1, [2.0, None])]
    df = spark.createDataFrame(rows, "k string, j int, v array<double>").repartition(3)
    want = exploded(df, ["k", "j"], "v", how)
    found = {(r.k, r.j): r.v for r in graphs.pool(df, ["k", "j"], "v", how).collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert [x if x is None else pytest.approx(x, nan_ok=True) for x in v] == found[k], k
    assert graphs.pool(df.limit(0), ["k"], "v", how).collect() == []
    assert len(graphs.pool(df, [], "v", how).collect()) == 1


def test_wide_vectors_send_one_row_an_arc(spark):
    rng = np.random.default_rng(5)
    bonds = [(m, int(a), int(b)) for m in range(6) for a, b in rng.integers(0, 12, (20, 2))]
    arcs = graphs.arcs(spark.createDataFrame(bonds, "mol_id int, a int, b int"))
    x = {(m, i): rng.normal(size=99) for m in range(6) for i in range(12)}
    nodes = spark.createDataFrame([(m, i, v.tolist(), i % 2) for (m, i), v in x.items()], "mol_id int, atom_idx int, features array<double>, keep int")
    near = {k: set() for k in x}
    for r in arcs.where("src != dst").collect():
        near[r.mol_id, r.src].add((r.mol_id, r.dst))
    gin = {(r.mol_id, r.atom_idx): r.features for r in graphs.neighbor_sum(nodes, arcs, 0.5).collect()}
    masked = {(r.mol_id, r.atom_idx): r.features for r in graphs.neighbor_sum(nodes, arcs, 0.5, "keep").collect()}
    gcn = {(r.mol_id, r.atom_idx): r.features for r in graphs.gcn_propagate(nodes, arcs).collect()}
    d = {k: len(v) + 1 for k, v in near.items()}
    for k in x:
        assert np.allclose(gin[k], 1.5 * x[k] + sum((x[n] for n in near[k]), np.zeros(99)))
        assert np.allclose(gcn[k], x[k] / d[k] + sum((x[n] / math.sqrt(d[k] * d[n]) for n in near[k]), np.zeros(99)))
        assert np.allclose(masked[k], (k[1] % 2) * (1.5 * x[k] + sum((x[n] for n in near[k] if n[1] % 2), np.zeros(99))))
    plan = graphs.neighbor_sum(nodes, arcs)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_groups_by_keys_of_any_kind():
    import pyarrow as pa

    first, group = vectors.group_codes([pa.array(["x", None, "x", None, "y"]), pa.array([1, 1, 1, 2, 1])])
    assert first.tolist() == [0, 1, 3, 4] and group.tolist() == [0, 1, 0, 2, 3]
