"""Explanations made where a sample stands, against the joined path and SQL."""

import csv
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinity_jobs import chain_queries, explain, graphs, io, queries, subgraphs, udfs
from test_growth import plan
from test_queries import rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def samples(spark):
    rng = random.Random(9)
    sizes = {m: rng.randint(1, 7) for m in range(12)} | {12: 18, 13: 16}
    ids = {m: rng.sample(range(60), n) for m, n in sizes.items()}
    bonds = [(m, *rng.sample(x, 2)) for m, x in ids.items() if len(x) > 1 for _ in range(len(x) + 1 if len(x) < 10 else 12)]
    atoms = spark.createDataFrame([(m, i) for m, x in ids.items() for i in x], "mol_id long, atom_idx int")
    adj = graphs.adjacency(atoms, graphs.arcs(spark.createDataFrame(bonds, "mol_id long, a int, b int")))
    data = [(10 * m + j, m, [[float(rng.randint(1, 9)), 1.0] for _ in x], None if m == 3 else 200.0 if m == 12 else rng.choice([7.0, 20.0]), "t") for m, x in ids.items() for j in range(2 if len(x) < 10 else 1)]
    data += [(500, 77, [], 1.0, "no atoms"), (None, 4, [[1.0, 1.0]] * len(ids[4]), 9.0, "no key")]
    data[0] = (*data[0][:2], [[None if i == 0 else 2.0, 1.0] for i in range(len(data[0][2]))], *data[0][3:])
    empty = spark.createDataFrame([(77, {})], "mol_id long, adj map<int, array<int>>")
    return spark.createDataFrame(data, "sample_id long, mol_id long, features array<array<double>>, total double, text string").join(adj.unionByName(empty), "mol_id")


def model():
    def share(batch):
        assert set(batch) == {"features", "mask", "total", "text"} and set(batch["text"]) == {"t"}
        return batch["features"][:, :, 0].sum(axis=1) / batch["total"]

    return lambda: share


def tidy(df):
    return sorted((r.sample_id, r["rank"], r.atoms, r.components, r.paths, r.num_components, r["size"], round(r.full_prediction, 9), round(r.prediction, 9), round(r.difference, 9)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"max_subgraph": 3, "max_total": 5, "k": 2}, {"max_combination": 1}])
def test_whole_samples_equal_the_joined_path(spark, samples, monkeypatch, sizes):
    monkeypatch.setattr(explain, "STACKED", 200)
    some = samples.where("size(adj) < 17") if not sizes else samples  # a large one has too many pairs for a small test
    found = explain.explain_whole(some, model(), ["total", "text"], epsilon=0.3, **sizes)
    own = some.where("sample_id IS NOT NULL AND size(adj) > 0").withColumn("ids", F.array_sort(F.map_keys("adj")))
    plain = lambda: lambda batch: [x["features"][:, 0].sum() / (x["total"] or float("nan")) for x in batch]
    score = lambda c: udfs.score_masked(c, own.select("sample_id", "features", "ids", "total"), plain, ids="ids")
    want = tidy(explain.explain(own.select("sample_id", "mol_id"), samples.select("mol_id", "adj").dropDuplicates(["mol_id"]), score, epsilon=0.3, **sizes))
    assert tidy(explain.listed(found)) == want and len({r[0] for r in want}) > 9
    assert {r.sample_id for r in found.collect()} == {r.sample_id for r in own.collect()}  # those without an explanation too
    assert bool({120} & {r[0] for r in want}) == bool(sizes)
    given = explain.explain_whole(some.withColumn("full_prediction", F.lit(1.0)), model(), ["total", "text"], epsilon=0.3, **sizes)
    assert {r.full_prediction for r in explain.listed(given).collect()} == {1.0}


def test_features_must_fit_their_atoms(spark, samples):
    bad = samples.where("size(adj) > 1").withColumn("features", F.slice("features", 1, 1))
    with pytest.raises(Exception, match="a row for each atom"):
        explain.explain_whole(bad, model(), ["total", "text"], most=16).collect()


def odd_orders(spark, path):
    rng = random.Random(5)
    lines = [(m, rng.randint(1, 6), rng.choice(["A", "N", None]), rng.choice([None, 1.0, 7.0, 20.0]), 10.5) for m in range(40) for _ in range(rng.randint(1, 8))]
    lines += [(50, 1, "A", 0.0, 1.0), (50, 2, "A", 0.0, None), (51, 3, "N", 5.0, None), (None, 1, "A", 3.0, 2.0), (52, 1, None, None, 1.0)]
    lines += [(53, i, "ANR"[i % 3] if i > 12 else None, 40.0 if i < 5 else 2.0, 3.7) for i in range(1, 18)]
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, schema).write.parquet(f"{path}/lineitem.parquet")


def same_as_sql(spark, path, name, query, sql):
    found, con = query(spark, str(path)), duckdb.connect()
    files = f"{path}/lineitem.parquet" + ("/*.parquet" if Path(f"{path}/lineitem.parquet").is_dir() else "")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{files}'")
    frame = con.sql(sql[name]).to_arrow_table()
    want = rows(frame.column_names, zip(*[c.to_pylist() for c in frame.columns], strict=True))
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == want
    return want


def test_minimal_explanations_shuffle_lines_alone(spark, tmp_path):
    found = plan(queries.minimal_explanations(spark, DATA))
    assert found.count("Exchange") == 1 and "Join" not in found and found.count("MapInArrow") == 1
    odd_orders(spark, tmp_path)
    want = same_as_sql(spark, tmp_path, "minimal_explanations", queries.minimal_explanations, queries.SQL)
    assert any(53 in r for r in want)  # an order of 17 lines


def test_shapes_are_made_once(monkeypatch):
    monkeypatch.setattr(subgraphs, "BLOCK", 8)
    adj = [{1: [2], 2: [1], 3: []}, {4: [5], 5: [4], 9: []}, {1: [3], 3: [1], 2: []}]
    column = pa.array([list(x.items()) for x in adj], pa.map_(pa.int32(), pa.list_(pa.int32())))
    shapes = subgraphs.Shapes(8, 8)
    found = {tuple(at): shape for shape, at in shapes.each(subgraphs.Molecules(column), column)}
    assert set(found) == {(0, 1), (2,)} and len(shapes.known) == 2
    assert sorted(found[0, 1].mask) == [1, 2, 3, 4, 5, 6, 7] and sorted(found[2,].parts) == [1, 1, 1, 1, 2, 2, 2]
    again = [shape for shape, _ in shapes.each(subgraphs.Molecules(column), column)]
    assert {id(x) for x in again} == {id(x) for x in found.values()}
    monkeypatch.setattr(subgraphs, "HELD", 7)
    full = subgraphs.Shapes(8, 8)
    assert [len(list(full.each(subgraphs.Molecules(column), column))) for _ in range(2)] == [2, 2] and len(full.known) == 1
    enough = np.array([[m in (1, 3, 6, 7) for m in found[0, 1].mask]])
    assert sorted(found[0, 1].mask[found[0, 1].least(enough)[1]]) == [1, 6]


def written(monkeypatch):
    """The plans and paths of explanations that queries write."""
    seen, real = [], io.write_explanations
    monkeypatch.setattr(io, "write_explanations", lambda df, path, **more: seen.append((plan(df), path)) or real(df, path, **more))
    return seen


def test_the_table_is_in_order_without_a_sort_of_its_own(spark, tmp_path, monkeypatch):
    seen = written(monkeypatch)
    odd_orders(spark, tmp_path)
    same_as_sql(spark, tmp_path, "explanation_table", chain_queries.explanation_table, chain_queries.SQL)
    same_as_sql(spark, DATA, "explanation_table", chain_queries.explanation_table, chain_queries.SQL)
    found, path = seen[-1]
    assert found.count("Exchange") == 1 and "Exchange rangepartitioning(l_orderkey" in found and "Join" not in found
    parts = sorted(Path(path.removeprefix("file://")).glob("part-*.csv"))
    keys = [(int(r["sample_index"]), int(r["size"]), float(r["difference"])) for part in parts for r in csv.DictReader(part.open(newline=""))]
    assert len(parts) > 1 and keys == sorted(keys)
    for _, other in seen[:1]:  # with an order of 17 lines, which is joined: rows are sorted once more
        keys = [int(r["sample_index"]) for part in sorted(Path(other.removeprefix("file://")).glob("part-*.csv")) for r in csv.DictReader(part.open(newline=""))]
        assert 53 in keys and keys == sorted(keys)


def test_atoms_of_explanations_are_counted_in_their_rows(spark, samples, tmp_path):
    found = plan(chain_queries.explanation_atoms(spark, DATA))
    assert found.count("Exchange") == 1 and "Join" not in found
    odd_orders(spark, tmp_path)
    want = same_as_sql(spark, tmp_path, "explanation_atoms", chain_queries.explanation_atoms, chain_queries.SQL)
    assert any(None in r for r in want)
    entries = F.array_sort(F.map_keys("adj"))
    atoms = F.transform(entries, lambda i: F.struct(i.alias("atom_idx"), F.lit("C").alias("symbol"), (i % 2 == 0).alias("is_aromatic"), (i > 30).alias("in_ring")))
    some = samples.where("size(adj) < 17").withColumn("a", atoms)
    whole = explain.explain_whole(some, model(), ["total", "text"], keep=("sample_id", "mol_id", "total", "a"), epsilon=0.3, most=16)
    keys = ["sample_id", "mol_id", "total", "atom_idx", "symbol", "is_aromatic", "in_ring"]
    own = explain.attach_target_fields(explain.listed(whole).drop("total", "a"), some, ["total", "y"])
    joined = explain.describe_atoms(own, some.select("mol_id", F.inline("a")).distinct()).join(own.select("sample_id", "total").distinct(), "sample_id")
    want = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    every = lambda df: sorted(tuple(r) for r in df.select(*keys, "n").collect())
    assert every(explain.described(whole)) == every(want) != []


def test_first_explanations_shuffle_lines_alone(spark, tmp_path, monkeypatch):
    seen = written(monkeypatch)
    odd_orders(spark, tmp_path)
    same_as_sql(spark, tmp_path, "top_explanations", chain_queries.top_explanations, chain_queries.SQL)
    same_as_sql(spark, DATA, "top_explanations", chain_queries.top_explanations, chain_queries.SQL)
    found, path = seen[-1]
    assert found.count("Exchange") == 1 and "Join" not in found and "Window" not in found
    lines = [line for part in Path(path.removeprefix("file://")).glob("part-*.csv") for line in part.read_text().splitlines()]
    assert {x for x in lines if x.startswith("sample_id")} == {"sample_id,mol_id,full_prediction,components,num_components,size,prediction,difference,rank,atom_indices"}
