"""Molecules in a row each: summaries, samples, counted combinations and scores, against the jobs over atoms and arcs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinity_jobs import chain_queries, explain, graphs, queries, samples, subgraphs, udfs
from test_growth import plan


@pytest.fixture
def tables(spark):
    rng = random.Random(4)
    sizes = {m: rng.randint(1, 8) for m in range(12)} | {12: 18}
    atoms = [(m, 3 * i, rng.choice(["C", "O", None]), rng.randint(0, 3)) for m, n in sizes.items() for i in range(n)]
    bonds = [(m, 3 * a, 3 * b) for m, n in sizes.items() for a, b in itertools.combinations(range(n), 2) if rng.random() < (0.3 if n < 10 else 0.06)]
    masses = spark.createDataFrame([("C", 12.0), ("O", 16.0)], "symbol string, mass double")
    return spark.createDataFrame(atoms, "mol_id long, atom_idx int, symbol string, num_hs int"), graphs.arcs(spark.createDataFrame(bonds, "mol_id long, a int, b int")), masses


def whole(atoms, arcs, *fields):
    rows = atoms.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct("atom_idx", *fields))).alias("a"))
    return rows.join(graphs.adjacency(atoms, arcs).hint("merge"), "mol_id")


def tidy(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_summaries_of_whole_molecules(spark, tables):
    atoms, arcs, masses = tables
    found = graphs.molecule_summary(atoms, arcs, masses)
    assert "hashpartitioning(symbol" not in plan(found)  # three flags would make three tasks
    want = tidy(found)
    assert tidy(graphs.whole_summary(whole(atoms.join(masses, "symbol", "left"), arcs, "symbol", "num_hs", "mass"))) == want and len(want) == 13
    parts = dict(tidy(graphs.components(graphs.adjacency(atoms, arcs)).groupBy("mol_id").agg(F.count_distinct("component").alias("n"))))
    bonds = dict(tidy(arcs.where("src <= dst").groupBy("mol_id").count()))
    assert [r[4] for r in want] == [bonds.get(r[0], 0) - r[1] + parts[r[0]] for r in want]


def test_combinations_are_counted_where_sets_grow(spark, tables, monkeypatch):
    adj = graphs.adjacency(*tables[:2])
    monkeypatch.setattr(explain, "COUNTED", 64)
    monkeypatch.setattr(subgraphs, "PAIRS", 50)
    for sizes in ((4, 2, 6), (2, 2, 2), (2, 3, 4)):
        made = explain.combine(explain.enumerate_connected(adj, sizes[0]), *sizes[1:])
        want = made.groupBy("mol_id", "size", "num_components").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("atoms").alias("n_sets"))
        assert tidy(explain.count_combinations(adj, *sizes)) == tidy(want)


def test_columns_of_parts_are_made_before_their_pairs(spark, tables, tmp_path):
    atoms, arcs, _ = tables
    nodes = atoms.select("mol_id", "atom_idx", F.array(F.col("atom_idx") * 1.0).alias("features"))
    vectors = atoms.select("mol_id").distinct().withColumn("mol_features", F.array(F.lit(1.0)))
    table = samples.whole_molecule_table(whole(nodes, arcs, "features"), vectors)
    assert tidy(table) == tidy(samples.molecule_table(nodes, arcs, vectors)) and "Broadcast" not in plan(table)
    targets = spark.createDataFrame([("T", [1, 0, 2], [1.0], [1], [1], [1])], "target_id string, target array<int>, protein_feat array<float>, klifs_pocket array<int>, gatekeeper array<int>, hinge array<int>")
    pairs = spark.createDataFrame([(i, "d", "s", i % 13, "T", 1.0) for i in range(30)], "sample_id long, dataset string, split string, mol_id long, target_id string, y double")
    samples.write(pairs, table, targets, f"file://{tmp_path}/s", buckets=2)
    used = F.size(F.filter("target", lambda x: x != 0)).alias("used")
    found = samples.read(spark, f"file://{tmp_path}/s", molecules={"n": F.size("features")}, targets={"used": used})
    assert found.columns == [*samples.PAIRS, "n", "used"] and "Broadcast" not in plan(found)
    assert tidy(found) == tidy(samples.read(spark, f"file://{tmp_path}/s").select(*samples.PAIRS, F.size("features"), used))
    assert plan(found).index("SortMergeJoin") < plan(found).index("AS used")  # a plan's root stands first


def test_features_of_a_batch_become_one_array():
    kind = pa.list_(pa.list_(pa.float64()))
    even = udfs.feature_rows(pa.array([[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]], kind).slice(1))
    assert len(even) == 1 and even[0].tolist() == [[3.0, 4.0], [5.0, 6.0]]
    odd = udfs.feature_rows(pa.array([[[1.0]], [[2.0, None]], []], kind))
    assert [x.shape for x in odd] == [(1, 1), (1, 2), (0,)] and np.isnan(odd[1][0, 1])
    assert [x.tolist() for x in udfs.feature_rows(pa.array([[1, 2], [3]]))] == [[1.0, 2.0], [3.0]]


def test_lines_of_whole_molecules_meet_once(spark):
    found = plan(queries.whole_molecules(spark, "/root/testdata/sf0.001"))
    assert found.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in found
    want = dict(map(tuple, queries.molecule_adjacency(spark, "/root/testdata/sf0.001").collect()))
    assert {r.mol_id: r.adj for r in queries.whole_molecules(spark, "/root/testdata/sf0.001").collect()} == want


def test_scores_of_whole_samples_are_not_broadcast(spark):
    assert "Broadcast" not in plan(chain_queries.full_scores(spark, "/root/testdata/sf0.001"))
