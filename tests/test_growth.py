"""Joins, aggregates and memory that must not grow with the tables."""

import contextlib
import io as texts

from pyspark.sql import functions as F

from affinity_jobs import chain_queries, encode, explain, graphs, io, queries


def plan(df) -> str:
    with contextlib.redirect_stdout(texts.StringIO()) as out:
        df.explain()
    return out.getvalue()


def pair_of_orders(spark):
    atoms = spark.createDataFrame([(m, i, "AR"[i % 2], float(i + 1)) for m in range(3) for i in range(4)], "mol_id long, atom_idx int, symbol string, weight double")
    bonds = spark.createDataFrame([(m, i, i + 1) for m in range(3) for i in range(3)], "mol_id long, a int, b int")
    return atoms, graphs.arcs(bonds)


def test_no_join_of_explanations_is_broadcast(spark):
    atoms, arcs = pair_of_orders(spark)
    adj = graphs.adjacency(atoms, arcs)
    samples = atoms.groupBy("mol_id").agg(F.sum("weight").alias("total")).withColumn("sample_id", F.col("mol_id"))
    score = lambda rows: rows.withColumn("prediction", F.size("atoms") / 4.0)
    found = explain.explain(samples, adj, score)
    assert "Broadcast" not in plan(found)
    assert {r["size"] for r in found.collect()} == {3}
    assert "Broadcast" not in plan(explain.attach_target_fields(found, samples, ["total"]))
    assert "Broadcast" not in plan(explain.describe_atoms(found, atoms.withColumns({"is_aromatic": F.lit(True), "in_ring": F.lit(True)})))
    assert "Broadcast" not in plan(explain.combine(explain.enumerate_connected(adj)))


def test_codes_of_targets_take_no_join(spark, tmp_path):
    rows = [(1, "red bolt", "LARGE"), (2, "jar", "SMALL")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = chain_queries.target_sequences(spark, str(tmp_path))
    assert "Join" not in plan(found)
    assert [r["codes"].split(",")[:4] for r in found.orderBy("p_partkey").collect()] == [["17", "5", "4", "2"], ["1", "17", "0", "0"]]
    twice = spark.createDataFrame([(1, "A", "K", "A"), (1, "C", "K", "A")], "target_id long, klifs_85_residue_sequence string, gatekeeper_residue string, hinge_residues string")
    assert encode.target_codes(twice).count() == 2


def test_the_tasks_of_molecules_follow_their_rows(spark, monkeypatch):
    lines = spark.range(1000)
    assert io.tasks(lines) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(io, "TASK_ROWS", 50)
    assert io.tasks(lines) == 20
    assert "hashpartitioning(l_orderkey#" in (found := plan(queries.arcs_degree(spark, "/root/testdata/sf0.001")))
    assert "REPARTITION_BY_NUM" in found
    atoms, arcs = pair_of_orders(spark)
    nodes = atoms.select("mol_id", "atom_idx", F.array("weight").alias("features"))
    for step in (graphs.neighbor_sum, graphs.gcn_propagate):
        tidy = lambda df: sorted((r.mol_id, r.atom_idx, round(r.features[0], 9)) for r in df.collect())
        assert tidy(step(nodes, arcs, tasks=7)) == tidy(step(nodes, arcs)) and "Broadcast" not in plan(step(nodes, arcs, tasks=7))
