"""Stored model samples, molecule vectors and the table of explanations on odd rows."""

import csv
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from affinity_jobs import encode, explain, graphs, io, samples


@pytest.fixture
def parts(spark):
    atoms = spark.createDataFrame([(1, 4, [1.0, 2.0]), (1, 9, [3.0, 4.0]), (1, 6, [5.0, 6.0]), (2, 0, [7.0, 8.0])], "mol_id long, atom_idx int, features array<double>")
    bonds = spark.createDataFrame([(1, 4, 9), (1, 9, 4), (1, 6, 9), (1, 6, 7), (3, 0, 1)], "mol_id long, a int, b int")
    vectors = spark.createDataFrame([(1, [1.0] * 8), (2, [2.0] * 8), (3, [3.0] * 8)], "mol_id long, mol_features array<double>")
    names = ["has_structure", "pocket_hydrophobicity", "pocket_charge", "activation_loop_state", *encode.CATEGORIES]
    schema = ", ".join(f"{c} string" for c in ["target_id", "target_sequence", *names, "klifs_85_residue_sequence", "gatekeeper_residue", "hinge_residues"])
    features = spark.createDataFrame([("T", "MK", "1", "0.5", "", None, "G", "F", "", "in", "out", "AJ", "A", "BC"), ("U", None, *[None] * 9, None, None, None)], schema)
    pairs = spark.createDataFrame([(7, "1", "01", 1, "T", 5.0), (8, "1", "01", 1, "U", None), (9, None, "x", 2, "T", 6.0), (9, None, "x", 2, "T", 6.0)], "sample_id long, dataset string, split string, mol_id long, target_id string, y double")
    return pairs, samples.molecule_table(atoms, graphs.arcs(bonds), vectors), samples.target_table(features, encode.vocabularies(features))


def test_samples_come_back_whole(spark, tmp_path, parts):
    path = f"file://{tmp_path}/s"
    samples.write(*parts, path, buckets=3)
    rows = sorted(samples.read(spark, path).collect(), key=lambda r: (r.sample_id, r.target_id))
    assert [(r.sample_id, r.dataset, r.split, r.y, r.c_size) for r in rows] == [(7, "1", "01", 5.0, 3), (8, "1", "01", None, 3), (9, None, "x", 6.0, 1), (9, None, "x", 6.0, 1)]
    assert rows[0].features == [[1.0, 2.0], [5.0, 6.0], [3.0, 4.0]] and rows[0].edge_index == [[0, 1, 2, 2], [2, 2, 0, 1]]
    assert rows[2].edge_index == [[], []] and rows[2].mol_features == [2.0] * 8
    assert rows[0].target == [12, 10] + [0] * 998 and rows[1].target == [0] * 1000 and rows[0].klifs_pocket == [1, 0] + [0] * 83
    assert rows[0].gatekeeper == [1] and rows[0].hinge == [2, 3, 0] and rows[0].protein_feat == [1, 0.5, 0, 0, 0, 1, 0, 1, 1, 0, 1, 0, 1]
    assert samples.read(spark, path, "1", "01").count() == 2 and samples.read(spark, path, split="x").count() == 2
    # another session has no table of this name, and takes the files
    spark.sql(f"DROP TABLE {samples._name(path)}")
    assert sorted((r.sample_id, r.split) for r in samples.read(spark, path).collect()) == [(7, "01"), (8, "01"), (9, "x"), (9, "x")]


def test_whole_parts_are_kept_and_torn_ones_written_again(spark, tmp_path, parts):
    path = f"file://{tmp_path}/s"
    samples.write(*parts, path, buckets=2)
    samples.write(parts[0].limit(1), *parts[1:], path, buckets=2)
    assert samples.read(spark, path).count() == 4
    samples.write(parts[0].where("sample_id = 8"), *parts[1:], path, buckets=2, force=True)
    assert [r.sample_id for r in samples.read(spark, path).collect()] == [8]
    (tmp_path / "s" / "pairs" / "_SUCCESS").unlink()
    samples.write(*parts, path, buckets=2)
    assert samples.read(spark, path).count() == 4
    samples.write(*[p.limit(0) for p in parts], f"{path}0", buckets=2)
    assert samples.stored_pairs(spark, f"{path}0").count() == 0 and samples.read(spark, f"{path}0").count() == 0


def test_predictions_join_stored_pairs_without_their_shuffle(spark, tmp_path, parts):
    path = f"file://{tmp_path}/s"
    samples.write(*parts, path, buckets=4)
    scored = spark.createDataFrame([(7, 1.0), (9, 2.0)], "sample_id long, prediction double")
    plan = samples.stored_pairs(spark, path).hint("merge").join(scored, "sample_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_pair_without_its_molecule_is_an_error(spark, tmp_path, parts):
    path = f"file://{tmp_path}/s"
    samples.write(parts[0].withColumn("mol_id", F.lit(5).cast("long")), *parts[1:], path, buckets=2)
    with pytest.raises(Exception, match="no features"):
        samples.read(spark, path).collect()


def test_molecule_vectors(spark):
    atoms = spark.createDataFrame([(1, 0, "C", 3), (1, 1, "O", 1)], "mol_id long, atom_idx int, symbol string, num_hs int")
    bonds = spark.createDataFrame([(1, 0, 1)], "mol_id long, a int, b int")
    masses = spark.createDataFrame([("C", 12.011), ("O", 15.999)], "symbol string, mass double")
    summary = graphs.molecule_summary(atoms, graphs.arcs(bonds), masses)
    names = "mol_id long, logp double, tpsa double, rotatable int, hbd int, hba int, weight double"
    given = spark.createDataFrame([(1, -0.4, None, 0, 1, 1, 99.0), (1, 0.4, 3.0, 0, 1, 1, 99.0)], names)
    (row,) = graphs.molecule_vector(summary, given).collect()
    assert row.mol_features[0] == pytest.approx(32.042) and math.isnan(row.mol_features[2]) and row.mol_features[3:] == [0, 1, 1, 1, 0] and row.mol_features[1] == -0.4
    with pytest.raises(Exception, match="no features"):
        graphs.molecule_vector(summary, given.limit(0)).collect()


def test_table_of_explanations(spark, tmp_path):
    schema = "sample_id long, mol_id long, paths array<array<int>>, components array<array<int>>, atoms array<int>, num_components int, size int, full_prediction double, prediction double, difference double, rank int"
    found = spark.createDataFrame([(5, 1, [[3, 1], [6]], [[1, 3], [6]], [1, 3, 6], 2, 3, 1.0, 0.9, 0.1, 2), (5, 1, [[2]], [[2]], [2], 1, 1, 1.0, 0.8, 0.2, 1), (4, 1, [[0]], [[0]], [0], 1, 1, 2.0, 2.0, 0.0, 1)], schema)
    texts = spark.createDataFrame([(5, 'C"C,O')], "sample_id long, full_smiles string")
    names = lambda sets: F.transform(sets, lambda s: F.concat(F.lit('f"'), F.array_join(s.cast("array<string>"), "")))
    io.write_explanations(explain.explanation_table(found, texts, dataset="d", model_name="m", fragments=names), str(tmp_path / "t"))
    rows = [r for part in sorted(Path(tmp_path / "t").glob("part-*.csv")) for r in csv.DictReader(part.open(newline=""))]
    assert list(rows[0]) == explain.TABLE
    assert [(r["sample_index"], r["full_smiles"], r["atom_indices"], r["size"]) for r in rows] == [("4", "", "[0]", "1"), ("5", 'C"C,O', "[2]", "1"), ("5", 'C"C,O', "[1,3,6]", "3")]
    assert rows[2]["components"] == "[[1,3],[6]]" and rows[2]["fragment_smiles"] == 'f"136' and (rows[2]["epsilon"], rows[2]["max_total_atoms"]) == ("0.25", "8")
    (bare,) = explain.explanation_table(found.where("sample_id = 4"), texts, dataset="d", model_name="m", max_total=None).collect()
    assert bare.fragment_smiles is None and bare.component_smiles is None and bare.max_total_atoms is None
