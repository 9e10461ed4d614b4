"""Hand-computed cases and properties of the domain jobs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity_jobs import encode, explain, graphs, io, metrics, pairs, queries, splits, targets, udfs


def test_json_dictionary_keeps_order_and_folds_keep_repeats(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"b": "CC", "a": "CO", "c": "CC"}')
    (tmp_path / "train.json").write_text("[[0, 2], [1, 1]]")
    (tmp_path / "test.json").write_text("[3, 4]")
    assert [tuple(r) for r in io.read_json_dict(spark, str(tmp_path / "l.json"), "ligand_id", "smiles").collect()] == [(0, "b", "CC"), (1, "a", "CO"), (2, "c", "CC")]
    assert [tuple(r) for r in io.read_folds(spark, str(tmp_path / "train.json"), "train").collect()] == [("train", 0, 0), ("train", 0, 2), ("train", 1, 1), ("train", 1, 1)]
    assert [tuple(r) for r in io.read_folds(spark, str(tmp_path / "test.json"), "test").collect()] == [("test", 0, 3), ("test", 0, 4)]


def test_matrix_to_pairs(spark, tmp_path):
    nan = float("nan")
    matrix = spark.createDataFrame([(0, [10000.0, nan]), (1, [nan, nan]), (2, [0.0, -1.0])], "row_idx long, values array<double>")
    cells = pairs.cell_ordinal(matrix.withColumn("values", F.transform("values", pairs.pkd)))
    assert sorted((r.row_idx, r.col_idx, r.ordinal, r.value) for r in cells.collect()) == [(0, 0, 0, 5.0), (2, 0, 1, math.inf)]
    folds = spark.createDataFrame([(0,), (0,), (9,)], "ordinal long")
    ligands = spark.createDataFrame([(0, "C,C"), (2, "CO")], "row_idx long, smiles string")
    proteins = spark.createDataFrame([(0, "T", "MK"), (1, "U", "MK")], "col_idx long, target_id string, target_sequence string")
    labelled = pairs.label_pairs(pairs.select_fold(cells, folds), ligands, proteins)
    io.write_pairs(labelled, str(tmp_path / "p"))
    io.write_pairs(labelled.limit(0), str(tmp_path / "p"))  # exists: left as it is
    assert [tuple(r) for r in io.read_pairs(spark, str(tmp_path / "p")).collect()] == [("C,C", "T", "MK", 5.0)] * 2
    assert tuple(pairs.summary(labelled, ["target_id"]).first()) == ("T", 2, 1, 1)
    assert pairs.all_sequences([labelled, labelled]).count() == 2


def test_metrics(spark):
    rng = random.Random(3)
    data = [("m", rng.choice([1.0, 2.0, 3.5]), rng.choice([0.0, 1.0, 2.0])) for _ in range(60)] + [("c", 1.0, 2.0), ("c", 1.0, 3.0)]
    df = spark.createDataFrame(data, "model string, y double, f double")
    found = {r.model: r for r in metrics.evaluate(df, ["model"]).collect()}
    y, f = (np.array([r[i] for r in data if r[0] == "m"]) for i in (1, 2))
    up = [(a, b) for a, b in itertools.permutations(zip(y, f, strict=True), 2) if a[0] > b[0]]
    assert found["m"].ci == pytest.approx(sum(1.0 if a[1] > b[1] else 0.5 * (a[1] == b[1]) for a, b in up) / len(up))
    assert found["m"].mse == pytest.approx(((y - f) ** 2).mean())
    assert found["m"].pearson == pytest.approx(np.corrcoef(y, f)[0, 1])
    assert math.isnan(found["c"].pearson) and found["c"].ci is None


def test_epochs(spark):
    rows = [("val", 0, 2000.0), ("val", 1, 5.0), ("val", 2, 5.0), ("val", 3, float("nan")), ("val", 4, 4.0), ("test", 1, 7.0), ("test", 4, 8.0)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, split string, epoch int, mse double")
    val = sorted((r.epoch, r.improved, r.best_epoch) for r in metrics.epoch_progress(df.where("split = 'val'"), ["model"]).collect())
    assert val == [(0, False, -1), (1, True, 1), (2, False, 1), (3, False, 1), (4, True, 4)]
    assert [(r.epoch, r.mse) for r in metrics.select_by_validation(df, ["model"]).collect()] == [(4, 8.0)]


def test_target_features(spark, tmp_path):
    names = spark.createDataFrame([(" abl1 (E255K)p",), ("a/b",), ("akt1-phosphorylated",)], "n string")
    assert [r[0] for r in names.select(targets.normalize_name(F.col("n"))).collect()] == ["ABL1", "A-B", "AKT1-PHOSPHORYLATED"]
    kinases = spark.createDataFrame([(1, "ABL1", "Human", "7", None, "TK", "x"), (0, "abl1", "HUMAN", "3", "Abl", "TK", "y")], "pos long, kinase_name string, species string, kinase_ID string, family string, `group` string, kinase_class string")
    pocket = "AV-LIKRD" * 7
    structures = spark.createDataFrame([(0, "3", "s0", "p", "AA", "in", "in", None, 0.0, 1.0), (1, "3", "s1", "p", pocket, "in", "out", "3.5", 8.0, None), (2, "3", "s2", "p", "AA", "in", "in", None, 8.0, 2.5)], "pos long, kinase_ID string, structure_ID string, pdb string, pocket string, DFG string, aC_helix string, Grich_rotation string, quality_score double, resolution double")
    proteins = spark.createDataFrame([("ABL1(T315I)", "SEQ"), ("none-phosphorylated", "SEQ"), ("lost", "")], "target_id string, target_sequence string")
    table = targets.feature_table(proteins, kinases, structures)
    io.write_features(table, str(tmp_path / "f"))
    table = io.read_features(spark, str(tmp_path / "f"))
    got = {r.target_id: r for r in targets.fill_from_donors(table, []).collect()}
    assert got["ABL1(T315I)"].best_structure_klifs_id == "s2" and got["ABL1(T315I)"].kinase_family == "Abl"
    assert got["none-phosphorylated"].klifs_kinase_id == "3" and got["none-phosphorylated"].has_structure == "1"
    assert got["lost"].klifs_kinase_id == "" and got["lost"].has_structure == "0"
    row = spark.createDataFrame([(pocket.replace("-", "_"),)], "p string")
    letters = row.select(targets.pocket_letters(F.col("p")).alias("l"), *[c.alias(n) for c, n in zip(targets.gatekeeper_hinge(F.col("p")), "gh", strict=True)])
    composition, share, charge = targets.pocket_summary(F.col("l"))
    assert tuple(letters.select(composition, share, charge, "g", "h").first()) == ("A:7;D:7;I:7;K:7;L:7;R:7;V:7", 4 / 7, 1 / 7, "I", "KRD")


def test_encoding(spark):
    df = spark.createDataFrame([("AZJ", "SP2", " "), ("", None, "1.5")], "s string, h string, n string")
    found = df.select(encode.sequence(F.col("s"), 4, False).alias("a"), encode.one_of_k(F.col("h"), graphs.HYBRIDS, "last").alias("b"), encode.numeric_or_zero(F.col("n")).alias("c")).collect()
    assert found[0].a == [1, 25, 0, 0] and found[1].a == [0, 0, 0, 0]
    assert found[0].b == [0, 1, 0, 0, 0, 0] and found[1].b == [0, 0, 0, 0, 0, 1]
    assert (found[0].c, found[1].c) == (0.0, 1.5)
    with pytest.raises(Exception, match="no code"):
        df.select(encode.sequence(F.col("s"), 4)).collect()
    features = spark.createDataFrame([tuple(["t"] + ["1"] * 17), tuple(["u"] + [""] * 17)], ", ".join(f"{c} string" for c in io.FEATURES))
    vectors = encode.target_vector(features, encode.vocabularies(features)).collect()
    assert {len(r.protein_feat) for r in vectors} == {14} and sum(vectors[1].protein_feat) == 5
    assert len(encode.target_codes(features).first().pocket) == 85
    lost = spark.createDataFrame([("x",)], "target_id string")
    with pytest.raises(Exception, match="no features"):
        encode.attach_targets(lost, features.select("target_id")).collect()


def test_graphs(spark):
    bonds = spark.createDataFrame([("m", 0, 1), ("m", 1, 0), ("m", 1, 2), ("m", 2, 0)], "mol_id string, a int, b int")
    atoms = spark.createDataFrame([("m", i, s, 1, 0, 0, "SP2", True, True) for i, s in enumerate(["C", "N", "Xx", "Cl"])], "mol_id string, atom_idx int, symbol string, num_hs int, implicit_valence int, formal_charge int, hybridization string, is_aromatic boolean, in_ring boolean")
    arcs = graphs.arcs(bonds)
    assert arcs.count() == 6
    hits = spark.createDataFrame([("m", 0, "LumpedHydrophobe"), ("m", 0, "ZnBinder")], "mol_id string, atom_idx int, family string")
    full = graphs.atom_vector(graphs.pharmacophore_flags(atoms.join(graphs.degree(atoms, arcs), ["mol_id", "atom_idx"]), hits)).orderBy("atom_idx").collect()
    assert {len(r.features) for r in full} == {99} and full[2].features[43] == 1 and full[0].features[95] == 1 and full[3].degree == 0
    masses = spark.createDataFrame([("C", 12.0), ("N", 14.0), ("Cl", 35.0), ("Xx", 1.0)], "symbol string, mass double")
    summary = graphs.molecule_summary(atoms, arcs, masses).first()
    assert (summary.n_atoms, summary.rings, summary.heteroatoms) == (4, 1, 3) and summary.weight == pytest.approx(62 + 4 * 1.008)
    assert spark.range(1).select(graphs.l1_normalize(F.array(F.lit(1.0), F.lit(3.0)))).first()[0] == [0.25, 0.75]
    nodes = spark.createDataFrame([("m", 0, [1.0], 1), ("m", 1, [2.0], 0), ("m", 2, [4.0], 1)], "mol_id string, atom_idx int, features array<double>, keep int")
    summed = {r.atom_idx: r.features for r in graphs.neighbor_sum(nodes, arcs, 0.5, "keep").collect()}
    assert summed == {0: [5.5], 1: [0.0], 2: [7.0]}


def brute_sets(n, bonds, most):
    near = {i: {b for a, b in bonds if a == i} | {a for a, b in bonds if b == i} for i in range(n)}
    out = set()
    for size in range(1, most + 1):
        for part in itertools.combinations(range(n), size):
            reach, todo = {part[0]}, [part[0]]
            while todo:
                new = (near[todo.pop()] & set(part)) - reach
                reach |= new
                todo += new
            if len(reach) == size:
                out.add(part)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_subgraphs_and_combinations(spark, seed):
    rng = random.Random(seed)
    n = 7
    bonds = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(8)})
    atoms = spark.createDataFrame([("m", i) for i in range(n)], "mol_id string, atom_idx int")
    adj = graphs.adjacency(atoms, graphs.arcs(spark.createDataFrame([("m", *b) for b in bonds], "mol_id string, a int, b int")))
    found = explain.enumerate_connected(adj, 4)
    sets = [tuple(r.atoms) for r in found.collect()]
    want = brute_sets(n, bonds, 4)
    assert len(sets) == len(set(sets)) and set(sets) == want
    combos = [tuple(map(tuple, r.components)) for r in explain.combine(found, 2, 4).collect()]
    pairs_of = {frozenset(p) for p in itertools.combinations(want, 2) if not set(p[0]) & set(p[1]) and len(p[0]) + len(p[1]) <= 4}
    assert {frozenset(c) for c in combos if len(c) == 2} == pairs_of and len(combos) == len(want) + len(pairs_of)
    assert explain.enumerate_connected(adj, 0).count() == n


def test_queries_of_combinations_take_up_to_eight_atoms(spark, tmp_path):
    rng = random.Random(6)
    orders = {1: [(i, "AB"[i % 2], 10.0) for i in range(1, 8)], 2: [(i, "A", 7.0) for i in range(1, 10)]}
    orders |= {m: [(i, rng.choice("ANR"), float(rng.randint(1, 50))) for i in range(1, rng.randint(2, 8))] for m in range(3, 12)}
    rows = [(m, *line) for m, lines in orders.items() for line in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    counts, least = {}, set()
    for m, lines in orders.items():
        n, weight = len(lines), [line[2] for line in lines]
        sets = brute_sets(n, [(a, b) for a, b in itertools.combinations(range(n), 2) if b == a + 1 or lines[a][1] == lines[b][1]], min(n, 8))
        made = [(frozenset(s), 1) for s in sets] + [(frozenset(x + y), 2) for x, y in itertools.combinations(sorted(sets), 2) if not set(x) & set(y) and len(x) + len(y) <= 8]
        for atoms, parts in made:
            counts.setdefault((m, len(atoms), parts), []).append(atoms)
        near = {atoms for atoms, _ in made if abs(1 - sum(weight[a] for a in atoms) / sum(weight)) <= 0.25}
        least |= {(m, ",".join(str(lines[a][0]) for a in sorted(s))) for s in near if not any(o < s for o in near)}
    found = {(r.mol_id, r["size"], r.num_components): (r.n, r.n_sets) for r in queries.disjoint_pairs(spark, str(tmp_path)).collect()}
    assert found == {k: (len(v), len(set(v))) for k, v in counts.items()} and max(k[1] for k in found) == 8
    explained = [(r.mol_id, r.atoms) for r in queries.minimal_explanations(spark, str(tmp_path)).collect()]
    assert sorted(explained) == sorted(least) and {m for m, _ in explained} == set(orders)


def test_minimal_and_dedup(spark):
    rows = [(1, [0, 1], [[0], [1]], [[0], [1]], 2, 2, 0.1), (1, [0, 1], [[0, 1]], [[0, 1]], 1, 2, 0.25), (1, [0, 1, 2], [[0, 1, 2]], [[0, 1, 2]], 1, 3, 0.0), (1, [3], [[3]], [[3]], 1, 1, 0.26)]
    df = spark.createDataFrame([(*r[:6], 1.0, 1.0 - r[6]) for r in rows], "sample_id long, atoms array<int>, components array<array<int>>, paths array<array<int>>, num_components int, size int, full_prediction double, prediction double")
    best = explain.dedup_by_atoms(explain.sufficient(df))
    assert sorted((r.atoms, r.num_components) for r in best.collect()) == [([0, 1], 1), ([0, 1, 2], 1)]
    kept = explain.ranked(explain.minimal(best), 20).collect()
    assert [(r.atoms, r["rank"]) for r in kept] == [([0, 1], 1)]
    assert explain.output_columns(best.where("size = 2")).first().components == "[[0,1]]"
    assert df.select(explain.masked_features(F.expr("array(array(1.0D), array(2.0D))"), F.array(F.lit(1)))).first()[0] == [[0.0], [2.0]]


def test_splits_and_udfs(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    first, again = (splits.exact_split(df, "k", seed=4).where("part = 'train'") for _ in range(2))
    assert first.count() == 800 and first.exceptAll(again).count() == 0
    sizes = splits.batches(df, "k", 100).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [1] + [100] * 10
    rows = spark.createDataFrame([("CC",), ("CC",), ("O",)], "smiles string")
    assert udfs.expand_distinct(rows, "smiles", lambda s: [(i, c) for i, c in enumerate(s)], "smiles string, atom_idx int, symbol string").count() == 3
    assert sorted(r.prediction for r in udfs.score(df, lambda: lambda part: part["k"].to_numpy() * 2.0, batch_size=10).collect())[-1] == 2000.0


def test_torn_outputs_are_written_again(spark, tmp_path):
    path = tmp_path / "out"
    rows = spark.range(20).withColumnRenamed("id", "k")
    io.write(rows.repartition(4), str(path))
    io.write(rows.limit(1), str(path))
    assert spark.read.parquet(str(path)).count() == 20  # whole: left as it is
    (path / "_SUCCESS").unlink()
    next(path.glob("part-*")).unlink()  # torn: half an output, without its marker
    io.write(rows, str(path))
    assert sorted(r.k for r in spark.read.parquet(str(path)).collect()) == list(range(20)) and io.finished(spark, str(path))
    (tmp_path / "empty").mkdir()
    io.write(rows.limit(2), str(tmp_path / "empty"))
    io.write(rows.limit(1), str(path), force=True)
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 2 and spark.read.parquet(str(path)).count() == 1


def test_values_outside_a_list_are_an_error(spark):
    df = spark.createDataFrame([(11,)], "degree int")
    with pytest.raises(Exception, match="not allowed: 11"):
        df.select(encode.one_of_k(F.col("degree"), graphs.COUNTS)).collect()
    assert df.select(encode.one_of_k(F.col("degree"), graphs.COUNTS, "last").alias("v")).first().v == [0.0] * 10 + [1.0]
