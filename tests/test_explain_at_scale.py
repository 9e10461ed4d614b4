"""Connected sets, pairs and minimal sets as bitmaps, against the plainer path and brute force."""

import itertools
import random

import numpy as np
import pytest

from affinity_jobs import explain, graphs, subgraphs, udfs


def adjacency(spark, mols):
    atoms = [(m, i) for m, (ids, _) in mols.items() for i in ids]
    bonds = [(m, a, b) for m, (_, edges) in mols.items() for a, b in edges]
    return graphs.adjacency(spark.createDataFrame(atoms, "mol_id string, atom_idx int"), graphs.arcs(spark.createDataFrame(bonds, "mol_id string, a int, b int")))


def some(rng, ids, edges):
    return ids, sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(edges)})


def rows(df):
    return sorted((r.mol_id, tuple(r.atoms), tuple(map(tuple, r.components)), tuple(map(tuple, r.paths)), r.num_components, r["size"]) for r in df.collect())


def test_candidates_equal_the_joined_path(spark, monkeypatch):
    monkeypatch.setattr(subgraphs, "PAIRS", 50)
    monkeypatch.setattr(subgraphs, "CHUNK", 16)
    rng = random.Random(1)
    mols = {f"m{k}": some(rng, rng.sample(range(100), n), n + 2) for k, n in enumerate((2, 5, 8, 9, 18))} | {"one": ([7], []), "apart": ([3, 5, 9], [])}
    adj = adjacency(spark, mols)
    for sizes in ((4, 2, 5), (8, 2, 8), (1, 2, 2), (5, 2, 3)):
        plain = explain.collapse(explain.combine(explain.enumerate_connected(adj, sizes[0]), *sizes[1:])) if sizes[0] < 8 else None
        small = adj if sizes[0] < 8 else adj.where("size(adj) < 10")
        plain = plain or explain.collapse(explain.combine(explain.enumerate_connected(small, sizes[0]), *sizes[1:]))
        found = rows(explain.candidates(small, *sizes))
        assert found == rows(plain) and found
    assert rows(explain.candidates(adj.where("mol_id = 'm0'"), 2, 3, 4)) == rows(explain.collapse(explain.combine(explain.enumerate_connected(adj.where("mol_id = 'm0'"), 2), 3, 4)))
    assert explain.candidates(adj.limit(0)).collect() == []


def test_large_molecules_are_dealt_by_their_first_atom(spark):
    ids = list(range(0, 140, 2))
    ring = [(a, b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)]  # of 70 atoms: two words
    adj = adjacency(spark, {"ring": (ids, ring)})
    found = explain.enumerate_connected(adj, 8).collect()
    assert len(found) == len({tuple(r.atoms) for r in found}) == 70 * 8
    assert all(len(r.mask) == 2 and sum(bin(w & (1 << 64) - 1).count("1") for w in r.mask) == r["size"] for r in found)
    pairs = explain.combine(explain.enumerate_connected(adj, 2), 2, 3)
    want = {(a, b) for a, b in itertools.combinations([(i,) for i in ids] + [tuple(sorted(e)) for e in ring], 2) if not set(a) & set(b) and len(a) + len(b) <= 3}
    assert {frozenset(map(tuple, r.components)) for r in pairs.where("num_components = 2").collect()} == {frozenset(p) for p in want}


def test_paths_go_by_distance_then_number(spark):
    adj = adjacency(spark, {"m": ([0, 1, 2, 3, 4], [(0, 4), (4, 1), (0, 3), (1, 2)])})
    paths = {tuple(r.atoms): r.path for r in explain.enumerate_connected(adj).collect()}
    assert paths[0, 1, 3, 4] == [0, 3, 4, 1] and paths[0, 1, 2, 3, 4] == [0, 3, 4, 1, 2]


@pytest.mark.parametrize("with_mask", [True, False])
def test_minimal_sets_equal_brute_force(spark, with_mask):
    rng = random.Random(4)
    data = {(k, frozenset(rng.sample(range(90), rng.randint(1, 4)) if k else rng.sample(range(7), rng.randint(1, 5)))) for k in (0, 1, None) for _ in range(120)}
    word = lambda s, w: int(np.uint64(sum(1 << a - 64 * w for a in s if a // 64 == w)).astype(np.int64))
    df = spark.createDataFrame([(k, sorted(s), [word(s, 0), word(s, 1)], "x") for k, s in data], "sample_id int, atoms array<int>, mask array<bigint>, other string").repartition(5)
    found = explain.minimal(df if with_mask else df.drop("mask"))
    assert {(r.sample_id, frozenset(r.atoms)) for r in found.collect()} == {(k, s) for k, s in data if not any(j == k and o < s for j, o in data)}
    assert explain.minimal(df.limit(0)).collect() == []


def test_masked_samples_are_scored_across_samples(spark):
    samples = spark.createDataFrame([(k, [[float(k + i), 1.0] for i in range(n)], k * 10) for k, n in ((0, 3), (1, 40), (2, 1), (9, 5))], "sample_id int, features array<array<double>>, extra int")
    rng = random.Random(2)
    data = [(k, sorted(rng.sample(range(n), rng.randint(0, n))), str(j)) for k, n in ((0, 3), (1, 40), (2, 1)) for j in range(30)] + [(7, [0], "no sample"), (None, [0], "no key"), (0, None, "none")]
    rows = spark.createDataFrame(data, "sample_id int, atoms array<int>, name string").repartition(3)
    sizes = spark.sparkContext.accumulator(0)

    def make_predict():
        def predict(batch):
            assert len(batch) <= 7
            sizes.add(1)
            return [x["features"][:, 0].sum() + x["extra"] + x["mask"].sum() / 1000 for x in batch]

        return predict

    found = {(r.sample_id, r.name): r.prediction for r in udfs.score_masked(rows, samples, make_predict, batch_size=7).collect()}
    want = {(k, name): sum(k + a for a in atoms or []) + 10 * k + len(atoms or []) / 1000 for k, atoms, name in data if k in (0, 1, 2)}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(v) for k, v in want.items())
    assert sizes.value < len(data)
    shuffled = udfs.score_masked(rows, samples, make_predict)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in shuffled  # features stand in one row a sample, not in each candidate's
    by_id = samples.selectExpr("sample_id", "slice(features, 1, 2) AS features", "extra", "array(30, 50) AS names")
    some = spark.createDataFrame([(1, [30]), (1, [50, 30]), (1, [4])], "sample_id int, atoms array<int>")
    values = {tuple(r.atoms): r.prediction for r in udfs.score_masked(some, by_id, lambda: lambda b: [x["features"][:, 0].sum() for x in b], ids="names").collect()}
    assert values == {(30,): 1.0, (50, 30): 3.0, (4,): 0.0}


def test_components_of_long_paths_and_many_bonds(spark):
    rng = random.Random(8)
    numbers = rng.sample(range(10_000), 5000)
    mols = {"path": (numbers, list(zip(numbers, numbers[1:], strict=False))), "apart": ([4, 9, 2, 30], [(9, 2)]), "one": ([5], []), "loop": ([1, 2], [(1, 1)])}
    found = {(r.mol_id, r.atom_idx): r.component for r in graphs.components(adjacency(spark, mols)).collect()}
    assert {v for (m, _), v in found.items() if m == "path"} == {min(numbers)} and len(found) == 5007
    assert {k[1]: v for k, v in found.items() if k[0] == "apart"} == {4: 4, 9: 2, 2: 2, 30: 30} and (found["loop", 1], found["loop", 2]) == (1, 2)
    assert graphs.components(adjacency(spark, mols).limit(0)).collect() == []
    bonds = np.random.default_rng(0).integers(0, 1_500_000, (2, 1_000_000))
    label = graphs.least_reached(1_500_000, *bonds)
    assert (label[bonds[0]] == label[bonds[1]]).all() and (label <= np.arange(len(label))).all() and (label[label] == label).all()
