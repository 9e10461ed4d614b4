"""Hard negatives, prefix tries and quality scores against brute force, on odd rows, and by held-out accuracy."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity_jobs.llm import hard_negatives, prefix_trie, quality

VECTORS = "vec_id long, embedding array<float>, label int, v int, score int, cell int"


def mined(rows):
    """Hard negatives by comparing every anchor with every row."""
    fine = [(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, l, v in sorted(fine):
        if i % 100 == 0:
            anchors.setdefault(i, (l, v))
    out = []
    for a, (la, va) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in fine)
        for ps, p, _ in [s for s in scored if s[2] == la and s[1] != a][:5]:
            fit = [(n, s) for s, n, l in scored if l != la and 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, p, k, n, -ps, -s) for k, (n, s) in enumerate(fit[:5], 1)]
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame([(i, v, l, 1, 2, 3) for i, v, l in rows], VECTORS)
    return sorted(tuple(r)[:6] for r in hard_negatives.hard_negatives(docs).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "LEVELS", (2, 6, 20))


def test_hard_negatives_equal_brute_force(spark, small):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.6)], int(rng.integers(4))) for i in range(700)]
    assert found(spark, rows) == mined(rows)


def test_hard_negatives_among_equal_vectors_ties_and_scales(spark, small):
    rng = np.random.default_rng(4)
    same = [(i, [0.5, 0.25, -1.0], i % 3) for i in range(150)]  # a group of copies over several shards
    zero = [(i, [0.0, 0.0, 0.0], i % 2) for i in range(200, 240)]
    large = [(i, [float(x) for x in rng.integers(-900, 900, 3)], i % 4) for i in range(300, 420)]
    below = [(i, [-1.0 * (i % 5), 0.5, 0.0], i % 2) for i in range(500, 560)]
    for rows in (same, zero, large, below, same + zero + large + below):
        assert found(spark, rows) == mined(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 0.5], None), (None, [1.0, 0.5], 1),
            (6, [1.0, 0.4], 1), (6, [1.0, 0.4], 1), (6, [0.9, 0.4], 2), (8, [1.0], 2), (9, [], 2), (8, [0.95, 0.5], 3), (200, [0.5, 0.5], 2), (200, [0.5, 0.5], 2)]
    padded = [(i, v if v is None else [*v, *[0.0] * (2 - len(v))], l) for i, v, l in rows]
    assert found(spark, rows) == mined(padded)
    assert found(spark, []) == [] and found(spark, [(100, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(100, [3e9, 3e9], 1), (1, [3e9, 3e9], 1)])


def test_cover_trees_cover(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (300, 5))
    radius = float(np.sqrt((v**2).sum(axis=1).max())) + 1
    made = hard_negatives.from_bytes(hard_negatives.to_bytes(hard_negatives.tree(np.arange(300), np.zeros(300, np.int64), v, radius)))
    x = hard_negatives.sphere(made["v"], radius)
    node = np.repeat(np.arange(len(made["starts"]) - 1), np.diff(made["starts"]))
    for level in range(int(made["levels"][0]) - 1, -1, -1):
        angle = np.arccos(np.clip((x * made[f"point{level}"][node]).sum(axis=1), -1, 1))
        assert (angle <= made[f"wide{level}"][node] + 1e-9).all()
        node = made[f"parent{level}"][node] if level else node
    q = rng.integers(-50, 50, (20, 5))
    length = np.sqrt((q**2).sum(axis=1))
    least, most = hard_negatives.bounds(np.c_[q / length[:, None], np.zeros(20)], length, made["point1"], made["wide1"], radius)
    node = np.repeat(np.arange(len(made["starts"]) - 1), np.diff(made["starts"]))
    for level in range(int(made["levels"][0]) - 1, 1, -1):
        node = made[f"parent{level}"][node]
    score = q @ made["v"].T
    assert (score >= least[:, node]).all() and (score <= most[:, node]).all()


TURNS = "conv_id long, turn long, role string, text string, depth int, n int, row string"


def trie(rows):
    """The trie of rebuilt conversations, their turns put together one by one."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(k) == len(q) + 1 and k[: len(q)] == q for k in members)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes(spark, rows):
    talks = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS)
    return sorted((tuple(r)[:8] for r in prefix_trie.prefix_trie(talks).collect()), key=lambda r: r[:2])


def some_talks(n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [0, 100, *rng.choice(np.arange(1, 400), n, replace=False).tolist()]:
        rows += [(int(c), t, ["user", "bot"][t % 2], f"says {rng.integers(3)} é") for t in range(int(rng.integers(1, 9)))]
    return rows


def test_tries_equal_brute_force(spark):
    rows = some_talks()
    assert nodes(spark, rows) == trie(rows)
    refs = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS)).where("depth > 0").collect()
    stored = {(c, t + 1): x for c, t, _, x in rows}
    assert all((r.ref_conv, r.ref_turn) in stored for r in refs)


def test_tries_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", "a"), (7, 2, "user", "b"), (7, 2, "bot", "b"), (7, 2, "bot", "b"), (7, 0, "", None), (7, 9, "user", "z" * 5000),
            (-5, 1, "user", "minus"), (-5, 2, "bot", None), (300, 1, "user", "base"), (301, 1, "user", "base"), (302, 1, None, "base"), (105, 1, "user", "x"), (106, 1, "user", "x"), (107, 1, "user", "x")]
    rows += [(303 + k, t, "user", "same" if t < 4 else f"end {k % 2}") for k in range(8) for t in range(6)]
    want = [(c, t, r, x) for c, t, r, x in rows]
    base = trie([(c, t, r, x) for c, t, r, x in want if c is None or c >= 0])
    assert nodes(spark, [r for r in rows if r[0] is None or r[0] >= 0]) == base
    assert len(nodes(spark, rows)) > 0 and nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "a")]) == []


def test_long_conversations_over_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 63)
    rows = [(c, t, "user", f"turn {t % 7}") for c in (200, 203, 250) for t in range(90 - c % 7)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that partitions stay small
    try:
        assert nodes(spark, rows) == trie(rows)
        assert nodes(spark, some_talks(40, 3)) == trie(some_talks(40, 3))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_clashing_hashes_are_found_and_hashed_anew(spark, monkeypatch):
    rows, seeds = some_talks(30, 5), []
    true_hashes = prefix_trie.turn_hashes

    def weak(role, text, seed):
        seeds.append(seed)
        return (F.length(text).cast("long"), F.lit(1).cast("long")) if seed == 0 else true_hashes(role, text, seed)

    monkeypatch.setattr(prefix_trie, "turn_hashes", weak)
    assert nodes(spark, rows) == trie(rows) and max(seeds) == 1
    monkeypatch.setattr(prefix_trie, "turn_hashes", true_hashes)
    bases = prefix_trie.bases
    monkeypatch.setattr(prefix_trie, "bases", lambda seed: [1, 1, 1, 1] if seed == 0 else bases(seed))  # turns in any order have one sum
    swapped = [(400, 1, "u", "a"), (400, 2, "u", "b"), (500, 1, "u", "b"), (500, 2, "u", "a")]
    assert nodes(spark, swapped) == trie(swapped)


def test_primes_are_primes():
    for p in prefix_trie.PRIMES:
        assert p < 1 << 31 and all(p % k for k in range(2, int(p**0.5) + 1))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.op13(spark, folder).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    bad, good = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert sum(r.predicted == 0 for r in bad) >= 0.93 * len(bad) and sum(r.predicted == 1 for r in good) >= 0.98 * len(good)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, 40)) if i % 2 else "@@ ## " * 30 + str(i) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "w1 w2 " * 50_000), (None, "w3"), (1, "another text of id 1"), (103, texts[1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (101, 7)], "doc_id long, quality int")
    out = quality.quality(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows)
    assert sum(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 60) >= 58
    again = quality.quality(docs, quality.fit(docs.repartition(5), labels.repartition(3))).collect()
    assert sorted((repr(r.doc_id), r.score) for r in again) == sorted((repr(r.doc_id), r.score) for r in out)
    assert quality.quality(docs.limit(0), quality.fit(docs, labels)).collect() == []
    assert {r.score for r in quality.quality(docs, quality.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.quality(docs, quality.fit(docs.limit(0), labels)).collect()} == {0.0}


def test_whole_texts_are_compressed():
    sizes = quality.Sizes(quality.trained([b"good words in a row " * 40] * 30), quality.trained([b"%% bad && junk ## " * 40] * 30))
    clean = b"good words in a row " * 2000
    assert sizes.features(clean)[0] > sizes.features(clean + b"%% bad && junk ## " * 2000)[0]  # what stands at the end counts
