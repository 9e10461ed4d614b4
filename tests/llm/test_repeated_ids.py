"""Rows that share an id but not their text, and null ids, in the operators that look at documents by id."""

import random

import numpy as np
import pytest

import corpus_pipeline
from affinity_jobs.llm import bpe, html_text, mixing, near_dedup, suffix_dedup

rng = random.Random(3)
A, B, X = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abx")
PASSAGE = X[:250]
ROWS = [(0, PASSAGE), (1, A), (1, B), (1, "short"), (2, A + " end"), (3, B + " end"), (5, PASSAGE + A[:40]), (5, "more " + PASSAGE), (5, None), (None, A), (None, B), (None, None), (1, A)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_lose_no_link(rows):
    found = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(rows, size=2).collect()}
    assert len([1 for r in near_dedup.near_duplicates(rows, size=2).collect()]) == len(ROWS)
    sets = {(i, t): {tuple((t or "").split()[j : j + 2]) for j in range(len((t or "").split()) - 1)} for i, t in ROWS}
    link = lambda p, q: p and q and 100 * len(p & q) >= 80 * len(p | q)
    assert link(sets[1, A], sets[2, A + " end"]) and link(sets[1, B], sets[3, B + " end"])
    assert {i: found[i, 60].component_id for i in (2, 3)} == {2: 1, 3: 1}  # rows 2 and 3 are near copies of different texts of id 1
    assert all(found[i, 60].kept == (i == 1) for i in (2, 3))


def test_a_text_of_an_id_that_is_kept_may_go(spark):
    rows = spark.createDataFrame([(5, A), (5, B), (2, A + " end"), (7, B + " end")], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()}
    assert kept == {(2, A + " end"), (5, B)}


def test_repeated_strings_of_the_text_that_counts(rows):
    found = suffix_dedup.digests(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in found) == sorted((i is None, i, len(t or "")) for i, t in ROWS)
    # of each id one text counts; those under 100 bytes don't
    judged = {i: min({t for j, t in ROWS if j == i and len(t or "") >= 100}, key=lambda t: codes(rows)[t]) for i in (0, 1, 2, 3, 5)}
    want, seen = {}, set()
    for i, t in sorted(judged.items()):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cover[k : k + 100] = True
            seen.add(b[k : k + 100])
        want[i, len(b)] = int(cover.sum())
    assert {(i, n): want.get((i, n), 0) for i, n in {(r.doc_id, r.n_bytes) for r in found if r.doc_id is not None}} == {(r.doc_id, r.n_bytes): r.n_removed for r in found if r.doc_id is not None}


def codes(rows):
    return {r.text: r.h for r in rows.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}


def test_mixes_agree_whatever_the_rows_order(spark, rows):
    some = [(7, " ".join("w" * (k % 5 + 1) for _ in range(k))) for k in range(1, 30)] + [(None, "v " * k) for k in range(1, 30)]
    made = []
    for data in (some, some[::-1]):
        docs = spark.createDataFrame([(i, t, "a" if n % 2 else "b") for n, (i, t) in enumerate(data)] if data is some else [(i, t, "a" if (len(data) - 1 - n) % 2 else "b") for n, (i, t) in enumerate(data)], "doc_id long, text string, source string")
        made.append(sorted([tuple(r) for r in mixing.mix(docs.repartition(3)).collect()], key=repr))
    assert made[0] == made[1]
    assert mixing.mix(rows).count() == len(ROWS)


def test_stages_keep_their_rows(spark, rows):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, rows, "").collect()
        assert found, name
    assert bpe.digests(rows, bpe.default_path()).count() == len(ROWS)
    assert corpus_pipeline.repeated_strings(spark, rows, "").count() == len(ROWS)


def test_an_empty_drawing_hides_nothing():
    found = lambda html: [m.group(0) for m in html_text.TOKEN.finditer(html)]
    assert found('<p>one</p><svg class="i"/><p>two</p>') == ["<p>", "</p>", '<svg class="i"/>', "<p>", "</p>"]
    assert found("<svg a='>' b=\"x/>\"><path/></svg><p>") == ["<svg a='>' b=\"x/>\"><path/></svg>", "<p>"]
    assert found("<svg " + 'a="b" ' * 2000 + "><i></svg>")[-1].endswith("</svg>")


def test_the_mix_comes_in_the_order_of_the_clock(spark):
    docs = [(i, " ".join(["w"] * (i % 7)), "abc"[i % 3]) for i in range(120)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and len(places) > 80 and all(r.position is None for r in rows[len(places) :])
    first, taken = {}, {}
    for r in mixing.curriculum(docs, whole=False, position="clock").collect():
        first[r.doc_id] = min(r.clock, first.get(r.doc_id, 2))
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert {r.doc_id: r.position for r in rows if r.taken} == first
    assert all((r.taken > r.size * (taken[r.doc_id] - 1)) and r.taken <= r.size * taken[r.doc_id] for r in rows if r.taken)
