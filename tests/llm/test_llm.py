"""The corpus operators against brute force, exact round trips, and on odd rows."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from affinity_jobs.llm.common import packed
from affinity_jobs.llm import bpe, embed_dedup, html_text, langid, media, mixing, near_dedup, ngram_lm, suffix_dedup, toxicity

TWICE = "the same text twice over and over again, the same"
ODD = [(0, None, None, None), (1, "", "en", "a"), (2, "a", "en", None), (3, "x" * 5000, "de", "a"), (4, TWICE, "en", "b"), (5, TWICE, "en", "b"), (6, "  \n\t ", None, "c"), (None, TWICE, "en", "a"), (4, TWICE, "en", "b"), (None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that clash with those that operators use or return.
CLASHING = ["row", "found", "score", "rate", "lang_pred", "foreign", "position", "at", "size", "spans", "_id", "_spans", "_n", "part", "first", "key", "n", "kept"]


@pytest.fixture
def odd(spark):
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame([(*r, *[77] * len(CLASHING)) for r in ODD], f"{SCHEMA}, {extra}")


@pytest.fixture
def empty(odd):
    return odd.limit(0)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def score_toxicity(docs):
    labels = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("toxic")).where("doc_id IS NOT NULL")
    return toxicity.toxicity(docs, toxicity.fit(docs, labels))


def pages(docs):
    return html_text.main_text(docs.withColumnRenamed("text", "html"), html_text.fit(docs.select("doc_id", "text"), ident="doc_id", markup="text"))


def vectors(docs):
    return embed_dedup.near_duplicates(docs.selectExpr("doc_id AS vec_id", "array(cast(length(text) AS double), 1D) AS embedding", "n", "row"))


JOBS = {
    "near": near_dedup.near_duplicates, "toxicity": score_toxicity, "bpe": lambda d: bpe.digests(d, bpe.default_path()), "html": pages,
    "langid": lambda d: langid.identify(d, langid.fit(d)), "lm": lambda d: ngram_lm.score(d, ngram_lm.fit(d)), "suffix": suffix_dedup.digests,
    "media": lambda d: media.measured(media.stored(d)), "media columns": media.media_columns, "mix": mixing.mix, "vectors": vectors,
}


@pytest.mark.parametrize("name", list(JOBS))
def test_empty_tables_and_odd_rows(empty, odd, name):
    assert JOBS[name](empty).collect() == []
    found = [r[0] for r in JOBS[name](odd).collect()]
    assert sorted(found, key=repr) == sorted([r[0] for r in ODD], key=repr)  # a row for each, nulls and repeated ids too


def test_own_columns_stay(odd):
    out = langid.identify(odd, langid.fit(odd)).where("doc_id = 3").first()
    assert all(out[c] == 77 for c in CLASHING) and out["lang_pred_"] == "de" and out["score_"] > 0
    kept = suffix_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and all(r[c] == 77 for r in kept.collect() for c in CLASHING)
    assert mixing.curriculum(odd).columns == odd.columns and all(r.position == 77 for r in mixing.curriculum(odd).collect())


def test_stages_on_odd_rows(spark, empty, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
    kept = {name: sorted([r.doc_id for r in stage(spark, odd, "").collect()], key=repr) for name, stage in corpus_pipeline.STAGES}
    assert kept["language"] == sorted([2, 3, 4, 5, 4, None], key=repr)
    assert kept["near_duplicates"] == sorted([0, 1, 2, 3, 4, 4, 6, None, None], key=repr)
    assert kept["repeated_strings"] == sorted([r[0] for r in ODD], key=repr)
    assert set(kept["mixing"]) == {2, 3, 4, 5, None} and len(kept["encoding"]) == len(ODD)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{i}" for i in rng.integers(0, 400, rng.integers(3, 60))] for _ in range(40)]
    docs = []
    for words in base:
        for _ in range(5):
            copy = list(words)
            if rng.random() < 0.7:
                copy[int(rng.integers(len(copy)))] = "other"
            docs.append((len(docs), " ".join(copy)))
    found = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()}
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in docs)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.n_shingles == len(sets[i]) for i, r in found.items())


def test_suffix_arrays_and_repeats(spark):
    rng = np.random.default_rng(2)
    for n, letters in ((1, 1), (40, 1), (300, 2), (2000, 5)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        array = suffix_dedup.suffix_array(t)
        assert array.tolist() == sorted(range(n), key=lambda i: bytes(t[i:]))
    base = "".join(map(chr, rng.integers(97, 123, 300)))
    docs = [(i, base[i : i + 200] + str(i) * 3 + base[: 110 + i]) for i in range(12)] + [(50, None), (51, "short"), (52, "ab" * 150)]
    seen, want = set(), {}
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    for hot in (64, 2):
        suffix_dedup.HOT = hot
        found = suffix_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in found} == want
    suffix_dedup.HOT = 64


def test_suffix_dedup_keeps_null_ids_whole(spark):
    text = "".join(map(chr, np.random.default_rng(4).integers(97, 123, 150)))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, text), (None, None)], "doc_id long, text string")
    removed = [(r.doc_id, r.n_removed) for r in suffix_dedup.digests(docs).collect()]
    assert sorted(removed, key=repr) == [(1, 0), (2, 150), (None, 0), (None, 0), (None, 0)]
    kept = [tuple(r) for r in suffix_dedup.deduplicate(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, text), (None, text), (None, text), (None, "")], key=repr)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, other = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    texts = ["", "aaaaaaa", "It's <|endoftext|> 123", "  \n x", "日本語 é", "ab" * 300]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == other.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == other.decode(ids.tolist(), skip_special_tokens=False)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32) * 0.25).tolist()) for i in range(200)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, 2.0]), (904, [])]
    rows += [(300 + i, rows[0][1]) for i in range(3)]
    found = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 900}
    links = [(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= 0.9]
    want = components(found, links)
    assert sum(want[i] != r.component_id for i, r in found.items()) == 0
    assert sum(r.n_links for r in found.values()) >= 0.98 * 2 * len(links)


def test_balls_of_close_vectors_lose_no_link(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((6, 64)))
    # groups of copies from tight, which are one ball, to loose, whose balls are linked in part, and a chain of small steps
    groups = [c + s * rng.standard_normal((60, 64)) for c, s in zip(centres, (0.005, 0.012, 0.02, 0.03, 0.04, 0.05), strict=True)]
    path = unit(rng.standard_normal((2, 64)))
    chain = [np.cos(t) * path[0] + np.sin(t) * path[1] for t in np.arange(0, 1.2, 0.04)]
    v = rng.permutation(np.concatenate([*groups, chain, groups[1][:5]]))
    rows = [(int(i), [float(y) for y in x]) for i, x in enumerate(v)]
    found = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999999).collect()}
    near = unit(v) @ unit(v).T >= 0.9
    for i in range(len(v)):
        assert found[i].n_links == near[i].sum() - 1
        reach = {i}
        while len(more := set(np.flatnonzero(near[sorted(reach)].any(axis=0)))) > len(reach):
            reach = more
        assert found[i].component_id == min(reach) and found[i].kept == (i == min(reach))
    assert len(found) == len(v)


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy now</div><article><h1>Head</h1><p>One <b>bo</b>ld &amp; two<br>three</p><script>var t="</p>"</script><aside>Note</aside><p>Four five six</p></article><footer>Foot</footer></body></html>'
    assert html_text.extract(page, html_text.learn([page])) == "Head\nOne bold & two three\nFour five six"
    assert html_text.extract(None) == "" and html_text.extract("<p></p>") == "" and html_text.extract("<p>a&nbsp;&lt; b") == "a < b"
    body = "<h1>T</h1><p>a b c d e f g h</p><p class=\"search-results-intro\">i j</p><p title=\"5\" tall\">k l</p><div class=\"ad\">buy</div><p>m n"
    wrapped = f'<form><div class="content no-sidebar"><div class="page-header main">{body}</div></div><div class="comments"><p>I like it</p></div></form>'
    assert html_text.extract(wrapped) == "T\na b c d e f g h\ni j\nk l\nm n"


def test_html_scan_is_the_best_region_and_pages_take_linear_time():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(scores)
        assert sum(scores[a:b]) == max([0.0, *[sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]])
    for piece in ("<nav>a ", "<div class=ad>a ", "<b><i>x</b>", '<a b="'):
        begin = time.time()
        html_text.extract(piece * 100_000)
        assert time.time() - begin < 30


def test_parses_equal_brute_force():
    rng = random.Random(1)
    known = {"a": ["the cat and the dog are in the house " * 5, "abcabcabc hello"], "b": ["der hund und die katze ist im haus " * 5]}
    model = langid.Model(known)
    samples = {lang: " ".join(known[lang]).encode() for lang in model.langs}

    def phrases(text, sample):
        at = count = 0
        while at < len(text):
            end = at + 1
            while end <= len(text) and text[at:end] in sample:
                end += 1
            at, count = max(end - 1, at + 1), count + 1
        return count

    texts = ["", "a", "zzz", "the cat and the dog are in the house " * 200, "abc" * 1000]
    texts += ["".join(rng.choice(["the cat ", "der hund ", "hello", "abc", "q", "\u00df", "haus im "]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    for piece in (7, 64, langid.PIECE):
        before, langid.PIECE = langid.PIECE, piece
        found = model.parse(*packed(texts)).tolist()
        langid.PIECE = before
        assert found == [[phrases(t.encode(), samples[lang]) for lang in model.langs] for t in texts]


def test_held_out_languages_and_toxicity(spark):
    data = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = langid.op5(spark, data).where("held_out").join(langs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op2(spark, data).where("held_out").join(labels, "doc_id").where("toxic IN (0, 1)").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.88 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted for r in rows if r.toxic)


def test_language_and_toxicity(spark):
    texts = [(i, ("the cat and the dog are in the house " if i % 2 else "der hund und die katze sind im haus ") * 3 + str(i), "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit(docs.where("doc_id < 30"))).where("doc_id >= 30").collect()
    assert all(r.lang_pred == r.lang for r in out)
    rng = np.random.default_rng(1)
    word = lambda: "".join(map(chr, rng.integers(97, 105, 5)))
    rows = [(i, " ".join([word() for _ in range(50)] + ["vile", "nasty"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 200], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([found[r[0]] == r[2] for r in rows[200:]]) > 0.9 and 999 in found


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(1, 40)), [None, "a", "b", "c"][int(rng.integers(4))]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken, goal = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size and (0 <= r.position <= 1 if r.taken else r.position is None)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_mix_equals_its_sql(spark):
    data = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    frame = con.sql(mixing.SQL)
    names = sorted(frame.columns)
    want = sorted(tuple(r[frame.columns.index(c)] for c in names) for r in frame.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in mixing.op9(spark, str(data)).collect()) == want


def test_positions_follow_the_schedules_on_one_clock(spark):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randint(1, 6), "abc"[rng.choice([0, 0, 0, 1, 1, 2])]) for i in range(3000)]
    rows = mixing.curriculum(spark.createDataFrame(docs, "doc_id long, text string, source string"), position="clock").collect()
    assert [r.clock for r in rows] == sorted(r.clock for r in rows)
    total, demand = 0, Counter()
    for r in rows:
        demand[r.source] += len(r.text) // 2
    share = {s: n / sum(demand.values()) for s, n in demand.items()}
    area = {"a": lambda t: 1.5 * t - t * t / 2, "b": lambda t: 0.75 * t + t * t / 2 if t < 0.5 else 0.5 + (t - 0.5) * (3 - t) / 2, "c": lambda t: 0.5 * t + t * t / 2}
    seen, times = Counter(), np.linspace(0, 1, 20001)
    clock = np.array([sum(share[s] * area[s](t) for s in "abc") for t in times])
    for r in rows:
        seen[r.source] += len(r.text) // 2
        total += len(r.text) // 2
        assert abs(total - r.clock * sum(demand.values())) < 30  # tokens so far are the position
        t = times[min(np.searchsorted(clock, r.clock), len(times) - 1)]
        assert all(abs(seen[s] - demand[s] * area[s](t)) < 30 for s in "abc")


def test_curriculum_keeps_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "s"), (None, "d e", "s"), (None, None, "s"), (1, "f", "s"), (1, "g h i j", "s"), (2, "k", "s"), (2, "k", "s")]
    once = [tuple(r) for r in mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(once, key=repr) == sorted([r for r in rows if r[1]], key=repr)  # one source: its target is its size
    rows += [(None, "w " * n, "t") for n in range(1, 40)]
    mixed = mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    words = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in "st"}
    assert words["s"] == 3 * 12 and abs(words["t"] - (12 + 780 - 36)) <= 20


def test_media_round_trip():
    payload = media.pad("é text".encode())
    assert len(payload) == 64 and media.load(media.store(payload)) == (payload, media.RATE)
    found = media.features(media.pad(bytes(range(256)) * 40))
    tensors, spans = media.blocks(found)
    batch = media.tensor_batch(tensors, spans)
    assert batch.column(0).type.shape == [media.BLOCK, media.MELS] and spans[0, 0] == 0


def test_media_of_a_whole_table(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = {r.doc_id: r for r in media.op8(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        payload, r = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text)), found[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.store(payload)).hexdigest()
    whole = media.resample(np.arange(200_000, dtype=np.float32) % 97)
    before, media.STRIP = media.STRIP, 1000
    assert np.allclose(whole, media.resample(np.arange(200_000, dtype=np.float32) % 97))
    media.STRIP = before


def test_token_digests_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(3)
    bits = ["the ", "  ", "\n", "\t x", " 12", "'s", " <|endoftext|>", "\u00e9", "\u65e5\u672c", " a", "!?", " .", "\U0001f600"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))) for i in range(100)] + [(900, None), (901, ""), (902, "".join(rng.choice(bits) for _ in range(20000)))]
    before, bpe.BATCH_CHARS = bpe.BATCH_CHARS, 1000  # long texts in stretches
    found = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(docs, "doc_id long, text string"), bpe.default_path()).collect()}
    stretches = bpe.vocabulary(bpe.default_path()).encode([docs[-1][1]])[0].tolist()
    bpe.BATCH_CHARS = before
    assert stretches == library.encode(docs[-1][1], add_special_tokens=False).ids
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    table = spark.createDataFrame(docs[:5], "doc_id long, text string")
    assert sorted(map(tuple, bpe.decode(bpe.encode(table, bpe.default_path()), bpe.default_path()).collect())) == sorted(docs[:5])


def test_language_model_equals_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("ABCDEFGHIJKLMNOP"[: rng.randint(2, 16)]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(90, None)]
    train = docs[:60]
    found = {r.doc_id: r for r in ngram_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), ngram_lm.fit(spark.createDataFrame(train, "doc_id long, text string"))).collect()}
    tokens = lambda t: [*(t or "").lower().split(), "END"]
    uni, bi, hist = Counter(), Counter(), Counter()
    for _, text in train:
        line = tokens(text)
        uni.update(line)
        bi.update(zip(["BEGIN", *line], line, strict=False))
    for (h, _), n in bi.items():
        hist[h] += n
    cont = Counter(w for _, w in bi)

    def discounts(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.9] if y else [0.5, 0.75, 0.9]
        return [0.0, *[min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]]

    d2, d1 = discounts(bi.values()), discounts(cont.values())
    left = sum(d1[min(c, 3)] for c in cont.values()) / len(bi)
    low = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + left / (len(uni) + 1)
    back = {h: sum(d2[min(n, 3)] for (g, _), n in bi.items() if g == h) / c for h, c in hist.items()}

    def probability(h, w):
        n = bi[h, w]
        return max(n - d2[min(n, 3)], 0) / max(hist[h], 1) + back.get(h, 1.0) * low(w)

    assert sum(probability("a", w) for w in [*uni, "never seen"]) == pytest.approx(1)
    total = sum(uni.values())
    for i, text in docs:
        line, r = tokens(text), found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(line), sum(uni[w] > 0 for w in line), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in line))
        assert r.score == pytest.approx(sum(math.log10(probability(h, w)) for h, w in zip(["BEGIN", *line], line, strict=False)))


def test_no_link_of_small_sets_is_lost():
    rng = np.random.default_rng(4)
    for k, _ in itertools.product(range(1, 41), range(40)):
        common, extra = rng.integers(1, 2**63, 4 * k).astype(np.uint64), rng.integers(1, 2**63, k).astype(np.uint64)
        h = int(rng.integers(0, k + 1))
        p, q = np.unique(np.r_[common, extra[:h]]), np.unique(np.r_[common, extra[h:]])
        x, y = near_dedup.registers(p), near_dedup.registers(q)
        assert near_dedup.near_enough(x[None], y[None], np.array([len(p)]), np.array([len(q)]), 80)[1][0]  # sizes 4 to 200, index 0.8
        assert near_dedup.linked(p, q, 80) and (x.reshape(near_dedup.BANDS, -1) == y.reshape(near_dedup.BANDS, -1)).all(axis=1).any()


def test_recursive_induction_of_wide_alphabets():
    rng = np.random.default_rng(0)
    for n, letters in ((2, 1), (300, 2), (3000, 1000), (999, 250)):
        t = rng.integers(0, letters, n)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    t = np.frombuffer(b"ab" * 300 + b"aab" * 100 + b"zyx" * 50, np.uint8)
    assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: bytes(t[i:]))


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(30)]
    passage = " ".join(word() for _ in range(40))
    texts += [texts[3], texts[4] + " more", passage + " " + texts[5], texts[6] + " " + passage, "12 34 !", "", None]
    docs = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", "u", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    rows = {i: (t, s) for i, t, _, s, _ in docs if t and any(c.isalpha() for c in t)}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, (t, _) in rows.items())}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = {i: rows[i] for i, least in components(sets, links).items() if i == least}
    seen, cut = set(), {}
    for i in sorted(rows):
        b = rows[i][0].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        if not gone.all():
            cut[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    size = {i: len(t.split()) for i, t in cut.items()}
    names = sorted({rows[i][1] for i in cut}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i in cut if rows[i][1] == s) for s in names}
    weight, target, held = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, {}
    while True:
        level = (sum(total.values()) - sum(held.values())) / sum(w for s, w in weight.items() if s not in held)
        over = {s: 3 * total[s] for s in names if s not in held and 3 * total[s] <= level * weight[s]}
        if not over:
            break
        held |= over
    target = {s: held.get(s, level * weight[s]) for s in names}
    taken = []
    for s in names:
        order = sorted((i for i in cut if rows[i][1] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15])
        passes, rest = divmod(int(target[s] + 0.5), total[s])
        for i in order:
            part = max(0, min(size[i], rest))
            rest -= size[i]
            taken += [i] * (passes + (2 * part >= size[i])) * (size[i] > 0)  # documents without words are never taken
    library = Tokenizer.from_file(bpe.default_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in cut.items()}
    assert found == sorted((i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()) for i in taken)
