"""Language identification by cross-parsing: how few phrases of a language's text does a text need?

For each language a suffix automaton is built over a bounded sample of labelled text. A document is
parsed greedily against it: from each place the longest match is one phrase, and the letter that
breaks it begins the next. The language with the fewest phrases per letter wins.

Letters are bytes of the text in lower case, whose other characters are spaces. A state's out-edges are
bits of a mask and a run of an array, so an automaton takes about 20 bytes a letter of its sample. Many
texts step through it together. A long text is parsed in pieces side by side; then each piece is parsed
anew from the state in which the one before it ended, until both parses are in one state, so that the
phrases are those of the whole text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, cut, fold, free_names, lean, packed, text_bytes, text_chunks

#: Bounds of the training sample: windows per language, their characters, characters of all, and languages.
WINDOWS, WINDOW_CHARS, SAMPLE_CHARS, LANGUAGES = 64, 800, 1 << 20, 4096
#: Long texts are parsed in pieces of this many bytes, and so many pieces at once.
PIECE, LANES = 1024, 1 << 13
#: A text is foreign to its best language if it needs so many times the most phrases of any training window.
FOREIGN, FOREIGN_LETTERS = 2.0, 40


def plain(text: Column) -> Column:
    """A text in lower case, each run of other characters than letters as one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Out-edges of the states of the suffix automaton of ``codes``; state 0 is "none", state 1 the root."""
    step: list[dict[int, int]] = [{}, {}]
    link, longest = [0, 0], [0, 0]
    last = 1
    for c in codes:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


class Model:
    """Automata of all languages, with a shared numbering of states and of the bytes seen."""

    def __init__(self, samples: dict[str, list[str]], foreign: dict[str, float] | None = None):
        self.langs = sorted(samples)
        #: Phrases per letter from which a text is foreign to the language.
        self.foreign = np.array([(foreign or {}).get(lang, np.inf) for lang in self.langs])
        texts = [" ".join(samples[lang]).encode() for lang in self.langs]
        seen = sorted({32, *b"".join(texts)})
        self.number = np.full(256, len(seen), np.uint8)  # bytes never seen share a number without edges
        self.number[seen] = np.arange(len(seen))
        self.words = len(seen) // 64 + 1
        sizes, edges, roots = [1], [], []
        for text in texts:
            base = sum(sizes) - 1
            states = automaton(self.number[np.frombuffer(text, np.uint8)].tolist())
            edges.append(np.array([(s + base, c, to + base) for s, out in enumerate(states) for c, to in sorted(out.items())], np.int64).reshape(-1, 3))
            roots.append(base + 1)
            sizes.append(len(states) - 1)
        state, letter, to = np.concatenate([*edges, np.zeros((0, 3), np.int64)]).T
        self.mask = np.zeros(sum(sizes) * self.words, U)
        np.bitwise_or.at(self.mask, state * self.words + letter // 64, U(1) << (letter % 64).astype(U))
        many = np.bitwise_count(self.mask)
        self.first = (np.cumsum(many, dtype=np.int64) - many).astype(np.int32)
        self.to = np.r_[to, 0].astype(np.int32)
        self.roots = np.array(roots, np.int32)
        #: The bit of each letter in its word, and its state after each language's root.
        self.bit = U(1) << (np.arange(256) & 63).astype(U)
        self.start = np.zeros((256, len(roots)), np.int32)
        root = np.isin(state, roots)
        self.start[letter[root], np.searchsorted(self.roots, state[root])] = to[root]

    def next(self, state: np.ndarray, letter: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one letter, and where it breaks a phrase of its language and begins the next one."""
        at = state if self.words == 1 else state * self.words + (letter >> 6)
        mask, bit = self.mask[at], self.bit[letter]
        to = self.to[self.first[at] + np.bitwise_count(mask & (bit - U(1)))]
        hit = mask & bit != 0
        return np.where(hit, to, self.start[letter, lang]), ~hit

    def walk(self, letters: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases broken and last states (pieces by languages) of pieces of letters, each from the root."""
        every = np.arange(len(self.langs))[None, :]
        broken = np.zeros((len(begin), len(self.langs)), np.int64)
        last = np.repeat(self.roots[None, :], len(begin), axis=0)
        for lane in range(0, len(begin), LANES):
            order = lane + np.argsort(-many[lane : lane + LANES], kind="stable")
            first, now, count = begin[order], last[order], broken[order].astype(np.int32)
            active = np.searchsorted(-many[order], -np.arange(int(many[order[0]])), side="left")  # pieces longer than each step
            for t, n in enumerate(active.tolist()):
                now[:n], miss = self.next(now[:n], letters[first[:n] + t][:, None], every)
                count[:n] += miss
            broken[order], last[order] = count, now
        return broken, last

    def rewalk(self, letters: np.ndarray, begin: np.ndarray, many: np.ndarray, lang: np.ndarray, old: np.ndarray, new: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many more phrases break from ``new`` states than from ``old`` ones, and the last states (``end`` from the old)."""
        more, end = np.zeros(len(begin), np.int64), end.copy()
        live, t = np.arange(len(begin)), 0
        while len(live):  # until both are in one state
            letter = letters[begin[live] + t]
            (old, miss), (new, other) = self.next(old, letter, lang), self.next(new, letter, lang)
            more[live] += other.astype(np.int64) - miss
            t += 1
            over = t >= many[live]
            end[live[over]] = new[over]
            go = ~over & (old != new)
            live, lang, old, new = live[go], lang[go], old[go], new[go]
        return more, end

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases (rows by languages) that the texts need."""
        phrases = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        letters, length = self.number[data], np.diff(offsets)
        pieces = -(-length // PIECE)
        row = np.repeat(np.arange(len(length)), pieces)
        place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][row] + place * PIECE
        many = np.minimum(PIECE, length[row] - place * PIECE)
        if not len(row):
            return phrases
        broken, end = self.walk(letters, begin, many)
        state = np.repeat(self.roots[None, :], len(row), axis=0)
        later = (place[1:] > 0)[:, None]
        while True:  # until each piece begins in the state in which the one before it ends
            piece, lang = np.nonzero(later & (state[1:] != end[:-1]))
            if not len(piece):
                break
            fresh, piece = end[piece, lang], piece + 1
            more, end[piece, lang] = self.rewalk(letters, begin[piece], many[piece], lang, state[piece, lang], fresh, end[piece, lang])
            broken[piece, lang] += more
            state[piece, lang] = fresh
        # a first letter that the language lacks is a phrase already counted
        broken += (place == 0)[:, None] & (self.start[letters[begin]] != 0)
        np.add.at(phrases, row, broken)
        return phrases

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, phrases per letter, and whether foreign, of texts made plain; ``und``, 0, 1 and true without letters."""
        length = np.diff(offsets)
        if not self.langs or not len(length):
            return pa.array(["und"] * len(length), pa.string()), np.zeros(len(length)), np.ones(len(length)), np.ones(len(length), bool)
        rate = self.parse(data, offsets) / np.maximum(length, 1)[:, None]
        best, low = rate.argmin(axis=1), rate.min(axis=1, keepdims=True)
        # fewer phrases by a tenth make a language e**4 times likelier; little text says less
        odds = np.exp(-(rate / np.maximum(low, 1e-9) - 1) * 40 * np.minimum(1.0, length[:, None] / 40))
        none = length == 0
        foreign = none | (length >= FOREIGN_LETTERS) & (low[:, 0] > self.foreign[best])
        langs = pa.array([*self.langs, "und"], pa.string()).take(pa.array(np.where(none, len(self.langs), best)))
        return langs, np.where(none, 0.0, 1 / np.maximum(odds.sum(axis=1), 1.0)), np.where(none, 1.0, low[:, 0]), foreign


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", ident: str = "doc_id", windows: int = WINDOWS, window_chars: int = WINDOW_CHARS) -> Model:
    """A model from labelled rows: per language one window of text from each of the ``windows`` rows of least hash.

    A window starts where a hash of the row says. The sample is bounded by ``windows * window_chars`` characters a
    language and about ``SAMPLE_CHARS`` in all: with many languages each gives fewer windows, one at least. More
    than ``LANGUAGES`` languages are an error. Rows without label or letter are left out; rows repeated with one id
    count once; a table without labels gives a model that knows no language.

    How many phrases a text of a language may need before it counts as foreign follows from its windows: half
    of them are parsed against the other half, and the other way round.
    """
    own = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    spare = F.greatest(F.length(text) - window_chars + 1, F.lit(1))
    begin = (F.pmod(F.xxhash64(ident, F.lit(1)), spare) + 1).cast("int")
    rows = own.select(F.col(lang).alias("lang"), F.xxhash64(ident, text).alias("h"), F.substring(F.col(text), begin, F.lit(window_chars)).alias("text"))
    # each row of the partial aggregate keeps at most `windows` windows
    best = cut(rows.groupBy("lang", F.pmod("h", F.lit(windows)).alias("slot")).agg(F.min_by("text", "h").alias("text")), "windows")
    count = best.select("lang").distinct().count()
    if count > LANGUAGES:
        raise ValueError(f"{count} languages are more than {LANGUAGES}: is '{lang}' a language column?")
    allowed = max(1, min(windows, SAMPLE_CHARS // (window_chars * max(count, 1))))
    first = best.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("slot"))).where(F.col("k") <= allowed)
    samples: dict[str, list[str]] = {}
    for row in first.select("lang", "slot", plain(F.col("text")).alias("text")).orderBy("lang", "slot").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return Model(samples, foreign_rates(samples))


def foreign_rates(samples: dict[str, list[str]]) -> dict[str, float]:
    """The phrases per letter from which a text is foreign, for languages with enough windows to tell."""
    halves = [{lang: texts[side::2] for lang, texts in samples.items() if len(texts) >= 8} for side in (0, 1)]
    most: dict[str, float] = {}
    for known, others in (halves, halves[::-1]):
        for lang in known:
            own = Model({lang: known[lang]})
            long = [t for t in others[lang] if len(t) >= FOREIGN_LETTERS]
            if long:
                _, _, rate, _ = own.predict(*packed(long))
                most[lang] = max(most.get(lang, 0.0), float(rate.max()) * FOREIGN)
    return most


FOUND = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rate": T.DoubleType(), "foreign": T.BooleanType()}


def found(model: Model, text: Column, spark: SparkSession) -> Column:
    """A struct of ``lang_pred string, score double, rate double, foreign boolean`` of a text; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)  # bounded by fit's sample

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lean(batches):
            parts = [shared.value.predict(data, offsets) for _, _, data, offsets in text_chunks(column)] or [shared.value.predict(*text_bytes(column))]
            columns = [pa.concat_arrays([p[0] for p in parts]), *[pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]]
            yield pa.StructArray.from_arrays(columns, list(FOUND))

    kind = T.StructType([T.StructField(name, kind) for name, kind in FOUND.items()])
    return F.arrow_udf(run, kind).asNondeterministic()(plain(text))  # so that no filter repeats it


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs``' columns with ``lang_pred, score, rate, foreign``.

    A null text and one without a letter is ``und``: score 0, rate 1 and foreign. Ties go to the first language by
    code point; repeated rows and null ids have a row each; an empty table gives no rows. ``rate`` is the number
    of phrases per letter, over whole texts of any length. Where ``docs`` has a column of one of these names, it
    stays as it is, and the model's is named with underscores after it.
    """
    names = free_names([*FOUND, "found"], docs.columns)
    out = docs.withColumn(names["found"], found(model, F.col(f"`{text}`"), docs.sparkSession))
    return out.withColumns({names[n]: F.col(names["found"]).getField(n) for n in FOUND}).drop(names["found"])


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rate")
