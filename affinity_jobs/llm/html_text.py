"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive; a tag scores negative by how much commoner it is
outside the article than inside, counted on a bounded sample of labelled pages: those that mark their article with
an ``article`` or ``main`` element. One linear scan finds the region of the greatest sum.

Elements have costs too: by their names and the words of their class, id and role, from priors that labelled pages
move up or down. Words in elements that cost as much as a word is worth score nothing and are left out, and such an
element lowers the sum a little as a whole, so that a menu or an advert in an article doesn't cut it in two. An
element that holds most of the page's words, and its heading or article if it has any, is what the page is about: it
costs nothing, whatever its name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_names, lean, text_bytes

#: Bounds of the training sample: pages, and the length up to which a page is taken, whole.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000
#: Costs of a tag: least, greatest, and of one never seen in training.
LEAST, MOST, UNSEEN = 0.02, 6.0, 0.3
#: What an element that is left out costs as a whole, and bytes of markup taken to Python strings at once.
AWAY, BATCH_BYTES = 1.0, 1 << 20
#: Prior costs a word: by element name or a whole class; by the first or last word of a longer class of a container; of other elements.
NAMED, COMPOUND, INLINE = 4.0, 2.5, 0.5
#: Labelled pages move a class's cost within these; so many words stand for no evidence.
DOWN, UP, DOUBT = -2.0, 4.0, 5.0

# Elements whose content is never shown as text, other element names, and words of class, id and role.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button")
BESIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"aside", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "menu", "nav", "ol", "section", "table", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "pagination", "popup", "promo", "related", "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
HEADS = {"article", "main", "h1"}
NEGATIONS = {"has", "hide", "no", "not", "with", "without"}

#: A quote has meaning after an equals sign only; elsewhere it is part of a name.
REST = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<svg(?=[\s/>])(?>{REST})(?<=/)>"  # closed by itself: nothing is inside
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){REST}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>{REST})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Token(NamedTuple):
    """A text (``tag`` is empty) or a tag; ``classes`` are those of a start tag."""

    tag: str
    text: str = ""
    end: bool = False
    classes: tuple[str, ...] = ()


class Costs(NamedTuple):
    """What labelled pages say: costs of tags, and by how much classes' costs move."""

    tags: dict[str, float] = {}
    classes: dict[str, float] = {}


def tokens(page: str) -> list[Token]:
    """Texts and tags in page order, character references decoded; raw elements and comments vanish."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(Token("", html.unescape(page[at : m.start()])))
        at = m.end()
        if m["name"]:
            classes = {c for found in ATTRIBUTE.finditer(m["rest"]) for c in "".join(x or "" for x in found.groups()).split()} if m["rest"] and not m["end"] else ()
            out.append(Token(m["name"].lower(), "", bool(m["end"]), tuple(sorted(classes))))
    if at < len(page):
        out.append(Token("", html.unescape(page[at:])))
    return out


def ends(found: list[Token]) -> list[int]:
    """The last token of each start tag's element, in one pass with a stack; of other tokens themselves.

    Without an end tag of its own an element reaches to the end of the one around it, or, if it is beside the text
    by its name or class, to the next start tag of a block.
    """
    out, stack, open_, last = list(range(len(found))), [], Counter(), len(found) - 1
    block = [last] * (len(found) + 1)  # the place before the next start tag of a block
    for i in range(last, -1, -1):
        block[i] = i - 1 if found[i].tag in BLOCKS and not found[i].end else block[i + 1]

    def close(i: int, at: int) -> None:
        out[i] = max(i, min(at, block[i + 1])) if prior(found[i]) > 0 else at
        open_[found[i].tag] -= 1

    for i, token in enumerate(found):
        if not token.tag or token.tag in VOID:
            continue
        if not token.end:
            stack.append(i)
            open_[token.tag] += 1
        elif open_[token.tag]:
            while found[stack[-1]].tag != token.tag:
                close(stack.pop(), i)
            out[stack[-1]] = i
            open_[found[stack.pop()].tag] -= 1
    while stack:
        close(stack.pop(), last)
    return out


def class_prior(tag: str, name: str) -> float:
    """What a class, id or role costs before any page is seen."""
    parts = [w.lower() for w in SPLIT.split(name) if w]
    if not parts or parts[0] in NEGATIONS or not {parts[0], parts[-1]} & MARKS:
        return 0.0
    if len(parts) == 1:
        return NAMED
    return COMPOUND if tag in CONTAINERS else INLINE


def prior(token: Token) -> float:
    if token.tag in ("html", "body", "article", "main"):
        return 0.0
    return max([NAMED * (token.tag in BESIDE), *[class_prior(token.tag, c) for c in token.classes]])


def element_cost(token: Token, costs: Costs) -> float:
    """A word's cost in an element: the most that its name or one of its classes makes."""
    if token.tag in ("html", "body", "article", "main"):
        return 0.0
    return max([NAMED * (token.tag in BESIDE), *[class_prior(token.tag, c) + costs.classes.get(c, 0.0) for c in token.classes]])


def words(found: list[Token]) -> list[int]:
    return [0 if t.tag else len(t.text.split()) for t in found]


def left_out(found: list[Token], reach: list[int], count: list[int], costs: Costs) -> list[int]:
    """For each token the number of elements around it (itself included) that are left out."""
    edge, total = [0] * (len(found) + 1), [0, *accumulate(count)]
    heads = [0, *accumulate(t.tag in HEADS and not t.end for t in found)]

    def about(i: int) -> bool:
        if 2 * (total[reach[i] + 1] - total[i]) <= total[-1]:
            return False
        return heads[reach[i] + 1] > heads[i] if heads[-1] else found[i].tag not in BESIDE

    for i, token in enumerate(found):
        if token.tag and not token.end and token.tag not in VOID and element_cost(token, costs) >= 1.0 and not about(i):
            edge[i] += 1
            edge[reach[i] + 1] -= 1
    return list(accumulate(edge))[:-1]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the greatest sum, by one scan; empty if nothing is positive, the first one on ties."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def scored(found: list[Token], hidden: list[int], count: list[int], costs: Costs) -> list[float]:
    """Each token's score: words in sight count, tags and the beginnings of hidden elements cost."""
    out = []
    for i, token in enumerate(found):
        if hidden[i]:
            out.append(-AWAY if hidden[i] > (hidden[i - 1] if i else 0) == 0 else 0.0)
        else:
            out.append(-costs.tags.get("/" * token.end + token.tag, UNSEEN) if token.tag else float(count[i]))
    return out


def learn(pages: list[str]) -> Costs:
    """Costs from pages that mark their article: log-odds of standing outside it, of tags and of words in classes."""
    inside, outside, near, far = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        found = tokens(page)
        spans = [i for i, t in enumerate(found) if t.tag in ("article", "main")]
        if len(spans) < 2:
            continue
        reach, count = ends(found), words(found)
        hidden = left_out(found, reach, count, Costs())
        among = [spans[0] < i < spans[-1] and not hidden[i] for i in range(len(found))]
        sums = [0, *accumulate(n * a for n, a in zip(count, among, strict=True))], [0, *accumulate(count)]
        for i, token in enumerate(found):
            if token.tag and not hidden[i]:  # tags of elements that are left out have no part in the sum
                (inside if among[i] else outside)["/" * token.end + token.tag] += 1
            for c in token.classes:
                within = sums[0][reach[i] + 1] - sums[0][i]
                near[c] += within
                far[c] += sums[1][reach[i] + 1] - sums[1][i] - within
    tags = {tag: min(MOST, max(LEAST, math.log((outside[tag] + 0.5) / (inside[tag] + 0.5)))) for tag in inside.keys() | outside.keys()}
    classes = {c: min(UP, max(DOWN, math.log((far[c] + DOUBT) / (near[c] + DOUBT)))) for c in near.keys() | far.keys()}
    return Costs(tags, classes)


def extract(page: str | None, costs: Costs = Costs()) -> str:
    """Blocks of the best region, one a line; empty without any words."""
    if not page:
        return ""
    found = tokens(page)
    reach, count = ends(found), words(found)
    hidden = left_out(found, reach, count, costs)
    start, end = best_region(scored(found, hidden, count, costs))
    blocks, run = [], []
    for i in range(start, end):
        token = found[i]
        if token.tag in BLOCKS:
            blocks.append("".join(run))
            run = []
        elif token.tag == "br":
            run.append(" ")
        elif not token.tag and not hidden[i]:
            run.append(token.text)
    blocks.append("".join(run))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def fit(pages: DataFrame, *, ident: str = "page_id", markup: str = "html") -> Costs:
    """Costs from a bounded sample of whole labelled pages, those of least id hash among pages of ``SAMPLE_CHARS`` at most.

    Without labelled pages all costs are the priors.
    """
    marked = pages.where(F.col(f"`{markup}`").rlike(r"(?i)<(article|main)[\s>]") & (F.length(f"`{markup}`") <= SAMPLE_CHARS))
    rows = marked.select(F.xxhash64(ident).alias("h"), F.col(f"`{markup}`").alias("page"))
    sample = rows.groupBy(F.pmod("h", F.lit(SAMPLE_PAGES)).alias("slot")).agg(F.min_by("page", "h").alias("page"))
    return learn([r["page"] for r in sample.orderBy("slot").collect()])


def text_of(costs: Costs, markup: Column) -> Column:
    """The main text of a page; only the markup goes to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lean(batches):
            _, at = text_bytes(column)
            parts = [pa.array([extract(p, costs) for p in column.slice(a, b - a).to_pylist()], pa.string()) for a, b in chunks(at, BATCH_BYTES)]
            yield pa.concat_arrays([*parts, pa.array([], pa.string())])

    return F.arrow_udf(run, "string").asNondeterministic()(markup)


def main_text(pages: DataFrame, costs: Costs, *, markup: str = "html") -> DataFrame:
    """``pages``' columns but ``markup``, with ``text`` and ``n_chars`` (its code points), of every whole page.

    Null and empty pages, and pages without words, have an empty text. Repeated rows and null ids have a row each;
    an empty table gives no rows. Of regions with equal sums the first is taken. Where ``pages`` has a column of one
    of the new names, it stays, and the new one is named with underscores after it.
    """
    rest = [c for c in pages.columns if c != markup]
    names = free_names(["text", "n_chars"], rest)
    out = pages.select(*[F.col(f"`{c}`") for c in rest], text_of(costs, F.col(f"`{markup}`")).alias(names["text"]))
    return out.withColumn(names["n_chars"], F.length(names["text"]).cast("long"))


def op4(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, fit(pages))
