"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule ``w(t)`` over training time 0..1, piecewise linear between knots, and a demand:
the tokens that the mix takes from it over all its passes. The integral of the schedule says what share of the
demand is due by time t. A source's documents stand in an order drawn from a hash of their ids, pass after pass;
the inverse of the integral at a token's share of the demand is the token's time. All sources' demands due by
then, added up, are its position on the one token clock of the training run, as a share of the whole run.

Work at scale: running totals are taken at levels. Documents fall into hash ranges of about ``GROUP_ROWS`` rows,
ranges into blocks of ``GROUP_ROWS`` ranges; block totals are summed up by a window over a source's blocks, ranges
by one within a block, documents by one within their range. Sources are ranked within ranges of their names. No
window holds a source, or all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, cut

GROUP_ROWS = 1000
#: Documents' places in the hash order are whole numbers below this.
PLACES = 1 << 60
#: A source's rows are joined with its target in so many parts.
SALTS = 64
#: Knots (time, factor) of the schedules of weight classes 1, 2 and 3: the first class fades, the last grows.
SCHEDULES = {1: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 0.75), (0.5, 1.25), (1.0, 0.75)], 3: [(0.0, 0.5), (1.0, 1.5)]}


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(totals: DataFrame) -> DataFrame:
    """``totals`` with ``rank`` from 1: sources by code point, null last."""
    parts = cut(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(before, "part").withColumn("rank", (F.col("before") + inside).cast("int")).drop("part", "before")


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """``totals(source, source_size)`` with ``weight, target``: shares by weight, none above ``cap`` times its size.

    Sources rank by code point, null last, and weigh 1, 2, 3, repeating. All sources below their caps share one
    level of size for each weight. Where it exceeds a source's cap, the source is held there and the level rises;
    it is found by repeated sums until no more sources are held.
    """
    weight = ((F.col("rank") - 1) % 3 + 1).cast("int")
    ranked = cut(ranked_sources(totals).withColumn("weight", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size")).drop("rank"), "weights")
    sums = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, held = (sums["size"] or 0) / max(sums["weight"] or 0, 1), -1
    while True:
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        found = ranked.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("limit"))).alias("limit"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if found["n"] == held or not found["weight"]:
            break
        held, level = found["n"], (sums["size"] - (found["limit"] or 0.0)) / found["weight"]
    return ranked.withColumn("target", F.least(F.col("limit"), F.lit(level) * F.col("weight"))).drop("limit")


def _pieces(knots: list[tuple[float, float]]) -> Column:
    """Schedule pieces with the share of all tokens due before each, as an array of structs."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, rows = sum(area), 0.0, []
    for (t0, w0), (t1, w1), x in zip(knots, knots[1:], area, strict=False):
        rows.append(F.struct(F.lit(float(t0)).alias("t0"), F.lit(w0 / total).alias("w0"), F.lit((w1 - w0) / (t1 - t0) / total).alias("slope"), F.lit(done / total).alias("due")))
        done += x
    return F.array(*rows)


def due_time(share: Column, weight: Column, schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """The time at which ``share`` of a source's demand is due: the inverse of the integrated schedule."""
    pieces = F.lit(None)
    for w, knots in schedules.items():
        pieces = F.when(weight == w, _pieces(knots)).otherwise(pieces)
    piece = F.element_at(F.filter(pieces, lambda p: p["due"] <= share), -1)
    rest = share - piece["due"]
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), piece["t0"] + F.when(piece["w0"] + root > 0, 2 * rest / (piece["w0"] + root)).otherwise(0.0))


def due_share(time: Column, knots: list[tuple[float, float]]) -> Column:
    """The share of a source's demand that is due by ``time``: the integrated schedule."""
    piece = F.element_at(F.filter(_pieces(knots), lambda p: p["t0"] <= time), -1)
    rest = time - piece["t0"]
    return F.least(F.lit(1.0), piece["due"] + rest * (piece["w0"] + piece["slope"] * rest / 2))


def token_clock(time: Column, demand: dict[int, int], schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """All tokens due by ``time``, as a share of all; ``demand`` has the tokens of each weight's sources."""
    total = max(sum(demand.values()), 1)
    return sum((F.lit(demand.get(w, 0) / total) * due_share(time, knots) for w, knots in schedules.items()), F.lit(0.0))


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: float = 3.0, whole: bool = False, carry: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """A row for each document, and each weight's demand in tokens.

    A row holds ``doc_id, size, source, source_size, weight, target``, ``due`` (the source's demand), ``passes``
    (whole passes over the source), ``first`` (the words before the document's in a pass) and ``part`` (what the
    last pass takes of it); with ``carry`` also the document's own columns as the struct ``row``.
    """
    own = carried(docs).alias("row")
    rest = F.to_json(carried(docs, without=(text,)))
    tie = F.xxhash64(text, rest)  # rows that agree in this too are alike in all
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), text, F.lit("")).cast("binary"))
    at = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), sizes(docs, text).alias("size"), at.alias("at"), tie.alias("tie"), *([own] if carry else []))
    # words are counted once for all that follows, but for texts that are carried along: those aren't stored
    narrow = cut(base.select("doc_id", "source", "size", "at", "tie"), "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(totals, cap).withColumn("due", F.floor(F.col("target") + F.lit(0.5)).cast("long")).withColumn("ranges", F.ceil(F.col("n") / GROUP_ROWS)).drop("n")
    goal = cut(goal, "targets")
    demand = {r["weight"]: r["due"] for r in goal.groupBy("weight").agg(F.sum("due").alias("due")).collect()}  # three rows
    salted = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")

    def ranged(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("part", (F.col("at") % SALTS).cast("int"))
        out = rows.join(salted, (F.col("part") == F.col("salt")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "salt", "part")
        return out.withColumn("range", F.floor(F.col("at") / F.lit(float(PLACES)) * F.col("ranges")))

    masses = ranged(narrow).groupBy("source", "range").agg(F.sum("size").alias("mass")).withColumn("block", F.floor(F.col("range") / GROUP_ROWS))
    blocks = masses.groupBy("source", "block").agg(F.sum("mass").alias("all"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), (F.sum("all").over(Window.partitionBy("source").orderBy("block")) - F.col("all")).alias("before"))
    starts = masses.withColumn("upto", F.sum("mass").over(Window.partitionBy("source", "block").orderBy("range")))
    starts = starts.join(blocks, (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("before") + F.col("upto") - F.col("mass")).alias("start"))
    starts = cut(starts, "ranges")  # so that its size is known before documents are shuffled to meet it
    rows = ranged(base if carry else narrow)
    inside = Window.partitionBy("source", "range").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(starts, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "r")
    first = F.col("start") + F.col("upto") - F.col("size")
    passes = F.when(F.col("source_size") > 0, F.expr("due div source_size")).otherwise(0).cast("long")
    rows = rows.withColumn("first", first).withColumn("passes", passes)
    left = F.col("due") - F.col("passes") * F.col("source_size") - F.col("first")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    names = ["doc_id", "size", "source", "source_size", "weight", "target", "due", "passes", "first"]
    return rows.select(*names, part.alias("part"), *(["row"] if carry else [])), demand


def _took(run: Column) -> Column:
    """The words that pass ``run`` (from 0) takes of a document."""
    return F.when(run < F.col("passes"), F.col("size")).otherwise(F.col("part"))


def _runs() -> Column:
    """The passes that take words of a document, from 0: none of one without words."""
    many = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0)
    return F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<long>"))


def _position(run: Column, demand: dict[int, int], schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """Where the middle of what pass ``run`` (from 0) takes of a document stands on the token clock."""
    share = F.least(F.lit(1.0), (run * F.col("source_size") + F.col("first") + _took(run) / 2) / F.greatest(F.col("due"), F.lit(1)))
    return token_clock(due_time(share, F.col("weight"), schedules), demand, schedules)


def mix(docs: DataFrame, *, schedules=None, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, position``, range-sorted by position.

    Every pass over a document is put on the clock: ``taken`` adds up what they take, ``position`` is the first one's.
    Documents of which nothing is taken come last; ties stand by a hash of the id, then by id, size and source.

    A source takes whole passes over its documents and one part pass up to its target, in the order
    of ``md5(doc_id)`` (of the text where the id is null), rows of one id by a hash of all they hold. The document on the edge gives the words that are still due; with ``whole=True`` it
    is taken or left whole, by which is nearer. ``position`` is null where nothing is taken. Null texts have size 0 and are never taken; null sources form one source; null ids
    are documents of their own; repeated rows count once each; an empty table gives no rows. Other columns have
    no part in it.
    """
    rows, demand = plan(docs, **options)
    runs = F.transform(_runs(), lambda run: F.struct(_position(run, demand, schedules or SCHEDULES).alias("at"), _took(run).alias("took")))
    rows = rows.select("doc_id", "size", "source", "source_size", "target", runs.alias("runs"))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["took"])
    rows = rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.array_min("runs.at").alias("position"))
    rows = cut(rows, "mix")  # the range sort reads them twice
    order = [F.col("position").asc_nulls_last(), F.xxhash64("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "size", "source")


def curriculum(docs: DataFrame, *, whole: bool = True, schedules=None, position: str | None = None, **options) -> DataFrame:
    """The mix's documents with all their own columns, one row per pass, range-sorted by training position.

    Each row is a document of its own, whether its id is null or repeated; documents without words are never
    taken; an empty table gives no rows. ``position`` names a column to add for the position, which must be free.
    """
    rows, demand = plan(docs, whole=whole, carry=True, **options)
    rows = rows.withColumn("run", F.explode(_runs()))
    rows = rows.select("doc_id", "row", _position(F.col("run"), demand, schedules or SCHEDULES).alias("at"))
    rows = rows.repartitionByRange("at", F.xxhash64("doc_id")).sortWithinPartitions("at", "doc_id")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *([F.col("at").alias(position)] if position else []))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


#: Times are found by halving an interval until the integral of the schedule, by the trapezoid rule over both
#: halves of training, meets the share; the formula of its inverse isn't used.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM totals),
weighed AS (SELECT *, (rk - 1) % 3 + 1 AS weight, 3.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0.0))
    / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER w, 0)::DOUBLE) AS lev
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT *, least(cap, (max(lev) OVER ()) * weight) AS target FROM levels),
due AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS due FROM goal),
runs AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.weight, g.due,
    CASE WHEN g.source_size > 0 THEN g.due // g.source_size ELSE 0 END AS passes,
    CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY substr(b.k, 1, 15), b.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - b.size AS first
  FROM base b JOIN due g ON b.source IS NOT DISTINCT FROM g.source),
parts AS (SELECT *, greatest(0, least(size, due - passes * source_size - first)) AS part FROM runs),
shares AS (
  SELECT *, CAST(passes * size + part AS BIGINT) AS taken,
    least(1.0::DOUBLE, (first + CASE WHEN passes > 0 THEN size ELSE part END / 2.0::DOUBLE) / greatest(due, 1)) AS share
  FROM parts),
halving(doc_id, weight, share, n, lo, hi) AS (
  SELECT doc_id, weight, share, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM shares WHERE taken > 0
  UNION ALL
  SELECT doc_id, weight, share, n + 1,
    CASE WHEN half + rest < share THEN mid ELSE lo END, CASE WHEN half + rest < share THEN hi ELSE mid END
  FROM (
    SELECT *, (lo + hi) / 2 AS mid, least(mid, 0.5) AS a, greatest(mid, 0.5) AS b,
      a * (CASE weight WHEN 1 THEN 1.5 + (1.5 - a) WHEN 2 THEN 0.75 + (0.75 + a) ELSE 0.5 + (0.5 + a) END) / 2 AS half,
      (b - 0.5) * (CASE weight WHEN 1 THEN 1.0 + (1.5 - b) WHEN 2 THEN 1.25 + (1.75 - b) ELSE 1.0 + (0.5 + b) END) / 2 AS rest
    FROM halving WHERE n < 45)),
times AS (SELECT doc_id, (lo + hi) / 2 AS t FROM halving WHERE n = 45),
demand AS (
  SELECT sum(due)::DOUBLE AS d, coalesce(sum(due) FILTER (weight = 1), 0) / d AS d1, coalesce(sum(due) FILTER (weight = 2), 0) / d AS d2,
    coalesce(sum(due) FILTER (weight = 3), 0) / d AS d3
  FROM due)
SELECT s.doc_id, s.size, s.source_size, s.target, s.taken,
  round(d1 * (1.5 * t - t * t / 2)
    + d2 * (CASE WHEN t < 0.5 THEN 0.75 * t + t * t / 2 ELSE 0.5 + (t - 0.5) * (3.0 - t) / 2 END)
    + d3 * (0.5 * t + t * t / 2), 6) AS position
FROM shares s CROSS JOIN demand LEFT JOIN times USING (doc_id)
"""
