"""Hard negatives for anchors by inner product, searched in cover trees over norm-augmented vectors.

Candidates get one more component, so that all have the length of the longest: on that sphere the inner product with an
anchor depends on the angle alone. Candidates are dealt to cells by their nearest pivot, large cells to several shards,
and a task makes a shard's tree. Its levels are nested nets, the first 4, 16, 64, ... points of a farthest-first order;
a node knows its covering radius, the widest angle to any point below it, so that for an anchor all inner products below
it lie between two bounds. The shards themselves are nodes above the trees.

An anchor first takes the shard of the greatest bound, then those that can still hold something. Inside a shard it goes
down level by level, leaves out nodes that lie outside what it looks for, and visits the leaves best first, comparing
their points exactly in whole numbers; what it has found raises the floor for what is left. There are two descents: for
the positives, the best of an anchor's own label, and for the negatives, the best of other labels within each
positive's window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

#: Rows of a shard, about; the most cells (pivots are a sample of so many rows) and the most shards; anchors of a block.
SHARD_ROWS, MOST_CELLS, MOST_SHARDS, BLOCK = 16_384, 1024, 1 << 16, 1024
#: Points of each level of a tree.
LEVELS = (4, 16, 64, 256)
POSITIVES, NEGATIVES = 5, 5
SCALE, EVERY, RELABELLED, LABELS = 256, 100, 7, 10
#: A window's scores, in hundredths of the positive's score.
LOW, HIGH = 80, 100
#: Angles are widened by this much for rounding.
SLACK = 1e-6
TINY = np.iinfo(np.int64).min
LARGE = 1 << 62


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: rows that take part, components scaled to whole numbers, labels changed where the id says so."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", label.alias("label"), whole.alias("v"))


def exact_type(dim: int, most: int):
    """The fastest type in which inner products of such components are exact."""
    reach = dim * most * most
    if reach >= 1 << 63:
        raise ValueError("components are too large for inner products of 64 bits")
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column as rows; shorter ones are filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy() if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy()
    if (n == dim).all():
        return values.reshape(len(n), dim)
    out = np.zeros((len(n), dim), values.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def sphere(v: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with the component that gives them all the length ``radius``, as unit vectors."""
    v = v.astype(float)
    rest = np.sqrt(np.maximum(radius * radius - (v * v).sum(axis=1), 0))
    return np.c_[v, rest] / radius


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def tree(ids: np.ndarray, labels: np.ndarray, v: np.ndarray, radius: float) -> dict[str, np.ndarray]:
    """A cover tree of a shard as arrays: points in leaf order, and for each level its nodes' points, radii, parents and label ranges."""
    x = sphere(v, radius)
    n = len(x)
    centre = x.mean(axis=0)
    centre /= max(np.linalg.norm(centre), 1e-12)
    net = [int(np.argmax(x @ centre))]
    gap = np.arccos(np.clip(x @ x[net[0]], -1, 1))
    owner = np.zeros(n, np.int64)
    while len(net) < min(LEVELS[-1], n) and gap.max() > SLACK:
        far = int(np.argmax(gap))
        d = np.arccos(np.clip(x @ x[far], -1, 1))
        owner[d < gap] = len(net)
        gap = np.minimum(gap, d)
        net.append(far)
    order = np.lexsort([ids, owner])
    owner, ids, labels, v, x = owner[order], ids[order], labels[order], v[order], x[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    net = place[net]
    sizes = sorted({min(k, len(net)) for k in (1, *LEVELS)})
    out = {"ids": ids, "labels": labels, "v": v, "starts": np.r_[np.searchsorted(owner, np.arange(len(net))), n]}
    node = owner  # of each point, from the lowest level up
    for level in range(len(sizes) - 1, -1, -1):
        k = sizes[level]
        if k < len(net):
            parent = np.argmin(angles(x[net[: sizes[level + 1]]], x[net[:k]]), axis=1)
            out[f"parent{level + 1}"], node = parent, parent[node]
        wide = np.zeros(k)
        np.maximum.at(wide, node, np.arccos(np.clip((x * x[net[:k]][node]).sum(axis=1), -1, 1)))
        lo, hi = np.full(k, np.iinfo(np.int64).max), np.full(k, TINY)
        np.minimum.at(lo, node, labels)
        np.maximum.at(hi, node, labels)
        out |= {f"point{level}": x[net[:k]], f"wide{level}": wide, f"lo{level}": lo, f"hi{level}": hi}
    out["levels"] = np.array([len(sizes)])
    return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one Arrow record of binary columns with their shapes."""
    fields = {k: pa.array([np.ascontiguousarray(a).tobytes()], pa.large_binary()) for k, a in arrays.items()}
    shapes = {k: f"{a.dtype.str}|{','.join(map(str, a.shape))}" for k, a in arrays.items()}
    batch = pa.RecordBatch.from_arrays(list(fields.values()), schema=pa.schema([pa.field(k, pa.large_binary()) for k in fields], metadata=shapes))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    out = {}
    for i, field in enumerate(batch.schema):
        kind, shape = batch.schema.metadata[field.name.encode()].decode().split("|")
        out[field.name] = np.frombuffer(batch.column(i)[0].as_buffer(), np.dtype(kind)).reshape([int(k) for k in shape.split(",")])
    return out


def bounds(anchor: np.ndarray, length: np.ndarray, points: np.ndarray, wide: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner products of anchors (unit vectors and their lengths) with what nodes hold."""
    gap = angles(anchor, points)
    wide = wide[None, :] + SLACK
    reach = length[:, None] * radius
    most = np.cos(np.maximum(gap - wide, 0)) * reach
    least = np.cos(np.minimum(gap + wide, np.pi)) * reach
    slack = 1e-9 * reach + 1e-6
    return least - slack, most + slack


class Wanted:
    """What a block of anchors looks for: windows of scores (floor to ceiling) and the best ``keep`` rows of each.

    ``own`` tells whether rows of the anchor's label count, or those of others.
    """

    def __init__(self, label: np.ndarray, low: np.ndarray, high: np.ndarray, own: bool, keep: int):
        self.label, self.low, self.high, self.own, self.keep = label, low, high, own, keep

    def useful(self, least: np.ndarray, most: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Anchors by nodes: whether a node may hold a row that is wanted, by its bounds and its least and greatest label."""
        label = self.label[:, None]
        out = (lo <= label) & (label <= hi) if self.own else ~((lo == hi) & (lo == label))
        inside = np.zeros(out.shape, bool)
        for w in range(self.low.shape[1]):
            low, high = self.low[:, w, None], self.high[:, w, None]
            inside |= (low <= high) & (most >= low) & (least <= high)
        return out & inside


def best(score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 4 * keep:
        floor = np.partition(score, len(score) - keep)[len(score) - keep]
        some = score >= floor
        score, ids = score[some], ids[some]
    order = np.lexsort([ids, -score])[:keep]
    return score[order], ids[order]


def descend(shard: dict[str, np.ndarray], ids: np.ndarray, v: np.ndarray, wanted: Wanted, radius: float, kind) -> list[tuple[int, int, int, int]]:
    """``(anchor, window, score, row's id)``: the best rows of a shard for each window of each anchor."""
    length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    unit = np.c_[v / np.maximum(length, 1e-300)[:, None], np.zeros(len(v))]
    alive = np.ones((len(ids), 1), bool)
    for level in range(int(shard["levels"][0])):
        least, most = bounds(unit, length, shard[f"point{level}"], shard[f"wide{level}"], radius)
        above = alive[:, shard[f"parent{level}"]] if level else alive
        alive = above & wanted.useful(least, most, shard[f"lo{level}"], shard[f"hi{level}"])
    points, starts, out = shard["v"].astype(kind), shard["starts"], []
    queries = v.astype(kind)
    for i in np.flatnonzero(alive.any(axis=1)):
        leaves = np.flatnonzero(alive[i])
        leaves = leaves[np.argsort(-most[i, leaves], kind="stable")]
        low, high = wanted.low[i].copy(), wanted.high[i]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        at, step = 0, 8
        while at < len(leaves):  # best first, in growing strides
            some = leaves[at : at + step]
            at, step = at + step, 2 * step
            open_to = (low[:, None] <= high[:, None]) & (most[i, some] >= low[:, None]) & (least[i, some] <= high[:, None])
            if not open_to.any() and most[i, some[0]] < low[low <= high].min(initial=LARGE):
                break
            some = some[open_to.any(axis=0)]
            if not len(some):
                continue
            rows = np.concatenate([np.arange(starts[a], starts[a + 1]) for a in some])
            score = (points[rows] @ queries[i]).astype(np.int64)
            right = (shard["labels"][rows] == wanted.label[i]) == wanted.own
            if wanted.own:
                right &= shard["ids"][rows] != ids[i]
            score, rows = score[right], rows[right]
            for w in range(len(low)):
                fits = (score >= low[w]) & (score <= high[w])
                if fits.any():
                    s, r = np.concatenate([found[w][0], score[fits]]), np.concatenate([found[w][1], shard["ids"][rows[fits]]])
                    found[w] = best(s, r, wanted.keep)
                    if len(found[w][0]) == wanted.keep:
                        low[w] = found[w][0][-1]
        out += [(int(ids[i]), w, int(s), int(r)) for w, (scores, names) in enumerate(found) for s, r in zip(scores, names, strict=True)]
    return out


class Index:
    """Shards of candidates with their trees, written to the shared folder, and what anchors need to choose among them."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = self.rows = cut(rows, "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        most = F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), F.coalesce(-F.array_min("v"), F.lit(0)))
        about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm"), F.max(most).alias("most")).first()
        self.n, dim = about["n"], about["dim"] or 0
        self.dim, self.radius, self.kind = dim, float(np.sqrt(about["norm"] or 0)) * (1 + 1e-9) + 1.0, exact_type(dim, about["most"] or 0)
        size = max(SHARD_ROWS, -(-self.n // (MOST_SHARDS - MOST_CELLS)))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(min(MOST_CELLS, -(-self.n // size))).select("v").toArrow()
        pivots = spark.sparkContext.broadcast(np.unique(sphere(matrix(sample.column("v"), dim), self.radius), axis=0))  # MOST_CELLS at most
        radius, kind = self.radius, self.kind

        def cells(batches):
            for batch in lean(batches):
                x = sphere(matrix(batch.column(2), dim), radius)
                cell = np.argmax(x @ pivots.value.T, axis=1) if len(pivots.value) else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "label", "v", "cell"])

        dealt = cut(rows.select("vec_id", "label", "v").mapInArrow(cells, "vec_id long, label long, v array<long>, cell long"), "cells")
        parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))  # MOST_CELLS at most
        dealt = dealt.join(F.broadcast(parts), "cell").withColumn("shard", F.col("cell") * MOST_SHARDS + F.pmod(F.xxhash64("vec_id", "label", "v"), "parts"))

        def plant(key, table):
            made = tree(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v"), dim), radius)
            return pa.table({"shard": [key[0].as_py()], "tree": pa.array([to_bytes(made)], pa.binary()), "point": [made["point0"][0].tolist()], "wide": [float(made["wide0"][0])], "lo": [int(made["lo0"][0])], "hi": [int(made["hi0"][0])]})

        self.shards = cut(dealt.select("shard", "vec_id", "label", "v").groupBy("shard").applyInArrow(plant, "shard long, tree binary, point array<double>, wide double, lo long, hi long"), "shards")
        tops = self.shards.drop("tree").orderBy("shard").toArrow()  # MOST_SHARDS at most
        self.tops = {c: tops.column(c).to_numpy() for c in ("shard", "wide", "lo", "hi")} | {"point": matrix(tops.column("point"), dim + 1)}

    def search(self, anchors: DataFrame, own: bool, keep: int) -> DataFrame:
        """``anchor_id, w, score, vec_id``: the best rows within each window of ``anchors(vec_id, label, v, low, high)``.

        Anchors go to their most promising shard, then, with the floors that it gives, to all others that may hold more.
        """
        first = self.visit(anchors.withColumn("seen", F.lit(None).cast("long")), own, keep)
        first = cut(first, "found")
        count = F.count(F.lit(1))
        floors = first.groupBy("anchor_id", "w").agg(F.when(count >= keep, F.min("score")).alias("floor"))
        raised = floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "floor"))).alias("floors"))  # a window each
        home = first.select("anchor_id", "home").distinct()
        rest = anchors.join(raised, F.col("vec_id") == F.col("anchor_id"), "left").drop("anchor_id")
        low = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("floors", w), x)))
        rest = rest.withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(low)).join(home, F.col("vec_id") == F.col("anchor_id"), "left")
        rest = self.visit(rest.select("vec_id", "label", "v", "low", "high", F.coalesce("home", F.lit(-1)).alias("seen")), own, keep)
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
        return first.unionByName(rest).drop("home").withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)

    def visit(self, anchors: DataFrame, own: bool, keep: int) -> DataFrame:
        """Results of the best shard of each anchor (``seen`` is null) or of all others than ``seen`` that are useful."""
        tops, dim, radius, kind = anchors.sparkSession.sparkContext.broadcast(self.tops), self.dim, self.radius, self.kind

        def route(batches):
            for whole in batches:
                for begin in range(0, whole.num_rows, 256):
                    batch = whole.slice(begin, 256)
                    v, top = matrix(batch.column(2), dim).astype(float), tops.value
                    length = np.sqrt((v * v).sum(axis=1))
                    unit = np.c_[v / np.maximum(length, 1e-300)[:, None], np.zeros(len(v))]
                    least, most = bounds(unit, length, top["point"], top["wide"], radius)
                    wanted = Wanted(batch.column(1).to_numpy(), matrix_of(batch.column(3)), matrix_of(batch.column(4)), own, keep)
                    fit = wanted.useful(least, most, top["lo"], top["hi"])
                    if batch.column(5).null_count:
                        pick = np.argmax(np.where(fit, most, -np.inf), axis=1)
                        only = np.zeros(fit.shape, bool)
                        only[np.arange(len(pick)), pick] = True
                        fit &= only
                    else:
                        fit &= top["shard"][None, :] != batch.column(5).to_numpy()[:, None]
                    row, shard = np.nonzero(fit)
                    yield pa.RecordBatch.from_arrays([pa.array(top["shard"][shard]), *[batch.column(c).take(pa.array(row)) for c in range(5)]], ["shard", "anchor_id", "label", "v", "low", "high"])

        columns = "shard long, anchor_id long, label long, v array<long>, low array<long>, high array<long>"
        routed = cut(anchors.select("vec_id", "label", "v", "low", "high", "seen").mapInArrow(route, columns), "routed")
        blocks = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        blocks = cut(blocks, "blocks")
        routed = routed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("anchor_id"), "blocks"))
        trees = self.shards.select("shard", "tree").join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

        def search(key, left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "w", "score", "vec_id", "home")})
            shard = from_bytes(left.column("tree")[0].as_py())
            right = right.combine_chunks()
            wanted = Wanted(right.column("label").to_numpy(), matrix_of(right.column("low")), matrix_of(right.column("high")), own, keep)
            found = descend(shard, right.column("anchor_id").to_numpy(), matrix(right.column("v"), dim), wanted, radius, kind)
            a, w, s, r = zip(*found, strict=True) if found else ([], [], [], [])
            return pa.table({"anchor_id": pa.array(a, pa.int64()), "w": pa.array(w, pa.int64()), "score": pa.array(s, pa.int64()), "vec_id": pa.array(r, pa.int64()), "home": pa.array([key[0].as_py()] * len(a), pa.int64())})

        keys = ["shard", "block"]
        return trees.select(*keys, "tree").groupBy(*keys).cogroup(routed.drop("blocks").groupBy(*keys)).applyInArrow(search, "anchor_id long, w long, score long, vec_id long, home long")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` and ``positive_rank``.

    ``embeddings`` has ``vec_id, label, embedding``; other columns have no part in it. Rows with a null id or label and
    vectors that are null or hold null, NaN or infinity take no part; a shorter vector is filled with zeros, an empty one
    is zero. Ties go by id. Rows repeated with one id are candidates as often as they stand; as an anchor an id counts
    once, with its least label and vector, and rows of its own id are no positives. Components whose inner products
    could exceed 64 bits are an error. An empty table gives no rows.
    """
    index = Index(prepared(embeddings))
    anchors = index.rows.where(F.col("vec_id") % EVERY == 0)
    anchors = cut(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "anchors")
    any_score = anchors.withColumns({"low": F.array(F.lit(-LARGE)), "high": F.array(F.lit(LARGE))})
    positives = cut(index.search(any_score, True, POSITIVES).select("anchor_id", F.col("k").cast("int").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 80 p <= 100 n <= 100 p; a window that cannot hold a score is empty, and those of missing positives too
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * LOW / HIGH).cast("long")
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_rank", low.alias("low"), F.col("positive_score").alias("high")))).alias("w"))  # POSITIVES at most
    rows = anchors.join(windows, F.col("vec_id") == F.col("anchor_id"))

    def padded(name: str, fill: int):
        return F.concat(F.col(f"w.{name}"), F.array_repeat(F.lit(fill).cast("long"), F.lit(POSITIVES) - F.size("w"))).alias(name)

    found = index.search(rows.select("vec_id", "label", "v", padded("low", 1), padded("high", 0)), False, NEGATIVES)
    found = found.select("anchor_id", (F.col("w") + 1).cast("int").alias("positive_rank"), F.col("k").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(found, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def op11(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("positive_rank")


SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM scored WHERE same) WHERE k <= 5),
found AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5"""
