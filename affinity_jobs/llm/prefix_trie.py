"""Prefix trie of conversations that are rebuilt from another one's head and their own tail.

A sequence of turns has a fingerprint: the sum of its turns' hashes, each times a base to the power of the turn's place,
modulo four primes. Fingerprints form a monoid (length, sum): a sequence put after another one is multiplied by the
base to the power of the other's length and added. So all prefixes of a conversation are running sums, pieces of a long
conversation are summed apart and joined, and a rebuilt conversation's prefixes follow from its base's head and its own
running sums with a few products; its texts are never put together.

Equal fingerprints of one depth are a node. That they are equal sequences is verified: a turn's hash must stand for
one role and text only among all stored turns, and a node's members must agree in their parent node and last turn.
Should a check fail, all is hashed anew with the next seed.

Sums over subtrees need no walk. A node belongs to its smallest member; a conversation owns the nodes from some depth
on to its end. A node's subtree is what its smallest member owns from its depth on, and all that its other members own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, cut, mix64

#: The four largest primes below 2**31: products of residues fit 63 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LOW = (1 << 31) - 1
#: Places of one window of running sums; bytes of a piece of joined ids.
BLOCK, PIECE_BYTES = 8192, 1 << 20
SEEDS = 8
#: The longest head that is taken from a base.
HEAD = 5
EMPTY_SHA = hashlib.sha256().hexdigest()


def bases(seed: int) -> list[int]:
    return [int(x) % (p - 2) + 2 for x, p in zip(mix64(np.arange(4, dtype=U) + U(4 * seed + 1)), PRIMES, strict=True)]


def turn_hashes(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn."""
    return F.xxhash64(F.lit(2 * seed), role, text), F.xxhash64(F.lit(2 * seed + 1), role, text)


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    """``base**i % prime`` for i < n."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Sorted rows ``conv_id, h1, h2, n`` with their place within the partition's part of a conversation and running sums.

    ``pid`` is the partition, ``k`` the place from 1, ``fa, fb`` the four residues with the turn and ``pa, pb`` without it.
    """
    base = bases(seed)
    names = ["conv_id", "pid", "k", "h1", "h2", "n", "fa", "fb", "pa", "pb"]

    def run(batches):
        pid, conv, place, sums = TaskContext.get().partitionId(), None, 0, [0, 0, 0, 0]
        for batch in batches:
            ids, h1, h2 = (batch.column(c).to_numpy() for c in (0, 1, 2))
            if not len(ids):
                continue
            first = np.r_[True, ids[1:] != ids[:-1]]
            start = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            k = np.arange(len(ids)) - start[group] + 1
            on = group == 0 if conv == ids[0] else np.zeros(len(ids), bool)  # rows that go on from the batch before
            with_turn, before = [], []
            for j, (b, p) in enumerate(zip(base, PRIMES, strict=True)):
                h = (h1, h1 >> 31, h2, h2 >> 31)[j] & LOW
                added = (h + 1) % p * power_table(b, p, len(ids) + 1)[k] % p
                added[on] = added[on] * pow(b, place, p) % p
                upto = np.cumsum(added)  # below 2**31 terms of 31 bits
                s = (upto - (upto - added)[start][group]) % p
                s[on] = (s[on] + sums[j]) % p
                with_turn.append(s)
                before.append((s - added) % p)
            k[on] += place
            conv, place, sums = int(ids[-1]), int(k[-1]), [int(s[-1]) for s in with_turn]
            packed = [x[i] << 31 | x[i + 1] for x in (with_turn, before) for i in (0, 2)]
            arrays = [batch.column(0), pa.array(np.full(len(ids), pid, np.int32)), pa.array(k), batch.column(1), batch.column(2), batch.column(3), *map(pa.array, packed)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, "conv_id long, pid int, k long, h1 long, h2 long, n long, fa long, fb long, pa long, pb long")


def joined(turns: DataFrame, seed: int) -> DataFrame:
    """Places and sums of conversations that several partitions share, as of whole conversations.

    At most two conversations of a partition go on elsewhere, so what is brought together is bounded by the partitions.
    """
    spark, base = turns.sparkSession, bases(seed)
    torn = turns.groupBy("conv_id").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("lo < hi").select("conv_id")
    last = F.max_by(F.struct("k", "fa", "fb"), "k")
    parts = turns.join(F.broadcast(torn), "conv_id").groupBy("conv_id", "pid").agg(last.alias("s")).select("conv_id", "pid", "s.*").orderBy("conv_id", "pid").collect()
    moved, conv = [], None
    for r in parts:
        if r.conv_id != conv:
            conv, place, sums = r.conv_id, 0, [0, 0, 0, 0]
        times = [pow(b, place, p) for b, p in zip(base, PRIMES, strict=True)]
        moved.append((r.conv_id, r.pid, place, times, list(sums)))
        own = [r.fa >> 31, r.fa & LOW, r.fb >> 31, r.fb & LOW]
        sums = [(s + t * o) % p for s, t, o, p in zip(sums, times, own, PRIMES, strict=True)]
        place += r.k
    if not moved:
        return turns
    shift = spark.createDataFrame(moved, "conv_id long, pid int, _place long, _times array<long>, _sums array<long>")
    out = turns.join(F.broadcast(shift), ["conv_id", "pid"], "left")

    def whole(a: str, first: int) -> Column:
        high, low = ((F.col("_sums")[first + i] + F.col("_times")[first + i] * half) % PRIMES[first + i] for i, half in enumerate(unpacked(F.col(a))))
        return F.when(F.col("_place").isNull(), F.col(a)).otherwise(packed(high, low)).alias(a)

    return out.select("conv_id", (F.col("k") + F.coalesce("_place", F.lit(0))).alias("k"), "h1", "h2", "n", whole("fa", 0), whole("fb", 2), whole("pa", 0), whole("pb", 2))


def unpacked(c: Column) -> tuple[Column, Column]:
    return F.shiftright(c, 31), c.bitwiseAND(F.lit(LOW))


def packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 31).bitwiseOR(low)


def composed(head: Column, run: Column, skipped: Column, moved: Column, seed: int, half: int) -> Column:
    """Sums of a head followed by a run's turns after ``skipped``, which stand ``moved`` places earlier than in the run."""
    out = []
    for i, (h, r, s) in enumerate(zip(unpacked(head), unpacked(run), unpacked(skipped), strict=True)):
        p, b = PRIMES[half + i], bases(seed)[half + i]
        back = F.array(*[F.lit(pow(pow(b, -1, p), z, p)) for z in range(HEAD + 1)])
        out.append((h + (r - s + p) % p * F.element_at(back, moved + 1)) % p)
    return packed(*out)


def stored_turns(rows: DataFrame, seed: int) -> DataFrame:
    """``conv_id, k, h1, h2, n, fa, fb, pa, pb`` of each turn: place, hashes, code points, sums with it and without it.

    Rows are sorted over all partitions, so that a long conversation is dealt to several tasks.
    """
    h1, h2 = turn_hashes(F.col("role"), F.col("text"), seed)
    turn = F.col("turn").asc_nulls_first()
    ordered = rows.repartitionByRange("conv_id", turn, F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", turn, "role", "text")
    return joined(cut(numbered(ordered.select("conv_id", h1.alias("h1"), h2.alias("h2"), F.length("text").cast("long").alias("n")), seed), "turns"), seed)


def ambiguous(rows: DataFrame, seed: int) -> bool:
    """Whether two different turns have the same hashes."""
    h1, h2 = turn_hashes(F.col("role"), F.col("text"), seed)
    return not rows.select(h1.alias("h1"), h2.alias("h2"), "role", "text").distinct().groupBy("h1", "h2").count().where("count > 1").isEmpty()


def member_rows(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], seed: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes of all rebuilt conversations, and ``conv_id, base, h, hb, length`` of each."""
    early = F.when(F.col("k") <= HEAD, F.struct("k", "h1", "h2", "n", "fa", "fb", "pa", "pb"))
    convs = cut(turns.groupBy("conv_id").agg(F.max("k").alias("turns"), F.sort_array(F.collect_list(early)).alias("early")), "conversations")  # HEAD entries at most
    heads = convs.select(F.col("conv_id").alias("base"), F.col("early").alias("_head"))
    rows = convs.withColumns({"base": base(F.col("conv_id")), "h": head(F.col("conv_id")).cast("int")}).join(heads, "base", "left")
    rows = rows.withColumn("_head", F.when(F.col("_head").isNull(), F.slice("early", 1, 0)).otherwise(F.expr("slice(_head, 1, h)"))).withColumn("hb", F.size("_head"))
    rows = rows.withColumn("length", F.col("hb") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))

    def sums(entries: str, at: str, name: str) -> Column:
        return F.when((F.col(at) > 0) & (F.size(entries) >= F.col(at)), F.expr(f"try_element_at({entries}, {at}).{name}")).otherwise(F.lit(0)).cast("long")

    known = {"ha": sums("_head", "hb", "fa"), "hc": sums("_head", "hb", "fb"), "oa": sums("early", "h", "fa"), "oc": sums("early", "h", "fb")}
    info = cut(rows.select("conv_id", "base", "h", "hb", "length", "turns", F.col("_head").alias("head"), *[c.alias(n) for n, c in known.items()]), "heads")
    zero = [F.lit(0).cast("long").alias(c) for c in ("fa", "fb", "pa", "pb", "h1", "h2", "n")]
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), *zero, (F.col("length") == 0).alias("last"))
    shared = info.select("conv_id", "length", F.explode("head").alias("e"))
    shared = shared.select("conv_id", F.col("e.k").alias("depth"), *[F.col(f"e.{c}").alias(c) for c in ("fa", "fb", "pa", "pb", "h1", "h2", "n")], (F.col("e.k") == F.col("length")).alias("last"))
    tail = info.where("turns > h").select("conv_id", "h", "hb", "length", "ha", "hc", "oa", "oc")
    own = turns.join(tail, "conv_id").where("k > h")
    moved, depth = F.col("h") - F.col("hb"), F.col("hb") + F.col("k") - F.col("h")
    made = [composed(F.col(x), F.col(c), F.col(o), moved, seed, half).alias(c) for c, x, o, half in (("fa", "ha", "oa", 0), ("fb", "hc", "oc", 2), ("pa", "ha", "oa", 0), ("pb", "hc", "oc", 2))]
    own = own.select("conv_id", depth.alias("depth"), *made, "h1", "h2", "n", (depth == F.col("length")).alias("last"))
    return root.unionByName(shared).unionByName(own), info.select("conv_id", "base", "h", "hb", "length")


NODE = ["depth", "fa", "fb"]


def grouped(members: DataFrame) -> DataFrame:
    """Nodes with their smallest member, number of members, parent and last turn; ``sound`` tells if all members agree in these."""
    same = ["pa", "pb", "h1", "h2", "n"]
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in same for f in (F.min, F.max)]
    found = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *ends)
    sound = F.lit(True)
    for c in same:
        sound = sound & (F.col(f"{c}_min") == F.col(f"{c}_max"))
    return found.select(*NODE, "conv_id", "n_convs", *[F.col(f"{c}_min").alias(c) for c in same], sound.alias("sound"))


def digests_of_ends(members: DataFrame) -> DataFrame:
    """SHA-256 of each node's conversations that end there: their ids, ascending, joined by commas.

    Ids are joined to pieces by sorted ranges; only a node's digest itself, which must read them in order, is one task.
    """
    ends = members.where("last").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def pieces(batches):
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            ids = batch.column(3).to_pylist()
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(ids) else np.zeros(0, np.int64)
            cuts = np.unique(np.r_[start, np.arange(0, len(ids), PIECE_BYTES // 21)]).astype(np.int64)  # an id and its comma take 21 bytes at most
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(key[cuts, c]) for c in range(3)], pa.array([ids[a] for a in cuts], pa.int64()), pa.array(texts, pa.string())], [*NODE, "first", "piece"])

    parts = ends.mapInArrow(pieces, "depth long, fa long, fb long, first long, piece string").repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def digests(batches):
        node, digest, out = None, None, []
        for batch in batches:
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if key != node:
                    out += [(*node, digest.hexdigest())] if node else []
                    node, digest = key, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if len(out) > 10_000:
                yield from rows(out)
                out = []
        yield from rows(out + ([(*node, digest.hexdigest())] if node else []))

    def rows(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], [*NODE, "ends_sha256"])

    return parts.mapInArrow(digests, "depth long, fa long, fb long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, members: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """``conv_id, depth`` and, for each amount of a node, its sum over the node's subtree."""
    own = nodes.select(*NODE, "conv_id", F.floor(F.col("depth") / BLOCK).alias("_block"), *[c.alias(a) for a, c in amounts.items()])
    later = Window.partitionBy("conv_id", "_block").orderBy(F.desc("depth"))
    blocks = own.groupBy("conv_id", "_block").agg(*[F.sum(a).alias(a) for a in amounts])
    after = Window.partitionBy("conv_id").orderBy(F.desc("_block"))  # a block's sum for each BLOCK nodes
    blocks = blocks.select("conv_id", "_block", *[(F.sum(a).over(after) - F.col(a)).alias(f"_after_{a}") for a in amounts], *[F.sum(a).over(Window.partitionBy("conv_id")).alias(f"_all_{a}") for a in amounts])
    owned = own.select(*NODE, "conv_id", "_block", *[F.sum(a).over(later).alias(a) for a in amounts]).join(blocks, ["conv_id", "_block"])
    owned = owned.select(*NODE, "conv_id", *[(F.col(a) + F.col(f"_after_{a}") - F.col(f"_all_{a}")).alias(a) for a in amounts])
    total = own.groupBy("conv_id").agg(*[F.sum(a).alias(f"_{a}") for a in amounts]).where(" OR ".join(f"_{a} <> 0" for a in amounts))
    each = members.select("conv_id", *NODE).join(total, "conv_id").groupBy(*NODE).agg(*[F.sum(f"_{a}").alias(f"_{a}") for a in amounts])
    out = owned.join(each, NODE, "left")
    return out.select("conv_id", "depth", *[(F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a) for a in amounts])


def hundred(conv: Column) -> Column:
    return conv - conv % 100


def crc_head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def prefix_trie(conversations: DataFrame, *, base: Callable[[Column], Column] = hundred, head: Callable[[Column], Column] = crc_head) -> DataFrame:
    """The trie's nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` has ``conv_id, turn, role, text``; other columns have no part in it. ``base`` tells whose head a
    conversation gets and ``head`` how many turns (``HEAD`` at most) it gets in place of as many of its own. ``ref_conv``
    and ``ref_turn`` (place from 1) tell where the last turn of a node is stored; null for the root. Turns go by ``turn``,
    null first; equal ones by role, then text, and repeated rows are turns of their own. Null roles and texts are
    empty ones. A null ``conv_id`` is no conversation: such rows are left out. An empty table has no node.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    for seed in range(SEEDS):
        if ambiguous(rows, seed):
            continue
        members, info = member_rows(stored_turns(rows, seed), base, head, seed)
        members = cut(members, "members")
        nodes = cut(grouped(members), "nodes")
        if nodes.where("NOT sound").isEmpty():
            break
    else:
        raise ValueError(f"no seed of {SEEDS} tells all turns and prefixes apart")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents.where("depth > 1"), ["depth", "pa", "pb"], "left")
    sums = subtree_sums(nodes, members, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n")})
    out = out.join(sums, ["conv_id", "depth"]).join(digests_of_ends(members), NODE, "left").join(info, "conv_id")
    least = info.agg(F.min("conv_id").alias("_least"))  # one row: the root's smallest member
    out = out.join(F.broadcast(least))
    parent = F.when(F.col("depth") > 1, F.col("parent_conv_id")).when(F.col("depth") == 1, F.col("_least"))
    shared = F.col("depth") <= F.col("hb")
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        F.when(F.col("depth") > 0, F.when(shared, F.col("base")).otherwise(F.col("conv_id"))).alias("ref_conv"),
        F.when(F.col("depth") > 0, F.when(shared, F.col("depth")).otherwise(F.col("depth") - F.col("hb") + F.col("h"))).alias("ref_turn"))


def op12(spark, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of an id's text, bit by bit; a prefix is the list of its turns.
SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS name FROM turns),
sums AS (
  SELECT c, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS crc
  FROM ids),
convs AS (SELECT c, c - c % 100 AS b, crc % 6 AS h FROM sums),
rebuilt AS (
  SELECT convs.c, 0 AS part, k, r, x FROM convs JOIN turns ON turns.c = convs.b AND k <= h
  UNION ALL SELECT convs.c, 1, k, r, x FROM convs JOIN turns ON turns.c = convs.c AND k > h),
lists AS (SELECT c, list({'r': r, 'x': x} ORDER BY part, k) AS s FROM rebuilt GROUP BY c),
seqs AS (SELECT convs.c, coalesce(s, []) AS s, coalesce(len(s), 0) AS n FROM convs LEFT JOIN lists ON convs.c = lists.c),
members AS (SELECT c, s, n, unnest(range(0, n + 1)) AS d FROM seqs),
prefixes AS (SELECT c, d, n, list_slice(s, 1, d) AS p, list_slice(s, 1, d - 1) AS q, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars FROM members),
nodes AS (
  SELECT d, p, any_value(q) AS q, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, q, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children, up.c AS parent
  FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.q = nodes.p LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.p = nodes.q AND nodes.d > 0),
below AS (SELECT saved, n_children, p, unnest(range(0, d + 1)) AS u FROM full_nodes),
subtrees AS (SELECT u AS d, list_slice(p, 1, u) AS p, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM below GROUP BY 1, 2)
SELECT n.c AS conv_id, n.d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM full_nodes n JOIN subtrees s ON n.d = s.d AND n.p = s.p"""
