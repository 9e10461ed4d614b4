"""Explaining predictions by connected subgraphs: enumerate, combine, score, and keep the minimal sufficient ones."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subgraphs, udfs
from .io import cut, large
from .vectors import group_codes

EPSILON, MAX_SUBGRAPH, MAX_COMBINATION, MAX_TOTAL = 0.25, 8, 2, 8
# The columns of a table of explanations.
TABLE = ["sample_index", "full_smiles", "fragment_smiles", "atom_indices", "num_components", "components", "size", "full_prediction", "fragment_prediction", "difference", "epsilon", "max_subgraph_size", "dataset", "model_name", "max_combination_size", "max_total_atoms", "component_smiles"]
#: The largest molecule whose connected sets of all sizes may be asked for.
UNLIMITED = 24
#: The largest molecule that is dealt whole.
WHOLE = 16
#: Sets, at most, of the molecules that are counted together.
COUNTED = 1 << 18
#: An explanation of a sample in a row.
FOUND = "atoms array<int>, components array<array<int>>, paths array<array<int>>, num_components int, size int, full_prediction double, prediction double, difference double, rank int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
#: Masked samples, and values of their features, that a model takes at once.
STACKED, CELLS = 1 << 14, 1 << 20


def enumerate_connected(adj: DataFrame, max_size: int | None = MAX_SUBGRAPH) -> DataFrame:
    """``mol_id, path, atoms, size, mask``: every connected set of up to ``max_size`` atoms, once.

    ``path`` has the atoms in the order in which the set grew: by distance from the least one, then by number. ``mask``
    is the set as a bitmap over the molecule's atoms by number, a long for each 64 of them. Sets grow in numpy from each
    atom of a molecule, many at a time; molecules and their first atoms are dealt to tasks, so that a large one takes
    several. A size below 1 gives single atoms; None goes on until no molecule has a larger set, which is an error above
    ``UNLIMITED`` atoms: the number of sets doubles with each atom.
    """
    if max_size is None:
        most = adj.agg(F.max(F.size("adj"))).first()[0] or 1
        if most > UNLIMITED:
            raise ValueError(f"a molecule of {most} atoms has too many connected sets: give a max_size")
    limit = max_size if max_size is None else max(max_size, 1)
    # small molecules start from all atoms in one row, those of more than WHOLE atoms from one atom a row
    start = F.when(F.size("adj") > WHOLE, F.sequence(F.lit(0), F.size("adj") - 1)).otherwise(F.array(F.lit(-1)))
    dealt = adj.select("mol_id", "adj", F.explode(start).alias("start")).repartition("mol_id", "start")

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                one = batch.column(2).to_numpy()
                for rows in (np.flatnonzero(one < 0), np.flatnonzero(one >= 0)):
                    if not len(rows):
                        continue
                    part = batch.take(pa.array(rows))
                    mols = subgraphs.Molecules(part.column(1))
                    first = subgraphs.starts(mols, None if one[rows[0]] < 0 else one[rows].astype(np.int64))
                    for sets in subgraphs.connected(mols, first, limit):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(sets.mol)), *subgraphs.columns(mols, sets)], ["mol_id", "path", "atoms", "size", "mask"])

    schema = T.StructType([adj.schema["mol_id"], *T._parse_datatype_string("path array<int>, atoms array<int>, size int, mask array<bigint>").fields])
    return dealt.mapInArrow(run, schema)


def _apart(a: str, b: str) -> Column:
    """Whether two bitmaps of one molecule share no atom."""
    return ~F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def combine(subgraphs: DataFrame, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL) -> DataFrame:
    """``mol_id, paths, components, atoms, num_components, size, mask``: sets of disjoint subgraphs in path order.

    Disjoint sizes add up, so partners are joined by the sizes that still fit, and told apart by their bitmaps; atom lists
    are made of the paths once pairs are found.
    """
    fits = subgraphs if max_total is None else subgraphs.where(F.col("size") <= max_total)
    levels = [fits.select("mol_id", F.array("path").alias("paths"), F.lit(1).alias("num_components"), "size", "mask")]
    part = fits.select(F.col("mol_id").alias("_m"), F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mask").alias("_mask"))
    for k in range(2, max_combination + 1):
        left = levels[-1]
        if max_total is None:
            meet = left.join(large(part), F.col("mol_id") == F.col("_m"))
        else:
            left = left.where(F.col("size") < max_total).withColumn("_room", F.explode(F.sequence(F.lit(1), F.lit(max_total) - F.col("size"))))
            meet = left.join(large(part.where(F.col("_s") < max_total)), (F.col("mol_id") == F.col("_m")) & (F.col("_room") == F.col("_s")))
        meet = meet.where(_apart("mask", "_mask") & (F.element_at("paths", -1) < F.col("_p")))
        union = F.zip_with("mask", "_mask", lambda x, y: x.bitwiseOR(y))
        levels.append(meet.select("mol_id", F.concat("paths", F.array("_p")).alias("paths"), F.lit(k).alias("num_components"), (F.col("size") + F.col("_s")).alias("size"), union.alias("mask")))
    return reduce(DataFrame.unionByName, levels).select("mol_id", "paths", *_lists("paths"), "num_components", "size", "mask")


def _lists(paths: str) -> list[Column]:
    """``components`` and ``atoms`` of paths."""
    return [F.transform(paths, lambda c: F.array_sort(c)).alias("components"), F.array_sort(F.flatten(paths)).alias("atoms")]


def order_key() -> Column:
    return F.struct("num_components", "paths")


def collapse(combos: DataFrame) -> DataFrame:
    """One row for each atom set, the first made: a score depends on the atoms alone."""
    rest = F.struct("paths", "num_components", "size")
    first = combos.groupBy("mol_id", "mask").agg(F.min_by(rest, order_key()).alias("_r")).select("mol_id", "mask", "_r.*")
    return first.select("mol_id", F.array_sort(F.flatten("paths")).alias("atoms"), F.transform("paths", lambda c: F.array_sort(c)).alias("components"), "paths", "num_components", "size", "mask")


def candidates(adj: DataFrame, max_subgraph: int = MAX_SUBGRAPH, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL) -> DataFrame:
    """``collapse`` of ``combine`` of ``enumerate_connected``: one row for each atom set of up to ``max_combination`` parts.

    Molecules of up to ``WHOLE`` atoms, which have few sets, are finished in the task that grows them, without a shuffle
    of sets; pairs of larger ones are joined.
    """
    if max_combination != 2 or max_total is None or not 1 <= max_subgraph <= subgraphs.KEYED or max_total > subgraphs.KEYED:
        return collapse(combine(enumerate_connected(adj, max_subgraph), max_combination, max_total))

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                mols = subgraphs.Molecules(batch.column(1))
                mol, columns = subgraphs.Pairs(list(subgraphs.connected(mols, subgraphs.starts(mols), max_subgraph)), max_total).columns(mols)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mol)), *columns], names)

    large = collapse(combine(enumerate_connected(adj.where(F.size("adj") > WHOLE), max_subgraph), max_combination, max_total))
    names = large.columns
    small = adj.where((F.size("adj") <= WHOLE) & (F.size("adj") > 0)).select("mol_id", "adj")
    return small.mapInArrow(run, large.schema).unionByName(large)


def count_combinations(adj: DataFrame, max_subgraph: int = MAX_SUBGRAPH, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL) -> DataFrame:
    """``mol_id, size, num_components, n, n_sets``: the rows of ``combine`` of ``enumerate_connected`` by molecule, size and parts, and their different atom sets.

    Molecules of up to ``WHOLE`` atoms are counted in the task that grows their sets, many at a time; combinations of
    larger ones are made and counted.
    """
    adj = cut(adj, "molecules")
    pairs = max_combination == 2 and max_total is not None and max_total >= 1
    rest = adj.where(F.size("adj") > WHOLE) if pairs else adj
    made = combine(enumerate_connected(rest, max_subgraph), max_combination, max_total)
    made = made.groupBy("mol_id", "size", "num_components").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mask").alias("n_sets"))
    if not pairs:
        return made
    limit = max(max_subgraph, 1)

    def run(batches):
        for whole in batches:
            room = np.cumsum(1 << np.diff(whole.column(1).offsets.to_numpy()).astype(np.int64)) // COUNTED
            for begin, end in zip(*(np.searchsorted(room, np.unique(room), side=side) for side in ("left", "right")), strict=True):
                batch = whole.slice(begin, end - begin)
                mols = subgraphs.Molecules(batch.column(1))
                mol, *found = subgraphs.counts(batch.num_rows, subgraphs.connected(mols, subgraphs.starts(mols), limit), max_total)
                kinds = (np.int32, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mol)), *(pa.array(x.astype(k)) for x, k in zip(found, kinds, strict=True))], names.names)

    names = T.StructType([adj.schema["mol_id"], *T._parse_datatype_string("size int, num_components int, n bigint, n_sets bigint").fields])
    small = adj.where((F.size("adj") <= WHOLE) & (F.size("adj") > 0)).select("mol_id", "adj")
    return small.mapInArrow(run, names).unionByName(made)


def attach_target_fields(candidates: DataFrame, samples: DataFrame, fields: list[str], optional: tuple[str, ...] = ("y",)) -> DataFrame:
    """Candidates with ``fields`` of their full sample; an optional field that samples lack is left out."""
    have = [f for f in fields if f in samples.columns or f not in optional]
    return candidates.join(large(samples.select("sample_id", *have)), "sample_id")


def masked_features(features: Column, atoms: Column) -> Column:
    """Feature rows with those of atoms outside the set as zeros; places are atom numbers from 0."""
    return F.transform(features, lambda v, i: F.when(F.array_contains(atoms, i), v).otherwise(F.transform(v, lambda x: x * 0)))


def node_mask(n_atoms: Column, atoms: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n_atoms - 1), lambda i: F.array_contains(atoms, i).cast("float"))


def masked_sample(candidates: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """A model sample for each candidate: its full sample with features masked, ``mask`` added, and no molecule vector.

    ``samples`` has ``features`` (a row for each atom, by number from 0), ``mol_features`` and ``n_atoms``. Arcs and the
    number of atoms stay; the molecule's own vector becomes zeros, as it would tell of the whole molecule.
    """
    rows = candidates.select(key, "atoms").join(large(samples), key)
    masked = {"features": masked_features(F.col("features"), F.col("atoms")), "mask": node_mask(F.col("n_atoms"), F.col("atoms"))}
    return rows.withColumns(masked | {"mol_features": F.transform("mol_features", lambda x: x * 0)})


def sufficient(scored: DataFrame, epsilon: float = EPSILON, full: str = "full_prediction", prediction: str = "prediction") -> DataFrame:
    """Rows whose prediction is within ``epsilon`` of the full one, with their ``difference``."""
    return scored.withColumn("difference", F.abs(F.col(full) - F.col(prediction))).where(F.col("difference") <= epsilon)


def dedup_by_atoms(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row for each atom set: fewest components, then least difference, then first made."""
    rest = [c for c in df.columns if c not in (key, "atoms")]
    best = df.groupBy(key, "atoms").agg(F.min_by(F.struct(*rest), F.struct("num_components", "difference", "paths")).alias("_r"))
    return best.select(key, "atoms", "_r.*").select(*df.columns)


def bitmap(atoms: Column) -> Column:
    """Atoms by number as bits, a long for each 64 numbers."""
    words = F.sequence(F.lit(0), (F.coalesce(F.array_max(atoms), F.lit(0)) / 64).cast("int"))
    one = lambda w: F.aggregate(F.filter(atoms, lambda a: F.floor(a / 64) == w), F.lit(0).cast("long"), lambda s, a: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (a % 64).cast("int"))))
    return F.transform(words, one)


def minimal(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows none of whose strictly smaller sets is among the rows; a null key is a sample.

    A sample's rows pass by size. A set with a smaller one inside has a minimal one inside, so it is compared with the
    minimal ones so far, all of a size at once, by bitmaps; only these are held.
    """
    own = df if "mask" in df.columns else df.withColumn("mask", bitmap(F.col("atoms")))
    rows = own.withColumn("_size", F.size("atoms")).repartition(key).sortWithinPartitions(key, "_size")
    places = [rows.columns.index(c) for c in (key, "_size", "mask")]

    def run(batches):
        sample, kept, fresh, now = None, np.zeros((0, 1), np.uint64), [], -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size, masks = (batch.column(i) for i in places)
            size, masks = size.to_numpy(), subgraphs.words_of(masks)
            new = group_codes([ids])[1]
            edge = np.flatnonzero(np.r_[True, (new[1:] != new[:-1]) | (size[1:] != size[:-1])])
            stays = np.ones(len(size), bool)
            for a, b in zip(edge, [*edge[1:], len(size)], strict=True):
                name = ids[a].as_py()
                if name != sample or now < 0:
                    sample, kept, fresh = name, masks[:0], []
                elif size[a] != now and fresh:
                    kept, fresh = subgraphs.stacked([kept, *fresh]), []
                now = size[a]
                stays[a:b] = ~subgraphs.has_inside(masks[a:b], kept)
                fresh.append(masks[a:b][stays[a:b]])
            yield batch.filter(pa.array(stays))

    found = rows.mapInArrow(run, rows.schema)
    return found.select(*df.columns)


def ranked(df: DataFrame, k: int | None = None, key: str = "sample_id") -> DataFrame:
    """Rows with their ``rank`` by size, then difference, then first made; of the first ``k`` only, if given."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("size", "difference", "num_components", "paths")))
    return out if k is None else out.where(F.col("rank") <= k)


def describe_atoms(df: DataFrame, atoms: DataFrame, key: str = "sample_id") -> DataFrame:
    """A row for each atom of each set: number, symbol, aromatic, in ring."""
    return df.select(key, "mol_id", F.col("atoms").alias("set"), F.explode("atoms").alias("atom_idx")).join(large(atoms.select("mol_id", "atom_idx", "symbol", "is_aromatic", "in_ring")), ["mol_id", "atom_idx"])


def output_columns(df: DataFrame) -> DataFrame:
    """List columns as JSON text, components sorted."""
    return df.withColumns({"atom_indices": F.to_json(F.sort_array("atoms")), "components": F.to_json(F.transform("components", lambda c: F.sort_array(c)))})


def explanation_table(df: DataFrame, samples: DataFrame | None, *, dataset: str, model_name: str, fragments=None, epsilon: float = EPSILON, max_subgraph: int = MAX_SUBGRAPH, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL, ranged: bool = False) -> DataFrame:
    """The columns ``TABLE`` of explanations, ordered by sample, size, difference and first made; ``samples(sample_id, full_smiles)``.

    ``fragments`` takes the column of a row's atom sets (the whole set, then its components) and gives a list of as many
    texts, by an expression or a user's batch function; without it, the texts of fragments are null. Explanations of a
    sample that ``samples`` lacks have a null ``full_smiles``; of repeated rows the least counts. Without ``samples``, ``df`` has the
    texts. Rows ``ranged`` by sample, a range for each task, are only sorted within tasks.
    """
    parts = F.transform("components", lambda c: F.sort_array(c))
    sets = F.concat(F.array(F.sort_array("atoms")), parts)
    named = F.lit(None).cast("array<string>") if fragments is None else fragments(F.col("_sets"))
    if samples is not None:
        df = df.join(large(samples.groupBy("sample_id").agg(F.min("full_smiles").alias("full_smiles"))), "sample_id", "left")
    order = ["sample_id", "size", "difference", "num_components", "paths"]
    rows = df.sortWithinPartitions(*order) if ranged else df.orderBy(*order)  # before the texts are made
    rows = rows.withColumn("_sets", sets).withColumn("_names", named)
    own = {
        "sample_index": F.col("sample_id"), "fragment_smiles": F.get("_names", F.lit(0)), "atom_indices": F.to_json(F.get("_sets", F.lit(0))),
        "components": F.to_json(F.slice("_sets", 2, 1 << 30)), "fragment_prediction": F.col("prediction"), "epsilon": F.lit(epsilon).cast("double"), "max_subgraph_size": F.lit(max_subgraph),
        "dataset": F.lit(dataset), "model_name": F.lit(model_name), "max_combination_size": F.lit(max_combination),
        "max_total_atoms": F.lit(max_total).cast("int"), "component_smiles": F.to_json(F.slice("_names", 2, 1 << 30)),
    }
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in TABLE])


def full_predictions(samples: DataFrame, adj: DataFrame, score) -> DataFrame:
    """``sample_id, full_prediction``: ``score`` of each whole sample, that is of all its molecule's atoms."""
    whole = samples.join(large(adj), "mol_id").withColumn("atoms", F.sort_array(F.map_keys("adj"))).drop("adj")
    return score(whole).select("sample_id", F.col("prediction").alias("full_prediction"))


def explain(samples: DataFrame, adj: DataFrame, score, *, epsilon: float = EPSILON, max_subgraph: int = MAX_SUBGRAPH, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL, k: int | None = None) -> DataFrame:
    """Minimal sufficient explanations of ``samples(sample_id, mol_id)``.

    Combinations are built once for each molecule. ``score`` takes candidates (sample_id, mol_id, atoms and what
    else they carry) and returns them with ``prediction``. Samples without a ``full_prediction`` are scored whole first.
    """
    molecules = cut(adj.join(large(samples.select("mol_id").distinct()), "mol_id", "left_semi"), "molecules")
    if "full_prediction" not in samples.columns:
        full = cut(full_predictions(samples, molecules, score), "full")
        samples = samples.join(large(full), "sample_id")
    # one row for each atom set: the one that `dedup_by_atoms` would keep, as sets of the same atoms score alike
    combos = candidates(molecules, max_subgraph, max_combination, max_total)
    scored = score(samples.join(large(combos), "mol_id"))
    return ranked(minimal(sufficient(scored, epsilon)), k).drop("mask")


def explain_whole(samples: DataFrame, make_predict, fields: list[str], *, keep: tuple[str, ...] = ("sample_id", "mol_id"), epsilon: float = EPSILON, max_subgraph: int = MAX_SUBGRAPH, max_combination: int = MAX_COMBINATION, max_total: int | None = MAX_TOTAL, k: int | None = None, most: int | None = None) -> DataFrame:
    """The columns ``keep`` of each sample and ``found``, its minimal sufficient explanations by rank: a list of ``FOUND``.

    ``samples`` has a row for each sample: ``sample_id``, ``mol_id``, ``adj``, ``features`` (a row for each of ``adj``'s atoms, by
    number), the model's ``fields``, and ``full_prediction``, unless the model is to make it. The model is made once in each
    task and takes samples of as many atoms at once, as a dict: ``features`` (samples, atoms, ...) with zeros outside the set,
    ``mask`` (samples, atoms) and ``fields``, an array each; it returns their predictions.

    A sample of up to ``WHOLE`` atoms is finished where it stands: its sets, which molecules of one shape share, their scores
    and the choice among them take one batch function and no shuffle. Larger ones go through ``explain``; ``most``, if no molecule
    has more atoms, tells that there are none. Samples without atoms are left out, as are those with a null key.
    """
    given = ["full_prediction"] if "full_prediction" in samples.columns else []
    rows = samples.where(F.col("sample_id").isNotNull() & F.col("mol_id").isNotNull())
    rows = rows.select(*dict.fromkeys([*keep, "sample_id", "mol_id", "adj", "features", *fields, *given]))
    keyed = max_combination == 2 and max_total is not None and 1 <= max_subgraph <= subgraphs.KEYED and max_total <= subgraphs.KEYED
    all_small = keyed and most is not None and most <= WHOLE
    rows = rows if all_small else cut(rows, "samples")

    def run(batches):
        predict, shapes = make_predict(), subgraphs.Shapes(max_subgraph, max_total)
        for batch in batches:
            batch = batch.filter(pa.array(np.diff(batch.column("adj").offsets.to_numpy()) > 0))
            if not batch.num_rows:
                continue
            mols = subgraphs.Molecules(batch.column("adj"))
            features = udfs.feature_rows(batch.column("features"))
            if [x.shape[0] if x.ndim else 0 for x in features] != mols.sizes.tolist():
                raise ValueError("features need a row for each atom of adj")
            values = {c: udfs.values(batch.column(c)) for c in [*fields, *given]}
            found = []
            for shape, at in shapes.each(mols, batch.column("adj")):
                step = max(1, STACKED // max(len(shape.mask), 1 << shape.atoms))
                found += [_least(shape, at[a : a + step], features, values, predict, epsilon, given) for a in range(0, len(at), step)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _found(mols, batch.num_rows, found, k)], [*keep, "found"])

    schema = T.StructType([*[samples.schema[c] for c in keep], T.StructField("found", T.ArrayType(T._parse_datatype_string(FOUND)))])
    if all_small:
        return rows.mapInArrow(run, schema)
    many = rows.where(F.size("adj") > (WHOLE if keyed else 0))
    own = many.select("sample_id", "features", *[c for c in fields if c != "sample_id"], F.array_sort(F.map_keys("adj")).alias("_ids"))
    score = lambda sets: udfs.score_masked(sets, own, udfs.of_samples(make_predict, fields), ids="_ids")
    made = explain(many.select("sample_id", "mol_id", *given), many.select("mol_id", "adj").dropDuplicates(["mol_id"]), score, epsilon=epsilon, max_subgraph=max_subgraph, max_combination=max_combination, max_total=max_total, k=k)
    lists = made.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*FOUND_NAMES).alias("f"))))["f"].alias("found"))
    rest = many.select(*dict.fromkeys([*keep, "sample_id"])).join(large(lists), "sample_id", "left")
    rest = rest.select(*keep, F.coalesce("found", F.array().cast(schema["found"].dataType)).alias("found"))
    return rows.where(F.size("adj") <= WHOLE).mapInArrow(run, schema).unionByName(rest) if keyed else rest


def _least(shape: subgraphs.Shape, at: np.ndarray, features: list[np.ndarray], values: dict[str, np.ndarray], predict, epsilon: float, given: list[str]) -> tuple:
    """Of the samples ``at``, all of one shape: rows, numbers of their sets, full predictions, predictions and differences of the least sufficient sets, and the sets."""
    x, own = np.stack([features[i] for i in at]), {c: v[at] for c, v in values.items() if c not in given}
    own |= {c: values[c][at] for c in given if c in own}
    full = values[given[0]][at] if given else np.asarray(predict(udfs.stacked(x, np.ones((1, shape.atoms)), own)), float)
    scores = np.zeros((len(at), len(shape.mask)))
    step = max(1, min(STACKED // len(at), CELLS // max(x.size, 1)))
    for a in range(0, len(shape.mask), step):
        scores[:, a : a + step] = np.asarray(predict(udfs.stacked(x, shape.inside[a : a + step], own)), float).reshape(len(at), -1)
    difference = np.abs(full[:, None] - scores)
    row, one = shape.least(difference <= epsilon)
    return at[row], one, full[row], scores[row, one], difference[row, one], shape.size[one], shape.parts[one], shape.paths[one]


def _found(mols: subgraphs.Molecules, count: int, found: list[tuple], k: int | None) -> pa.ListArray:
    """The explanations of a batch of ``count`` samples as a list of ``FOUND`` each, by rank, of the first ``k`` ranks if given."""
    row, one, full, score, difference, size, parts, paths = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort([one, difference, size, row])
    rank = np.arange(len(row)) - np.searchsorted(row[order], row[order]) + 1
    order, rank = (order, rank) if k is None else (order[rank <= k], rank[rank <= k])
    row, full, score, difference, size, parts, paths = (c[order] for c in (row, full, score, difference, size, parts, paths))
    ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    there, none = paths >= 0, np.iinfo(np.int64).max
    ids = np.where(there, mols.ids[np.minimum(mols.first[row][:, None, None] + paths, len(mols.ids) - 1)], none)
    ordered, length = np.sort(ids, axis=2), there.sum(axis=2)
    lists = lambda x, n: pa.ListArray.from_arrays(ends(n), pa.array(x[np.arange(x.shape[1]) < n[:, None]].astype(np.int32)))
    used = length > 0
    components, by_path = (pa.ListArray.from_arrays(ends(parts), lists(x[used], length[used])) for x in (ordered, ids))
    atoms = lists(np.sort(ids.reshape(len(row), 2 * subgraphs.KEYED), axis=1), size)
    numbers = [pa.array(x.astype(t)) for x, t in ((parts, np.int32), (size, np.int32), (full, float), (score, float), (difference, float), (rank, np.int32))]
    rows = pa.StructArray.from_arrays([atoms, components, by_path, *numbers], FOUND_NAMES)
    return pa.ListArray.from_arrays(ends(np.bincount(row, minlength=count)), rows)


def listed(df: DataFrame) -> DataFrame:
    """A row for each explanation of ``explain_whole``, with what else its sample carries."""
    return df.select(*[c for c in df.columns if c != "found"], F.inline("found"))


def described(df: DataFrame) -> DataFrame:
    """``describe_atoms`` of whole samples, counted: each atom of ``a`` that is in one of ``found``, its fields, and in how many (``n``)."""
    sets = lambda x: F.size(F.filter("found", lambda f: F.array_contains(f["atoms"], x["atom_idx"].cast("int")))).cast("long")
    atoms = F.transform("a", lambda x: F.struct(x.alias("x"), sets(x).alias("n")))
    rows = df.where(F.size("found") > 0).select(*[c for c in df.columns if c not in ("a", "found")], F.inline(atoms)).where("n > 0")
    return rows.select(*[c for c in rows.columns if c not in ("x", "n")], "x.*", "n")
