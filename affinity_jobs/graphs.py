"""Molecular graphs as atom and bond tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import attach_targets, once, one_of_k
from .io import dealt, large
from .vectors import combine

# The slots of the atom vector.
SYMBOLS = ["C", "N", "O", "S", "F", "Si", "P", "Cl", "Br", "Mg", "Na", "Ca", "Fe", "As", "Al", "I", "B", "V", "K", "Tl", "Yb", "Sb", "Sn", "Ag", "Pd", "Co", "Se", "Ti", "Zn", "H", "Li", "Ge", "Cu", "Au", "Ni", "Cd", "In", "Mn", "Zr", "Cr", "Pt", "Hg", "Pb", "Unknown"]
COUNTS = list(range(11))
CHARGES = ["-2", "-1", "0", "1", "2", "Other"]
HYBRIDS = ["SP", "SP2", "SP3", "SP3D", "SP3D2", "Other"]
HALOGENS = ["F", "Cl", "Br", "I"]
FLAGS = {"donor": ["Donor"], "acceptor": ["Acceptor"], "hydrophobe": ["Hydrophobe", "LumpedHydrophobe"], "aromatic": ["Aromatic"], "positive": ["PosIonizable"], "negative": ["NegIonizable"]}
MOLECULE = ["weight", "logp", "tpsa", "rotatable", "hbd", "hba", "heteroatoms", "rings"]
HYDROGEN_MASS = 1.008


def arcs(bonds: DataFrame) -> DataFrame:
    """``mol_id, src, dst``: both directions of each bond, once."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return bonds.select("mol_id", F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("e")).select("mol_id", "e.*").distinct()  # bonds are made once


def attached(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``rows`` joined with ``other``, both sorted in ``tasks`` tasks (see ``io.dealt``)."""
    return dealt(rows, tasks, *keys).join(large(dealt(other, tasks, *keys)), keys, how)


def degree(atoms: DataFrame, arcs: DataFrame, tasks: int | None = None) -> DataFrame:
    """``mol_id, atom_idx, degree``; 0 without bonds."""
    counts = arcs.groupBy("mol_id", F.col("src").alias("atom_idx")).agg(F.count(F.lit(1)).alias("degree"))
    return attached(atoms.select("mol_id", "atom_idx"), counts, ["mol_id", "atom_idx"], "left", tasks).na.fill(0, ["degree"])


def adjacency(atoms: DataFrame, arcs: DataFrame) -> DataFrame:
    """``mol_id, adj``: each atom's sorted neighbours, empty for atoms without bonds."""
    ends = atoms.select("mol_id", "atom_idx", F.lit(None).alias("dst")).unionByName(arcs.select("mol_id", F.col("src").alias("atom_idx"), "dst", F.lit(True).alias("_arc")), allowMissingColumns=True)
    # an end that isn't among the atoms makes none
    lists = ends.groupBy("mol_id", "atom_idx").agg(F.sort_array(F.collect_set("dst")).cast("array<int>").alias("near"), F.bool_or(F.col("_arc").isNull()).alias("_atom")).where("_atom")
    entry = F.struct(F.col("atom_idx").cast("int").alias("k"), F.col("near").alias("v"))
    return lists.groupBy("mol_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("adj"))


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of nodes 0..n-1 that each reaches over links ``a, b``.

    Roots take the least label across their links, then labels jump to their labels' labels; rounds grow with the log
    of a path's length and end when nothing changes.
    """
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def parts(count: int, offsets: np.ndarray, atoms: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Molecules, numbers and components of the atoms of ``count`` molecules: ``atoms`` by ``offsets``, links from places in it to atoms by number.

    Ends that are no atoms of the molecule link nothing.
    """
    mol = np.repeat(np.arange(count), np.diff(offsets))
    many = len(atoms)
    order = np.lexsort([atoms, mol])  # so that the least place is the least atom
    place = np.empty(many, np.int64)
    place[order] = np.arange(many)
    low = int(min(atoms.min(initial=0), ends.min(initial=0)))
    span = int(max(atoms.max(initial=0), ends.max(initial=0))) - low + 1
    known, wanted = mol[order] * span + atoms[order] - low, mol[owner] * span + ends - low
    at = np.minimum(np.searchsorted(known, wanted), max(many - 1, 0))
    real = known[at] == wanted if many else np.zeros(0, bool)
    return mol[order], atoms[order], least_reached(many, place[owner[real]], at[real])


def components(adj: DataFrame) -> DataFrame:
    """``mol_id, atom_idx, component``: the least atom that each atom of a molecule reaches, by pointer jumping over a batch's molecules at once.

    Neighbours that are no atoms of the molecule link nothing.
    """

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                maps = batch.column(1)
                offsets = maps.offsets.to_numpy()
                first, many = int(offsets[0]), int(offsets[-1] - offsets[0])
                ids, near = maps.keys.to_numpy()[first : first + many].astype(np.int64), maps.items.slice(first, many)
                degree = near.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                owner, ends = np.repeat(np.arange(many), degree), near.flatten().to_numpy().astype(np.int64)
                mol, names, label = parts(batch.num_rows, offsets, ids, owner, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mol)), pa.array(names.astype(np.int32)), pa.array(names[label].astype(np.int32))], ["mol_id", "atom_idx", "component"])

    return adj.select("mol_id", "adj").mapInArrow(run, T.StructType([adj.schema["mol_id"], T.StructField("atom_idx", T.IntegerType()), T.StructField("component", T.IntegerType())]))


def molecule_summary(atoms: DataFrame, arcs: DataFrame, masses: DataFrame) -> DataFrame:
    """``mol_id, n_atoms, weight, heteroatoms, rings`` from atoms, arcs and ``masses(symbol, mass)``, a row for each element.

    Rings are bonds - atoms + components. Atoms and arcs of a molecule meet once, in one group.
    """
    rows = atoms.join(F.broadcast(masses), "symbol", "left")  # elements are few: atoms aren't dealt by symbol
    own = rows.select("mol_id", F.col("atom_idx").cast("long").alias("_a"), (F.col("mass") + HYDROGEN_MASS * F.col("num_hs")).alias("_w"), (~F.col("symbol").isin("C", "H")).alias("_h"), F.lit(1).alias("_n"))
    links = arcs.select("mol_id", F.struct(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d")).alias("_e"), (F.col("src") <= F.col("dst")).alias("_b"))
    counts = own.unionByName(links, allowMissingColumns=True).where("mol_id IS NOT NULL").groupBy("mol_id").agg(
        F.count("_n").alias("n_atoms"), F.sum("_w").alias("weight"), F.count_if("_h").alias("heteroatoms"), F.count_if("_b").alias("_bonds"), F.collect_set("_a").alias("_ids"), F.collect_list("_e").alias("_links"))
    return _with_rings(counts.where("n_atoms > 0").select("mol_id", "n_atoms", "weight", "heteroatoms", "_bonds", "_ids", F.col("_links.s").alias("_src"), F.col("_links.d").alias("_dst")))


def whole_summary(molecules: DataFrame) -> DataFrame:
    """``molecule_summary`` of molecules in a row each: ``mol_id``, ``a`` (structs with ``atom_idx``, ``symbol``, ``num_hs``, ``mass``), and ``adj`` as of ``adjacency``."""
    mass = lambda x: x["mass"] + HYDROGEN_MASS * x["num_hs"]
    weight = F.when(F.exists("a", lambda x: mass(x).isNotNull()), F.aggregate("a", F.lit(0.0), lambda s, x: s + F.coalesce(mass(x), F.lit(0.0))))
    other = F.size(F.filter("a", lambda x: ~x["symbol"].isin("C", "H"))).cast("long")
    ends = F.map_entries("adj")
    bonds = F.aggregate(ends, F.lit(0).cast("long"), lambda s, e: s + F.size(F.filter(e["value"], lambda d: d >= e["key"])))
    link = lambda of: F.flatten(F.transform(ends, lambda e: of(e["key"], e["value"]))).cast("array<bigint>")
    rows = molecules.where((F.size("a") > 0) & F.col("mol_id").isNotNull()).select(
        "mol_id", F.size("a").cast("long").alias("n_atoms"), weight.alias("weight"), other.alias("heteroatoms"), bonds.alias("_bonds"), F.map_keys("adj").cast("array<bigint>").alias("_ids"),
        link(lambda k, v: F.array_repeat(k, F.size(v))).alias("_src"), F.flatten(F.map_values("adj")).cast("array<bigint>").alias("_dst"))
    return _with_rings(rows)


def _with_rings(lists: DataFrame) -> DataFrame:
    """Bonds, atoms and links of each molecule as ``rings``, many molecules at once."""

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                atoms, src, dst = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns[5:])
                offsets = np.r_[0, np.cumsum(batch.column(5).value_lengths().to_numpy())]
                mol = np.repeat(np.arange(batch.num_rows), batch.column(6).value_lengths().to_numpy())
                low = int(min(atoms.min(initial=0), src.min(initial=0)))
                span = int(max(atoms.max(initial=0), src.max(initial=0))) - low + 1
                key = np.repeat(np.arange(batch.num_rows), np.diff(offsets)) * span + atoms - low
                order = np.argsort(key)
                wanted = mol * span + src - low
                at = np.minimum(np.searchsorted(key, wanted, sorter=order), max(len(key) - 1, 0))
                real = key[order[at]] == wanted if len(key) else np.zeros(0, bool)
                found, _, label = parts(batch.num_rows, offsets, atoms, order[at[real]], dst[real])
                count = np.bincount(found[label == np.arange(len(label))], minlength=batch.num_rows)
                rings = batch.column(4).to_numpy() - batch.column(1).to_numpy() + count
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rings)], ["mol_id", "n_atoms", "weight", "heteroatoms", "rings"])

    return lists.mapInArrow(run, T.StructType([*lists.schema.fields[:4], T.StructField("rings", T.LongType())]))


def molecule_vector(summary: DataFrame, descriptors: DataFrame) -> DataFrame:
    """``mol_id, mol_features``: the eight slots of a molecule, of ``molecule_summary`` and ``descriptors(mol_id, logp, tpsa, rotatable, hbd, hba)``.

    A molecule without a row of descriptors is an error when rows are read; a number that is null is NaN. Of repeated rows
    of descriptors the least counts, nulls first.
    """
    given = ["logp", "tpsa", "rotatable", "hbd", "hba"]
    once_each = descriptors.groupBy("mol_id").agg(F.min(F.struct(*given)).alias("d")).select("mol_id", "d.*")
    rows = attach_targets(summary, large(once_each), key="mol_id")
    slots = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in MOLECULE]
    return rows.select("mol_id", F.array(*slots).alias("mol_features"))


def pharmacophore_flags(atoms: DataFrame, hits: DataFrame, tasks: int | None = None) -> DataFrame:
    """``atoms`` with six flags; families outside the list are ignored."""
    found = hits.groupBy("mol_id", "atom_idx").agg(*[F.bool_or(F.col("family").isin(names)).alias(flag) for flag, names in FLAGS.items()])
    return attached(atoms, found, ["mol_id", "atom_idx"], "left", tasks).na.fill(False, list(FLAGS))


def atom_vector(df: DataFrame) -> DataFrame:
    """``df`` (atoms with ``degree`` and flags) with the 99-slot vector ``features``; a degree above 10 is an error."""
    number = lambda c: F.array((F.coalesce(c, F.lit(False))).cast("float"))
    symbol = F.col("symbol")
    parts = [
        one_of_k(symbol, SYMBOLS, "last"), one_of_k(F.col("degree").cast("int"), COUNTS), one_of_k(F.col("num_hs").cast("int"), COUNTS, "last"), one_of_k(F.col("implicit_valence").cast("int"), COUNTS, "last"),
        one_of_k(F.col("formal_charge").cast("string"), CHARGES, "last"), one_of_k(F.col("hybridization"), HYBRIDS, "last"),
        number(F.col("is_aromatic")), number(F.col("in_ring")), number(~symbol.isin("C", "H")), number(symbol.isin(HALOGENS)), *[number(F.col(f)) for f in FLAGS],
    ]
    return df.withColumn("features", F.concat(*parts))


def l1_normalize(v: Column) -> Column:
    """A vector divided by its sum."""

    def divide(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        return once(total, lambda t: F.transform(w, lambda x: x / t))

    return once(v, divide)


def distinct_ligands(pairs: list[DataFrame], column: str = "compound_iso_smiles") -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(column) for p in pairs]).distinct()


def attach_graphs(pairs: DataFrame, graphs: DataFrame, column: str = "compound_iso_smiles") -> DataFrame:
    """Pairs with their ligand's graph, built once for each ligand."""
    return pairs.join(graphs, column)


def pool(df: DataFrame, keys: list[str], vector: str, how: str = "sum") -> DataFrame:
    """Vectors of each group combined by place: sum, max, mean, or max followed by mean."""
    return combine(df, keys, vector, how)


def _propagate(nodes: DataFrame, arcs: DataFrame, weight: Column | None, own: Column, tasks: int | None = None) -> DataFrame:
    """Sum over arcs of the source's vector times ``weight``, plus the node's own times ``own``: a row with a vector for each arc and node."""
    source = nodes.select("mol_id", F.col("atom_idx").alias("src"), F.col("_deg").alias("_ds"), "features")
    end = nodes.select("mol_id", F.col("atom_idx").alias("dst"), F.col("_deg").alias("_dd"))
    sent = attached(attached(arcs.where("src != dst"), end, ["mol_id", "dst"], tasks=tasks), source, ["mol_id", "src"], tasks=tasks)
    sent = sent.select("mol_id", F.col("dst").alias("atom_idx"), (weight if weight is not None else F.lit(1.0)).alias("_w"), "features")
    return combine(sent.unionByName(nodes.select("mol_id", "atom_idx", own.alias("_w"), "features")), ["mol_id", "atom_idx"], "features", weight=F.col("_w"), tasks=tasks)


def _with_degree(nodes: DataFrame, arcs: DataFrame, tasks: int | None = None) -> DataFrame:
    counts = arcs.where("src != dst").groupBy("mol_id", F.col("src").alias("atom_idx")).agg(F.count(F.lit(1)).alias("_n"))
    return attached(nodes, counts, ["mol_id", "atom_idx"], "left", tasks).withColumn("_deg", F.coalesce("_n", F.lit(0)) + 1).drop("_n")


def neighbor_sum(nodes: DataFrame, arcs: DataFrame, eps: float = 0.0, mask: str | None = None, tasks: int | None = None) -> DataFrame:
    """``mol_id, atom_idx, features``: ``(1 + eps) * x`` plus the neighbours' sum; masked nodes are 0 before and after."""
    rows = nodes if mask is None else nodes.withColumn("features", F.transform("features", lambda x: x * F.col(mask)))
    out = _propagate(_with_degree(rows, arcs, tasks), arcs, None, F.lit(1.0 + eps), tasks)
    if mask is None:
        return out
    return attached(out, nodes.select("mol_id", "atom_idx", mask), ["mol_id", "atom_idx"], tasks=tasks).withColumn("features", F.transform("features", lambda x: x * F.col(mask))).drop(mask)


def gcn_propagate(nodes: DataFrame, arcs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Neighbours' sum with self loops, each term over the root of the product of both degrees."""
    return _propagate(_with_degree(nodes, arcs, tasks), arcs, 1 / F.sqrt(F.col("_ds") * F.col("_dd")), 1 / F.col("_deg"), tasks)
