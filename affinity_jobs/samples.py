"""Model samples: pairs, molecules and targets stored once each, joined when they are read."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encode, io

#: Files of a data set's split; a table of more pairs takes more.
BUCKETS = 64
PAIRS = ["sample_id", "dataset", "split", "mol_id", "target_id", "y"]
MOLECULES = ["mol_id", "features", "edge_index", "mol_features", "c_size"]
TARGETS = ["target_id", "target", "protein_feat", "klifs_pocket", "gatekeeper", "hinge"]


def molecule_table(atoms: DataFrame, arcs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``MOLECULES``: feature rows of ``atoms(mol_id, atom_idx, features)`` by atom number, arcs as two lists of places among them.

    ``vectors(mol_id, mol_features)`` must have each molecule, else reading is an error. An arc from or to what isn't an
    atom of the molecule is left out. Without atoms a molecule has no row.
    """
    both = atoms.select("mol_id", F.struct("atom_idx", "features").alias("_a")).unionByName(arcs.select("mol_id", F.struct("src", "dst").alias("_e")), allowMissingColumns=True)
    rows = both.groupBy("mol_id").agg(F.sort_array(F.collect_list("_a")).alias("a"), F.sort_array(F.collect_set("_e")).alias("e")).where(F.size("a") > 0)
    # places by a map, so that atom numbers may have gaps
    rows = rows.withColumn("at", F.map_from_entries(F.transform("a", lambda x, i: F.struct(x["atom_idx"].cast("long").alias("k"), i.alias("v")))))
    place = lambda c: F.element_at("at", c.cast("long"))
    known = F.filter("e", lambda x: F.map_contains_key("at", x["src"].cast("long")) & F.map_contains_key("at", x["dst"].cast("long")))
    edges = F.array(F.transform(known, lambda x: place(x["src"])), F.transform(known, lambda x: place(x["dst"])))
    rows = rows.select("mol_id", F.col("a.features").alias("features"), edges.alias("edge_index"), F.size("a").alias("c_size"))
    return encode.attach_targets(rows, io.large(vectors.select("mol_id", "mol_features")), key="mol_id").select(*MOLECULES)


def whole_molecule_table(molecules: DataFrame, vectors: DataFrame) -> DataFrame:
    """``molecule_table`` of molecules in a row each: ``mol_id``, ``a`` (structs with ``atom_idx`` and ``features``, by number) and ``adj`` as of ``graphs.adjacency``."""
    place = lambda c: (F.array_position(F.col("a")["atom_idx"], c) - 1).cast("int")
    # by an expression of each atom's own neighbours, so that places need no map; an end that is no atom is left out
    inside = F.transform(F.map_entries("adj"), lambda e: F.transform(F.filter(e["value"], lambda d: F.array_contains(F.col("a")["atom_idx"], d)), lambda d: F.struct(place(e["key"]).alias("s"), place(d).alias("d"))))
    rows = molecules.where(F.size("a") > 0).withColumn("_e", F.flatten(inside))
    rows = rows.select("mol_id", F.col("a.features").alias("features"), F.array("_e.s", "_e.d").alias("edge_index"), F.size("a").alias("c_size"))
    return encode.attach_targets(rows, io.large(vectors.select("mol_id", "mol_features")), key="mol_id").select(*MOLECULES)


def target_table(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``TARGETS``: the strict codes of the sequence, the vector, and the codes of pocket, gatekeeper and hinge."""
    strict = encode.sequence(F.col("target_sequence"), encode.SEQUENCE).alias("target")
    rows = encode.with_vector(features, vocabulary).select("target_id", strict, "protein_feat", *encode.code_columns())
    return rows.withColumnRenamed("pocket", "klifs_pocket").select(*TARGETS)


def _name(path: str) -> str:
    return f"samples_{zlib.crc32(path.encode()):08x}"


def write(pairs: DataFrame, molecules: DataFrame, targets: DataFrame, path: str, *, force: bool = False, buckets: int = BUCKETS) -> None:
    """Store samples under ``path``: a molecule and a target once each, however many pairs name them.

    Pairs are partitioned by data set and split, and bucketed by ``sample_id``, so that predictions by sample join them
    without a shuffle of the pairs. Parts that are whole are kept unless ``force``.
    """
    spark = pairs.sparkSession
    io.write(molecules.select(*MOLECULES), f"{path}/molecules", force=force)
    io.write(targets.select(*TARGETS), f"{path}/targets", force=force)
    if not force and io.finished(spark, f"{path}/pairs"):
        return
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    texts = {c: F.col(c).cast("string") for c in ("dataset", "split")}
    dealt = pairs.select(*PAIRS).withColumns(texts).repartition(buckets, "sample_id")  # as buckets are dealt: a task writes one file a split
    writer = dealt.write.mode("overwrite").format("parquet").partitionBy("dataset", "split").bucketBy(buckets, "sample_id").sortBy("sample_id")
    writer.option("path", f"{path}/pairs").saveAsTable(_name(path))


def stored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The stored pairs, with their buckets in the session that wrote them."""
    if spark.catalog.tableExists(_name(path)):
        return spark.table(_name(path))
    found = spark.read.parquet(f"{path}/pairs").schema
    text = {"dataset", "split"}  # names that look like numbers stay texts
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in found])).parquet(f"{path}/pairs")


def read(spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None, *, molecules: dict[str, Column] | None = None, targets: dict[str, Column] | None = None) -> DataFrame:
    """Whole samples: pairs with their molecule and target; of one data set or split, if given, whose files alone are read.

    A pair whose molecule or target isn't stored is an error when rows are read. A null data set or split comes back null.
    A model that wants other columns gives them by name, as functions of the stored ones of ``molecules`` or ``targets``, in
    whose place they stand: they are made once for each molecule or target, before its pairs meet it.
    """
    rows = stored_pairs(spark, path)
    for column, wanted in (("dataset", dataset), ("split", split)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    names = list(PAIRS)
    for part, key, stored, own in (("molecules", "mol_id", MOLECULES, molecules), ("targets", "target_id", TARGETS, targets)):
        columns = {c: F.col(c) for c in stored[1:]} if own is None else own
        table = spark.read.parquet(f"{path}/{part}").select(key, *[c.alias(name) for name, c in columns.items()])
        rows = encode.attach_targets(rows, io.large(table), key=key)
        names += columns
    return rows.select(*names)
