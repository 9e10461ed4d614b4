"""Sources and sinks: ordered JSON dictionaries, folds, matrices, and the tables that the jobs write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table that a task of `dealt` takes.
TASK_ROWS = 250_000
#: Entries of a dictionary that one window numbers.
ENTRIES = 100_000
#: Blanks at the ends of a text belong to it; quotes within it are doubled, so that backslashes stand for themselves.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# The columns of pair and feature tables.
PAIRS = "compound_iso_smiles string, target_id string, target_sequence string, affinity double"
FEATURES = ["target_id", "target_sequence", "kinase_group", "kinase_family", "kinase_subfamily", "klifs_kinase_id", "best_structure_klifs_id", "best_structure_pdb_id", "has_structure", "klifs_85_residue_sequence", "gatekeeper_residue", "hinge_residues", "pocket_residue_composition", "pocket_hydrophobicity", "pocket_charge", "dfg_state", "ac_helix_state", "activation_loop_state"]


def _before(df: DataFrame, block: str, order: str, step: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``step`` over a file's earlier rows, by totals of its blocks and within them."""
    totals = df.groupBy("file", block).agg(F.sum(step).alias("_all"))
    first = F.sum("_all").over(Window.partitionBy("file").orderBy(block)) - F.col("_all")  # a row a block
    inner = F.sum(step).over(Window.partitionBy("file", block).orderBy(order)) - F.col(step)
    return df.join(totals.select("file", block, first.alias("_first")), ["file", block]).withColumn(out, F.col("_first") + inner).drop("_first")


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """``file, block, at, value``: texts between marks, read in byte ranges by many tasks; ``at`` grows within a block."""
    text = spark.read.option("lineSep", mark).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return text.select(*place, "value")


def _sure(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(what)).cast("boolean"))


def read_json_dict(spark: SparkSession, path: str, key: str = "id", value: str = "value") -> DataFrame:
    """``row_idx, key, value`` of a JSON object of strings, in its order; a repeated key keeps its first place and its last value.

    A file of any size is split at byte ranges: texts between quotes are counted by range, which tells keys from values.
    Each file of ``path`` is an object of its own. What isn't an object of strings is an error; an empty file has no rows.
    """
    # a quote after an odd number of backslashes ends no string
    ends = (F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 0).cast("long")
    rows = _before(_pieces(spark, path, '"').withColumn("step", ends), "block", "at", "step", "place")
    kind = F.col("place") % 4
    between = F.when(F.col("place") == 0, r"\A\s*(\{\s*(\}\s*)?)?\z").when(kind == 0, r"\A\s*[,}]\s*\z").when(kind == 2, r"\A\s*:\s*\z")
    rows = rows.select("file", F.floor(F.col("place") / 4).alias("entry"), kind.alias("kind"), F.struct("block", "at", "value").alias("p"), F.coalesce(F.rlike("value", between), F.lit(True)).alias("good"))

    def whole(k: int) -> Column:
        raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("p")))), lambda x: x["value"]), '"')
        return F.when(F.count_if(F.col("kind") == k) > 0, raw)

    entries = rows.groupBy("file", "entry").agg(whole(1).alias("k"), whole(3).alias("v"), F.bool_and("good").alias("good"))
    sound = F.col("good") & (F.col("k").isNull() == F.col("v").isNull())
    entries = entries.where(_sure(sound, F.col("k").isNotNull(), "not a JSON object of strings"))
    plain = lambda c: F.when(F.instr(c, "\\") == 0, F.col(c)).otherwise(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>", {"mode": "FAILFAST"})[0])
    entries = entries.select("file", "entry", plain("k").alias("k"), plain("v").alias("v"))
    kept = entries.groupBy("file", "k").agg(F.min("entry").alias("entry"), F.max_by("v", "entry").alias("v"))
    kept = _before(kept.withColumns({"many": F.floor(F.col("entry") / ENTRIES), "one": F.lit(1).cast("long")}), "many", "entry", "one", "row_idx")
    return kept.orderBy("file", "row_idx").select("row_idx", F.col("k").alias(key), F.col("v").alias(value))


def read_folds(spark: SparkSession, path: str, split: str) -> DataFrame:
    """``split, fold, ordinal`` of a JSON list of ordinals, or of lists of them, in its order; a flat list is fold 0.

    A file is split at byte ranges: its fold is the number of lists that closed before an ordinal. What isn't such a
    list is an error.
    """
    closed = F.length("value") - F.length(F.replace("value", F.lit("]"), F.lit("")))
    rows = _before(_pieces(spark, path, ",").withColumn("step", closed.cast("long")), "block", "at", "step", "fold")
    number = F.regexp_extract("value", r"-?\d+", 0)
    good = F.col("value").rlike(r"\A[\s\[]*(-?\d+)?[\s\]]*\z")
    rows = rows.where(_sure(good, number != "", "not a list of ordinals")).orderBy("file", "block", "at")
    return rows.select(F.lit(split).alias("split"), F.col("fold").cast("int").alias("fold"), number.cast("long").alias("ordinal"))


def read_matrix(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``row_idx, values`` from Parquet, or from CSV lines of a row's number and its cells.

    In CSV a blank cell is null, ``nan`` is NaN, a first line that starts with ``row_idx`` is a header; what isn't a number is an error.
    """
    if fmt == "parquet":
        return spark.read.schema("row_idx long, values array<double>").parquet(path)
    if fmt != "csv":
        raise ValueError(f"a matrix is read from parquet or csv, not {fmt}")
    cells = F.transform(F.split("value", ",", -1), lambda c: F.trim(c))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"\A\s*(row_idx\s*(,.*)?)?\z")).select(cells.alias("c"))
    number = lambda c: F.when(F.lower(c) == "nan", F.lit(float("nan"))).when(c != "", c.cast("double"))
    return lines.select(F.col("c")[0].cast("long").alias("row_idx"), F.transform(F.slice("c", 2, 1 << 30), number).alias("values"))


def write_matrix(df: DataFrame, path: str, force: bool = False) -> None:
    """``row_idx, values`` as CSV lines, as ``read_matrix`` takes them: null cells are blank."""
    cells = F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    cells = F.when(F.size("values") > 0, cells)
    write(df.select(F.concat_ws(",", F.col("row_idx").cast("string"), cells).alias("value")), path, fmt="text", force=force)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote ``path`` ended: its last act is to leave the marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write(df: DataFrame, path: str, *, fmt: str = "parquet", force: bool = False, partition_by: tuple[str, ...] = (), **options) -> None:
    """Write ``df``; an output that is whole is left as it is unless ``force``. One without its end's marker, as a lost driver leaves it, is written again."""
    if not force and finished(df.sparkSession, path):
        return
    writer = df.write.mode("overwrite").options(**options).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_pairs(df: DataFrame, path: str, force: bool = False) -> None:
    write(df.select("compound_iso_smiles", "target_id", "target_sequence", "affinity"), path, fmt="csv", force=force, **CSV)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS).csv(path, **CSV)


def write_features(df: DataFrame, path: str, force: bool = False) -> None:
    write(df.select(*[F.col(c).cast("string") for c in FEATURES]), path, fmt="csv", force=force, **CSV)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The 18 feature columns as text, missing values as blanks."""
    return spark.read.schema(", ".join(f"{c} string" for c in FEATURES)).csv(path, **CSV).na.fill("")


def write_samples(df: DataFrame, path: str, force: bool = False) -> None:
    """Model samples with array columns, as Parquet."""
    write(df, path, force=force)


def write_explanations(df: DataFrame, path: str, force: bool = False) -> None:
    """Explanations as CSV; list columns become JSON text."""
    columns = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    write(df.select(*columns), path, fmt="csv", force=force, **CSV)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, ``spark.checkpoint.dir``; only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/.shared"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted, not broadcast.

    Spark takes a table for as large as its compressed files, and what a batch function makes of it for no larger; a side
    that grows with the data would be gathered in the driver by mistake.
    """
    return df.hint("merge")


def tasks(df: DataFrame) -> int:
    """In how many tasks ``df``'s rows are dealt: as many as keep a task's rows, and so its memory, the same at any size. Counts the rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, number: int | None, *keys: str) -> DataFrame:
    """``df`` by its keys in ``number`` tasks; without one it is left to Spark, whose tasks take more rows of a larger table."""
    return df if number is None else df.repartition(number, *keys)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is used more than once is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
