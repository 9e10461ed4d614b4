"""Affinity matrices to labelled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one window when running totals are taken in two levels.
BLOCK = 10_000


def present(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def pkd(y: Column) -> Column:
    """``-log10(y / 1e9)``: infinity for 0, NaN for negative values, as floating-point rules have it."""
    return F.when(y > 0, -F.log10(y / F.lit(1e9))).when(y == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over rows of smaller ``order`` (a dense long), by totals of blocks and within them."""
    df = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    blocks = df.groupBy("_block").agg(F.sum(amount).alias("_mass"))
    blocks = blocks.select("_block", (F.sum("_mass").over(Window.orderBy("_block")) - F.col("_mass")).alias("_before"))
    inner = F.sum(amount).over(Window.partitionBy("_block").orderBy(order)) - F.col(amount)
    return df.join(blocks, "_block").withColumn(out, (F.col("_before") + inner).cast("long")).drop("_block", "_before")


def melt_matrix(matrix: DataFrame) -> DataFrame:
    """``row_idx, col_idx, value`` of cells that are present."""
    return matrix.select("row_idx", F.posexplode("values").alias("col_idx", "value")).where(present(F.col("value")))


def cell_ordinal(matrix: DataFrame) -> DataFrame:
    """``row_idx, col_idx, ordinal, value``: present cells numbered row by row."""
    kept = matrix.withColumn("kept", F.filter(F.transform("values", lambda v, i: F.struct(i.alias("col_idx"), v.alias("value"))), lambda c: present(c["value"])))
    kept = running_total(kept.select("row_idx", "kept", F.size("kept").cast("long").alias("many")), "row_idx", "many", "first")
    cells = kept.select("row_idx", "first", F.posexplode("kept").alias("at", "cell"))
    return cells.select("row_idx", "cell.col_idx", (F.col("first") + F.col("at")).alias("ordinal"), "cell.value")


def select_fold(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """Cells whose ordinal a fold lists, as often as it lists them."""
    return cells.join(folds, "ordinal")


def label_pairs(cells: DataFrame, ligands: DataFrame, proteins: DataFrame) -> DataFrame:
    """Pairs from cells, ``ligands(row_idx, smiles)`` and ``proteins(col_idx, target_id, target_sequence)``."""
    out = cells.join(ligands, "row_idx").join(proteins, "col_idx")
    rest = [c for c in cells.columns if c not in ("value", "row_idx", "col_idx")]
    return out.select(*rest, F.col("smiles").alias("compound_iso_smiles"), "target_id", "target_sequence", F.col("value").alias("affinity"))


def summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs, distinct drugs and distinct targets of each key."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("compound_iso_smiles").alias("n_drugs"), F.count_distinct("target_id").alias("n_targets"))


def all_sequences(datasets: list[DataFrame]) -> DataFrame:
    """Each dataset's distinct sequences, one dataset after the other."""
    return reduce(DataFrame.unionByName, [d.select("target_sequence").distinct() for d in datasets])
