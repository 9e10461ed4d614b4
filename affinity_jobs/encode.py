"""Sequences, categories and numbers as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: residue letters by code, from 1; 0 is padding or unknown.
ALPHABET = "ABCDEFGHIKLMNOPQRSTUVWXYZ"
NUMERIC = ["has_structure", "pocket_hydrophobicity", "pocket_charge", "activation_loop_state"]
CATEGORIES = ["kinase_group", "kinase_family", "kinase_subfamily", "dfg_state", "ac_helix_state"]
SEQUENCE, POCKET, HINGE, GATE = 1000, 85, 3, 1
#: The most values of a category.
WIDTH = 10_000


def numeric_or_zero(c: Column) -> Column:
    """The number in a text; 0 where it is missing or blank."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(text == "", F.lit(0.0)).otherwise(F.when(text != "", text).cast("double"))


def sequence(c: Column, n: int, strict: bool = True) -> Column:
    """The first n letters as codes, filled with 0. A letter without code is an error if strict, else 0."""
    letters = F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), 1, n)

    def code(x: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), x)
        return F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("no code for letter "), x))).cast("int") if strict else at

    codes = F.transform(letters, code)
    return F.concat(codes, F.array_repeat(F.lit(0), F.lit(n) - F.size(letters)))


def vocabularies(df: DataFrame, columns: list[str] = CATEGORIES, width: int = WIDTH) -> DataFrame:
    """One row with the sorted distinct values of each column; missing ones are blanks and count.

    A column of more than ``width`` values is an error: it makes no vector.
    """
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    counts = df.agg(*[F.count_distinct(v).alias(c) for c, v in values.items()]).first().asDict()
    if wide := {c: n for c, n in counts.items() if n > width}:
        raise ValueError(f"too many values for one-hot vectors (more than {width}): {wide}")
    return df.agg(*[F.sort_array(F.collect_set(v)).alias(c) for c, v in values.items()])


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def one_hot(value: Column, vocabulary: Column) -> Column:
    """1 at the value's place; all 0 where it is not there."""
    return F.transform(vocabulary, lambda v: F.coalesce((v == value).cast("float"), F.lit(0.0).cast("float")))


def one_of_k(value: Column, allowed: list, unknown: str = "error") -> Column:
    """One-hot over a fixed list; a value that isn't in it is an error, or the last place if ``unknown`` is "last"."""
    options = F.array(*[F.lit(a) for a in allowed])
    known = F.coalesce(F.array_contains(options, value), F.lit(False))
    other = F.lit(allowed[-1]) if unknown == "last" else F.raise_error(F.concat(F.lit("not allowed: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string" if isinstance(allowed[0], str) else "int")
    return once(F.when(known, value).otherwise(other), lambda v: one_hot(v, options))


def target_vector(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``target_id, protein_feat``: four numbers, then five one-hots."""
    return with_vector(df, vocabulary).select("target_id", "protein_feat")


def with_vector(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``df`` with ``protein_feat``."""
    words = vocabulary.select(*[F.col(c).alias(f"_v_{c}") for c in CATEGORIES])
    rows = df.join(F.broadcast(words))  # one row, whose width `vocabularies` checks
    numbers = F.array(*[numeric_or_zero(F.col(c)).cast("float") for c in NUMERIC])
    vector = F.concat(numbers, *[one_hot(F.coalesce(F.col(c), F.lit("")), F.col(f"_v_{c}")) for c in CATEGORIES])
    return rows.withColumn("protein_feat", vector).drop(*words.columns)


def target_codes(df: DataFrame) -> DataFrame:
    """``target_id`` with the code vectors of pocket, gatekeeper and hinge."""
    return df.select("target_id", *code_columns())


def code_columns() -> list[Column]:
    """The code vectors of pocket, gatekeeper and hinge, of a row's own columns."""
    given = {"pocket": ("klifs_85_residue_sequence", POCKET), "gatekeeper": ("gatekeeper_residue", GATE), "hinge": ("hinge_residues", HINGE)}
    return [sequence(F.col(c), n, False).alias(name) for name, (c, n) in given.items()]


def attach_targets(pairs: DataFrame, features: DataFrame, strict: bool = True, key: str = "target_id") -> DataFrame:
    """Pairs with their target's columns. If strict, a target without features is an error when rows are read."""
    out = pairs.join(features.withColumn("_found", F.lit(True)), key, "left" if strict else "inner")
    if strict:
        out = out.withColumn(key, F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no features for target "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(pairs.schema[key].dataType)))
    return out.drop("_found")
