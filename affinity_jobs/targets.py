"""Kinase and pocket features of proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import FEATURES

# Residue classes and pocket positions.
HYDROPHOBIC = "AVLIMFWYPCG"
POSITIVE = "KRH"
NEGATIVE = "DE"
GATEKEEPER = 45
HINGE_START, HINGE_END = 46, 48


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_resolved(row_id: Column) -> Column:
    """Whether a kinase id is there and not blank."""
    return row_id.isNotNull() & (F.trim(row_id.cast("string")) != "")


def normalize_name(name: Column) -> Column:
    """A target's name without white space, state suffix and bracketed part, in capitals."""
    plain = F.regexp_replace(F.trim(name), r"\s+", "")
    plain = F.when(plain.endswith("p") & plain.contains("("), F.regexp_replace(plain, "p$", "")).otherwise(plain)
    return F.upper(F.replace(F.regexp_replace(plain, r"\([^)]*\)", ""), F.lit("/"), F.lit("-")))


def with_alias(df: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Names replaced by ``aliases(alias, name)`` where they have one."""
    found = df.join(aliases.dropDuplicates(["alias"]).select(F.col("alias").alias("_alias"), F.col("name").alias("_name")), F.col(column) == F.col("_alias"), "left")
    return found.withColumn(column, F.coalesce("_name", column)).drop("_alias", "_name")


def resolve_kinases(targets: DataFrame, kinases: DataFrame, overrides: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Targets with their first kinase record (by ``pos``), by override of the raw id or else by name."""
    named = targets.withColumn("_key", normalize_name(F.col("target_id")))
    if aliases is not None:
        named = with_alias(named, aliases, "_key")
    if overrides is not None:
        extra = overrides.dropDuplicates(["target_id"]).select(F.col("target_id").alias("_raw"), F.col("kinase_name").alias("_given"))
        named = named.join(extra, F.col("target_id") == F.col("_raw"), "left").withColumn("_key", F.coalesce(F.upper("_given"), "_key")).drop("_raw", "_given")
    human = kinases.where(F.upper("species") == "HUMAN")
    rest = [c for c in human.columns if c not in ("pos", "kinase_name", "species")]
    first = human.groupBy(F.upper("kinase_name").alias("_key")).agg(F.min_by(F.struct(*rest), "pos").alias("_k")).select("_key", "_k.*")
    return named.join(first, "_key", "left").drop("_key")


def best_structure(structures: DataFrame, key: str = "kinase_ID") -> DataFrame:
    """Each kinase's best structure: quality falling, resolution rising, then ``pos``; 0 and null count as missing."""
    quality = F.when(F.coalesce(F.col("quality_score"), F.lit(0.0)) != 0, F.col("quality_score")).otherwise(F.lit(float("-inf")))
    resolution = F.when(F.coalesce(F.col("resolution"), F.lit(0.0)) != 0, F.col("resolution")).otherwise(F.lit(float("inf")))
    rest = [c for c in structures.columns if c != key]
    best = structures.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-quality).alias("q"), resolution.alias("r"), F.col("pos"))).alias("_s"))
    return best.select(key, "_s.*")


def attach_best_structure(targets: DataFrame, structures: DataFrame) -> DataFrame:
    return targets.join(best_structure(structures).drop("pos"), "kinase_ID", "left")


def normalize_pocket(pocket: Column) -> Column:
    return F.translate(F.trim(F.coalesce(pocket, F.lit(""))), "-", "_")


def pocket_letters(pocket: Column) -> Column:
    return F.regexp_replace(pocket, r"[^\p{L}]", "")


def pocket_summary(letters: Column) -> tuple[Column, Column, Column]:
    """Residue composition, share of hydrophobic residues, and net charge per residue of ``pocket_letters``.

    Give it a column rather than an expression: each kind of letter looks at it once.
    """
    n = F.length(letters)

    def count(residues: str) -> Column:
        return n - F.length(F.translate(letters, residues, ""))

    kinds = F.array_sort(F.array_distinct(F.filter(F.split(letters, ""), lambda c: c != "")))
    parts = F.transform(kinds, lambda c: F.concat(c, F.lit(":"), (n - F.length(F.replace(letters, c, F.lit("")))).cast("string")))
    share = F.when(n > 0, count(HYDROPHOBIC) / n).otherwise(0.0)
    charge = F.when(n > 0, (count(POSITIVE) - count(NEGATIVE)) / n).otherwise(0.0)
    return F.array_join(parts, ";"), share, charge


def gatekeeper_hinge(pocket: Column) -> tuple[Column, Column]:
    """Residues at the gatekeeper's and hinge's places; blank in pockets that end before."""
    long = F.length(pocket) >= HINGE_END
    return F.when(long, F.substring(pocket, GATEKEEPER, 1)).otherwise(""), F.when(long, F.substring(pocket, HINGE_START, HINGE_END - HINGE_START + 1)).otherwise("")


def structure_columns(df: DataFrame) -> DataFrame:
    """Feature columns of rows that have a structure's fields."""
    df = df.withColumn("pocket", normalize_pocket(F.col("pocket"))).withColumn("_letters", pocket_letters(F.col("pocket")))
    pocket = F.col("pocket")
    composition, share, charge = pocket_summary(F.col("_letters"))
    gate, hinge = gatekeeper_hinge(pocket)
    found = is_resolved(F.col("structure_ID"))
    some = lambda c: F.when(found, c).otherwise("")
    columns = {
        "best_structure_klifs_id": some(text_or_blank(F.col("structure_ID"))), "best_structure_pdb_id": some(text_or_blank(F.col("pdb"))), "has_structure": F.when(found, "1").otherwise("0"),
        "klifs_85_residue_sequence": some(pocket), "gatekeeper_residue": some(gate), "hinge_residues": some(hinge), "pocket_residue_composition": some(composition),
        "pocket_hydrophobicity": some(share.cast("string")), "pocket_charge": some(charge.cast("string")), "dfg_state": some(text_or_blank(F.col("DFG"))),
        "ac_helix_state": some(text_or_blank(F.col("aC_helix"))), "activation_loop_state": some(text_or_blank(F.col("Grich_rotation"))),
    }
    return df.withColumns(columns).drop("_letters")


def with_defaults(df: DataFrame) -> DataFrame:
    """All 18 feature columns as text: blanks where missing, 0 for ``has_structure``."""
    have = set(df.columns)
    value = lambda c: text_or_blank(F.col(c)) if c in have else F.lit("")
    return df.select(*[(F.when(value(c) == "", "0").otherwise(value(c)) if c == "has_structure" else value(c)).alias(c) for c in FEATURES])


def feature_table(proteins: DataFrame, kinases: DataFrame, structures: DataFrame, **options) -> DataFrame:
    """The feature table of ``proteins(target_id, target_sequence)``."""
    rows = attach_best_structure(resolve_kinases(proteins.select("target_id", "target_sequence"), kinases, **options), structures)
    named = structure_columns(rows).withColumns({"kinase_group": F.col("group"), "kinase_family": F.col("family"), "kinase_subfamily": F.col("kinase_class"), "klifs_kinase_id": F.col("kinase_ID")})
    return with_defaults(named)


def fill_from_donors(rows: DataFrame, donors: list[DataFrame], *, resolved: str = "klifs_kinase_id", sequence: str = "target_sequence", ident: str = "target_id", pos: str | None = None) -> DataFrame:
    """Unresolved rows take all feature columns of the first resolved donor with their sequence.

    Donor tables come first in order, then the rows themselves. Sequences are matched by hash and text;
    blank sequences match nothing.
    """
    features = [c for c in rows.columns if c not in (ident, sequence, pos)]
    order = pos or ident
    pool = None
    for rank, table in enumerate([*donors, rows]):
        part = table.where(is_resolved(F.col(resolved)) & is_resolved(F.col(sequence))).select(F.lit(rank).alias("_rank"), F.col(order).alias("_order"), F.col(sequence).alias("_seq"), F.struct(*features).alias("_f"))
        pool = part if pool is None else pool.unionByName(part)
    first = pool.groupBy(F.xxhash64("_seq").alias("_h"), "_seq").agg(F.min_by("_f", F.struct("_rank", "_order")).alias("_f"))
    out = rows.withColumn("_k", F.when(~is_resolved(F.col(resolved)) & is_resolved(F.col(sequence)), F.xxhash64(sequence)))
    out = out.join(first, (F.col("_k") == F.col("_h")) & (F.col(sequence) == F.col("_seq")), "left")
    filled = {c: F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c)) for c in features}
    return out.withColumns(filled).select(*rows.columns)
