"""The corpus pipeline: stages over documents, each written as Parquet and read back for the next.

A stage takes all rows that the one before it kept and returns the columns of ``documents``; the last returns
digests of the encoded texts. Null ids are kept as documents of their own; rows repeated with one id are each
kept or dropped like any other; columns that a stage doesn't know pass through it, whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity_jobs.llm import bpe, langid, mixing, near_dedup, suffix_dedup
from affinity_jobs.llm.common import cut, fold, free_names, remove, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that training documents have; a null ``lang`` becomes the language found.

    Null and empty texts and those without a letter go, and so do foreign ones: texts of 40 letters or more that
    need over twice as many phrases a letter as any training window of their best language. Ties go to the first
    language by code point. If no document has a language, only texts without a letter go.
    """
    model = langid.fit(docs.where(fold(F.col("doc_id")) != 0))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_names(["found"], docs.columns)["found"]
    known = docs.withColumn(name, langid.found(model, F.col("text"), spark)).where(f"{name}.lang_pred != 'und' AND NOT {name}.foreign")
    return known.withColumn("lang", F.coalesce("lang", f"{name}.lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one of least id.

    Null and empty texts have no duplicates. Rows repeated with the id and text that stay all stay; of different texts
    with one id each is judged by itself.
    """
    kept = near_dedup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("code").alias("hash")).distinct()
    stays = (docs["doc_id"] == kept["id"]) & (F.xxhash64(docs["text"]) == kept["hash"])
    return docs.join(kept, stays, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier; ``n_chars`` follows. A text that is all repeats goes."""
    out = suffix_dedup.deduplicate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, one row per pass, in training order; documents without words go."""
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; a null text is an empty one."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Suffix sorting, language models and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. What the stages wrote on the way is removed stage by stage."""
    docs = table(spark, sf_dir, "documents")
    before = set(written())
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        output = written()[-1]
        remove(spark, [p for p in written() if p not in before and p != output])
    return STAGES[-1][1](spark, docs, sf_dir)
