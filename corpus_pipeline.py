"""From raw documents to packed sequences: five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last return the columns of
the documents. Null ids stay with their rows: the line stage compares no documents without an id, the
near-duplicate stage knows texts of null and of shared ids by a number.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tellmark.llm import jaccard, langid, lines, packing, substrings
from tellmark.llm.common import boxed, free_name, join_checked, scratch_path, stored, unboxed

#: No SQL follows trained language models, patience alignment or the packing; tests hold the stages
#: against plain versions.
ORACLE_SQL = None

#: Rows that pass to a Python worker at once in all stages: whole texts and all columns, so a few megabytes.
BATCH_ROWS = 1000


def small_batches(stage):
    """A stage under ``BATCH_ROWS``. Workers and executors hold several copies of a batch, and the settings that
    a write sees are those of its session, so it stays set."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        least = min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(least if least > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without letters. The models learn
    from the documents at hand whose language is known."""
    trees = langid.train(docs)
    if trees is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang = free_name(docs, "lang_found")
    found = langid.attach(docs, trees, lang=lang, score=free_name(docs, "lang_score"))
    return found.where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete lines aligned with an earlier document; documents that keep no line leave."""
    left = free_name(docs, "lines_left")
    return lines.clean(docs, left=left).where(F.col(left) > 0).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near duplicates."""
    named, name, _ = jaccard.named(docs)
    kept = jaccard.judged(named, key=name).where("kept").groupBy(name).agg(F.count(F.lit(1)).alias("_rows"))
    kept = stored(kept.select(F.col(name).alias("_kept"), "_rows"), "kept")
    rows = boxed(named, "text").withColumn("_kept", F.col("_row").getField(name).cast("long"))
    rows = join_checked(rows, kept, "_kept", "inner", 32)
    once = unboxed(rows.where("_rows = 1"), docs.columns, "text", F.col("_text"))
    # equal rows of an id: one of them stays
    several = rows.where("_rows > 1").groupBy("_kept").agg(F.min(F.struct("_text", "_row")).alias("_one"))
    return once.unionByName(unboxed(several.select("_one.*"), docs.columns, "text", F.col("_text")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out word windows that also start earlier; documents that keep no word leave."""
    left = free_name(docs, "words_left")
    return substrings.clean(docs, left=left).where(F.col(left) > 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", small_batches(language)),
    ("lines", small_batches(line_dedup)),
    ("near_duplicates", small_batches(near_dedup)),
    ("substrings", small_batches(substring_dedup)),
    ("packing", small_batches(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
