"""Compliance and style reports. Each is one aggregation over per-row flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tellmark import config as cfg
from tellmark.functions import text as tx
from tellmark.functions.hashing import hash_number, key_hash
from tellmark.operators.audit import count_if
from tellmark.plans.scaling import fan_out, rank_cuts
from tellmark.session import settle

STYLE_FLAGS = {
    "starts_with_i": lambda c: tx.opener_word(c) == "i",
    "starts_with_first_person": lambda c: tx.opener_word(c).isin("i", "we", "my", "our"),
    "contains_em_dash": lambda c: c.contains("—"),
    "contains_en_dash": lambda c: c.contains("–"),
    "contains_spaced_hyphen": lambda c: c.contains(" - "),
    "contains_hyphen": lambda c: c.contains("-"),
    "contains_semicolon": lambda c: c.contains(";"),
}


def rows(df: DataFrame):
    """Row count as an uncorrelated scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def pct(flag):
    return 100 * F.avg(flag.cast("double"))


# ---- instruction compliance ----------------------------------------------


def length_report(gen: DataFrame) -> DataFrame:
    return gen.groupBy("length").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("n_chars").alias("mean_chars"),
        pct(F.col("in_length_band")).alias("pct_in_band"),
        F.avg("n_attempts").alias("mean_attempts"),
    )


def length_adherence(gen: DataFrame, floor: float = cfg.AttemptSpec().adherence_floor) -> DataFrame:
    """One row; ``poor`` is 1 when less than ``floor`` of the rows are in band."""
    return gen.agg(
        F.count(F.lit(1)).alias("n"), F.avg("in_length_band").alias("in_band")
    ).withColumn("poor", (F.col("in_band") < floor).cast("int"))


def sentiment_agreement(judged: DataFrame) -> DataFrame:
    """Per requested sentiment: rows, verdicts that agree, judge errors."""
    agreed = count_if(F.col("verdict") == F.col("sentiment"))
    return judged.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        agreed.alias("agreed"),
        (100 * agreed / F.count(F.lit(1))).alias("pct_agreed"),
        count_if(F.col("verdict").startswith("error")).alias("errors"),
    )


def with_aspect_hits(df: DataFrame, patterns=None, text: str = "text") -> DataFrame:
    """``mentioned`` (aspect names) and ``n_mentioned``."""
    return df.withColumn("mentioned", tx.aspect_hits(F.col(text), patterns)).withColumn(
        "n_mentioned", F.size("mentioned")
    )


def aspect_coverage(instructed: DataFrame, patterns=None) -> DataFrame:
    """Asked and covered aspects, per length and overall (``length`` = 'all').

    ``instructed`` carries the text and the ``aspects`` it was asked for; rows without any are
    left out.
    """
    asked = with_aspect_hits(instructed.where(F.size("aspects") > 0), patterns)
    counted = asked.select(
        "length",
        F.size("aspects").alias("asked"),
        F.size(F.array_intersect("aspects", "mentioned")).alias("hit"),
    )
    return (
        counted.rollup("length")
        .agg(F.sum("asked").alias("asked"), F.sum("hit").alias("hit"), F.grouping_id().alias("_g"))
        .where(F.col("asked").isNotNull())
        .select(
            F.when(F.col("_g") == 1, "all").otherwise(F.col("length")).alias("length"),
            "asked", "hit", (100 * F.col("hit") / F.col("asked")).alias("pct"),
        )
    )


def aspect_mentions(gen: DataFrame, patterns=None) -> DataFrame:
    return with_aspect_hits(gen, patterns).groupBy("structure").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_mentioned").alias("mean_aspects")
    )


def opener_compliance(gen: DataFrame) -> DataFrame:
    return gen.groupBy("opener_move").agg(
        F.count(F.lit(1)).alias("n"),
        pct(tx.opener_ok(F.col("text"), F.col("opener_move"))).alias("pct_ok"),
    )


# ---- style against reference classes -------------------------------------


def stylometry(df: DataFrame, classes: tuple[str, ...], text: str = "text") -> DataFrame:
    """Percentage of texts with each style flag, classes side by side.

    One pass; the pivot then works on one row per class.
    """
    flags = df.select("class", *[f(F.col(text)).cast("int").alias(m) for m, f in STYLE_FLAGS.items()])
    rates = flags.groupBy("class").agg(*[pct(F.col(m)).alias(m) for m in STYLE_FLAGS])
    return (
        rates.unpivot("class", list(STYLE_FLAGS), "metric", "pct")
        .groupBy("metric").pivot("class", list(classes)).agg(F.first("pct"))
    )


def top_openers(df: DataFrame, k: int = 6, text: str = "text") -> DataFrame:
    """The ``k`` most frequent opening words; ties by word."""
    return (
        df.groupBy(tx.opener_word(F.col(text)).alias("opener"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "opener").limit(k)
    )


def opener_bootstrap(
    gen: DataFrame, reference: DataFrame, key: str, seed: int = 0, draws: int = 200, text: str = "text"
) -> DataFrame:
    """Is the number of distinct openers in ``gen`` within the 95% range of equally large
    samples, drawn without replacement, of ``reference``?

    Draw i orders the reference by a hash of (seed, i, key) and takes the first n rows. The
    n-th hash is looked up per draw, and an opener is in the sample when its smallest hash
    does not exceed it, so only (draw, opener) minima are shuffled, never the samples. The
    texts are read once, into stored (key, opener) rows.
    """
    own = gen.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(tx.opener_word(F.col(text))).alias("openers")
    ).first()
    openers = settle(
        reference.select(F.col(key).alias("_key"), tx.opener_word(F.col(text)).alias("opener"))
    )
    n = own["n"]
    if n > openers.count():
        raise ValueError(f"a sample of {n} needs a reference of at least as many texts")
    drawn = (
        fan_out(openers, "_key").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("_h", hash_number(key_hash(seed, F.col("draw"), F.col("_key")), 15))
    )
    cuts = drawn.sparkSession.createDataFrame(  # one row per draw
        [(c["draw"], c["cut"]) for c in rank_cuts(drawn, "draw", "_h", {"cut": F.lit(n)}, F.shiftright("_h", 48))],
        "draw int, cut long",
    )
    seen = (
        drawn.groupBy("draw", "opener").agg(F.min("_h").alias("_first"))
        .join(F.broadcast(cuts), "draw")
        .where(F.col("_first") <= F.col("cut"))
    )
    return (
        seen.groupBy("draw").agg(F.count(F.lit(1)).alias("distinct"))
        .agg(
            F.percentile("distinct", F.lit(0.025)).alias("lo"),
            F.percentile("distinct", F.lit(0.975)).alias("hi"),
        )
        .select(
            F.lit(n).cast("long").alias("n_sample"),
            F.lit(own["openers"]).cast("long").alias("observed"), "lo", "hi",
        )
        .withColumn("inside", F.col("observed").between(F.col("lo"), F.col("hi")).cast("int"))
    )


def char_document_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts per class that contain each non-space character. Characters are made distinct
    inside the row, so what shuffles is bounded by the alphabet."""
    return (
        df.select("class", F.explode(tx.distinct_characters(F.col(text))).alias("ch"))
        .where(F.col("ch") != "")
        .groupBy("class", "ch").agg(F.count(F.lit(1)).alias("n_texts"))
    )


def perfect_separators(df: DataFrame, generated: str, text: str = "text") -> DataFrame:
    """Characters of the generated class that occur in no text of any other class."""
    total = rows(df.where(F.col("class") == generated))
    own = F.col("class") == generated
    return (
        char_document_frequency(df, text)
        .groupBy("ch")
        .agg(
            F.sum(F.when(own, F.col("n_texts"))).alias("n_texts"),
            F.sum(F.when(~own, F.col("n_texts"))).alias("_other"),
        )
        .where(F.col("n_texts").isNotNull() & F.col("_other").isNull())
        .select(
            "ch", tx.code_point(F.col("ch")).alias("code_point"), "n_texts",
            (100 * F.col("n_texts") / total).alias("pct"),
        )
    )


# ---- hygiene --------------------------------------------------------------


def language_purity(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(tx.stray_characters(F.col(text)) != "").alias("n_impure"),
    )


def impure_rows(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("stray", tx.stray_characters(F.col(text))).where(F.col("stray") != "")


def hygiene_report(gen: DataFrame, human: DataFrame) -> DataFrame:
    """One row: leaks, disclosures, exact duplicates, categories used out of all categories of
    the human corpus, and their spread."""
    digest = F.md5("text")
    text = gen.agg(
        count_if(tx.preamble_leak(F.col("text"))).alias("preamble_leaks"),
        count_if(tx.self_disclosure(F.col("text"))).alias("disclosures"),
        (F.count(digest) - F.countDistinct(digest)).alias("duplicates"),
    )
    spread = gen.groupBy("Category").agg(F.count(F.lit(1)).alias("n")).agg(
        F.struct(
            F.count("Category").alias("categories"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
        )
    ).scalar()
    known = human.agg(F.countDistinct("Category")).scalar()
    return text.withColumn("_s", spread).select("*", "_s.*", known.alias("known_categories")).drop("_s")


def copy_report(copies: DataFrame, warn_above: int = 5) -> DataFrame:
    """Summary of ``ngram_copy``: rows seen, rows with any copy, worst row."""
    return copies.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col("n_copied") > 0).alias("n_with_copy"),
        F.max("n_copied").cast("long").alias("max_copied"),
    ).withColumn("warn", F.coalesce((F.col("max_copied") > warn_above).cast("int"), F.lit(0)))


def dataset_gate(df: DataFrame, generated: str, text: str = "text") -> DataFrame:
    """One row: passed only without separators and without impure generated rows."""
    impure = language_purity(df.where(F.col("class") == generated), text).select("n_impure").scalar()
    return (
        perfect_separators(df, generated, text)
        .agg(F.count(F.lit(1)).alias("n_separators"))
        .withColumn("n_impure", impure)
        .withColumn("passed", ((F.col("n_separators") == 0) & (F.col("n_impure") == 0)).cast("int"))
    )


def require_gate(gate: DataFrame) -> DataFrame:
    found = gate.first()
    if not found["passed"]:
        raise ValueError(
            f"dataset gate failed: {found['n_separators']} separators, {found['n_impure']} impure rows"
        )
    return gate


# ---- counts ---------------------------------------------------------------


def cell_counts(gen: DataFrame) -> DataFrame:
    """Rows per cell and the target its highest repetition implies."""
    return gen.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max("rep_index") + 1).cast("long").alias("target")
    )


def failure_breakdown(failures: DataFrame) -> DataFrame:
    return failures.groupBy("cell_id", "error").agg(F.count(F.lit(1)).alias("n"))
