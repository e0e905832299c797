"""Integrity checks, corpus audit and leakage findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tellmark.functions.text import strip


def count_if(condition):
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def null_audit(df: DataFrame, columns: Iterable[str] = ("text", "label")) -> DataFrame:
    """One row: rows and nulls per column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def require_clean(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Raise unless text and label are complete and the label has exactly two values."""
    found = df.agg(
        count_if(F.col(text).isNull() | F.col(label).isNull()).alias("missing"),
        F.countDistinct(label).alias("classes"),
    ).first()
    if found["missing"]:
        raise ValueError("some rows have no text or no label")
    if found["classes"] != 2:
        raise ValueError(f"the label has {found['classes']} values, not 2")
    return df


def drop_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.na.drop(subset=[text])


def normalize_labels(
    df: DataFrame, positive: str = "fake", text: str = "text", label: str = "label", out: str = "y"
) -> DataFrame:
    """Strip the text and add the 0/1 label; every value but ``positive`` is 0."""
    return df.withColumn(text, strip(F.col(text))).withColumn(
        out, (F.lower(F.col(label)) == positive.lower()).cast("int")
    )


def source_label_crosstab(
    df: DataFrame, labels: Iterable[str] = ("fake", "real"), source: str = "source", label: str = "label"
) -> DataFrame:
    """Zero-filled counts. Known labels make this one aggregation."""
    return df.groupBy(source).agg(*[count_if(F.col(label) == v).alias(v) for v in labels])


def corpus_audit(
    df: DataFrame, labels: tuple[str, ...] = ("fake", "real"), text: str = "text"
) -> DataFrame:
    """Long rows ``metric, key1, key2, value``: size, classes, missing, duplicates, crosstab.

    Two scans: one over the text (counted by digest, so whole texts never shuffle), one over
    source and label alone.
    """

    def entry(metric, key1, key2, value):
        return F.struct(
            F.lit(metric).alias("metric"), key1.alias("key1"), key2.alias("key2"),
            value.cast("long").alias("value"),
        )

    none = F.lit("")
    digest = F.md5(F.col(text))
    sizes = df.agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col(text).isNull() | F.col("label").isNull()).alias("missing"),
        (F.count(digest) - F.countDistinct(digest)).alias("dup"),
    ).select(
        F.explode(
            F.array(
                entry("n_rows", none, none, F.col("n")),
                entry("missing_values", none, none, F.col("missing")),
                entry("duplicate_texts", none, none, F.col("dup")),
            )
        ).alias("e")
    )
    table = source_label_crosstab(df, labels)
    cells = table.select(
        F.explode(
            F.array(*[entry("source_by_label", F.col("source"), F.lit(v), F.col(v)) for v in labels])
        ).alias("e")
    )
    classes = (
        table.agg(*[F.sum(v).alias(v) for v in labels])
        .select(F.explode(F.array(*[entry("class_count", F.lit(v), none, F.col(v)) for v in labels])).alias("e"))
    )
    return sizes.unionByName(classes).unionByName(cells).select("e.*")


def leakage_scan(
    df: DataFrame, columns: Iterable[str], label: str = "label", unique_ratio: float = 0.5
) -> DataFrame:
    """Per column: constant, perfect predictor of the label, predictor by null pattern.

    Null is a value of its own. A column with nearly one value per row predicts anything, so
    ``near_unique`` stands beside the raw ``perfect_predictor`` flag. The first aggregation
    combines on the map side, so a constant column costs one row per task.
    """
    pairs = df.select(
        F.xxhash64(label).alias("_label"),  # only compared; a number aggregates by hash
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("p"),
    ).select("_label", "p.*")
    by_value = pairs.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("_label").alias("lo"), F.max("_label").alias("hi")
    )
    null = F.col("value").isNull()
    scan = by_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_values"),
        F.max((F.col("lo") != F.col("hi")).cast("int")).alias("_mixed"),
        F.min(F.when(null, F.col("lo"))).alias("_nlo"),
        F.max(F.when(null, F.col("hi"))).alias("_nhi"),
        F.min(F.when(~null, F.col("lo"))).alias("_vlo"),
        F.max(F.when(~null, F.col("hi"))).alias("_vhi"),
    )
    unique = F.col("n_values") > unique_ratio * F.col("n_rows")
    by_null = (
        (F.col("_nlo") == F.col("_nhi")) & (F.col("_vlo") == F.col("_vhi"))
        & (F.col("_nlo") != F.col("_vlo"))
    )
    return scan.select(
        "column", "n_rows", "n_values",
        (F.col("n_values") == 1).cast("int").alias("is_constant"),
        unique.cast("int").alias("near_unique"),
        ((F.col("_mixed") == 0) & (F.col("n_values") > 1)).cast("int").alias("perfect_predictor"),
        F.coalesce(by_null, F.lit(False)).cast("int").alias("null_predictor"),
    )


def drop_leaky(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def merge_corpora(human: DataFrame, generated: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is null there."""
    return human.unionByName(generated, allowMissingColumns=True)


def split_overlap(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts present in more than one split."""
    flags = [F.max((F.col("split") == s).cast("int")).alias(f"in_{s}") for s in ("train", "validation", "test")]
    return (
        df.groupBy(F.md5(F.col(text)).alias("text_md5"))
        .agg(F.count(F.lit(1)).alias("n_rows"), *flags)
        .where(F.col("in_train") + F.col("in_validation") + F.col("in_test") > 1)
    )
