"""Readers. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

from tellmark import config as cfg


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CORPUS_SCHEMA = _schema(
    Binary_label=T.StringType(),
    Category=T.StringType(),
    domain=T.StringType(),
    text=T.StringType(),
    is_synthetic=T.IntegerType(),
    source=T.StringType(),
)

_INTS = {
    "is_synthetic", "rep_index", "n_chars", "n_words", "target_chars",
    "in_length_band", "n_attempts", "gen_seed",
}
_OTHER = {"gen_temperature": T.DoubleType(), "timestamp": T.TimestampType()}
GENERATED_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c in _INTS else _OTHER.get(c, T.StringType()))
        for c in cfg.GENERATED_COLUMNS
    ]
)

FAILURE_SCHEMA = _schema(
    cell_id=T.StringType(),
    rep_index=T.IntegerType(),
    hotel=T.StringType(),
    model=T.StringType(),
    error=T.StringType(),
    timestamp=T.TimestampType(),
)


def require_columns(df: DataFrame, names: Iterable[str] = cfg.REQUIRED_CORPUS_COLUMNS) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing expected columns: {missing}")
    return df


def read_corpus(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CORPUS_SCHEMA,
    required: Iterable[str] = cfg.REQUIRED_CORPUS_COLUMNS,
    multi_line: bool = False,
) -> DataFrame:
    """A labelled corpus from CSV or parquet.

    The header decides which of the declared columns exist, in which order. All files of a
    folder must share one header: reading fails at a file whose header differs. With
    ``multi_line``, quoted fields may span lines, and a file is one task; store large corpora as
    parquet.
    """
    if path.rstrip("/").endswith(".parquet"):
        return require_columns(spark.read.parquet(path), required)
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    declared = {f.name: f.dataType for f in schema.fields}
    actual = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
    return require_columns(spark.read.schema(actual).options(**options).csv(path), required)


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENERATED_SCHEMA).parquet(path).select(*cfg.GENERATED_COLUMNS)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE_SCHEMA).json(path)
