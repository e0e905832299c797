"""Writers."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from tellmark import config as cfg
from tellmark.config import VectorSpec
from tellmark.functions.text import output_tag
from tellmark.operators.boosting import BoostedTrees
from tellmark.operators.learn import Features
from tellmark.operators.svm import Margins


def write_generated(df: DataFrame, path: str) -> None:
    """Append accepted rows in the fixed column order, one folder per model."""
    (
        df.select(*cfg.GENERATED_COLUMNS, output_tag(F.col("model")).alias("model_tag"))
        .write.mode("append").partitionBy("model_tag").parquet(path)
    )


def write_failures(df: DataFrame, path: str) -> None:
    df.select("cell_id", "rep_index", "hotel", "model", "error", "timestamp").write.mode(
        "append"
    ).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A result frame as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, key: str = "id") -> None:
    """Row ids with their split. Ids, not positions, so the split can be joined back."""
    df.select(key, "split").write.mode("overwrite").parquet(path)


MODELS = {m.__name__: m for m in (Margins, BoostedTrees)}


def write_model(fitted: Margins | BoostedTrees, feats: Features, path: str) -> None:
    """A fitted model with all that scoring new texts needs: the vocabulary, and the limits of the
    vectoriser."""
    spark = feats.vectors.sparkSession
    feats.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    row = (type(fitted).__name__, fitted.text(), json.dumps(asdict(feats.spec)))
    spark.createDataFrame([row], "kind string, model string, spec string").write.mode("overwrite").parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> tuple[Margins | BoostedTrees, DataFrame, VectorSpec]:
    """The model ready to score, its vocabulary, and the limits its vectoriser had."""
    row = spark.read.parquet(f"{path}/model").first()
    spec = json.loads(row["spec"])
    return MODELS[row["kind"]].read(row["model"]), spark.read.parquet(f"{path}/vocabulary"), VectorSpec(**{**spec, "ngrams": tuple(spec["ngrams"])})
