"""Incremental collection: grade arriving texts and append them to accepted and failed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tellmark.config import AttemptSpec
from tellmark.operators.grading import accepted, failed, grade_attempts

KEYS = ["cell_id", "rep_index", "model"]


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """A stream over the Parquet files of a folder, or over one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def stream_ingest(
    texts: DataFrame,
    out: str,
    lo: int,
    hi: int,
    spec: AttemptSpec = AttemptSpec(),
    trigger: dict | None = None,
):
    """Start the query. ``texts`` is a stream with the key columns, ``text`` and ``timestamp``.

    The state store keeps every key, so the first text of a key is graded whenever it arrives
    and repeats of it are dropped, however late; no watermark discards rows that are out of
    order. Keys are spread over the state's partitions; for many of them choose a state store
    on disk (``spark.sql.streaming.stateStore.providerClass``). Each micro batch writes to its
    own folder with overwrite, so a batch that is retried after a failure replaces its first
    try; with the checkpoint this makes the sinks exactly-once.
    """
    once = texts.dropDuplicates(KEYS)
    graded = grade_attempts(once, F.lit(lo), F.lit(hi), spec)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop("lo", "hi")
        stored = batch.persist()
        try:
            accepted(stored).drop("error").write.mode("overwrite").parquet(f"{out}/accepted/batch={batch_id}")
            failed(stored).drop("text").write.mode("overwrite").parquet(f"{out}/failed/batch={batch_id}")
        finally:
            stored.unpersist()

    return (
        graded.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/_state")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_sink(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """All batches of one sink; ``kind`` is 'accepted' or 'failed'."""
    return spark.read.parquet(f"{out}/{kind}")
