"""Session settings for local runs, and the shared folder of any session."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting of local sessions over fixture tables of one file: partitions that texts are dealt to.
FIXTURE_PARTITIONS = "spark.tellmark.fixture.partitions"

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tellmark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(FIXTURE_PARTITIONS, str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Where it names none, a local session
    takes a folder under its warehouse; a cluster's executors may not reach that, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tellmark-shared"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session ended before the interpreter did
            return


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the written copy.

    Used where several later jobs read one result: they read the stored columns that they need
    instead of repeating the work, and losing an executor cannot lose them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
