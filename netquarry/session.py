"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "netquarry", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_CLEARED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A local master without that setting uses a folder in the session's
    warehouse, which is removed when the process ends; any other master must
    set it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = spark.conf.get("spark.sql.warehouse.dir", None).rstrip("/") + "/staged"
    own = f"{folder}/{spark.sparkContext.applicationId}"
    if own not in _CLEARED:
        _CLEARED.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file:"), ignore_errors=True)
    return folder


def run_dir(spark: SparkSession) -> str:
    """The folder of everything this application stages."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def drop_run(spark: SparkSession) -> None:
    """Delete what this application has staged, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate once as parquet in the shared folder and read it back.

    Several downstream operators then scan a pruned columnar table instead of
    recomputing the shuffle, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let the shuffle files of finished jobs go.

    Spark drops shuffle files when the driver collects their plans, which it
    may do late; until then they fill the executors' disks.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()
