"""Session setup and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def build_session(app_name: str = "tokenloom", *, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (AQE, skew joins, UTC, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a missing setting is an error,
    because executors would not see a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="spark-tokenloom-")
    return _local_folders[application]


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of every query built inside as soon as that query has ended.

    For chains of stored tables: once a table is written, nothing reads the shuffles that made it. Others keep theirs.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def materialize(df: DataFrame, name: str = "table", *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    This cuts lineage in iterative jobs, survives the loss of executors, and gives the optimizer real file
    sizes for its broadcast decisions. The shuffles that made the table are removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tokenloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with short_lived_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(_stored_schema(df, partition_by)).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core; larger scans stay as they are.

    Small files arrive in one or two splits, which would leave tokenising and vector work to as many cores. On
    large data the scan has more splits than cores and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)


def _stored_schema(df: DataFrame, partition_by: list[str] | None):
    schema = df.schema
    if not partition_by:
        return schema
    kept = [field for field in schema if field.name not in partition_by]
    return type(schema)(kept + [schema[name] for name in partition_by])
