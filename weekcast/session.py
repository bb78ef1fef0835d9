"""Session defaults and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weekcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC dates and adaptive execution.

    Cluster-specific settings (executors, memory, shuffle partitions) are left to
    ``spark-submit``; anything in ``conf`` wins over the defaults here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, one in
    the warehouse, which executors share as well. Never a folder of one machine alone: the
    default warehouse lies below the driver's working directory, so a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and spark.sparkContext.getConf().get("spark.sql.warehouse.dir") is None:
        raise ValueError("set spark.checkpoint.dir, or spark.sql.warehouse.dir, to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Later steps that read it several times do not repeat the work behind it, a lost
    executor costs a re-read and not a re-run, and Parquet keeps column pruning, filter
    pushdown and size statistics, which a checkpointed RDD loses.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/weekcast/{run}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
