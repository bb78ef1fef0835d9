"""Writing result tables: one folder per run, one table per folder, never overwriting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Written last: the tables of a run and their numbers of rows.
MANIFEST = "manifest"


def write_table(
    df: DataFrame, root: str, run_id: str, name: str, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> str:
    """Write ``root/run_id=…/name``; fails when that run already holds the table."""
    path = f"{root}/run_id={run_id}/{name}"
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Write every table, and when all are written the run's manifest, which makes the run
    visible to ``read_run``; predictions are partitioned by model for later pruning.

    Rows are counted by the writing job itself."""
    paths, counted, spark = {}, [], None
    for name, df in tables.items():
        if name == MANIFEST:
            raise ValueError(f"{MANIFEST} is the name of the run's own table")
        spark, seen = df.sparkSession, Observation()
        paths[name] = write_table(
            df.observe(seen, F.count(F.lit(1)).alias("rows")),
            root,
            run_id,
            name,
            partition_by=["model_name"] if name.endswith("predictions") else (),
        )
        counted.append((name, seen.get["rows"]))
    if spark is not None:
        manifest = spark.createDataFrame(counted, "name string, rows bigint").coalesce(1)
        write_table(manifest, root, run_id, MANIFEST)
    return paths


def complete_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, name, rows`` of every table of the runs that were written to the end."""
    try:
        found = spark.read.option("basePath", root).parquet(f"{root}/run_id=*/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run_id string, name string, rows bigint")
    # From the path, since a run's name that looks like a number or a day stays text.
    run = F.regexp_extract("_metadata.file_path", f"run_id=([^/]*)/{MANIFEST}/", 1)
    return found.select(F.url_decode(F.replace(run, F.lit("+"), F.lit("%2B"))).alias("run_id"), "name", "rows")


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a complete run by name; fails where the run broke off or never was."""
    names = [r["name"] for r in complete_runs(spark, root).where(F.col("run_id") == run_id).collect()]
    if not names:
        raise ValueError(f"no complete run {run_id} in {root}")
    return {name: spark.read.parquet(f"{root}/run_id={run_id}/{name}") for name in names}
