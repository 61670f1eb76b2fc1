"""Sinks: JSON results (S8), reports (S9) and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.screens import path_reason


def check_output_path(spark: SparkSession, path: str) -> str | None:
    """C9 for one output path given by the caller (a parameter, not data):
    NULL when acceptable, else absolute / escape / hidden / protected."""
    return spark.range(1).select(path_reason(F.lit(path)).alias("r")).first()["r"]


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a location, as the driver's Hadoop client sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_complete(spark: SparkSession, path: str) -> bool:
    """Did a write to ``path`` end? Spark puts ``_SUCCESS`` there after the last task's commit."""
    fs, p = _hadoop(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def new_only(spark: SparkSession, path: str) -> str:
    """Write mode for a place that is written once: what a failed write left behind is replaced, a whole one never."""
    fs, p = _hadoop(spark, path)
    return "overwrite" if fs.exists(p) and not is_complete(spark, path) else "errorifexists"


def write_batch_once(batch: DataFrame, batch_id: int, out: str) -> bool:
    """Write a micro-batch under its id, once: a batch that is replayed after its write ended is left as it is, one whose write
    failed is written anew. Returns whether it wrote."""
    path = f"{out.rstrip('/')}/batch_id={batch_id}"
    if is_complete(batch.sparkSession, path):
        return False
    batch.write.mode("overwrite").parquet(path)
    return True


def read_batches(spark: SparkSession, out: str, schema) -> DataFrame:
    """All batches whose write ended, with their ``batch_id``."""
    fs, p = _hadoop(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    whole = [f"{out.rstrip('/')}/{n}" for n in names if n.startswith("batch_id=") and is_complete(spark, f"{out.rstrip('/')}/{n}")]
    if not whole:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))
    return spark.read.schema(schema).option("basePath", out).parquet(*whole)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row (JSON lines)."""
    df.write.mode(mode).json(path)


def write_report(spark: SparkSession, df: DataFrame, column: str, path: str, base: str | None = None,
                 relative: bool = True) -> None:
    """A text report per row, to a new location only (what a failed write left there is replaced). When ``relative``
    the path is screened like the reference's output path and resolved under
    ``base``."""
    if relative:
        reason = check_output_path(spark, path)
        if reason is not None:
            raise ValueError(f"Output path rejected: {reason}")
        path = f"{base.rstrip('/')}/{path}" if base else path
    df.select(F.col(column).cast("string").alias("value")).write.mode(new_only(spark, path)).text(path)


def write_requests(df: DataFrame, path: str, provider: str = "provider", body: str = "body") -> None:
    """Request bodies as JSON lines, one folder per provider (batch
    inference inputs), to a new location only."""
    df.select(F.col(provider), F.col(body).alias("value")).write.mode(new_only(df.sparkSession, path)).partitionBy(provider).text(path)
