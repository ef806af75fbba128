"""Session settings the jobs rely on. Only runtime SQL settings, so any session can be used."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # What one task holds: ascending keys shrink to a tenth and less, so 64 MB of shuffle are more than a GB in sorts and maps.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Hot certificates and heats: let AQE split the skewed side even if that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Wide rule expressions: above the JIT's method size fall back to split projection methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "millspark", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the one the cluster names in spark.checkpoint.dir; local sessions without it get a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/millspark-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back, so that later steps do not recompute its inputs."""
    path = f"{shared_folder(df.sparkSession)}/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """The same rows, each computed once: filters and columns that follow see values, not the expressions behind them.

    For a table that one branch of a query reads, in place of ``staged``. All columns of ``df`` are computed, so select first.
    """
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
