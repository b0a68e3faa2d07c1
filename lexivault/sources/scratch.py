"""Intermediate tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that is small.
SMALL = 256 << 20
_own: dict[int, str] = {}  # folders of sessions on one machine


def folder(spark: SparkSession) -> str:
    """The folder the cluster names; on one machine, where none is named, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="lexivault-"))


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt to all of them in turn; any other as it is.

    Files of one row group are one task each, however many cores wait. Spark sorts rows before it deals them in turn, so a
    task that runs again deals them alike.
    """
    plan, cores = df._jdf, df.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL and 0 < len(plan.inputFiles()) < cores else df


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is computed once, whatever executor is lost later."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
