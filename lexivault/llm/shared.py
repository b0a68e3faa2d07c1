"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import folder

def fresh_name(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = f"{folder(df.sparkSession)}/{fresh_name(name)}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of data frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _path(spark: SparkSession, path: str):
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df.shared_path)


def _versions(spark: SparkSession, base: str, name: str) -> list[int]:
    at, fs = _path(spark, base)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(f.rsplit(".", 1)[1]) for f in found if f.startswith(name + ".") and f.rsplit(".", 1)[1].isdigit())


def newest(spark: SparkSession, base: str, name: str) -> str | None:
    """The newest content of a small file that replace() wrote; None if there is none."""
    known = _versions(spark, base, name)
    if not known:
        return None
    at, fs = _path(spark, f"{base}/{name}.{known[-1]}")
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace(spark: SparkSession, base: str, name: str, content: str) -> None:
    """Writes the next version of a small file: whole under another name first, then renamed, so readers see all or nothing."""
    known = _versions(spark, base, name)
    new, fs = _path(spark, f"{base}/{name}.new")
    stream = fs.create(new, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    if not fs.rename(new, _path(spark, f"{base}/{name}.{(known or [0])[-1] + 1}")[0]):
        raise RuntimeError(f"another writer replaced {base}/{name}")
    for v in known[:-1]:
        fs.delete(_path(spark, f"{base}/{name}.{v}")[0], False)
