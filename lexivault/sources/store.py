"""Versioned Parquet tables made of segments: writes append, deletions are lists of keys, and small segments merge.

A table's state is one small file, ``manifest.<version>``: its segments, and the lists of deleted keys with the version
from which on they hold. A write makes its segment (and list of keys) first and the next manifest last, whole under another
name and then renamed; so a crash at any point leaves the version before in force, and readers keep the version they
resolved. Once there are more than a few segments, the last one merges with the one before while that is not twice as
large, so there are never many, and a row is rewritten a logarithmic number of times. One writer at a time; a second one
fails at the rename.

All files are reached through Hadoop's file systems, so tables may live wherever Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SCHEMA_VERSION

#: Versions whose files are kept for readers, segments that may stand beside each other unmerged.
KEPT, SEGMENTS = 3, 6
#: The column that says in which version a row, or a deleted key, was written.
VERSION = "_version"
_EMPTY = {"version": 0, "schema": None, "sort": [], "segments": [], "gone": []}


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._made: list[str] = []

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _versions(self, table: str) -> list[int]:
        path = self._path(table)
        fs = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[9:]) for n in names if n.startswith("manifest.") and n[9:].isdigit())

    def _manifest(self, table: str, version: int | None = None) -> dict:
        known = [version] if version is not None else self._versions(table)
        if not known:
            return dict(_EMPTY)
        path = self._path(table, f"manifest.{known[-1]}")
        stream = self._fs(path).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, state: dict) -> int:
        """Puts the next version in force, and removes what only versions no longer kept refer to."""
        known = self._versions(table)
        new, now = self._path(table, f"manifest.new-{uuid.uuid4().hex}"), self._path(table, f"manifest.{state['version']}")
        fs = self._fs(now)
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if fs.exists(now) or not fs.rename(new, now):
            raise RuntimeError(f"another writer put version {state['version']} of {table} in force")
        dirs = lambda m: {x["dir"] for x in m["segments"] + m["gone"]}
        old, kept = known[: -(KEPT - 1)], known[-(KEPT - 1) :]
        if old:
            used = dirs(state).union(*[dirs(self._manifest(table, v)) for v in kept])
            for v in old:
                for d in dirs(self._manifest(table, v)) - used:
                    fs.delete(self._path(table, d), True)
                fs.delete(self._path(table, f"manifest.{v}"), False)
        return state["version"]

    def version(self, table: str) -> int:
        """Version in force; 0 if the table is new."""
        return (self._versions(table) or [0])[-1]

    def schema_version(self, table: str) -> int | None:
        """Layout that the version in force was written with; null if the table is new."""
        return self._manifest(table)["schema"]

    # Reading

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The table as it stands now, with the columns of schema (new ones null); empty if it is new."""
        state = self._manifest(table)
        out = self._live(table, state, state["segments"], schema)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _live(self, table: str, state: dict, segments: list[dict], schema: T.StructType | None) -> DataFrame | None:
        """Rows of the segments that no later list of keys names: one scan, and one join if there are any lists."""
        if not segments:
            return None
        shapes = {s["schema"] for s in segments}
        got = self.spark.read.option("mergeSchema", len(shapes) > 1).parquet(*[f"{self.base}/{table}/{s['dir']}" for s in segments])
        oldest = min(s["version"] for s in segments)
        gone = [g["dir"] for g in state["gone"] if g["version"] > oldest]
        if gone:
            keys = self.spark.read.parquet(*[f"{self.base}/{table}/{d}" for d in gone])
            key = [c for c in keys.columns if c != VERSION]
            last = keys.groupBy(*key).agg(F.max(VERSION).alias("_gone"))
            got = got.join(last, key, "left").where(F.col("_gone").isNull() | (F.col(VERSION) >= F.col("_gone"))).drop("_gone")
        got = got.drop(VERSION)
        if schema is not None:
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in got.columns]
            got = got.select("*", *missing).select([F.col(f.name).cast(f.dataType) for f in schema])
        return got

    # Writing

    def _fresh(self, kind: str) -> str:
        """A new folder's name, noted as made by the write at hand."""
        self._made.append(f"{kind}-{uuid.uuid4().hex}")
        return self._made[-1]

    def _segment(self, table: str, rows: DataFrame, sort: list[str], version: int, partitions: tuple[str, ...] = ()) -> dict:
        name = self._fresh("segment")
        out = rows.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else rows
        return {"dir": name, "version": version, "schema": SCHEMA_VERSION, "rows": self._written(out, version, f"{self.base}/{table}/{name}", partitions)}

    @staticmethod
    def _written(rows: DataFrame, version: int, path: str, partitions: tuple[str, ...] = ()) -> int:
        """Writes rows with their version and counts them in the same job."""
        seen = Observation()
        writer = rows.withColumn(VERSION, F.lit(version)).observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
        return seen.get["n"]

    def write(self, table: str, rows: DataFrame | None, sort: tuple[str, ...] = (), partitions: tuple[str, ...] = (), gone: DataFrame | None = None, append: bool = False) -> int:
        """Rows (if any) as the next version; with append, beside the rows in force, except those that gone (a table of keys) names."""
        state = self._manifest(table) if append else dict(_EMPTY, version=self.version(table))
        v = state["version"] + 1
        sort = list(sort) or state["sort"]
        lists = list(state["gone"])
        self._made = []
        if gone is not None and state["segments"]:
            name = self._fresh("gone")
            if self._written(gone, v, f"{self.base}/{table}/{name}"):
                lists.append({"dir": name, "version": v})
        state = dict(state, version=v, schema=SCHEMA_VERSION, sort=sort, gone=lists)
        held = state["segments"]
        if rows is not None:
            held = self._merged(table, state, [*held, self._segment(table, rows, sort, v, partitions)])
        oldest = min((s["version"] for s in held), default=v)
        final = dict(state, segments=held, gone=[g for g in lists if g["version"] > oldest])
        self._commit(table, final)
        used = {x["dir"] for x in final["segments"] + final["gone"]}
        for d in set(self._made) - used:  # merged or dropped again at once: no version ever named them
            path = self._path(table, d)
            self._fs(path).delete(path, True)
        return v

    def _merged(self, table: str, state: dict, held: list[dict]) -> list[dict]:
        """Segments after merging those at the end that are of like size, if there are many; their deleted rows go."""
        if len(held) <= SEGMENTS:
            return held
        a = len(held) - 1
        size = held[a]["rows"]
        while a and held[a - 1]["rows"] < 2 * size:
            a -= 1
            size += held[a]["rows"]
        if a == len(held) - 1:
            return held
        return [*held[:a], self._segment(table, self._live(table, state, held[a:], None), state["sort"], state["version"])]

    def upsert(self, table: str, rows: DataFrame, key: str, schema: T.StructType, sort: tuple[str, ...] = (), gone: DataFrame | None = None) -> int:
        """Rows replace those with the same key, or those with the keys of gone, where it is given."""
        return self.write(table, rows.select(schema.names), sort, gone=rows.select(key).distinct() if gone is None else gone.select(key), append=True)

    def delete(self, table: str, keys: DataFrame, key: str, schema: T.StructType, sort: tuple[str, ...] = ()) -> int:
        return self.write(table, None, sort, gone=keys.select(key).distinct(), append=True)

    def delete_where(self, table: str, condition, schema: T.StructType, sort: tuple[str, ...] = ()) -> int:
        """Deletes matching rows and returns their number."""
        rows = self.read(table, schema)
        gone = rows.where(condition).count()
        if gone:
            self.write(table, rows.where(~F.coalesce(condition, F.lit(False))), sort)
        return gone

    def files(self, table: str) -> tuple[int, int]:
        """Files and bytes of the version in force."""
        sizes = []
        for s in self._manifest(table)["segments"]:
            path = self._path(table, s["dir"])
            sizes += [f.getLen() for f in self._fs(path).listStatus(path) if f.getPath().getName().endswith(".parquet")]
        return len(sizes), sum(sizes)

    def compact(self, table: str, schema: T.StructType, sort: tuple[str, ...] = (), file_bytes: int = 256 << 20) -> tuple[int, int]:
        """Rewrites a table into one segment with files of about file_bytes; files before and after."""
        before, size = self.files(table)
        rows = self.read(table, schema)
        n = max(1, -(-size // file_bytes))
        self.write(table, rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort) if sort else rows.repartition(n))
        return before, self.files(table)[0]

    def drop(self, table: str) -> None:
        path = self._path(table)
        self._fs(path).delete(path, True)
