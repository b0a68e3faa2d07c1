"""Ingestion: files become documents, postings and word positions; the state of the files is written last.

A run lists the folder, removes what has gone, marks what is new or changed as pending, and then takes pending files batch
by batch, the largest first: claimed (extracting), extracted, indexed, and done or in error. Each batch appends a segment to
each table and replaces its rows by lists of ids; nothing is rewritten as a whole. Documents, index and positions change
before the jobs do, so a run that breaks off is repeated without harm (at least once, idempotent): files left as
extracting are taken again.

Of equal contents the file with the smallest id is the original and alone in the index. If it goes or changes, the next
one becomes the original and is extracted in its turn.

The same step serves each micro-batch of a file stream.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..operators import jobs as J
from ..operators import positions as P
from ..plans import lower
from ..sources import files
from ..sources.store import Store

INDEX_SORT = ("term", "doc_id")
#: The tables of the index by name: schema and order.
INDEX = {"documents": (schema.DOCUMENTS, ()), "postings": (schema.POSTINGS, INDEX_SORT), "positions": (schema.POSITIONS, ("doc_id", "word_offset"))}


@dataclass
class Outcome:
    changed: int
    orphans: int
    indexed: int
    errors: int


@dataclass
class Limits:
    """Files and bytes of a batch at most (one file at least)."""

    files: int = 10_000
    bytes: int = 64 << 30


def documents_of(done: DataFrame, collection: str) -> DataFrame:
    return done.select(F.lit(collection).alias("collection_id"), F.col("id").alias("doc_id"), "path", F.col("text").alias("content"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def positions_of(done: DataFrame) -> DataFrame:
    """Words of each document numbered by token; without boxes from the extractor, tokens on a grid."""
    boxed = done.where(F.size("words") > 0).select(F.col("id").alias("doc_id"), F.posexplode("words").alias("word_offset", "w")).select("doc_id", "word_offset", "w.*")
    plain = done.where(F.size("words") == 0).select(F.col("id").alias("doc_id"), F.posexplode(T.tokens(F.col("text"))).alias("word_offset", "word_text"))
    return boxed.select(schema.POSITIONS.names).unionByName(P.grid_boxes(plain).select(schema.POSITIONS.names))


@dataclass
class Ingest:
    """One collection's tables: documents, postings, positions, jobs.

    progress is called with the files done and to do; cancelled() is asked between batches.
    """

    spark: SparkSession
    store: Store
    collection: str
    extractor: files.Extractor = files.plain_text
    ocr: Callable[[bytes], str] | None = None
    progress: Callable[[int, int], None] | None = None
    limits: Limits = field(default_factory=Limits)
    cancelled: threading.Event = field(default_factory=threading.Event)

    def jobs(self) -> DataFrame:
        return self.store.read("jobs", schema.JOBS)

    def _tell(self, done: int, total: int) -> None:
        if self.progress:
            self.progress(done, total)

    def _drop(self, keys: DataFrame) -> None:
        """Takes documents (doc_id) out of the index."""
        for table, (shape, sort) in INDEX.items():
            self.store.delete(table, keys, "doc_id", shape, sort)

    def _same_contents(self, jobs: DataFrame, checksums: DataFrame) -> DataFrame:
        return jobs.join(checksums.select("checksum").where("checksum <> ''").distinct(), "checksum", "left_semi")

    def remove_orphans(self, listing: DataFrame) -> int:
        """Files that have gone leave the tables; a copy of one that was an original becomes pending."""
        jobs = self.jobs()
        gone = J.orphans(jobs, listing).select("id", "path", "checksum").persist()
        n = gone.count()
        if n:
            self._drop(gone.select(F.col("id").alias("doc_id")))
            left = self._same_contents(jobs, gone).join(gone.select("id"), "id", "left_anti")
            fresh = J.promoted(left, J.with_duplicates(left))
            self.store.upsert("jobs", fresh, "id", schema.JOBS, gone=gone.select("id").union(fresh.select("id")))
        gone.unpersist()
        return n

    def flush(self, extracted: DataFrame) -> tuple[int, int]:
        """Writes extracted files (schema.EXTRACTED) of known jobs: index first, then the jobs."""
        before = self.jobs()
        own = before.join(extracted.select("path"), "path", "left_semi")
        events = extracted.select("path", F.when(F.col("error").isNull(), "done").otherwise("error").alias("kind"), "checksum", "ocr_flag", "error")
        moved = J.apply_events(own, events)
        # All jobs whose place among equal contents may change: those with an old or a new checksum of the batch.
        touched = own.select("checksum").union(moved.select("checksum"))
        around = self._same_contents(before, touched).join(own.select("id"), "id", "left_anti")
        was = around.unionByName(own)
        after = J.promoted(around, J.with_duplicates(around.unionByName(moved))).persist()
        rows = extracted.where("error is null").join(after.where("status = 'done' and duplicate_of is null").select("id", "path"), "path").persist()
        docs = documents_of(rows, self.collection)
        # Documents that the index may hold in an older form, or should hold no longer.
        stale = after.where("status <> 'done' or duplicate_of is not null").select(F.col("id").alias("doc_id"))
        drop = self.store.read("documents", schema.DOCUMENTS).select("doc_id").join(docs.select("doc_id").union(stale).distinct(), "doc_id", "left_semi").persist()
        made = {"documents": docs, "postings": lower.postings(docs), "positions": positions_of(rows)}
        gone = None if drop.isEmpty() else drop
        for table, (shape, sort) in INDEX.items():
            self.store.write(table, made[table].select(shape.names), sort, gone=gone, append=True)
        equal = F.expr(" and ".join(f"(a.{c} <=> b.{c})" for c in schema.JOBS.names))
        changed = after.alias("a").join(was.alias("b"), F.col("a.id") == F.col("b.id"), "left").where(~equal).select("a.*")
        self.store.upsert("jobs", changed, "id", schema.JOBS)
        done, failed = rows.count(), extracted.where("error is not null").count()
        for df in (rows, after, drop):
            df.unpersist()
        return done, failed

    def _mark(self, listed: DataFrame) -> None:
        """New and changed files become pending."""
        known = self.jobs()
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        own = known.join(listed.select("path"), "path", "left_semi")
        self.store.upsert("jobs", J.upsert_pending(own, listed, top), "id", schema.JOBS)

    def _claim(self, listing: DataFrame) -> list[str]:
        """Paths of the next pending files, the largest first; they are extracting from now on."""
        waiting = J.claim(self.jobs().join(listing.select("path"), "path", "left_semi"), self.limits.files)
        paths, size = [], 0
        for r in waiting.select("path", F.coalesce("file_size", F.lit(0)).alias("n")).collect():  # a bounded batch
            if paths and size + r["n"] > self.limits.bytes:
                break
            paths.append(r["path"])
            size += r["n"]
        if paths:
            claims = self.spark.createDataFrame([(p, "claim", None, None, None) for p in paths], "path string, kind string, checksum string, ocr_flag boolean, error string")
            own = self.jobs().join(claims.select("path"), "path", "left_semi")
            self.store.upsert("jobs", J.apply_events(own, claims), "id", schema.JOBS)
        return paths

    def extracted(self, paths: list[str], folder: str, extractor: files.Extractor | None = None) -> DataFrame:
        """The batch extracted and kept. Where the whole job fails (a file that kills its worker), halves are tried by
        themselves, down to the file, which is then in error."""
        out = files.extract(files.contents(self.spark, paths, folder), extractor or self.extractor).persist()
        try:
            out.count()
            return out
        except Exception as e:  # noqa: BLE001  whatever broke the job
            out.unpersist()
            if self.cancelled.is_set():
                raise
            if len(paths) == 1:
                return self.spark.createDataFrame([(paths[0], None, False, None, 0, f"worker crashed: {str(e).splitlines()[0][:200]}", [])], schema.EXTRACTED)
            half = len(paths) // 2
            return self.extracted(paths[:half], folder, extractor).unionByName(self.extracted(paths[half:], folder, extractor))

    def run(self, folder: str, index: bool = True) -> Outcome:
        """One incremental run over a folder."""
        self.cancelled.clear()
        listing = files.list_folder(self.spark, folder).persist()
        try:
            gone = self.remove_orphans(listing)
            found = J.changed(listing, self.jobs()).persist()
            n = found.count()
            if not index:
                return Outcome(n, gone, 0, 0)
            if n:
                self._mark(found)
            found.unpersist()
            waiting = self.jobs().where("status = 'pending'").join(listing.select("path"), "path", "left_semi").count()
            done = failed = taken = 0
            if waiting:
                self._tell(0, waiting)
            while not self.cancelled.is_set() and (paths := self._claim(listing)):
                batch = self.extracted(paths, folder)
                a, b = self.flush(batch)
                batch.unpersist()
                done, failed, taken = done + a, failed + b, taken + len(paths)
                self._tell(taken, max(waiting, taken))
            return Outcome(n, gone, done, failed)
        finally:
            listing.unpersist()

    def run_ocr(self, folder: str, max_retries: int = 2) -> int:
        """OCR of files without text: texts are indexed before the attempt is written down. Goes on until none is left to try."""
        if self.ocr is None:
            raise RuntimeError("no OCR is set up")
        ocr, done = self.ocr, 0
        sent = self.spark.createDataFrame([], "id long")
        while not self.cancelled.is_set():
            todo = J.distinct_polls(J.needs_ocr(self.jobs(), max_retries), sent).orderBy("id").limit(self.limits.files).select("id", "path").collect()  # a bounded batch
            if not todo:
                break
            sent = sent.union(self.spark.createDataFrame([(r["id"],) for r in todo], "id long"))
            got = self.extracted([r["path"] for r in todo], folder, lambda content: files.Extracted(ocr(content)))
            done += self.flush(got.where("error is null and not ocr_flag"))[0]
            results = got.select("path", (F.col("error").isNull() & ~F.col("ocr_flag")).alias("ok"), F.coalesce("error", F.lit("no text")).alias("error"))
            own = self.jobs().join(results.select("path"), "path", "left_semi")
            self.store.upsert("jobs", J.ocr_attempt(own, results, max_retries), "id", schema.JOBS)
            got.unpersist()
        return done

    def stream(self, folder: str, checkpoint: str, files_per_batch: int = 1000):
        """A file stream that takes what is there and stops; started again, it goes on where it stopped.

        Deleted files never reach a stream: remove_orphans() finds them.
        """
        source = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)

        def batch(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            found = rows.select("path", F.unix_timestamp("modificationTime").alias("file_modified"), F.col("length").alias("file_size"))
            self._mark(J.changed(found, self.jobs()))
            extracted = files.extract(rows, self.extractor).persist()
            self.flush(extracted)
            extracted.unpersist()
            rows.unpersist()

        return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
