"""The state of every file: change detection, duplicates, orphans and status events, as joins and projections.

States: pending, extracting, done, error. A table of jobs goes in, a table of jobs comes out.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources import scratch

RETRY = ("error", "extracting")
#: Fixed value: files a worker gets at a time.
BATCH = 30


def unchanged(mtime: Column, size: Column, known_mtime: Column, known_size: Column, status: Column) -> Column:
    """Same time and size, and neither failed nor stuck."""
    zero = F.lit(0)
    return (mtime == F.coalesce(known_mtime, zero)) & (size == F.coalesce(known_size, zero)) & ~status.isin(*RETRY)


def changed(listing: DataFrame, jobs: DataFrame) -> DataFrame:
    """Listed files that are new, changed, failed or stuck."""
    known = jobs.select("path", F.col("file_modified").alias("_m"), F.col("file_size").alias("_s"), "status")
    both = listing.join(known, "path", "left")
    same = F.coalesce(unchanged(F.col("file_modified"), F.col("file_size"), F.col("_m"), F.col("_s"), F.col("status")), F.lit(False))
    return both.where(~same).select(listing.columns)


def orphans(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Jobs whose file is gone."""
    return jobs.join(listing.select("path"), "path", "left_anti")


def ids_for_paths(jobs: DataFrame, paths: DataFrame) -> DataFrame:
    return jobs.join(paths.select("path"), "path", "left_semi").select("id", "path")


def upsert_pending(jobs: DataFrame, found: DataFrame, top: int | None = None) -> DataFrame:
    """Found files become pending; known ones keep their ids, new ones get ids after the largest (top, if jobs are but some)."""
    if top is None:
        top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = found.select("path", F.col("file_modified").alias("_m"), F.col("file_size").alias("_s"), F.lit(True).alias("_f"))
    both = jobs.join(new, "path", "full_outer")
    fresh = both.where("id is null").select("path")
    # Ids of new rows: offsets of the range partitions, then places in them; no task holds all rows. The places are written
    # down once, so a task that runs again after a loss cannot number them otherwise.
    placed = fresh.repartitionByRange("path").sortWithinPartitions("path").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = scratch.written(placed, "places")
    before = placed.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = placed.join(before.select("_p", F.coalesce("_before", F.lit(0)).alias("_before")), "_p").select("path", (F.lit(top) + 1 + F.col("_before") + F.col("_k")).alias("_new"))
    out = both.join(numbered, "path", "left")
    hit = F.col("_f").isNotNull()
    value = {
        "id": F.coalesce("id", "_new"),
        "checksum": F.coalesce("checksum", F.lit("")),
        "status": F.when(hit, F.lit("pending")).otherwise(F.col("status")),
        "ocr_flag": F.when(hit, F.lit(False)).otherwise(F.col("ocr_flag")),
        "error": F.when(~hit, F.col("error")),
        "ocr_attempts": F.coalesce("ocr_attempts", F.lit(0)),
        "file_modified": F.when(hit, F.col("_m")).otherwise(F.col("file_modified")),
        "file_size": F.when(hit, F.col("_s")).otherwise(F.col("file_size")),
    }
    return out.select(*[value.get(c, F.col(c)).alias(c) for c in schema.JOBS.names])


def upsert_checksums(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Known jobs whose content (path, checksum) differs become pending with the new checksum; equal ones stay as they are."""
    new = found.select("path", F.col("checksum").alias("_c"))
    both = jobs.join(new, "path", "left")
    hit = F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("checksum"))
    value = {
        "checksum": F.when(hit, F.col("_c")).otherwise(F.col("checksum")),
        "status": F.when(hit, F.lit("pending")).otherwise(F.col("status")),
        "ocr_flag": F.when(hit, F.lit(False)).otherwise(F.col("ocr_flag")),
        "error": F.when(~hit, F.col("error")),
    }
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in schema.JOBS.names])


def apply_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after events (path, kind, checksum, ocr_flag, error), one a path: claim, done, error, reset."""
    e = events.select("path", F.col("kind").alias("_k"), F.col("checksum").alias("_c"), F.col("ocr_flag").alias("_o"), F.col("error").alias("_e"))
    both, k = jobs.join(e, "path", "left"), F.col("_k")
    done = F.coalesce(k == "done", F.lit(False))
    value = {
        "status": F.when(k == "claim", "extracting").when(k == "done", "done").when(k == "error", "error").when(k == "reset", "pending").otherwise(F.col("status")),
        "checksum": F.when(done, F.col("_c")).otherwise(F.col("checksum")),
        "ocr_flag": F.when(done, F.col("_o")).otherwise(F.col("ocr_flag")),
        "error": F.when(k == "error", F.col("_e")).when(k.isNotNull(), F.lit(None)).otherwise(F.col("error")),
    }
    return with_duplicates(both.select(*[value.get(c, F.col(c)).alias(c) for c in schema.JOBS.names]))


def with_duplicates(jobs: DataFrame) -> DataFrame:
    """Recomputes duplicate_of from the living rows: of the done rows of one checksum, the smallest id is the original.

    The originals come from a grouped minimum; a checksum that very many files share is never one task's work.
    """
    known = jobs.where("status = 'done' and checksum <> ''").groupBy("checksum").agg(F.min("id").alias("_first"))
    both = jobs.drop("duplicate_of").join(known, "checksum", "left")
    first = F.when((F.col("status") == "done") & (F.col("_first") < F.col("id")), F.col("_first"))
    return both.withColumn("duplicate_of", first).select(schema.JOBS.names)


def promoted(before: DataFrame, after: DataFrame) -> DataFrame:
    """after, with those jobs pending that were duplicates before and are originals now: the index does not hold them yet."""
    was = before.where("status = 'done' and duplicate_of is not null").select("id", F.lit(True).alias("_was"))
    both = after.join(was, "id", "left")
    fresh = F.col("_was").isNotNull() & (F.col("status") == "done") & F.col("duplicate_of").isNull()
    return both.withColumn("status", F.when(fresh, "pending").otherwise(F.col("status"))).select(schema.JOBS.names)


def originals(rows: DataFrame, key: str = "checksum", id_col: str = "doc_id") -> DataFrame:
    """First row of every content; rows without a checksum are always originals."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    # The smallest id of each content, joined on content and id: no task gets all copies of one content.
    first = rows.where(~blank).groupBy(F.col(key).alias("_k")).agg(F.min(id_col).alias("_i"))
    kept = rows.where(~blank).join(first, (F.col(key) == F.col("_k")) & (F.col(id_col) == F.col("_i")), "left_semi")
    return kept.unionByName(rows.where(blank))


def original_by_checksum(jobs: DataFrame) -> DataFrame:
    """(checksum, id, path) of the first done row that is no duplicate."""
    live = jobs.where("status = 'done' and duplicate_of is null and checksum <> ''")
    return live.groupBy("checksum").agg(F.min_by(F.struct("id", "path"), "id").alias("o")).select("checksum", "o.id", "o.path")


def ocr_attempt(jobs: DataFrame, results: DataFrame, max_retries: int = 2) -> DataFrame:
    """Jobs after OCR results (path, ok, error)."""
    r = results.select("path", F.col("ok").alias("_ok"), F.col("error").alias("_e"))
    both, ok = jobs.join(r, "path", "left"), F.col("_ok")
    tries = F.col("ocr_attempts") + 1
    value = {
        "ocr_attempts": F.when(ok.isNotNull(), tries).otherwise(F.col("ocr_attempts")),
        "ocr_flag": F.when(ok, F.lit(False)).otherwise(F.col("ocr_flag")),
        "ocr_error": F.when(ok.isNull(), F.col("ocr_error")).when(~ok, F.col("_e")),
        "failed_ocr": F.when(ok.isNull(), F.col("failed_ocr")).when(~ok & (tries >= max_retries), F.current_timestamp()),
    }
    return both.select(*[value.get(c, F.col(c)).alias(c) for c in schema.JOBS.names])


def needs_ocr(jobs: DataFrame, max_retries: int = 2) -> DataFrame:
    return jobs.where((F.col("status") == "done") & F.col("ocr_flag") & (F.col("ocr_attempts") < max_retries))


def with_status(jobs: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Jobs of a status by id; a negative limit gives none."""
    out = jobs.where(F.col("status") == status).orderBy("id")
    return out if limit is None else out.limit(max(0, limit))


def failed_ocr(jobs: DataFrame) -> DataFrame:
    return jobs.where("failed_ocr is not null").orderBy(F.desc("failed_ocr"))


def claim(jobs: DataFrame, limit: int) -> DataFrame:
    """The next pending jobs, the largest files first."""
    return jobs.where("status = 'pending'").orderBy(F.desc(F.coalesce("file_size", F.lit(0))), "id").limit(max(0, limit))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if("ocr_flag").alias("n_ocr"))


def balanced(sizes: list[tuple[int, int]], workers: int, cap: int = BATCH) -> tuple[list[list[int]], list[int]]:
    """Greedy shares of (id, size) for workers, largest first to the least loaded (then to the least filled); the rest.

    Plans one round of a bounded number of files; nothing here runs over a whole corpus.
    """
    ranked = sorted(sizes, key=lambda x: (-x[1], x[0]))
    room = workers * cap
    loads = [(0, 0, w) for w in range(workers)]
    out: list[list[int]] = [[] for _ in range(workers)]
    for i, size in ranked[:room]:
        total, count, w = heapq.heappop(loads)
        out[w].append(i)
        if count + 1 < cap:
            heapq.heappush(loads, (total + size, count + 1, w))
    return out, [i for i, _ in ranked[room:]]


def rounds(files: DataFrame, workers: int, cap: int = BATCH) -> DataFrame:
    """(round, worker, id) of all files (id, file_size): rounds of workers * cap, the largest files first, each shared out.

    Rounds come from the files' places in a distributed sort; a round is one small group.
    """
    room = workers * cap
    ranked = files.select("id", F.coalesce("file_size", F.lit(0)).cast("long").alias("size")).repartitionByRange(F.desc("size"), F.asc("id")).sortWithinPartitions(F.desc("size"), F.asc("id"))
    placed = scratch.written(ranked.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "places")
    before = placed.groupBy("_p").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(F.broadcast(before.select("_p", "_b")), "_p").select(F.floor((F.col("_b") + F.col("_k")) / room).cast("int").alias("round"), "id", "size")  # a row for each partition

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        shares, _ = balanced(list(zip(pdf["id"].tolist(), pdf["size"].tolist())), workers, cap)
        return pd.DataFrame([(pdf["round"].iloc[0], w, i) for w, own in enumerate(shares) for i in own], columns=["round", "worker", "id"])

    return numbered.groupBy("round").applyInPandas(share, "round int, worker int, id long")


def distinct_polls(found: DataFrame, sent: DataFrame) -> DataFrame:
    """Jobs of a poll that no earlier poll has sent, once each."""
    return found.dropDuplicates(["id"]).join(sent.select("id"), "id", "left_anti")
