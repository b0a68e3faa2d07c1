"""The facade: collections, indexing, search, positions, statistics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from . import __version__, schema
from .functions import text as T
from .operators import jobs as J
from .operators import positions as P
from .plans import lower, search
from .plans import query as Q
from .sources import files
from .sources.store import Store
from .streaming.ingest import Ingest, Limits, Outcome

#: Positions are relative to the crop box and count from its upper left corner.
TRANSFORMED = 1


@dataclass
class Settings:
    """Tuning; anything else is Spark's own configuration."""

    ocr_language: str = "eng"
    ocr_retries: int = 2
    files_per_batch: int = 10_000
    bytes_per_batch: int = 64 << 30
    snippet_width: int = 150

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Unknown names are passed over, missing ones have their defaults."""
        got = json.loads(text)
        return cls(**{f.name: got[f.name] for f in fields(cls) if f.name in got})


class Metrics(StreamingQueryListener):
    """Counts files, batches and searches; throughput is rows a second, latency the mean time of a search."""

    def __init__(self, log: Callable[[str], None] | None = None, every: float = 5.0):
        self.rows = self.batches = self.searches = 0
        self.millis = self.search_nanos = 0
        self.log, self.every, self._said = log, every, 0.0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.batch(event.progress.numInputRows, event.progress.batchDuration)

    def onQueryTerminated(self, event):
        pass

    def batch(self, rows: int, millis: float) -> None:
        self.rows, self.batches, self.millis = self.rows + rows, self.batches + 1, self.millis + millis
        self._tell()

    def search(self, nanos: int) -> None:
        self.searches, self.search_nanos = self.searches + 1, self.search_nanos + nanos
        self._tell()

    def throughput(self) -> float:
        return self.rows / (self.millis / 1000) if self.millis else 0.0

    def latency_nanos(self) -> int:
        return self.search_nanos // self.searches if self.searches else 0

    def summary(self) -> str:
        return f"{self.rows} files in {self.batches} batches, {self.throughput():.1f} a second; {self.searches} searches, {self.latency_nanos() / 1e6:.1f} ms each"

    def _tell(self) -> None:
        """A summary to the log, at most every so many seconds."""
        if self.log and time.monotonic() - self._said >= self.every:
            self._said = time.monotonic()
            self.log(self.summary())


class Engine:
    def __init__(self, spark: SparkSession, base: str, extractor: files.Extractor = files.plain_text, settings: Settings | None = None, log: Callable[[str], None] | None = None, ocr: Callable[[bytes], str] | None = None, progress: Callable[[int, int], None] | None = None):
        self.spark, self.base, self.extractor, self.log = spark, base.rstrip("/"), extractor, log
        self.settings = settings or Settings()
        self.ocr, self.progress = ocr, progress
        self.registry = Store(spark, f"{self.base}/registry")
        self.metrics = Metrics(log)
        self.builders: dict[str, search.QueryBuilder] = {}
        self._running: dict[int, Ingest] = {}

    def register_builder(self, builder: search.QueryBuilder) -> None:
        """Requests with the builder's name as their strategy are read by it."""
        self.builders[builder.name] = builder

    def save_settings(self) -> None:
        """Keeps the settings beside the collections."""
        self.registry.write("settings", self.spark.createDataFrame([(self.settings.to_json(),)], "json string"))

    def load_settings(self) -> Settings:
        """The settings that were kept last, else the defaults; they hold from now on."""
        row = self.registry.read("settings", schema.SETTINGS).first()
        self.settings = Settings.from_json(row["json"]) if row else Settings()
        return self.settings

    @staticmethod
    def version() -> str:
        return __version__

    # Collections

    def collections(self) -> DataFrame:
        return self.registry.read("collections", schema.COLLECTIONS).orderBy("id")

    def add_collection(self, folder: str, label: str | None = None) -> int:
        """Id of the folder's collection; a known folder keeps its own."""
        folder = folder.rstrip("/")
        known = self.collections().where(F.col("folder") == folder).first()
        if known:
            return known["id"]
        new = (self.collections().agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(folder).alias("folder"), F.lit(label).cast("string").alias("label"), F.lit(f"{self.base}/{new}").alias("data_dir"), F.lit(0).cast("long").alias("doc_count"), F.lit(None).cast("timestamp").alias("last_indexed"), F.current_timestamp().alias("created_at"))
        self.registry.upsert("collections", row, "id", schema.COLLECTIONS)
        return new

    def get_collection(self, collection: int) -> dict:
        row = self.collections().where(F.col("id") == collection).first()
        if row is None:
            raise KeyError(f"no collection {collection}")
        return row.asDict()

    def update_collection(self, collection: int, label: str | None = None, doc_count: int | None = None, indexed: bool = False) -> None:
        """Sets what is given; an unknown id is an error."""
        self.get_collection(collection)
        row = self.collections().where(F.col("id") == collection)
        new = {"label": label, "doc_count": doc_count}
        row = row.select(*[F.lit(new[f.name]).cast(f.dataType).alias(f.name) if new.get(f.name) is not None else F.current_timestamp().alias(f.name) if indexed and f.name == "last_indexed" else F.col(f.name) for f in schema.COLLECTIONS])
        self.registry.upsert("collections", row, "id", schema.COLLECTIONS)

    def remove_collection(self, collection: int) -> None:
        """Removes the entry and its tables; an unknown id is ignored."""
        self.registry.delete_where("collections", F.col("id") == collection, schema.COLLECTIONS)
        self.store(collection).drop("")

    def reset(self) -> None:
        """Removes all collections and their tables."""
        for row in self.collections().select("id").collect():
            self.remove_collection(row["id"])

    def store(self, collection: int) -> Store:
        return Store(self.spark, f"{self.base}/{collection}")

    # Indexing

    def ingest(self, collection: int) -> Ingest:
        """The collection's ingestion; the one that cancel() stops."""
        limits = Limits(self.settings.files_per_batch, self.settings.bytes_per_batch)
        self._running[collection] = Ingest(self.spark, self.store(collection), str(collection), self.extractor, self.ocr, self.progress, limits)
        return self._running[collection]

    def index(self, collection: int, ocr: bool = False, dry_run: bool = False) -> Outcome:
        """One incremental run; with ocr also a pass over files without text; a dry run only looks for changes."""
        folder = self.get_collection(collection)["folder"]
        step, began = self.ingest(collection), time.monotonic()
        context = self.spark.sparkContext
        context.setJobGroup(self._group(collection), f"index collection {collection}", True)
        try:
            out = step.run(folder, index=not dry_run)
            if ocr and not dry_run:
                step.run_ocr(folder, self.settings.ocr_retries)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        if not dry_run:
            self.update_collection(collection, doc_count=self.documents(collection).count(), indexed=True)
            self.metrics.batch(out.indexed + out.errors, (time.monotonic() - began) * 1000)
        if self.log:
            self.log(f"collection {collection}: {out}")
        return out

    @staticmethod
    def _group(collection: int) -> str:
        return f"index-{collection}"

    def cancel(self, collection: int) -> None:
        """Stops a collection's indexing: no further batch is claimed and running jobs end; the next run takes unfinished files."""
        if collection in self._running:
            self._running[collection].cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self._group(collection))

    # Tables

    def documents(self, collection: int | None = None) -> DataFrame:
        return self._all("documents", schema.DOCUMENTS, collection)

    def postings(self, collection: int | None = None) -> DataFrame:
        return self._all("postings", schema.POSTINGS, collection)

    def positions(self, collection: int) -> DataFrame:
        return self.store(collection).read("positions", schema.POSITIONS)

    def jobs(self, collection: int) -> DataFrame:
        return self.store(collection).read("jobs", schema.JOBS)

    def _all(self, table, shape, collection):
        ids = [collection] if collection is not None else [r["id"] for r in self.collections().select("id").collect()]
        out = None
        for i in ids:
            own = self._readable(i, table, shape)
            if own is not None:
                out = own if out is None else out.unionByName(own)
        return self.spark.createDataFrame([], shape) if out is None else out

    def _readable(self, collection: int, table: str, shape) -> DataFrame | None:
        """A collection's table; None if it was never indexed, or (told to the log) cannot be read."""
        store = self.store(collection)
        try:
            return store.read(table, shape) if store.version(table) else None
        except (AnalysisException, ValueError) as e:
            if self.log:
                self.log(f"collection {collection} is left out: {str(e).splitlines()[0]}")
            return None

    # Search

    def statistics(self, docs: DataFrame) -> DataFrame:
        """One row for each collection, from the token counts that the document table keeps."""
        return docs.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avg_length"))

    def engine(self, collection: int | None = None) -> search.IndexEngine:
        """The index of a collection, or of all that can be read; every collection has its own statistics."""
        docs = self.documents(collection)
        return search.IndexEngine(docs, self.postings(collection), self.statistics(docs))

    def pipeline(self, collection: int) -> search.SearchPipeline:
        docs = self.documents(collection)
        return search.SearchPipeline(self.engine(collection), [search.TermCollector(), search.Snippets(docs, self.settings.snippet_width), search.PositionEnricher(self.positions(collection))], self.log)

    def tree(self, request: search.SearchInput) -> object:
        return request.tree(self.builders)

    def search(self, collection: int, request: search.SearchInput | str) -> dict:
        if isinstance(request, str):
            request = search.SearchInput(request)
        pipeline = self.pipeline(collection)
        pipeline.builders = self.builders
        began = time.monotonic_ns()
        try:
            return pipeline.response(request)
        finally:
            self.metrics.search(time.monotonic_ns() - began)

    def search_json(self, collection: int, text: str) -> dict:
        return self.search(collection, search.SearchInput.from_json(text, tuple(self.builders)))

    def search_all(self, request: search.SearchInput, boosts: dict[int, float] | None = None) -> DataFrame:
        """The best hits of all indexed collections from their postings; those that cannot be read are left out."""
        if any(b <= 0 for b in (boosts or {}).values()):
            raise ValueError("boosts are above 0")
        hits = self.engine().search(self.tree(request), request.path_filter)
        if boosts:
            rows = self.spark.createDataFrame([(str(k), float(v)) for k, v in boosts.items()], "collection_id string, boost double")
            hits = search.boosted(hits, rows)
        return lower.top(hits, request.limit, request.offset)

    def count(self, request: search.SearchInput, collection: int | None = None) -> int:
        """Hits of the same filters as the search, in one collection or all."""
        return self.engine(collection).search(self.tree(request), request.path_filter).count()

    def snippet(self, collection: int, doc_id: int, text: str) -> str:
        terms = [t for x in Q.all_leaves(Q.auto_phrase(text)) for t in ([x.text] if isinstance(x, Q.Term) else x.terms)]
        row = self.documents(collection).where(F.col("doc_id") == doc_id).first()
        return search.snippet_of(row["content"], terms, self.settings.snippet_width) if row else ""

    def term_offsets(self, collection: int, doc_id: int, term: str) -> list[int]:
        row = self.postings(collection).where((F.col("doc_id") == doc_id) & (F.col("term") == term)).first()
        return list(row["positions"]) if row else []

    def term_positions(self, collection: int, doc_id: int, matched_terms: list[str], groups: list[list[str]]) -> DataFrame:
        return P.term_positions(self.positions(collection).where(F.col("doc_id") == doc_id), matched_terms, groups)

    def load_positions(self, collection: int, doc_id: int) -> DataFrame:
        """All words of a document in order; a document without any is an error."""
        own = self.positions(collection).where(F.col("doc_id") == doc_id)
        if own.isEmpty():
            raise KeyError(f"no positions of document {doc_id}")
        return own.orderBy("word_offset")

    def transform_flags(self, collection: int, doc_id: int) -> int | None:
        """How a document's positions were transformed; None where they come from before that was written down."""
        self.load_positions(collection, doc_id)
        return TRANSFORMED if (self.store(collection).schema_version("positions") or 0) >= 2 else None

    def position_count(self, collection: int, doc_id: int) -> int:
        return self.positions(collection).where(F.col("doc_id") == doc_id).count()

    # Statistics

    def collection_stats(self, collection: int) -> dict:
        n, size = self.store(collection).files("postings")
        return {"num_docs": self.documents(collection).count(), "num_segments": n, "size_bytes": size}

    def stats(self) -> dict:
        row = self.collections().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_count"), F.lit(0)).alias("d"), F.count("last_indexed").alias("i")).first()
        return {"collections": row["n"], "documents": row["d"], "indexed_collections": row["i"]}

    def problems(self, collection: int) -> DataFrame:
        return J.with_status(self.jobs(collection), "error").select("id", "path", "error")

    def optimize(self, collection: int) -> tuple[int, int]:
        return self.store(collection).compact("postings", schema.POSTINGS, ("term", "doc_id"))

    def language_counts(self, collection: int) -> DataFrame:
        return self.documents(collection).groupBy(T.detect_language("content").alias("language")).count()
