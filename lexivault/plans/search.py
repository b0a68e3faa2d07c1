"""Search: request in, page of enriched hits out."""

from __future__ import annotations

import html
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lower
from . import query as Q


@dataclass
class SearchInput:
    query: str
    limit: int = 50
    offset: int = 0
    path_filter: str | None = None
    strategy: str = "auto_phrase"
    collection_id: str | None = None
    clauses: list[tuple[str, str]] | None = None

    @classmethod
    def from_json(cls, text: str, builders: tuple[str, ...] = ()) -> SearchInput:
        """Unknown strategies fall back to auto_phrase; builders are names of further ones."""
        got = json.loads(text)
        out = cls(got.get("query", ""), int(got.get("limit", 50)), int(got.get("offset", 0)), got.get("path_filter"), got.get("strategy", "auto_phrase"), got.get("collection_id"))
        if out.strategy not in Q.STRATEGIES and out.strategy not in builders:
            out.strategy = "auto_phrase"
        return out

    def tree(self, builders: dict[str, QueryBuilder] | None = None) -> object:
        if self.clauses:
            return Q.structured(self.clauses)
        builder = (builders or {}).get(self.strategy) or StrategyBuilder(self.strategy)
        tree = builder.build(self.query)
        return Q.All() if tree == Q.Nothing() and self.path_filter and not self.query.strip() else tree


class QueryBuilder(ABC):
    """Turns a query string into a tree; its name is a strategy of requests."""

    name = ""

    @abstractmethod
    def build(self, text: str) -> object: ...


class StrategyBuilder(QueryBuilder):
    """One of the query language's own strategies."""

    def __init__(self, name: str):
        if name not in Q.STRATEGIES:
            raise Q.UnknownStrategy(name)
        self.name = name

    def build(self, text):
        return Q.STRATEGIES[self.name](text)


class KindBuilder(QueryBuilder):
    """The viewer's kinds of queries: standard, fuzzy, regex, phrase."""

    def __init__(self, kind: str):
        self.name = kind

    def build(self, text):
        return Q.by_kind(self.name, text)


class SearchEngine(ABC):
    """Runs a tree over a corpus."""

    @abstractmethod
    def search(self, tree: object, path_filter: str | None = None) -> DataFrame: ...

    def count(self, tree: object, path_filter: str | None = None) -> int:
        return self.search(tree, path_filter).count()


class ScanEngine(SearchEngine):
    def __init__(self, docs: DataFrame):
        self.docs = docs

    def search(self, tree, path_filter=None):
        return lower.scan(self.docs, tree, path_filter)


class IndexEngine(SearchEngine):
    """Searches postings; the document table gives paths."""

    def __init__(self, docs: DataFrame, index: DataFrame, stats: DataFrame):
        self.docs, self.index, self.stats = docs, index, stats

    def search(self, tree, path_filter=None):
        paths = self.docs.select(*[c for c in ("collection_id", "doc_id", "path") if c in self.docs.columns])
        if "collection_id" not in paths.columns:
            paths = paths.withColumn("collection_id", F.lit(None).cast("string"))
        keep = lower.path_filter(path_filter)
        if keep is not None:
            paths = paths.where(keep)
        if isinstance(tree, (Q.All, Q.Nothing)):
            paths = paths if isinstance(tree, Q.All) else paths.limit(0)
            return paths.select("collection_id", "doc_id", "path", F.lit(0.0).alias("score"))
        hits = lower.search_postings(self.index, self.stats, tree).alias("h")
        same = F.col("h.doc_id") == F.col("p.doc_id")
        if "collection_id" in self.docs.columns:
            same = same & F.col("h.collection_id").eqNullSafe(F.col("p.collection_id"))
        return hits.join(paths.alias("p"), same).select("h.collection_id", "h.doc_id", "p.path", "h.score")


class ResultEnricher(ABC):
    """Adds columns to a page of hits."""

    name = ""
    depends_on: tuple[str, ...] = ()

    @abstractmethod
    def enrich(self, hits: DataFrame, request: SearchInput) -> DataFrame: ...


class TermCollector(ResultEnricher):
    name = "terms"

    def enrich(self, hits, request):
        groups, flat = (Q.boolean_phrase_groups if request.strategy == "boolean_phrase" else Q.auto_phrase_groups)(request.query)
        pack = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        return hits.withColumn("matched_terms", pack(flat)).withColumn("phrase_groups", F.array(*[pack(g) for g in groups]).cast("array<array<string>>"))


def snippet_of(text: str, terms: list[str], width: int = 150) -> str:
    """The stretch of at most width characters with the most different query terms (then the earliest), marked up."""
    found = [(m.start(), m.end(), m[0].lower()) for m in Q._token.finditer(text)]
    wanted = set(terms)
    hits = [(a, b, w) for a, b, w in found if w in wanted]
    if not hits:
        return ""
    best, at = 0, hits[0][0]
    for i, (a, _, _) in enumerate(hits):
        own = {w for s, e, w in hits[i:] if e <= a + width}
        if len(own) > best:
            best, at = len(own), a
    begin = max(0, at - 20)
    end = min(len(text), begin + width)
    out, last = [], begin
    for a, b, _ in hits:
        if a >= begin and b <= end:
            out += [html.escape(text[last:a]), "<b>", html.escape(text[a:b]), "</b>"]
            last = b
    return "".join(out) + html.escape(text[last:end])


class Snippets(ResultEnricher):
    """Joins the texts of the few hits of a page and cuts a marked stretch out of each."""

    name = "snippet"

    def __init__(self, docs: DataFrame, width: int = 150):
        self.docs, self.width = docs, width

    def enrich(self, hits, request):
        tree = request.tree() if request.clauses or request.strategy in Q.STRATEGIES else Q.boolean_phrase(request.query)
        terms, width = [t for x in Q.all_leaves(tree) for t in ([x.text] if isinstance(x, Q.Term) else getattr(x, "terms", ()))], self.width

        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: snippet_of(t, terms, width), na_action="ignore")

        texts = self.docs.select("doc_id", "content")
        return hits.join(texts, "doc_id", "left").withColumn("snippet", cut("content")).drop("content")


class PositionEnricher(ResultEnricher):
    """Adds the boxes of the matched terms."""

    name = "positions"
    depends_on = ("terms",)

    def __init__(self, positions: DataFrame):
        self.positions = positions

    def enrich(self, hits, request):
        _, flat = Q.auto_phrase_groups(request.query)
        own = self.positions.where(F.lower("word_text").isin(flat or [""])).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("word_offset", "page", "x_min", "y_min", "x_max", "y_max", "word_text"))).alias("positions"))
        return hits.join(own, "doc_id", "left")


def in_order(enrichers: list[ResultEnricher]) -> list[ResultEnricher]:
    """Enrichers with what each depends on before it."""
    by_name = {e.name: e for e in enrichers}
    try:
        order = list(TopologicalSorter({e.name: [d for d in e.depends_on if d in by_name] for e in enrichers}).static_order())
    except CycleError as e:
        raise Q.EnricherError(f"enrichers depend on each other: {e.args[1]}") from e
    return [by_name[n] for n in order]


def page_number(offset: int, limit: int) -> int:
    return offset // limit + 1 if limit > 0 else 1


@dataclass
class SearchPipeline:
    engine: SearchEngine
    enrichers: list[ResultEnricher] = field(default_factory=list)
    log: Callable[[str], None] | None = None
    builders: dict[str, QueryBuilder] = field(default_factory=dict)
    #: Hits of like score stand by id; what ids of several collections share is told apart last.
    TIES: ClassVar[tuple[str, ...]] = ("doc_id", "collection_id")

    def hits(self, request: SearchInput) -> DataFrame:
        """All matching rows with scores."""
        return self.engine.search(request.tree(self.builders), request.path_filter)

    def page(self, request: SearchInput, hits: DataFrame | None = None) -> DataFrame:
        return lower.top(self.hits(request) if hits is None else hits, request.limit, request.offset, self.TIES)

    def rich(self, request: SearchInput, hits: DataFrame | None = None) -> DataFrame:
        out = self.page(request, hits)
        for e in in_order(self.enrichers):
            out = e.enrich(out, request)
        return lower.best_first(out, self.TIES)

    def json_hits(self, request: SearchInput) -> DataFrame:
        """The page with one JSON object a hit."""
        out = self.rich(request)
        return out.select(F.to_json(F.struct(*[c for c in out.columns if c != "content"])).alias("hit"))

    def response(self, request: SearchInput) -> dict:
        """The whole answer; total counts with the same filters as the search."""
        hits = self.hits(request).persist()  # ids, paths and scores, found once for the page and for the total
        try:
            rows = [r.asDict(recursive=True) for r in self.rich(request, hits).collect()]  # one page
            total = hits.count()
        finally:
            hits.unpersist()
        if self.log:
            self.log(f"search {request.query!r}: {total} hits")
        return {"success": True, "total_count": total, "page": page_number(request.offset, request.limit), "page_size": request.limit, "query": request.query, "strategy": request.strategy, "results": rows, "metadata": {}}


def federated(docs: DataFrame, tree: object, boosts: DataFrame | None = None, limit: int = 50, offset: int = 0, path_filter: str | None = None) -> DataFrame:
    """The best hits of all collections: statistics of each its own, scores times the collection's boost (1 if it has none)."""
    hits = lower.scan(docs, tree, path_filter, per_collection=True)
    return lower.top(hits if boosts is None else boosted(hits, boosts), limit, offset)


def boosted(hits: DataFrame, boosts: DataFrame) -> DataFrame:
    """Scores times the collection's boost (collection_id, boost); 1 if it has none."""
    return hits.join(boosts, "collection_id", "left").withColumn("score", F.col("score") * F.coalesce("boost", F.lit(1.0))).drop("boost")


#: Fixed value: what a snippet marks.
MARKED = r"<b>(.*?)</b>"


def snippet_runs(snippet: str) -> list[tuple[str, bool]]:
    """A marked snippet as runs of plain text, and whether each is marked."""
    out, last = [], 0
    for m in re.finditer(MARKED, snippet, re.S):
        out += [(snippet[last : m.start()], False), (m[1], True)]
        last = m.end()
    return [(html.unescape(t), b) for t, b in [*out, (snippet[last:], False)] if t]


def weighted_fields(docs: DataFrame, text: str, weights: dict[str, float], path_filter: str | None = None) -> DataFrame:
    """Hits of a query in several fields, each score times the field's weight; unknown fields are left out."""
    found = None
    for name, weight in weights.items():
        if name not in docs.columns:
            continue
        try:
            tree = Q.auto_phrase(text)
        except Q.QueryError:
            continue
        path = F.col("path") if name != "path" else docs["path"]
        own = lower.scan(docs.select("doc_id", path.alias("path"), F.col(name).alias("content")), tree, path_filter).select("doc_id", "path", (F.col("score") * weight).alias("score"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise Q.QueryError("no known field")
    return found.groupBy("doc_id", "path").agg(F.sum("score").alias("score"))


def field_search(docs: DataFrame, text: str, name: str, path_filter: str | None = None, distance: int | None = None) -> DataFrame:
    """A query in one field; words side by side are alternatives. With a distance, a fuzzy one (0: as written)."""
    if name not in docs.columns:
        raise Q.QueryError(f"field {name!r} not found in schema")
    tree = Q.parse(text, conjunction=False) if distance is None else Q.fuzzy(text, distance)
    return lower.scan(docs.select("doc_id", "path", F.col(name).alias("content")), tree, path_filter)


def stem_search(docs: DataFrame, text: str, path_filter: str | None = None) -> DataFrame:
    """There is no stemming: the same as a search of the text."""
    return lower.scan(docs, Q.auto_phrase(text), path_filter)


def recency_boost(hits: DataFrame) -> DataFrame:
    """Documents carry no date, so scores stay as they are."""
    return hits
