"""Lowering of query trees to DataFrames: over documents (scan) or over an inverted index (postings).

Both give (doc_id, score, …) of the matching rows and nothing else: texts are joined to the few rows of a page later.
BM25 with k1 = 1.2 and b = 0.75; idf = ln(1 + (N - n + 0.5) / (n + 0.5)); a phrase counts its occurrences, with the sum of
its terms' idf; fuzzy and regex leaves score 1. Statistics are those of the searched corpus (one row).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import query as Q

K1, B = 1.2, 0.75


def score(tf: Column, length: Column, average: Column | float, idf: Column | float) -> Column:
    idf, average = (x if isinstance(x, Column) else F.lit(float(x)) for x in (idf, average))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def idf(total: int, holding: int) -> float:
    return math.log(1 + (total - holding + 0.5) / (holding + 0.5))


#: Leaves whose score is the constant 1.
UNSCORED = (Q.Regex, Q.OneOf)


def _is(term: Column, leaf: object) -> Column:
    """Whether a term is one that such a leaf stands for."""
    return term.isin(list(leaf.terms)) if isinstance(leaf, Q.OneOf) else term.rlike(f"^(?:{leaf.pattern})$")


def _tf(leaf: object, tokens: Column) -> Column:
    """Occurrences of a leaf in a token array."""
    if isinstance(leaf, Q.Term):
        return F.size(F.filter(tokens, lambda x: x == leaf.text))
    if isinstance(leaf, Q.Phrase):
        n, terms = len(leaf.terms), leaf.terms
        if not any(terms[:k] == terms[-k:] for k in range(1, n)):
            # No occurrence overlaps another: what is left of the text without them tells their number. Every token has its
            # own space on both sides, so neighbours share none.
            said, phrase = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" ")), f" {'  '.join(terms)} "
            gone = F.octet_length(said) - F.octet_length(F.replace(said, F.lit(phrase), F.lit("")))
            return F.floor(gone / len(phrase.encode())).cast("int")
        # Neighbouring tokens side by side, in one pass.
        shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0))) for i in range(n)]
        zipped = F.arrays_zip(*[s.alias(f"t{i}") for i, s in enumerate(shifted)])
        return F.size(F.filter(zipped, lambda x: reduce(lambda a, b: a & b, [x[f"t{i}"] == t for i, t in enumerate(terms)])))
    if isinstance(leaf, UNSCORED):
        return F.size(F.filter(tokens, lambda x: _is(x, leaf)))
    raise Q.QueryError(f"cannot count {leaf!r}")


def matches(query: object, of: dict[object, Column]) -> Column:
    """Truth of a tree, given each leaf's number of occurrences."""
    if isinstance(query, Q.All):
        return F.lit(True)
    if isinstance(query, Q.Nothing):
        return F.lit(False)
    if isinstance(query, Q.Boost):
        return matches(query.query, of)
    if isinstance(query, Q.Bool):
        own = lambda qs: [matches(q, of) for q in qs]
        out = reduce(lambda a, b: a & b, own(query.must)) if query.must else reduce(lambda a, b: a | b, own(query.should)) if query.should else F.lit(True)
        return reduce(lambda a, b: a & b, [out, *[~x for x in own(query.must_not)]])
    return of[query] > 0


def _expanded(query: object, vocabulary) -> object:
    """Fuzzy leaves become the terms they stand for; vocabulary(keep) gives distinct terms (term) that a filter keeps."""
    if isinstance(query, Q.Fuzzy):
        maybe = vocabulary(T.maybe_near(F.col("term"), query.text, query.distance))
        found = maybe.where(T.edit_distance(query.text)(F.col("term")) <= query.distance)
        near = tuple(sorted(r["term"] for r in found.collect()))  # terms within two edits of one word
        return Q.OneOf(near) if near else Q.Nothing()
    if isinstance(query, Q.Bool):
        return Q.Bool(*[tuple(_expanded(q, vocabulary) for q in side) for side in (query.must, query.should, query.must_not)])
    if isinstance(query, Q.Boost):
        return Q.Boost(_expanded(query.query, vocabulary), query.weight)
    return query


def path_filter(pattern: str | None) -> Column | None:
    """The whole path must match; no pattern, no filter."""
    if not pattern:
        return None
    try:
        import re

        re.compile(pattern)
    except re.error as e:
        raise Q.QueryError(f"bad path pattern: {e}") from e
    return F.col("path").rlike(f"^(?:{pattern})$")


def _check(query: object) -> None:
    if not Q.positive(query):
        raise Q.QueryError("a query cannot only exclude")


def scan(docs: DataFrame, query: object, path: str | None = None, per_collection: bool = False) -> DataFrame:
    """(collection_id, doc_id, path, score) of the matching documents (doc_id, path, content[, collection_id]).

    With per_collection, each collection has its own statistics.
    """
    _check(query)
    if "collection_id" not in docs.columns:
        docs = docs.withColumn("collection_id", F.lit(None).cast("string"))
    base = docs.select("collection_id", "doc_id", "path", T.tokens(F.col("content")).alias("tokens"))
    query = _expanded(query, lambda keep: base.select(F.explode("tokens").alias("term")).where(keep).distinct())
    all_leaves = list(dict.fromkeys(Q.all_leaves(query)))
    scored = [(x, w) for x, w in Q.leaves(query) if not isinstance(x, UNSCORED)]
    terms = sorted({t for x, _ in scored for t in ([x.text] if isinstance(x, Q.Term) else x.terms)})
    counts = {x: f"_tf{i}" for i, x in enumerate(all_leaves)}
    slim = base.select("collection_id", "doc_id", "path", F.size("tokens").alias("_dl"), *[_tf(x, F.col("tokens")).alias(c) for x, c in counts.items()])
    hit = slim.where(matches(query, {x: F.col(c) for x, c in counts.items()}))
    keep = path_filter(path)
    if keep is not None:
        hit = hit.where(keep)
    out = F.lit(0.0)
    if scored:
        keys = ["collection_id"] if per_collection else []
        stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("tokens")).alias("_avg"), *[F.sum(F.array_contains("tokens", t).cast("long")).alias(f"_df{i}") for i, t in enumerate(terms)])
        if per_collection:
            hit = hit.join(stats, "collection_id")
            n, avg = F.col("_n"), F.col("_avg")
            weight = {t: F.log(1 + (n - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) for i, t in enumerate(terms)}
        else:
            row = stats.first()
            avg = F.lit(row["_avg"] or 1.0)
            weight = {t: F.lit(idf(row["_n"], row[f"_df{i}"] or 0)) for i, t in enumerate(terms)}
        for x, w in scored:
            own = [x.text] if isinstance(x, Q.Term) else x.terms
            out = out + F.lit(w) * score(F.col(counts[x]), F.col("_dl"), avg, reduce(lambda a, b: a + b, [weight[t] for t in own]))
    for x, w in Q.leaves(query):
        if isinstance(x, UNSCORED):
            out = out + F.when(F.col(counts[x]) > 0, F.lit(float(w))).otherwise(F.lit(0.0))
    return hit.select("collection_id", "doc_id", "path", out.alias("score"))


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index of documents (doc_id, content[, collection_id]): one row for each term of each document."""
    if "collection_id" not in docs.columns:
        docs = docs.withColumn("collection_id", F.lit(None).cast("string"))
    toks = docs.select("collection_id", "doc_id", T.tokens(F.col("content")).alias("t")).withColumn("doc_length", F.size("t"))
    flat = toks.select("collection_id", "doc_id", "doc_length", F.posexplode("t").alias("pos", "term"))
    grouped = flat.groupBy("collection_id", "doc_id", "doc_length", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("collection_id", "term", "doc_id", F.size("positions").alias("tf"), "doc_length", "positions")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, doc_freq, total_freq) of documents (content): each task sums its own terms, and only the sums are exchanged."""
    toks = docs.select(T.tokens(F.col("content")).alias("t"))
    once = lambda first: lambda x: F.struct(x.alias("term"), F.lit(first).alias("first"))
    said = toks.select(F.inline(F.concat(F.transform("t", once(0)), F.transform(F.array_distinct("t"), once(1)))))
    return said.groupBy("term").agg(F.sum("first").alias("doc_freq"), F.sum(1 - F.col("first")).alias("total_freq"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row for each collection: documents and mean length in tokens."""
    return docs.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(T.tokens(F.col("content")))).alias("avg_length"))


def search_postings(index: DataFrame, stats: DataFrame, query: object) -> DataFrame:
    """(collection_id, doc_id, score) of the matching documents, from the index alone; statistics by collection.

    Only rows of the query's terms are read (the index is sorted by term); one aggregation by document follows.
    """
    _check(query)
    query = _expanded(query, lambda keep: index.select("term").where(keep).distinct())
    all_leaves = list(dict.fromkeys(Q.all_leaves(query)))
    if not all_leaves:
        raise Q.QueryError("match-all needs the document table, not the index")
    terms = sorted({t for x in all_leaves if not isinstance(x, UNSCORED) for t in ([x.text] if isinstance(x, Q.Term) else x.terms)})
    wanted = F.col("term").isin(terms)
    for x in all_leaves:
        if isinstance(x, UNSCORED):
            wanted = wanted | _is(F.col("term"), x)
    rows = index.where(wanted)
    name = {t: i for i, t in enumerate(terms)}
    empty = F.array().cast("array<int>")
    regexes = [x for x in all_leaves if isinstance(x, UNSCORED)]
    by_doc = rows.groupBy("collection_id", "doc_id").agg(
        F.max("doc_length").alias("_dl"),
        *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), empty).alias(f"_p{i}") for t, i in name.items()],
        *[F.sum(F.when(_is(F.col("term"), x), F.col("tf")).otherwise(0)).alias(f"_r{i}") for i, x in enumerate(regexes)],
    )
    df = rows.groupBy("collection_id").agg(*[F.sum((F.col("term") == t).cast("long")).alias(f"_df{i}") for t, i in name.items()]) if terms else None

    def tf(x):
        if isinstance(x, Q.Term):
            return F.size(f"_p{name[x.text]}")
        if isinstance(x, UNSCORED):
            return F.col(f"_r{regexes.index(x)}")
        starts = F.col(f"_p{name[x.terms[0]]}")
        for j, t in enumerate(x.terms[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.col(f"_p{name[t]}"), _back(j)))
        return F.size(starts)

    of = {x: F.col(f"_tf{i}") for i, x in enumerate(all_leaves)}
    hit = by_doc.select("*", *[tf(x).alias(f"_tf{i}") for i, x in enumerate(all_leaves)]).where(matches(query, of))
    for side in (stats, df):
        if side is not None:
            hit = hit.join(side.withColumnRenamed("collection_id", "_c"), F.col("collection_id").eqNullSafe(F.col("_c"))).drop("_c")
    out = F.lit(0.0)
    for x, w in Q.leaves(query):
        if isinstance(x, UNSCORED):
            out = out + F.when(of[x] > 0, F.lit(float(w))).otherwise(F.lit(0.0))
            continue
        n = F.col("n_docs")
        own = [x.text] if isinstance(x, Q.Term) else x.terms
        weight = reduce(lambda a, b: a + b, [F.log(1 + (n - F.col(f"_df{name[t]}") + 0.5) / (F.col(f"_df{name[t]}") + 0.5)) for t in own])
        out = out + F.lit(w) * score(of[x], F.col("_dl"), F.col("avg_length"), weight)
    return hit.select("collection_id", "doc_id", out.alias("score"))


def _back(places: int):
    return lambda p: p - F.lit(places)


def top(hits: DataFrame, limit: int, offset: int = 0, ties: tuple[str, ...] = ("collection_id", "doc_id")) -> DataFrame:
    """A page of the best hits; ties by collection and id, or in the order named."""
    return best_first(hits, ties).offset(max(offset, 0)).limit(max(limit, 0))


def best_first(hits: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    return hits.orderBy(F.desc("score"), *[F.asc(c) for c in ties if c in hits.columns])
