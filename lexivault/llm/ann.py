"""Approximate nearest neighbours by few stable projections, indexed by kd-trees, with a chi-square stopping test.

Vectors are projected to a few dimensions by a fixed Gaussian matrix (a 2-stable law) whose columns are made orthogonal.
For a Gaussian matrix the squared projected distance of two vectors, over their squared distance, follows a chi-square
law with as many degrees of freedom as projections; orthogonal columns only narrow it, so its upper quantile stays a safe
bound. How many projections are useful depends on the data: ``learn`` takes the fewest (of ``DIMS``) that leave at most
``SHARE`` of a bounded sample (``SAMPLE`` rows) to verify. The sample also gives each query a first bound of its k-th distance.

The rows are dealt into blocks; each block indexes all its projected vectors in a kd-tree and takes in the queries. For
each query the block's vectors come in rising projected distance, leaf by leaf, and are verified in the original space,
until a vector as near as the k-th best so far would have come by now with probability ``CONFIDENCE``: the test holds when
the next projected distance squared exceeds the chi-square quantile times the k-th best distance squared. So each true
neighbour is missed with a probability below 1 - CONFIDENCE. Ties are never cut: vectors as far as the k-th best are told
apart by the smaller id. Vectors of no more dimensions than projections are searched as they are, and exactly.

Queries are broadcast in blocks of bounded size; every row is in the index. Distances are Euclidean, in double precision on
the original vectors. Null, zero and non-finite vectors (and vectors of another length than the first query's) take no
part; repeated rows are candidates each; a query's own row is no candidate for it; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import parts

#: Numbers of projections to choose from, and the share of rows to verify that is aimed at.
DIMS, SHARE = (8, 16, 24, 32, 40, 48), 0.25
CONFIDENCE, LEAF, SEED = 0.9, 256, 20150824
#: Rows of the sample, and sampled queries, at most.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Rows of an index block, and numbers (queries x dimensions) of a block of queries, at most.
BLOCK_ROWS, QUERY_NUMBERS = 1 << 16, 1 << 22
OUT = "query_id long, vec_id long, score double, verified long"


def chi_square(x: float, dims: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


def projection(dims: int, count: int) -> np.ndarray:
    """Gaussian columns, made orthogonal, and as long as Gaussian ones are on average; the identity if count is dims."""
    if count >= dims:
        return np.eye(dims)
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, count)))[0] * math.sqrt(dims)


def learn(sample: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, float]:
    """The projection with the fewest useful dimensions, and the factor of its stopping test."""
    dims = sample.shape[1]
    choices = [m for m in DIMS if m <= 3 * dims // 4]
    if not choices:
        return np.eye(dims), 1.0
    some = sample[np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)] if len(sample) else sample
    exact = np.sort(_squares(some, sample), axis=1)[:, min(k, max(len(sample) - 1, 0))] if len(sample) else np.zeros(0)
    for m in choices:
        matrix, factor = projection(dims, m), quantile(confidence, m)
        if not len(sample) or (_squares(some @ matrix, sample @ matrix) <= factor * exact[:, None]).mean() <= SHARE:
            break
    return matrix, factor


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b (of bounded size), about as exact as the squares of the norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def first_bounds(ids: np.ndarray, vectors: np.ndarray, own_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query, a bound of the squared distance of its k-th nearest: that in the sample, its own row left out."""
    out = np.full(len(vectors), np.inf)
    for a in range(0, len(vectors) if len(sample) > k else 0, 1024):
        d = _squares(vectors[a : a + 1024], sample)
        d[ids[a : a + 1024, None] == own_ids[None, :]] = np.inf
        scale = (vectors[a : a + 1024] ** 2).sum(1) + (sample**2).sum(1).max()
        out[a : a + 1024] = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 * scale  # above any error of the squares
    return out


class KdTree:
    """Median splits down to leaves, each with the box of its points."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        todo = [(0, len(points))]
        while todo:
            begin, end = todo.pop()
            own = self.points[self.order[begin:end]]
            spread = np.ptp(own, axis=0)
            axis = int(spread.argmax())
            if end - begin <= LEAF or spread[axis] == 0:
                self.leaves.append((begin, end))
                continue
            mid = (end - begin) // 2
            self.order[begin:end] = self.order[begin:end][np.argpartition(own[:, axis], mid)]
            todo += [(begin, begin + mid), (begin + mid, end)]
        boxes = [self.points[self.order[a:b]] for a, b in self.leaves]
        self.low, self.high = np.array([x.min(0) for x in boxes]), np.array([x.max(0) for x in boxes])

    def rising(self, q: np.ndarray):
        """Leaves (as index arrays) by rising squared distance of their boxes from q, which no later point is below."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        bound = (gap * gap).sum(1)
        for i in np.argsort(bound, kind="stable"):
            begin, end = self.leaves[i]
            yield float(bound[i]), self.order[begin:end]


def _search(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, own_id: int, q: np.ndarray, projected: np.ndarray, k: int, factor: float, limit: float):
    """The k nearest of a block's vectors, and how many were verified; limit: a known bound of the k-th squared distance."""
    best_d, best_i, verified = np.zeros(0), np.zeros(0, np.int64), 0
    for bound, leaf in tree.rising(projected):
        kth = min(best_d[-1], limit) if len(best_d) == k else np.inf
        if bound > factor * kth:
            break
        leaf = leaf[ids[leaf] != own_id]
        near = ((tree.points[leaf] - projected) ** 2).sum(1)
        if len(best_d) < k:  # the first k come as they are nearest in projection
            take = np.argsort(near, kind="stable")[: k - len(best_d)]
            d = ((vectors[leaf[take]] - q) ** 2).sum(1)
            verified += len(take)
            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[leaf[take]]])
            order = np.lexsort((best_i, best_d))
            best_d, best_i = best_d[order], best_i[order]
            if len(best_d) < k:
                continue
            rest = np.ones(len(leaf), bool)
            rest[take] = False
            leaf, near = leaf[rest], near[rest]
        leaf = leaf[near <= factor * min(best_d[-1], limit)]
        if len(leaf):
            d, i = np.concatenate([best_d, ((vectors[leaf] - q) ** 2).sum(1)]), np.concatenate([best_i, ids[leaf]])
            verified += len(leaf)
            order = np.lexsort((i, d))[:k]
            best_d, best_i = d[order], i[order]
    return best_d, best_i, verified


def _valid(vectors: np.ndarray) -> np.ndarray:
    return np.isfinite(vectors).all(1) & (vectors != 0).any(1)


def _matrix(ids: pa.Array, column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    ids, column = ids.filter(fits), column.filter(fits)
    v = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # null becomes nan
    ok = _valid(v)
    return pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False)[ok], v[ok]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) of the k nearest rows found for each query; verified: distances computed for it."""
    spark = rows.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    first = asked.where("size(vec) > 0").select(F.size("vec")).first()
    dims = first[0] if first else 1
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    n, blocks_of = rows.count(), -(-asked.count() * dims // QUERY_NUMBERS)
    tasks = parts.partitions(spark)
    dealt = plain.repartition(max(min(tasks, -(-n // 1024)), -(-n // BLOCK_ROWS), 1), "id")
    drawn = plain if n <= SAMPLE else plain.sample(fraction=min(1.0, 1.5 * SAMPLE / n), seed=SEED).limit(SAMPLE)
    drawn = drawn.toArrow() if blocks_of else plain.limit(0).toArrow()  # a sample of bounded size
    sample_ids, sample = _matrix(drawn["id"].combine_chunks(), drawn["vec"].combine_chunks(), dims)
    matrix, factor = learn(sample, k, confidence)
    found = spark.createDataFrame([], OUT)
    for block in range(blocks_of):
        own = asked if blocks_of == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks_of)) == block)
        got = own.toArrow()  # a block of bounded size
        q_ids, q = _matrix(got["id"].combine_chunks(), got["vec"].combine_chunks(), dims)
        order = np.argsort(q_ids, kind="stable")
        q_ids, q = q_ids[order], q[order]
        asked_now = spark.sparkContext.broadcast((q_ids, q, matrix, first_bounds(q_ids, q, sample_ids, sample, k)))

        def run(batches, asked_now=asked_now):
            q_ids, q, matrix, limits = asked_now.value
            projected = q @ matrix
            schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])

            def block(ids, vectors):
                tree = KdTree(vectors @ matrix)
                out = []
                for qi, qv, qp, limit in zip(q_ids.tolist(), q, projected, limits.tolist()):
                    d, i, verified = _search(tree, ids, vectors, qi, qv, qp, k, factor, limit)
                    # The block's count stands in its first row alone, so counts add up.
                    out.append((np.full(len(d), qi), i, np.sqrt(d), np.where(np.arange(len(d)) == 0, verified, 0)))
                cols = [np.concatenate(c) for c in zip(*out)]
                return pa.RecordBatch.from_arrays([pa.array(c).cast(t.type) for c, t in zip(cols, schema)], schema=schema)

            held, size = [], 0
            for b in batches:
                ids, vectors = _matrix(b.column(0), b.column(1), dims)
                held.append((ids, vectors))
                size += len(ids)
                if size >= BLOCK_ROWS:
                    yield block(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
            if size and len(q_ids):
                yield block(*map(np.concatenate, zip(*held)))

        found = found.union(dealt.mapInArrow(parts.lean(run), OUT))
    own = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy("score", "vec_id"))).withColumn("verified", F.sum("verified").over(own))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
