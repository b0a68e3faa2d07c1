"""Connected components of an edge table, by local contraction and alternating large and small stars.

Nothing is gathered on the driver but two numbers a round; a node with a third of all edges is only ever a join key
whose partition can be split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import parts, shared


class Forest:
    """Union-find that keeps the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = up.setdefault(x, x)
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches):
    """Edges of a partition as (member, smallest member) of its own components."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            forest.join(x, y)
    nodes = np.array([x for x in forest.up if forest.find(x) != x], np.int64)
    roots = np.array([forest.find(int(x)) for x in nodes], np.int64)
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], names=["a", "b"])


#: Edges that one task contracts at most.
PART_EDGES = 1 << 20


def _write(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """A written edge table, with its count and a sum over its rows from the same job."""
    seen = Observation()
    out = shared.written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), name)
    return out, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach, for every node that is not itself the smallest.

    Tasks contract bounded shares of the edges first (a small table is done then); rounds of stars join the shares.
    """
    raw, (n, _) = _write(edges.select("a", "b").where("a <> b"), "edges")
    e, state = _write(raw.coalesce(-(-n // PART_EDGES) or 1).mapInArrow(parts.lean(_contract), "a long, b long"), "edges")
    shared.remove(raw)
    while state[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = shared.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = shared.written(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # a node keeps few smaller neighbours, so no key is hot here
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        before, old = state, e
        e, state = _write(small.where("a <> b").distinct(), "edges")
        shared.remove(old, least, large)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
