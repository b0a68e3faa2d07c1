"""N-gram Jaccard join: near copies by a blocked sparse matrix product of document by n-gram incidence.

1. Sets. Each document's set of word shingles is hashed. Documents with equal sets collapse into the one with the
   smallest id (they link by definition), found by the set's fingerprint.
2. Bounds. Documents are counted for every shingle. A link at similarity t needs t * |set| common shingles, so a document
   with fewer shingles that any other set holds is discarded at once.
3. Blocks. Of the rest, each keeps its shared shingles in one global order, rarest first; two sets that link share one of
   their first |shared| - t * |set| + 1. Stars over these prefixes, and their connected components, give groups that no
   link leaves. A group is cut into blocks of bounded size.
4. Product. In each block the incidence matrix times its transpose gives overlap counts: sparse columns by their pairs,
   fuller ones as dense slices, for pairs alone whose sizes allow a link; 7 * overlap >= 3 * (|A| + |B|) is one (t = 3/4).
5. A group of more than one block goes on: representatives of the blocks' components are multiplied, so a large group of
   near copies is soon one component. What is still apart is compared shingle by shingle (``crossing``): in the group of a
   prefix shingle, documents outside its most frequent component with those of like size. Pairs already connected are left
   out, so no link between components is lost; documents that share shingles and never link cost what their shingles'
   groups hold, not all pairs of the group.

Defined cases: null or blank text has the empty set and links with nothing; fewer words than a shingle make one shingle
of all; rows of one id are one node; null ids are one node that counts as 2**63 - 1, larger than all others; an empty table gives an
empty result. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, hashing, parts, shared

#: Documents and set entries of a block at most (a document larger than that has a block of its own).
BLOCK_DOCS, BLOCK_ENTRIES = 1024, 1 << 20
SETS = "doc long, n long, rep long, prefix array<long>, entries array<long>"


class _Sets:
    """Distinct shingles of each document of a part, sorted by hash, and the set's fingerprint."""

    def __init__(self, p: parts.Part, words: int):
        start, _, value = hashing.words(p.buf, lower=True)
        bounds = np.append(np.searchsorted(start, p.starts), len(start))
        count = np.diff(bounds)
        h = hashing.windows(value, words)
        short = np.zeros(len(p), np.uint64)
        for k in range(1, words):
            at = np.flatnonzero(count == k)
            if len(at):
                short[at] = hashing.windows(value, k)[bounds[at]]
        pieces, sizes = [], np.zeros(len(p), np.int64)
        for d, (a, n) in enumerate(zip(bounds[:-1].tolist(), count.tolist())):
            if not n:
                continue
            own = np.sort(h[a : a + n - words + 1]) if n >= words else short[d : d + 1]
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
            pieces.append(own)
            sizes[d] = len(own)
        self.n = sizes
        self.flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix(self.flat ^ np.uint64(0x5851F42D4C957F2D)))])
        self.mark = hashing.mix(total[self.at[1:]] - total[self.at[:-1]] + sizes.astype(np.uint64))
        self.full = np.flatnonzero(sizes)
        # Documents ascend by id, so the first of a mark has the smallest.
        self.marks, first, self.place = np.unique(self.mark[self.full], return_index=True, return_inverse=True)
        self.first = self.full[first]

    def of(self, docs: np.ndarray) -> np.ndarray:
        """Places in flat of the documents' entries."""
        n = self.n[docs]
        return np.repeat(self.at[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())


#: Kinds of keys: shingles, and fingerprints of whole sets.
SHINGLES, MARKS = 0, 1


def _send(words: int, layout: parts.Layout):
    def run(table: pa.Table) -> pa.Table:
        p = parts.Part(table, separator=True)
        s = _Sets(p, words)
        keys, count = np.unique(s.flat[s.of(s.first)], return_counts=True)
        shingles = parts.send(layout, p.number, keys, np.minimum(count, 255).astype(np.uint8), SHINGLES)
        return pa.concat_tables([shingles, parts.send(layout, p.number, s.marks, p.ids[s.first], MARKS)])

    return run


def _judge(kind: int, keys: np.ndarray, epochs: np.ndarray, extra: bytes) -> np.ndarray:
    """Answers a shingle with its class of frequency (0: only one set), a set's mark with the smallest id that has it."""
    distinct, place = np.unique(keys, return_inverse=True)
    if kind == SHINGLES:
        total = np.bincount(place, np.frombuffer(extra, np.uint8))
        return np.where(total < 2, 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(total, 1))).astype(np.int64)).astype(np.uint8)[place]
    least = np.full(len(distinct), parts.LAST, np.int64)
    np.minimum.at(least, place, np.frombuffer(extra, np.int64))
    return least[place]


def _needed(n):
    """Common shingles that a link needs at least: three quarters, rounded up."""
    return (3 * n + 3) // 4


def _keep(words: int):
    """Set sizes and representatives of all documents; prefixes and shared entries of those that may link."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        p = parts.Part(table, separator=True)
        s = _Sets(p, words)
        grade, least = parts.joined(replies, np.uint8, SHINGLES), parts.joined(replies, np.int64, MARKS)
        keys = np.unique(s.flat[s.of(s.first)])
        rep = p.ids.copy()
        rep[s.full] = least[s.place]
        prefix: list = [None] * len(p)
        entries: list = [None] * len(p)
        for d in s.first[least == p.ids[s.first]].tolist():
            own = s.flat[s.at[d] : s.at[d + 1]]
            g = grade[np.searchsorted(keys, own)]
            common = g > 0
            c, need = int(common.sum()), int(_needed(s.n[d]))
            if c >= need:
                own, g = own[common], g[common]
                own = own[np.argsort(g, kind="stable")].view(np.int64)  # by class, then by hash
                prefix[d], entries[d] = own[: c - need + 1], own
        many = pa.list_(pa.int64())
        return pa.table({"doc": pa.array(p.ids), "n": pa.array(s.n), "rep": pa.array(rep), "prefix": pa.array(prefix, many), "entries": pa.array(entries, many)})

    return run


#: Columns of at most so many entries are multiplied pair by pair, fuller ones as dense slices; rows of a tile.
SPARSE, TILE = 16, 128


def _overlaps(sizes: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs (i, j) with i < j whose sizes, which ascend, allow a link; others may stay too low.

    The incidence matrix times its transpose: sparse columns by their pairs, fuller ones as dense slices, tile by tile of
    rows against the columns of the product that the size bound leaves.
    """
    n = len(docs)
    flat = np.concatenate(docs)
    row = np.repeat(np.arange(n), [len(x) for x in docs])
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    out = np.zeros((n, n), np.float32)
    few = (count[column] > 1) & (count[column] <= SPARSE)  # a column with one entry adds to no pair
    r, c = row[few], column[few]
    for d in range(1, SPARSE):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        i, j = r[same], r[same + d]
        near = 4 * sizes[i] >= 3 * sizes[j]
        np.add.at(out, (i[near], j[near]), 1)
    full = count[column] > SPARSE
    r, c = row[full], np.unique(column[full], return_inverse=True)[1]
    upto = np.searchsorted(sizes, sizes * 4 // 3, "right")
    width = 2048
    for a in range(0, int(c.max()) + 1 if len(c) else 0, width):
        i, j = np.searchsorted(c, [a, a + width])
        x = np.zeros((n, width), np.float32)
        x[r[i:j], c[i:j] - a] = 1
        for b in range(0, n, TILE):
            end = min(b + TILE, n)
            out[b:end, b : upto[end - 1]] += x[b:end] @ x[b : upto[end - 1]].T
    return out


def _links(sizes: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Which pairs link, as a symmetric matrix."""
    order = np.argsort(sizes, kind="stable")
    own = sizes[order]
    up = np.triu(7 * _overlaps(own, [docs[i] for i in order]) >= 3 * (own[:, None] + own[None, :]), 1)
    out = np.zeros_like(up)
    out[np.ix_(order, order)] = up | up.T
    return out


def _groups(batches, keys: int):
    """Rows of consecutive equal keys (the first columns), as lists of columns, whole."""
    held, now = [], None
    for b in batches:
        t = pa.table(b)
        values = list(zip(*[t.column(k).to_pylist() for k in range(keys)]))
        a = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[a]:
                if held and values[a] != now:
                    yield pa.concat_tables(held)
                    held = []
                now = values[a]
                held.append(t.slice(a, i - a))
                a = i
    if held:
        yield pa.concat_tables(held)


EDGES = "a long, b long, degree long"


def _edges(a, b, degree) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b, degree)], names=["a", "b", "degree"])


def _inside(batches):
    """Blocks (group, block, doc, label, n, entries): (label, smallest label of its component in the block, links)."""
    for g in _groups(batches, 2):
        label = g["label"].to_numpy()
        if len(label) < 2:
            yield _edges(label, label, [0])
            continue
        link = _links(g["n"].to_numpy(), [np.asarray(x.values) for x in g["entries"]])
        yield _edges(label, _smallest(link, label), link.sum(1))


def _smallest(link: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row reaches."""
    out, left = label.copy(), np.ones(len(label), bool)
    for i in np.argsort(label):
        if left[i]:
            reached = np.zeros(len(label), bool)
            reached[i] = True
            edge = np.array([i])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(0) & ~reached)
                reached[edge] = True
            out[reached], left[reached] = label[i], False
    return out


#: What tells the blocks of two sides apart.
TASK = ["key", "band", "chunk", "block"]


def _across(batches):
    """Blocks of two sides: one link for each pair of components that a link joins."""
    for g in _groups(batches, len(TASK)):
        side = g["side"].to_numpy()
        if side.min() == side.max():
            continue
        label = g["label"].to_numpy()
        link = _links(g["n"].to_numpy(), [np.asarray(x.values) for x in g["entries"]])
        link &= (side[:, None] == 0) & (side[None, :] == 1) & (label[:, None] != label[None, :])
        i, j = np.nonzero(link)
        if len(i):
            pairs = np.unique(np.stack([label[i], label[j]], 1), axis=0)
            yield _edges(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)))


def _run(blocks: DataFrame, keys: list[str], run) -> DataFrame:
    tasks = parts.partitions(blocks.sparkSession)
    return blocks.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(parts.lean(run), EDGES)


def jaccard_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """Steps 1 and 2, as a written table: (doc, n, rep) of all rows; prefix and entries of those that may link."""
    dealt, layout = parts.deal(docs, id_col, text_col, part_bytes=part_bytes)
    texts = dealt.groupBy("part")
    replies = parts.exchange(texts.applyInArrow(parts.lean(_send(words, layout)), parts.KEYS), _judge, layout)
    out = shared.written(texts.cogroup(replies.groupBy("part")).applyInArrow(parts.lean(_keep(words)), SETS), "sets")
    del dealt, texts, replies
    shared.release(docs.sparkSession)
    return out


def crossing(prefixes: DataFrame, now: DataFrame) -> DataFrame:
    """What is still to be compared: (key, band, chunk, block, side, doc) for pairs that share a prefix shingle and no label.

    prefixes: prefix shingles (doc, prefix); now: (doc, label, n). Shingles with the same documents count once. In a shingle's
    group only documents outside its most frequent label are compared with the others, and only with those whose sizes
    allow a link (bands of sizes, neighbours included). Large groups are cut into chunks times blocks.
    """
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int").alias("band")
    held = prefixes.join(now, "doc").select("doc", "label", band, F.explode("prefix").alias("key"))
    group = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("docs"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("mark"))
    group = group.where("low <> high").groupBy("docs", "mark").agg(F.min("key").alias("key")).select("key")
    held = held.join(group, "key")
    common = held.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("common"))
    left = held.join(common, "key").where("label <> common").select("key", "band", "doc")
    right = held.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "doc")
    chunks = left.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / (BLOCK_DOCS // 2)).cast("int").alias("chunks"))
    blocks = right.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
    cut = chunks.join(blocks, ["key", "band"])
    left = left.join(cut, ["key", "band"]).select("key", "band", F.expr("cast(pmod(xxhash64(doc, 2), chunks) as int)").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"), "doc")
    right = right.join(cut, ["key", "band"]).select("key", "band", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.expr("cast(pmod(xxhash64(doc, 3), blocks) as int)").alias("block"), F.lit(1).alias("side"), "doc")
    return left.union(right)


def linked(sets: DataFrame) -> DataFrame:
    """Steps 3 to 5: (node, label) for each set that a link joins to one with a smaller id."""
    may = sets.where("entries is not null")
    keys = may.select(F.explode("prefix").alias("key"), "doc")
    hub = shared.written(keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub <> last").select("key", "hub"), "hubs")
    stars = keys.join(hub, "key").where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    coarse = graph.components(stars)
    group = shared.written(coarse.select(F.col("node").alias("doc"), F.col("label").alias("group")).union(coarse.select("label", "label").distinct()), "groups")
    members = may.select("doc", "n", "entries").join(group, "doc")
    weight = members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("entries")).alias("entries"))
    blocks = weight.select("group", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("entries") / BLOCK_ENTRIES)).cast("int").alias("blocks"))
    many = shared.written(blocks.where("blocks > 1"), "blocks")
    placed = members.join(many, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = shared.written(placed.select("group", F.expr("cast(pmod(xxhash64(doc), blocks) as int)").alias("block"), "doc", "n", "entries", "blocks"), "placed")
    cols = ["group", "block", "doc", "label", "n", "entries"]
    found = shared.written(_run(placed.withColumn("label", F.col("doc")).select(*cols), ["group", "block"], _inside), "inside")
    stars = found.select("a", "b").where("a <> b")
    if many.isEmpty():
        shared.remove(placed, group, many, hub)
        return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # Representatives of the blocks' components, against each other.
    wide = placed.where("blocks > 1")
    best = found.groupBy("b").agg(F.max_by("a", F.struct("degree", -F.col("a"))).alias("doc"))
    heads = wide.join(best, "doc").withColumn("label", F.col("b"))
    weight = heads.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum(F.size("entries")) / BLOCK_ENTRIES)).alias("k"))
    heads = heads.join(weight, "group").withColumn("block", F.expr("cast(pmod(xxhash64(doc, 1), k) as int)"))
    second = shared.written(_run(heads.select(*cols), ["group", "block"], _inside).select("a", "b").where("a <> b"), "heads")
    labels = graph.components(stars.union(second))
    now = wide.join(labels, wide["doc"] == labels["node"], "left").select("doc", F.coalesce("label", "doc").alias("label"), "n", "entries")
    now = shared.written(now.dropDuplicates(["doc"]), "labelled")
    # What those two rounds left apart, shingle by shingle.
    tasks = shared.written(crossing(may.select("doc", "prefix"), now.select("doc", "label", "n")), "crossing")
    third = _run(tasks.join(now, "doc").select(*TASK, "side", "doc", "label", "n", "entries"), TASK, _across).select("a", "b")
    out = graph.components(stars.union(second).union(third))
    shared.remove(placed, group, many, hub, now, tasks)
    return out


def jaccard_join(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: links at a Jaccard similarity of 0.75 or more, followed through."""
    sets = jaccard_sets(docs, words, id_col, text_col, part_bytes)
    labels = shared.written(linked(sets), "components")
    sizes = shared.written(sets.select("doc", "n", "rep"), "sizes")
    shared.remove(sets)
    out = sizes.join(labels, F.col("rep") == F.col("node"), "left")
    known = lambda c: F.when(c < F.lit(int(parts.LAST)), c)  # noqa: E731  the stand-in for a null id
    return out.select(known(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("label", "rep")).alias("component_id"))
