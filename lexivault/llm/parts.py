"""Ordered parts of a corpus, and the exchange of hashed keys between parts and key buckets.

The operators that compare texts across documents share one shape:

1. ``deal`` cuts the corpus into parts of a few MB of text. At most ``RANGES`` ranges of document ids (a fixed number of
   cuts, whatever the corpus) are split further by a hash of id and text, by their bytes. So a range of long documents,
   or one id with very many rows, is several parts. Text is shuffled once; every later pass reuses that exchange.
2. A pass over the parts sends the *distinct* 64-bit keys of each part (windows, lines, shingles, suffixes), packed
   as sorted deltas, to key buckets. A key that a third of all documents hold is one entry for each part.
3. A bucket answers each part along the keys that it sent.
4. The next pass over the parts joins the answers to the text by cogroup.

A part sends to ``FAN`` coarse buckets at most. Where more are needed, a coarse bucket's messages from ``FAN``
neighbouring parts (a region) are merged and dealt on to finer buckets, and the answers come back the same way. So the
number of messages grows with the number of parts, never with parts times buckets (up to ``FAN`` squared buckets).

Parts of one range have no order among themselves. A key that several of them hold first is a tie, which a second, small
exchange decides by the smallest id (``earlier``).

Rows that are equal in id and text are in one part. No step holds more than a part, a region's share of a coarse bucket, or a bucket's share of the distinct keys of parts.
Rows of one id never count as earlier than each other; a null id counts as 2**63 - 1, larger than all others.
"""

from __future__ import annotations

import ctypes
import inspect
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text in a part; what a row counts besides, so rows without text are bounded too.
PART_BYTES, ROW_BYTES = 4 << 20, 64
#: Text a bucket of keys stands for; keys of all parts in one bucket are held by one task.
BUCKET_BYTES = 8 << 20
#: Ranges of ids at most; coarse buckets, and parts of a region, at most.
RANGES, FAN = 1 << 16, 1 << 12
LAST = np.iinfo(np.int64).max
KEYS = "kind int, bucket int, part int, epoch int, keys binary, epochs binary, extra binary"
ANSWERS = "part int, kind int, bucket int, answer binary"
#: Answers of ``seen``, and the kind of the keys whose ties go to the second exchange.
EARLIER, TIE, TIES = 1, 2, 100
#: Parts below 0 stand for what was there before the corpus at hand.
BEFORE = -1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Layout:
    """How a corpus is dealt: the first part of each range of ids, buckets of keys, parts of a region."""

    base: np.ndarray
    coarse: int
    subs: int = 1
    fan: int = FAN

    def epoch(self, part: int) -> int:
        """The range that a part belongs to."""
        return int(np.searchsorted(self.base, part, "right")) - 1

    @property
    def tied(self) -> bool:
        """True if a range has several parts."""
        return int(self.base[-1]) >= len(self.base)


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), part_bytes: int = PART_BYTES, whole_ids: bool = False) -> tuple[DataFrame, Layout]:
    """Rows as (part, id, body, rest) dealt by part, and the layout. With whole_ids, all rows of an id are in one part."""
    spark = docs.sparkSession
    small_batches(spark)
    weight = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES
    n, size = docs.agg(F.count(F.lit(1)), F.sum(weight)).first()
    tasks, size = partitions(spark), int(size or 0)
    want = min(max(-(-size // part_bytes), min(tasks, n // 16 + 1)), RANGES)
    cuts: list[float] = []
    if want > 1:
        at = [i / want for i in range(1, want)]
        cuts = docs.select(F.col(id_col).cast("long").alias("i")).approxQuantile("i", at, 0.25 / want)
    edges = np.unique(np.clip(np.array(cuts, np.float64), -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))

    @F.pandas_udf(T.IntegerType())
    def range_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "left").astype(np.int32))

    sizes = np.zeros(len(edges) + 1, np.int64)
    if len(edges):
        for r, b in docs.groupBy(range_of(key)).agg(F.sum(weight)).collect():  # RANGES rows at most
            sizes[r] = b
    split = np.where(sizes > 2 * part_bytes, -(-sizes // part_bytes), 1)
    base = np.cumsum(split) - split

    @F.pandas_udf(T.IntegerType())
    def part_of(ids, hashes):
        import pandas as pd

        r = np.searchsorted(edges, ids.to_numpy(np.int64), "left")
        return pd.Series((base[r] + hashes.to_numpy(np.int64) % split[r]).astype(np.int32))

    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"), rest.alias("rest"), key.alias("key"))
    scatter = F.xxhash64("key") if whole_ids else F.xxhash64("key", "body")
    part = (part_of(F.col("key"), scatter) if split.max() > 1 else range_of(F.col("key"))) if len(edges) else F.lit(0)
    rows = rows.withColumn("part", part).drop("key")
    buckets = max(tasks, -(-size // BUCKET_BYTES))
    subs = -(-buckets // FAN)
    return rows.repartition(max(tasks, -(-int(split.sum()) // 32)), "part"), Layout(base, -(-buckets // subs), subs, FAN)


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their deltas, without the outer planes that hold only zeros."""
    d = np.diff(keys, prepend=np.uint64(0))
    held = int(np.bitwise_or.reduce(d)) if len(d) else 0
    low = 0
    while low < 7 and held and not held >> 8 * low & 255:
        low += 1
    width = max(1, (held.bit_length() + 7) // 8 - low)
    planes = d.view(np.uint8).reshape(-1, 8)[:, low : low + width]
    return struct.pack("<IBB", len(d), low, width) + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n, low, width = struct.unpack_from("<IBB", blob)
    out = np.zeros((n, 8), np.uint8)
    out[:, low : low + width] = np.frombuffer(blob, np.uint8, n * width, 6).reshape(width, n).T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the key space, in key order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _message(kind, bucket, part, epoch, keys, epochs, extra) -> pa.Table:
    n = len(bucket)
    ints = lambda x: pa.array([x] * n if isinstance(x, int) else x, pa.int32())
    blobs = lambda x: pa.array([None] * n if x is None else x, pa.binary())
    return pa.table({"kind": ints(kind), "bucket": ints(bucket), "part": ints(part), "epoch": ints(epoch), "keys": blobs(keys), "epochs": blobs(epochs), "extra": blobs(extra)})


def send(layout: Layout, part: int, keys: np.ndarray, extra: np.ndarray | None = None, kind: int = 0) -> pa.Table:
    """Sorted distinct keys of a part, one row for each coarse bucket that gets some; extra runs along with the keys.

    Parts below 0 are of the epoch before all others.
    """
    cut = np.searchsorted(bucket_of(keys, layout.coarse), np.arange(layout.coarse + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    blobs = [pack(keys[cut[b] : cut[b + 1]]) for b in full]
    more = None if extra is None else [extra[cut[b] : cut[b + 1]].tobytes() for b in full]
    return _message(kind, full, part, layout.epoch(part) if part >= 0 else BEFORE, blobs, None, more)


class Received:
    """The messages of a bucket in the order of their senders: keys with the epoch and extra of each."""

    def __init__(self, table: pa.Table):
        at = [int(i) for i in np.argsort(table["part"].to_numpy(), kind="stable")]
        self.kind, self.bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        self.part = table["part"].to_numpy()[at]
        keys = [unpack(table["keys"][i].as_py()) for i in at]
        self.cut = np.cumsum([0, *map(len, keys)])
        self.keys = np.concatenate(keys)
        epoch, epochs = table["epoch"].to_numpy(), table["epochs"]
        self.epochs = np.concatenate([np.full(len(k), epoch[i], np.int32) if epochs[i].as_py() is None else np.frombuffer(epochs[i].as_py(), np.int32) for i, k in zip(at, keys)])
        self.extra = b"".join(table["extra"][i].as_py() or b"" for i in at)

    def shares(self, answer: np.ndarray) -> list[bytes]:
        """The answers along all keys, cut by sender."""
        return [answer[a:b].tobytes() for a, b in zip(self.cut, self.cut[1:])]


def _answers(part, kind: int, bucket, given: list[bytes]) -> pa.Table:
    n = len(given)
    ints = lambda x: pa.array([x] * n if isinstance(x, int) else x, pa.int32())
    return pa.table({"part": ints(part), "kind": ints(kind), "bucket": ints(bucket), "answer": pa.array(given, pa.binary())})


Reduce = Callable[[int, np.ndarray, np.ndarray, bytes], np.ndarray]


def _reduced(reduce: Reduce):
    def run(table: pa.Table) -> pa.Table:
        got = Received(table)
        return _answers(got.part, got.kind, got.bucket, got.shares(reduce(got.kind, got.keys, got.epochs, got.extra)))

    return run


def _gather(layout: Layout):
    """A region's keys of a coarse bucket, merged and dealt on to its finer buckets."""

    def run(table: pa.Table) -> pa.Table:
        got = Received(table)
        order = np.argsort(got.keys, kind="stable")
        keys, epochs = got.keys[order], got.epochs[order]
        extra = np.frombuffer(got.extra, f"V{len(got.extra) // len(keys)}")[order] if got.extra else None
        fine = bucket_of(keys, layout.coarse * layout.subs)
        cut = np.searchsorted(fine, np.arange(got.bucket * layout.subs, (got.bucket + 1) * layout.subs + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cut))
        share = lambda x: [x[cut[b] : cut[b + 1]].tobytes() for b in full]
        region = int(got.part[0] // layout.fan)
        return _message(got.kind, full + got.bucket * layout.subs, region, 0, [pack(keys[cut[b] : cut[b + 1]]) for b in full], share(epochs), None if extra is None else share(extra))

    return run


def _scatter(table: pa.Table, replies: pa.Table) -> pa.Table:
    """The answers of finer buckets, back along the keys of each part of the region."""
    got = Received(table)
    order = np.argsort(got.keys, kind="stable")
    flat = b"".join(replies["answer"][int(i)].as_py() for i in np.argsort(replies["fine"].to_numpy()))
    given = np.frombuffer(flat, f"V{len(flat) // len(order)}")
    answer = np.empty_like(given)
    answer[order] = given
    return _answers(got.part, got.kind, got.bucket, got.shares(answer))


def exchange(sent: DataFrame, reduce: Reduce, layout: Layout) -> DataFrame:
    """Runs reduce(kind, keys, epochs, extra) over each bucket; the answers of each part along the keys it sent."""
    if layout.subs == 1:
        return sent.groupBy("kind", "bucket").applyInArrow(lean(_reduced(reduce)), ANSWERS)
    routed = sent.withColumn("region", F.floor(F.col("part") / layout.fan).cast("int")).groupBy("region", "kind", "bucket")
    fine = routed.applyInArrow(lean(_gather(layout)), KEYS).groupBy("kind", "bucket").applyInArrow(lean(_reduced(reduce)), ANSWERS)
    back = fine.select(F.col("part").alias("region"), "kind", F.floor(F.col("bucket") / layout.subs).cast("int").alias("bucket"), F.col("bucket").alias("fine"), "answer")
    return routed.cogroup(back.groupBy("region", "kind", "bucket")).applyInArrow(lean(_scatter), ANSWERS)


def joined(replies: pa.Table, dtype, kind: int = 0) -> np.ndarray:
    """A part's answers of a kind, along its sorted keys."""
    at = np.flatnonzero(replies["kind"].to_numpy() == kind)
    at = at[np.argsort(replies["bucket"].to_numpy()[at])]
    return np.frombuffer(b"".join(replies["answer"][int(i)].as_py() for i in at), dtype)


def _groups(keys: np.ndarray) -> np.ndarray:
    """The number of each sorted key's group of equals."""
    return np.cumsum(np.append(0, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def seen(kind: int, keys: np.ndarray, epochs: np.ndarray, extra: bytes = b"") -> np.ndarray:
    """EARLIER for a key that a part of an earlier range sent, TIE for one that several parts of its first range did."""
    order = np.lexsort((epochs, keys))
    group, epoch = _groups(keys[order]), epochs[order]
    first = epoch[np.searchsorted(group, group)]
    held = np.bincount(group[epoch == first], minlength=int(group[-1]) + 1)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(epoch > first, EARLIER, np.where(held[group] > 1, TIE, 0))
    return out


def smallest(kind: int, keys: np.ndarray, epochs: np.ndarray, extra: bytes) -> np.ndarray:
    """EARLIER for a key that another part sent with a smaller id."""
    ids = np.frombuffer(extra, np.int64)
    order = np.lexsort((ids, keys))
    group = _groups(keys[order])
    out = np.empty(len(keys), np.uint8)
    out[order] = ids[order] > ids[order][np.searchsorted(group, group)]
    return out


Entries = Callable[["Part"], tuple[np.ndarray, np.ndarray]]


def break_ties(texts, replies: DataFrame, entries: Callable, layout: Layout, separator: bool = False, kind: int = 0) -> DataFrame:
    """replies, and the decisions on their ties; entries(part, replies) gives a part's sorted keys and smallest ids."""
    if not layout.tied:
        return replies

    def again(table: pa.Table, given: pa.Table) -> pa.Table:
        p = Part(table, separator)
        keys, ids = entries(p, given)
        tie = np.flatnonzero(joined(given, np.uint8, kind) == TIE) if len(keys) else np.zeros(0, np.int64)
        return send(layout, p.number, keys[tie], ids[tie], kind + TIES)

    more = exchange(texts.cogroup(replies.groupBy("part")).applyInArrow(lean(again), KEYS), smallest, layout)
    return replies.unionByName(more)


def earlier(texts, entries: Entries, layout: Layout, separator: bool = False, before: DataFrame | None = None) -> DataFrame:
    """For each part's keys (entries(part): sorted distinct keys, smallest id of each), whether a smaller id has them.

    before: messages of parts below 0. The answers are read by ``held_earlier``.
    """

    def first(table: pa.Table) -> pa.Table:
        p = Part(table, separator)
        return send(layout, p.number, entries(p)[0])

    sent = texts.applyInArrow(lean(first), KEYS)
    replies = exchange(sent if before is None else sent.unionByName(before), seen, layout).where("part >= 0")
    return break_ties(texts, replies, lambda p, _: entries(p), layout, separator)


def held_earlier(replies: pa.Table, kind: int = 0) -> np.ndarray:
    """True for each of a part's sorted keys that a document with a smaller id in another part has."""
    got = joined(replies, np.uint8, kind)
    out, tie = got == EARLIER, np.flatnonzero(got == TIE)
    if len(tie):
        out[tie] = joined(replies, np.uint8, kind + TIES) == EARLIER
    return out


def tidy() -> None:
    """Gives freed memory back to the system, so that workers that wait hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A worker function that tidies up after every table or batch."""
    if inspect.isgeneratorfunction(run):

        def batches_to_batches(batches):
            for out in run(batches):
                yield out
                tidy()

        return batches_to_batches
    if run.__code__.co_argcount == 1:

        def table_to_table(table):
            try:
                return run(table)
            finally:
                tidy()

        return table_to_table

    def tables_to_table(left, right):
        try:
            return run(left, right)
        finally:
            tidy()

    return tables_to_table


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to workers a thousand at a time (Spark's own limit of bytes holds besides), unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


class Part:
    """A part's documents by ascending id, their texts in one buffer (with a separator byte after each, if asked for)."""

    def __init__(self, table: pa.Table, separator: bool = False):
        key = pc.fill_null(table["id"], int(LAST)).to_numpy().astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.rows = table.take(pa.array(order))
        self.number = int(table["part"][0].as_py()) if len(table) else -1
        self.ids = key[order]
        texts = self.rows["body"].combine_chunks().cast(pa.large_binary())
        texts = pc.fill_null(texts, b"")
        if separator:
            texts = pc.binary_join_element_wise(texts, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0] - int(separator)
        #: Position of the first document with the same id: documents of one rank are never earlier than each other.
        self.rank = np.searchsorted(self.ids, self.ids)

    def __len__(self) -> int:
        return len(self.ids)


def free_name(name: str, taken: list[str]) -> str:
    """The name, made longer until it is none of those taken (whatever the case)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def first_owner(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, each entry's place among them, and each distinct key's lowest rank.

    rank ascends, as entries come in document order; so the first entry of a key has its lowest rank.
    """
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, place, rank[first]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for each of n places that one of the intervals [start, end) holds."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0
