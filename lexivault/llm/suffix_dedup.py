"""Suffix-array dedup: bytes covered by long strings that also start in a document with a smaller id are removed.

Suffixes are sampled by content: a suffix is kept if its leading ``GRAM`` bytes have the lowest hash of some
``length``-byte window, so any two equal windows hold a sampled suffix at the same offset. The stretch of windows that
share a sampled suffix is a *run* (50 to 80 bytes): it reaches to the left and to the right of the suffix's start.

One batch (``suffix_dedup``):

1. Parts send the distinct hashes of their runs, and of the leading bytes of their sampled suffixes, to key buckets.
2. A run that an earlier part holds in full loses all its windows. The first copy of a run whose leading bytes also begin
   other runs can match in part; only these few send the hashes of their single windows to buckets of their own. Equal
   windows are thus always found, wherever the text around them differs; nothing is sampled away.
3. The windows that an earlier document holds are removed, overlaps and all.

A family of indexes (``SuffixIndex``): the runs that a batch brings are kept as a sparse suffix array, a table of runs in
the byte order of their suffixes (a distributed sort). A new batch is scanned against every level: its runs' hashes, then
the windows of the levels' runs that share leading bytes (a sort-merge join). Then its own new runs become a level, and
levels of like size merge, so there are never more than logarithmically many.

Runs are dealt by their own hash, so a beginning that very many documents share (and go on from differently) is no hot
bucket. Cost: text is shuffled once, sampled suffixes (6 % of the bytes) once with about 17 bytes each, windows of partly
matching runs once. Hashes have 64 bits and are no polynomials; the chance of a false match is near n * 2**-64 a string.

Defined cases: null text is empty; texts shorter than ``length`` stay whole; rows of one id never remove each other's
bytes; a null id counts as 2**63 - 1, larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing, parts, shared

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>"
LEVEL = "lead long, run long, suffix binary, before binary"
#: Leading bytes by which suffixes are sampled.
GRAM = 20
#: Kinds of keys: hashes of runs, of leading bytes, of windows.
RUNS, LEADS, WINDOWS = 0, 1, 2
#: Numbers of a level that are packed into one round of messages, about.
PACK_ROWS = 1 << 20
_LOW = np.uint64((1 << 18) - 1)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive keys."""
    span, out = 1, key
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """First and last window, document, place of the suffix, hash of leading bytes and of all bytes, for each run."""
    gram = min(GRAM, length)
    width = length - gram + 1
    n = len(buf) - length + 1
    got: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(n, 0), hashing.CHUNK):
        m = min(hashing.CHUNK, n - base)  # windows that start here
        piece = buf[base : base + m + length - 1]
        lead = hashing.byte_windows(piece, gram)
        key = (lead & ~_LOW) | np.arange(len(lead), dtype=np.uint64)
        at = (_least(key, width) & _LOW).astype(np.int64)
        # Windows within a document.
        a, b = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + m, "left")
        whole = np.zeros(m, bool)
        new = np.ones(m, bool)
        new[1:] = at[1:] != at[:-1]
        for d in range(a, b):
            lo, hi = max(starts[d] - base, 0), min(ends[d] - length + 1 - base, m)
            if hi > lo:
                whole[lo:hi] = True
                new[lo] = True
        first = np.flatnonzero(whole & new)
        stop = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
        if len(first):
            w = hashing.byte_windows(piece, length)
            # The first and the last window overlap or touch, so both together are the whole run.
            full = hashing.combine(hashing.combine(w[first], w[stop]), (stop - first).astype(np.uint64))
            # The lowest hashes of windows crowd at the low end; scrambled, they fill all buckets alike. Beginnings that 48 bits
            # take for one only cost windows, so the rest need not travel.
            got.append((first + base, stop + base, at[first] + base, hashing.mix(lead[at[first]] + np.uint64(1)) & ~np.uint64(0xFFFF), full))
    if not got:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    first, stop, place, lead, full = (np.concatenate(x) for x in zip(*got))
    return first, stop, hashing.owners(starts, first), place, lead, full


def _some(full: np.ndarray, several: np.ndarray) -> np.ndarray:
    """What tells a beginning's runs apart, in five bytes: 39 bits of the hash of one of them, and whether there are more."""
    word = (full >> np.uint64(25) << np.uint64(1)) | several.astype(np.uint64)
    return np.ascontiguousarray(word.view(np.uint8).reshape(-1, 8)[:, :5])


class _Runs:
    """A part's runs; the distinct hashes of runs and of leading bytes, and where each run's are among them."""

    def __init__(self, p: parts.Part, length: int):
        self.p, self.length = p, length
        self.first, self.stop, self.doc, self.suffix, self.lead, self.full = runs(p.buf, p.starts, p.ends, length)
        rank = p.rank[self.doc] if len(self.doc) else self.doc
        self.keys, self.place, lowest = parts.first_owner(self.full, rank)
        self.lowest = p.ids[lowest] if len(lowest) else lowest
        self.copy = lowest[self.place] < rank if len(rank) else np.zeros(0, bool)  # an earlier document of the part has it
        self.leads, first, self.lead_place = np.unique(self.lead, return_index=True, return_inverse=True)
        some = self.full[first]
        several = np.zeros(len(self.leads), bool)
        several[self.lead_place[self.full != some[self.lead_place]]] = True
        self.some = _some(some, several)

    def partial(self, replies: pa.Table) -> np.ndarray:
        """Runs to be judged window by window: first copies whose leading bytes begin other runs too."""
        if not len(self.first):
            return self.first
        other = parts.joined(replies, np.uint8, LEADS) > 0
        return np.flatnonzero(other[self.lead_place] & ~parts.held_earlier(replies, RUNS)[self.place] & ~self.copy)

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of the picked runs."""
        a, n = self.first[pick], self.stop[pick] - self.first[pick] + 1
        start = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = int(np.searchsorted(start, start[i] + hashing.CHUNK))
            out[i:j] = hashing.byte_windows(self.p.buf[start[i] : start[j - 1] + self.length], self.length)[start[i:j] - start[i]]
            i = j
        return start, out

    def window_keys(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window hashes of the partial runs, and the smallest id of each."""
        start, h = self.windows(self.partial(replies))
        rank = self.p.rank[hashing.owners(self.p.starts, start)] if len(start) else start
        keys, _, lowest = parts.first_owner(h, rank)
        return keys, self.p.ids[lowest] if len(lowest) else lowest


def _judge(kind: int, keys: np.ndarray, epochs: np.ndarray, extra: bytes) -> np.ndarray:
    """Runs and windows: whether an earlier part holds them. Leading bytes: 1 if they begin more than one run."""
    if kind != LEADS:
        return parts.seen(kind, keys, epochs)
    word = np.zeros((len(keys), 8), np.uint8)
    word[:, :5] = np.frombuffer(extra, np.uint8).reshape(-1, 5)
    some = word.reshape(-1).view(np.uint64)
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    differs = (some & np.uint64(1) > 0) | (some >> np.uint64(1) != (some >> np.uint64(1))[first][group])
    return (np.bincount(group, differs)[group] > 0).astype(np.uint8)


class _Steps:
    """The passes over the parts of one batch; levels are tables of runs from earlier batches."""

    def __init__(self, docs: DataFrame, length: int, id_col: str, text_col: str, part_bytes: int, levels: DataFrame | None):
        dealt, self.layout = parts.deal(docs, id_col, text_col, part_bytes=part_bytes)
        self.texts, self.length = dealt.groupBy("part"), length
        first = self.asked(self.over(self._send, parts.KEYS), None if levels is None else levels.select("lead", "run").mapInArrow(parts.lean(_level_runs(self.layout)), parts.KEYS))
        self.first = parts.break_ties(self.texts, first, lambda p, _: (lambda r: (r.keys, r.lowest))(_Runs(p, length)), self.layout, kind=RUNS)
        seen = None
        if levels is not None:
            leads = self.over(self._leads, "lead long", self.first).distinct()
            seen = levels.join(leads, "lead", "left_semi").select("before", "suffix").mapInArrow(parts.lean(_level_windows(self.layout, length)), parts.KEYS)
        replies = self.asked(self.over(self._send_windows, parts.KEYS, self.first), seen)
        both = self.first.unionByName(replies)
        self.replies = parts.break_ties(self.texts, both, lambda p, given: _Runs(p, length).window_keys(given), self.layout, kind=WINDOWS)

    def asked(self, sent: DataFrame, more: DataFrame | None) -> DataFrame:
        return parts.exchange(sent if more is None else sent.unionByName(more), _judge, self.layout).where("part >= 0")

    def over(self, step, schema: str, replies: DataFrame | None = None) -> DataFrame:
        """A pass over the parts, each with its answers."""
        run = step(self.layout, self.length)
        if replies is None:
            return self.texts.applyInArrow(parts.lean(run), schema)
        return self.texts.cogroup(replies.groupBy("part")).applyInArrow(parts.lean(run), schema)

    @staticmethod
    def _send(layout, length):
        def run(table: pa.Table) -> pa.Table:
            r = _Runs(parts.Part(table), length)
            return pa.concat_tables([parts.send(layout, r.p.number, r.keys, kind=RUNS), parts.send(layout, r.p.number, r.leads, r.some, kind=LEADS)])

        return run

    @staticmethod
    def _leads(layout, length):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            r = _Runs(parts.Part(table), length)
            return pa.table({"lead": pa.array(np.unique(r.lead[r.partial(replies)]).view(np.int64))})

        return run

    @staticmethod
    def _send_windows(layout, length):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            r = _Runs(parts.Part(table), length)
            return parts.send(layout, r.p.number, r.window_keys(replies)[0], kind=WINDOWS)

        return run

    @staticmethod
    def _new(layout, length):
        """The runs that no earlier document has, with their bytes."""

        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            r = _Runs(parts.Part(table), length)
            new = np.flatnonzero(~parts.held_earlier(replies, RUNS)[r.place] & ~r.copy) if len(r.first) else r.first
            new = new[np.unique(r.place[new], return_index=True)[1]]
            raw = r.p.buf.tobytes()
            cut = lambda a, b: pa.array([raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())], pa.binary())
            return pa.table({"lead": pa.array(r.lead[new].view(np.int64)), "run": pa.array(r.full[new].view(np.int64)), "suffix": cut(r.suffix, r.stop + length), "before": cut(r.first, r.suffix)})

        return run

    @staticmethod
    def _remove(layout, length):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            p = parts.Part(table)
            r = _Runs(p, length)
            whole = np.flatnonzero(parts.held_earlier(replies, RUNS)[r.place] | r.copy) if len(r.first) else r.first
            start, h = r.windows(r.partial(replies))
            rank = p.rank[hashing.owners(p.starts, start)] if len(start) else start
            _, at, low = parts.first_owner(h, rank)
            hit = start[parts.held_earlier(replies, WINDOWS)[at] | (low[at] < rank)] if len(start) else start
            gone = parts.covered(len(p.buf), np.concatenate([r.first[whole], hit]), np.concatenate([r.stop[whole] + length, hit + length]))
            left = p.buf[~gone]
            bounds = np.append(p.starts, len(p.buf))
            upto = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            kept = [left[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])]
            cut = np.zeros(len(p.buf) + 1, bool)
            cut[bounds] = True  # a removed stretch ends with its document
            now, before = np.append(gone, False), np.append(False, gone)
            begin, close = np.flatnonzero(now & (cut | ~before)), np.flatnonzero(before & (cut | ~now))
            of = hashing.owners(p.starts, begin)
            edges = np.searchsorted(of, np.arange(len(p) + 1))
            spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array((begin - p.starts[of]).astype(np.int32)), pa.array((close - p.starts[of]).astype(np.int32))], ["start", "end"]))
            size = p.ends - p.starts
            return pa.table({"doc_id": p.rows["id"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(size - np.diff(upto), pa.int64()), "n_spans": pa.array(np.diff(edges), pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": spans})

        return run

    def result(self) -> DataFrame:
        return self.over(self._remove, OUT, self.replies)


def _level_part() -> int:
    """The number that a level's task sends under: below all parts of a batch."""
    return parts.BEFORE - TaskContext.get().partitionId()


def _packs(batches, numbers):
    """What numbers(batch) gives (arrays of 64-bit numbers), gathered over batches up to PACK_ROWS."""
    held, size = [], 0
    for b in batches:
        own = numbers(b)
        held.append(own)
        size += len(own[0])
        if size >= PACK_ROWS:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _level_runs(layout: parts.Layout):
    """A level's hashes of runs and of leading bytes, as messages from before the batch."""

    def run(batches):
        for lead, full in _packs(batches, lambda b: [b.column(i).to_numpy().view(np.uint64) for i in (0, 1)]):
            yield from parts.send(layout, _level_part(), np.unique(full), kind=RUNS).to_batches()
            leads, first, place = np.unique(lead, return_index=True, return_inverse=True)
            several = np.zeros(len(leads), bool)
            several[place[full != full[first][place]]] = True
            yield from parts.send(layout, _level_part(), leads, _some(full[first], several), kind=LEADS).to_batches()

    return run


def _level_windows(layout: parts.Layout, length: int):
    """All windows of a level's runs, as messages from before the batch."""

    def windows(b):
        own = [hashing.byte_windows(np.frombuffer(x + y, np.uint8), length) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        return [np.concatenate(own) if own else np.zeros(0, np.uint64)]

    def run(batches):
        for (keys,) in _packs(batches, windows):
            yield from parts.send(layout, _level_part(), np.unique(keys), kind=WINDOWS).to_batches()

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """One row for each document: bytes, removed bytes, the maximal removed spans and the bytes left."""
    return _Steps(docs, length, id_col, text_col, part_bytes, None).result()


class SuffixIndex:
    """A logarithmic family of sparse suffix arrays in a folder that driver and executors share.

    ``add`` judges a batch against all batches before it (all their documents count as earlier) and against itself,
    then takes it in. A batch that fails leaves the family as it was: the list of levels is replaced last, as one new file.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 50):
        self.spark, self.path, self.length = spark, path.rstrip("/"), length

    def levels(self) -> list[tuple[str, int]]:
        """Names and rows of the levels, the largest first."""
        lines = (shared.newest(self.spark, self.path, "levels") or "").split()
        return [(a, int(b)) for a, b in zip(lines[::2], lines[1::2])]

    def level(self, name: str) -> DataFrame:
        """A level's runs, in the byte order of their suffixes."""
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = shared.fresh_name("level")
        rows.repartitionByRange("suffix", "before").sortWithinPartitions("suffix", "before").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name, self.level(name).count()

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = parts.PART_BYTES) -> DataFrame:
        """The result of ``suffix_dedup`` for the batch, as a written table."""
        held, levels = self.levels(), None
        for name, _ in held:
            levels = self.level(name) if levels is None else levels.unionByName(self.level(name))
        steps = _Steps(docs, self.length, id_col, text_col, part_bytes, levels)
        out = shared.written(steps.result(), "suffix-batch")
        held.append(self._write(steps.over(steps._new, LEVEL, steps.first)))
        old = []
        while len(held) > 1 and held[-2][1] < 2 * held[-1][1]:
            a, b = held.pop(), held.pop()
            old += [a[0], b[0]]
            held.append(self._write(self.level(a[0]).unionByName(self.level(b[0]))))
        shared.replace(self.spark, self.path, "levels", "\n".join(f"{a} {b}" for a, b in held))
        for name in old:
            shared.delete(self.spark, f"{self.path}/{name}")
        return out
