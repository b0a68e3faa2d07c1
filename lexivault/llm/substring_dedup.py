"""Substring dedup: Rabin-Karp hashes of every fixed-length word window; repeated windows merge into removal intervals.

Each part sends the distinct hashes of its windows to buckets; a bucket tells each part which of them an earlier part
holds. With the part's own earlier documents that gives every window that also starts in a document of a smaller id;
the windows' intervals merge into maximal removal intervals.

Cost: text is shuffled once, window hashes once (about 6 bytes for each distinct window of a part). A window's hash is a
polynomial of its words' 64-bit hashes modulo the prime 2**61 - 1: two different windows are taken for one with a
probability near n * 2**-61 a window.

Defined cases: null text has no words; ids may repeat (rows of one id never remove each other's words); a null id
counts as 2**63 - 1, larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing, parts

OUT = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:int,end:int>>"


def _windows(p: parts.Part, length: int):
    """Words of the part, and of each window that lies within a document: first word, rank, hash."""
    start, end, value = hashing.words(p.buf)
    doc = hashing.owners(p.starts, start)
    at = np.searchsorted(start, p.starts)  # first word of each document
    bounds = np.append(at, len(start))
    h = hashing.rabin_karp(value, length)
    whole = np.flatnonzero(doc[: len(h)] == doc[length - 1 :][: len(h)])
    return start, end, doc, bounds, whole, h[whole]


def _entries(length: int):
    def run(p: parts.Part):
        _, _, doc, _, whole, h = _windows(p, length)
        keys, _, lowest = parts.first_owner(h, p.rank[doc[whole]])
        return keys, p.ids[lowest] if len(lowest) else lowest

    return run


def _remove(length: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        p = parts.Part(table, separator=True)
        start, end, doc, bounds, whole, h = _windows(p, length)
        _, place, first = parts.first_owner(h, p.rank[doc[whole]])
        earlier = parts.held_earlier(replies)
        hit = whole[earlier[place] | (first[place] < p.rank[doc[whole]])] if len(whole) else whole
        gone = parts.covered(len(start), hit, hit + length)
        # Kept words, each with one space after it, cut out of the buffer in one go.
        keep = ~gone
        letters = parts.covered(len(p.buf), start[keep], end[keep])
        text = p.buf.copy()
        letters[end[keep]] = True
        text[end[keep]] = 32
        left = text[letters]
        size = np.where(keep, end - start + 1, 0)
        upto = np.concatenate([[0], np.cumsum(size)])[bounds]
        kept = [left[a : max(a, b - 1)].tobytes() for a, b in zip(upto[:-1], upto[1:])]
        step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        cut = np.zeros(len(start) + 1, bool)
        cut[bounds] = True  # an interval ends with its document
        begin = np.flatnonzero((step == 1) | (cut & np.append(gone, False) & np.append(False, gone)))
        close = np.flatnonzero((step == -1) | (cut & np.append(gone, False) & np.append(False, gone)))
        of = doc[begin] if len(begin) else begin
        n_words = np.diff(bounds)
        n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of, np.arange(len(p) + 1)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((begin - bounds[of]).astype(np.int32)), pa.array((close - bounds[of]).astype(np.int32))], ["start", "end"]),
        )
        return pa.table({"doc_id": p.rows["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": spans})

    return run


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """One row for each document: words, removed words, the text left (kept words, one space between) and removed word spans."""
    dealt, layout = parts.deal(docs, id_col, text_col, part_bytes=part_bytes)
    texts = dealt.groupBy("part")
    replies = parts.earlier(texts, _entries(length), layout, separator=True)
    return texts.cogroup(replies.groupBy("part")).applyInArrow(parts.lean(_remove(length)), OUT)
