r"""Line dedup: normalised lines are hashed, documents counted for each hash, and lines over the threshold dropped.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold are dropped everywhere except in the document with
the smallest id that holds them. The other lines stay in their order, joined by \n.

Each part counts the documents of each of its lines first, so a line that all documents share is one entry for each
part. Text is shuffled once; 64-bit xxh3 hashes of lines once. A line that a smaller id holds has two documents already;
only a higher threshold needs the counts, and then all rows of an id are kept in one part.

Defined cases: null or empty text is one empty line; rows of one id count as one document; a null id counts as
2**63 - 1, larger than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import hashing, parts

OUT = "doc_id long, n_lines long, n_dropped long, kept binary"


def _keys(p: parts.Part, min_chars: int):
    """Lines of all documents, the document of each, whether its key is long enough, and the key's hash."""
    lines: list[bytes] = []
    counts = []
    for a, b in zip(p.starts, p.ends):
        own = p.buf[a:b].tobytes().split(b"\n")
        counts.append(len(own))
        lines += own
    h = np.zeros(len(lines), np.uint64)
    long = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(hashing.SPACES).lower()
            if len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars):
                h[i] = xxhash.xxh3_64_intdigest(key)
                long[i] = True
    return lines, np.array(counts, np.int64), long, h


def _counted(p: parts.Part, counts: np.ndarray, long: np.ndarray, h: np.ndarray):
    """Distinct keys with their numbers of documents and lowest ranks; the place of each long line's key."""
    rank = np.repeat(p.rank, counts)[long]
    distinct, place, first = parts.first_owner(h[long], rank)
    pairs = np.unique(np.stack([place, rank], 1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
    return distinct, np.bincount(pairs[:, 0], minlength=len(distinct)), place, first, rank


def _entries(min_chars: int):
    def run(p: parts.Part):
        _, counts, long, h = _keys(p, min_chars)
        distinct, _, _, first, _ = _counted(p, counts, long, h)
        return distinct, p.ids[first] if len(first) else first

    return run


#: The kind of the keys whose documents are counted.
COUNTS = 1


def _send(min_chars: int, min_docs: int, layout: parts.Layout):
    def run(table: pa.Table) -> pa.Table:
        p = parts.Part(table)
        _, counts, long, h = _keys(p, min_chars)
        distinct, docs, *_ = _counted(p, counts, long, h)
        out = parts.send(layout, p.number, distinct)
        return out if min_docs <= 2 else pa.concat_tables([out, parts.send(layout, p.number, distinct, docs.astype(np.int64), COUNTS)])

    return run


def _judge(min_docs: int):
    """Whether an earlier part holds a line; whether enough documents do."""

    def run(kind: int, keys: np.ndarray, epochs: np.ndarray, extra: bytes) -> np.ndarray:
        if kind != COUNTS:
            return parts.seen(kind, keys, epochs)
        _, group = np.unique(keys, return_inverse=True)
        return (np.bincount(group, np.frombuffer(extra, np.int64))[group] >= min_docs).astype(np.uint8)

    return run


def _drop(min_chars: int, min_docs: int, rest: list[str]):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        p = parts.Part(table)
        lines, counts, long, h = _keys(p, min_chars)
        _, _, place, first, rank = _counted(p, counts, long, h)
        drop = np.zeros(len(lines), bool)
        if len(place):
            drop[long] = parts.held_earlier(replies)[place] | (first[place] < rank)
            if min_docs > 2:
                drop[long] &= parts.joined(replies, np.uint8, COUNTS)[place] > 0
        at = np.concatenate([[0], np.cumsum(counts)])
        kept = [b"\n".join([x for x, gone in zip(lines[a:b], drop[a:b].tolist()) if not gone]) if drop[a:b].any() else b"\n".join(lines[a:b]) for a, b in zip(at, at[1:])]
        dropped = np.diff(np.concatenate([[0], np.cumsum(drop)])[at])
        out = {"doc_id": p.rows["id"], "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.binary())}
        return pa.table(out | ({"rest": p.rows["rest"]} if rest else {}))

    return run


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """One row for each document: lines, dropped lines, the text left; keep names columns to carry along (in a struct ``rest``)."""
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least: the smallest id that holds a line always keeps it")
    dealt, layout = parts.deal(docs, id_col, text_col, keep, part_bytes, whole_ids=min_docs > 2)
    texts = dealt.groupBy("part")
    replies = parts.exchange(texts.applyInArrow(parts.lean(_send(min_chars, min_docs, layout)), parts.KEYS), _judge(min_docs), layout)
    entries = _entries(min_chars)
    replies = parts.break_ties(texts, replies, lambda p, _: entries(p), layout)
    out = OUT + (", rest " + dealt.schema["rest"].dataType.simpleString() if keep else "")
    return texts.cogroup(replies.groupBy("part")).applyInArrow(parts.lean(_drop(min_chars, min_docs, list(keep))), out)
