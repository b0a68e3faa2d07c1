"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Test items come in blocks of bounded size (``BLOCK_ITEMS``, ``BLOCK_BYTES``); a block's n-grams are a table of known size
that goes to all workers, and every document is held against every block, whole, without a shuffle. A first pass counts
the documents that hold each n-gram. Seeds are the n-grams that at most ``RARE`` of all documents (or ``FEW``) and at most
``ITEMS`` places of items hold; besides, the cheaper half (documents times places) of every stretch of ``STRETCH`` n-grams
of an item, so seeds lie all over an item, however often the item itself has leaked, and a prompt that all items begin
with is not looked up for each of them while they have anything rarer. Hits on near diagonals make a candidate passage, which
is aligned with the item word by word (edits, insertions and deletions allowed); the score is the alignment's share of
the score of a perfect copy. A passage counts from ``min_score`` on, or if it holds ``MIN_WORDS`` words of the item as they
are (``EDIT`` / ``MATCH`` more for every edited word, so at four of five words at least), however long the item is; its score
and place are then those of that stretch.

All passages that hold an item are reported, the best of those that overlap.

Words are runs of letters, digits and non-ASCII characters, lower-cased; each character of the Chinese, Japanese and
Korean scripts, which write no spaces, is a word. Defined cases: null or blank texts have no hits; items with fewer than
``SEED`` words have no seeds and match nothing; repeated documents are judged each on their own, repeated rows of an item
once; ids may be null; a column of documents that has the result's name is replaced; with an empty benchmark no document
has hits; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from . import hashing, parts
from .align import MATCH, align, clusters

#: Items and bytes of their texts in a block at most (a longer item is a block of its own).
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Words of a seed; n-grams of a stretch, of which the cheaper half are seeds; share and number of documents, and places of items, up to which others are.
SEED, STRETCH, RARE, FEW, ITEMS = 3, 8, 0.01, 20, 64
#: Words that count however long the item is, and what an edit among them costs.
MIN_WORDS, EDIT = 30, 8
#: Seeds on one diagonal that make a candidate (one, if an item has only one), how far apart their diagonals may lie, words added at both ends.
HITS, DRIFT, MARGIN = 2, 8, 8
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))


def word_hashes(text: str | None) -> np.ndarray:
    return hashing.words(np.frombuffer((text or "").lower().encode(), np.uint8), breaks=hashing.punctuation_table(), wide=True)[2]


class Grams:
    """n-grams of items: sorted distinct hashes, and for each where it stands in which item."""

    def __init__(self, items: list[np.ndarray], picked: list[np.ndarray] | None = None):
        h, item, place = [], [], []
        for i, words in enumerate(items):
            own = hashing.windows(words, SEED)
            at = np.arange(len(own)) if picked is None else picked[i]
            h.append(own[at])
            item.append(np.full(len(at), i))
            place.append(at)
        flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.seeds = np.bincount(self.item, minlength=len(items))
        self.known = np.zeros(1 << 20, bool)  # a sieve before the search
        self.known[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that hold one of the keys, and which."""
        at = np.flatnonzero(self.known[(h >> np.uint64(44)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[at])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == h[at] if len(self.keys) else np.zeros(0, bool)
        return at[same], key[same]


def _count(grams):
    def run(batches):
        docs = np.zeros(len(grams.value.keys), np.int64)
        for b in batches:
            for text in b.column(0):
                _, key = grams.value.find(hashing.windows(word_hashes(text.as_py()), SEED))
                docs[np.unique(key)] += 1
        key = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(docs[key])], names=["key", "docs"])

    return run


def _rare(items: list[np.ndarray], grams: Grams, docs: np.ndarray, total: int) -> list[np.ndarray]:
    """Places of the rare n-grams of each item, and of the cheaper half in every stretch."""
    out, places = [], np.diff(grams.first)
    for words in items:
        h = hashing.windows(words, SEED)
        key = np.searchsorted(grams.keys, h)
        seed = (docs[key] <= max(RARE * total, FEW)) & (places[key] <= ITEMS)
        cost = (docs[key] + 1) * places[key]
        for a in range(0, len(h), STRETCH):
            seed[a + np.argsort(cost[a : a + STRETCH], kind="stable")[: -(-min(STRETCH, len(h) - a) // 2)]] = True
        out.append(np.flatnonzero(seed))
    return out


def passages(words: np.ndarray, items: list[np.ndarray], seeds: Grams, min_score: float) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the passages that hold items, the best of those that overlap for each item."""
    at, key = seeds.find(hashing.windows(words, SEED))
    if not len(at):
        return []
    n = seeds.first[key + 1] - seeds.first[key]
    where = np.repeat(seeds.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at, item, diagonal = np.repeat(at, n), seeds.item[where], np.repeat(at, n) - seeds.place[where]
    order = np.argsort(item, kind="stable")
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        i = int(item[own[0]])
        found = []
        for group in clusters(diagonal[own], DRIFT):
            d = diagonal[own[group]]
            if len(np.unique(at[own[group]])) < min(HITS, seeds.seeds[i]):
                continue
            a, b = max(0, int(d.min()) - MARGIN), min(len(words), int(d.max()) + len(items[i]) + MARGIN)
            score, b0, b1 = judged(items[i], words[a:b], min_score)
            if score:
                found.append((-score, a + b0, a + b1))
        kept: list[tuple[float, int, int]] = []
        for x in sorted(set(found)):
            if all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
                kept.append(x)
        out += [(i, -score, b0, b1) for score, b0, b1 in sorted(kept, key=lambda x: x[1])]
    return out


def judged(item: np.ndarray, words: np.ndarray, min_score: float) -> tuple[float, int, int]:
    """Score and place of the best alignment of an item with a passage; a score of 0 if it does not count."""
    score, _, _, _, b0, b1 = align(item, words)
    whole = MATCH * len(item)
    if score < min_score * whole:
        if score < MATCH * MIN_WORDS:
            return 0.0, 0, 0
        score, _, _, _, b0, b1 = align(item, words, cost=EDIT)
        if score < MATCH * MIN_WORDS:
            return 0.0, 0, 0
    return score / whole, b0, b1


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.45, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out_col: str = "hits") -> DataFrame:
    """The documents' rows with a column ``hits``: the items each holds copies of, with score and place (in words)."""
    spark = docs.sparkSession
    parts.small_batches(spark)
    docs = scratch.spread(docs.drop(out_col))
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).distinct()
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-int(size or 0) // BLOCK_BYTES))
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, HIT)])
    text_at = docs.columns.index(text_col)
    rows = docs.withColumn(out_col, F.array().cast(HIT))
    total = docs.count() if blocks else 0
    for block in range(blocks):
        got = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # a block of bounded size
        got.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["text"] or ""))
        ids, texts = [r["id"] for r in got], [word_hashes(r["text"]) for r in got]
        grams = Grams(texts)
        shared = spark.sparkContext.broadcast(grams)
        counted = docs.select(text_col).mapInArrow(parts.lean(_count(shared)), "key int, docs long").groupBy("key").agg(F.sum("docs")).collect()
        shared.unpersist()
        count = np.zeros(len(grams.keys), np.int64)
        for k, m in counted:
            count[k] = m
        model = spark.sparkContext.broadcast((ids, texts, Grams(texts, _rare(texts, grams, count, total))))

        def run(batches, model=model):
            ids, texts, seeds = model.value
            for b in batches:
                hits = []
                for text, before in zip(b.column(text_at), b.column(b.num_columns - 1).to_pylist()):
                    found = passages(word_hashes(text.as_py()), texts, seeds, min_score)
                    hits.append((before or []) + [{"item_id": ids[i], "score": s, "start_word": x, "end_word": y} for i, s, x, y in found])
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(hits, kind)], names=b.schema.names)

        rows = rows.mapInArrow(parts.lean(run), schema)
    return rows
