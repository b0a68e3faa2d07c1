"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table.

1. Each task splits its texts into pre-tokens and keeps, for each batch of texts, the distinct words and the texts as
   sequences of word numbers (their positions). A word that is itself a token has its id at once; the others and the
   sequences leave in one exchange: sequences by batch, words by bucket of the word's hash. A batch's number comes from
   its partition and place, so a task that runs again gives the same rows: documents are read from files, or have
   been written before, in one order.
2. The words of all batches meet in their bucket, message by message; each distinct word is encoded once.
3. The ids go back to the batches that asked, and each text is put together in the order of its positions.

Nothing grows with the number of occurrences but the sequences, which stay in their batch (less than two bytes a word). No
word list of the corpus is ever held or broadcast whole; the ranks (a vocabulary of fixed size) go to all workers. A
batch sends to ``BUCKETS`` buckets at most, and a bucket holds its own distinct words and one batch's message at a time.

Defined cases: null or empty text has no tokens and decodes to no bytes; words of any length are encoded whole; ids of
documents may repeat or be null; decoding passes over null ids and ids outside the table, and null ids of a whole row give
no bytes; a column that has the result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import parts

#: Bytes of text whose distinct words are gathered in one task at a time.
BATCH_BYTES = 10 << 20
#: Bytes of text that a bucket of words stands for, and buckets at most.
BUCKET_BYTES, BUCKETS = 16 << 20, 1 << 12
#: Pre-tokens put together at a time.
PIECE = 1 << 20
ROWS = "key long, batch long, ids binary, sizes binary, seq binary, order binary, known binary, words binary"
ANSWERS = "key long, bucket int, answer binary"


def rust_pattern(pattern: str) -> str:
    r"""The pattern for Python's regex module: \s as Unicode's White_Space, as Rust has it."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out += {"\\s": r"\p{White_Space}", "\\S": r"\P{White_Space}"}.get(two, two)
            i += 2
            continue
        depth += (c == "[") - (c == "]")
        out += c
        i += 1
    return out


@functools.lru_cache(4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    ranks = token_ranks(ranks_path)
    return tiktoken.Encoding(f"ranks:{ranks_path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    return token_ranks(path)


def token_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table; an id that the ranks leave out decodes to nothing."""
    ranks = token_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


_KINDS = {1: "<u1", 2: "<u2", 4: "<u4"}


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    top = int(numbers.max()) if len(numbers) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    planes = np.ascontiguousarray(numbers.astype(_KINDS[width]).view(np.uint8).reshape(-1, width).T)
    return struct.pack("<QB", len(numbers), width) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", blob)
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(_KINDS[width]).reshape(-1).astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _pack(np.fromiter(map(len, words), np.int64, len(words)))
    return struct.pack("<Q", len(sizes)) + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def _unpack_words(blob: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", blob)
    ends = np.cumsum(_unpack(blob[8 : 8 + n]))
    flat = zstandard.ZstdDecompressor().decompress(blob[8 + n :], max_output_size=int(ends[-1]) or 1)
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _split(ranks_path: str, pattern: str, buckets: int, batch_bytes: int):
    def run(batches):
        find, ranks = regex.compile(rust_pattern(pattern)).findall, _ranks(ranks_path)
        schema = pa.schema([("key", pa.int64()), ("batch", pa.int64()), *((k, pa.binary()) for k in ("ids", "sizes", "seq", "order", "known", "words"))])
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, seqs, held = [], [], [], 0
        numbers: dict[str, int] = {}

        def flush():
            nonlocal made
            batch = -1 - (part << 24 | made)
            made += 1
            seq = np.concatenate(seqs)
            # Frequent words get small numbers, which pack well; order says where each word is among those known, then sent.
            rank = np.empty(len(numbers), np.int64)
            rank[np.argsort(-np.bincount(seq, minlength=len(numbers)), kind="stable")] = np.arange(len(numbers))
            shares: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
            tokens, whose = [], []
            for i, w in enumerate(numbers):
                w = w.encode()
                token = ranks.get(w)
                if token is None:
                    shares[xxhash.xxh3_64_intdigest(w) % buckets].append((w, i))
                else:
                    tokens.append(token)
                    whose.append(i)
            for share in shares:
                share.sort()
            full = [b for b, share in enumerate(shares) if share]
            whose += [i for b in full for _, i in shares[b]]
            order = rank[np.array(whose, np.int64)]
            who = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + np.array([x is None for x in ids], np.uint8).tobytes()
            none = [None] * len(full)
            out = {"key": [batch, *full], "batch": [batch] * (1 + len(full)), "ids": [who, *none], "sizes": [_pack(np.array(sizes, np.int64)), *none], "seq": [_pack(rank[seq]), *none], "order": [_pack(order), *none], "known": [_pack(np.array(tokens, np.int64)), *none], "words": [None, *(_pack_words([w for w, _ in shares[b]]) for b in full)]}
            for x in (ids, sizes, seqs, numbers):
                x.clear()
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                text = text.as_py() or ""
                tokens = find(text)
                for t in tokens:
                    if t not in numbers:
                        numbers[t] = len(numbers)
                ids.append(i)
                sizes.append(len(tokens))
                seqs.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                held += len(text)
                if held >= batch_bytes:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return run


def _encode(ranks_path: str, pattern: str):
    """Encodes the distinct words of a bucket, each once, and answers every batch along the words it sent.

    Rows come bucket by bucket, one message at a time.
    """

    def run(batches):
        piece = encoder(ranks_path, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            keys, batch, given, bucket = b.column("key").to_pylist(), [], [], []
            for key, number, blob in zip(keys, b.column("batch").to_pylist(), b.column("words")):
                if key < 0:
                    continue
                if key != now:
                    known, now = {}, key
                sizes, ids = [], []
                for word in _unpack_words(blob.as_py()):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = piece(word)
                    sizes.append(len(got))
                    ids += got
                size = _pack(np.array(sizes, np.int64))
                given.append(struct.pack("<Q", len(size)) + size + _pack(np.array(ids, np.int64)))
                batch.append(number)
                bucket.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(bucket, pa.int32()), pa.array(given, pa.binary())], names=["key", "bucket", "answer"])

    return run


_NONE = pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})


def _assemble(table: pa.Table, replies: pa.Table) -> pa.Table:
    """The texts of a batch; words that wait for their own batch give nothing here."""
    if not len(table) or table["key"][0].as_py() >= 0:
        return _NONE
    row = {k: table[k][0].as_py() for k in ("ids", "sizes", "seq", "order", "known")}
    own = _unpack(row["known"]).astype(np.int32)
    sizes, ids = [np.ones(len(own), np.int64)], [own]
    for i in np.argsort(replies["bucket"].to_numpy()):
        blob = replies["answer"][int(i)].as_py()
        (n,) = struct.unpack_from("<Q", blob)
        sizes.append(_unpack(blob[8 : 8 + n]))
        ids.append(_unpack(blob[8 + n :]).astype(np.int32))
    sent, token, order = np.concatenate(sizes), np.concatenate(ids), _unpack(row["order"])
    size, begin = np.empty(len(sent), np.int64), np.empty(len(sent), np.int64)
    size[order], begin[order] = sent, np.cumsum(sent) - sent
    seq, count = _unpack(row["seq"]).astype(np.int32), _unpack(row["sizes"])
    ends, flat = np.zeros(len(seq) + 1, np.int64), []
    for a in range(0, len(seq), PIECE):
        own = seq[a : a + PIECE]
        each = size[own]
        stop = np.cumsum(each)
        flat.append(token[np.arange(stop[-1]) + np.repeat(begin[own] - (stop - each), each)])
        ends[a + 1 : a + 1 + len(own)] = stop + ends[a]
    starts = ends[np.concatenate([[0], np.cumsum(count)])].astype(np.int32)
    n = len(count)
    missing = np.frombuffer(row["ids"], np.uint8, n, 8 * n).astype(bool)
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
    return pa.table({"doc_id": pa.array(np.frombuffer(row["ids"], "<i8", n), pa.int64(), mask=missing), "ids": pa.ListArray.from_arrays(pa.array(starts), values)})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id and the token ids of each row's whole text."""
    parts.small_batches(docs.sparkSession)
    tasks = parts.partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = scratch.spread(rows)
    rows = rows if dealt is rows else dealt.sortWithinPartitions("id", F.xxhash64("text"))  # in one order, so batches are the same again
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = min(max(tasks, -(-size // BUCKET_BYTES)), BUCKETS)
    # Both uses read the same exchange; each passes over the rows of the other kind.
    dealt = rows.mapInArrow(parts.lean(_split(ranks_path, pattern, buckets, batch_bytes)), ROWS).repartition(max(tasks, buckets), "key")
    replies = dealt.sortWithinPartitions("key").mapInArrow(parts.lean(_encode(ranks_path, pattern)), ANSWERS)  # all columns, so the exchange is the same
    return dealt.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(parts.lean(_assemble), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids by the token-byte table."""
    from pyspark.sql import types as T

    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        table = token_bytes(ranks_path)
        end = len(table)
        table = [*table, b""]
        for b in batches:
            ids = b.column(ids_col)
            ids = pc.if_else(pc.is_null(ids), pa.scalar([], ids.type), ids) if ids.null_count else ids
            off, flat = ids.offsets.to_numpy(), pc.fill_null(ids.values, -1).to_numpy(zero_copy_only=False)
            flat = np.where((flat < 0) | (flat >= end), end, flat)
            out = [b"".join(map(table.__getitem__, flat[x:y].tolist())) for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, out_col])

    return encoded.mapInArrow(parts.lean(run), schema)
