"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of all labelled rows: each task sums its own counts, slices of the count table are summed
by key, and only the finished table (at most ``MAX_LANGS`` languages x ``BUCKETS``) reaches the driver. The table
of log probabilities is broadcast; texts are scored in numpy, a batch of texts and ``LANGS`` languages at a time, over
whole texts.

Besides the posterior, which is near 1 for any longer text, a fit can be asked for: how much better than chance the best
language explains a text, as the mean over its n-grams without digits of the log of their probability times the number of
buckets. Text of no known language, or noise, is below 0; numbers, which belong to no language, do not count.

Defined cases: text that is null or has no letter is ``und`` with score 0 and null fit; with no labelled row every text
is; ties go to the smaller language name; more than ``MAX_LANGS`` languages are an error; ids may repeat or be null;
columns that have the results' names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from . import hashing, parts

#: Languages at most (the table has 4 * BUCKETS bytes for each), and how many are scored at a time.
MAX_LANGS, LANGS = 1024, 16
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Code points counted or scored at a time.
PIECE = 1 << 16
SLICES = 16


def _grams(codes: np.ndarray, begins: np.ndarray, buckets: int):
    """Hash buckets and places of all n-grams that begin where begins is true; none crosses a separator (code 0)."""
    word = codes.astype(np.uint64)
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, n, np.uint64) if len(codes) >= n else np.zeros(0, np.uint64)
        whole = begins[: len(h)].copy()
        for k in range(n):
            part = word[k : k + len(h)]
            h = hashing.mix(h * np.uint64(0x9E3779B97F4A7C15) + part)
            whole &= part > 0
        at = np.flatnonzero(whole)
        yield (h[at] % np.uint64(buckets)).astype(np.int64), at


def _pieces(texts: list[str]):
    """Groups of texts as code points, each followed by separators; a long text comes in slices.

    A slice carries the first code points of the next one along, so n-grams over its end are counted, once. Gives the
    code points, where n-grams may begin, the start of each text and the texts' numbers.
    """
    codes, begins, starts, who, held = [], [], [], [], 0
    over = max(ORDERS) - 1
    gap = np.zeros(max(ORDERS), np.uint32)
    for i, text in enumerate(texts):
        low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for a in range(0, max(len(low), 1), PIECE):
            piece = low[a : a + PIECE + over]
            starts.append(held)
            who.append(i)
            codes += [piece, gap]
            held += len(piece) + len(gap)
            begins.append(np.arange(len(piece) + len(gap)) < PIECE)
            if held >= PIECE:
                yield np.concatenate(codes), np.concatenate(begins), np.array(starts), np.array(who)
                codes, begins, starts, who, held = [], [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(begins), np.array(starts), np.array(who)


def _count(buckets: int):
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        schema = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("docs", pa.int64()), ("counts", pa.binary())])

        def flush():
            rows = [(lang, s, docs[lang] if not s else 0, part.tobytes()) for lang, c in counts.items() for s, part in enumerate(np.split(c, SLICES))]
            counts.clear()
            docs.clear()
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                own = [t or "" for t, x in zip(texts, langs) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                c = counts.setdefault(lang, np.zeros(buckets, np.int64))
                for codes, begins, _, _ in _pieces(own):
                    for h, _ in _grams(codes, begins, buckets):
                        c += np.bincount(h, minlength=buckets)
                if len(counts) >= 64:
                    yield flush()
        if counts:
            yield flush()

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
    docs = sum(table["docs"].to_pylist())
    return pa.table({"lang": table["lang"][:1], "slice": table["slice"][:1], "docs": pa.array([docs], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (sorted), log priors, and log probabilities by hash bucket and language, from all rows with a language."""
    parts.small_batches(labelled.sparkSession)
    rows = scratch.spread(labelled).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    buckets = BUCKETS
    if rows.select("lang").distinct().count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    schema = "lang string, slice int, docs long, counts binary"
    got = rows.mapInArrow(parts.lean(_count(buckets)), schema).groupBy("lang", "slice").applyInArrow(parts.lean(_sum), schema).collect()
    names = sorted({r["lang"] for r in got})
    counts, docs = np.zeros((buckets, len(names))), np.zeros(len(names))
    for r in got:
        i, width = names.index(r["lang"]), buckets // SLICES
        counts[r["slice"] * width : (r["slice"] + 1) * width, i] = np.frombuffer(r["counts"], np.int64)
        docs[i] += r["docs"]
    smooth = counts + alpha
    return names, np.log(docs / max(docs.sum(), 1)), np.log(smooth / smooth.sum(0)).astype(np.float32)


def _digits(codes: np.ndarray) -> np.ndarray:
    """Running count of the digits among code points, one longer than those."""
    distinct, place = np.unique(codes, return_inverse=True)
    digit = np.array([c > 0 and chr(c).isnumeric() for c in distinct.tolist()], bool)
    return np.concatenate([[0], np.cumsum(digit[place])])


def _sums(table: np.ndarray, h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the table's rows h between cuts, as differences of running sums."""
    run = np.zeros((len(h) + 1, table.shape[1]))
    np.cumsum(table[h], axis=0, out=run[1:])
    return run[cut[1:]] - run[cut[:-1]]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score"), fit_col: str | None = None) -> DataFrame:
    """Adds the language and its posterior probability to the rows, and the fit if it has a name; takes nothing but the
    text into account."""
    parts.small_batches(docs.sparkSession)
    names_out = [*out_cols, *([fit_col] if fit_col else [])]
    docs = scratch.spread(docs.drop(*names_out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names_out, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    at = docs.columns.index(text_col)

    def run(batches):
        names, prior, table = shared.value
        letter = regex.compile(r"\p{L}").search
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            logs, plain, grams = np.zeros((len(texts), len(names))), np.zeros((len(texts), len(names))), np.zeros(len(texts))
            known = np.array([bool(names) and letter(t) is not None for t in texts], bool)
            for codes, begins, starts, who in _pieces(texts) if names else ():
                digits = _digits(codes) if fit_col else None
                for n, (h, place) in zip(ORDERS, _grams(codes, begins, len(table))):
                    if not len(h):
                        continue
                    cut = np.append(np.searchsorted(place, starts), len(h))
                    kinds = [(h, cut, None)]
                    if fit_col:  # n-grams without digits, and the others
                        bare = digits[place + n] == digits[place]
                        kinds = [(h[own], np.concatenate([[0], np.cumsum(own)])[cut], to) for own, to in ((bare, plain), (~bare, None))]
                        np.add.at(grams, who, np.diff(kinds[0][1]))
                    for own, bounds, to in kinds:
                        for a in range(0, len(names), LANGS):
                            sums = _sums(table[:, a : a + LANGS], own, bounds)
                            np.add.at(logs[:, a : a + LANGS], who, sums)
                            if to is not None:
                                np.add.at(to[:, a : a + LANGS], who, sums)
            if names:
                fit = plain.max(1) / np.maximum(grams, 1) + np.log(len(table))
                logs += prior
                best = logs.argmax(1)
                score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            pred = pa.array([names[best[i]] if known[i] else "und" for i in range(len(texts))], pa.string())
            value = pa.array([float(score[i]) if known[i] else 0.0 for i in range(len(texts))], pa.float64())
            how = [pa.array([float(fit[i]) if known[i] else None for i in range(len(texts))], pa.float64())] if fit_col else []
            yield pa.RecordBatch.from_arrays([*b.columns, pred, value, *how], names=[*b.schema.names, *names_out])

    return docs.mapInArrow(parts.lean(run), schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """True for rows kept out of training: crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
