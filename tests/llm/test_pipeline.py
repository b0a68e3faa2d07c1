"""The corpus pipeline against a plain version of its stages."""

import random

import public_tokenizers
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from lexivault.llm import bpe, langid, shared

from . import brute


def plain_stages(rows, items, fits):
    """(doc_id, text) left after the first four stages; fits: whether a text is better than chance in some language."""
    rows = [(i, t) for i, t in rows if t and regex.search(r"\p{L}", t) and fits(t)]
    key = lambda line: brute.low(line.strip(brute.WS))
    first = brute.first_ids(rows, lambda t: [key(x) for x in t.split("\n") if len(key(x)) >= 10])
    rows = [(i, "\n".join(x for x in t.split("\n") if first.get(key(x), i) >= i)) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.strip(brute.WS)]
    keep = {i for i, _, c in brute.op3(rows) if i == c}
    folded = [brute.fold(x) for x in items]
    clean = lambda t: all(s < 0.45 * 2 * len(w) for w, (s, _) in zip(folded, brute.smith_waterman(folded, brute.fold(t))))
    return [(i, t) for i, t in rows if i in keep and clean(t)]


def test_pipeline(spark, data, tmp_path):
    """The whole run against plain stages, with texts of no language among the documents."""
    table = spark.read.parquet(f"{data}/documents.parquet")
    rnd = random.Random(4)
    noise = [(10**6 + k, "".join(chr(rnd.randrange(33, 127)) for _ in range(300)), None, "noise", 300) for k in range(5)]
    noise += [(10**6 + 7, None, None, "noise", 0), (10**6 + 8, "12 345", None, "noise", 6), (10**6 + 9, "это русский текст о погоде", None, "noise", 26)]
    docs = table.unionByName(spark.createDataFrame(noise, table.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [r["text"] for r in benchmark.collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    # Every text of the driver's table is of a labelled language; the noise has none.
    own = {t for i, t in rows if i < 10**6}
    want = plain_stages(rows, items, lambda t: t in own)
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got) == sorted((i, enc.encode_ordinary(t), t) for i, t in want)


def test_no_labels(spark, data):
    """Without any label the first stage judges letters alone."""
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, data).count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_clashing_columns(spark, data):
    """Columns that are named like what the stages use inside pass through as they are."""
    names = ["lang_pred", "score", "fit", "leaked", "hits", "part", "id", "body", "rest", "key", "label", "kept"]
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    docs = shared.written(docs, "clash")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, data), "stage")
        assert out.columns == docs.columns and out.count() > 0
        assert out.where(" or ".join(f"{n} is distinct from concat('{n}', doc_id)" for n in names)).count() == 0
        docs = out
    assert corpus_pipeline.tokens(spark, docs, data).count() == docs.count()


def test_stages_keep_columns(spark, data):
    """Nulls, empty texts, repeated rows and an empty table pass through all stages."""
    cols = spark.read.parquet(f"{data}/documents.parquet").schema
    long = "a clean document of its own words, with more than ten of them in a row, stays as it is"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", 9), (3, long, "en", "s", 9), (4, long, None, None, None), (None, "another text without an id that nothing else here repeats", "en", "s", 1), (5, "123", "en", "s", 3)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, cols)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared.written(stage(spark, docs, data), "stage")
            assert docs.columns == cols.names
        ids = sorted(str(r["doc_id"]) for r in docs.collect())
        assert ids == (["3", "3", "None"] if own else [])
