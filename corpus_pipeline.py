"""Corpus pipeline: five operators in a row, each stage written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, parts, shared

#: SQL can express neither the classifier, the alignment nor the tokenizer; a test holds the rows against brute force.
ORACLE_SQL = None
#: An n-gram of a text must be so much likelier than by chance, on average (a natural logarithm: e times).
MIN_FIT = 1.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages: text goes that is null, holds no letter, or that the best language
    explains hardly better than chance (``langid``: fit below MIN_FIT). Without any label only letters are judged."""
    name = lambda c: parts.free_name(c, docs.columns)
    lang, score, fit = name("lang_pred"), name("score"), name("fit")
    model = langid.train(docs.select("lang", "text"))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model, out_cols=(lang, score), fit_col=fit).where(F.col(fit) >= MIN_FIT).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; a document left without any text goes."""
    out = line_dedup.line_dedup(docs, keep=tuple(docs.columns))
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    kept = [new[c].alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*kept).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    found = jaccard_join.jaccard_join(docs)
    gone = found.where("component_id < doc_id or (component_id is not null and doc_id is null)").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = parts.free_name("leaked", docs.columns)
    return decontaminate.decontaminate(docs, benchmark, out_col=hits).where(F.size(hits) == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if done is not None:
            shared.remove(done)  # only the stage just written read it
        done = docs
    return docs
