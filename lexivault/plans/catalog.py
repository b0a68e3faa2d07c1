"""The registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

Documents stand for files: path = /source/lang/id.pdf, collection = source, content = text. Conversations stand for
documents with pages: page = turn + 1. Word boxes lie on the grid of ``positions.grid_boxes``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import jobs as J
from ..operators import positions as P
from ..operators import words as W
from ..sources import scratch
from . import lower, search
from . import query as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- inputs ----

_TOKENS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{S}}]+'), lambda w: lower(w))"
_D = "d AS (SELECT doc_id, source AS collection_id, '/' || source || '/' || lang || '/' || doc_id || '.pdf' AS path, text AS content FROM documents)"
_TOK = _D + ", tok AS (SELECT *, " + _TOKENS.format("content") + " AS toks FROM d)"
_POST = _TOK + ", post AS (SELECT doc_id, collection_id, path, len(toks) AS dl, unnest(toks) AS term, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos FROM tok)"
_CONV = "cw AS (SELECT conv_id AS doc_id, turn + 1 AS page, unnest(t) AS word_text, generate_subscripts(t, 1) AS i FROM (SELECT *, " + _TOKENS.format("text") + " AS t FROM conversations)), pos AS (SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS INTEGER) AS word_offset, word_text FROM cw)"
_GRID = _POST + ", grid AS (SELECT doc_id, pos AS word_offset, CAST(1 + pos // 250 AS INTEGER) AS page, CAST(50 + 70 * (pos % 250 % 8) AS DOUBLE) AS x_min, CAST(750 - 15 * (pos % 250 // 8) AS DOUBLE) AS y_min, term AS word_text FROM post)"
#: Known files: one for each document. On disk all of them stand where they stood (l), or every tenth has moved (m).
_JOBS = (
    _D
    + """, j AS (SELECT d.doc_id + 1 AS id, path, sha256(content) AS checksum, CASE doc_id % 5 WHEN 4 THEN 'error' WHEN 3 THEN 'pending' ELSE 'done' END AS status,
    n_chars < 300 AS ocr_flag, CASE WHEN doc_id % 5 = 4 THEN 'unreadable' END AS error, CAST(doc_id % 3 AS INTEGER) AS ocr_attempts, doc_id * 10 AS file_modified, n_chars AS file_size
    FROM d JOIN documents USING (doc_id)),
 l AS (SELECT path, doc_id * 10 + CAST(doc_id % 7 = 0 AS INTEGER) AS file_modified, n_chars AS file_size FROM d JOIN documents USING (doc_id)),
 m AS (SELECT CASE WHEN file_modified // 10 % 10 = 0 THEN '/moved' || path ELSE path END AS path, file_modified, file_size FROM l)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = scratch.spread(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("source").alias("collection_id"), path.alias("path"), F.col("text").alias("content"))


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    return P.word_offsets(pages)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("content"))).alias("word_offset", "word_text"))
    return P.grid_boxes(words)


def document_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.tokens(F.col("content")).alias("words"))


def _one_page(i: np.ndarray) -> tuple[np.ndarray, ...]:
    """The grid's boxes, with all of a document's pages drawn on one."""
    page, *box = P.grid_places(i)
    return np.ones_like(page), *box


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files: all documents."""
    i = F.col("doc_id")
    rows = documents(spark, sf_dir).withColumn("n_chars", F.length("content").cast("long"))
    status = F.when(i % 5 == 4, "error").when(i % 5 == 3, "pending").otherwise("done")
    null = F.lit(None)
    return rows.select(
        (i + 1).alias("id"), "path", F.sha2("content", 256).alias("checksum"), status.alias("status"), (F.col("n_chars") < 300).alias("ocr_flag"), F.when(i % 5 == 4, "unreadable").alias("error"), (i % 3).cast("int").alias("ocr_attempts"),
        null.cast("string").alias("ocr_error"), null.cast("timestamp").alias("failed_ocr"), null.cast("string").alias("language"), (i * 10).alias("file_modified"), F.col("n_chars").alias("file_size"), null.cast("long").alias("duplicate_of"),
    )


def listing(spark: SparkSession, sf_dir: str, moved: bool = False) -> DataFrame:
    """Files on disk: all documents; every seventh has been touched. With moved, every tenth stands in another folder."""
    i = F.col("doc_id")
    path = F.when(i % 10 == 0, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")) if moved else F.col("path")
    return documents(spark, sf_dir).select(path.alias("path"), (i * 10 + (i % 7 == 0).cast("int")).alias("file_modified"), F.length("content").cast("long").alias("file_size"))


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# ---- tokens and vocabulary ----

_add("tokenize_counts", lambda s, d: documents(s, d).select("doc_id", T.tokens(F.col("content")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms")), f"WITH {_TOK} SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_terms FROM tok")
_add("vocabulary_df", lambda s, d: lower.vocabulary(documents(s, d)), f"WITH {_POST} SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM post GROUP BY term")
_add("corpus_statistics", lambda s, d: lower.corpus_stats(documents(s, d)).select("collection_id", "n_docs", F.round("avg_length", 6).alias("avg_length")), f"WITH {_TOK} SELECT collection_id, count(*) AS n_docs, round(avg(len(toks)), 6) AS avg_length FROM tok GROUP BY collection_id")
_add("term_offsets", lambda s, d: P.term_offsets(documents(s, d), "license"), f"WITH {_POST} SELECT doc_id, pos AS word_offset FROM post WHERE term = 'license'")
_add("clean_words", lambda s, d: documents(s, d).select("doc_id", F.sha2(T.clean_word(F.col("content")), 256).alias("clean_sha256")), rf"WITH {_D} SELECT doc_id, sha256(array_to_string(regexp_extract_all(content, '[\p{{L}}\p{{N}}\p{{S}}]+'), ' ')) AS clean_sha256 FROM d")
_add("single_token_words", lambda s, d: documents(s, d).select(F.explode(F.split("content", r"[ \n]+")).alias("word")).where(F.col("word") != "").groupBy(T.is_token(F.col("word")).alias("is_token")).agg(F.count(F.lit(1)).alias("n_words")), rf"WITH {_D}, w AS (SELECT unnest(regexp_split_to_array(content, '[ \n]+')) AS word FROM d) SELECT regexp_matches(word, '^[\p{{L}}\p{{N}}\p{{S}}]+$') AS is_token, count(*) AS n_words FROM w WHERE word <> '' GROUP BY 1")
_add("content_checksums", lambda s, d: documents(s, d).select("doc_id", T.checksum(F.col("content")).alias("checksum")), f"WITH {_D} SELECT doc_id, sha256(content) AS checksum FROM d")
_add("file_names", lambda s, d: documents(s, d).select("doc_id", T.file_name(F.col("path")).alias("file_name"), T.folder(F.col("path")).alias("folder")), rf"WITH {_D} SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS file_name, regexp_replace(path, '/?[^/]*$', '') AS folder FROM d")
_add("page_counts", lambda s, d: documents(s, d).select("doc_id", T.page_count(F.concat(F.lit("Title: x\nPages:   "), F.col("doc_id") % 9, F.lit("\nSize: 1"))).alias("n_pages")), "SELECT doc_id, CAST(greatest(doc_id % 9, 1) AS INTEGER) AS n_pages FROM documents")
_add("analysers", lambda s, d: table(s, d, "documents").select(F.concat("lang", F.lit("")).alias("lang")).union(s.createDataFrame([("jpn",), ("th",), ("cmn",), ("kor",)], "lang string")).groupBy(T.analyser_for(F.col("lang")).alias("analyser")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN lang IN ('ja', 'jpn') THEN 'ja' WHEN lang IN ('zh', 'cmn') THEN 'zh' WHEN lang IN ('ko', 'kor') THEN 'ko' WHEN lang IN ('th', 'tha') THEN 'th' ELSE 'multilang' END AS analyser, count(*) AS n FROM (SELECT lang FROM documents UNION ALL VALUES ('jpn'), ('th'), ('cmn'), ('kor')) GROUP BY 1")
_FLAT = r"regexp_replace(regexp_replace(nfc_normalize(text), '[\t\f\r\v ]+|[\x00-\x09\x0b-\x1f\x7f-\x9f]+', ' ', 'g'), ' {2,}', ' ', 'g')"
#: SQL knows NFC only, which is the same as NFKC for texts without compatibility characters, as the table's are.
_add("normalize_text", lambda s, d: documents(s, d).select("doc_id", T.normalize_text("content").alias("normalized")), rf"SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split({_FLAT}, chr(10)), lambda x: trim(x)), chr(10)), '^\s+|\s+$', '', 'g') AS normalized FROM documents")


def _language_sql() -> str:
    own = ", ".join(f"count(*) FILTER (w IN ({', '.join(repr(x) for x in words.split())})) / count(*) AS {lang}" for lang, words in T.STOP_WORDS.items())
    shares = ", ".join(T.STOP_WORDS)
    best = " ".join(f"WHEN {lang} = top THEN '{lang}'" for lang in T.STOP_WORDS)
    return rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(trim(text)), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
 n AS (SELECT doc_id, {own} FROM w GROUP BY doc_id),
 r AS (SELECT *, list_reverse_sort([{shares}]) AS s, greatest({shares}) AS top FROM n)
 SELECT doc_id, CASE WHEN strlen(trim(text)) >= {T.MIN_BYTES} AND s[1] - s[2] >= {T.LEAD} THEN CASE {best} END END AS language FROM documents LEFT JOIN r USING (doc_id)"""


_add("detect_language", lambda s, d: documents(s, d).select("doc_id", T.detect_language("content").alias("language")), _language_sql())
_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in T.ENTITIES:
    _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_char}')"
_add("page_texts", lambda s, d: table(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text")), rf"SELECT page_id, trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g')) AS text FROM pages")

# ---- search ----


def _leaf_sql(leaf) -> str:
    if isinstance(leaf, Q.Term):
        return f"len(list_filter(toks, lambda w: w = '{leaf.text}'))"
    if isinstance(leaf, Q.Phrase):
        test = " AND ".join(f"toks[i + {k + 1}] = '{t}'" for k, t in enumerate(leaf.terms))
        return f"len(list_filter(range(len(toks) - {len(leaf.terms) - 1}), lambda i: {test}))"
    if isinstance(leaf, Q.Fuzzy):
        return f"len(list_filter(toks, lambda w: damerau_levenshtein(w, '{leaf.text}') <= {leaf.distance}))"
    return f"len(list_filter(toks, lambda w: regexp_full_match(w, '{leaf.pattern}')))"


def _match_sql(q, names) -> str:
    if isinstance(q, Q.All):
        return "true"
    if isinstance(q, Q.Nothing):
        return "false"
    if isinstance(q, Q.Boost):
        return _match_sql(q.query, names)
    if isinstance(q, Q.Bool):
        main = " AND ".join(_match_sql(x, names) for x in q.must) if q.must else " OR ".join(_match_sql(x, names) for x in q.should) or "true"
        return "((" + main + ")" + "".join(f" AND NOT {_match_sql(x, names)}" for x in q.must_not) + ")"
    return f"({names[q]} > 0)"


def search_sql(q, path: str | None = None, per_collection: bool = False, source: str = _TOK) -> str:
    """CTEs and a final ``hits(collection_id, doc_id, path, score)`` of a query tree."""
    names = {x: f"f{i}" for i, x in enumerate(dict.fromkeys(Q.all_leaves(q)))}
    terms = sorted({t for x, _ in Q.leaves(q) if isinstance(x, (Q.Term, Q.Phrase)) for t in ([x.text] if isinstance(x, Q.Term) else x.terms)})
    group = "GROUP BY collection_id" if per_collection else ""
    key = "collection_id, " if per_collection else ""
    dfs = "".join(f", sum(CAST(list_contains(toks, '{t}') AS INTEGER)) AS df{i}" for i, t in enumerate(terms))
    idf = lambda t: f"ln(1 + (n - df{terms.index(t)} + 0.5) / (df{terms.index(t)} + 0.5))"
    parts = []
    for x, w in Q.leaves(q):
        if isinstance(x, (Q.Term, Q.Phrase)):
            own = [x.text] if isinstance(x, Q.Term) else x.terms
            parts.append(f"{w} * ({' + '.join(map(idf, own))}) * {names[x]} * 2.2 / ({names[x]} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
        else:
            parts.append(f"CASE WHEN {names[x]} > 0 THEN {w} ELSE 0.0 END")
    flat = "".join(f", {_leaf_sql(x)} AS {c}" for x, c in names.items())
    join = "USING (collection_id)" if per_collection else "ON true"
    keep = f" AND regexp_full_match(path, '{path}')" if path else ""
    return f"""WITH {source}, m AS (SELECT collection_id, doc_id, path, len(toks) AS dl{flat} FROM tok),
 st AS (SELECT {key}count(*) AS n, avg(len(toks)) AS avgdl{dfs} FROM tok {group}),
 hits AS (SELECT m.collection_id, doc_id, path, CAST({' + '.join(parts) or '0'} AS DOUBLE) AS score FROM m JOIN st {join} WHERE {_match_sql(q, names)}{keep})"""


_ROW = "doc_id, path, round(score, 6) AS score"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "path", F.round("score", 6).alias("score"))


def _add_search(name: str, q, path: str | None = None, limit: int | None = None, offset: int = 0) -> None:
    def run(s, d):
        hits = lower.scan(documents(s, d), q, path)
        return _rows(hits if limit is None else lower.top(hits.drop("collection_id"), limit, offset))

    page = "" if limit is None else f" ORDER BY hits.score DESC, doc_id LIMIT {limit} OFFSET {offset}"
    _add(name, run, f"{search_sql(q, path)} SELECT {_ROW} FROM hits{page}")


_add_search("term_search_bm25_top10", Q.auto_phrase("license"), limit=10)
_add_search("phrase_search", Q.auto_phrase('"of the"'))
_add_search("auto_phrase", Q.auto_phrase("public license"))
_add_search("bool_and", Q.boolean_phrase("license AND the"))
_add_search("bool_or", Q.boolean_phrase("apache OR mit OR gnu"))
_add_search("bool_or_top10", Q.boolean_phrase("apache OR mit OR gnu"), limit=10)
_add_search("bool_not", Q.boolean_phrase("license NOT apache"))
_add_search("plus_minus", Q.boolean_phrase("+license -mit"))
_add_search("nested_parens", Q.boolean_phrase("(apache OR mit) AND (the OR les) AND license"))
_add_search("mixed_phrase_term", Q.boolean_phrase('released "mit license"'))
_add_search("precedence", Q.boolean_phrase("gnu AND public OR apache AND license"))
_add_search("standard_or", Q.by_kind("standard", "apache gnu"))
_add_search("match_all", Q.by_kind("phrase", ""))
_add_search("path_filter_fullmatch", Q.auto_phrase("license"), path="/src[0-4]/en/.*")
_add_search("path_only", Q.All(), path="/src1/.*")
_add_search("paged_search", Q.auto_phrase("the"), limit=20, offset=40)
_add_search("structured_boolean", Q.structured([("license", "must"), ("apache", "should"), ("gnu", "must_not")]))
_add_search("structured_json", Q.structured_json([{"term": "public license", "occur": "should"}, {"term": "apache", "occur": "should"}]))
_add_search("boosted_clause", Q.Bool(should=(Q.Boost(Q.Term("apache"), 3.0), Q.Term("mit"))))
_add_search("fuzzy_terms", Q.fuzzy("licanse", 1))
_add_search("regex_terms", Q.by_kind("regex", "licens.*"))
_add("phrase_search_postings", lambda s, d: _from_postings(s, d, Q.auto_phrase('"of the"')), f"{search_sql(Q.auto_phrase(chr(34) + 'of the' + chr(34)))} SELECT doc_id, round(score, 6) AS score FROM hits")
_add("bool_search_postings", lambda s, d: _from_postings(s, d, Q.boolean_phrase("(apache OR mit) AND license NOT gnu")), f"{search_sql(Q.boolean_phrase('(apache OR mit) AND license NOT gnu'))} SELECT doc_id, round(score, 6) AS score FROM hits")
_add("fuzzy_postings", lambda s, d: _from_postings(s, d, Q.fuzzy("licanse", 1)), f"{search_sql(Q.fuzzy('licanse', 1))} SELECT doc_id, round(score, 6) AS score FROM hits")


def _from_postings(s, d, q):
    docs = documents(s, d).drop("collection_id").withColumn("collection_id", F.lit(None).cast("string"))
    return lower.search_postings(lower.postings(docs), lower.corpus_stats(docs), q).select("doc_id", F.round("score", 6).alias("score"))


_add("hit_count", lambda s, d: lower.scan(documents(s, d), Q.auto_phrase("license"), "/src[0-4]/.*").agg(F.count(F.lit(1)).alias("total_count")), f"{search_sql(Q.auto_phrase('license'), '/src[0-4]/.*')} SELECT count(*) AS total_count FROM hits")
_add("count_by_collection", lambda s, d: lower.scan(documents(s, d), Q.auto_phrase("license")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_hits")), f"{search_sql(Q.auto_phrase('license'))} SELECT collection_id, count(*) AS n_hits FROM hits GROUP BY collection_id")


def _federated(s, d):
    boosts = s.createDataFrame([("src1", 2.0), ("src2", 1.5)], "collection_id string, boost double")
    return search.federated(documents(s, d), Q.auto_phrase("the"), boosts, 10).select("collection_id", "doc_id", "path", F.round("score", 6).alias("score"))


_BOOSTED = "(SELECT collection_id, doc_id, path, score * CASE collection_id WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 1.5 ELSE 1.0 END AS boosted FROM hits)"
_add("federated_boosted_top10", _federated, f"{search_sql(Q.auto_phrase('the'), per_collection=True)} SELECT collection_id, doc_id, path, round(boosted, 6) AS score FROM {_BOOSTED} ORDER BY boosted DESC, collection_id, doc_id LIMIT 10")

_PATHS = _D + ", tok AS (SELECT *, " + _TOKENS.format("path") + " AS toks FROM d)"
_add("weighted_fields", lambda s, d: _rows(search.weighted_fields(documents(s, d), "en", {"content": 1.0, "path": 2.0, "nowhere": 5.0})), f"SELECT doc_id, path, round(sum(score), 6) AS score FROM (SELECT * FROM ({search_sql(Q.Term('en'))} SELECT doc_id, path, score FROM hits) UNION ALL SELECT * FROM ({search_sql(Q.Term('en'), source=_PATHS)} SELECT doc_id, path, 2.0 * score AS score FROM hits)) GROUP BY doc_id, path")
_add("field_search", lambda s, d: _rows(search.field_search(documents(s, d), "src1 src2", "path")), f"{search_sql(Q.parse('src1 src2', conjunction=False), source=_PATHS)} SELECT {_ROW} FROM hits")


_add("field_fuzzy", lambda s, d: _rows(search.field_search(documents(s, d), "srcc1", "path", distance=1)), f"{search_sql(Q.fuzzy('srcc1', 1), source=_PATHS)} SELECT {_ROW} FROM hits")
_add("stem_search", lambda s, d: _rows(search.recency_boost(search.stem_search(documents(s, d), "license"))), f"{search_sql(Q.auto_phrase('license'))} SELECT {_ROW} FROM hits")


def _rich(s, d):
    docs = documents(s, d)
    request = search.SearchInput('released "mit license"', limit=10, strategy="boolean_phrase")
    pipe = search.SearchPipeline(search.ScanEngine(docs), [search.TermCollector(), search.Snippets(docs)])
    return pipe.rich(request).select("doc_id", "path", F.round("score", 6).alias("score"), "snippet", F.array_join("matched_terms", " ").alias("terms"), F.size("phrase_groups").alias("n_groups"))


_add("snippets", _rich)
_BOTH = Q.boolean_phrase('released "mit license"')
_add("rich_hits", lambda s, d: _rich(s, d).select("doc_id", "path", "score", "terms", "n_groups"), f"{search_sql(_BOTH)} SELECT {_ROW}, 'released mit license' AS terms, 2 AS n_groups FROM hits ORDER BY hits.score DESC, doc_id LIMIT 10")


def _groups(s, d):
    """Highlight groups of queries made of a quoted benchmark text and a number, by both strategies."""
    said = F.concat(F.lit('"'), "text", F.lit('" '), F.col("item_id").cast("string")).alias("query")
    rows = table(s, d, "benchmark").select("item_id", said)
    auto, boolean = (F.pandas_udf(_said(f), "string") for f in (Q.auto_phrase_groups, Q.boolean_phrase_groups))
    both = rows.select("item_id", F.lit("auto_phrase").alias("strategy"), auto("query").alias("phrase_groups")).union(rows.select("item_id", F.lit("boolean_phrase"), boolean("query")))
    return both


def _said(groups):
    def run(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: " | ".join(" ".join(g) for g in groups(q)[0]))

    return run


_PUNCTUATION = r"""[!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]"""
_add(
    "term_groups",
    _groups,
    rf"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS t FROM benchmark),
 b AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(replace(replace(text, '(', ' '), ')', ' ')), '\S+'), lambda x: regexp_replace(x, '^{_PUNCTUATION}+|{_PUNCTUATION}+$', '', 'g')), lambda x: x <> '') AS t FROM benchmark)
 SELECT item_id, 'auto_phrase' AS strategy, item_id || ' | ' || array_to_string(t, ' ') AS phrase_groups FROM w UNION ALL SELECT item_id, 'boolean_phrase', array_to_string(t, ' ') || ' | ' || item_id FROM b""",
)


def _with_positions(s, d):
    """The best hits of a phrase with the boxes of its words."""
    request = search.SearchInput("public license", limit=10)
    pipe = search.SearchPipeline(search.ScanEngine(documents(s, d)), [search.TermCollector(), search.PositionEnricher(document_words(s, d))])
    return pipe.rich(request).select("doc_id", F.round("score", 6).alias("score"), F.size("positions").cast("long").alias("n_positions"), F.element_at("positions", 1)["word_offset"].alias("first_offset"))


_add("hits_with_positions", _with_positions, f"{search_sql(Q.auto_phrase('public license'))}, best AS (SELECT * FROM hits ORDER BY hits.score DESC, doc_id LIMIT 10) SELECT best.doc_id, round(best.score, 6) AS score, count(*) AS n_positions, CAST(min(p.i) - 1 AS INTEGER) AS first_offset FROM best JOIN (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM tok) p ON p.doc_id = best.doc_id WHERE p.w IN ('public', 'license') GROUP BY best.doc_id, best.score")

# ---- positions ----

_add("phrase_positions", lambda s, d: P.phrase(conversation_words(s, d), ["of", "the"]).select("doc_id", "page", "start_offset", "word_offset", "word_text"), f"WITH {_CONV}, st AS (SELECT a.doc_id, a.page, a.word_offset AS start_offset FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.page = b.page AND b.word_offset = a.word_offset + 1 WHERE a.word_text = 'of' AND b.word_text = 'the') SELECT st.doc_id, st.page, start_offset, pos.word_offset, word_text FROM st JOIN pos ON pos.doc_id = st.doc_id AND pos.page = st.page AND pos.word_offset BETWEEN start_offset AND start_offset + 1")
_add("single_term_positions", lambda s, d: P.single_term(document_words(s, d), "License").select("doc_id", "word_offset", "page", F.col("x_min").cast("double").alias("x_min"), F.col("y_min").cast("double").alias("y_min"), "word_text"), f"WITH {_GRID} SELECT doc_id, word_offset, page, x_min, y_min, word_text FROM grid WHERE word_text = 'license'")
_add("positions_at_offsets", lambda s, d: P.at_offsets(document_words(s, d), document_words(s, d).where("word_text = 'license'").select("doc_id", (F.col("word_offset") + 1).alias("word_offset"))).select("doc_id", "word_offset", "word_text"), f"WITH {_GRID} SELECT a.doc_id, a.word_offset, a.word_text FROM grid a JOIN grid b ON a.doc_id = b.doc_id AND a.word_offset = b.word_offset + 1 WHERE b.word_text = 'license'")
_HITS = f"{_CONV}, f AS (SELECT doc_id, page, word_offset, word_text FROM pos WHERE word_text IN ('of', 'the'))"
_found = lambda s, d: conversation_words(s, d).where(F.col("word_text").isin("of", "the"))
_OVER = "OVER (PARTITION BY doc_id ORDER BY page, word_offset)"
_add("phrase_starts", lambda s, d: P.phrase_starts(_found(s, d), 2).select("doc_id", "page", "word_offset", "is_start"), f"WITH {_HITS} SELECT doc_id, page, word_offset, coalesce(lag(page) {_OVER} <> page OR lag(word_offset) {_OVER} + 1 <> word_offset, true) AS is_start FROM f")
_add("match_navigation", lambda s, d: P.neighbours(_found(s, d)).select("doc_id", "page", "word_offset", "previous_offset", "next_offset"), f"WITH {_HITS} SELECT doc_id, page, word_offset, lag(word_offset) {_OVER} AS previous_offset, lead(word_offset) {_OVER} AS next_offset FROM f")
_add("matching_pages", lambda s, d: P.matching_pages(_found(s, d)), f"WITH {_HITS} SELECT DISTINCT doc_id, page - 1 AS page_index FROM f WHERE page >= 1")
_add("positions_by_page", lambda s, d: P.by_page(_found(s, d)).select("doc_id", "page", F.size("words").cast("long").alias("n_words"), F.element_at("words", 1)["word_offset"].alias("first_offset")), f"WITH {_HITS} SELECT doc_id, page, count(*) AS n_words, min(word_offset) AS first_offset FROM f GROUP BY doc_id, page")
_add("distinct_boxes", lambda s, d: P.document_boxes(document_tokens(documents(s, d)), _one_page, P.starts).select("doc_id", "word_offset", "word_text"), f"WITH {_GRID} SELECT doc_id, word_offset, word_text FROM grid QUALIFY row_number() OVER (PARTITION BY doc_id, x_min, y_min ORDER BY word_offset) = 1")
_add("term_positions", lambda s, d: P.term_positions(document_words(s, d), ["public", "license", "mit"], [["public", "license"], ["mit"]]).select("doc_id", "word_offset", "page", "word_text"), f"WITH {_GRID}, st AS (SELECT a.doc_id, a.page, a.word_offset AS o FROM grid a JOIN grid b ON a.doc_id = b.doc_id AND a.page = b.page AND b.word_offset = a.word_offset + 1 WHERE a.word_text = 'public' AND b.word_text = 'license') SELECT g.doc_id, g.word_offset, g.page, g.word_text FROM st JOIN grid g ON g.doc_id = st.doc_id AND g.page = st.page AND g.word_offset BETWEEN o AND o + 1 UNION SELECT doc_id, word_offset, page, word_text FROM grid WHERE word_text = 'mit'")
_add("ui_boxes", lambda s, d: P.document_boxes(document_tokens(documents(s, d).orderBy("doc_id")), _one_page, P.edges).select("doc_id", "word_offset", "word_text"), f"WITH {_GRID} SELECT doc_id, word_offset, word_text FROM grid QUALIFY row_number() OVER (PARTITION BY doc_id, x_min, y_min ORDER BY word_offset) = 1")
_add("nearest_pages", lambda s, d: P.nearest_pages(conversation_words(s, d).groupBy("doc_id", "page").agg((F.max("word_offset") / 2.0).alias("y_centre")), F.lit(100.0)).select("doc_id", "page", "place"), f"WITH {_CONV}, y AS (SELECT doc_id, page, max(word_offset) / 2.0 AS y FROM pos GROUP BY doc_id, page) SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(y - 100), page) AS INTEGER) AS place FROM y")
_add("line_grouping", lambda s, d: P.group_lines(document_words(s, d).where("word_text = 'the'").select("doc_id", "page", F.col("y_min").cast("int").alias("top"), F.col("y_max").cast("int").alias("bottom"))), f"WITH {_GRID} SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y_min) - 1 AS INTEGER) AS line, CAST(y_min AS INTEGER) AS top, CAST(y_min + 12 AS INTEGER) AS bottom, CAST(count(*) AS INTEGER) AS n_words FROM grid WHERE word_text = 'the' GROUP BY doc_id, page, y_min")


def _pages(s, d):
    """Whole texts cut into pages of 2,400 characters, white space among them."""
    c = documents(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit("(?s).{1,2400}"), F.lit(0))).alias("i", "text"))
    return c.select("doc_id", (F.col("i") + 1).alias("page"), "text")


def _typed(i: np.ndarray):
    """Characters 7 wide and 12 high, 60 a line, 40 lines a page."""
    x, y = (i % 60) * 7.0, (i // 60) * 20.0
    return x, y, x + 7.0, y + 12.0


_CHARS = r"""c AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS ch FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS t FROM documents)),
 p AS (SELECT doc_id, CAST(1 + i // 2400 AS INTEGER) AS page, i, ch, (i % 60) * 7.0 AS x, (i % 2400 // 60) * 20.0 AS y, NOT regexp_matches(ch, '^[\x09-\x0D\x20]$') AS solid FROM c),
 n AS (SELECT *, solid AND (i % 60 = 0 OR NOT lag(solid, 1, false) OVER (PARTITION BY doc_id, page ORDER BY i)) AS fresh FROM p),
 k AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY i) AS BIGINT) AS word_id FROM n)"""
_boxed = lambda df: df.select("doc_id", "page", F.col("word_id").cast("long").alias("word_id"), "word_text", "x_min", "y_min", "x_max", "y_max")
_add("char_gap_words", lambda s, d: W.page_words(_pages(s, d), _typed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.max(F.length("word_text")).cast("long").alias("longest")), f"WITH {_CHARS} SELECT doc_id, count(*) AS n_words, max(n) AS longest FROM (SELECT doc_id, page, word_id, count(*) AS n FROM k WHERE solid GROUP BY ALL) GROUP BY doc_id")
_add("box_union", lambda s, d: _boxed(W.page_words(_pages(s, d), _typed)), f"WITH {_CHARS} SELECT doc_id, page, word_id, string_agg(ch, '' ORDER BY i) AS word_text, CAST(min(x) AS DOUBLE) AS x_min, CAST(min(y) AS DOUBLE) AS y_min, CAST(max(x) + 7 AS DOUBLE) AS x_max, CAST(max(y) + 12 AS DOUBLE) AS y_max FROM k WHERE solid GROUP BY doc_id, page, word_id")

# ---- geometry ----


def _geometry(s, d):
    i = F.col("doc_id")
    rows = documents(s, d).select("doc_id", F.lit(612.0).alias("media_width"), F.lit(792.0).alias("media_height"), (i % 4).cast("int").alias("rotation"), *[F.when(i % 3 == 0, F.lit(v)).alias(f"crop_{k}") for k, v in (("left", 50.0), ("top", 742.0), ("right", 562.0), ("bottom", 50.0))], (i % 500).cast("double").alias("x"), (i % 600).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    sx, sy = G.pdf_to_stored(x, y)
    px, py = G.stored_to_pdf(x, y)
    box = G.box_to_render(x, y, x + 60, y + 12)
    w, h = G.render_size()
    return rows.select("doc_id", w.alias("render_w"), h.alias("render_h"), sx.alias("stored_x"), sy.alias("stored_y"), px.alias("pdf_x"), py.alias("pdf_y"), *[b.alias(n) for b, n in zip(box, ("box_x1", "box_y1", "box_x2", "box_y2"))])


_add("geometry_transform", _geometry, """WITH g AS (SELECT doc_id, doc_id % 4 AS r, doc_id % 3 = 0 AS c, CASE WHEN doc_id % 3 = 0 THEN 512.0 ELSE 612.0 END::DOUBLE AS w, CASE WHEN doc_id % 3 = 0 THEN 692.0 ELSE 792.0 END::DOUBLE AS h, (doc_id % 500)::DOUBLE AS x, (doc_id % 600)::DOUBLE AS y FROM documents),
 p AS (SELECT *, x + 60 AS x2, y + 12 AS y2 FROM g),
 q AS (SELECT *, CASE r WHEN 1 THEN h - y WHEN 2 THEN w - x WHEN 3 THEN y ELSE x END AS ax, CASE r WHEN 1 THEN w - x WHEN 2 THEN y WHEN 3 THEN x ELSE y END AS ay, CASE r WHEN 1 THEN h - y2 WHEN 2 THEN w - x2 WHEN 3 THEN y2 ELSE x2 END AS bx, CASE r WHEN 1 THEN w - x2 WHEN 2 THEN y2 WHEN 3 THEN x2 ELSE y2 END AS by_ FROM p)
 SELECT doc_id, CASE WHEN r IN (1, 3) THEN h ELSE w END AS render_w, CASE WHEN r IN (1, 3) THEN w ELSE h END AS render_h, CASE WHEN c THEN x - 50 ELSE x END AS stored_x, CASE WHEN c THEN 742 - y ELSE h - y END AS stored_y, x AS pdf_x, h - y AS pdf_y, least(ax, bx) AS box_x1, least(ay, by_) AS box_y1, greatest(ax, bx) AS box_x2, greatest(ay, by_) AS box_y2 FROM q""")


def _layout(s, d):
    i = F.col("doc_id")
    rows = documents(s, d).select("doc_id", (i % 500).cast("double").alias("x"), (i % 600).cast("double").alias("y"), (i % 4).cast("int").alias("rotation"))
    pw, ph = F.lit(612.0), F.lit(792.0)
    lx, ly = G.to_layout(F.col("x"), F.col("y"), pw, ph, 1224.0, 396.0)
    w, h = G.layout_size(F.lit(60.0), F.lit(12.0), pw, ph, 1224.0, 396.0)
    return rows.select("doc_id", lx.alias("layout_x"), ly.alias("layout_y"), w.alias("layout_w"), h.alias("layout_h"), F.round(G.centre_y(F.col("x"), F.col("y"), ph, F.col("rotation")), 9).alias("centre"))


_add("ui_coordinate_map", _layout, "SELECT doc_id, (doc_id % 500) * 2.0::DOUBLE AS layout_x, (792 - doc_id % 600) * 0.5::DOUBLE AS layout_y, 120.0::DOUBLE AS layout_w, 8.0::DOUBLE AS layout_h, round(least(1, greatest(0, CASE doc_id % 4 WHEN 1 THEN 792 - doc_id % 500 WHEN 3 THEN doc_id % 500 ELSE doc_id % 600 END / 792::DOUBLE)), 9) AS centre FROM documents")

# ---- files and jobs ----

_add("scan_changes", lambda s, d: J.changed(listing(s, d, True), jobs(s, d)), f"WITH {_JOBS} SELECT m.path, m.file_modified, m.file_size FROM m LEFT JOIN j ON m.path = j.path WHERE j.path IS NULL OR m.file_modified <> j.file_modified OR m.file_size <> j.file_size OR j.status IN ('error', 'extracting')")
_add("orphans", lambda s, d: J.orphans(jobs(s, d), listing(s, d, True)).select("id", "path"), f"WITH {_JOBS} SELECT id, path FROM j WHERE path NOT IN (SELECT path FROM m)")


def _promoted(s, d):
    """Copies that become originals when the files that have moved are dropped."""
    known = J.with_duplicates(jobs(s, d))
    left = J.orphans(known, listing(s, d, True))
    left = known.join(left.select("id"), "id", "left_anti")
    return J.promoted(left, J.with_duplicates(left)).join(known.where("status = 'done'").select("id"), "id", "left_semi").where("status = 'pending'").select("id", "checksum")


_add("promoted_originals", _promoted, f"WITH {_JOBS}, f AS (SELECT checksum, min(id) AS first FROM j WHERE status = 'done' GROUP BY checksum), a AS (SELECT checksum, min(id) AS id FROM j WHERE status = 'done' AND path IN (SELECT path FROM m) GROUP BY checksum) SELECT id, checksum FROM a JOIN f USING (checksum) WHERE id > first")
_add("dedup_originals", lambda s, d: J.originals(documents(s, d).withColumn("checksum", T.checksum(F.col("content")))).select("doc_id", "checksum"), f"WITH {_D} SELECT min(doc_id) AS doc_id, sha256(content) AS checksum FROM d GROUP BY 2")
_add("duplicate_of", lambda s, d: J.with_duplicates(jobs(s, d)).select("id", "duplicate_of"), f"WITH {_JOBS}, f AS (SELECT checksum, min(id) AS first FROM j WHERE status = 'done' GROUP BY checksum) SELECT id, CASE WHEN status = 'done' AND first < id THEN first END AS duplicate_of FROM j LEFT JOIN f USING (checksum)")
_add("original_lookup", lambda s, d: J.original_by_checksum(J.with_duplicates(jobs(s, d))), f"WITH {_JOBS} SELECT checksum, min(id) AS id, arg_min(path, id) AS path FROM j WHERE status = 'done' GROUP BY checksum")
_add("job_status_counts", lambda s, d: J.status_counts(jobs(s, d)), f"WITH {_JOBS} SELECT status, count(*) AS n_jobs, count(*) FILTER (ocr_flag) AS n_ocr FROM j GROUP BY status")
_add("claim_order", lambda s, d: J.claim(jobs(s, d), 25).select("id", "path", "file_size"), f"WITH {_JOBS} SELECT id, path, file_size FROM j WHERE status = 'pending' ORDER BY coalesce(file_size, 0) DESC, id LIMIT 25")
_add("ocr_needed", lambda s, d: J.needs_ocr(jobs(s, d)).select("id", "path", "ocr_attempts"), f"WITH {_JOBS} SELECT id, path, ocr_attempts FROM j WHERE status = 'done' AND ocr_flag AND ocr_attempts < 2")
_add("errored_jobs", lambda s, d: J.with_status(jobs(s, d), "error").select("id", "path", "error"), f"WITH {_JOBS} SELECT id, path, error FROM j WHERE status = 'error'")


def _attempts(s, d):
    results = listing(s, d).select("path", (F.col("file_size") % 2 == 0).alias("ok"), F.lit("blank page").alias("error"))
    out = J.ocr_attempt(jobs(s, d), results)
    return out.select("id", "ocr_attempts", "ocr_flag", "ocr_error", F.col("failed_ocr").isNotNull().alias("gave_up"))


_add("ocr_attempt_update", _attempts, f"WITH {_JOBS} SELECT id, CASE WHEN l.path IS NULL THEN ocr_attempts ELSE ocr_attempts + 1 END AS ocr_attempts, CASE WHEN l.file_size % 2 = 0 THEN false ELSE ocr_flag END AS ocr_flag, CASE WHEN l.file_size % 2 = 1 THEN 'blank page' END AS ocr_error, coalesce(l.file_size % 2 = 1 AND ocr_attempts + 1 >= 2, false) AS gave_up FROM j LEFT JOIN l ON j.path = l.path")


def _events(s, d):
    e = listing(s, d).select("path", F.when(F.col("file_size") % 3 == 0, "done").when(F.col("file_size") % 3 == 1, "error").otherwise("claim").alias("kind"), F.lit("c").alias("checksum"), F.lit(False).alias("ocr_flag"), F.lit("broken").alias("error"))
    return J.apply_events(jobs(s, d), e).select("id", "status", "error", "ocr_flag")


_add("job_events", _events, f"WITH {_JOBS} SELECT id, CASE l.file_size % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' WHEN 2 THEN 'extracting' ELSE status END AS status, CASE WHEN l.path IS NULL THEN error WHEN l.file_size % 3 = 1 THEN 'broken' END AS error, CASE WHEN l.file_size % 3 = 0 THEN false ELSE ocr_flag END AS ocr_flag FROM j LEFT JOIN l ON j.path = l.path")
_add("upsert_jobs", lambda s, d: J.upsert_pending(jobs(s, d), J.changed(listing(s, d, True), jobs(s, d))).select("id", "path", "status", "error", "file_modified", "file_size"), f"WITH {_JOBS}, ch AS (SELECT m.* FROM m LEFT JOIN j ON m.path = j.path WHERE j.path IS NULL OR m.file_modified <> j.file_modified OR m.file_size <> j.file_size OR j.status = 'error'), mx AS (SELECT max(id) AS m FROM j) SELECT coalesce(j.id, m + row_number() OVER (PARTITION BY j.id IS NULL ORDER BY ch.path)) AS id, coalesce(j.path, ch.path) AS path, CASE WHEN ch.path IS NULL THEN status ELSE 'pending' END AS status, CASE WHEN ch.path IS NULL THEN error END AS error, coalesce(ch.file_modified, j.file_modified) AS file_modified, coalesce(ch.file_size, j.file_size) AS file_size FROM j FULL JOIN ch ON j.path = ch.path CROSS JOIN mx")
_add("upsert_checksums", lambda s, d: J.upsert_checksums(jobs(s, d), documents(s, d).select("path", F.when(F.col("doc_id") % 6 == 0, "new").otherwise(F.sha2("content", 256)).alias("checksum"))).select("id", "checksum", "status", "error"), f"WITH {_JOBS} SELECT id, CASE WHEN (id - 1) % 6 = 0 THEN 'new' ELSE checksum END AS checksum, CASE WHEN (id - 1) % 6 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN (id - 1) % 6 <> 0 THEN error END AS error FROM j")
_add("ids_for_paths", lambda s, d: J.ids_for_paths(jobs(s, d), listing(s, d).where("file_size < 500")), f"WITH {_JOBS} SELECT id, path FROM j WHERE path IN (SELECT path FROM l WHERE file_size < 500)")
_add("catalog_stats", lambda s, d: documents(s, d).groupBy("collection_id").agg(F.count(F.lit(1)).alias("doc_count"), F.sum(F.length("content").cast("long")).alias("n_chars")), "SELECT source AS collection_id, count(*) AS doc_count, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source")


_add("greedy_batches", lambda s, d: J.rounds(jobs(s, d).where("status = 'pending'"), 4))


def _stream(s, d):
    """Documents as a stream of files, duplicates of earlier ones left out, into a versioned table; then that table."""
    from ..sources.store import Store

    base = scratch.fresh(s, "stream")
    store = Store(s, base)
    source = s.readStream.schema(table(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    shape = table(s, d, "documents").select("doc_id", "text").withColumn("checksum", F.lit("")).schema

    def batch(rows, number):
        new = J.originals(rows.select("doc_id", "text", T.checksum(F.col("text")).alias("checksum")))
        old = store.read("originals", shape)
        store.write("originals", new.join(old.select("checksum"), "checksum", "left_anti").select(shape.names), append=True)

    q = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read("originals", shape).select("doc_id", "checksum")


_add("stream_ingest", _stream, "SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents GROUP BY 2")
