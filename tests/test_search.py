"""Search semantics on a corpus of five documents."""

import pytest
from pyspark.sql import functions as F

from lexivault.functions import text as T
from lexivault.plans import lower, search
from lexivault.plans import query as Q

DOCS = [(1, "/doc1.pdf", "hello world"), (2, "/doc2.pdf", "hello there"), (3, "/other.pdf", "rust programming language"), (4, "/doc4.pdf", "hello AND world boolean test"), (5, "/doc5.pdf", "hello OR world")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, path string, content string").withColumn("collection_id", F.lit("c")).cache()


@pytest.fixture(scope="module")
def index(docs):
    return lower.postings(docs).cache(), lower.corpus_stats(docs).cache()


CASES = [
    ("auto_phrase", "hello", {1, 2, 4, 5}),
    ("auto_phrase", "hello world", {1}),
    ("boolean_phrase", "hello AND world", {1, 4, 5}),
    ("boolean_phrase", "rust OR hello", {1, 2, 3, 4, 5}),
    ("boolean_phrase", "hello NOT world", {2}),
    ("boolean_phrase", "+hello -world", {2}),
    ("boolean_phrase", "(hello OR rust) AND world", {1, 4, 5}),
    ("boolean_phrase", '"hello world" AND boolean', set()),
    ("auto_phrase", 'hello "programming language"', set()),
    ("boolean_phrase", "hello world", {1}),
    ("auto_phrase", "HELLO", {1, 2, 4, 5}),
    ("auto_phrase", "run", set()),
]


@pytest.mark.parametrize("strategy,text,want", CASES)
def test_strategies(docs, index, strategy, text, want):
    tree = Q.STRATEGIES[strategy](text)
    scan = {r["doc_id"]: r["score"] for r in lower.scan(docs, tree).collect()}
    assert set(scan) == want
    by_index = {r["doc_id"]: r["score"] for r in lower.search_postings(*index, tree).collect()}
    assert by_index == pytest.approx(scan)


def test_paging_and_filters(docs):
    pipe = search.SearchPipeline(search.ScanEngine(docs))
    n = lambda **k: pipe.page(search.SearchInput("hello", **k)).count()
    assert (n(limit=2), n(offset=1), n(limit=2, offset=1), n(limit=0), n(offset=9)) == (2, 3, 2, 0, 0)
    assert n(path_filter="nonexistent") == 0 and n(path_filter="/doc.*") == 4 and n(path_filter="doc1") == 0
    assert pipe.page(search.SearchInput("", path_filter="/other.*")).count() == 1
    assert pipe.page(search.SearchInput("")).count() == 0


@pytest.mark.parametrize("text", ["+", "-", "(hello", "hello)", "a AND", "hel*", "title:x", "OR"])
def test_refused(text):
    with pytest.raises(Q.QueryError):
        Q.boolean_phrase(text)


def test_only_negative(docs):
    with pytest.raises(Q.QueryError):
        lower.scan(docs, Q.boolean_phrase("-hello"))
    with pytest.raises(Q.QueryError):
        lower.scan(docs, Q.auto_phrase("hello"), "(")


def test_fuzzy(docs):
    ids = lambda q: {r["doc_id"] for r in lower.scan(docs, q).collect()}
    assert ids(Q.fuzzy("hallo", 1)) == {1, 2, 4, 5}
    assert ids(Q.fuzzy("Hlelo", 1)) == {1, 2, 4, 5}  # neighbours swapped: one edit
    assert ids(Q.fuzzy("languag", 1)) == {3} and ids(Q.fuzzy("langu", 1)) == set()
    assert ids(Q.fuzzy("hello", 0)) == {1, 2, 4, 5}


def test_structured(docs):
    ids = lambda c: {r["doc_id"] for r in lower.scan(docs, Q.structured(c)).collect()}
    assert ids([("hello", "must"), ("world", "must_not")]) == {2}
    assert ids([("rust", "should"), ("there", "should")]) == {2, 3}
    with pytest.raises(Q.QueryError):
        Q.structured([("x", "maybe")])
    with pytest.raises(Q.QueryError):
        Q.structured_json([{"occur": "must"}])


def test_response(docs):
    pipe = search.SearchPipeline(search.ScanEngine(docs), [search.Snippets(docs), search.TermCollector()])
    out = pipe.response(search.SearchInput.from_json('{"query": "hello world", "limit": 5, "strategy": "nonsense"}'))
    assert out["total_count"] == 1 and out["page"] == 1 and out["strategy"] == "auto_phrase"
    assert out["results"][0]["snippet"] == "<b>hello</b> <b>world</b>"
    assert out["results"][0]["phrase_groups"] == [["hello", "world"]]
    assert search.snippet_of("a < b license", ["license"]) == "a &lt; b <b>license</b>"


def test_federated(spark):
    rows = [("one", 1, "/a.pdf", "math algebra"), ("two", 1, "/b.pdf", "math algebra")]
    docs = spark.createDataFrame(rows, "collection_id string, doc_id long, path string, content string")
    boosts = spark.createDataFrame([("two", 2.0)], "collection_id string, boost double")
    got = search.federated(docs, Q.auto_phrase("math"), boosts).collect()
    assert [r["collection_id"] for r in got] == ["two", "one"] and got[0]["score"] == pytest.approx(2 * got[1]["score"])


def test_fields(docs):
    assert search.field_search(docs, "other doc1", "path").count() == 2
    with pytest.raises(Q.QueryError, match="not found"):
        search.field_search(docs, "x", "title")
    assert search.weighted_fields(docs, "hello", {"content": 1.0, "none": 2.0}).count() == 4


def test_enricher_order():
    class A(search.TermCollector):
        name, depends_on = "a", ("b",)

    class B(search.TermCollector):
        name, depends_on = "b", ()

    class C(search.TermCollector):
        name, depends_on = "b", ("a",)

    assert [e.name for e in search.in_order([A(), B()])] == ["b", "a"]
    with pytest.raises(Q.EnricherError):
        search.in_order([A(), C()])


GROUPS = [
    (Q.auto_phrase_groups, "hello", [["hello"]]),
    (Q.auto_phrase_groups, "hello world", [["hello", "world"]]),
    (Q.auto_phrase_groups, '"hello world"', [["hello", "world"]]),
    (Q.boolean_phrase_groups, "hello", [["hello"]]),
    (Q.boolean_phrase_groups, "hello AND world", [["hello"], ["world"]]),
    (Q.boolean_phrase_groups, '"machine learning" AND "signal processing"', [["machine", "learning"], ["signal", "processing"]]),
    (Q.boolean_phrase_groups, "hello world", [["hello", "world"]]),
    (Q.boolean_phrase_groups, "(hello OR world) -foo", [["hello"], ["world"], ["foo"]]),
]


@pytest.mark.parametrize("run,text,want", GROUPS)
def test_groups(run, text, want):
    groups, flat = run(text)
    assert groups == want and flat == [w for g in want for w in g]


def test_pages():
    assert [search.page_number(o, n) for o, n in ((0, 50), (50, 50), (99, 50), (10, 0))] == [1, 2, 2, 1]


def test_phrase_counts(spark):
    """Phrases that overlap themselves or follow each other closely count every place where they begin."""
    import random

    rnd = random.Random(8)
    texts = [" ".join(rnd.choices(["a", "b", "ab", "é"], k=rnd.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, f"/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, content string")
    for terms in (("a", "b"), ("a", "a"), ("a", "b", "a"), ("é", "ab"), ("b", "b", "b"), ("a", "b", "ab")):
        want = {i: sum(tuple(w[k : k + len(terms)]) == terms for k in range(len(w))) for i, t in enumerate(texts) for w in [t.split()]}
        got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", lower._tf(Q.Phrase(terms), T.tokens(F.col("content"))).alias("n")).collect()}
        assert got == want


@pytest.mark.parametrize("limit,offset,want", [(3, 0, [1, 2, 3]), (3, 2, [3, 4, 5])])
def test_ties_by_id(spark, limit, offset, want):
    """Hits of like score come by id, whatever their collections; federated ones by collection first."""
    docs = spark.createDataFrame([(i, f"/{i}", "alpha beta", f"c{9 - i}") for i in range(1, 7)], "doc_id long, path string, content string, collection_id string")
    request = search.SearchInput("alpha", limit=limit, offset=offset)
    pipe = search.SearchPipeline(search.ScanEngine(docs), [search.TermCollector(), search.Snippets(docs)])
    assert [r["doc_id"] for r in pipe.rich(request).collect()] == want
    assert [r["doc_id"] for r in pipe.response(request)["results"]] == want
    assert [r["doc_id"] for r in search.federated(docs, request.tree(), None, 3).collect()] == [6, 5, 4]


def test_vocabulary(spark):
    """Terms are summed where they are read: no positions and no rows of documents are exchanged."""
    df = lower.vocabulary(spark.createDataFrame([(1, "a b A"), (2, "b"), (3, ""), (4, None)], "doc_id long, content string"))
    plan = df._jdf.queryExecution().executedPlan().toString()  # before it has run, so each step stands in it once
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1, 2), ("b", 2, 2)]
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and "partial_sum" in plan
