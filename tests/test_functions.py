import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivault.functions import geometry as G
from lexivault.functions import text as T
from lexivault.operators import positions as P
from lexivault.operators import words as W
from lexivault.sources import files

NORMAL = [
    ("hello    world", "hello world"), ("a\tb\nc   d", "a b\nc d"), ("line1\n\n\nline2", "line1\n\n\nline2"), ("  hello world  ", "hello world"), ("", ""), ("   \t   \n   ", ""),
    ("ＰＤＦ", "PDF"), ("á", "á"), ("a b", "a b"), ("a b", "a b"), ("hello \U0001f600 world", "hello \U0001f600 world"), ("a\x00b\x01c", "a b c"), ("a\x0cb", "a b"), ("\n\n\n", ""), (" \n \n ", ""), ("\n\nhello\n\n", "hello"), ("line1 \t \n  line2", "line1\nline2"),
]


@pytest.mark.parametrize("text,want", NORMAL)
def test_normalize(text, want):
    assert T.normalize(text) == want


def test_tokens(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one(T.tokens, "E = mc^2, Straße!") == ["e", "=", "mc^2", "straße"]
    assert one(T.clean_word, "(Hello), World.") == "Hello World"
    assert one(T.is_token, "abc") and not one(T.is_token, "a b")
    assert one(T.page_count, "Title: x\nPages:   12\nSize: 1") == 12 and one(T.page_count, "none") == 1 and one(T.page_count, "Pages: 0") == 1
    assert one(T.strip_html, "<p>a<script>x</script>b &amp; c</p><!-- d -->") == "a b & c"
    assert [one(T.analyser_for, x) for x in ("ja", "cmn", "eng", "")] == ["ja", "zh", "multilang", "multilang"]
    assert one(T.file_name, "/a/b/c.pdf") == "c.pdf" and one(T.folder, "/a/b/c.pdf") == "/a/b"


def test_normalize_by_text(spark):
    """A batch of texts is normalised one by one: beyond the result's bytes, one text at a time is held."""
    rows = [(1, "a  b\u00e9 \U0001f600"), (2, None), (3, ""), (4, " \n ")]
    df = spark.createDataFrame(rows, "i long, t string").select("i", T.normalize_text("t").alias("n"), T.detect_language("t").alias("l"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a b\u00e9 \U0001f600", None), (2, None, None), (3, "", None), (4, "", None)]
    import tracemalloc

    texts = pa.array(["wörd \U0001f600 " * 800] * 2000 + [None])
    tracemalloc.start()
    try:
        got = T.normalize_text.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.null_count == 1 and got[0].as_py() == texts[0].as_py().strip() and peak < 1.5 * texts.nbytes
    assert T.normalize_text.func(pa.array([], pa.string())).to_pylist() == []


def test_language():
    assert T.language_of("The quick brown fox jumps over the lazy dog. This is a longer sentence that should be reliably detected.") == "eng"
    assert T.language_of("Hello") is None and T.language_of("") is None
    assert T.language_of("これは日本語の文章です。十分な長さがあるので、信頼性高く検出できるはずです。") == "jpn"


def page(spark, rotation=0, crop=False):
    c = (50.0, 742.0, 562.0, 50.0) if crop else (None,) * 4
    return spark.createDataFrame([(612.0, 792.0, rotation, *c)], "media_width double, media_height double, rotation int, crop_left double, crop_top double, crop_right double, crop_bottom double")


@pytest.mark.parametrize("turn,want", [(0, (100.0, 92.0)), (1, (700.0, 512.0)), (2, (512.0, 92.0 + 0)), (3, (92.0, 100.0))])
def test_rotation(spark, turn, want):
    x, y = G.stored_to_render(F.lit(100.0), F.lit(92.0))
    assert tuple(page(spark, turn).select(x.alias("x"), y.alias("y")).first()) == want


def test_geometry(spark):
    w, h = G.render_size()
    assert tuple(page(spark, 1).select(w, h).first()) == (792.0, 612.0)
    assert tuple(page(spark, 0, True).select(G.unrotated_width(), G.unrotated_height()).first()) == (512.0, 692.0)
    box = G.box_to_render(*[F.lit(v) for v in (100.0, 80.0, 200.0, 92.0)])
    assert tuple(page(spark, 1).select(*[b.alias(str(i)) for i, b in enumerate(box)]).first()) == (700.0, 412.0, 712.0, 512.0)


WORDS = [(1, 0, 1, 10.0, 20.0, "machine"), (1, 1, 1, 60.0, 20.0, "learning"), (1, 2, 1, 110.0, 20.0, "is"), (1, 3, 2, 10.0, 40.0, "learning"), (1, 4, 2, 60.0, 40.0, "machine"), (1, 5, 2, 110.0, 40.0, "cool"), (1, 6, 3, 10.0, 10.0, "machine"), (1, 7, 3, 60.0, 10.0, "learning")]


@pytest.fixture(scope="module")
def placed(spark):
    df = spark.createDataFrame(WORDS, "doc_id long, word_offset int, page int, x_min double, y_min double, word_text string")
    return df.withColumn("x_max", F.col("x_min") + 40).withColumn("y_max", F.col("y_min") + 10).cache()


def test_phrase_positions(placed):
    got = P.term_positions(placed, ["machine", "learning"], [["machine", "learning"]]).collect()
    assert [(r["page"], r["word_offset"]) for r in got] == [(1, 0), (1, 1), (3, 6), (3, 7)]
    assert P.term_positions(placed, [], [["x"]]).count() == 0
    assert P.term_positions(placed, ["COOL"], [["COOL"]]).count() == 1


def test_phrases_in_one_pass(spark):
    """All groups come from one read of the positions and one exchange of the groups' own terms; repeats, overlaps and
    pages count as in a plain search."""
    rng = np.random.default_rng(5)
    texts = {(d, p): list(rng.choice(["A", "a", "b", "c", "x"], 60)) for d in range(4) for p in (1, 2)}
    rows = [(d, p, (p - 1) * 60 + i, float(i), 0.0, float(i) + 1, 1.0, str(w)) for (d, p), t in texts.items() for i, w in enumerate(t)]
    rows += [(None, 1, 0, 0.0, 0.0, 1.0, 1.0, "a"), (None, 1, 1, 1.0, 0.0, 2.0, 1.0, "b"), (None, 1, 2, 2.0, 0.0, 3.0, 1.0, "c")]
    table = spark.createDataFrame(rows, "doc_id long, page int, word_offset int, x_min double, y_min double, x_max double, y_max double, word_text string")
    groups = [["a", "B", "a"], ["a", "a"], ["C"]]
    want = []
    for n, g in enumerate(groups):
        for (d, p), t in texts.items():
            at = [i for i in range(len(t) - len(g) + 1) if [w.lower() for w in t[i : i + len(g)]] == [w.lower() for w in g]]
            want += [(n, d, p, (p - 1) * 60 + i, j, (p - 1) * 60 + i + j, t[i + j]) for i in at for j in range(len(g))]
    want.append((2, None, 1, 2, 0, 2, "c"))
    found = P.occurrences(table, groups)
    got = [tuple(r) for r in found.select("group_no", "doc_id", "page", "start_offset", "j", "word_offset", "word_text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(*x[:6], str(x[6])) for x in want]))
    plan = P.term_positions(table, ["a"], groups)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1


def _scattered(i):
    """Pages and boxes that go back and forth, some in the same place or within the same hundredth."""
    x, y = ((i * 7919) % 11 / 8).astype(np.float32), ((i * 104729) % 5 + i % 3 * 0.001).astype(np.float32)
    return ((i * 31) % 4 + 1).astype(np.int32), x, y, x + np.float32(1), y + (i % 2).astype(np.float32)


@pytest.mark.parametrize("chunk", [1, 50, 1 << 16])
@pytest.mark.parametrize("layout", [P.grid_places, _scattered])
def test_boxes_of_documents(spark, monkeypatch, layout, chunk):
    """Documents in one row give the boxes that their words give as rows, without an exchange."""
    monkeypatch.setattr(P, "CHUNK", chunk)
    docs = spark.createDataFrame([(3, list("abc")), (1, [f"w{i}" for i in range(600)]), (2, []), (4, None), (5, [f"v{i}" for i in range(90)]), (None, ["x", "y"])], "doc_id long, words array<string>").coalesce(1)
    page, *box = layout(np.arange(600))
    places = spark.createDataFrame([(i, int(page[i]), *[float(v[i]) for v in box]) for i in range(600)], "word_offset int, page int, x_min float, y_min float, x_max float, y_max float")
    rows = docs.select("doc_id", F.posexplode("words").alias("word_offset", "word_text")).join(places, "word_offset")
    if layout is P.grid_places:
        assert sorted(map(repr, P.grid_boxes(rows).select(rows.columns).collect())) == sorted(map(repr, rows.collect()))
    for apart, want in ((P.starts, P.distinct_boxes(rows, ["word_offset"])), (P.edges, P.ui_boxes(rows))):
        got = P.document_boxes(docs, layout, apart)
        assert dict(got.dtypes) == dict(want.dtypes) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("Coalesce", "")
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    own = [(r["page"], r["word_offset"]) for r in P.document_boxes(docs, layout, P.edges).collect() if r["doc_id"] == 1]
    assert own == sorted(own)


def test_starts(placed):
    hits = placed.where(F.col("word_text").isin("machine", "learning"))
    got = {r["word_offset"]: r["is_start"] for r in P.phrase_starts(hits, 2).collect()}
    assert got == {0: True, 1: False, 3: True, 4: False, 6: True, 7: False}
    assert all(r["is_start"] for r in P.phrase_starts(hits, 1).collect())


def test_segments(spark):
    chars = [(1, 1, i, c, 10.0 * i + (30 if i > 3 else 0), 0.0, 10.0 * i + 9 + (30 if i > 3 else 0), 12.0) for i, c in enumerate("ab.cdef")] + [(1, 1, 7, "g", 0.0, 40.0, 9.0, 52.0)]
    seg = W.segment(spark.createDataFrame(chars, "doc_id long, page int, i int, ch string, left double, top double, right double, bottom double")).cache()
    got = sorted((r["word_id"], r["word_text"], r["x_min"], r["y_max"]) for r in W.words(seg).collect())
    assert got == [(1, "ab.c", 0.0, 12.0), (2, "def", 70.0, 12.0), (3, "g", 0.0, 52.0)]
    assert sorted(r["word_text"] for r in W.split_tokens(W.words(seg), seg).collect()) == ["ab", "c", "def", "g"]
    assert W.page_text(seg).first()["text"] == "ab.c def g"


def test_words_of_pages(spark):
    """Pages in one row give the words that their characters give as rows, whatever boxes and white space there are."""
    rng = np.random.default_rng(7)
    texts = ["", " \t\n", "word", "é🙂\u00a0x\u2003y\x00z \x1fq"] + ["".join(rng.choice(list("abé🙂 \n\t\r.\x1c"), n)) for n in (1, 60, 400)]
    table = np.cumsum(rng.choice([1.0, 7.0, 30.0], 400)), np.repeat(rng.choice([0.0, 5.0, 40.0], 20), 20), rng.choice([-3.0, 0.0, 7.0, 9.5], 400), rng.choice([0.0, 9.0, 12.1], 400)
    left, top = np.where(rng.random(400) < 0.1, np.nan, table[0]), np.where(rng.random(400) < 0.1, np.nan, table[1])
    right, bottom = np.where(rng.random(400) < 0.1, np.nan, table[0] + table[2]), np.where(rng.random(400) < 0.1, np.nan, table[1] + table[3])
    places = [[None if np.isnan(v) else float(v) for v in x] for x in (left, top, right, bottom)]
    pages = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)] + [(None, 0, "a b"), (2, 0, None)], "doc_id long, page int, text string")
    chars = [(k, n, i, c, *[x[i] for x in places]) for k, n, t in [(r["doc_id"], r["page"], r["text"] or "") for r in pages.collect()] for i, c in enumerate(t)]
    rows = spark.createDataFrame(chars, "doc_id long, page int, i int, ch string, left double, top double, right double, bottom double")
    want = W.words(W.segment(rows))
    got = W.page_words(pages, lambda i: (left[i], top[i], right[i], bottom[i]))
    order = lambda df: sorted(map(repr, df.select(want.columns).collect()))
    assert dict(got.dtypes) == dict(want.dtypes) and order(got) == order(want) and got.count() > 150


def test_lines(spark):
    rows = [(1, 1, 0, 10), (1, 1, 2, 12), (1, 1, 30, 40), (1, 1, 31, 42)]
    got = P.group_lines(spark.createDataFrame(rows, "doc_id long, page int, top int, bottom int")).collect()
    assert [(r["line"], r["top"], r["bottom"], r["n_words"]) for r in got] == [(0, 0, 12, 2), (1, 30, 42, 2)]


def test_lines_page_by_page(spark):
    """Lines found by looking at the open one are those found by looking at all; no Python call for every page."""
    rng = np.random.default_rng(3)
    rows = [(int(d), int(p), int(t), int(t + h)) for d, p, t, h in zip(rng.integers(0, 40, 4000), rng.integers(1, 4, 4000), rng.integers(-80, 400, 4000), rng.choice([-4, 0, 3, 12, 40], 4000))]
    rows += [(None, 1, 5, 9), (None, 1, 6, 9), (99, 1, 7, 19)]
    want, pages = [], {}
    for d, p, top, bottom in rows:
        pages.setdefault((d, p), []).append(((top + bottom) // 2, top, bottom))
    for key, boxes in pages.items():
        limit, found = -(-sorted(b - t for _, t, b in boxes)[len(boxes) // 2] // 2), []
        for c, top, bottom in sorted(boxes):
            near = next((x for x in found if abs(c - x[0] // x[1]) <= limit), None)
            if near:
                near[:] = [near[0] + c, near[1] + 1, min(near[2], top), max(near[3], bottom)]
            else:
                found.append([c, 1, top, bottom])
        want += [(*key, i, x[2], x[3], x[1]) for i, x in enumerate(found)]
    df = P.group_lines(spark.createDataFrame(rows, "doc_id long, page int, top int, bottom int"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_images():
    img = np.full((40, 40), 200, np.uint8)
    img[10:20] = 30
    assert 30 <= files.otsu(img) < 200
    assert files.skew(img < 100) == 0.0
    out = files.preprocess(np.kron(img, np.ones((4, 4), np.uint8)), max_side=80)
    assert out.shape == (80, 80) and set(np.unique(out)) == {0, 255} and (out[22:38] == 0).all()
