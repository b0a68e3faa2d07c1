import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lexivault import schema
from lexivault.engine import Engine, Settings
from lexivault.operators import jobs as J
from lexivault.plans import query as Q
from lexivault.plans import search
from lexivault.plans.search import SearchInput
from lexivault.sources import files, pdf
from lexivault.sources.store import Store

FILES = {"multi_page.pdf": "machine learning\fdeep learning\f", "phrase_test.pdf": "machine learning is fun", "valid_words.pdf": "hello world foo bar baz qux", "subdir/nested.PDF": "nested file content", "truncated.pdf": b"%PDF-1.4\xff\x00", "empty.pdf": b"", "not.txt": "no"}


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "books"
    for name, content in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return root


def put(path, text, age=60):
    path.write_text(text)
    t = time.time() + age
    os.utime(path, (t, t))


def test_life_of_a_collection(spark, folder, tmp_path):
    told = []
    engine = Engine(spark, f"file://{tmp_path}/base", progress=lambda *x: told.append(x))
    one = engine.add_collection(f"file://{folder}", "Books")
    assert engine.add_collection(f"file://{folder}") == one
    out = engine.index(one)
    assert (out.changed, out.indexed, out.errors, out.orphans) == (6, 4, 2, 0) and told == [(0, 6), (6, 6)]
    assert '"matched_terms":["nested"]' in engine.pipeline(one).json_hits(SearchInput("nested")).first()["hit"]
    assert {r["path"].rsplit("/", 1)[1] for r in engine.problems(one).collect()} == {"truncated.pdf", "empty.pdf"}
    assert engine.search(one, "machine learning")["total_count"] == 2
    assert engine.search(one, "nested")["results"][0]["snippet"] == "<b>nested</b> file content"
    # Nothing changed: only the failed files are tried again.
    out = engine.index(one)
    assert (out.changed, out.indexed, out.errors) == (2, 0, 2)
    # A changed file replaces its words, a copy is a duplicate, a deleted file goes.
    put(folder / "valid_words.pdf", "goodbye moon")
    put(folder / "copy.pdf", "machine learning is fun")
    os.remove(folder / "multi_page.pdf")
    out = engine.index(one)
    assert (out.orphans, out.indexed) == (1, 1)
    assert engine.search(one, "hello")["total_count"] == 0 and engine.search(one, "goodbye moon")["total_count"] == 1
    assert engine.search(one, "machine learning")["total_count"] == 1
    assert engine.jobs(one).where("duplicate_of is not null").count() == 1
    doc = engine.documents(one).where(F.col("content").contains("fun")).first()["doc_id"]
    assert engine.term_offsets(one, doc, "learning") == [1] and engine.term_offsets(one, doc, "Learning") == []
    assert engine.term_positions(one, doc, ["machine", "learning"], [["machine", "learning"]]).count() == 2
    assert engine.position_count(one, doc) == 4
    assert engine.stats() == {"collections": 1, "documents": 3, "indexed_collections": 1}
    assert engine.collection_stats(one)["num_docs"] == 3 and engine.optimize(one)[1] == 1
    assert engine.search_all(SearchInput("fun"), {one: 2.0}).count() == 1 and engine.count(SearchInput("fun")) == 1
    engine.remove_collection(one)
    engine.remove_collection(99)
    with pytest.raises(KeyError):
        engine.get_collection(one)


def test_stream_restarts(spark, folder, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/base")
    one = engine.add_collection(f"file://{folder}")
    step = engine.ingest(one)
    go = lambda: step.stream(f"file://{folder}", f"file://{tmp_path}/state", 2).awaitTermination()
    go()
    assert engine.documents(one).count() >= 4
    n = engine.jobs(one).count()
    # A crash between the index and the jobs: the pointer of the jobs goes back, the next run repairs it.
    put(folder / "new.pdf", "brand new words", 120)
    store = step.store
    real, store.write = store.write, lambda table, *a, **k: (_ for _ in ()).throw(RuntimeError("crash")) if table == "jobs" and store.version("documents") > before else real(table, *a, **k)
    before = store.version("documents")
    with pytest.raises(Exception, match="crash"):
        go()
    store.write = real
    go()
    assert engine.search(one, "brand new words")["total_count"] == 1
    assert engine.jobs(one).count() == n + 1 and engine.jobs(one).where("status = 'extracting'").count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    shape = schema.LISTING
    assert store.read("t", shape).count() == 0 and store.version("t") == 0 and store.schema_version("t") is None
    row = lambda *r: spark.createDataFrame(list(r), shape)
    assert store.write("t", row(("a", 1, 1), ("b", 1, 1))) == 1 and store.schema_version("t") == schema.SCHEMA_VERSION
    old = store.read("t", shape)
    assert store.upsert("t", row(("b", 2, 2), ("c", 3, 3)), "path", shape) == 2
    assert sorted(map(tuple, store.read("t", shape).collect())) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]
    assert old.count() == 2  # readers keep their version
    assert store.delete_where("t", F.col("path") == "a", shape) == 1
    assert store.compact("t", shape, ("path",))[1] == 1


def test_store_keeps_old_state_on_a_crash(spark, tmp_path):
    """Whatever part of a write fails, the table stays as it was, and the next write goes on from there."""
    store = Store(spark, f"file://{tmp_path}/s")
    shape = schema.LISTING
    row = lambda *r: spark.createDataFrame(list(r), shape)
    store.write("t", row(("a", 1, 1)))
    for part in ("_segment", "_commit"):
        real = getattr(store, part)
        setattr(store, part, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.upsert("t", row(("a", 2, 2), ("b", 2, 2)), "path", shape)
        setattr(store, part, real)
        assert store.version("t") == 1 and [tuple(r) for r in store.read("t", shape).collect()] == [("a", 1, 1)]
    # A manifest that was never renamed is not read; two writers of one version: the second fails.
    (tmp_path / "s" / "t" / "manifest.new-x").write_text("half")
    other = Store(spark, store.base)
    assert store.upsert("t", row(("a", 3, 3)), "path", shape) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit("t", dict(other._manifest("t"), version=2))
    assert [tuple(r) for r in other.read("t", shape).collect()] == [("a", 3, 3)]


def test_store_segments(spark, tmp_path):
    """Many small writes make few segments and few files; rows live once; old versions go."""
    store = Store(spark, f"file://{tmp_path}/s")
    want = {}
    for k in range(12):
        rows = [(f"p{i}", k, i) for i in range(k, k + 5)]
        want |= {r[0]: r for r in rows}
        store.upsert("t", spark.createDataFrame(rows, schema.LISTING).coalesce(1), "path", schema.LISTING)
        if k % 4 == 3:
            gone = f"p{k}"
            want.pop(gone)
            store.delete("t", spark.createDataFrame([(gone,)], "path string"), "path", schema.LISTING)
        assert sorted(map(tuple, store.read("t", schema.LISTING).collect())) == sorted(want.values())
    state = store._manifest("t")
    assert len(state["segments"]) <= 6
    dirs = {p.name for p in (tmp_path / "s" / "t").iterdir() if p.is_dir()}
    used = set().union(*[{x["dir"] for x in m["segments"] + m["gone"]} for m in (store._manifest("t", v) for v in store._versions("t"))])
    assert len(store._versions("t")) == 3 and not dirs - used


def test_copy_takes_over(spark, folder, tmp_path):
    """When an original goes, or changes, its copy is extracted and found."""
    engine = Engine(spark, f"file://{tmp_path}/base")
    one = engine.add_collection(f"file://{folder}")
    for name in ("b1.pdf", "b2.pdf", "b3.pdf"):
        put(folder / name, "a very special sentence", 10)
    engine.index(one)
    found = lambda: [r["path"].rsplit("/", 1)[1] for r in engine.search(one, "very special sentence")["results"]]
    assert found() == ["b1.pdf"]
    os.remove(folder / "b1.pdf")
    engine.index(one)
    assert found() == ["b2.pdf"]
    put(folder / "b2.pdf", "something else", 99)
    engine.index(one)
    assert found() == ["b3.pdf"] and engine.search(one, "something else")["total_count"] == 1
    jobs = engine.jobs(one)
    assert jobs.where("status not in ('done', 'error') or duplicate_of is not null").count() == 0
    # The changed file goes back to what it was: as the smaller id it is the original again, and alone in the index.
    put(folder / "b2.pdf", "a very special sentence", 150)
    engine.index(one)
    assert found() == ["b2.pdf"] and engine.jobs(one).where("duplicate_of is not null").count() == 1


def test_batches_claims_and_cancel(spark, folder, tmp_path):
    """Files are taken in bounded batches, the largest first; a cancelled run leaves the rest to the next."""
    told, cancelled = [], []
    engine = Engine(spark, f"file://{tmp_path}/base", settings=Settings(files_per_batch=2))
    one = engine.add_collection(f"file://{folder}")

    def progress(done, total):
        told.append((done, total))
        if done == 2 and not cancelled:
            cancelled.append(engine.cancel(one))

    engine.progress = progress
    out = engine.index(one)
    assert out.indexed + out.errors == 2 and told == [(0, 6), (2, 6)]
    assert engine.jobs(one).where("status = 'pending'").count() == 4 and engine.jobs(one).where("status = 'extracting'").count() == 0
    told.clear()
    out = engine.index(one)
    assert told[-1][0] >= 4 and engine.documents(one).count() == 4
    assert engine.metrics.rows >= 6 and " files in 2 batches" in engine.metrics.summary()


def test_worker_that_dies(spark, tmp_path):
    """A file that kills its worker is in error by itself; the others are indexed."""
    root = tmp_path / "books"
    root.mkdir()
    for i in range(5):
        put(root / f"f{i}.pdf", f"text number {i}")

    def extractor(content):
        if b"3" in content:
            os._exit(9)
        return files.plain_text(content)

    engine = Engine(spark, f"file://{tmp_path}/base", extractor=extractor)
    one = engine.add_collection(f"file://{root}")
    out = engine.index(one)
    assert (out.indexed, out.errors) == (4, 1)
    bad = engine.problems(one).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in bad] == ["f3.pdf"] and bad[0]["error"].startswith("worker crashed")


def test_ocr_pass(spark, tmp_path):
    """Files without text are read by OCR, indexed, and given up after so many attempts."""
    root = tmp_path / "books"
    root.mkdir()
    put(root / "scan.pdf", "  \f ")
    put(root / "noise.pdf", " \f\f")
    put(root / "plain.pdf", "plain words")

    def ocr(content):
        if content.count(b"\f") > 1:
            raise RuntimeError("blurred")
        return "read by eye"

    engine = Engine(spark, f"file://{tmp_path}/base", ocr=ocr)
    one = engine.add_collection(f"file://{root}")
    engine.index(one, ocr=True)
    assert engine.search(one, "read by eye")["total_count"] == 1
    state = lambda: {r["path"].rsplit("/", 1)[1]: (r["ocr_attempts"], r["ocr_flag"], r["ocr_error"], r["failed_ocr"] is not None) for r in engine.jobs(one).collect()}
    assert state() == {"scan.pdf": (1, False, None, False), "noise.pdf": (1, True, "blurred", False), "plain.pdf": (0, False, None, False)}
    engine.index(one, ocr=True)
    engine.index(one, ocr=True)
    assert state()["noise.pdf"] == (2, True, "blurred", True)
    with pytest.raises(RuntimeError):
        Engine(spark, engine.base).index(one, ocr=True)


def test_several_collections(spark, folder, tmp_path):
    """Search over all from the index: own statistics and boosts; collections that are new or broken are left out."""
    said = []
    engine = Engine(spark, f"file://{tmp_path}/base", log=said.append)
    other = tmp_path / "other"
    other.mkdir()
    put(other / "x.pdf", "learning machine learning")
    one, two = engine.add_collection(f"file://{folder}"), engine.add_collection(f"file://{other}")
    three = engine.add_collection(f"file://{tmp_path}/nowhere")
    engine.index(one)
    engine.index(two)
    request = SearchInput("learning")
    scan = {(r["collection_id"], r["path"]): r["score"] for r in search.federated(engine.documents(), request.tree(), None).collect()}
    got = {(r["collection_id"], r["path"]): r["score"] for r in engine.search_all(request).collect()}
    assert got == pytest.approx(scan) and len(got) == 3
    best = engine.search_all(request, {two: 50.0}).first()
    assert best["collection_id"] == str(two) and best["score"] == pytest.approx(50 * got[str(two), best["path"]])
    assert engine.count(request) == 3 and engine.count(request, two) == 1 and engine.search_all(request, {three: 2.0}).count() == 3
    for p in (tmp_path / "base" / str(two) / "postings").glob("segment-*"):
        shutil.rmtree(p)
    assert engine.search_all(request).count() == 2 and any(f"collection {two} is left out" in x for x in said)
    engine.update_collection(one, label="Named", doc_count=7)
    assert engine.get_collection(one)["label"] == "Named" and engine.get_collection(one)["doc_count"] == 7
    with pytest.raises(KeyError):
        engine.update_collection(99, label="x")


def test_builders_settings_and_positions(spark, folder, tmp_path):
    class Shout(search.QueryBuilder):
        name = "shout"

        def build(self, text):
            return Q.Term(text.strip("!").lower())

    engine = Engine(spark, f"file://{tmp_path}/base", extractor=pdf.pdf_or_text)
    one = engine.add_collection(f"file://{folder}")
    from .test_extraction import make

    (folder / "real.pdf").write_bytes(make(["deep machine", "learning deep"]))
    engine.index(one)
    engine.register_builder(Shout())
    assert engine.search(one, SearchInput("NESTED!!", strategy="shout"))["total_count"] == 1
    assert engine.search_json(one, '{"query": "NESTED!", "strategy": "shout"}')["total_count"] == 1
    with pytest.raises(Q.UnknownStrategy):
        engine.search(one, SearchInput("x", strategy="nothing like that"))
    hit = engine.search(one, "deep machine")["results"][0]
    assert [(p["word_text"], p["page"]) for p in hit["positions"]] == [("deep", 1), ("machine", 1), ("deep", 2)]
    doc = hit["doc_id"]
    words = [r["word_text"] for r in engine.load_positions(one, doc).collect()]
    assert words == ["deep", "machine", "learning", "deep"] and engine.transform_flags(one, doc) == 1
    with pytest.raises(KeyError):
        engine.load_positions(one, 12345)
    assert engine.metrics.searches >= 3 and engine.metrics.latency_nanos() > 0
    assert search.KindBuilder("regex").build("a.*") == Q.Regex("a.*")
    engine.settings.snippet_width = 33
    engine.save_settings()
    again = Engine(spark, engine.base)
    assert again.load_settings().snippet_width == 33 and again.settings.ocr_language == "eng"
    assert Settings.from_json('{"snippet_width": 9, "unknown": 1}') == Settings(snippet_width=9)


def test_listing_of_odd_names(spark, tmp_path):
    root = tmp_path / "odd"
    root.mkdir()
    names = ["a b.pdf", "c+d.pdf", "e%20f.pdf", "g[1].PDF", "h{x}*.pdf", "empty one.pdf", "ü.pdf"]
    for n in names:
        put(root / n, "" if "empty" in n else f"text of {n}")
    listing = files.list_folder(spark, f"file://{root}")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in listing.collect()) == sorted(names)
    paths = [r["path"] for r in listing.collect()]
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]).decode() for r in files.contents(spark, paths, f"file://{root}").collect()}
    assert got == {n: "" if "empty" in n else f"text of {n}" for n in names}
    only = files.contents(spark, paths[:1], f"file://{root}")
    assert only.inputFiles() is not None and only.count() == 1
    os.remove(root / "ü.pdf")
    assert files.contents(spark, paths, f"file://{root}").where("content = x''").count() == 2


def test_missing_folder(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        files.list_folder(spark, f"file://{tmp_path}/none")


def test_ids_and_limits(spark):
    jobs = spark.createDataFrame([], schema.JOBS)
    found = spark.createDataFrame([(f"/{i}.pdf", 1, i) for i in range(50)], schema.LISTING)
    jobs = J.upsert_pending(jobs, found)
    assert sorted(r["id"] for r in jobs.collect()) == list(range(1, 51))
    assert [r["file_size"] for r in J.claim(jobs, 2).collect()] == [49, 48] and J.claim(jobs, -1).count() == 0


def test_balanced():
    shares, rest = J.balanced([(1, 100), (2, 80), (3, 60), (4, 40), (5, 20), (6, 10)], 4)
    assert not rest and sorted(map(len, shares)) == [1, 1, 2, 2]
    shares, rest = J.balanced([(i, 1) for i in range(70)], 2)
    assert [len(s) for s in shares] == [30, 30] and len(rest) == 10
    assert J.balanced([(1, 50), (2, 30), (3, 20)], 1) == ([[1, 2, 3]], [])
