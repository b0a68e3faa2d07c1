"""Deduplication operators against their plain versions: real rows, hand-made edge cases, random texts, small parts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivault.llm import graph, hashing, jaccard_join, parts, queries, shared
from lexivault.llm.line_dedup import line_dedup
from lexivault.llm.substring_dedup import substring_dedup
from lexivault.llm.suffix_dedup import GRAM, SuffixIndex, suffix_dedup

from . import brute

SCHEMA = "source string, doc_id long, text string, id long, part int, body string, rest string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([("s", i, t, 7, 7, "x", None) for i, t in rows], SCHEMA)


def digest(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols, F.sha2("kept", 256)).collect())


def run1(spark, rows, **k):
    return digest(suffix_dedup(frame(spark, rows), **k), "doc_id", "n_bytes", "n_removed", "n_spans")


def run2(spark, rows, **k):
    return digest(line_dedup(frame(spark, rows), **k), "doc_id", "n_lines", "n_dropped")


def run3(spark, rows, **k):
    return sorted(tuple(r) for r in jaccard_join.jaccard_join(frame(spark, rows), **k).collect())


def run5(spark, rows, **k):
    return digest(substring_dedup(frame(spark, rows), **k), "doc_id", "n_words", "n_removed")


RUNS = [(run1, brute.op1), (run2, brute.op2), (run3, brute.op3), (run5, brute.op5)]


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["le", "Ünder", "onhe.", "thing", "a", "zz", "kappa", "ΩΩ"]) + str(rnd.randrange(40))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(80)]
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(0, 90)))) for i in range(40)]
    rows += [(i, f"Start {i}\n{passage}\n end {word()}\nSAME line here\t\n  same LINE here") for i in range(40, 60)]
    for i in range(60, 100):  # near copies
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(80)] = word()
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "   \n\t"), (103, "one two"), (104, "ONE  two"), (105, "é" * 70), (106, "é" * 70), (107, "a" * 300), (108, "b" + "a" * 120), (109, "Is onhe. " * 60), (110, "Is onhe. " * 50), (111, "\n\n\n"), (112, rows[45][1]), (113, rows[45][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("run,plain", RUNS)
@pytest.mark.parametrize("part_bytes", [2000, 4 << 20])
def test_corpus(spark, run, plain, part_bytes):
    rows = corpus()
    assert run(spark, rows, part_bytes=part_bytes) == sorted(plain(rows))


@pytest.mark.parametrize("run,plain", RUNS)
def test_empty_table(spark, run, plain):
    assert run(spark, []) == []


@pytest.mark.parametrize("run,plain", RUNS)
def test_repeated_rows(spark, run, plain):
    """Rows of one id never count against each other."""
    text = "the same text of more than fifty bytes, and more than thirteen words long, is here in all of these rows"
    rows = [(5, text), (5, text), (9, text), (9, text)]
    assert run(spark, rows) == sorted(plain(rows))


@pytest.mark.parametrize("run", [run1, run2, run5])
def test_null_id_is_last(spark, run):
    text = "the same text of more than fifty bytes, and more than thirteen words long, is here in all of these rows"
    got = {r[0]: r for r in run(spark, [(5, text), (6, "short")]) }
    rows = run_null(spark, run, text)
    assert rows[5] == got[5] and rows[None][2] > 0


def run_null(spark, run, text):
    f = {run1: suffix_dedup, run2: line_dedup, run5: substring_dedup}[run]
    cols = {run1: ("doc_id", "n_bytes", "n_removed", "n_spans"), run2: ("doc_id", "n_lines", "n_dropped"), run5: ("doc_id", "n_words", "n_removed")}[run]
    return {r[0]: tuple(r) for r in f(frame(spark, [(None, text), (5, text)])).select(*cols, F.sha2("kept", 256)).collect()}


def test_null_id_links(spark):
    text = "one two three four five six seven"
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.jaccard_join(frame(spark, [(None, text), (5, text), (6, None)])).collect()}
    assert got == {None: (3, 5), 5: (3, 5), 6: (0, 6)}


def test_long_texts(spark):
    rnd = random.Random(1)
    one = " ".join(str(rnd.randrange(10**6)) for _ in range(60_000))
    rows = [(1, one), (2, "x " + one[1000:300_000]), (3, "y" * 200_000)]
    assert run1(spark, rows) == sorted(brute.op1(rows))
    assert run5(spark, rows) == sorted(brute.op5(rows))


def test_many_runs_with_one_lead(spark):
    """100,000 documents share 24 bytes and no window of 50: none loses a byte, but a true copy of one does."""
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n: "".join(rnd.choices(letters, k=n))
    lead = lambda g: int(hashing.byte_windows(np.frombuffer(g.encode(), np.uint8), GRAM)[0])
    gram = min((some(GRAM) for _ in range(5000)), key=lead) + some(24 - GRAM)  # sampled in every window that holds it
    rows = [(i, some(26) + gram + some(26)) for i in range(100_000)]
    rows += [(100_000, rows[77][1]), (100_001, "-" + rows[500][1][5:])]
    got = suffix_dedup(frame(spark, rows), part_bytes=1 << 20).where("n_removed > 0").select("doc_id", "n_removed").collect()
    assert sorted(tuple(r) for r in got) == [(100_000, 76), (100_001, 71)]


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_ENTRIES", 2000)
    monkeypatch.setattr(graph, "PART_EDGES", 50)
    rows = corpus()
    assert run3(spark, rows, part_bytes=2000) == sorted(brute.op3(rows))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART_EDGES", 30)
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    forest = graph.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.find(x) for x in forest.up if forest.find(x) != x}
    assert dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()) == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(params=["tied", "regions", "both"])
def layout(request, monkeypatch):
    """Few ranges of ids, so that parts of one range tie; few coarse buckets, so that messages go by regions."""
    if request.param != "regions":
        monkeypatch.setattr(parts, "RANGES", 2)
    if request.param != "tied":
        monkeypatch.setattr(parts, "FAN", 3)
        monkeypatch.setattr(parts, "BUCKET_BYTES", 2000)


@pytest.mark.parametrize("run,plain", RUNS)
def test_layouts(spark, layout, run, plain):
    rows = corpus() + [(7, f"{k} the same id on very many rows, with words of its own and some shared by all of them {k % 5}") for k in range(300)]
    got = run(spark, rows, part_bytes=2000)
    if run is not run3:
        assert got == sorted(plain(rows))
    else:  # rows of one id are one node, whose sets all link
        assert {(i, c) for i, _, c in got} == {(i, c) for i, _, c in plain(rows)}


def test_many_documents_for_a_line(spark, monkeypatch):
    """A higher threshold counts documents, not rows, wherever the rows of an id are."""
    monkeypatch.setattr(parts, "RANGES", 2)
    rows = [(5, f"a line of two documents\nfiller {k} {'x' * 90}") for k in range(40)] + [(9, "a line of two documents")]
    rows += [(i, f"a line of three documents\nfiller {i} {'y' * 90}") for i in (11, 12, 13)]
    got = {}
    for r in line_dedup(frame(spark, rows), min_docs=3, part_bytes=1000).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_dropped"]
    assert got == {5: 0, 9: 0, 11: 0, 12: 1, 13: 1}
    with pytest.raises(ValueError):
        line_dedup(frame(spark, rows), min_docs=1)


def test_messages_grow_with_parts(spark, monkeypatch):
    """Up to FAN * FAN buckets, a part sends at most FAN messages and as many go on from regions; long documents split off."""
    monkeypatch.setattr(parts, "FAN", 12)
    monkeypatch.setattr(parts, "BUCKET_BYTES", 9000)  # within FAN * FAN buckets at the largest scale
    monkeypatch.setattr(parts, "RANGES", 16)
    messages = []
    for scale in (1, 4, 16):
        rnd = random.Random(scale)
        rows = [(i, " ".join(str(rnd.randrange(10**6)) for _ in range(150 if i % 16 else 1500))) for i in range(40 * scale)]
        dealt, layout = parts.deal(frame(spark, rows), part_bytes=8000)
        size = dealt.groupBy("part").agg(F.sum(F.octet_length("body")).alias("b"), F.max(F.octet_length("body")).alias("m")).collect()
        assert all(r["b"] <= 6 * 8000 + r["m"] for r in size)
        number = {r: i for i, r in enumerate(sorted(r["part"] for r in dealt.select("part").distinct().collect()))}
        keys = np.sort(np.random.default_rng(scale).integers(0, 1 << 63, 2000).astype(np.uint64)) * np.uint64(2)
        first = [parts.send(layout, p, keys) for p in number]
        regions = {}
        for p, t in zip(number, first):
            for i in range(len(t)):
                regions.setdefault((p // layout.fan, t["bucket"][i].as_py()), []).append(t.slice(i, 1))
        import pyarrow as pa

        fine = [parts._gather(layout)(pa.concat_tables(x)) for x in regions.values()] if layout.subs > 1 else []
        messages.append((sum(map(len, first)) + sum(map(len, fine))) / len(number))
        assert len(number) // 2 <= layout.coarse * layout.subs <= 12 * 12
    assert max(messages) <= 2 * 12 and len(number) > 100


def morse(n, a, b):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return [(a, b)[x] for x in out[:n]], [(b, a)[x] for x in out[:n]]


def test_regular_patterns_do_not_collide(spark):
    """Pairs that polynomials modulo 2**64 take for one, as bytes, as words, and as words of a window."""
    rows = []
    for k, n in enumerate((256, 1024, 4096)):
        x, y = morse(n, "a", "b")
        words_of = [f"w{i}" for i in range(12)]
        rows += [(4 * k, " ".join([*words_of, "".join(x)])), (4 * k + 1, " ".join([*words_of, "".join(y)]))]
        x, y = morse(n, f"left{k}", f"right{k}")
        rows += [(4 * k + 2, " ".join(x)), (4 * k + 3, " ".join(y))]
    for run, plain in RUNS:
        assert run(spark, rows) == sorted(plain(rows))
    for n in (13, 64, 1024, 2048):
        for a, b in ((97, 98), (0, 255)):
            x, y = (np.array(v, np.uint8) for v in morse(n, a, b))
            assert hashing.byte_windows(x, n)[0] != hashing.byte_windows(y, n)[0]
            assert hashing.windows(x.astype(np.uint64), n)[0] != hashing.windows(y.astype(np.uint64), n)[0]
            assert hashing.words(x + 48)[2][0] != hashing.words(y + 48)[2][0] or (x + 48 == y + 48).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.integers(1, 40))
def test_rabin_karp(numbers, length):
    """Windows have the values of their polynomials, in whole numbers."""
    own = [sum(x * pow(hashing.POINT, length - 1 - k, hashing.PRIME) for k, x in enumerate(numbers[i : i + length])) % hashing.PRIME for i in range(len(numbers) - length + 1)]
    assert hashing.rabin_karp(np.array(numbers, np.uint64), length).tolist() == hashing.mix(np.array(own, np.uint64)).tolist()
    x, y = (np.array(v, np.uint64) for v in morse(4096, 1, 2))
    assert hashing.rabin_karp(x, 4096)[0] != hashing.rabin_karp(y, 4096)[0]


def test_runs_that_differ_late(spark):
    """Documents of 50 bytes with the same 24 first bytes are not the same."""
    rows = [(1, "bkzijforzjwgisitokziforsjqzgusfekominbztqjxlxmjcqj"), (2, "bkzijforzjwgisitokziforsqiramqiudjskjcevnorchsteei")]
    assert [r[2] for r in run1(spark, rows)] == [0, 0]


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50), st.integers(0, 48))
def test_pack(numbers, low):
    keys = np.sort(np.array(numbers, np.uint64) >> np.uint64(low) << np.uint64(low))
    assert (parts.unpack(parts.pack(keys)) == keys).all()


starts = st.sampled_from(["the same beginning of 24!", "another one, as long: 24"])
tails = st.text("ab \n", max_size=90)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(starts, tails, tails).map(lambda x: x[1][:30] + x[0] + x[2]), min_size=2, max_size=6))
def test_run_windows(texts):
    """Runs hold every window of a document, and equal windows stand at one distance from equal leading bytes."""
    import pyarrow as pa

    p = parts.Part(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "part": pa.array([0] * len(texts), pa.int32()), "body": pa.array([t.encode() for t in texts], pa.binary()), "rest": pa.nulls(len(texts))}))
    from lexivault.llm.suffix_dedup import runs

    first, stop, doc, suffix, lead, full = runs(p.buf, p.starts, p.ends, 50)
    windows = [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49)]
    held = [(int(d), int(w - p.starts[d])) for a, z, d in zip(first, stop, doc) for w in range(a, z + 1)]
    assert held == windows
    raw, at = p.buf.tobytes(), {}
    for a, z, x, h, f in zip(first, stop, suffix, lead, full):
        for w in range(a, z + 1):
            assert at.setdefault(raw[w : w + 50], (x - w, h)) == (x - w, h)
        assert at.setdefault(("run", int(f)), raw[a : z + 50]) == raw[a : z + 50]


def test_index_family(spark, tmp_path):
    """Batches added one by one give what one run over all gives; levels stay few and in the byte order of suffixes."""
    rows = sorted((i, t) for i, t in corpus() if i not in (112, 113))
    rows += [(200 + i, t) for i, t in rows[40:60]] + [(300, "q" * 40 + rows[45][1][20:150])]
    want = {r[0]: r[1:] for r in run1(spark, rows)}
    index = SuffixIndex(spark, f"file://{tmp_path}/index")
    assert index.levels() == []
    for a in range(0, len(rows), 20):
        batch = rows[a : a + 20]
        got = {r[0]: r[1:] for r in digest(index.add(frame(spark, batch), part_bytes=2000), "doc_id", "n_bytes", "n_removed", "n_spans")}
        assert got == {i: want[i] for i, _ in batch}
        sizes = [n for _, n in index.levels()]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:]))
    for name, n in index.levels():
        own = [(bytes(r["suffix"]), bytes(r["before"])) for r in index.level(name).collect()]
        assert own == sorted(own) and len(own) == n
    # A batch that fails while it is taken in leaves the family as it was.
    before = index.levels()
    index._write = lambda rows: 1 / 0
    with pytest.raises(ZeroDivisionError):
        index.add(frame(spark, rows[:3]))
    assert SuffixIndex(spark, index.path).levels() == before
    assert digest(SuffixIndex(spark, index.path).add(frame(spark, [])), "doc_id") == []


def test_unlinked_chain(spark, monkeypatch):
    """Documents in one chain of shared shingles that never link cost rows in proportion to their number."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)
    per_doc = []
    for n in (400, 1600):
        say = lambda i: " ".join(f"p{i}x{j}" for j in range(12))
        rows = [(i, f"{say(i)} {say(i + 1)} {say(i + 2)}") for i in range(n)]
        sets = jaccard_join.jaccard_sets(frame(spark, rows))
        may = sets.where("entries is not null")
        tasks = jaccard_join.crossing(may.select("doc", "prefix"), may.select("doc", F.col("doc").alias("label"), "n"))
        per_doc.append(tasks.count() / n)
    assert per_doc[1] <= 1.2 * per_doc[0]
    got = run3(spark, rows)
    assert all(i == c for i, _, c in got)


def test_shared_folder(spark, tmp_path):
    base = f"file://{tmp_path}/f"
    assert shared.newest(spark, base, "x") is None
    for k in range(3):
        shared.replace(spark, base, "x", f"content {k}")
        assert shared.newest(spark, base, "x") == f"content {k}"


@pytest.mark.parametrize("name,plain", [("op1_suffix_dedup", brute.op1), ("op2_line_dedup", brute.op2), ("op3_jaccard_join", brute.op3), ("op5_substring_dedup", brute.op5)])
def test_query(spark, data, name, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, data).collect()) == sorted(plain(rows))
