"""Tokenising, language, chat, licences, decontamination and neighbours."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivault.llm import ann, bpe, chat, langid, queries
from lexivault.llm.align import align
from lexivault.llm.decontaminate import decontaminate
from lexivault.llm.licenses import LONG, REQUIRED, TEMPLATES, scan_licenses

from . import brute

RANKS, VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello  world\n\n  it's fine\x1c x y", "日本語 テスト 123٣", "é" * 300, "x" * 20_000, "don't DON'T\r\n\t!!", "🙂🙂 ok", "\u0085a᠎ b"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("batch_bytes", [50, 12 << 20])
def test_bpe(spark, plain, batch_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, batch long, ids binary")
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, batch_bytes=batch_bytes), RANKS).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    want = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key)


def test_bpe_few_buckets_and_columns(spark, plain, monkeypatch):
    """Many batches in one bucket; a column with the result's name; ids that no token has."""
    monkeypatch.setattr(bpe, "BUCKETS", 1)
    docs = spark.createDataFrame([(i, f"Word{i % 7} zebrawood{i % 11} 日本語{i} naïveté", "x") for i in range(60)], "doc_id long, text string, decoded string").repartition(5)
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, batch_bytes=100), RANKS)
    assert all(r["ids"] == plain.encode_ordinary(f"Word{r['doc_id'] % 7} zebrawood{r['doc_id'] % 11} 日本語{r['doc_id']} naïveté") for r in got.collect())
    top = len(plain.token_byte_values())
    odd = spark.createDataFrame([(1, [64, None, 65], "x"), (2, None, "x"), (3, [], "x"), (4, [10**9, 64, -5, top + 500], "x")], "doc_id long, ids array<int>, Decoded string")
    out = bpe.decode(odd, RANKS)
    assert out.columns == ["doc_id", "ids", "decoded"]
    one = plain.decode_single_token_bytes
    assert {r["doc_id"]: bytes(r["decoded"]) for r in out.collect()} == {1: one(64) + one(65), 2: b"", 3: b"", 4: one(64)}


def test_bpe_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_pattern_splits_like_the_library(plain):
    """Every code point, between letters and by itself, is cut as the library cuts it."""
    find = regex.compile(bpe.rust_pattern(public_tokenizers.PATTERN)).findall
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0xFEFF, 0x1D7D8, 0x1F600, 0xA0, 0x1680, 0x202F, 0x205F]
    text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in points)
    piece = [i for w in find(text) for i in plain._encode_single_piece(w.encode())]
    assert piece == plain.encode_ordinary(text)


def test_bpe_query(spark, data, plain):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows for ids in [plain.encode_ordinary(t or "")])
    assert sorted(tuple(r) for r in queries.QUERIES["op7_byte_bpe"](spark, data).collect()) == want


def test_language(spark, data):
    got = queries.QUERIES["op9_language_id"](spark, data).collect()
    lang = dict(tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect())
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, monkeypatch):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "", None), (5, "123 !!", "en"), (6, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pred = lambda m: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, m).collect()}
    got = pred(langid.train(docs))
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "en" and got[2][0] == "fr"
    assert all(v == ("und", 0.0) for v in pred(langid.train(docs.where("false"))).values())
    assert langid.predict(docs.where("false"), langid.train(docs)).count() == 0
    # Slices of a long text give the same counts as the whole.
    long = spark.createDataFrame([("the cat sat on the mat " * 300, "en"), ("le chat est sur la table " * 300, "fr")], "text string, lang string")
    whole = langid.train(long)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert np.allclose(langid.train(long)[2], whole[2])


def test_language_is_plain_bayes(spark, data, monkeypatch):
    """Languages and posteriors of short texts equal those of a plain naive Bayes; blocks of languages change nothing."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 1200").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    known = [(x, t) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    ask = [(i, " ".join((t or "").split()[:3])) for i, t, _ in rows][:60]
    asked = spark.createDataFrame([(*r, 5, "x", None) for r in ask], "doc_id long, text string, score int, LANG_PRED string, fit string")
    want = dict(zip([i for i, _ in ask], brute.bayes(known, [t for _, t in ask], langid.BUCKETS)))
    monkeypatch.setattr(langid, "LANGS", 3)
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    out = langid.predict(asked, model, fit_col="fit")
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "fit"]
    for r in out.collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-3)
    with monkeypatch.context() as m, pytest.raises(ValueError):
        m.setattr(langid, "MAX_LANGS", 2)
        langid.train(docs)


def test_language_fit(spark, data):
    """Texts of the languages fit much better than chance, noise and other scripts hardly or worse."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs.select("lang", "text"))
    assert langid.predict(docs, model, fit_col="fit").where("fit < 2 or fit is null").count() == 0
    odd = ["".join(chr(33 + (i * i * 7919 + i * 31) % 90) for i in range(300)), "это русский текст о погоде и природе", "日本語の文章です"]
    assert [r["fit"] < 1 for r in langid.predict(spark.createDataFrame([(t,) for t in odd], "text string"), model, fit_col="fit").collect()] == [True] * 3
    # Numbers are of no language: they neither help nor harm.
    text = docs.where("length(text) > 500").first()["text"]
    both = spark.createDataFrame([(text,), (text + " 4397110767823743 20.118.157.107" * 50,)], "text string")
    a, b = (r["fit"] for r in langid.predict(both, model, fit_col="fit").collect())
    assert b > 2 and b > a - 2.5


def test_chat(spark, data):
    got = {r["conv_id"]: r for r in queries.QUERIES["op10_chat_format"](spark, data).collect()}
    rows = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    trick = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", trick), (1, "assistant", trick)]
    assert set(got) == set(rows)
    for conv, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[conv])[1:5] == (len(turns), sha(said), len(loss), sha(loss))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op10_chat_format"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.values())


def test_chat_edges(spark):
    rows = [(1, None, "assistant", None), (1, 2, None, "b"), (1, 1, "assistant", "é🙂<|end|>"), (1, 1, "assistant", "é🙂<|end|>"), (None, 0, "assistant", "  \n x"), (2, 0, "user", ""), (3, 0, "ro\nle", "y" * 5000)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, ids int, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, VOCAB)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant", ""), ("assistant", "é🙂<|end|>"), ("assistant", "é🙂<|end|>"), ("", "b")]
    assert got[1]["loss_text"] == "é🙂<|end|>" * 2 and got[None]["loss_text"] == "  \n x" and got[2]["loss_text"] == ""
    assert got[3]["turns"][0]["role"] == "ro\nle"
    assert chat.format_conversations(df.where("false"), VOCAB).count() == 0


control = st.sampled_from([*chat.CONTROLS, "\\", "<", "<\\|start|>", "[\\/INST]", "a", " ", "\n", "é", "<|", "|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(control, max_size=4).map("".join), st.lists(control, max_size=8).map("".join)), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns, turns[0][0])
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == turns[0][0])
    ids, loss = chat.mask(text, spans, VOCAB)
    raw = text.encode()
    assert b"".join(raw[a:b] for _, a, b in loss).decode() == "".join(text[a:b] for a, b in spans)


def test_align():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    b = np.array([9, 1, 2, 8, 4, 5, 9], np.uint64)
    assert align(a, b) == (7, 4, 0, 5, 1, 6) and align(a, b, 1, 2) == (7, 4, 0, 5, 1, 6)
    assert align(a, np.array([7, 7], np.uint64))[0] == 0


ITEM = "in the beginning the clever fox jumped over seven lazy dogs and ran to the distant hills without a sound"
EDITED = "before that in the beginning a clever fox leaped over seven lazy dogs and then ran to distant hills without any sound at all"


def test_leaks(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    rows = [(1, f"{filler} {ITEM.upper()} {filler}", "x"), (2, EDITED, "x"), (3, filler, "x"), (4, None, "x"), (5, "", "x"), (6, "the fox ran to the hills", "x"), (None, ITEM, "x"), (1, ITEM, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (10, ITEM)], "item_id long, text string")
    got = decontaminate(docs, items).collect()
    hits = sorted((str(r["doc_id"]), sorted({h["item_id"] for h in r["hits"]}), bool(r["hits"])) for r in got)
    assert hits == [("1", [10], True), ("1", [10], True), ("2", [10], True), ("3", [], False), ("4", [], False), ("5", [], False), ("6", [], False), ("None", [10], True)]
    span = next(r["hits"][0] for r in got if r["doc_id"] == 1 and len(r["text"]) > 1000)
    assert (span["start_word"], span["end_word"], span["score"]) == (500, 520, 1.0)
    assert decontaminate(docs, items.where("false")).where("size(hits) > 0").count() == 0
    assert decontaminate(docs.where("false"), items).count() == 0


def test_long_and_short_items(spark):
    """A long stretch of a longer item counts, as does one copy of an item that is a single seed."""
    item = [f"v{i}" for i in range(400)]
    edited = [w if i % 10 else "other" for i, w in enumerate(item[100:180])]
    sparse = [w if i % 2 else f"z{i}" for i, w in enumerate(item[100:180])]
    filler = " ".join(f"w{i}" for i in range(200))
    say = lambda w: f"{filler} {' '.join(w)} {filler}"
    rows = [(1, say(item[100:250])), (2, say(item[100:120])), (3, say(edited)), (4, say(sparse)), (5, say(["alpha", "Beta", "gamma"])), (6, say(["alpha", "beta"]))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "alpha beta gamma")], "item_id long, text string")
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    hits = {r["doc_id"]: [(h["item_id"], h["score"], h["start_word"], h["end_word"]) for h in r["hits"]] for r in got}
    assert hits[1] == [(1, 0.375, 200, 350)] and [h[0] for h in hits[3]] == [1]
    assert hits[2] == hits[4] == hits[6] == [] and hits[5] == [(2, 1.0, 200, 203)]


def test_leaks_in_blocks(spark, monkeypatch):
    from lexivault.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK_ITEMS", 2)
    texts = [f"item {k} says " + " ".join(f"v{k}x{j}" for j in range(20)) for k in range(5)]
    docs = spark.createDataFrame([(1, " and ".join(texts))], "doc_id long, text string")
    got = decontaminate(docs, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).first()
    assert sorted(h["item_id"] for h in got["hits"]) == [0, 1, 2, 3, 4]


def test_leak_query(spark, data):
    """Each document that holds an item as it is must be found; found ones share most of the item's words."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.QUERIES["op4_decontaminate"](spark, data).collect()}
    flat = lambda t: " ".join(regex.findall(r"[\w\P{ASCII}]+", (t or "").lower()))
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {flat(x)} " in f" {flat(t)} "}
    assert want <= set(got) and len(want) > 0 and all(s >= 0.45 for s in got.values())


def test_leaks_are_all_alignments(spark, data):
    """Scores of all documents with all items, by plain alignment of whole texts: the same pairs, the same best scores."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    words = [brute.fold(t) for _, t in items]
    want = {}
    for d, text in docs:
        for (i, _), w, (score, _) in zip(items, words, brute.smith_waterman(words, brute.fold(text))):
            if score >= 0.45 * 2 * len(w):
                want[d, i] = score / (2 * len(w))
    got = {}
    for r in queries.QUERIES["op4_decontaminate"](spark, data).collect():
        got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), 0), r["score"])
    assert got == pytest.approx(want) and len(want) > 0


def test_leaks_everywhere(spark):
    """Every copy in a text is reported; characters of scripts without spaces are words; names and repeated items clash with nothing."""
    filler = " ".join(f"w{i}" for i in range(300))
    han = "今天天气很好我们一起去公园散步然后回家吃饭看书"
    rows = [(1, f"{ITEM} {filler} {EDITED} {filler} {ITEM}", [7]), (2, f"前面的话{han[:10]}真{han[11:]}后面的话", None), (3, han[:4], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits array<int>")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, han), (12, ITEM + " x")], "item_id long, text string")
    out = decontaminate(docs, items)
    assert out.columns == ["doc_id", "text", "hits"]
    got = {r["doc_id"]: [(h["item_id"], h["start_word"]) for h in r["hits"]] for r in out.collect()}
    assert [x for x in got[1] if x[0] == 10] == [(10, 0), (10, 322), (10, 645)] or len([x for x in got[1] if x[0] == 10]) == 3
    assert [i for i, _ in got[2]] == [11] and got[3] == []


def test_shared_prompt(spark):
    """Items that all begin with one prompt: the prompt alone is no copy of any, a whole item is."""
    prompt = " ".join(f"prompt{i}" for i in range(6))
    items = [(i, f"{prompt} " + " ".join(f"q{i}x{j}" for j in range(14))) for i in range(300)]
    docs = [(1, f"{prompt} and something else " * 50), (2, "before " + items[123][1] + " after")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in got.collect()} == {1: [], 2: [123]}


def test_licenses_are_all_alignments(spark, data):
    """Documents with a short notice, by plain alignment of whole texts with every short template."""
    short = {n: brute.fold(t) for n, t in TEMPLATES.items() if len(brute.fold(t)) < LONG}
    names = sorted(short)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for d, text in docs:
        words = brute.fold(text)
        said = f" {' '.join(words)} "
        for n, (_, matched) in zip(names, brute.smith_waterman([short[n] for n in names], words)):
            if matched >= 0.7 * len(short[n]) and all(f" {' '.join(brute.fold(x))} " in said for x in REQUIRED.get(n, [])):
                want.add(d)
    assert {r["doc_id"] for r in queries.QUERIES["op8_license_scan"](spark, data).collect()} == want and want


def test_licenses(spark, data):
    rows = [(1, f"x y z {TEMPLATES['mit']} a b"), (2, None), (3, ""), (4, "Released under the MIT Licence, maybe"), (5, "nothing here"), (None, TEMPLATES["mit-statement"] * 2)]
    got = scan_licenses(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license string")).collect()
    by = sorted((str(r["doc_id"]), r["license"], round(r["coverage"], 2)) for r in got)
    assert by == [("1", "mit", 1.0), ("4", "mit-statement", 0.8), ("None", "mit-statement", 1.0), ("None", "mit-statement", 1.0)]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["start_word"] == 3
    with pytest.raises(ValueError):
        scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {"x": "two words"})
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r["doc_id"] for r in queries.QUERIES["op8_license_scan"](spark, data).collect()}
    assert found == {r["doc_id"] for r in docs.where(F.col("text").rlike("Licensed under (CC BY-NC 4.0|the Apache License)|Released under the MIT License|licensed under the GNU General")).collect()}


def test_license_templates(spark):
    """A planted copy of every template is found by its name, once; like lines of other versions get no wrong name."""
    names = sorted(TEMPLATES)
    rows = [(i, f"q1 q2 q3 {TEMPLATES[n]} q4 q5") for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(names[r["doc_id"]], []).append((r["license"], round(r["coverage"], 3)))
    assert {n: x for n, x in got.items() if x != [(n, 1.0)]} == {} and len(got) == len(names)
    lines = {
        "Licensed under CC BY-SA 4.0": ["cc-by-sa-4.0-statement"],
        "Licensed under the GNU General Public License, version 2": ["gpl-2.0-line"],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-statement"],
        "Licensed under the Apache License, Version 1.1.": [],
        "Released under the Foo License.": [],
        "SPDX-License-Identifier: Foo-1.0": [],
        f"{TEMPLATES['gpl-2.0']} {TEMPLATES['mit']} {TEMPLATES['gpl-2.0']}": ["gpl-2.0", "mit", "gpl-2.0"],
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = scan_licenses(docs).orderBy("start_word").collect()
    assert {t: [r["license"] for r in found if r["doc_id"] == i] for i, t in enumerate(lines)} == lines


def test_neighbours(spark, data):
    got = queries.QUERIES["op6_nearest"](spark, data).collect()
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12 for r in own)
        hits += len(set(ids[best]) & {r["vec_id"] for r in own})
        total += 10
    assert hits >= 0.95 * total


def test_neighbours_verify_few(spark):
    """On the larger table the stopping test leaves at most 30 % of the rows to verify, at a recall of 0.95 or more."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(rows, rows.where("vec_id % 100 = 0")).toPandas()
    e = rows.toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    hits = 0
    for q, own in got.groupby("query_id"):
        d = ((v - v[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(own["vec_id"]))
    assert hits >= 0.95 * len(got) and len(got) == 10 * sum(ids % 100 == 0)
    assert got.groupby("query_id")["verified"].first().sum() <= 0.3 * len(ids) * sum(ids % 100 == 0)


def test_neighbour_edges(spark):
    rnd = np.random.default_rng(1)
    v = rnd.standard_normal((3000, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3000 + i, v[0].tolist()) for i in range(30)]
    rows += [(4000, None), (4100, [0.0] * 16), (4200, [float("nan")] * 16), (4300, [1.0, 2.0]), (4400, [None] * 16), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), k=10)
    own = [r["vec_id"] for r in got.where("query_id = 0").orderBy("rank").collect()]
    assert own == list(range(3000, 3010))  # ties to the smaller id
    assert {r["query_id"] for r in got.collect()} == set(range(0, 3100, 100))
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few, k=10).count() == 12
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0
    assert ann.chi_square(ann.quantile(0.99, 8), 8) == pytest.approx(0.99)
