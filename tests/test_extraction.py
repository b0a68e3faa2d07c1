"""PDF files, OCR by tools, images and frames."""

import hashlib
import io
import os
import random
import stat
import struct
import subprocess
import zlib

import numpy as np
import pytest

from lexivault.functions import text as T
from lexivault.operators import jobs as J
from lexivault.plans import query as Q
from lexivault.plans import search
from lexivault.sources import files, pages, pdf

FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def make(pages, compress=False, **page):
    """A small PDF: a page for each text (or content stream) at (50, 700), 12 points."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", None, FONT]
    kids = []
    for text in pages:
        raw = text if isinstance(text, bytes) else b"" if not text else b"BT /F1 %d Tf %d %d Td (" % (page.get("size", 12), page.get("x", 50), page.get("y", 700)) + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj ET"
        data, kind = (zlib.compress(raw), b"/Filter/FlateDecode") if compress else (raw, b"")
        objects.append(b"<</Length %d%s>>stream\n" % (len(data), kind) + data + b"\nendstream")
        extra = page.get("extra", b"")
        objects.append(b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (len(objects), extra))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>>>" % (b" ".join(kids), len(kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return out + b"trailer<</Root 1 0 R%s>>\n%%%%EOF" % page.get("trailer", b"")


CASES = [
    (["Pattern", "pattern", "PATTERN", ""], "Pattern pattern PATTERN"),
    (["support vector machine", "machine learning", "vector machine learning", ""], "support vector machine machine learning vector machine learning"),
    (["lorem ipsum dolor sit amet " * 300], ("lorem ipsum dolor sit amet " * 300).strip()),
    (["first flight field flip flop final"], "first flight field flip flop final"),
    (["naïve café résumé señor jalapeño über"], "naïve café résumé señor jalapeño über"),
    ([r"a (b) \\ c"], r"a (b) \\ c"),
]


@pytest.mark.parametrize("pages,text", CASES)
@pytest.mark.parametrize("compress", [False, True])
def test_generated_corpus(pages, text, compress):
    ocr, got = files.finalize(pdf.pdf(make(pages, compress)))
    assert (ocr, got.text, got.page_count) == (False, text, len(pages))
    assert [w[5] for w in got.words] == [w for w in files.re.findall(r"[^\W_]+", text)]


def test_boxes():
    one = pdf.pdf(make(["machine learning"])).words
    assert [w[5] for w in one] == ["machine", "learning"] and one[0][:3] == (1, 50.0, 83.0) and one[0][4] == 95.0
    assert one[0][3] < one[1][1] and one[0][3] - one[0][1] == pytest.approx(7 * 6)
    cropped = pdf.pdf(make(["machine"], extra=b"/CropBox[50 50 562 742]")).words[0]
    assert cropped[1:3] == (0.0, 33.0)
    # Lines, gaps and kerning.
    lines = pdf.pdf(make([b"BT /F1 10 Tf 14 TL 50 700 Td (one) Tj T* [(t) -20 (wo) -4000 (three)] TJ 0 -14 Td <666f7572> Tj ET"]))
    assert lines.text.split() == ["one", "two", "three", "four"] and "\n" in lines.text
    assert [w[0] for w in pdf.pdf(make(["a", "b"])).words] == [1, 2]


def test_unicode_map():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <65e5> endbfchar 1 beginbfrange <0002> <0003> <672c> endbfrange"
    data = make([b"BT /F2 12 Tf 50 700 Td <000100020003> Tj ET"], extra=b"/Resources<</Font<</F2 90 0 R>>>>")
    data = data.replace(b"trailer", b"90 0 obj<</Type/Font/Subtype/Type0/ToUnicode 91 0 R>> endobj\n91 0 obj<</Length %d>>stream\n" % len(cmap) + cmap + b"\nendstream endobj\ntrailer")
    assert pdf.pdf(data).text.strip() == "日本\u672d"


def test_object_streams():
    body = b"<</Type/Catalog/Pages 5 0 R>> <</Type/Pages/Kids[6 0 R]/Count 1>>"
    head = b"4 0 5 %d " % len(b"<</Type/Catalog/Pages 5 0 R>> ")
    packed = zlib.compress(head + body)
    stream = b"BT /F1 12 Tf 10 10 Td (inside) Tj ET"
    data = b"%%PDF-1.5\n1 0 obj<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(head), len(packed)) + packed
    data += b"\nendstream endobj\n6 0 obj<</Type/Page/Contents 7 0 R>> endobj\n7 0 obj<</Length %d>>stream\n" % len(stream) + stream + b"\nendstream endobj\n8 0 obj<</Type/XRef/Root 4 0 R/Length 0>>stream\n\nendstream endobj"
    assert pdf.pdf(data).text.strip() == "inside"


@pytest.mark.parametrize("bad", [b"", b"plain text", b"%PDF-1.4\xff\x00garbage", b"%PDF-1.4\n1 0 obj<</Type/Catalog>> endobj"])
def test_not_a_pdf(bad):
    with pytest.raises(pdf.PdfError, match="not a PDF"):
        pdf.pdf(bad)


def test_locked(tmp_path):
    """A locked buffer goes to OCR; a locked file is an error."""
    data = make(["secret"], trailer=b"/Encrypt 9 0 R")
    assert files.finalize(pdf.pdf(data)) == (True, files.Extracted("", 0, []))
    (tmp_path / "a.pdf").write_bytes(data)
    with pytest.raises(pdf.PdfError, match="password"):
        pdf.pdf_at(str(tmp_path / "a.pdf"))
    assert pdf.pdf_or_text(b"hello").text == "hello" and files.finalize(pdf.pdf(make([""])))[0]


@pytest.fixture()
def tools(tmp_path, monkeypatch):
    """Page and reading tools that say how they were called."""
    path = tmp_path / "bin"
    path.mkdir()

    def tool(name, body):
        f = path / name
        f.write_text("#!/bin/sh\n" + body)
        f.chmod(f.stat().st_mode | stat.S_IEXEC)

    files.tool_available.cache_clear()
    monkeypatch.setenv("PATH", f"{path}:/usr/bin:/bin")
    yield tool
    files.tool_available.cache_clear()


PAGE = "printf 'P5\\n4 2\\n255\\n\\000\\377\\000\\377\\000\\377\\000\\377'"


def test_ocr_by_tools(tools):
    with pytest.raises(RuntimeError, match="not installed"):
        files.ocr_pages(b"x")
    files.tool_available.cache_clear()
    tools("tesseract", "head -c 2 $1; echo; echo \" $4 $6 $OMP_THREAD_LIMIT \"\n")
    with pytest.raises(RuntimeError, match="renders"):
        files.ocr_pages(b"x")
    files.tool_available.cache_clear()
    tools("mutool", f"for i in 000001 000002; do {PAGE} > $(echo $9 | sed s/%06d/$i/); done\n")
    assert files.ocr_pages(b"x", "deu") == "P5\n deu 3 1\nP5\n deu 3 1"
    files.tool_available.cache_clear()
    tools("pdftoppm", f"{PAGE} > $5-1.pgm\n")
    assert files.ocr_pages(b"x") == "P5\n eng 3 1"
    assert files.page_count(b"x") == 1
    tools("pdfinfo", "echo 'Title: x'; echo 'Pages:   7'\n")
    assert files.page_count(b"x") == 1  # looked up once
    files.tool_available.cache_clear()
    assert files.page_count(b"x") == 7
    tools("tesseract", "exit 0\n")
    with pytest.raises(RuntimeError, match="no text"):
        files.ocr_pages(b"x")


def test_resize():
    gray = np.add.outer(np.arange(300), np.arange(200)).astype(np.uint8)
    assert files.preprocess(np.full((40, 30), 255, np.uint8)).shape == (40, 30)
    assert files.resize(np.full((90, 60), 77, np.uint8), 31, 20).tolist() == np.full((31, 20), 77).tolist()
    ramp = files.resize(np.tile(np.arange(0, 240, 2, dtype=np.uint8), (50, 1)), 25, 60)
    assert ramp.shape == (25, 60) and (np.abs(ramp[12, 3:-3].astype(int) - (np.arange(60)[3:-3] * 4 + 1)) <= 1).all()
    assert max(files.preprocess(gray, max_side=120).shape) == 120


def test_frames(tmp_path):
    two = files.frame(b"one") + files.frame(b"")
    stream = io.BytesIO(two)
    assert [files.read_frame(stream) for _ in range(3)] == [b"one", b"", None]
    for bad in (two[:3], two[:9], files.frame(b"one")[:-1] + b"x"):
        with pytest.raises(ValueError):
            files.read_frame(io.BytesIO(bad))
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    files.write_pgm(str(tmp_path / "a.pgm"), image)
    assert files.read_pgm(str(tmp_path / "a.pgm")).tolist() == image.tolist() and os.path.getsize(tmp_path / "a.pgm") > 6


def unpacked(data):
    """Pixels of a PNG without filters."""
    width, height = struct.unpack(">II", data[16:24])
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    assert (rows[:, 0] == 0).all()
    return rows[:, 1:].reshape(height, width, -1)


def test_pages(spark, tools):
    gray = np.full((20, 30), 200, np.uint8)
    assert (unpacked(pages.png(gray))[:, :, 0] == 200).all()
    marked = pages.highlighted(gray, [(2, 1, 5, 4), (3, 1, 6, 4)], 2.0)
    assert unpacked(pages.png(marked)).tolist() == marked.tolist()
    assert marked[3, 5].tolist() == marked[3, 11].tolist() == [222, 208, 120] and marked[0, 0].tolist() == marked[8, 5].tolist() == [200] * 3
    assert pages.highlighted(gray, [], 1.0, inverted=True)[0, 0].tolist() == [55] * 3
    assert pages.thumbnail(gray, 15).shape == (10, 15) and pages.thumbnail(gray, 60) is gray
    files.tool_available.cache_clear()
    tools("pdftoppm", f"case $(head -c 3 $4) in bad) exit 1;; esac; {PAGE} > $5-1.pgm; {PAGE} > $5-2.pgm\n")
    both = pages.page_images(b"%PDF")
    assert [x.shape for x in both] == [(2, 4)] * 2 and both[0].tolist() == [[0, 255, 0, 255]] * 2
    with pytest.raises(subprocess.CalledProcessError):
        pages.page_images(b"bad")
    # Workers of this session know no tools: an error for each file, never a failed job.
    found = spark.createDataFrame([("a", bytearray(b"%PDF")), ("b", None)], "path string, content binary")
    assert sorted((r["path"], r["page"], "installed" in r["error"]) for r in pages.render_pages(found).collect()) == [("a", 0, True), ("b", 0, True)]


def test_caches(tmp_path):
    made = []
    make = lambda k: lambda: made.append(k) or np.full((3, 4), k, np.uint8)
    cache = pages.Thumbnails(str(tmp_path / "t"), kept=2)
    for k in (1, 2, 1, 3, 2, 1):
        assert cache.get(f"p{k}", 7, make(k))[0, 0] == k
    assert made == [1, 2, 3] and len(cache.held) == 2  # dropped from memory, found in the folder
    assert cache.get("p1", 8, make(9))[0, 0] == 9 and cache.key("p", 1) == hashlib.sha256(b"p|1").hexdigest().upper()
    key = cache.key("p2", 7)
    old = tmp_path / "t" / f"{key}.thumb"
    data = old.read_bytes()
    assert data[:8] == b"PXT1\x02\0\0\0"
    for bad in (b"nothing", data[:4] + b"\x01" + data[5:], data[:-1]):
        old.write_bytes(bad)
        assert cache.load(key) is None and not old.exists()
    recent = pages.Recent(2)
    assert [recent.get(k, lambda k=k: made.append(k) or k) for k in "abacb"] == list("abacb") and made[-4:] == ["a", "b", "c", "b"]


def test_render_queue():
    q = pages.RenderQueue()
    for i in range(200):
        q.put(i, i)
    for i in range(20):
        q.put(i, -i, urgent=True)
    got = [q.take() for _ in range(16 + 128 + 1)]
    assert got[0] == (4, -4) and got[16] == (72, 72) and got[-2] == (199, 199) and got[-1] is None
    q.put(1, 1)
    q.cancel()
    q.put(2, 2)
    assert q.take() is None


def test_log_strings():
    assert [T.uptime(x) for x in (0, 59.9, 60, 3725)] == ["0s", "59s", "1m00s", "62m05s"]
    assert T.shares([3, 1]) == "[3/1]" and T.shares([]) == "[]"
    assert T.exit_code_name(-1073741819) == "exited(0xC0000005 ACCESS_VIOLATION (segfault))" and T.exit_code_name(9) == "exited(9)"
    assert T.exit_code_name(0xC0000999) == "exited(0xC0000999)"


def test_snippets():
    """Snippets against all stretches tried one by one, and read back as runs."""
    rnd = random.Random(3)
    for _ in range(200):
        text = " ".join(rnd.choice(["alpha", "beta", "x<y", "Gamma", "mu", "delta&"]) for _ in range(rnd.randrange(1, 60)))
        terms = rnd.sample(["alpha", "beta", "gamma", "y", "delta"], 3)
        snippet = search.snippet_of(text, terms, 50)
        runs = search.snippet_runs(snippet)
        said = "".join(t for t, _ in runs)
        assert said in text and len(said) <= 50 and all(t.lower() in terms for t, b in runs if b)
        hits = [(m.start(), m.end(), m[0].lower()) for m in Q._token.finditer(text) if m[0].lower() in terms]
        assert bool(hits) == bool(snippet)
        most = max((len({w for a, b, w in hits if a >= h[0] and b <= h[0] + 50}) for h in hits), default=0)
        first = next((h for h in hits if len({w for a, b, w in hits if a >= h[0] and b <= h[0] + 50}) == most), None)
        if first and first[0] - 20 <= 0 or first and first[1] <= max(0, first[0] - 20) + 50:
            assert any(b and t.lower() == first[2] for t, b in runs)


def test_rounds(spark):
    """Rounds over all files are the greedy shares of consecutive slices, the largest files first."""
    rows = [(i, (i * 7919) % 101) for i in range(333)]
    got = {}
    for r in J.rounds(spark.createDataFrame(rows, "id long, file_size long").repartition(5), 4, 5).collect():
        got.setdefault(r["round"], [[] for _ in range(4)])[r["worker"]].append(r["id"])
    ranked = sorted(rows, key=lambda x: (-x[1], x[0]))
    want = {k: J.balanced(ranked[20 * k : 20 * k + 20], 4, 5)[0] for k in range(17)}
    assert {k: [sorted(w) for w in v] for k, v in got.items()} == {k: [sorted(w) for w in v] for k, v in want.items()}


def test_polls(spark):
    found = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "id long, path string")
    assert sorted(r["id"] for r in J.distinct_polls(found, spark.createDataFrame([(3,)], "id long")).collect()) == [1, 2]
