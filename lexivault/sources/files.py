"""Listing of folders and extraction of texts and word boxes."""

from __future__ import annotations

import functools
import glob
import os
import re
import shutil
import struct
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def list_folder(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, file_modified, file_size) of all files below a folder with a suffix, whatever its case; empty files too.

    The paths may be anywhere that Spark reads. Spark lists the folder (in tasks, if it is large). Its reader leaves out
    empty files; only if there are any, the names of its listing are gone through, and the empty files looked up.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise NotADirectoryError(folder)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    full = found.select(F.col("path"), F.unix_timestamp("modificationTime").alias("file_modified"), F.col("length").alias("file_size"))
    rows = full.where(F.lower("path").endswith(suffix))
    names, known = found._jdf.inputFiles(), []
    if len(names) != full.count():  # some are empty; their names, as Spark's own listing has them
        plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), ":/+", ":/")
        listed = spark.createDataFrame([(names[i],) for i in range(len(names)) if names[i].lower().endswith(suffix)], "path string").select(plain.alias("path"))
        for r in listed.join(rows.select(F.regexp_replace("path", ":/+", ":/").alias("path")), "path", "left_anti").collect():
            status = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(r["path"]))
            known.append((status.getPath().toString(), status.getModificationTime() // 1000, 0))
    rows = rows.unionByName(spark.createDataFrame(known, schema.LISTING)) if known else rows
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.LISTING])


@dataclass
class Extracted:
    """What an extractor makes of one file; words are (page, x_min, y_min, x_max, y_max, text)."""

    text: str = ""
    page_count: int = 1
    words: list[tuple] = field(default_factory=list)


Extractor = Callable[[bytes], Extracted]


def plain_text(content: bytes) -> Extracted:
    """Plain UTF-8 text with form feeds between pages; anything else is refused."""
    text = content.decode("utf-8")
    if not content or "\x00" in text:
        raise ValueError("not a text file")
    return Extracted(text, text.count("\f") + 1)


def finalize(found: Extracted) -> tuple[bool, Extracted]:
    """Blank texts are flagged for OCR and lose their words; other texts are trimmed at the end."""
    if not found.text.strip():
        return True, Extracted("", found.page_count, [])
    return False, Extracted(found.text.rstrip(), found.page_count, found.words)


def extract(files: DataFrame, extractor: Extractor = plain_text) -> DataFrame:
    """Files (path, content) through an extractor; a file that fails gives a row with an error, never a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content or b"")
                try:
                    ocr, got = finalize(extractor(content))
                    words = [dict(zip(("page", "x_min", "y_min", "x_max", "y_max", "word_text"), w)) for w in got.words]
                    rows.append((path, hashlib.sha256(content).hexdigest(), ocr, got.text, got.page_count, None, words))
                except Exception as e:  # noqa: BLE001  whatever a bad file does
                    rows.append((path, None, False, None, 0, str(e) or type(e).__name__, []))
            yield pd.DataFrame(rows, columns=schema.EXTRACTED.names)

    return files.select("path", "content").mapInPandas(run, schema.EXTRACTED)


_glob = re.compile(r"([\[\]{}*?\\])")


def contents(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """(path, content) of a bounded number of listed files: only these are opened; empty ones have empty content.

    A file that has gone since it was listed has empty content too, which no extractor takes.
    """
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    source = spark.read.format("binaryFile")
    try:
        found = source.load([_glob.sub(r"\\\1", p) for p in paths]).select("path", "content") if paths else None
    except AnalysisException:  # one of them has gone: the folder as it is now
        found = source.option("recursiveFileLookup", True).load(folder).select("path", "content")
    if found is None:
        return wanted.withColumn("content", F.lit(b""))
    return wanted.join(found, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


@functools.lru_cache
def tool_available(name: str) -> bool:
    """Whether a program is on the path; looked up once a process."""
    return shutil.which(name) is not None


def page_count(content: bytes) -> int:
    """Pages that the page tool names; 1 where it is not installed or names none."""
    if not tool_available("pdfinfo"):
        return 1
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        got = subprocess.run(["pdfinfo", f.name], capture_output=True, timeout=60)
    m = re.search(r"(?m)^Pages:\s+(\d+)\s*$", got.stdout.decode("utf-8", "replace"))
    return max(1, int(m[1])) if m else 1


def render(content: bytes, folder: str, dpi: int = 300) -> list[str]:
    """Grey images of all pages in order, by the first page tool that is installed."""
    source = f"{folder}/in.pdf"
    with open(source, "wb") as f:
        f.write(content)
    if tool_available("pdftoppm"):
        subprocess.run(["pdftoppm", "-r", str(dpi), "-gray", source, f"{folder}/p"], check=True, timeout=600)
    elif tool_available("mutool"):
        subprocess.run(["mutool", "draw", "-r", str(dpi), "-c", "gray", "-F", "pgm", "-o", f"{folder}/p%06d.pgm", source], check=True, timeout=600)
    else:
        raise RuntimeError("no tool that renders pages is installed")
    return sorted(glob.glob(f"{folder}/p*.pgm"))


def read_pgm(path: str) -> np.ndarray:
    """A binary grey image."""
    with open(path, "rb") as f:
        data = f.read()
    m = re.match(rb"P5(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not m or int(m[3]) > 255:
        raise ValueError("not a grey image")
    w, h = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w)


def write_pgm(path: str, gray: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + np.ascontiguousarray(gray, np.uint8).tobytes())


def otsu(gray: np.ndarray) -> int:
    """Threshold with the largest variance between the classes of a grey image."""
    counts = np.bincount(gray.reshape(-1), minlength=256).astype(float)
    weight, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    other = total - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * other * (mass / weight - (mass[-1] - mass) / other) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(dark: np.ndarray, limit: float = 5.0, step: float = 0.5) -> float:
    """Angle (degrees) at which the row sums of a black-and-white image vary most."""
    y, x = np.nonzero(dark)
    pad = int(dark.shape[1] * np.tan(np.radians(limit))) + 1  # sums of all rows, empty ones too
    best = (-1.0, 0.0, 0.0)  # variance, smaller angles first, angle
    for angle in np.arange(-limit, limit + step / 2, step):
        row = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        spread = float(np.bincount(row + pad, minlength=dark.shape[0] + 2 * pad).var())
        best = max(best, (spread, -abs(float(angle)), float(angle)))
    return best[2]


def _lanczos(size: int, new: int, lobes: int = 3) -> np.ndarray:
    """Weights (new x size) of a Lanczos filter that scales a row of pixels."""
    step = size / new
    wide = max(step, 1.0)
    at = (np.arange(new)[:, None] + 0.5) * step - 0.5
    x = (np.arange(size)[None, :] - at) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
    return w / w.sum(1, keepdims=True)


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image of another size, by Lanczos filters along both sides."""
    out = _lanczos(gray.shape[0], height) @ gray.astype(float) @ _lanczos(gray.shape[1], width).T
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def preprocess(gray: np.ndarray, max_side: int = 3000, min_angle: float = 0.5) -> np.ndarray:
    """A grey page ready for OCR: at most max_side pixels long, straightened if it is askew, black and white."""
    if max(gray.shape) > max_side:
        share = max_side / max(gray.shape)
        gray = resize(gray, max(1, round(gray.shape[0] * share)), max(1, round(gray.shape[1] * share)))
    angle = skew(gray <= otsu(gray))
    if abs(angle) > min_angle:
        t = np.radians(angle)
        y, x = np.indices(gray.shape)
        cy, cx = (gray.shape[0] - 1) / 2, (gray.shape[1] - 1) / 2
        sy = np.round((y - cy) * np.cos(t) + (x - cx) * np.sin(t) + cy).astype(int)
        sx = np.round((x - cx) * np.cos(t) - (y - cy) * np.sin(t) + cx).astype(int)
        inside = (sy >= 0) & (sy < gray.shape[0]) & (sx >= 0) & (sx < gray.shape[1])
        gray = np.where(inside, gray[np.clip(sy, 0, gray.shape[0] - 1), np.clip(sx, 0, gray.shape[1] - 1)], 255).astype(np.uint8)
    return np.where(gray <= otsu(gray), 0, 255).astype(np.uint8)


def ocr_pages(content: bytes, language: str = "eng", dpi: int = 300, workers: int = 2) -> str:
    """Text of all pages by external tools, pages joined by newlines; an error if none has text.

    Pages are rendered, made ready (``preprocess``) and read, some at a time.
    """
    if not tool_available("tesseract"):
        raise RuntimeError("OCR tools are not installed")

    def read(page: str) -> str:
        write_pgm(page, preprocess(read_pgm(page)))
        got = subprocess.run(["tesseract", page, "-", "-l", language, "--psm", "3"], capture_output=True, timeout=600, env={**os.environ, "OMP_THREAD_LIMIT": "1"})
        return got.stdout.decode("utf-8", "replace").strip() if got.returncode == 0 else ""

    with tempfile.TemporaryDirectory() as folder, ThreadPoolExecutor(workers) as pool:
        texts = [t for t in pool.map(read, render(content, folder, dpi)) if t]
    if not texts:
        raise RuntimeError("OCR found no text")
    return "\n".join(texts)


def frame(payload: bytes) -> bytes:
    """A payload with its length before and its CRC32 after it, little-endian."""
    return struct.pack("<I", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


def read_frame(stream: BinaryIO) -> bytes | None:
    """The next payload; None at a clean end; an error if it is cut off or its CRC differs."""
    head = stream.read(4)
    if not head:
        return None
    size = struct.unpack("<I", head)[0] if len(head) == 4 else -1
    payload, tail = (stream.read(size), stream.read(4)) if size >= 0 else (b"", b"")
    if len(payload) != size or len(tail) != 4 or struct.unpack("<I", tail)[0] != zlib.crc32(payload):
        raise ValueError("damaged frame")
    return payload
