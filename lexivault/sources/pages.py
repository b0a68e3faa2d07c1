"""Images of pages: PNG files with highlights, thumbnails and their cache, and the queue a viewer renders from."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import zlib
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import files

#: Colour of highlights, and the share of it in a highlighted pixel.
HIGHLIGHT, ALPHA = (255, 220, 0), 0.4
#: The head of a cached thumbnail (a mark and the version of its layout), and entries kept in memory.
MAGIC, LAYOUT, KEPT = b"PXT1", 2, 100
#: Requests that wait at most, urgent and others; the oldest go.
URGENT, NORMAL = 16, 128


def png(image: np.ndarray) -> bytes:
    """A PNG file of a grey (height, width) or coloured (height, width, 3) image."""
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def highlighted(gray: np.ndarray, boxes: list[tuple[float, float, float, float]], scale: float, inverted: bool = False) -> np.ndarray:
    """A coloured page with boxes (x_min, y_min, x_max, y_max in points) blended in; inverted first, if asked for."""
    page = np.repeat((255 - gray if inverted else gray)[:, :, None], 3, 2).astype(float)
    mark = np.zeros(gray.shape, bool)
    for x1, y1, x2, y2 in boxes:
        a, b = max(0, int(min(y1, y2) * scale)), int(np.ceil(max(y1, y2) * scale))
        c, d = max(0, int(min(x1, x2) * scale)), int(np.ceil(max(x1, x2) * scale))
        mark[a:b, c:d] = True  # boxes that overlap are blended once
    page[mark] = (1 - ALPHA) * page[mark] + ALPHA * np.array(HIGHLIGHT)
    return np.round(page).astype(np.uint8)


def thumbnail(gray: np.ndarray, side: int = 160) -> np.ndarray:
    share = side / max(gray.shape)
    return gray if share >= 1 else files.resize(gray, max(1, round(gray.shape[0] * share)), max(1, round(gray.shape[1] * share)))


def page_images(content: bytes, dpi: int = 150) -> list[np.ndarray]:
    """Grey images of all pages, by the page tools."""
    with tempfile.TemporaryDirectory() as folder:
        return [files.read_pgm(p) for p in files.render(content, folder, dpi)]


def render_pages(found: DataFrame, dpi: int = 150, side: int = 160) -> DataFrame:
    """(path, page, png, thumbnail, error) of files (path, content); a file that fails is one row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, i, png(x), png(thumbnail(x, side)), None) for i, x in enumerate(page_images(bytes(content or b""), dpi), 1)]
                except Exception as e:  # noqa: BLE001  whatever a bad file does
                    rows = [(path, 0, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "page", "png", "thumbnail", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, page int, png binary, thumbnail binary, error string")


class Recent:
    """Values by key, the most recently used so many of them."""

    def __init__(self, capacity: int):
        self.capacity, self.held = max(1, capacity), OrderedDict()

    def get(self, key, make: Callable[[], object]):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > self.capacity:
                self.held.popitem(last=False)
        return self.held[key]


class Thumbnails:
    """Thumbnails by path and time of change: in memory (first in, first out) and in a folder on this machine."""

    def __init__(self, folder: str, kept: int = KEPT):
        self.folder, self.kept, self.held = folder, kept, OrderedDict()

    @staticmethod
    def key(path: str, ticks: int) -> str:
        return hashlib.sha256(f"{path}|{ticks}".encode()).hexdigest().upper()

    def _file(self, key: str) -> str:
        return os.path.join(self.folder, key + ".thumb")

    def save(self, key: str, image: np.ndarray) -> None:
        os.makedirs(self.folder, exist_ok=True)
        pixels = np.ascontiguousarray(image, np.uint8)
        with open(self._file(key) + ".tmp", "wb") as f:
            f.write(MAGIC + struct.pack("<5i", LAYOUT, image.shape[1], image.shape[0], pixels.strides[0], pixels.nbytes) + pixels.tobytes())
        os.replace(self._file(key) + ".tmp", self._file(key))

    def load(self, key: str) -> np.ndarray | None:
        """The cached image; one of another layout, or a damaged one, is deleted."""
        try:
            with open(self._file(key), "rb") as f:
                data = f.read()
        except FileNotFoundError:
            return None
        head = 4 + struct.calcsize("<5i")
        if len(data) >= head and data[:4] == MAGIC:
            layout, width, height, stride, size = struct.unpack_from("<5i", data, 4)
            if layout == LAYOUT and size == len(data) - head == stride * height and stride >= width:
                return np.frombuffer(data, np.uint8, size, head).reshape(height, stride)[:, :width]
        os.remove(self._file(key))
        return None

    def get(self, path: str, ticks: int, make: Callable[[], np.ndarray]) -> np.ndarray:
        key = self.key(path, ticks)
        if key not in self.held:
            image = self.load(key)
            if image is None:
                image = make()
                self.save(key, image)
            self.held[key] = image
            if len(self.held) > self.kept:
                self.held.popitem(last=False)
        return self.held[key]


class RenderQueue:
    """Pages to render, urgent ones first; where too many wait, the oldest go."""

    def __init__(self):
        self.urgent, self.normal, self.cancelled = deque(maxlen=URGENT), deque(maxlen=NORMAL), False

    def put(self, match: int, page: int, urgent: bool = False) -> None:
        if not self.cancelled:
            (self.urgent if urgent else self.normal).append((match, page))

    def take(self) -> tuple[int, int] | None:
        """The next request; None if there is none, or all were cancelled."""
        if self.cancelled:
            return None
        return self.urgent.popleft() if self.urgent else self.normal.popleft() if self.normal else None

    def cancel(self) -> None:
        self.cancelled = True
        self.urgent.clear()
        self.normal.clear()
