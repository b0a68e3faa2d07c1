"""Vectorised hashing of bytes, words and windows (numpy, no per-token Python).

A window's hash is built by doubling: pieces of one length are combined two by two, the last two overlapping, and every
combination goes through a non-linear mix. So no algebraic pattern (as of polynomials modulo a power of two) makes
different strings of any length share a hash; two of them do with a probability near 2**-64. ``rabin_karp`` is the
polynomial hash itself, modulo a prime.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: ASCII white space of the word contracts: space and \t..\r.
SPACES = b" \t\n\x0b\x0c\r"
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes worked on at a time.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; the order counts."""
    x = a * _ODD
    x += b
    return mix(x)


@functools.lru_cache(1)
def lower_table() -> np.ndarray:
    """Bytes with A-Z folded onto a-z."""
    v = np.arange(256, dtype=np.uint8)
    v[65:91] += 32
    return v


@functools.lru_cache(1)
def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SPACES)] = True
    return t


@functools.lru_cache(1)
def punctuation_table() -> np.ndarray:
    """White space, control characters and ASCII punctuation."""
    t = np.ones(256, bool)
    t[128:] = t[48:58] = t[65:91] = t[97:123] = False
    return t


@functools.lru_cache(1)
def _masks() -> np.ndarray:
    return np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place (zeros after the end) as one number; a view of a copy."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def doubled(values: np.ndarray, span: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of windows of ``length``, from those of windows of ``span``: one for each start, or for the starts ``at``."""
    while span * 2 <= length:
        values = combine(values[:-span], values[span:])
        span *= 2
    if at is None:
        return combine(values[: len(values) - (length - span)], values[length - span :]) if span < length else values
    return combine(values[at], values[at + (length - span)]) if span < length else values[at]


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many 64-bit values: one for each start."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    return doubled(mix(values + _GOLD), 1, length)


#: Rabin-Karp: values of a polynomial at a fixed point modulo a Mersenne prime, which no regular pattern defeats.
PRIME = (1 << 61) - 1
POINT = 0x0B5297A4D1E3C68F


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.minimum(x, x - np.uint64(PRIME))  # below the prime, the difference wraps to a large number


def _times(a: np.ndarray, factor: int) -> np.ndarray:
    """Products modulo the prime, from halves of 31 and 30 bits; what exceeds 61 bits counts again from the first."""
    low = np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> np.uint64(31), a & low, np.uint64(factor >> 31), np.uint64(factor & ((1 << 31) - 1))
    middle = ah * bl + al * bh
    out = (ah * bh) << np.uint64(1)
    out += middle >> np.uint64(30)
    out += (middle & np.uint64((1 << 30) - 1)) << np.uint64(31)
    out += al * bl
    return _reduced(out)


def rabin_karp(values: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every window of so many 64-bit values, scrambled: one for each start.

    The hash of a window is that of its first part times a power of the point, plus that of the rest; so windows grow by
    doubling, and any length is put together from powers of two.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, span, at, out = _reduced(values), 1, length, None
    while True:
        if length & span:  # from the right: the parts before have the higher powers
            at -= span
            part = power[at : at + n]
            out = part if out is None else _reduced(_times(part, pow(POINT, length - at - span, PRIME)) + out)
        if span * 2 > length:
            return mix(out)
        power = _reduced(_times(power[:-span], pow(POINT, span, PRIME)) + power[span:])
        span *= 2


def byte_windows(buf: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many bytes: one for each start."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length < 8:
        return mix((eights(buf)[:n] & _masks()[length]) + _GOLD)
    return doubled(mix(eights(buf)[: len(buf) - 7] + _GOLD), 8, length)


def _wide_edges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a character of a script without spaces begins (U+3000 to U+D7FF), and just after one."""
    lead = (buf >= 0xE3) & (buf <= 0xED)
    after = np.zeros(len(buf), bool)
    after[3:] = lead[:-3]
    return lead, after


def words(buf: np.ndarray, lower: bool = False, breaks: np.ndarray | None = None, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of a buffer: runs without ASCII white space, or without the bytes of breaks.

    With wide, each Chinese, Japanese or Korean character is a word of its own. Words of up to 32 bytes are hashed by whole
    eights, the last one overlapping; longer ones by xxh3.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.ones(n + 2, bool)
    edge[1:-1] = (space_table() if breaks is None else breaks)[buf]
    inside, cut = ~edge[1:-1], np.zeros(n + 1, bool)
    if wide:
        lead, after = _wide_edges(buf)
        cut[:-1] = lead | after
    start = np.flatnonzero(inside & (edge[:-2] | cut[:-1]))
    end = np.flatnonzero(inside & (edge[2:] | cut[1:])) + 1
    if lower:
        buf = lower_table()[buf]
    load, size = eights(buf), end - start
    h = mix((load[start] & _masks()[np.minimum(size, 8)]) + _GOLD * size.astype(np.uint64))
    for low, high in ((8, 16), (16, 32)):
        at = np.flatnonzero((size > low) & (size <= high))
        if len(at):
            middle = [load[start[at] + 8], load[end[at] - 16]] if high == 32 else []
            for x in (*middle, load[end[at] - 8]):
                h[at] = combine(h[at], mix(x + _GOLD))
    at = np.flatnonzero(size > 32)
    if len(at):
        raw = memoryview(np.ascontiguousarray(buf))
        h[at] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())]
    return start, end, h


def owners(starts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Index of the document that holds each point; starts ascend, empty documents allowed."""
    return np.searchsorted(starts, points, "right") - 1
