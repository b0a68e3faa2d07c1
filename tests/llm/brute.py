"""Plain versions of the operators, straight from their definitions."""

import collections
import hashlib
import math
import re

import numpy as np

WS = " \t\n\x0b\x0c\r"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def first_ids(rows, keys):
    first = {}
    for i, t in rows:
        for k in keys(t):
            first[k] = min(first.get(k, i), i)
    return first


def op1(rows, n=50):
    windows = lambda b: [b[s : s + n] for s in range(len(b) - n + 1)]
    first = first_ids(rows, lambda t: windows((t or "").encode()))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s, w in enumerate(windows(b)):
            if first[w] < i:
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def op2(rows, n=10):
    key = lambda line: low(line.strip(WS))
    first = first_ids(rows, lambda t: [key(x) for x in (t or "").split("\n") if len(key(x)) >= n])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def op3(rows):
    sets, ids = [], []
    for i, t in rows:
        w = words(low(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        ids.append(i)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in enumerate(sets):
        for x in s:
            holders[x].append(d)
    for d, s in enumerate(sets):
        for e, o in collections.Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * o >= 75 * (len(s) + len(sets[e]) - o):
                a, b = find(ids[d]), find(ids[e])
                up[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in zip(ids, sets)]


def op5(rows, n=13):
    windows = lambda t: [tuple(w[s : s + n]) for w in [words(t)] for s in range(len(w) - n + 1)]
    first = first_ids(rows, windows)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [0] * len(w)
        for s, k in enumerate(windows(t)):
            if first[k] < i:
                gone[s : s + n] = [1] * n
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def fold(text):
    """Words as decontamination and licences take them: letters, digits and non-ASCII, each CJK character its own."""
    out = []
    for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower()):
        out += re.findall(r"[\u3000-\ud7ff]|[^\u3000-\ud7ff]+", w)
    return out


def smith_waterman(items, text, match=2, cost=1):
    """Best local score of a text (list of words) with each item, over all pairs of places, by anti-diagonals.

    The score of several items is computed side by side; equal scores go to more matched words (score, matches).
    """
    unit = 1 << 20
    number = {}
    as_ids = lambda ws: [number.setdefault(w, len(number)) for w in ws]
    m, n = max(map(len, items), default=0), len(text)
    a = np.full((len(items), m), -1)
    for k, w in enumerate(items):
        a[k, : len(w)] = as_ids(w)
    b = np.concatenate([np.full(m, -2), np.array(as_ids(text), int), np.full(m, -2)])
    one = two = np.zeros((len(items), m + 1), np.int64)  # the last anti-diagonal and the one before, by place in the item
    best = np.zeros(len(items), np.int64)
    for d in range(n + m - 1):
        other = b[d - np.arange(m) + m]  # the word that meets the item's i-th on this diagonal
        hit = np.where(a == other[None, :], match * unit + 1, -cost * unit)
        now = np.zeros_like(one)
        now[:, 1:] = np.maximum(0, np.maximum(two[:, :-1] + hit, np.maximum(one[:, :-1], one[:, 1:]) - cost * unit))
        best = np.maximum(best, now.max(1))
        one, two = now, one
    return [(int(x) // unit, int(x) % unit) for x in best]


def bucket(chars, buckets):
    """Hash bucket of an n-gram, in whole numbers."""
    top = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return x ^ x >> 31

    h = len(chars)
    for c in chars:
        h = mix(h * 0x9E3779B97F4A7C15 + ord(c) & top)
    return h % buckets


def bayes(labelled, texts, buckets, alpha=0.5):
    """Language and posterior of each text, by naive Bayes over hashed 1- to 3-grams, one n-gram at a time."""
    grams = lambda t: [bucket(t[i : i + n], buckets) for t in [(t or "").lower()] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    counts, docs = {}, collections.Counter()
    for lang, text in labelled:
        docs[lang] += 1
        counts.setdefault(lang, collections.Counter()).update(grams(text))
    out = []
    for text in texts:
        own, logs = grams(text), {}
        for lang in sorted(counts):
            total = math.log(sum(counts[lang].values()) + alpha * buckets)
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log(counts[lang][g] + alpha) - total for g in own)
        best = max(logs, key=lambda x: (logs[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out
