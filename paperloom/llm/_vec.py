"""Vectorised text hashing shared by the operators of this subpackage.

All functions work on a whole Arrow batch of texts at once: one UTF-32 buffer, class
look-ups and cumulative polynomial hashes in numpy, no Python loop over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_CP = 0x110000


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True for the code points that are letters or digits."""
    return np.fromiter((chr(c).isalnum() for c in range(_CP)), bool, _CP)


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(_CP)), bool, _CP)


@lru_cache(maxsize=1)
def _powers_cache() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = _powers_cache()
    size = 1 << max(16, int(n).bit_length())
    if size not in cache:
        p, q = np.empty(size, np.uint64), np.empty(size, np.uint64)
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(np.full(size - 1, _P), out=p[1:])
            np.multiply.accumulate(np.full(size - 1, _PINV), out=q[1:])
        cache.clear()
        cache[size] = (p, q)
    return cache[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * _A
        h = h ^ (h >> np.uint64(27))
        h = h * _B
        return h ^ (h >> np.uint64(31))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a zero behind each, and the offset of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    return buf, np.concatenate([[0], np.cumsum(lens + 1)])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask]).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, wherever it stands."""
    p, q = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        c = np.empty(len(buf) + 1, np.uint64)
        c[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(0x1F)) * p[: len(buf)], out=c[1:])
        return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _C)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, and the index of each one's text."""
    buf, offsets = codes(texts)
    starts, ends = runs(alnum_table()[buf])
    return span_hashes(buf, starts, ends), np.searchsorted(offsets, starts, "right") - 1


#: Characters that are worked on at once: about 100 MB of arrays.
CHARACTERS = 2_000_000


def slices(texts: list[str], most: int = CHARACTERS) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; one longer text is a range alone."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t) + 1
    return [*out, (begin, len(texts))] if texts else []


def shingles(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes: (text index, hash) sorted by both."""
    parts = [(a, _shingles(texts[a:b], k)) for a, b in slices(texts)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate([d + a for a, (d, _) in parts]), np.concatenate([s for _, (_, s) in parts])


def _shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    h, doc = word_hashes(texts)
    if len(h) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s = s * _P + h[i : len(h) - k + 1 + i]
        s = mix(s)
    inside = doc[: len(s)] == doc[k - 1 :]
    s, d = s[inside], doc[: len(s)][inside]
    order = np.argsort(s)
    order = order[np.argsort(d[order].astype(np.uint16 if len(texts) <= 65536 else np.int64), kind="stable")]
    s, d = s[order], d[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return d[first], s[first]
