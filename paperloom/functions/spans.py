"""Terms of whole Arrow batches of texts as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

_P, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Characters that are worked on at once; one longer text is a part alone.
CHARACTERS = 1 << 20


@lru_cache(maxsize=1)
def _words() -> np.ndarray:
    """True for the code points of letters, numbers and _."""
    return np.fromiter((c == 95 or unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """True for the code points other than blanks and line ends."""
    table = np.ones(0x110000, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(size, _P), np.full(size, _PINV)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lowered(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts that lie in UTF-8 data at offsets, lower-cased, and where each
    text begins in them and the last one ends."""
    if data.isascii():
        return np.frombuffer(data.lower(), np.uint8), offsets
    whole = data.decode("utf-8")
    low = whole.lower()
    if len(low) != len(whole) or "\u03a3" in whole:  # a letter becomes two, or depends on what is next to it
        each = [data[a:b].decode("utf-8").lower() for a, b in zip(offsets[:-1], offsets[1:])]
        low, offsets = "".join(each), np.r_[0, np.cumsum([len(x) for x in each])]
    else:
        offsets = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)][offsets]
    return np.frombuffer(low.encode("utf-32-le"), "<u4"), offsets


def _terms(data: bytes, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the terms of texts that lie in UTF-8 data at offsets."""
    code, offsets = _lowered(data, offsets)
    inside = (_words() if words else _signs())[code]
    border = np.zeros(len(code) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.r_[False, inside[:-1]]))
    stops = np.flatnonzero(inside & (border[1:] | ~np.r_[inside[1:], False])) + 1
    if words:
        long = stops - starts > 1
        starts, stops = starts[long], stops[long]
    p, q = _powers(1 << max(20, len(code).bit_length()))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(0x1F)) * p[: len(code)], out=sums[1:])
    h = _mix((sums[stops] - sums[starts]) * q[starts] + (stops - starts).astype(np.uint64) * _C)
    return h.view(np.int64), np.searchsorted(offsets, starts, "right") - 1


def term_hashes(text: pa.Array, words: bool, without: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, number of each text's) of texts without nulls, lower-cased: runs of
    two or more letters and digits, less the words ``without``; or what stands between
    blanks."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = memoryview(text.buffers()[2] or b"")
    left_out = np.sort(term_hashes(pa.array(without), words)[0]) if without else np.empty(0, np.int64)
    hashes, lengths, a = [], [], 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHARACTERS, "right")) - 1)
        h, owner = _terms(bytes(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], words)
        if len(left_out):
            keep = left_out[np.minimum(np.searchsorted(left_out, h), len(left_out) - 1)] != h
            h, owner = h[keep], owner[keep]
        hashes.append(h), lengths.append(np.bincount(owner, minlength=b - a))
        a = b
    return np.concatenate([np.empty(0, np.int64), *hashes]), np.concatenate([np.empty(0, np.int64), *lengths])
