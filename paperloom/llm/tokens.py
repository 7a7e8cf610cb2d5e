"""Encoding of the whole corpus with a public tokenizer (problem 8).

One pass without a shuffle: each row's text is encoded whole in the task that reads it, so
rows stay apart whatever their ids. A text above LONG characters is cut where the
tokenizer's own pattern always cuts (a character of one class before one of another), so
its segments encode in parallel threads and concatenate exactly. A single unsplit piece
above LONG, that has no such place, is cut into leaves; their token lists are joined as a
tree: a window around each join is encoded anew, and grows until its tokens agree with
both sides' own, from where on a byte-pair encoding can't differ any more.
"""

from __future__ import annotations

import base64
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import tokenizer_path

LONG = 16_384
#: Threads of a task for the segments of a long text.
THREADS = 4
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public tokenizer's pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places where every segmentation by PATTERN has a border: behind anything but a blank
#: and before a blank, and between a letter and a digit, or either and another sign.
_BORDER = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_PIECE = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, limit: int = LONG) -> list[tuple[str, int]]:
    """(part, piece): parts of a text that concatenate to it. piece is -1 for parts
    between certain borders; leaves of one unsplit piece share a number of their own."""
    out: list[tuple[str, int]] = []
    at, n, unsplit = 0, len(text), 0
    while n - at > limit:
        border = _BORDER.search(text, at + limit // 2, at + limit)
        if border:
            out.append((text[at : border.start()], -1))
            at = border.start()
            continue
        # no border in half a limit: look at the pieces up to the next certain border
        border = _BORDER.search(text, at + limit)
        end = border.start() if border else n
        start = at
        for piece in _PIECE.finditer(text, at, end):
            a, b = piece.span()
            if b - a > limit:
                if a > start:
                    out.append((text[start:a], -1))
                out += [(text[i : min(b, i + limit)], unsplit) for i in range(a, b, limit)]
                unsplit += 1
                start = b
        if end > start:
            out.append((text[start:end], -1))
        at = end
    if at < n:
        out.append((text[at:], -1))
    return out


def join_tokens(a: list[int], b: list[int], enc, window: int = 8) -> list[int]:
    """The tokens of one piece from those of its two halves.

    A window of tokens around the join is encoded anew and doubled until its first and
    last tokens are the halves' own: from an agreeing token outwards neither side's
    merges depend on the other, so the halves' tokens stand.
    """
    token = enc.decode_single_token_bytes
    while True:
        wa, wb = min(window, len(a)), min(window, len(b))
        middle = enc._encode_single_piece(b"".join(map(token, a[len(a) - wa :])) + b"".join(map(token, b[:wb])))
        left = wa == len(a) or middle[:2] == a[len(a) - wa : len(a) - wa + 2]
        right = wb == len(b) or middle[-2:] == b[max(0, wb - 2) : wb]
        if left and right and (len(middle) >= 4 or (wa == len(a) and wb == len(b))):
            return a[: len(a) - wa] + middle + b[wb:]
        window *= 2


def join_tree(parts: list[list[int]], enc) -> list[int]:
    while len(parts) > 1:
        parts = [join_tokens(parts[i], parts[i + 1], enc) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_part(part: str, piece: int, enc) -> np.ndarray:
    if piece < 0:
        return enc.encode_to_numpy(part, disallowed_special=())
    # a leaf: halves of halves, so that no call sees a long unsplit run
    data = part.encode()
    leaves = [enc._encode_single_piece(data[i : i + 1024]) for i in range(0, len(data), 1024)]
    return np.asarray(join_tree(leaves, enc), np.uint32)


def encode_text(text: str, enc, pool: ThreadPoolExecutor, limit: int = LONG) -> np.ndarray:
    """The tokens of one text, of whatever length."""
    if len(text) <= limit:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts = segments(text, limit)
    encoded = list(pool.map(lambda p: encode_part(*p, enc), parts))
    out, at = [], 0
    while at < len(parts):
        piece, end = parts[at][1], at + 1
        while piece >= 0 and end < len(parts) and parts[end][1] == piece:
            end += 1
        out.append(encoded[at] if end == at + 1 else np.asarray(join_tree([e.tolist() for e in encoded[at:end]], enc), np.uint32))
        at = end
    return np.concatenate(out)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", counts_only: bool = False) -> DataFrame:
    """(key, ids): each row's tokens without special ones; strings of special tokens are
    ordinary text. Null and empty texts give an empty list, a blank text is encoded as
    it is. ``counts_only`` gives (key, n_tokens) instead. Repeated rows stay, rows of one
    key with different texts too; an empty table gives no rows; other columns don't
    matter. Texts of any length are whole.
    """
    path = tokenizer_path(vocabulary)
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    result = (lambda arrays: pa.array([len(a) for a in arrays], pa.int32())) if counts_only else _lists

    def run(batches):
        enc = encoding(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                arrays = [encode_text(t, enc, pool) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), result(arrays)], ["key", "ids"])

    encoded = rows.mapInArrow(run, "key long, ids int" if counts_only else "key long, ids array<int>")
    return encoded.select(F.col("key").alias(key), F.col("ids").alias("n_tokens" if counts_only else "ids"))
