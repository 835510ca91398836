"""BLAKE3 digests, which Spark has no function for, in numpy over Arrow batches.

All chunks of a batch are compressed together, one block of each at a time; then the values of their trees are paired level by level, an odd
one moving up alone, which gives the tree that the format asks for. Whole subtrees of a long content have values of their own, so parts of it can be
taken in different tasks (`part_values`) and put together (`joined`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the format: initial words, the order that words of a block take from round to round, sizes and flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
BLOCK, CHUNK, ROUNDS = 64, 1024, 7
START, END, PARENT, ROOT = 1, 2, 4, 8
#: The columns and diagonals of four words that a round mixes.
LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
#: Chunks that are compressed together.
TOGETHER = 1 << 14
W = np.uint32


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> W(by)) | (x << W(32 - by))


def compressed(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next value (8 words) of each column; words has 16 rows."""
    state = [*value, *(np.full(value.shape[1], x, W) for x in IV[:4]), (counter & 0xFFFFFFFF).astype(W), (counter >> 32).astype(W), length.astype(W), flags.astype(W)]
    order = list(range(16))
    for _ in range(ROUNDS):
        for k, (a, b, c, d) in enumerate(LANES):
            for word, left, right in ((words[order[2 * k]], 16, 12), (words[order[2 * k + 1]], 8, 7)):
                state[a] = state[a] + state[b] + word
                state[d] = turned(state[d] ^ state[a], left)
                state[c] = state[c] + state[d]
                state[b] = turned(state[b] ^ state[c], right)
        order = [order[x] for x in ORDER]
    return np.stack([state[k] ^ state[k + 8] for k in range(8)])


def chunk_values(chunks: np.ndarray, size: np.ndarray, counter: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The values of chunks (rows of CHUNK bytes, padded with zeros) of these sizes; root marks those that are a whole content."""
    value = np.repeat(np.array(IV, W)[:, None], len(chunks), axis=1)
    blocks = np.maximum(1, -(-size // BLOCK))
    words = np.ascontiguousarray(chunks).view("<u4").reshape(len(chunks), CHUNK // BLOCK, 16)
    for k in range(int(blocks.max(initial=1))):
        at = np.flatnonzero(blocks > k)
        last = blocks[at] == k + 1
        flags = np.where(k == 0, START, 0) + np.where(last, END + np.where(root[at], ROOT, 0), 0)
        value[:, at] = compressed(value[:, at], np.ascontiguousarray(words[at, k].T), counter[at], np.minimum(BLOCK, size[at] - k * BLOCK), flags)
    return value


def paired(values: list[np.ndarray], whole: bool) -> list[np.ndarray]:
    """For each tree, given the values of its leaves as columns, that of its top. whole marks trees of whole contents, whose tops are roots."""
    while any(v.shape[1] > 1 for v in values):
        pairs = [v.shape[1] // 2 for v in values]
        left = np.concatenate([v[:, 0 : 2 * n : 2] for v, n in zip(values, pairs, strict=True)], axis=1)
        right = np.concatenate([v[:, 1 : 2 * n : 2] for v, n in zip(values, pairs, strict=True)], axis=1)
        root = np.concatenate([np.full(n, whole and v.shape[1] == 2) for v, n in zip(values, pairs, strict=True)])
        n = left.shape[1]
        top = compressed(np.repeat(np.array(IV, W)[:, None], n, axis=1), np.concatenate((left, right)), np.zeros(n, np.int64), np.full(n, BLOCK), PARENT + np.where(root, ROOT, 0))
        ends = np.cumsum(pairs)
        values = [np.concatenate((top[:, e - p : e], v[:, 2 * p :]), axis=1) for v, p, e in zip(values, pairs, ends.tolist(), strict=True)]
    return values


def leaves(contents: list[bytes], first: int, whole: bool) -> list[np.ndarray]:
    """The values of the chunks of each content, whose first has this number."""
    out: list[list[np.ndarray]] = [[] for _ in contents]
    spans = [(i, at) for i, c in enumerate(contents) for at in range(0, max(1, len(c)), CHUNK)]
    for start in range(0, len(spans), TOGETHER):
        now = spans[start : start + TOGETHER]
        data, size = np.zeros((len(now), CHUNK), np.uint8), np.zeros(len(now), np.int64)
        for k, (i, at) in enumerate(now):
            part = contents[i][at : at + CHUNK]
            data[k, : len(part)], size[k] = np.frombuffer(part, np.uint8), len(part)
        counter = np.array([first + at // CHUNK for _, at in now], np.int64)
        values = chunk_values(data, size, counter, np.array([whole and len(contents[i]) <= CHUNK for i, _ in now], bool))
        for k, (i, _) in enumerate(now):
            out[i].append(values[:, k])
    return [np.stack(v, axis=1) for v in out]


def text_of(value: np.ndarray) -> str:
    return value.astype("<u4").tobytes().hex()


def digests(contents: list[bytes]) -> list[str]:
    """The digests of whole contents, in lower-case hexadecimal numbers."""
    return [text_of(v[:, 0]) for v in paired(leaves(contents, 0, True), True)] if contents else []


def part_value(content: bytes, first: int) -> bytes:
    """The value of a part of a longer content: its chunks, of which the first has this number, a multiple of a power of two that no part but the last falls short of."""
    return paired(leaves([content], first, False), False)[0][:, 0].astype("<u4").tobytes()


def joined(values: list[bytes]) -> str:
    """The digest of a content of two parts or more, from the values of its parts in order."""
    return text_of(paired([np.stack([np.frombuffer(v, "<u4") for v in values], axis=1).astype(W)], True)[0][:, 0])


@F.pandas_udf(StringType())
def _digest(data: pd.Series) -> pd.Series:
    there = data.notna()
    out = pd.Series([None] * len(data), dtype=object)
    out[there.to_numpy()] = digests([bytes(d) for d in data[there]])
    return out


def digest(data: Column) -> Column:
    """The BLAKE3 digest of binary data in lower-case hexadecimal numbers; null for null. A row has to be small enough for a batch: longer contents go by parts."""
    return _digest(data)
