"""Edit distances of many short pairs at once: bit vectors over a whole Arrow batch.

A column of the distance matrix is kept as bits (Myers 1999, with the carries of Hyyro
2003): one step of a pair is a few operations on 64-bit words, and numpy takes that step
for all pairs of a block. Long pairs go to the distance built into Spark, see ``distance``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Pairs per block: its bit vectors stay in the processor's cache.
_BLOCK = 2048
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _matrix(codes: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``codes``, padded to ``width``; what stands in the padding does not matter."""
    at = start[:, None] + np.arange(width)
    return codes[np.minimum(at, max(len(codes) - 1, 0))] if len(codes) else np.zeros(at.shape, codes.dtype)


def _block(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Distances of the rows of two code matrices; ``a`` is a multiple of 64 wide, ``b_size`` falls."""
    n, width = a.shape
    words = width // 64
    up = np.full((words, n), ~np.uint64(0))  # vertical differences of +1 and of -1
    down = np.zeros((words, n), np.uint64)
    alive = np.searchsorted(-b_size, -np.arange(b.shape[1]), side="left")
    for j, k in enumerate(alive.tolist()):
        if not k:
            break
        same = np.packbits(a[:k] == b[:k, j, None], axis=1, bitorder="little").view("<u8")
        more, less = _ONE, np.uint64(0)  # the first row of the matrix grows by one a column
        for w in range(words):
            p, m = up[w, :k], down[w, :k]
            eq = same[:, w]
            xv = eq | m
            eq = eq | less
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            carried = ph >> _TOP, mh >> _TOP
            ph = (ph << _ONE) | more
            mh = (mh << _ONE) | less
            up[w, :k] = mh | ~(xv | ph)
            down[w, :k] = ph & xv
            more, less = carried
    out = b_size.astype(np.int64)
    for w in range(words):
        held = np.clip(a_size - 64 * w, 0, 64)
        mask = np.where(held == 64, ~np.uint64(0), (_ONE << np.minimum(held, 63).astype(np.uint64)) - _ONE)
        out += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask)
    return out


def distances(codes: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of slices of ``codes``."""
    out = np.empty(len(a_size), np.int64)
    order = np.argsort(-b_size, kind="stable")
    for i in range(0, len(order), _BLOCK):
        at = order[i : i + _BLOCK]
        wide = 64 * max(1, -(-int(a_size[at].max()) // 64))
        a = _matrix(codes, a_start[at], a_size[at], wide)
        b = _matrix(codes, b_start[at], b_size[at], int(b_size[at[0]]))
        out[at] = _block(a, a_size[at], b, b_size[at])
    return out


def _slices(size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    return start[:n], size[:n], start[n:], size[n:]


def _narrow(codes: np.ndarray) -> np.ndarray:
    top = int(codes.max(initial=0))
    return codes.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32)


def _with_nulls(a: pa.Array, b: pa.Array, fn) -> pa.Array:
    """``fn`` of the rows where both sides are given, null elsewhere."""
    given = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    out = np.zeros(len(a), np.int32)
    if given.any():
        rows = pa.array(np.flatnonzero(given))
        out[given] = fn(pa.concat_arrays([a.take(rows), b.take(rows)]), len(rows))
    return pa.array(out, mask=~given)


def _of_texts(texts: pa.Array, n: int) -> np.ndarray:
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    return distances(_narrow(codes), *_slices(size, n))


def _of_words(lists: pa.Array, n: int) -> np.ndarray:
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return distances(_narrow(codes), *_slices(size, n))


@F.arrow_udf(IntegerType())
def text_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Character edits of two texts, null where one is."""
    return _with_nulls(a, b, _of_texts)


@F.arrow_udf(IntegerType())
def list_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edits of two lists of words, null where one is."""
    return _with_nulls(a, b, _of_words)


@F.arrow_udf(ArrayType(IntegerType()))
def text_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """``text_distance`` place by place of two lists of one length."""
    size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, _with_nulls(a.flatten(), b.flatten(), _of_texts))
