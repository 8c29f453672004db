"""Numpy kernels over Arrow string columns, shared by the operators of this subpackage.

A batch of texts is one byte buffer with offsets, so words, lines and their 64-bit
hashes come from a few vectorised passes over bytes. A batch is worked in blocks of
about a megabyte of whole texts, which bounds memory whatever the batch holds; a
text longer than that is a block of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hyplab.llm.store import ship

BLOCK_BYTES = 1 << 20
_SEED = 20240229
_SPACES = [0x20, *range(0x09, 0x0E)]
NEWLINE = 0x0A


def _lut(codes: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


IN_WORD = ~_lut(_SPACES)
CONTINUATION = _lut(range(0x80, 0xC0))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x9E3779B97F4A7C15
    up = np.full(n, r, np.uint64)
    down = np.full(n, pow(r, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    return _powers(_room(n))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Block:
    """Some whole texts: bytes ``data`` and ``offsets`` (one more than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def prefix(self, table: np.ndarray | None = None) -> np.ndarray:
        """Running polynomial sums, from which ``span_hash`` takes any span."""
        data = self.data if table is None else table[self.data]
        up, _ = powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes()[data] * up[: len(data)], out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans [start, end), the same wherever a span stands."""
        _, down = powers(len(prefix) - 1)
        lengths = (end - start).astype(np.uint64)
        return mix((prefix[end] - prefix[start]) * down[start] + lengths * np.uint64(0x2545F4914F6CDD1D))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and where each text's words begin (n + 1 numbers)."""
        inside = IN_WORD[self.data]
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets[:-1]] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        first[self.offsets[-1]] = True
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each newline-split line (empty ones too), and where each text's lines begin."""
        cut = np.flatnonzero(self.data == NEWLINE)
        starts = np.concatenate([self.offsets[:-1], cut + 1])
        ends = np.concatenate([cut, self.offsets[1:]])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, "right") - 1])
        order = np.lexsort((starts, owner))
        # starts and ends of one text are both rising: sorting each by text pairs them
        order_ends = np.lexsort((ends, np.concatenate([np.searchsorted(self.offsets, cut, "right") - 1, np.arange(self.n)])))
        return starts[order], ends[order_ends], np.searchsorted(owner[order], np.arange(self.n + 1))

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def _room(n: int) -> int:
    size = BLOCK_BYTES
    while size < n + 1:
        size *= 2
    return size


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, Block]]:
    """(first row, block) over the texts of an Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers, at, n = column.buffers(), column.offset, len(column)
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], np.int64)[at : at + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, Block(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def windows(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` values that stays in one text, and where each text's runs begin."""
    n = len(values)
    size = np.maximum(np.diff(bounds) - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(size)])
    if n < k:
        return np.zeros(0, np.uint64), at
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc += values[j : n - k + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    keep = np.ones(n - k + 1, bool)
    for j in range(1, k):  # a run that starts in the last k - 1 places of a text reaches into the next
        late = bounds[1:] - j
        late = late[(late >= bounds[:-1]) & (late < n - k + 1)]
        keep[late] = False
    return mix(acc[keep]), at


def salt(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Make the values of different texts differ, so one sort finds repeats within each text."""
    own = mix(np.arange(1, len(bounds), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(values ^ np.repeat(own, np.diff(bounds)))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over each text's stretch."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def map_batches(
    df: DataFrame, columns: Iterable[str], schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict]]
) -> DataFrame:
    """``mapInArrow`` over the named columns; ``fn`` yields dicts of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in target)],
                    schema=target,
                )

    return df.select(*columns).mapInArrow(run, schema)
