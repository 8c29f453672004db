"""Quality score of documents: histogram gradient-boosted trees over text statistics.

The trees are grown on a bounded sample of labelled rows (``max_rows``, the rows whose
hashed doc_id is smallest) and flattened into three arrays, so a task scores a batch
by a few numpy steps per tree level. Everything else reads the whole table: one narrow
pass computes the statistics of every text and its score.

Null and empty texts have all-zero statistics and are scored like any other. A null
doc_id matches no label and is never held out. Rows that repeat are scored alike;
contradicting labels of one doc_id all take part. Without labels, or with one class
only, the score is the share of good labels (0.5 without any). Columns other than
doc_id and text are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hyplab.llm import kernels as K
from hyplab.llm.line_rules import repeated_words

FEATURES = (
    "log_words", "mean_word_bytes", "capital_share", "symbol_rate", "bang_rate", "bar_rate", "digit_share",
    "stop_rate", "comma_rate", "line_rate", "wide_share", "same_as_previous", "distinct_share", "repeat3_share",
    "repeated_words_of_previous_two", "long_word_share",
)
DOC = "doc_id long, "
STATS_SCHEMA = DOC + "stats array<double>"


def statistics(block: K.Block) -> np.ndarray:
    """One row of FEATURES per text."""
    data, off = block.data, block.offsets
    start, end, at = block.words()
    n = np.diff(at)
    per_word = np.maximum(n, 1)
    sums = lambda flags: K.per_text(flags, off)
    chars = np.maximum(sums(K.IN_WORD[data]), 1)
    capital, small = sums((data >= 65) & (data <= 90)), sums((data >= 97) & (data <= 122))
    hashes = K.Block.span_hash(block.prefix(), start, end)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    near = same.copy()
    near[2:] |= hashes[2:] == hashes[:-2]
    for flags, reach in ((same, 1), (near, 2)):
        for j in range(reach):
            first = at[:-1] + j
            flags[first[first < at[1:]]] = False
    keys = np.sort(K.salt(hashes, at))
    # salted hashes of one text lie anywhere in the sort, so distinct words are counted by first places
    order = np.argsort(K.salt(hashes, at), kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[order[1:]] = keys[1:] != keys[:-1]
    rate = lambda marks: sums(np.isin(data, np.frombuffer(marks, np.uint8))) / per_word
    return np.column_stack([
        np.log1p(n), chars / per_word, capital / np.maximum(capital + small, 1), rate(b"#*$%&<>"), rate(b"!"), rate(b"|"),
        sums((data >= 48) & (data <= 57)) / chars, rate(b"."), rate(b","), rate(b"\n"), sums(data >= 0x80) / chars,
        K.per_text(same, at) / per_word, K.per_text(fresh, at) / per_word, repeated_words(hashes, at) / per_word,
        K.per_text(near, at) / per_word, K.per_text(end - start > 20, at) / per_word,
    ]) * (n > 0)[:, None]


@dataclass
class Trees:
    """Complete trees as arrays: ``feature`` and ``cut`` of inner nodes, ``leaf`` values, per tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # complete trees: all rows reach the leaves together
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0
) -> Trees:
    """Boost trees on the logistic loss from histograms of gradients per (node, feature, bin)."""
    inner, leaves = 2**depth - 1, 2**depth
    good = float(y.mean()) if len(y) else 0.5
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or good in (0.0, 1.0):
        share = min(max(good, 1e-6), 1 - 1e-6)
        none.base = float(np.log(share / (1 - share)))
        return none
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])  # code > b means x > cuts[b]
    width = x.shape[1]
    flat = code + np.arange(width) * bins
    out = Trees(float(np.log(good / (1 - good))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                np.zeros((trees, leaves)))
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width * bins + flat).ravel()
            size = count * width * bins
            gs = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins).cumsum(2)
            hs = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1.0) | (ht - hs < 1.0)] = -np.inf
            for f, c in enumerate(cuts):
                gain[:, f, len(c):] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    out.feature[t, first + k], out.cut[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        out.leaf[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += out.leaf[t][leaf]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **params) -> Trees:
    """Grow trees on at most ``max_rows`` labelled documents that are not held out."""
    order = F.xxhash64(F.col("doc_id"))
    taught = (
        labels.select("doc_id", F.col("quality").cast("double").alias("_y"))
        .where(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(order, "doc_id", "_y").limit(max_rows)
    )
    # the sample is bounded by max_rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(row, block.n), "_y": batch.column(2).slice(row, block.n),
                   "stats": pa.array(list(statistics(block)), pa.list_(pa.float64()))}

    stats = K.map_batches(rows, ["doc_id", "text", "_y"], DOC + "_y double, stats array<double>", run)
    sample = stats.orderBy(order, "doc_id", "_y", "stats").limit(max_rows).collect()
    x = np.array([r["stats"] for r in sample]).reshape(len(sample), len(FEATURES))
    return grow(x, np.array([r["_y"] for r in sample]), **params)


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document with its ``score`` and ``predicted``. Narrow: no shuffle."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "score double", "predicted int"])
    names = list(dict.fromkeys([*keep, "text"]))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(names.index("text"))):
            s = model.score(statistics(block))
            yield {c: batch.column(names.index(c)).slice(row, block.n) for c in keep} | {
                "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return K.map_batches(docs, names, schema, run)
