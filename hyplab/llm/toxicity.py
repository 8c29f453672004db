"""Toxicity by a classifier chain of linear models over words and word beginnings.

Categories are predicted in order; each model also reads the probabilities of the
categories before it. In training those are out-of-fold predictions, so a later model
learns how far an earlier one can be trusted, not how well it remembers.

Models are fitted on a bounded sample of labelled rows (``max_rows``, the rows whose
hashed doc_id is smallest, held-out ids excluded). Its features are chosen by Spark:
each word and its first four, five and six bytes fall into one of 2 ** CELL_BITS cells,
and the ``n_features`` cells most tied to the last category are kept. Scoring is one
narrow pass over whole texts.

``labels`` has one toxicity mark. ``weak_categories`` derives finer ones from it: a toxic
row in which a seed word of the category occurs. A table with own columns for its
categories can be used as it is.

Null and empty texts have no features and get the models' intercepts. A null doc_id
matches no label and is never held out. Rows that repeat are scored alike, a category
that occurs in all or none of the sample gets its share as a constant, and without
labels every probability is 0. An empty table gives an empty result; columns other than
doc_id and text are ignored; very long texts are worked whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hyplab.llm import kernels as K
from hyplab.llm.quality_classifier import held_out

# Seed words of the weak categories.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser"),
    "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting", "stupid"),
}
CELL_BITS = 20
BEGINNINGS = (4, 5, 6)
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")] = True


def cells(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of every word and word beginning, punctuation at word ends left out."""
    start, end, at = block.words()
    owner = np.repeat(np.arange(block.n), np.diff(at))
    for _ in range(3):
        start = start + ((end - start > 1) & _EDGE[block.data[start]])
        end = end - ((end - start > 1) & _EDGE[block.data[end - 1]])
    prefix = block.prefix(K.LOWER)
    who, what = [owner], [K.Block.span_hash(prefix, start, end)]
    for size in BEGINNINGS:
        longer = end - start > size
        who.append(owner[longer])
        what.append(K.mix(K.Block.span_hash(prefix, start[longer], start[longer] + size) ^ np.uint64(size)))
    return np.concatenate(who), (np.concatenate(what) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@lru_cache(maxsize=2)
def _index(chosen: tuple[int, ...]) -> np.ndarray:
    table = np.full(1 << CELL_BITS, -1, np.int16)
    table[list(chosen)] = np.arange(len(chosen))
    return table


def presence(block: K.Block, chosen: tuple[int, ...]) -> np.ndarray:
    """One row per text: which chosen cells it has."""
    who, what = cells(block)
    column = _index(chosen)[what]
    x = np.zeros((block.n, len(chosen)))
    x[who[column >= 0], column[column >= 0]] = 1.0
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 12) -> np.ndarray:
    """Weights and intercept (last, not shrunk) by Newton steps."""
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    z = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(len(w), l2)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ w)
        slope = z.T @ (p - y) + shrink * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink)
        move = np.linalg.solve(curve, slope)
        w = w - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    categories: tuple[str, ...]
    chosen: tuple[int, ...]
    weights: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """One column of probabilities per category, each model fed with those before it."""
        made: list[np.ndarray] = []
        for w in self.weights:
            z = np.column_stack([x, *made])
            made.append(sigmoid(z @ w[:-1] + w[-1]))
        return np.column_stack(made) if made else np.zeros((len(x), 0))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Models of the categories (columns of ``y``) in order, later ones on out-of-fold probabilities of earlier ones."""
    weights, before = [], np.zeros((len(x), 0))
    for c in range(y.shape[1]):
        z = np.column_stack([x, before])
        weights.append(logistic(z, y[:, c]))
        if c + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for f in np.unique(fold):
                w = logistic(z[fold != f], y[fold != f, c])
                out[fold == f] = sigmoid(z[fold == f] @ w[:-1] + w[-1])
            before = np.column_stack([before, out])
    return weights


def weak_categories(docs: DataFrame, labels: DataFrame, seeds: Mapping[str, Sequence[str]] = SEEDS) -> DataFrame:
    """Columns doc_id, text, one 0/1 column per seeded category and toxic, for the labelled documents."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    marks = {name: ((F.col("toxic") == 1) & low.rlike(r"\b(" + "|".join(words) + r")\b")).cast("double") for name, words in seeds.items()}
    return rows.select("doc_id", "text", *[m.alias(n) for n, m in marks.items()], F.col("toxic").cast("double").alias("toxic"))


def sample_labels(labels: DataFrame, mark: str = "toxic", max_rows: int = 10_000) -> DataFrame:
    """At most ``max_rows`` labels of rows that may teach."""
    fit_for = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit_for.select("doc_id", mark).orderBy(F.xxhash64("doc_id"), "doc_id", mark).limit(max_rows)


def fit(taught: DataFrame, categories: Sequence[str], max_rows: int = 10_000, n_features: int = 256, folds: int = 3) -> Chain:
    """Fit the chain on ``taught``: doc_id, text and a 0/1 column per category; at most ``max_rows`` rows are used."""
    last = categories[-1]
    columns = ", ".join(f"`{c}` double" for c in categories)
    order = [F.xxhash64("doc_id"), "doc_id", *categories]

    def per_text(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            who, what = cells(block)
            pairs = np.unique(who * (1 << CELL_BITS) + what)
            mark = batch.column(2).slice(row, block.n).to_numpy(zero_copy_only=False)
            yield {"cell": pairs % (1 << CELL_BITS), "mark": mark[pairs // (1 << CELL_BITS)]}

    seen = K.map_batches(taught, ["doc_id", "text", last], "cell long, mark double", per_text)
    counts = seen.groupBy("cell").agg(F.count("*").alias("n"), F.sum("mark").alias("k")).where("n >= 3")
    totals = taught.agg(F.count("*").alias("n"), F.sum(last).alias("k")).first()
    n, k = totals["n"] or 0, totals["k"] or 0.0
    share = k / n if n else 0.0
    # a binomial score against the share of the mark in the sample
    gap = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    chosen = tuple(r["cell"] for r in counts.orderBy(F.abs(gap).desc(), "cell").limit(n_features).collect())

    def features(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            x = presence(block, chosen)
            yield {"doc_id": batch.column(0).slice(row, block.n), "has": pa.array([np.flatnonzero(r) for r in x], pa.list_(pa.int64()))} | {
                c: batch.column(2 + i).slice(row, block.n) for i, c in enumerate(categories)}

    rows = K.map_batches(taught, ["doc_id", "text", *categories], f"doc_id long, has array<long>, {columns}", features)
    sample = rows.orderBy(*order, "has").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).collect()
    x = np.zeros((len(sample), len(chosen)))
    for i, r in enumerate(sample):
        x[i, r["has"]] = 1.0
    y = np.array([[r[c] for c in categories] for r in sample]).reshape(len(sample), len(categories))
    return Chain(tuple(categories), chosen, fit_chain(x, y, np.array([r["fold"] for r in sample])))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, score (the last one) and predicted (1 if it is at least 0.5)."""
    names = [f"p_{c}" for c in chain.categories]
    schema = ", ".join(["doc_id long", *(f"`{c}` double" for c in names), "score double", "predicted int"])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            p = chain.score(presence(block, chain.chosen))
            yield {"doc_id": batch.column(0).slice(row, block.n), "score": p[:, -1], "predicted": (p[:, -1] >= 0.5).astype(np.int32)} | {
                c: p[:, i] for i, c in enumerate(names)}

    return K.map_batches(docs, ["doc_id", "text"], schema, run)
