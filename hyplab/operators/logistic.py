"""Many regularised logistic models fitted together, one pass over the rows per Newton step.

A model learns from the rows of some cells (each row lies in one cell). The products of a
row's features are made once for all models, which are summed by matrix products. A pass sums, for
every model, the gradient and the Hessian of its penalised log-likelihood; a task sends one
small array per model, arrays are added in a tree, and the driver solves the models' steps.
So the number of jobs is the number of Newton steps, however many models there are, and
what travels has the size of (models x features ** 2), whatever the table.

Features are imputed by the medians of a model's own training cells and scaled by their
mean and deviation; the intercept is not penalised. A model whose rows have one label only
gives that label's probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

FAN = 32
BLOCK = 512  # rows whose products of features and probabilities stay in the cache
MEDIAN_ACCURACY = 100_000
STEPS, TOLERANCE = 40, 1e-8


@dataclass(frozen=True)
class Model:
    """Learns from the cells of training set ``train`` with the features ``columns``; strength is the inverse penalty."""

    train: int
    columns: tuple[int, ...]
    strength: float
    balanced: bool


def tree_sum(df: DataFrame, key: str, value: str, tasks: int) -> DataFrame:
    """Sums of equally long arrays ``value`` per ``key``; no task adds more than about FAN arrays of a key at once.

    ``df`` has ``task``, the number of the task that made a row.
    """

    def add(table: pa.Table) -> pa.Table:
        rows = np.array([x for x in table[value].to_pylist()], float)
        out = {key: table[key].slice(0, 1), "task": table["task"].slice(0, 1), value: pa.array([rows.sum(0).tolist()], pa.list_(pa.float64()))}
        return pa.table(out)

    schema = f"{key} long, task long, {value} array<double>"
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        df = df.withColumn("task", F.col("task") % tasks).groupBy(key, "task").applyInArrow(add, schema)
    return df.groupBy(key).applyInArrow(add, schema).select(key, value)


def summed(df: DataFrame, columns: Sequence[Column], partial: Callable[[list[np.ndarray]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of the arrays that ``partial`` makes of a batch of ``columns``, by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                arrays = [_matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
                for k, x in partial(arrays).items():
                    total[k] = total[k] + x if k in total else x
        me = TaskContext.get().partitionId()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array([me] * len(total), pa.int64()),
                 pa.array([x.ravel().tolist() for x in total.values()], pa.list_(pa.float64()))], ["model", "task", "total"])

    parts = df.select(*columns).mapInArrow(run, "model long, task long, total array<double>")
    return {r["model"]: np.array(r["total"]) for r in tree_sum(parts, "model", "total", df.rdd.getNumPartitions()).toLocalIterator()}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


@dataclass
class Scaling:
    """For each training set the medians, means and deviations of the features, and its rows and positives."""

    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    rows: np.ndarray
    positives: np.ndarray

    def apply(self, x: np.ndarray, t: int) -> np.ndarray:
        z = (np.where(np.isfinite(x), x, self.medians[t]) - self.means[t]) / self.deviations[t]
        return np.concatenate([np.ones((len(x), 1)), z], axis=1)


def scaling(df: DataFrame, x: str, label: str, cell: str, sets: Sequence[Sequence[int]], width: int) -> Scaling:
    """Statistics of the training sets from statistics of the cells; medians by a mergeable sketch, for features with gaps only."""
    at = [F.col(x)[j] for j in range(width)]
    good = [F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v) for v in at]
    # sums of values shifted by any fixed number near their mean keep the deviation's digits
    shift = [r or 0.0 for r in df.agg(*[F.avg(v) for v in good]).first()]
    per = df.groupBy(cell).agg(
        F.count("*").alias("n"), F.sum(label).alias("pos"), *[F.count(v).alias(f"k{j}") for j, v in enumerate(good)],
        *[F.sum(v - shift[j]).alias(f"s{j}") for j, v in enumerate(good)], *[F.sum((v - shift[j]) ** 2).alias(f"q{j}") for j, v in enumerate(good)]).collect()
    cells = {r[cell]: r for r in per}
    medians = np.zeros((len(sets), width))
    gaps = [j for j in range(width) if any(r[f"k{j}"] < r["n"] for r in per)]
    if gaps:
        row = df.agg(*[F.percentile_approx(F.when(F.col(cell).isin(list(s)), good[j]), 0.5, MEDIAN_ACCURACY) for s in sets for j in gaps]).first()
        medians[:, gaps] = np.array([np.nan if v is None else v for v in row], float).reshape(len(sets), len(gaps))
        medians = np.nan_to_num(medians, nan=0.0)
    means, deviations, rows, positives = np.zeros((len(sets), width)), np.ones((len(sets), width)), np.zeros(len(sets)), np.zeros(len(sets))
    for t, s in enumerate(sets):
        held = [cells[c] for c in s if c in cells]
        rows[t], positives[t] = sum(r["n"] for r in held), sum(r["pos"] or 0 for r in held)
        for j in range(width):
            filled = medians[t, j] - shift[j]
            missing = sum(r["n"] - r[f"k{j}"] for r in held)
            total = sum(r[f"s{j}"] or 0.0 for r in held) + missing * filled
            squares = sum(r[f"q{j}"] or 0.0 for r in held) + missing * filled**2
            mean = total / max(rows[t], 1)
            means[t, j] = mean + shift[j]
            spread = max(0.0, squares / max(rows[t], 1) - mean**2)
            deviations[t, j] = np.sqrt(spread) if spread > 1e-20 else 1.0
    return Scaling(medians, means, deviations, rows, positives)


class Shared:
    """One scale for all training sets, so that a row's products of features serve every model.

    A set's scaled features are this scale's features times a matrix; weights, gradients and
    Hessians are carried over by it.
    """

    def __init__(self, scale: Scaling, width: int) -> None:
        with_rows = scale.rows > 0
        self.medians, self.means, self.deviations = scale.medians, scale.means[with_rows].mean(0), scale.deviations[with_rows].mean(0)
        self.upper = np.triu_indices(width + 1)
        self.to_set = []
        for mean, deviation in zip(scale.means, scale.deviations):
            a = np.diag(np.concatenate([[1.0], self.deviations / deviation]))
            a[0, 1:] = (self.means - mean) / deviation
            self.to_set.append(a)

    def weights(self, weights: np.ndarray, models: Sequence[Model]) -> np.ndarray:
        return np.array([self.to_set[m.train] @ w for m, w in zip(models, weights)])

    def apply(self, x: np.ndarray, t: int | None) -> np.ndarray:
        filled = x if t is None else np.where(np.isfinite(x), x, self.medians[t])
        return np.concatenate([np.ones((len(x), 1)), (filled - self.means) / self.deviations], axis=1)

    def scaled(self, total: np.ndarray, t: int, use: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian of a model in the scale of its training set."""
        a = self.to_set[t][:, use]
        d = len(self.to_set[t])
        hessian = np.zeros((d, d))
        hessian[self.upper] = total[1 + d :]
        hessian = hessian + np.triu(hessian, 1).T
        return total[0], a.T @ total[1 : 1 + d], a.T @ hessian @ a


def _sums(z: np.ndarray, positive: bool, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper Hessian of rows of one label, summed, for each of ``weights``."""
    sign = -1.0 if positive else 1.0
    upper = np.triu_indices(z.shape[1])
    out = np.zeros((len(weights), 1 + z.shape[1] + len(upper[0])))
    for at in range(0, len(z), BLOCK):
        c = z[at : at + BLOCK]
        v = sign * (c @ weights.T)
        e = np.exp(-np.abs(v))
        p = np.where(v >= 0, 1.0, e) / (1 + e)  # of the wrong label
        # a product of a block of numbers between 1 and 2 cannot overflow, and takes one logarithm
        out[:, 0] += np.maximum(v, 0).sum(0) + np.log((1 + e).prod(0))
        out[:, 1 : 1 + z.shape[1]] += sign * (p.T @ c)
        out[:, 1 + z.shape[1] :] += (p * (1 - p)).T @ (c[:, upper[0]] * c[:, upper[1]])
    return out


def fit(
    df: DataFrame, x: str, label: str, cell: str, sets: Sequence[Sequence[int]], models: Sequence[Model], width: int
) -> tuple[np.ndarray, Scaling]:
    """Weights (models x (1 + width), intercept first, for scaled features) and the scaling."""
    scale = scaling(df, x, label, cell, sets, width)
    weights = np.zeros((len(models), width + 1))
    use = [np.array([0, *(c + 1 for c in m.columns)]) for m in models]
    open_ = []
    for i, m in enumerate(models):
        n, pos = scale.rows[m.train], scale.positives[m.train]
        if pos in (0, n):
            weights[i, 0] = 50.0 if n and pos else -50.0  # probability 1 or 0
        else:
            open_.append(i)
    if not open_:
        return weights, scale
    shared_scale = Shared(scale, width)
    learners = {c: [i for i, m in enumerate(models) if c in sets[m.train]] for c in {c for s in sets for c in s}}
    context = df.sparkSession.sparkContext
    before: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(STEPS):
        if not open_:
            break
        shared = context.broadcast((shared_scale.weights(weights, models), set(open_)))

        def partial(arrays: list[np.ndarray]) -> dict[int, np.ndarray]:
            features, y, cells = arrays
            w, todo = shared.value
            out: dict[int, np.ndarray] = {}
            full = np.isfinite(features).all(axis=1)
            for c in np.unique(cells):
                ours = [i for i in learners.get(int(c), ()) if i in todo]
                by_set: dict[int, list[int]] = {}
                for i in ours:
                    by_set.setdefault(models[i].train, []).append(i)
                for positive in (False, True):
                    mine = (cells == c) & ((y == 1) == positive)
                    # rows with gaps look different to every training set, which fills them with its own medians
                    for rows, groups in ((mine & full, [(None, ours)]), (mine & ~full, by_set.items())):
                        if not rows.any():
                            continue
                        for t, group in groups:
                            if not group:
                                continue
                            made = _sums(shared_scale.apply(features[rows], t), positive, w[group])
                            for i, x in zip(group, made):
                                n, pos = scale.rows[models[i].train], scale.positives[models[i].train]
                                x = x * (n / (2 * (pos if positive else n - pos))) if models[i].balanced else x
                                out[i] = out[i] + x if i in out else x
            return out

        sums = summed(df, [F.col(x), F.col(label).cast("double"), F.col(cell).cast("long")], partial)
        still = []
        for i in open_:
            d, own = len(use[i]), weights[i, use[i]]
            penalty = np.full(d, 1 / models[i].strength)
            penalty[0] = 0.0
            loss, gradient, hessian = shared_scale.scaled(sums[i], models[i].train, use[i])
            value = loss + 0.5 * (penalty * own * own).sum()
            if i in before and value > before[i][0] + 1e-9 * abs(value):  # the last step went too far
                weights[i, use[i]] = own = (own + before[i][1]) / 2
                still.append(i)
                continue
            gradient = gradient + penalty * own
            hessian = hessian + np.diag(penalty) + 1e-10 * np.eye(d)
            before[i] = (value, own.copy())
            step = np.linalg.solve(hessian, gradient)
            weights[i, use[i]] = own - step
            # the decrease that is left is of second order in what the last step promised
            if gradient @ step > TOLERANCE * max(1.0, abs(value)) * 1e-2:
                still.append(i)
        shared.unpersist()
        open_ = still
    return weights, scale


def probabilities(features: np.ndarray, t: int, weights: np.ndarray, scale: Scaling) -> np.ndarray:
    """P(label 1) of each row under each of ``weights`` of training set ``t``."""
    return 1 / (1 + np.exp(-np.clip(scale.apply(features, t) @ weights.T, -500, 500)))
