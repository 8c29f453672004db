"""Paired bootstrap on per-unit sums; texts are never scored again.

Every unit gets a Poisson(1) weight per draw from a hash of (seed, unit, draw), so a run can be repeated on any engine; they
are not the draws of a seeded generator in another library. Rows are drawn by cells of alike rows (a Poisson weight with the
cell's size as its mean), seeded by the cell's content.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hyplab.operators.sizing import keep

COUNTS = ("we", "ce", "base_we", "base_ce", "nw", "nc")


def unit_sums(pairs: DataFrame, unit: str, *by: str) -> DataFrame:
    """Per-unit sums of the edit counts of a candidate and its base."""
    return pairs.groupBy(*by, unit).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in COUNTS])


def _poisson_cuts(bits: int = 32) -> list[float]:
    """Upper bounds of the Poisson(1) counts that ``bits`` random bits can tell apart."""
    cuts, term, total, k = [], math.exp(-1), 0.0, 0
    while 1.0 - total > 2.0**-bits:
        total += term
        cuts.append(total)
        k += 1
        term /= k
    return cuts


POISSON_CUTS = _poisson_cuts()


def poisson_weights(df: DataFrame, key: str, seed: int, draws: int) -> DataFrame:
    """One row per (row, draw) with a Poisson(1) weight; weight 0 is left out.

    Row resampling without any join or shuffle. One hash serves eight draws.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 8))).alias("_b")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("_b").cast("string")), 256)
    part = F.expr("transform(sequence(0, 7), j -> named_struct('draw', _b * 8 + j, 'u', conv(substr(_h, j * 8 + 1, 8), 16, 10) / 4294967296.0D))")
    weight = sum(((F.col("u") >= c).cast("int") for c in POISSON_CUTS), F.lit(0))
    staged = df.select("*", blocks).withColumn("_h", h).select(*df.columns, F.inline(part))
    return staged.where(F.col("draw") < draws).withColumn("weight", weight).drop("u").where(F.col("weight") > 0)


def group_draws(units: DataFrame, unit: str, seed: int, draws: int, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Resample whole units with Poisson(1) weights; sums of ``values`` per draw (and per ``by``).

    A unit's weights follow from its name, so the same units weigh alike for every ``by``
    value. Weights are made and summed where the unit's row is: what is shuffled is one row
    per draw and task.
    """
    weighted = poisson_weights(units.select(*by, unit, *values), unit, seed, draws)
    return weighted.groupBy(*by, "draw").agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in values])


def cell_weights(cells: DataFrame, keys: Sequence[str], seed: int, draws: int) -> DataFrame:
    """``cells`` (``n`` alike rows each) once per draw, with the weight that its rows have in it together.

    n independent Poisson(1) weights add up to one Poisson(n) weight, so resampling cells is
    resampling rows, and its cost follows the number of cells. A cell's draws come from a
    generator seeded by its ``keys``: the same on any partitioning and after a retry.
    """
    fields, size = [*cells.columns, "draw", "weight"], cells.columns.index("n")
    at = [cells.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_pylist() for i in at]
            for i, n in enumerate(b.column(size).to_pylist()):
                name = hashlib.sha256(repr((seed, *[c[i] for c in columns])).encode()).digest()
                weight = np.random.default_rng(list(name)).poisson(n, draws)
                some = np.flatnonzero(weight)
                row = b.take(pa.array(np.full(len(some), i)))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(some), pa.array(weight[some])], fields)

    kinds = dict(cells.dtypes)
    return cells.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in cells.columns], "draw long", "weight long"]))


def cell_sums(cells: DataFrame, by: Sequence[str], values: Sequence[str], seed: int, draws: int) -> DataFrame:
    """Weighted sums of ``values`` per ``by`` and draw, from cells of alike rows; a task gives one vector per value and group.

    ``cells`` has ``by``, ``values`` and ``n``; what is shuffled is one row per group and task, whatever the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([b.column(len(by) + j).to_numpy(zero_copy_only=False) for j in range(len(values))]).astype(float)
            n = b.column(len(by) + len(values)).to_numpy()
            groups = list(zip(*[b.column(j).to_pylist() for j in range(len(by))])) if by else [()] * b.num_rows
            for i, group in enumerate(groups):
                name = hashlib.sha256(repr((seed, group, x[i].tolist())).encode()).digest()
                weight = np.random.default_rng(list(name)).poisson(n[i], draws)
                if group not in sums:
                    sums[group] = np.zeros((len(values), draws))
                sums[group] += x[i][:, None] * weight
        for group, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([g]) for g in group], *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in total]], [*by, *values])

    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], *[f"`{v}` array<double>" for v in values]])
    parts = cells.select(*by, *values, "n").mapInArrow(run, schema)
    each = parts.select(*by, F.posexplode(F.arrays_zip(*values)).alias("draw", "v")).select(*by, "draw", "v.*")
    return each.groupBy(*by, "draw").agg(*[F.sum(v).alias(v) for v in values])


def corpus_delta(draws: DataFrame) -> DataFrame:
    """Gain of the candidate over the base per draw (positive is better)."""
    score = lambda w, c: 0.5 * F.col(w) / F.col("nw") + 0.5 * F.col(c) / F.col("nc")
    return draws.withColumn("delta", score("base_we", "base_ce") - score("we", "ce"))


def summary(draws: DataFrame, *by: str) -> DataFrame:
    """Mean, percentiles and sign shares of the draws."""
    q = F.percentile("delta", F.array(*[F.lit(x) for x in (0.025, 0.05, 0.5, 0.95, 0.975)]))
    out = draws.groupBy(*by).agg(
        F.count("*").alias("draws"), F.avg("delta").alias("mean"), q.alias("_q"),
        F.avg((F.col("delta") > 0).cast("int")).alias("p_gt_0"), F.avg((F.col("delta") >= 0).cast("int")).alias("p_ge_0"),
    )
    names = ("p2_5", "p5", "p50", "p95", "p97_5")
    return out.select(*by, "draws", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "p_gt_0", "p_ge_0")


def group_bootstrap(pairs: DataFrame, unit: str, seed: int, draws: int, *by: str) -> DataFrame:
    """Whole units resampled, pooled rates per draw."""
    units = keep(unit_sums(pairs, unit, *by))
    return summary(corpus_delta(group_draws(units, unit, seed, draws, COUNTS, by)), *by)


def row_bootstrap(pairs: DataFrame, seed: int, draws: int, *by: str) -> DataFrame:
    """Rows resampled with Poisson weights, pooled rates per draw. Rows with the same counts are drawn together."""
    cells = pairs.groupBy(*by, *COUNTS).agg(F.count("*").alias("n"))
    return summary(corpus_delta(cell_sums(cells, by, COUNTS, seed, draws)), *by)


def row_mean_bootstrap(pairs: DataFrame, unit: str, seed: int, draws: int, *by: str) -> DataFrame:
    """Whole units resampled, mean of the per-row gains per draw."""
    e = lambda w, c: 0.5 * (F.col(w) / F.greatest("nw", F.lit(1)) + F.col(c) / F.greatest("nc", F.lit(1)))
    units = keep(pairs.groupBy(*by, unit).agg(F.sum(e("base_we", "base_ce") - e("we", "ce")).alias("gain"), F.count("*").alias("n")))
    drawn = group_draws(units, unit, seed, draws, ("gain", "n"), by)
    return summary(drawn.withColumn("delta", F.col("gain") / F.col("n")), *by)
