"""Threshold calibration: one sort or one pass to cells, never one scan per threshold."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.functions import fixed
from hyplab.operators import ordering as O
from hyplab.operators.score import with_rates
from hyplab.operators.sizing import keep

INF = float("inf")


def one_row(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a table that is one row by construction."""
    return df.join(F.broadcast(scalars), F.lit(True))


def score_axis(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Distinct scores with inclusive running counts of both classes from below, and totals.

    Equal scores are summed first; the running sums go over parallel buckets.
    """
    counts = keep(df.groupBy(score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))
    points = O.split_points(counts, score)
    cum = O.running_totals(
        counts.withColumns({"n_pos_at": F.col("pos"), "n_neg_at": F.col("neg")}), [score],
        O.bucket_of(F.col(score), points), {"pos": F.col("pos"), "neg": F.col("neg")},
    )
    totals = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    return one_row(cum, totals)


def best_threshold(df: DataFrame, score: str, positive: Column, max_fpr: float = 0.05) -> DataFrame:
    """Highest TPR with FPR at most ``max_fpr``, then lower FPR, then the first in ascending order.

    Candidates are the scores, the midpoints to the next score, and two points just above
    the largest negative score. A midpoint accepts what the next score accepts, so the
    winner of a step between two scores is its midpoint. No candidate or an empty class
    gives +inf and accepts nothing.
    """
    axis = keep(score_axis(df, score, positive))
    s = F.col(score)
    # a point between u and the next score accepts all rows that the counts at u leave
    next_score = _next_value(axis, score)
    at_score = axis.select(
        s.alias("thr"), (F.col("n_pos") - F.col("pos") + F.col("n_pos_at")).alias("tp"), (F.col("n_neg") - F.col("neg") + F.col("n_neg_at")).alias("fp"),
        "n_pos", "n_neg",
    )
    between = next_score.where(F.col("_next").isNotNull()).select(
        (0.5 * (s + F.col("_next"))).alias("thr"), (F.col("n_pos") - F.col("pos")).alias("tp"), (F.col("n_neg") - F.col("neg")).alias("fp"), "n_pos", "n_neg"
    )
    top_neg = axis.where("n_neg_at > 0").agg(F.max(score).alias("_m"))
    # just above the largest negative score
    points = top_neg.where(F.col("_m").isNotNull()).select(F.explode(F.array(F.col("_m") + 1e-9, F.col("_m") + 1e-3)).alias("thr"))
    above = _above_points(axis, points, score)
    cands = at_score.unionByName(between).unionByName(above).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    rated = cands.withColumns({"tpr": F.col("tp") / F.col("n_pos"), "fpr": F.col("fp") / F.col("n_neg")})
    ok = rated.where(F.col("fpr") <= max_fpr + 1e-12)
    order = F.struct((-F.col("tp")).alias("a"), F.col("fp").alias("b"), F.col("thr").alias("c"))
    best = ok.agg(F.min_by(F.struct("thr", "tp", "fp", "tpr", "fpr"), order).alias("b"), F.count_distinct("thr").alias("candidates_ok"))
    totals = df.agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    zero = F.lit(0.0)
    note = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "empty_class_fail_closed").when(F.col("b").isNull(), "no_threshold_fail_closed").otherwise("calibrated")
    return one_row(totals, best).select(
        F.coalesce("b.thr", F.lit(INF)).alias("threshold"), F.coalesce("b.tp", F.lit(0)).alias("tp"), F.coalesce("b.fp", F.lit(0)).alias("fp"),
        F.coalesce("b.tpr", zero).alias("tpr"), F.coalesce("b.fpr", zero).alias("fpr"), "n_pos", "n_neg", "candidates_ok", note.alias("note"),
    )


def _next_value(axis: DataFrame, score: str) -> DataFrame:
    """The following distinct score, without one global sort.

    Inside a bucket it is the next row; the last row of a bucket takes the smallest
    score of the next non-empty bucket (one row per bucket).
    """
    points = O.split_points(axis, score)
    b = axis.withColumn("_b", O.bucket_of(F.col(score), points))
    firsts = b.groupBy("_b").agg(F.min(score).alias("_first"))
    following = firsts.select("_b", F.lead("_first").over(W.partitionBy(F.lit(0)).orderBy("_b")).alias("_after"))
    inside = F.lead(score).over(W.partitionBy("_b").orderBy(score))
    return b.withColumn("_in", inside).join(F.broadcast(following), "_b").withColumn("_next", F.coalesce("_in", "_after")).drop("_b", "_in", "_after")


def _above_points(axis: DataFrame, points: DataFrame, score: str) -> DataFrame:
    """True and false accepts at two given thresholds, from one pass over the distinct scores."""
    wide = points.agg(F.array_sort(F.collect_list("thr")).alias("_t"))  # two numbers
    rows = one_row(axis.select(F.col(score).alias("_s"), "n_pos_at", "n_neg_at", "n_pos", "n_neg"), wide)
    return (
        rows.select("*", F.explode("_t").alias("thr"))
        .groupBy("thr").agg(
            F.sum(F.when(F.col("_s") >= F.col("thr"), F.col("n_pos_at")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("_s") >= F.col("thr"), F.col("n_neg_at")).otherwise(0)).alias("fp"),
            F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        )
    )


def grid_calibration(df: DataFrame, positive: Column, max_fpr: float = 0.05, grid: dict[str, Sequence[float]] = fixed.MASS_GRID) -> DataFrame:
    """Best of the four-threshold grid, ties by lower FPR and then grid order; closed when none fits.

    Rows are reduced to their grid cells first, so the grid meets at most
    9 x 7 x 7 x 6 cells whatever the size of the table.
    """
    a, b, c = F.col("mass_a"), F.col("mass_b"), F.col("mass_c")
    passed = lambda values, test: F.size(F.filter(F.array(*[F.lit(v) for v in values]), test))
    cells = df.groupBy(
        passed(grid["min_a"], lambda v: a >= v).alias("ka"),  # ascending bound: the first ka pass
        passed(grid["max_b"], lambda v: b > v).alias("kb"),  # the first kb fail
        passed(grid["min_margin"], lambda v: (a - b) >= v).alias("km"),
        passed(grid["max_c"], lambda v: c > v).alias("kc"),
    ).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    combos = list(product(*[range(len(grid[k])) for k in ("min_a", "max_b", "min_margin", "max_c")]))
    spark = df.sparkSession
    configs = spark.createDataFrame(
        [(i, *combo, *[float(grid[k][x]) for k, x in zip(("min_a", "max_b", "min_margin", "max_c"), combo)]) for i, combo in enumerate(combos)],
        "config int, ia int, ib int, im int, ic int, min_a double, max_b double, min_margin double, max_c double",
    )
    take = (F.col("ia") < F.col("ka")) & (F.col("ib") >= F.col("kb")) & (F.col("im") < F.col("km")) & (F.col("ic") >= F.col("kc"))
    names = ["config", "min_a", "max_b", "min_margin", "max_c"]
    # both sides are bounded by the grid
    rated = cells.join(F.broadcast(configs), F.lit(True)).groupBy(*names).agg(
        F.sum(F.when(take, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(take, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )
    rate = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    ok = rated.withColumns({"tpr": rate("tp", "n_pos"), "fpr": rate("fp", "n_neg")}).where(F.col("fpr") <= max_fpr + 1e-12)
    best = ok.agg(
        F.min_by(F.struct(*names[1:], "tp", "fp", "tpr", "fpr"), F.struct(-F.col("tp"), F.col("fp"), F.col("config"))).alias("b"),
        F.count("*").alias("candidates_ok"),
    )
    closed = {"min_a": 1.01, "max_b": -0.01, "min_margin": 1.01, "max_c": -0.01}
    return best.select(
        *[F.coalesce(f"b.{k}", F.lit(v)).alias(k) for k, v in closed.items()],
        F.coalesce("b.tp", F.lit(0)).alias("tp"), F.coalesce("b.fp", F.lit(0)).alias("fp"),
        F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"), "candidates_ok",
        F.when(F.col("b").isNull(), "fail_closed_zero_accept").otherwise("calibrated").alias("note"),
    )


def margin_sweep(df: DataFrame, delta: Column, positive: Column, margins: Sequence[float]) -> DataFrame:
    """Per margin the rates and the corpus score of taking ``alt`` where delta >= margin.

    ``df`` has alt_we, alt_ce, base_we, base_ce, nw, nc. One pass to len(margins)+1 cells.
    """
    # read twice, so it stays a column: in the lambda alone it would be worked out anew for every margin
    df, d = df.withColumn("_delta", delta), F.col("_delta")
    k = F.when(d.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(float(m)) for m in margins]), lambda m: d >= m)))
    names = ("alt_we", "alt_ce", "base_we", "base_ce", "nw", "nc")
    cells = df.groupBy(k.alias("k")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"), *[F.sum(c).alias(c) for c in names])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(m)).alias("margin")) for i, m in enumerate(margins)])
    take = F.col("k") > F.col("i")
    pick = lambda c: F.sum(F.when(take, F.col(f"alt_{c}")).otherwise(F.col(f"base_{c}"))).alias(c)
    swept = cells.select("*", F.inline(steps)).groupBy("margin").agg(
        F.sum(F.when(take, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(take, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pick("we"), pick("ce"), F.sum("nw").alias("nw"), F.sum("nc").alias("nc"),
    )
    rate = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    return with_rates(swept).select(
        "margin", rate("tp", "n_pos").alias("tpr"), rate("fp", "n_neg").alias("fpr"), (F.col("tp") + F.col("fp")).alias("n_accept"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)).alias("precision"),
        "wer", "cer", "score",
    )


def best_margin(sweep: DataFrame, max_fpr: float = 0.10) -> DataFrame:
    """Highest TPR then lowest score under the cap, the first margin on ties; else the lowest FPR."""
    capped = F.col("fpr") <= max_fpr
    order = F.struct(
        (~capped).cast("int"), F.when(capped, F.lit(0.0)).otherwise(F.col("fpr")), -F.col("tpr"), F.round("score", 12), F.col("margin")
    )
    return sweep.agg(F.min_by(F.struct(*sweep.columns), order).alias("b")).select("b.*")


def capped_threshold(df: DataFrame, score: str, is_probe: Column, max_fpr: float, min_accept: int) -> DataFrame:
    """Loosest threshold with the share of negative probes at or above it under the cap.

    Among thresholds under the cap the one with the most accepted targets; on ties the
    lowest. If that accepts fewer than ``min_accept`` the result is the same threshold,
    since lower ones only raise the share.
    """
    axis = score_axis(df, score, is_probe)  # pos = probes, neg = targets
    at = axis.select(
        F.col(score).alias("threshold"), (F.col("n_pos") - F.col("pos") + F.col("n_pos_at")).alias("probes"),
        (F.col("n_neg") - F.col("neg") + F.col("n_neg_at")).alias("accepted"), "n_pos",
    ).withColumn("fpr", F.coalesce(F.try_divide(F.col("probes").cast("double"), F.col("n_pos").cast("double")), F.lit(1.0)))
    ok = at.where(F.col("fpr") <= max_fpr + 1e-12)
    best = ok.agg(F.min_by(F.struct("threshold", "fpr", "accepted"), F.struct(-F.col("accepted"), F.col("threshold"))).alias("b"))
    return best.select("b.*").withColumn("enough", F.col("accepted") >= min_accept)


def zero_false_accepts(df: DataFrame, value: Column, thresholds: Sequence[float], *by: str) -> DataFrame:
    """False accepts and rate per threshold (value <= t) on negatives, and whether it is safe."""
    steps = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (value <= t).cast("int").alias("hit")) for t in thresholds])
    return df.select(*by, F.inline(steps)).groupBy(*by, "threshold").agg(
        F.sum("hit").alias("false_accepts"), F.avg("hit").alias("fpr")
    ).withColumn("safe", F.col("false_accepts") == 0)


def safe_threshold(table: DataFrame, *by: str) -> DataFrame:
    return table.groupBy(*by).agg(F.max(F.when(F.col("safe"), F.col("threshold"))).alias("threshold"))


def best_accuracy(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Best accuracy over the 1..99 percentiles of the score (predict positive above the cut).

    Percentiles are exact; rows meet the cuts as counts per percentile band.
    """
    qs = [i / 100 for i in range(1, 100)]
    cuts = O.quantiles(df, score, qs).select(F.array(*[F.col(f"q{i}") for i in range(1, 100)]).alias("_c"))
    rows = one_row(df.select(F.col(score).alias("_s"), positive.alias("_y")), cuts)
    bands = rows.groupBy(F.size(F.filter("_c", lambda c: F.col("_s") > c)).alias("k")).agg(
        F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg")
    )
    spread = one_row(bands, cuts).select("k", "pos", "neg", F.posexplode("_c").alias("i", "threshold"))
    acc = spread.groupBy("i", "threshold").agg(
        (F.sum(F.when(F.col("k") > F.col("i"), F.col("pos")).otherwise(F.col("neg"))) / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy")
    )
    return acc.agg(F.min_by(F.struct("threshold", "accuracy"), F.struct(-F.round("accuracy", 12), F.col("i"))).alias("b")).select("b.*")


# --- distribution fits ---------------------------------------------------------------------------


def grid_cells(df: DataFrame, value: Column, sample: str, grid: Sequence[float], *by: str) -> DataFrame:
    """Rows per sample and grid cell: k is the first grid point at or above the value (len(grid) beyond it), n the count.

    Equal values are counted first, so a value is worked out once per row and meets the grid once.
    """
    equal = df.groupBy(*by, sample, value.alias("_value")).agg(F.count("*").alias("_n"))
    k = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g < F.col("_value")))
    return equal.groupBy(*by, sample, k.alias("k")).agg(F.sum("_n").alias("n"))


def cell_shares(cells: DataFrame, sample: str, grid: Sequence[float], *by: str) -> DataFrame:
    """Empirical distribution on a grid from the rows per cell: share of values at or below each grid point."""
    total = F.sum("n").over(W.partitionBy(*by, sample))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("t")) for i, g in enumerate(grid)])
    return cells.withColumn("_total", total).select(*by, sample, "k", "n", "_total", F.inline(steps)).groupBy(*by, sample, "i", "t").agg(
        (F.sum(F.when(F.col("k") <= F.col("i"), F.col("n")).otherwise(0)) / F.max("_total")).alias("share")
    )


def ecdf(df: DataFrame, value: Column, sample: str, grid: Sequence[float], *by: str) -> DataFrame:
    """Empirical distribution on a grid: one row per (sample, grid point), share of values at or below it."""
    return cell_shares(grid_cells(df, value, sample, grid, *by), sample, grid, *by)


def mixture_two(cdf: DataFrame, sample: str, test: str, a: str, b: str, *by: str) -> DataFrame:
    """Share of class a in the test sample by least squares on the grid, clipped; fit and null error."""
    of = lambda s: F.max(F.when(F.col(sample) == s, F.col("share")))
    g = cdf.groupBy(*by, "t").agg(*[F.coalesce(of(s), F.lit(0.0)).alias(k) for k, s in (("ft", test), ("fa", a), ("fb", b))])
    d, y = F.col("fa") - F.col("fb"), F.col("ft") - F.col("fb")
    fit = g.groupBy(*by).agg(
        F.sum(d * d).alias("dd"), F.sum(d * y).alias("dy"), F.sum(y * y).alias("yy"), F.count("*").alias("m")
    )
    pi = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dy") / F.col("dd")))
    # sum (y - pi d)^2 in closed form
    rss = F.greatest(F.lit(0.0), F.col("yy") - 2 * F.col("pi") * F.col("dy") + F.col("pi") * F.col("pi") * F.col("dd"))
    return fit.where(F.col("dd") > 0).withColumn("pi", pi).select(
        *by, "pi", F.sqrt(rss / F.col("m")).alias("rmse"), F.sqrt(F.col("yy") / F.col("m")).alias("rmse_null")
    )


def simplex_weights(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with non-negative weights that sum to one, by trying every support.

    On a fixed support the sum constraint is removed by substitution; the best feasible
    support is the exact optimum. Columns are few.
    """
    m = a.shape[1]
    best, best_rss = np.full(m, 1.0 / m), np.inf
    for mask in range(1, 1 << m):
        idx = [j for j in range(m) if mask >> j & 1]
        last, rest = idx[-1], idx[:-1]
        w = np.zeros(m)
        if rest:
            sol = np.linalg.lstsq(a[:, rest] - a[:, [last]], y - a[:, last], rcond=None)[0]
            w[rest] = sol
        w[last] = 1.0 - w[rest].sum()
        if (w >= -1e-12).all():
            rss = float(((y - a @ w) ** 2).sum())
            if rss < best_rss - 1e-15:
                best, best_rss = np.clip(w, 0.0, None), rss
    return best / best.sum()


def mixture_three(cdf: DataFrame, sample: str, test: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-negative class weights that sum to one, per group; the grid is a few dozen points."""
    of = lambda s: F.coalesce(F.max(F.when(F.col(sample) == s, F.col("share"))), F.lit(0.0))
    keys = list(by) or ["_all"]
    src = cdf if by else cdf.withColumn("_all", F.lit(0))
    grid = src.groupBy(*keys, "t").agg(of(test).alias("y"), *[of(c).alias(f"x{i}") for i, c in enumerate(classes)])

    def fit(pdf):
        a, y = pdf[[f"x{i}" for i in range(len(classes))]].to_numpy(float), pdf["y"].to_numpy(float)
        w = simplex_weights(a, y)
        out = pdf[keys].iloc[:1].copy()
        for i, x in enumerate(w):
            out[f"w{i}"] = x
        out["rmse"] = float(np.sqrt(np.mean((y - a @ w) ** 2)))
        return out

    types = dict(src.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"w{i} double" for i in range(len(classes))], "rmse double"])
    out = grid.groupBy(*keys).applyInPandas(fit, schema)
    named = [F.col(f"w{i}").alias(f"weight_{c}") for i, c in enumerate(classes)]
    return out.select(*by, *named, "rmse")


def decision_table(cdf: DataFrame, sample: str, test: str, classes: Sequence[str], weights: DataFrame, n_test: DataFrame,
                   gain: float = fixed.SWAP_GAIN, losses: Sequence[float] = (fixed.SWAP_LOSS_B, fixed.SWAP_LOSS_C)) -> DataFrame:
    """Accept rates, observed and predicted accepts, precision and value per threshold.

    ``weights`` is the one-row result of ``mixture_three``; ``n_test`` one row with n.
    """
    of = lambda s: F.coalesce(F.max(F.when(F.col(sample) == s, F.col("share"))), F.lit(0.0))
    rates = cdf.groupBy(F.col("t").alias("threshold")).agg(of(test).alias("test_rate"), *[of(c).alias(f"rate_{c}") for c in classes])
    j = one_row(one_row(rates, weights), n_test)
    hits = [F.col(f"weight_{c}") * F.col("n") * F.col(f"rate_{c}") for c in classes]
    predicted = hits[0]
    for h in hits[1:]:
        predicted = predicted + h
    lost = F.lit(0.0)
    for h, loss in zip(hits[1:], losses):
        lost = lost + h * loss
    share = lambda x: F.when(predicted > 0, x / predicted).otherwise(0.0)
    return j.select(
        "threshold", *[f"rate_{c}" for c in classes], F.round(F.col("test_rate") * F.col("n")).cast("long").alias("observed"),
        predicted.alias("predicted"), share(hits[0]).alias("precision"),
        (share(hits[0] * gain) - share(lost)).alias("value_per_row"), (hits[0] * gain - lost).alias("value_total"),
    )


def expected_delta(df: DataFrame, changed: Column, precision: Column, total: Column, gain: float, loss: float, floor: Column) -> DataFrame:
    """Unit gain, delta and projected score of changing rows at a given precision; no change is no gain."""
    unit = precision * gain - (1.0 - precision) * loss
    some = changed > 0
    return df.withColumns({
        "unit_gain": F.when(some, unit).otherwise(0.0),
        "delta": F.when(some, changed / total * unit).otherwise(0.0),
        "projected": F.when(some, floor + changed / total * unit).otherwise(floor),
    })


def projection_grid(df: DataFrame, mass: Column, true_score: Column, false_score: Column, p_true: Sequence[float], other: Sequence[float]) -> DataFrame:
    """Weighted projection over assumed precision and the score of the remaining rows."""
    rows = [F.struct(F.lit(float(p)).alias("p_true"), F.lit(float(z)).alias("z_other")) for p, z in product(p_true, other)]
    z = F.col("p_true") * true_score + (1.0 - F.col("p_true")) * false_score
    return df.select("*", F.inline(F.array(*rows))).withColumn("projected", mass * z + (1.0 - mass) * F.col("z_other"))
