"""Draws of cells against draws of rows, and fits on drawn distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyplab.operators import calibrate as C, resample as R

DRAWS = 2000


def pairs_frame(spark, n=400, copies=1):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), int(c), int(d), 12, 60) for a, b, c, d in rng.integers(0, 5, (n, 4))] * copies
    return rows, spark.createDataFrame(rows, "we long, ce long, base_we long, base_ce long, nw long, nc long")


def deltas(x, weight):
    we, ce, bwe, bce, nw, nc = (weight @ x[:, j] for j in range(6))
    return 0.5 * bwe / nw + 0.5 * bce / nc - 0.5 * we / nw - 0.5 * ce / nc


def test_row_bootstrap_by_cells_agrees_with_drawing_rows(spark):
    rows, df = pairs_frame(spark)
    got = R.row_bootstrap(df, 7, DRAWS).first()
    x = np.array(rows, float)
    want = deltas(x, np.random.default_rng(1).poisson(1, (DRAWS, len(x))))
    spread = want.std()
    assert got["draws"] == DRAWS
    assert abs(got["mean"] - want.mean()) < 5 * spread / np.sqrt(DRAWS)
    for name, q in (("p2_5", 2.5), ("p50", 50), ("p97_5", 97.5)):
        assert abs(got[name] - np.percentile(want, q)) < 0.25 * spread


def test_draws_do_not_depend_on_partitions(spark):
    _, df = pairs_frame(spark, 60)
    cells = df.groupBy(*R.COUNTS).agg(F.count("*").alias("n"))
    one = R.cell_sums(cells.coalesce(1), (), R.COUNTS, 3, 20).orderBy("draw").collect()
    many = R.cell_sums(cells.repartition(7), (), R.COUNTS, 3, 20).orderBy("draw").collect()
    assert one == many


def test_shuffled_rows_do_not_grow_with_the_table(spark):
    _, small = pairs_frame(spark, 50)
    _, large = pairs_frame(spark, 50, copies=40)
    cells = [df.groupBy(*R.COUNTS).agg(F.count("*").alias("n")) for df in (small, large)]
    assert cells[0].count() == cells[1].count()
    assert R.cell_sums(cells[1], (), R.COUNTS, 1, DRAWS).agg(F.avg("nw")).first()[0] == pytest.approx(50 * 40 * 12, rel=0.01)


def test_cell_weights_have_the_cell_as_mean_and_variance(spark):
    cells = spark.createDataFrame([("a", 0, 3), ("a", 1, 900), ("b", 0, 0)], "sample string, k int, n long")
    drawn = R.cell_weights(cells, ("sample", "k"), 4, DRAWS)
    got = {(r["sample"], r["k"]): r for r in drawn.groupBy("sample", "k").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q")).collect()}
    for (sample, k), n in ((("a", 0), 3), (("a", 1), 900)):
        mean = got[sample, k]["s"] / DRAWS
        assert mean == pytest.approx(n, rel=0.06) and got[sample, k]["q"] / DRAWS - mean**2 == pytest.approx(n, rel=0.15)
    assert ("b", 0) not in got and drawn.count() == drawn.select("sample", "k", "draw").distinct().count()


def test_fit_bootstrap_by_cells_agrees_with_resampling_values(spark):
    rng = np.random.default_rng(8)
    grid = (0.1, 0.2, 0.4, 0.8, 1.6)
    a, b = rng.gamma(1.0, 0.2, 300), rng.gamma(4.0, 0.2, 300)
    t = np.concatenate([rng.gamma(1.0, 0.2, 120), rng.gamma(4.0, 0.2, 80)])
    df = spark.createDataFrame([(s, float(v)) for s, x in (("a", a), ("b", b), ("t", t)) for v in x], "sample string, value double")
    cells = C.grid_cells(df, F.col("value"), "sample", grid)
    shares = C.cell_shares(R.cell_weights(cells, ("sample", "k"), 11, 1000).select("draw", "sample", "k", F.col("weight").alias("n")), "sample", grid, "draw")
    got = np.array([r["pi"] for r in C.mixture_two(shares, "sample", "t", "a", "b", "draw").collect()])
    cdf = lambda x: np.array([(x <= g).mean() for g in grid])
    want = []
    for _ in range(1000):
        fa, fb, ft = (cdf(rng.choice(x, len(x))) for x in (a, b, t))
        want.append(np.clip((fa - fb) @ (ft - fb) / ((fa - fb) @ (fa - fb)), 0, 1))
    assert len(got) == 1000
    assert abs(got.mean() - np.mean(want)) < 0.25 * np.std(want)
    for q in (2.5, 97.5):
        assert abs(np.percentile(got, q) - np.percentile(want, q)) < 0.4 * np.std(want)


def test_shares_equal_direct_counts(spark):
    values = [0.05, 0.1, 0.15, 5.0, 0.2]
    df = spark.createDataFrame([("s", v) for v in values], "sample string, value double")
    got = {r["t"]: r["share"] for r in C.ecdf(df, F.col("value"), "sample", (0.1, 0.2, 1.0)).collect()}
    assert got == {g: sum(v <= g for v in values) / 5 for g in (0.1, 0.2, 1.0)}
