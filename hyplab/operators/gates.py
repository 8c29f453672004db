"""Accept rules with reasons, feature coercion and ban checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.functions import distance as D, fixed, text as T
from hyplab.operators.sizing import keep


def mass_gate(a: Column, b: Column, c: Column, *, min_a: float, max_b: float, min_margin: float, max_c: float) -> Column:
    """Four thresholds; struct(accept, reason) with the first failing test. A missing mass fails."""
    no = lambda reason: F.struct(F.lit(False).alias("accept"), F.lit(reason).alias("reason"))
    missing = a.isNull() | b.isNull() | c.isNull()
    return (
        F.when(missing | (a < min_a), no("mass_a_low"))
        .when(b > max_b, no("mass_b_high"))
        .when((a - b) < min_margin, no("margin_low"))
        .when(c > max_c, no("mass_c_high"))
        .otherwise(F.struct(F.lit(True).alias("accept"), F.lit("accept").alias("reason")))
    )


def confusion_rates(df: DataFrame, predicted: Column, positive: Column, *by: str) -> DataFrame:
    """N, tp, fp, tn, fn, tpr, fpr; an empty class gives rate 0."""
    p, y = F.coalesce(predicted, F.lit(False)), positive
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
    )
    rate = lambda x, total: F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), F.lit(0.0))
    return out.withColumns({
        "tpr": rate(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": rate(F.col("fp"), F.col("fp") + F.col("tn")),
    })


def lid_mass_ok(p1: Column, lang2: Column, *, min_p1: float = 0.99, rivals: tuple[str, ...] = fixed.FAMILIES["ach"], junk: tuple[str, ...] = fixed.JUNK_CODES) -> Column:
    second = F.lower(F.coalesce(lang2, F.lit("")))
    return (p1 >= min_p1) & ~second.isin(*rivals, *junk)


def strict_ortho_ok(ortho: Column, lp_delta: Column, min_ortho: float = 2.4, min_lp_delta: float = 0.0) -> Column:
    return (ortho >= min_ortho) & (lp_delta > min_lp_delta)


def soft_agreement_ok(error: Column, ortho: Column, lp_delta: Column, lo: float = 0.15, hi: float = 0.22, min_ortho: float = 2.8) -> Column:
    """The error band counts only together with a strict orthography test."""
    return (error > lo) & (error <= hi) & strict_ortho_ok(ortho, lp_delta, min_ortho)


def residual_stack(
    df: DataFrame, *, min_ortho: float = 2.4, min_lp_delta: float = 0.0, min_p1: float = 0.99, min_similarity: float | None = 0.35,
    max_similarity: float | None = None, rivals: tuple[str, ...] = fixed.FAMILIES["ach"], junk: tuple[str, ...] = fixed.JUNK_CODES,
) -> DataFrame:
    """The ordered tests of a residual candidate; adds accept, reason and similarity.

    Columns: floor_hyp, new_hyp (normalised), p1, lang2, ortho, lp_own, lp_rival, error, already_dual.
    """
    floor, new = F.col("floor_hyp"), F.col("new_hyp")
    delta = F.col("lp_own") - F.col("lp_rival")
    staged = df.withColumns({"_fw": T.words(floor), "_nw": T.words(new), "_delta": delta}).withColumn(
        "similarity", D.similarity(floor, new)
    )
    sim, d = F.col("similarity"), F.col("_delta")
    a = strict_ortho_ok(F.col("ortho"), d, min_ortho, min_lp_delta)
    b = soft_agreement_ok(F.col("error"), F.col("ortho"), d)
    low = F.lit(False) if min_similarity is None else (sim < min_similarity) & ((F.col("ortho") < 3.0) | (d <= 0.05))
    high = F.lit(False) if max_similarity is None else sim >= max_similarity
    reason = (
        F.when(F.col("already_dual"), "already_dual")
        .when((new == "") | (new == ".") | (new == floor), "empty_or_same")
        .when(~D.length_ok(new, floor), "length_guard")
        .when(~T.structure_ok(F.col("_nw"), F.col("_fw")), "structure_fail")
        .when(~lid_mass_ok(F.col("p1"), F.col("lang2"), min_p1=min_p1, rivals=rivals, junk=junk), "lid_mass_fail")
        .when(low, "low_similarity_without_strict_ortho")
        .when(high, "similarity_too_high")
        .when(a & b, "strict+soft").when(a, "strict").when(b, "soft")
        .otherwise("no_path")
    )
    return staged.withColumn("reason", reason).withColumn("accept", F.col("reason").isin("strict+soft", "strict", "soft")).drop("_fw", "_nw", "_delta")


def coerce(df: DataFrame, numbers: Mapping[str, float], texts: Mapping[str, tuple[str, ...]], flags: tuple[str, ...] = ()) -> DataFrame:
    """Typed features; a missing *or zero* number becomes its default, the first non-empty text wins."""
    have = set(df.columns)
    out = {}
    for name, default in numbers.items():
        c = F.col(name).cast("double") if name in have else F.lit(None).cast("double")
        out[name] = F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(float(default)))
    for name, sources in texts.items():
        options = [F.when(F.col(s) != "", F.col(s)) for s in sources if s in have]
        out[name] = F.coalesce(*options, F.lit(""))
    for name in flags:
        out[name] = F.coalesce(F.col(name).cast("string").isin("true", "True", "1"), F.lit(False)) if name in have else F.lit(False)
    return df.withColumns(out)


def mass_rewrite(changed: Column, total: Column, limit: float = 0.25) -> Column:
    """More than a quarter of all rows would change, or there are no rows."""
    return (total <= 0) | (changed / total > limit)


def confidence_only(own: Column, rival: Column, margin: float = 0.0) -> Column:
    """The gate would be nothing but a confidence comparison."""
    return (own - rival) > margin


def pool_gates(df: DataFrame, key: str, thr: float, thr_hi: float | None = None, tops: tuple[int, ...] = (15, 30, 50)) -> DataFrame:
    """All named gates of a scored pool as long rows (key, gate).

    Columns: ortho, ngram, marker, p1, error, conf_delta. The top-k gates need only the
    first rows by ortho, a distributed top-n.
    """
    hi = thr_hi if thr_hi is not None else max(thr + 0.4, 3.0)
    o, p, e = F.col("ortho"), F.col("p1"), F.col("error")
    gates = {
        "p99": (o >= thr) & (p >= 0.99), "o05_p99": (o >= hi) & (p >= 0.99),
        "conf": (o >= thr * 0.85) & (F.coalesce("conf_delta", F.lit(-1.0)) >= 0.0) & (p >= 0.95),
        "dualsoft": (o >= thr) & (e <= 0.28) & (p >= 0.99), "dual15": (o >= thr) & (e <= 0.15) & (p >= 0.99),
        "o3_p99": (o >= 3.0) & (p >= 0.99), "o24_p99": (o >= 2.4) & (p >= 0.99), "o20_p99": (o >= 2.0) & (p >= 0.99),
        "ngram_marker": (F.col("ngram") >= 0.15) & (F.col("marker") >= 2.0) & (p >= 0.99) & (o >= thr),
    }
    rows = F.array(*[F.when(c, F.lit(name)) for name, c in gates.items()])
    df = keep(df.select(key, "ortho", "ngram", "marker", "p1", "error", "conf_delta"))  # the scoring plan runs once
    flagged = df.select(key, F.explode(F.filter(rows, lambda g: g.isNotNull())).alias("gate"))
    # the bounded head is taken once and labelled by rank
    head = df.select(key, "ortho").orderBy(F.desc("ortho"), key).limit(max(tops))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("ortho"), key))
    labels = F.array(*[F.when(F.col("_r") <= k, F.lit(f"top{k}")) for k in tops])
    best = head.withColumn("_r", rank).select(key, F.explode(F.filter(labels, lambda g: g.isNotNull())).alias("gate"))
    return flagged.unionByName(best)
