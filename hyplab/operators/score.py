"""Corpus scores: every score is a ratio of sums over edit counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.functions import distance as D, text as T
from hyplab.operators.ordering import quantiles

WORD_WEIGHT = CHAR_WEIGHT = 0.5


def ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def with_rates(df: DataFrame) -> DataFrame:
    """Add wer, cer and score to a table of summed edit counts."""
    wer, cer = ratio(F.col("we"), F.col("nw")), ratio(F.col("ce"), F.col("nc"))
    return df.withColumns({"wer": wer, "cer": cer, "score": WORD_WEIGHT * wer + CHAR_WEIGHT * cer})


def sums(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("we", "ce", "nw", "nc")]
    )


def corpus_scores(counts: DataFrame, *by: str) -> DataFrame:
    """pooled WER, CER and weighted score per group; no rows score 0."""
    return with_rates(sums(counts, by))


def scores_with_total(counts: DataFrame, keys: Sequence[str], level: str, total: str = "overall") -> DataFrame:
    """scores per ``keys`` and ``level`` plus one ``total`` row per ``keys``.

    The fact table is aggregated once; the grouping sets run on the summed rows.
    """
    fine = sums(counts, [*keys, level])
    rolled = fine.groupingSets([[*keys, level], [*keys]], *keys, level).agg(
        F.grouping(level).alias("_all"), *[F.sum(c).alias(c) for c in ("n", "we", "ce", "nw", "nc")]
    )
    label = F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(level))
    return with_rates(rolled.withColumn(level, label).drop("_all"))


def macro_scores(counts: DataFrame, *by: str) -> DataFrame:
    """mean row error and square-root-length weighted error.

    Rows without a reference are an error here, so score with ``sentinel=False``.
    """
    nw = F.when(F.col("nw") > 0, F.col("nw")).otherwise(F.raise_error(F.lit("empty reference in a macro score")))
    w, c = F.col("we") / nw, F.col("ce") / F.col("nc")
    rw, rc = F.sqrt("nw"), F.sqrt("nc")
    return counts.groupBy(*by).agg(
        F.avg(w).alias("macro_wer"),
        F.avg(c).alias("macro_cer"),
        (F.sum(w * rw) / F.sum(rw)).alias("sqrt_wer"),
        (F.sum(c * rc) / F.sum(rc)).alias("sqrt_cer"),
    )


def regime_scores(df: DataFrame, reference: str, hypothesis: str, *by: str, unicode_form: bool = True) -> DataFrame:
    """every scoring regime under three comparisons, in one pass.

    symmetric: both sides transformed; counterfactual: only the hypothesis;
    mixed: words from stripped text, characters from kept text.
    """
    ref, hyp = F.col(reference), F.col(hypothesis)
    forms = {
        "keep": lambda c: T.keep(c, unicode_form),
        "strip_preserve_case": lambda c: T.strip_punctuation(c, unicode_form),
        "lower_preserve_punctuation": lambda c: F.lower(T.keep(c, unicode_form)),
        "lower_strip": lambda c: F.lower(T.strip_punctuation(c, unicode_form)),
    }
    staged = df.select(
        *by,
        *[f(ref).alias(f"_r_{k}") for k, f in forms.items()],
        *[f(hyp).alias(f"_h_{k}") for k, f in forms.items()],
    )
    variants = []
    for k in forms:
        h = F.col(f"_h_{k}")
        kept, stripped = F.col("_r_keep"), F.col("_r_strip_preserve_case")
        rows = {
            "symmetric": (F.col(f"_r_{k}"), h, F.col(f"_r_{k}"), h),
            "counterfactual": (kept, h, kept, h),
            "mixed": (stripped, T.strip_punctuation(h, False), kept, T.keep(h, False)),
        }
        for name, (wr, wh, cr, ch) in rows.items():
            variants.append(
                F.struct(
                    F.lit(name).alias("comparison"), F.lit(k).alias("regime"),
                    wr.alias("wr"), wh.alias("wh"), cr.alias("cr"), ch.alias("ch"),
                )
            )
    long = staged.select(*by, F.explode(F.array(*variants)).alias("v")).select(*by, "v.*")
    counted = D.with_word_distance(long, "we", T.words(F.col("wr")), T.words(F.col("wh"))).select(
        *by, "comparison", "regime", "we",
        D.char_distance(F.col("cr"), F.col("ch")).cast("long").alias("ce"),
        T.n_words(F.col("wr")).cast("long").alias("nw"),
        F.length("cr").cast("long").alias("nc"),
    )
    return corpus_scores(counted, *by, "comparison", "regime")


def compare_to_baseline(table: DataFrame, name: str, baseline: str, *by: str) -> DataFrame:
    """mean error against a baseline row of the same (small) score table."""
    own = 0.5 * F.col("wer") + 0.5 * F.col("cer")
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    base = lambda c: F.max(F.when(F.col(name) == baseline, c)).over(w)
    return table.select(
        *by, name,
        own.alias("mean_error"),
        base(own).alias("baseline_error"),
        ((own < base(own)) | ((F.col("wer") < base(F.col("wer"))) & (F.col("cer") < base(F.col("cer"))))).alias("beats"),
    )


def row_error() -> Column:
    """Mean of the word and character error of one row."""
    return 0.5 * (F.col("we") / F.greatest(F.col("nw"), F.lit(1)) + F.col("ce") / F.greatest(F.col("nc"), F.lit(1)))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """counts and shares of predicted classes per true class."""
    counts = df.groupBy(true, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(true)))


def best_per_group(table: DataFrame, groups: Sequence[str], *order: Column) -> DataFrame:
    """the first row of every group of a score table."""
    w = W.partitionBy(*groups).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def distribution(df: DataFrame, value: str, *by: str, approximate: bool = False) -> DataFrame:
    """count, mean, population deviation, min, max, p10, p50, p90 per group.

    Exact quantiles come from counted values in parallel buckets; ``approximate``
    uses the sketch instead and saves a pass.
    """
    moments = [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    if approximate:
        return df.groupBy(*by).agg(
            *moments, *[F.percentile_approx(value, q, 10_000).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)]
        )
    q = quantiles(df, value, (0.1, 0.5, 0.9), by)
    return df.groupBy(*by).agg(*moments).join(
        q.select(*by, F.col("q10").alias("p10"), F.col("q50").alias("p50"), F.col("q90").alias("p90")), list(by)
    )


def comparable(stats: DataFrame, name: str, *by: str, same_shape: Column | None = None, limit: float = 0.03) -> DataFrame:
    """are two systems' confidences on one scale; all system pairs of a distribution table."""
    a, b = stats.alias("a"), stats.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by] + [F.col(f"a.{name}") < F.col(f"b.{name}")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    delta = F.abs(F.col("a.mean") - F.col("b.mean"))
    tiny = F.lit(1e-9)
    return a.join(b, cond).select(
        *[F.col(f"a.{k}").alias(k) for k in by],
        F.col(f"a.{name}").alias(f"{name}_a"), F.col(f"b.{name}").alias(f"{name}_b"),
        delta.alias("mean_delta"),
        (F.greatest(F.col("a.std"), tiny) / F.greatest(F.col("b.std"), tiny)).alias("std_ratio"),
        ((F.lit(True) if same_shape is None else same_shape) & (delta < limit)).alias("comparable"),
    )


def length_bucket(c: Column, short: float, medium: float) -> Column:
    return F.when(c < short, "short").when(c < medium, "medium").otherwise("long")


def bucket_report(counts: DataFrame, size: Column, short: float, medium: float, *by: str) -> DataFrame:
    """scores, extremes and empty hypotheses by size bucket."""
    keyed = counts.withColumns({"_size": size, "bucket": length_bucket(size, short, medium)})
    return with_rates(
        keyed.groupBy(*by, "bucket").agg(
            F.count("*").alias("n"), F.min("_size").alias("size_min"), F.max("_size").alias("size_max"),
            F.count_if(F.trim("hypothesis").isin("", ".")).alias("placeholders"),
            *[F.sum(c).alias(c) for c in ("we", "ce", "nw", "nc")],
        )
    )


def diff_stats(base: DataFrame, candidate: DataFrame, key: str, text: str, *by: str) -> DataFrame:
    """F16: same and different texts over the ids of ``base``, by group."""
    j = base.alias("b").join(candidate.select(key, F.col(text).alias("_new")), key, "left")
    same = F.trim(F.coalesce(F.col(text), F.lit(""))) == F.trim(F.coalesce("_new", F.lit("")))
    return j.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_diff")
    )


def family_masses(probs: DataFrame, key: str, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """probability mass per family of codes and the family with the largest mass."""
    code = F.lower("code")
    family = F.lit("other")
    for name, codes in reversed(list(families.items())):
        family = F.when(code.isin(*codes), F.lit(name)).otherwise(family)
    names = [*families, "other"]
    out = probs.withColumn("_f", family).groupBy(key).agg(
        *[F.sum(F.when(F.col("_f") == f, F.col("p")).otherwise(0.0)).alias(f"mass_{f}") for f in names]
    )
    best = F.greatest(*[F.col(f"mass_{f}") for f in names])
    route = F.coalesce(*[F.when(F.col(f"mass_{f}") == best, F.lit(f)) for f in names])
    return out.withColumn("route", route)


def misroute_cost(counts: DataFrame, group: str, own: str, other: str) -> DataFrame:
    """mean own-route score minus mean other-route score per class."""
    good = 1.0 - row_error()
    mean = lambda s: F.avg(F.when(F.col("system") == s, good))
    return counts.groupBy(group).agg(
        mean(own).alias("own_score"), mean(other).alias("other_score"), (mean(own) - mean(other)).alias("cost")
    )


def win_counts(counts: DataFrame, key: str, incumbent: str, challengers: Sequence[str], *by: str) -> DataFrame:
    """rows in which a challenger has the lower cost, singly and any of them."""
    names = [incumbent, *challengers]
    per_id = counts.where(F.col("system").isin(*names)).groupBy(key, *by).agg(
        *[F.max(F.when(F.col("system") == s, row_error())).alias(f"_{s}") for s in names]
    )
    wins = {s: F.col(f"_{s}") < F.col(f"_{incumbent}") for s in challengers}
    any_win = F.lit(False)
    for cond in wins.values():
        any_win = any_win | F.coalesce(cond, F.lit(False))
    return per_id.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"wins_{s}") for s, c in wins.items()],
        F.count_if(any_win).alias("wins_any"),
    )
