"""Ranks, running totals and quantiles that do not sort a whole table in one task.

A key is cut into order-preserving buckets by split points that are plain literals,
so every use of a bucket in a plan agrees. Within buckets Spark sorts in parallel;
across buckets only one row per bucket is summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 1024


def split_points(df: DataFrame, key: str, buckets: int = BUCKETS) -> list[float]:
    """Approximate quantiles of ``key``; one pass, at most ``buckets - 1`` numbers reach the driver."""
    at = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(key, at, 0.25 / buckets)
    return sorted({float(x) for x in found if x is not None})


def bucket_of(key: Column, points: Sequence[float]) -> Column:
    """How many split points are at or below ``key``; found in two short scans."""
    if not points:
        return F.lit(0)
    side = max(1, int(len(points) ** 0.5))
    chunks = [list(points[i : i + side]) for i in range(0, len(points), side)]
    heads = F.array(*[F.lit(c[0]) for c in chunks])
    bodies = F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks])
    coarse = F.size(F.filter(heads, lambda x: x <= key))
    fine = F.size(F.filter(F.get(bodies, coarse - 1), lambda x: x <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * side + fine)


def hash_bucket(hex_hash: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a hexadecimal hash: its first digits."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("int")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums in ``order`` (a total order), optionally per group.

    ``bucket`` must be monotone in the first order key.
    """
    staged = df.withColumn("_bucket", bucket)
    totals = staged.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*groups or [F.lit(0)]).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row per bucket (and group): a bounded table whatever the size of df
    offsets = totals.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    keep = [c for c in df.columns if c not in sums]
    return (
        staged.join(offsets, [*groups, "_bucket"])
        .select(*keep, *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])
    )


def row_numbers(df: DataFrame, key: str, out: str = "position") -> DataFrame:
    """Global 1-based position by a unique numeric key."""
    points = split_points(df, key)
    return running_totals(df, [key], bucket_of(F.col(key), points), {out: F.lit(1).cast("long")})


def hash_positions(df: DataFrame, hash_col: str, *tie: str, out: str = "position") -> DataFrame:
    """Global 1-based position by a hexadecimal hash column."""
    return running_totals(df, [hash_col, *tie], hash_bucket(F.col(hash_col)), {out: F.lit(1).cast("long")})


def quantiles(df: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, as columns q<percent>.

    Equal values are counted first, so a group that holds a third of the rows is
    spread over its buckets and never sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    points = split_points(df, value)
    cum = running_totals(counts, [value], bucket_of(F.col(value), points), {"_cum": F.col("_n")}, groups)
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("_total")) if groups else None
    if total is None:
        size = counts.agg(F.sum("_n").alias("_total")).withColumn("_k", F.lit(0))
        joined = cum.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k").drop("_k")
    else:
        joined = cum.join(total, list(groups))
    lo = F.col("_cum") - F.col("_n")
    out = []
    for q in qs:
        h = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(h), F.ceil(h)
        at_low = F.max(F.when((lo <= low) & (low < F.col("_cum")), F.col(value)))
        at_high = F.max(F.when((lo <= high) & (high < F.col("_cum")), F.col(value)))
        frac = F.max(h - low)
        out.append((at_low + (at_high - at_low) * frac).alias(f"q{round(q * 1000) / 10:g}".replace(".", "_")))
    return joined.groupBy(*groups).agg(*out) if groups else joined.agg(*out)
