"""Mixing sources to target weights without sorting: nested thresholds on a hash of each document.

Every source gets a target from its weight (``targets``). A document sits at a place
between 0 and 1 that a hash of its id and text names. A source takes every document
``base`` times (target over size, rounded down) and once more those whose place lies
below a threshold. Thresholds come from histograms: sizes are summed by source and
hash bucket, the bucket in which a source reaches its budget is found from running
sums, and only that bucket is divided again, four times 32,768. The last step keeps
or leaves out the documents at the boundary place, whichever comes nearer. Growing a
target only adds documents (nested thresholds), and equal inputs give equal mixes.

Null and empty texts have size 0. A null source is one source, the last. Rows alike in
doc_id and text share a place and are taken together. An empty table gives an empty
result; a source whose size is 0 has target 0. Column names with a leading underscore
and the output names are taken by the operator; other columns are ignored by ``take``
unless named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.llm.store import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 15, 4
MAX_BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Number of words: characters that begin one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", "")).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of the document's id and text, as a number."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with its _size and _place."""
    return docs.withColumns({"_size": n_words(F.col("text")), "_place": place(F.col("doc_id"), F.col("text"))})


def targets(measured: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target: ``share`` of all sizes split by weight, at most ``most`` times a source's
    size, what exceeds that going to the others by weight. One row per source; only these rows meet in a task."""
    by_source = measured.groupBy("source").agg(F.sum("_size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(number, F.lit(len(weights))).cast("int") + 1)
    weighed = by_source.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    # sources reach their cap in the order of cap over weight: fill until the level of the rest is below the next cap
    key = [F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source")]
    order = [k.asc() for k in key]
    below = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(below), F.lit(0))) / F.sum("_w").over(rest)
    filled = weighed.withColumn("_level", level).withColumn(
        "_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(*key, F.col("_level")))).over(everything)["_level"])
    return filled.select(
        "source", "source_size",
        F.round(F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.lit(float("inf")))), 6).alias("target"))


def plan(measured: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with base (times that every document is taken) and threshold (places below it once more).

    ``measured`` is read once per level and should be slim and cut; rows that one level
    settles never reach the next.
    """
    size = F.col("source_size")
    base = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0))
    goals = cut(goals.withColumn("base", base).withColumn("_need", F.col("target") - F.col("base") * size))
    small = goals.count() <= MAX_BROADCAST_SOURCES
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    open_rows = measured.select(F.col("source").alias("_s"), "_size", "_place")
    edge = goals.where("_need > 0").select("source", "_need", F.lit(0).cast("long").alias("_before"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = side(edge)
        inside = open_rows.join(at, F.col("_s").eqNullSafe(F.col("source"))).where(
            F.shiftright("_place", shift + BITS) == F.col("_prefix"))
        sums = inside.groupBy("source", "_need", "_before", F.shiftright("_place", shift).alias("_bucket")).agg(F.sum("_size").alias("_sum"))
        upto = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        reached = sums.withColumn("_upto", F.col("_before") + F.sum("_sum").over(upto)).where(F.col("_upto") > F.col("_need"))
        edge = cut(
            reached.groupBy("source").agg(F.min(F.struct("_bucket", "_need", "_upto", "_sum")).alias("e"))
            .select("source", "e._need", (F.col("e._upto") - F.col("e._sum")).alias("_before"), F.col("e._bucket").alias("_prefix"), "e._sum"))
    nearer = (F.col("_need") - F.col("_before")) * 2 > F.col("_sum")
    found = edge.select(F.col("source").alias("_s"), (F.col("_prefix") + nearer.cast("long")).alias("threshold"))
    return goals.join(found, F.col("_s").eqNullSafe(F.col("source")), "left").select(
        "source", "source_size", "target", "base", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def take(measured: DataFrame, made: DataFrame) -> DataFrame:
    """``measured`` with source_size, target and copies (how often the mix takes the document)."""
    made = cut(made)
    side = F.broadcast(made) if made.count() <= MAX_BROADCAST_SOURCES else made
    joined = measured.join(side.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("base") + (F.col("_place") < F.col("threshold")).cast("long")
    return joined.withColumn("copies", copies).drop("_s", "base", "threshold")
