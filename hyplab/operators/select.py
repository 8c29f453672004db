"""Candidate picks, splits and ranked selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.functions import text as T
from hyplab.operators import ordering as O


# --- picks over (id, candidate position, confidence) ------------------------------------------


def pick_max(cands: DataFrame, key: str = "id", default: str = ".") -> DataFrame:
    """Highest confidence per id, the first listed candidate on ties."""
    best = F.max_by(
        F.struct("system", "hypothesis", "confidence"), F.struct(F.col("confidence"), (-F.col("pos")).alias("neg"))
    )
    out = cands.where(F.col("confidence").isNotNull()).groupBy(key).agg(best.alias("b"))
    return out.select(key, "b.system", F.coalesce("b.hypothesis", F.lit(default)).alias("hypothesis"), "b.confidence")


def pick_margin(cands: DataFrame, threshold: float | None, key: str = "id") -> DataFrame:
    """The best candidate when it leads by ``threshold``, else the primary (position 0)."""
    row = F.struct(F.col("confidence").alias("c"), (-F.col("pos")).alias("neg"), "system", "hypothesis")
    # candidates of one id: as many as there are systems
    per_id = cands.groupBy(key).agg(
        F.max(row).alias("best"),
        F.max(F.when(F.col("pos") == 0, row)).alias("primary"),
        F.slice(F.sort_array(F.collect_list("confidence"), asc=False), 2, 1).alias("rest"),
    )
    margin = F.col("best.c") - F.coalesce(F.get("rest", F.lit(0)), F.lit(-1e9))
    if threshold is None:
        note, chosen = F.lit("maxconf"), F.col("best")
    else:
        leads = margin >= threshold
        has_primary = F.col("primary").isNotNull()
        note = F.when(leads, "margin_ok").when(has_primary, "primary_fb").otherwise("primary_missing")
        chosen = F.when(~leads & has_primary, F.col("primary")).otherwise(F.col("best"))
    return per_id.select(key, chosen.alias("p"), margin.alias("margin"), note.alias("note")).select(
        key, "p.system", "p.hypothesis", "margin", "note"
    )


def drop_length_outliers(cands: DataFrame, key: str = "id", lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Drop candidates far from the median length of their id; never empty a set."""
    w = W.partitionBy(key)
    n = T.n_words(F.col("hypothesis"))
    staged = cands.withColumn("_n", n).withColumns(
        {"_med": F.percentile("_n", F.lit(0.5)).over(w), "_size": F.count("*").over(w)}
    )
    fits = (F.col("_size") <= 1) | (F.col("_med") <= 0) | F.col("_n").between(lo * F.col("_med"), hi * F.col("_med"))
    kept = staged.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(w))
    return kept.where(F.col("_fits") | ~F.col("_any")).drop("_n", "_med", "_size", "_fits", "_any")


def candidate_sets(df: DataFrame, code: str, sets: Mapping[str, Sequence[str]], specialists: Sequence[str], default: Sequence[str]) -> DataFrame:
    """Ordered candidate routes per row by its detected class."""
    c = F.col(code)
    lists = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, options in sets.items():
        lists = lists.when(c == name, F.array(*[F.lit(o) for o in options]))
    lists = lists.when(c.isin(*specialists), F.array(c)).otherwise(F.array(*[F.lit(o) for o in default]))
    return df.select("*", F.posexplode(lists).alias("pos", "candidate"))


# --- splits over groups --------------------------------------------------------------------


def group_hash(group: Column, seed: str | int, sep: str = ":") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}{sep}"), group.cast("string")), 256)


def hash_holdout(df: DataFrame, group: str, seed: int, fraction: float) -> DataFrame:
    """Whole groups to the holdout in hash order; at least one, never all."""
    groups = df.select(group).distinct().withColumn("_h", group_hash(F.col(group), seed))
    ranked = O.hash_positions(groups, "_h", group, out="_pos")
    total = df.select(group).distinct().agg(F.count("*").alias("_g"))
    size = F.greatest(F.lit(1), F.least(F.col("_g") - 1, F.rint(F.col("_g") * fraction).cast("long")))
    sized = ranked.join(F.broadcast(total), F.lit(True))
    return sized.select(group, F.when(F.col("_pos") <= size, "holdout").otherwise("tune").alias("fold"))


def row_target_holdout(df: DataFrame, group: str, seed: int, fraction: float) -> DataFrame:
    """Hashed groups go to validation until the target number of rows is met; one group stays."""
    sizes = df.groupBy(group).agg(F.count("*").alias("rows")).withColumn("_h", group_hash(F.col(group), seed))
    ranked = O.running_totals(
        sizes, ["_h", group], O.hash_bucket(F.col("_h")), {"_pos": F.lit(1).cast("long"), "_cum": F.col("rows")}
    )
    total = sizes.agg(F.count("*").alias("_g"), F.sum("rows").alias("_all"))
    sized = ranked.join(F.broadcast(total), F.lit(True))
    target = F.greatest(F.lit(1), F.rint(F.col("_all") * fraction).cast("long"))
    before = F.col("_cum") - F.col("rows")
    held = (before < target) & (F.col("_pos") < F.col("_g"))
    return sized.select(group, "rows", F.when(held, "validation").otherwise("train").alias("fold"))


def hash_fold(group: Column, seed: str, k: int) -> Column:
    """fold = first 12 hex digits of the hash modulo k."""
    return F.pmod(F.conv(F.substring(group_hash(group, seed), 1, 12), 16, 10).cast("long"), F.lit(k))


def hash_half(group: Column, seed: str) -> Column:
    """Parity of the first byte of the hash of seed+group."""
    first = F.substring(F.sha2(F.concat(F.lit(seed), group.cast("string")), 256), 1, 2)
    return F.pmod(F.conv(first, 16, 10).cast("long"), F.lit(2))


def _fold_pieces(histogram: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Greedy placement of equal-sized groups, in closed form: (rows, first position, folds in turn).

    ``histogram`` has (rows, groups) by falling rows. While the lightest folds stay below
    the next one, groups go round them in turn; so a size needs a few pieces, however many
    groups have it.
    """
    loads = [0] * k
    pieces: list[tuple[int, int, list[int]]] = []
    for rows, groups in histogram:
        at = 0
        while at < groups:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            # the longest run of lightest folds that take turns: each is again behind all others after one group
            turn = next(m for m in range(1, k + 1) if m == k or (loads[order[0]] + rows, order[0]) <= (loads[order[m]], order[m]))
            if turn < k:
                gap = loads[order[turn]] - loads[order[turn - 1]]
                rounds = max(1, min(gap // rows - 1, (groups - at) // turn))
            else:
                rounds = max(1, (groups - at) // turn)
            n = min(rounds * turn, groups - at)
            pieces.append((rows, at, order[:turn]))
            for i in range(min(turn, n)):
                loads[order[i]] += rows * (n // turn + (i < n % turn))
            at += n
    return pieces


def balanced_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups by size descending (by hash within a size), each to the lightest fold so far (lowest number on ties).

    The fold follows from a group's position among groups of its size, so the driver sees
    one row per distinct size, of which there are at most the square root of twice the rows.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("rows")).withColumn("_h", F.sha2(F.col(group).cast("string"), 256))
    histogram = sizes.groupBy("rows").agg(F.count("*").alias("n")).orderBy(F.desc("rows")).collect()
    pieces = _fold_pieces([(r["rows"], r["n"]) for r in histogram], k)
    # a few rows per distinct size, as bounded as the histogram
    table = df.sparkSession.createDataFrame(pieces, "rows long, _from long, _turn array<int>")
    until = F.coalesce(F.lead("_from").over(W.partitionBy("rows").orderBy("_from")), F.lit(2**62))
    placed = O.running_totals(sizes, ["_h", group], O.hash_bucket(F.col("_h")), {"_pos": F.lit(1).cast("long")}, ["rows"])
    joined = placed.withColumn("_pos", F.col("_pos") - 1).join(F.broadcast(table.withColumn("_until", until)), "rows")
    here = (F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_until"))
    fold = F.get("_turn", ((F.col("_pos") - F.col("_from")) % F.size("_turn")).cast("int"))
    return joined.where(here).select(group, "rows", fold.alias("fold"))


def positional_slices(df: DataFrame, key: str, report: tuple[int, int] = (0, 50), select: tuple[int, int] = (50, 90)) -> DataFrame:
    """Fixed report and select slices by key order; disjoint, clipped, non-empty."""
    if set(range(*report)) & set(range(*select)) or report[0] >= report[1] or select[0] >= select[1]:
        raise ValueError("report and select slices must be non-empty and disjoint")
    # only the first rows can be in a slice: a bounded top-n, not a global sort
    top = df.orderBy(key).limit(max(report[1], select[1]))
    pos = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1
    label = (
        F.when((F.col("position") >= report[0]) & (F.col("position") < report[1]), "report")
        .when((F.col("position") >= select[0]) & (F.col("position") < select[1]), "select")
    )
    return top.withColumn("position", pos).withColumn("slice", label).where(F.col("slice").isNotNull())


def locked_halves(df: DataFrame, key: str) -> DataFrame:
    """First half tune, second half holdout, by position."""
    n = df.agg(F.count("*").alias("_n"))
    numbered = O.row_numbers(df, key, "_pos").join(F.broadcast(n), F.lit(True))
    return numbered.withColumn("half", F.when(F.col("_pos") <= F.floor(F.col("_n") / 2), "tune").otherwise("holdout")).drop("_pos", "_n")


def seeded_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows per group in hash order.

    Rows past a per-bucket cut can never be among the first n, so a bucket-level top n
    runs before the group-level one and a hot group is not ranked in one task.
    """
    h = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    local = W.partitionBy(group, O.hash_bucket(F.col("_h"), 2)).orderBy("_h", key)
    head = h.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n).drop("_r")
    final = W.partitionBy(group).orderBy("_h", key)
    return head.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r", "_h")


def shards(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Every ``workers``-th row by position."""
    return O.row_numbers(df, key, "_pos").withColumn("shard", F.pmod(F.col("_pos") - 1, F.lit(workers))).drop("_pos")


def position_range(df: DataFrame, key: str, start: int, count: int | None) -> DataFrame:
    """Rows start .. start+count-1 by position."""
    numbered = O.row_numbers(df, key, "_pos").where(F.col("_pos") > max(0, start))
    return (numbered if count is None else numbered.where(F.col("_pos") <= max(0, start) + count)).drop("_pos")


# --- ranked selections -----------------------------------------------------------------------


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)


def top_per_group(counts: DataFrame, group: Sequence[str], n: int, *order: Column, min_count: int = 0) -> DataFrame:
    """Most common rows per group of a count table."""
    w = W.partitionBy(*group).orderBy(*order)
    return counts.where(F.col("n") >= min_count).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def template_order(template: DataFrame, targets: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Targets in template order; a missing id is an error."""
    j = template.select(key, order).join(targets.select(key, F.col(text).alias("_t"), F.lit(True).alias("_has")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no target for "), F.col(key).cast("string"))).cast("string")
    clean = F.trim(F.coalesce("_t", F.lit("")))
    target = F.when(F.col("_has").isNull(), missing).when(clean == "", ".").otherwise(clean)
    return j.select(key, order, target.alias("target")).orderBy(order)
