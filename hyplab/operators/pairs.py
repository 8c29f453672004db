"""Tables over pairs of texts or vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hyplab.functions import distance as D, kernels as K, text as T


def system_pairs(hyps: DataFrame) -> DataFrame:
    """Every pair of systems of an id, in candidate order; (id, system) is unique, so groups stay small."""
    a = hyps.select("id", "pos", F.col("system").alias("system_a"), F.col("hypothesis").alias("text_a"))
    b = hyps.select("id", F.col("pos").alias("_pos"), F.col("system").alias("system_b"), F.col("hypothesis").alias("text_b"))
    return a.join(b, "id").where(F.col("pos") < F.col("_pos")).drop("pos", "_pos")


def agreement(hyps: DataFrame) -> DataFrame:
    """Character error, exact match and word distance of all system pairs."""
    a, b = F.col("text_a"), F.col("text_b")
    p = D.with_word_distance(system_pairs(hyps), "word_distance", T.words(a), T.words(b))
    return p.select("id", "system_a", "system_b", D.pair_error(a, b).alias("error"), (a == b).alias("exact"), "word_distance")


def operation_count(op: str, ops: str = "ops"):
    return F.size(F.filter(F.col(ops), lambda x: x["op"] == op))


def pair_operations(hyps: DataFrame) -> DataFrame:
    """Substitutions, insertions and deletions of all system pairs."""
    p = system_pairs(hyps).withColumn("ops", K.alignment(F.col("text_a"), F.col("text_b")))
    return p.select(
        "id", "system_a", "system_b", operation_count("S").alias("substitutions"),
        operation_count("I").alias("insertions"), operation_count("D").alias("deletions"),
    )


def alignment_table(df: DataFrame, key: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """One row per alignment step that is not a match, with its position."""
    ops = df.select(*key, K.alignment(F.col(reference), F.col(hypothesis)).alias("ops"))
    return (
        ops.select(*key, F.posexplode("ops").alias("step", "o")).where("o.op <> 'C'")
        .select(*key, "step", "o.op", "o.ref", "o.hyp")
    )


def prototypes(df: DataFrame, label: str, vector: str, labels: Sequence[int]) -> DataFrame:
    """L2-normalised mean vector per class: one row per label."""
    parts = (
        df.where(F.col(label).isin(*labels))
        .select(label, F.posexplode(vector).alias("i", "x"))
        .groupBy(label, "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    # one entry per dimension and label: bounded by the vector length
    mean = parts.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")
    )
    return mean.select(label, D.l2_normalize(F.col("mean")).alias("proto"))


def prototype_margin(df: DataFrame, protos: DataFrame, vector: str, positive: int, negative: int) -> DataFrame:
    """Distance to the negative prototype minus distance to the positive one."""
    both = protos.agg(
        F.max_by("proto", F.col("label") == positive).alias("_pos"), F.max_by("proto", F.col("label") == negative).alias("_neg")
    )
    x = F.col(vector).cast("array<double>")
    # the right side is one row by construction
    return df.join(F.broadcast(both), F.lit(True)).withColumn(
        "margin", D.euclidean(x, F.col("_neg")) - D.euclidean(x, F.col("_pos"))
    ).drop("_pos", "_neg")
