"""Tables mined from word alignments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hyplab.functions import kernels as K


def operations(df: DataFrame, reference: str, hypothesis: str, *by: str) -> DataFrame:
    """Counts of (op, ref, hyp) per group, without matches and without empty hypotheses.

    Equal pairs have no errors and never reach the kernel.
    """
    r, h = F.col(reference), F.col(hypothesis)
    wrong = df.where((h != "") & (h != ".") & (r != h))
    ops = wrong.select(*by, F.explode(F.filter(K.alignment(r, h), lambda o: o["op"] != "C")).alias("o"))
    return ops.groupBy(*by, F.col("o.op").alias("op"), F.col("o.ref").alias("ref"), F.col("o.hyp").alias("hyp")).agg(F.count("*").alias("n"))


def error_types(ops: DataFrame, language: str, function_words: Mapping[str, Sequence[str]]) -> DataFrame:
    """substitutions, deletions and insertions per language, and the function-word share."""
    word = F.coalesce("ref", "hyp")
    is_function = F.lit(False)
    for lang, words in function_words.items():
        is_function = is_function | ((F.col(language) == lang) & word.isin(*words))
    hit = F.when(is_function & (F.col("op") != "S"), F.col("n")).otherwise(0)
    return ops.groupBy(language, "op").agg(F.sum("n").alias("n"), F.sum(hit).alias("function_words"))


def most_common(ops: DataFrame, language: str, top: int = 25, min_substitutions: int = 5) -> DataFrame:
    """Most frequent substitutions, deletions and insertions per language."""
    kept = ops.where((F.col("op") != "S") | (F.col("n") >= min_substitutions))
    w = W.partitionBy(language, "op").orderBy(F.desc("n"), "ref", "hyp")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def substitution_map(ops: DataFrame, lex: DataFrame, language: str, min_n: int = 5, min_precision: float = 0.7,
                     common: int = 20, min_target: int = 2) -> DataFrame:
    """hypothesis word to its dominant reference word, where it is nearly always that error."""
    subs = ops.where("op = 'S'")
    best = subs.groupBy(language, "hyp").agg(
        F.sum("n").alias("total"), F.max_by(F.struct("ref", "n"), F.struct("n", "ref")).alias("b")
    ).select(language, F.col("hyp").alias("word"), F.col("b.ref").alias("new"), F.col("b.n").alias("n"), "total")
    sure = best.where((F.col("n") >= min_n) & (F.col("n") / F.col("total") >= min_precision) & (F.col("new") != F.col("word")))
    freq = lambda name, out: lex.select(language, F.col("word").alias(name), F.col("n").alias(out))
    j = sure.join(freq("word", "_fw"), [language, "word"], "left").join(freq("new", "_fn"), [language, "new"], "left")
    fw, fn = F.coalesce("_fw", F.lit(0)), F.coalesce("_fn", F.lit(0))
    return j.where(~((fw >= common) & (fw >= fn)) & (fn >= min_target)).select(language, "word", "new", "n", "total")
