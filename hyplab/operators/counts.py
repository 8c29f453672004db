"""Count tables over tokens and characters, and the maps mined from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hyplab.functions import ngrams as N, text as T

START, END = "<s>", "</s>"


def _marked(c: Column, marks: bool) -> Column:
    w = T.words(c)
    return F.concat(F.array(F.lit(START)), w, F.array(F.lit(END))) if marks else w


def word_counts(df: DataFrame, text: str, *by: str, marks: bool = False, min_count: int = 1) -> DataFrame:
    """token counts per group; ``marks`` adds sentence marks of non-empty texts."""
    w = df.where(F.col(text) != "").select(*by, F.explode(_marked(F.col(text), marks)).alias("word"))
    out = w.groupBy(*by, "word").agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= min_count) if min_count > 1 else out


def adjacent(w: Column) -> Column:
    """Adjacent token pairs of an array as structs (a, b)."""
    return F.when(
        F.size(w) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 2),
            lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b")),
        ),
    ).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def exploded_pairs(df: DataFrame, w: Column, *columns: str) -> DataFrame:
    """One row (columns, a, b) per pair of adjacent tokens; places are exploded, so the pairs are generated code."""
    size = F.size("_w")
    at = df.select(*columns, w.alias("_w")).where(size >= 2).select(*columns, "_w", F.explode(F.sequence(F.lit(0), size - 2)).alias("_i"))
    return at.select(*columns, F.get("_w", "_i").alias("a"), F.get("_w", F.col("_i") + 1).alias("b"))


def bigram_counts(
    df: DataFrame, text: str, *by: str, marks: bool = False, among: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """counts of adjacent token pairs per group; ``among`` filters the pairs (by, a, b) before they are counted."""
    pairs = exploded_pairs(df.where(F.col(text) != ""), _marked(F.col(text), marks), *by)
    return (among(pairs) if among else pairs).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def gram_array(s: Column, n: int) -> Column:
    """All character n-grams of a string."""
    return F.when(
        F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def char_ngrams(df: DataFrame, text: str, *by: str, n: int = 4, left: str = "<", right: str = ">") -> DataFrame:
    """counts of (context, next character) per group over the marked text; a block of texts is counted before it is shuffled."""
    padded = F.concat(F.lit(left), F.col(text), F.lit(right))
    counted = N.gram_counts(df.select(*by, padded.alias("_padded")), by, "_padded", n)
    return counted.select(*by, F.substring("_g", 1, n - 1).alias("ctx"), F.substring("_g", n, 1).alias("ch"), "n")


def with_context_totals(grams: DataFrame, *by: str) -> DataFrame:
    totals = grams.groupBy(*by, "ctx").agg(F.sum("n").alias("ctx_n"))
    return grams.join(totals, [*by, "ctx"])


def mine_joins(df: DataFrame, reference: str, hypothesis: str, lexicon: DataFrame, min_n: int = 5, min_freq: int = 2) -> DataFrame:
    """adjacent hypothesis pairs that the reference writes as one word."""
    r, h = T.words(F.col(reference)), T.words(F.col(hypothesis))
    pairs = df.select("language", r.alias("_r"), h.alias("_h")).select(
        "language", "_r", "_h", F.explode(adjacent(F.col("_h"))).alias("p")
    )
    joined = F.concat("p.a", "p.b")
    found = (
        pairs.where(F.array_contains("_r", joined) & ~F.array_contains("_h", joined))
        .groupBy("language", F.concat_ws(" ", "p.a", "p.b").alias("phrase"), joined.alias("joined"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_n)
    )
    known = lexicon.where(F.col("n") >= min_freq).select("language", F.col("word").alias("joined"))
    return found.join(known, ["language", "joined"], "left_semi").select("language", "phrase", "joined", "n")


def mine_splits(df: DataFrame, reference: str, hypothesis: str, lexicon: DataFrame, min_n: int = 5, min_freq: int = 2) -> DataFrame:
    """hypothesis words that the reference writes as two known words."""
    r, h = T.words(F.col(reference)), T.words(F.col(hypothesis))
    pairs = df.select("language", r.alias("_r"), h.alias("_h")).select(
        "language", "_r", "_h", F.explode(adjacent(F.col("_r"))).alias("p")
    )
    joined = F.concat("p.a", "p.b")
    found = (
        pairs.where(F.array_contains("_h", joined) & ~F.array_contains("_r", joined))
        .groupBy("language", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_n)
    )
    known = lexicon.where(F.col("n") >= min_freq).select("language", "word")
    for side in ("a", "b"):
        found = found.join(known.withColumnRenamed("word", side), ["language", side], "left_semi")
    return found.select("language", F.concat("a", "b").alias("joined"), F.concat_ws(" ", "a", "b").alias("phrase"), "n")
