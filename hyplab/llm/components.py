"""Connected components by alternating star contraction: only joins and minima, a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hyplab.llm.store import cut

ROWS_PER_PARTITION = 200_000
MAX_BROADCAST_ROWS = 500_000


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (long columns a, b) but the roots; a root is its component's least node.

    Each round hangs a node's larger neighbours on its least neighbour, then its
    smaller ones; the longest path shrinks by a constant factor, so the rounds grow
    with the logarithm of the component's diameter. A hub of any degree is only a key
    with many rows in a join, which adaptive execution splits. Self links and repeated
    links are ignored; nulls link nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now)
    mark = _mark(now)
    while mark[0]:
        # two numbers a row and a counted number of rows: small tables are broadcast and kept in few partitions
        side = (lambda df: F.broadcast(df)) if mark[0] <= MAX_BROADCAST_ROWS else (lambda df: df)
        now = now.coalesce(-(-mark[0] // ROWS_PER_PARTITION))
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        up = both.where("y > x").join(side(least), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        hung = up.join(side(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(low.select("u", F.col("m").alias("v")).union(hung).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
