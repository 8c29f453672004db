"""Broadcast behind a size check, and tables kept or cut from their lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 1_000_000
# Key hashes of a table are far smaller than its rows.
MAX_HASHED_ROWS = 4_000_000

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one plan read."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def cut(df: DataFrame) -> DataFrame:
    """A table of an iterative operator, written to the shared folder of ``spark.checkpoint.dir``.

    Only a local session that names no folder falls back to one of its own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hyplab-checkpoints-"))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Count a derived table once, keep it, and say whether it is small enough to broadcast.

    Small tables come back with a broadcast hint; larger ones without, so joins with
    them shuffle. A lost executor recomputes its part of the kept table.
    """
    kept = keep(df)
    small = kept.count() <= max_rows
    return (F.broadcast(kept) if small else kept), small


def frequent(df: DataFrame, count: str = "n", max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows of a count table, to be broadcast, and the others (None where all are few enough).

    The cut is a power of two of the count, so the driver sees one number for each power.
    A few rows are nearly all of a text's tokens; what is left can be shuffled.
    """
    bits = F.length(F.bin(F.col(count).cast("long")))
    rows, cut = 0, None
    for r in sorted(df.groupBy(bits.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["b"], reverse=True):
        rows += r["n"]
        if rows > max_rows:
            cut = 1 << r["b"]
            break
    if cut is None:
        return F.broadcast(df), None
    return F.broadcast(df.where(F.col(count) >= cut)), df.where(F.col(count) < cut)


def may_match(df: DataFrame, table: DataFrame, on: Sequence[str], max_rows: int = MAX_HASHED_ROWS) -> DataFrame:
    """``df`` without rows whose key ``table`` lacks, but for equal hashes: goes before a shuffle join that keeps few rows.

    The hashes of the keys are broadcast; a table beyond ``max_rows`` filters nothing.
    """
    hashes = keep(table.select(F.xxhash64(*on).alias("_hash")).distinct())
    if hashes.count() > max_rows:
        return df
    return df.withColumn("_hash", F.xxhash64(*on)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")


def release() -> None:
    """Drop every kept table."""
    while _kept:
        _kept.pop().unpersist()
