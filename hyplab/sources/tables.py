"""Strict CSV reads, ordered sinks, hypothesis tables, stores and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_strict_csv(spark: SparkSession, path: str, required: Sequence[str], exact: bool = True, key: str = "ID", filled: Sequence[str] = ("Target",)) -> DataFrame:
    """The header must equal (or hold) the declared columns, all strings, no NA parsing.

    A duplicate key or a blank required text fails the job when the rows are used.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    header = [h.lstrip("﻿") for h in header]
    if exact and header != list(required):
        raise ValueError(f"{path}: header must be {list(required)}, got {header}")
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = StructType([StructField(h, StringType()) for h in header])
    df = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST")
        .option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
        .select(*required)
    )
    df = df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in required])
    for c in filled:
        if c in required:
            bad = F.raise_error(F.concat(F.lit(f"empty {c} for "), F.col(key))).cast("string")
            df = df.withColumn(c, F.when(F.trim(c) == "", bad).otherwise(F.col(c)))
    if key in required:
        from hyplab.operators.joins import unique

        df = unique(df, key, path).select(*required)
    return df


def union_shards(shards: DataFrame, key: str, value: str) -> DataFrame:
    """Identical duplicates collapse, two different values of one key fail the job."""
    per_key = shards.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count_if(F.col(value).isNull()).alias("_nulls"), F.count("*").alias("_n"))
    conflict = ~F.col("_lo").eqNullSafe(F.col("_hi")) | ((F.col("_nulls") > 0) & (F.col("_nulls") < F.col("_n")))
    bad = F.raise_error(F.concat(F.lit("conflicting shard values for "), F.col(key).cast("string"))).cast("string")
    return per_key.select(key, F.when(conflict, bad).otherwise(F.col("_lo")).alias(value))


def shard_conflicts(shards: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that shards disagree on."""
    return shards.groupBy(key).agg(F.count_distinct(F.coalesce(value, F.lit("\u0000"))).alias("values"), F.count("*").alias("rows")).where(F.col("values") > 1)


def write_ordered(df: DataFrame, path: str, order: str, columns: Sequence[str] = ("ID", "Target")) -> None:
    """A10: two-column CSV parts in template order.

    The order is a range partitioning and a sort inside parts, so file order is row
    order and no task holds the whole table.
    """
    df.orderBy(order).select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", "\"").option("emptyValue", "").csv(path)


def round_trip(written: DataFrame, source: DataFrame, key: str, text: str) -> DataFrame:
    """A10: one row: missing, extra and changed rows of a written table against its source."""
    a = source.select(key, F.col(text).alias("_a"), F.lit(True).alias("_in_a"))
    b = written.select(key, F.col(text).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, key, "full_outer")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return j.agg(
        F.count("_in_a").alias("rows"), F.count_if(F.col("_in_b").isNull()).alias("missing"), F.count_if(F.col("_in_a").isNull()).alias("extra"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
    )


def append_hypotheses(df: DataFrame, path: str) -> None:
    """Long hypothesis rows, one directory per system; a system's rows are replaced as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("system").parquet(path)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last written row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def to_wide(hyps: DataFrame, systems: Sequence[str], key: str = "id", value: str = "hypothesis") -> DataFrame:
    """A column per system. The systems are named, so no extra pass looks for them."""
    return hyps.groupBy(key).pivot("system", list(systems)).agg(F.first(value))


def report_json(df: DataFrame) -> DataFrame:
    """Rows of a report as JSON lines."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def lines_digest(values: Column) -> Column:
    """sha256 of the sorted lines of a small array, each ended by a newline."""
    return F.sha2(F.concat(F.array_join(F.array_sort(values), "\n"), F.lit("\n")), 256)


def table_digest(df: DataFrame, *columns: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a table of any size: row count and xor of 60-bit row hashes."""
    row = F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns]), 256)
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor(bits).alias("digest"))
