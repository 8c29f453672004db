"""Utterance index: readers with a fixed schema, split guards and projections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

FORBIDDEN_SPLITS = ("test",)
TEXT_COLUMNS = ("id", "speaker_id", "transcription", "language", "gender")
INDEX_COLUMNS = ("ID", "speaker_id", "Target", "language", "gender", "split", "hf_config")
RENAMES = {"id": "ID", "transcription": "Target"}


def scan_text(spark: SparkSession, path: str, columns: Sequence[str] = TEXT_COLUMNS, glob: str | None = None) -> DataFrame:
    """Text columns of parquet shards; audio and other columns are never read."""
    reader = spark.read.option("mergeSchema", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    alternatives = {RENAMES[c] for c in columns if c in RENAMES}
    return df.select(*[c for c in df.columns if c in columns or c in alternatives])


def split_shards(spark: SparkSession, root: str, language: str, split: str) -> DataFrame:
    """Shards named {language}-{split}-*.parquet anywhere under ``root``."""
    return scan_text(spark, root, glob=f"*{language}-{split}-*.parquet")


def harmonise(df: DataFrame, language: str | Column, split: str | Column, config: str | Column = "") -> DataFrame:
    """Fixed names, defaults for missing columns, blank language becomes the partition's, fixed order."""
    for old, new in RENAMES.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    if "ID" not in df.columns:
        raise ValueError("no id column")
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    have = set(df.columns)
    text = lambda c: F.col(c) if c in have else F.lit("")
    lang = F.coalesce(F.nullif(F.col("language"), F.lit("")), value(language)) if "language" in have else value(language)
    return df.select(
        "ID", text("speaker_id").alias("speaker_id"), text("Target").alias("Target"), lang.alias("language"), text("gender").alias("gender"),
        value(split).alias("split"), value(config).alias("hf_config"),
    )


def union_parts(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts to union")
    return out


def projections(index: DataFrame) -> dict[str, DataFrame]:
    """Train (no held-out text), test (ids only), sample (ids with an empty target)."""
    test = index.where(F.col("split") == "test")
    return {
        "train": index.where(F.col("split") == "train").select("ID", "Target", "language"),
        "test": test.select("ID", "language"),
        "sample": test.select("ID", F.lit("").alias("Target")),
    }


def summary(index: DataFrame) -> DataFrame:
    """Rows per language and split."""
    of = lambda s: F.count_if(F.col("split") == s).alias(s)
    return index.groupBy("language").agg(of("train"), of("validation"), of("test"))


def write_index(index: DataFrame, path: str, force: bool = False) -> None:
    """Partitioned by language and split; an existing table is kept unless ``force``."""
    index.write.mode("overwrite" if force else "ignore").partitionBy("language", "split").parquet(path)


def read_index(spark: SparkSession, path: str, splits: Sequence[str] | None = None, allow_test: bool = False) -> DataFrame:
    """Rows of some splits; the text of a held-out split is refused, or dropped when allowed."""
    df = spark.read.parquet(path)
    return guarded(df, splits, allow_test) if splits is not None else training_frame(df)


def training_frame(index: DataFrame) -> DataFrame:
    """Every row whose split may be used for training or tuning."""
    return index.where(~F.col("split").isin(*FORBIDDEN_SPLITS))


def guarded(index: DataFrame, splits: Sequence[str], allow_test: bool = False, label: str = "Target") -> DataFrame:
    """Rows of ``splits``. A held-out split is an error unless allowed, and then comes without its text."""
    held = [s for s in splits if s in FORBIDDEN_SPLITS]
    if held and not allow_test:
        raise ValueError(f"refusing to read held-out splits {held} without allow_test")
    df = index.where(F.col("split").isin(*splits))
    return df.drop(label) if held else df


def capped(df: DataFrame, groups: Sequence[str], key: str, n: int) -> DataFrame:
    """At most n rows per group by key order; a first cut inside key buckets keeps hot groups parallel."""
    local = W.partitionBy(*groups, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)
    head = df.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    final = W.partitionBy(*groups).orderBy(key)
    return head.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n).drop("_r")


def labelled_union(parts: Mapping[tuple[str, str], DataFrame], cap: int | None = None) -> DataFrame:
    """Labelled rows of (language, split) parts; held-out splits are refused."""
    for _, split in parts:
        if split in FORBIDDEN_SPLITS:
            raise ValueError(f"refusing to put the held-out split {split!r} into a labelled set")
    out = union_parts(harmonise(df, lang, split) for (lang, split), df in parts.items())
    return out if cap is None else capped(out, ["language", "split"], "ID", cap)


def labelled(df: DataFrame, cap: int | None = None) -> DataFrame:
    """A09 over one table that already has language and split: held-out splits are left out, one scan for all languages."""
    kept = df.where(~F.col("split").isin(*FORBIDDEN_SPLITS))
    out = harmonise(kept, F.col("language"), F.col("split"))
    return out if cap is None else capped(out, ["language", "split"], "ID", cap)
