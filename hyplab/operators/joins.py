"""Joins with contracts: one row per key, nothing missing, order by an explicit column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hyplab.functions import distance as D, text as T


def unique(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """One row per key; a second row with the same key fails the job.

    The aggregate leaves the rows partitioned by key, so a following join on the
    same key needs no further shuffle.
    """
    others = [c for c in df.columns if c != key]
    many = F.raise_error(F.concat(F.lit(f"{label}: duplicate {key} "), F.col(key).cast("string")))
    grouped = df.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_row") if others else F.lit(None).alias("_row"))
    checked = F.when(F.col("_n") > 1, many.cast("long")).otherwise(F.col("_n"))
    return grouped.where(checked == 1).select(key, *[F.col("_row")[c].alias(c) for c in others])


def align_to_template(
    template: DataFrame, predictions: DataFrame, key: str, text: str, *, strict: bool = False, unicode_form: bool = True
) -> DataFrame:
    """Every template row with its prediction, '.' where none is usable.

    ``strict`` turns a missing or placeholder prediction into an error.
    """
    joined = unique(template, key, "template").join(unique(predictions.select(key, text), key, "predictions"), key, "left")
    norm = T.normalize(F.col(text), unicode_form=unicode_form)
    if strict:
        bad = F.raise_error(F.concat(F.lit("no usable prediction for "), F.col(key).cast("string")))
        target = F.when(F.col(text).isNull() | T.is_placeholder(norm), bad.cast("string")).otherwise(norm)
    else:
        target = F.when(F.col(text).isNull() | (norm == ""), F.lit(".")).otherwise(norm)
    return joined.withColumn("target", target).drop(text)


def complete_inner(tables: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """One-to-one inner join of several tables."""
    (name, out), *rest = tables
    out = unique(out, key, name)
    for label, t in rest:
        out = out.join(unique(t, key, label), key)
    return out


def coverage(tables: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """How many keys every table has and how many are in all of them."""
    tagged = None
    for name, t in tables:
        part = t.select(key, F.lit(name).alias("_t"))
        tagged = part if tagged is None else tagged.unionByName(part)
    names = [n for n, _ in tables]
    per_key = tagged.groupBy(key).agg(*[F.count_if(F.col("_t") == n).alias(n) for n in names])
    everywhere = F.lit(True)
    for n in names:
        everywhere = everywhere & (F.col(n) > 0)
    return per_key.agg(
        F.count("*").alias("keys"), *[F.count_if(F.col(n) > 0).alias(f"in_{n}") for n in names],
        *[F.count_if(F.col(n) > 1).alias(f"duplicated_in_{n}") for n in names], F.count_if(everywhere).alias("in_all"),
    )


def presence(expected: DataFrame, caches: Mapping[str, DataFrame], key: str, order: str) -> DataFrame:
    """Per cache the missing, foreign and empty rows, order equality and completeness.

    ``expected`` has (key, order); every cache has (key, order, text).
    """
    out = None
    for name, cache in caches.items():
        e = expected.select(key, F.col(order).alias("_want"))
        c = cache.select(key, F.col(order).alias("_got"), F.trim(F.coalesce("text", F.lit(""))).alias("_text"))
        j = e.join(c, key, "full_outer").agg(
            F.count("_want").alias("expected"), F.count("_got").alias("present"),
            F.count_if(F.col("_got").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("foreign_rows"),
            F.count_if(F.col("_text") == "").alias("empty"),
            F.count_if(F.col("_want") != F.col("_got")).alias("moved"),
        )
        clean = (F.col("missing") == 0) & (F.col("foreign_rows") == 0)
        row = j.select(
            F.lit(name).alias("cache"), "*", (clean & (F.col("moved") == 0)).alias("ordered_exact"),
            (clean & (F.col("moved") == 0) & (F.col("empty") == 0)).alias("complete_exact"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def assemble(template: DataFrame, systems: Mapping[str, DataFrame], key: str, text: str, order: Sequence[str]) -> DataFrame:
    """Template with a column per system and the first non-blank text in ``order``."""
    out = template
    for name, t in systems.items():
        out = out.join(t.select(key, F.col(text).alias(name)), key, "left")
    usable = [F.when(F.trim(F.col(n)) != "", F.col(n)) for n in order]
    return out.withColumn("chosen", F.coalesce(*usable, F.lit(".")))


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def restrict(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a set."""
    return rows.join(ids.select(key), key, "left_semi")


def in_band(value: Column, lo: float, hi: float) -> Column:
    """Open below, closed above."""
    return (value > lo) & (value <= hi)


def resolve_route(code: Column, specialists: Sequence[str], fallbacks: Mapping[str, Sequence[str]], default: str) -> Column:
    """The code itself, its first fallback with a specialist, else the default."""
    lid = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    out = F.when(lid.isin(*specialists), lid)
    for source, options in fallbacks.items():
        usable = [o for o in options if o in specialists]
        if usable:
            out = out.when(lid == source, F.lit(usable[0]))
    return out.otherwise(F.lit(default))


def pair_features(df: DataFrame, base: str, alt: str) -> DataFrame:
    """Word ratio and character error of two columns, for band filters and guards."""
    return df.withColumns(
        {
            "length_ratio": (T.n_words(F.col(alt)) + 1e-6) / (T.n_words(F.col(base)) + 1e-6),
            "pair_error": D.pair_error(F.col(base), F.col(alt)),
        }
    )
