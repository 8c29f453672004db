"""Checks on tables that leave the system, and set algebra over ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hyplab.functions import text as T
from hyplab.operators import ordering as O
from hyplab.operators.joins import resolve_route


def set_difference(expected: DataFrame, actual: DataFrame, key: str, *by: str) -> DataFrame:
    """Missing and extra ids, from one full outer join."""
    e = expected.select(key, *by).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key, *by).distinct().withColumn("_a", F.lit(True))
    return e.join(a, [key, *by], "full_outer").groupBy(*by).agg(
        F.count("_e").alias("expected"), F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra")
    ).withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def overlap(parts: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one part, with how many parts."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("parts")).where(F.col("parts") > 1)


def require_disjoint(parts: DataFrame, key: str, part: str) -> DataFrame:
    """``parts`` unchanged, but reading a key that occurs in more than one part is an error."""
    shared = overlap(parts, key, part).select(F.col(key).alias("_k"), F.lit(True).alias("_both"))
    j = parts.join(shared, F.col(key) == F.col("_k"), "left")
    leak = F.raise_error(F.concat(F.lit("id in more than one part: "), F.col(key).cast("string"))).cast(dict(parts.dtypes)[key])
    return j.withColumn(key, F.when(F.col("_both"), leak).otherwise(F.col(key))).select(*parts.columns)


def change_sets(base: DataFrame, candidate: DataFrame, failed: DataFrame, key: str, text: str) -> DataFrame:
    """Rows the candidate changes, and whether the failed table changed the id or to the same text."""
    j = (
        base.select(key, F.col(text).alias("_b")).join(candidate.select(key, F.col(text).alias("_c")), key)
        .join(failed.select(key, F.col(text).alias("_f")), key)
    )
    changed, failed_id = F.col("_c") != F.col("_b"), F.col("_f") != F.col("_b")
    same = changed & failed_id & (F.col("_c") == F.col("_f"))
    return j.where(changed).select(key, F.col("_c").alias(text), failed_id.alias("failed_id"), same.alias("failed_exact"))


def union_spaces(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Legacy ids in their order, then new ids by key; a sort key, not a position, so nothing is ranked."""
    fresh = new.select(key).distinct().join(old.select(key), key, "left_anti")
    return old.select(key, F.lit(0).alias("block"), F.col(order).cast("long").alias("rank")).unionByName(
        fresh.select(key, F.lit(1).alias("block"), F.col(key).cast("long").alias("rank"))
    )


def _errors(tests: Mapping[str, Column]) -> Column:
    found = F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()])
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), ";")


def submission_check(template: DataFrame, submission: DataFrame, key: str, text: str, strict: bool = False, unicode_form: bool = True) -> DataFrame:
    """One row with counts, the list of errors and ok."""
    s = submission.groupBy(key).agg(
        F.count("*").alias("_n"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("_blank"),
        F.count_if(T.is_placeholder(T.normalize(F.col(text), unicode_form=unicode_form))).alias("_bad"),
    )
    t = template.select(key).distinct().withColumn("_t", F.lit(True))
    c = t.join(s, key, "full_outer").agg(
        F.count("_t").alias("template_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_t").isNull()).alias("extra"), F.coalesce(F.sum("_blank"), F.lit(0)).alias("empty"),
        F.count_if(F.col("_n") > 1).alias("duplicated"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("placeholders"),
    )
    tests = {
        "row_count": F.col("rows") != F.col("template_rows"), "id_set": (F.col("missing") > 0) | (F.col("extra") > 0),
        "empty": F.col("empty") > 0, "duplicates": F.col("duplicated") > 0,
    }
    if strict:
        tests["placeholders"] = F.col("placeholders") > 0
    return c.withColumn("errors", _errors(tests)).withColumn("ok", F.col("errors") == "")


def order_check(expected: DataFrame, actual: DataFrame, key: str, order: str) -> DataFrame:
    """Row counts, and whether every expected position holds the expected id."""
    j = expected.select(F.col(order).alias("_o"), F.col(key).alias("_e")).join(
        actual.select(F.col(order).alias("_o"), F.col(key).alias("_a")), "_o", "full_outer"
    )
    return j.agg(F.count("_e").alias("expected_rows"), F.count("_a").alias("rows"), F.count_if(~F.col("_e").eqNullSafe(F.col("_a"))).alias("moved")).withColumn(
        "ok", F.col("moved") == 0
    )


def public_file_check(df: DataFrame, key: str, text: str, rows: int | Column, prefix: str) -> DataFrame:
    """Row count, unique ids with a prefix, no placeholder."""
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(T.is_placeholder(clean)).alias("_bad"))
    c = per_key.agg(
        F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicated"),
        F.count_if(~F.col(key).cast("string").startswith(prefix)).alias("bad_prefix"), F.sum("_bad").alias("placeholders"),
    )
    tests = {
        "row_count": F.col("rows") != rows, "duplicates": F.col("duplicated") > 0, "prefix": F.col("bad_prefix") > 0, "placeholders": F.col("placeholders") > 0,
    }
    return c.withColumn("errors", _errors(tests)).withColumn("ok", F.col("errors") == "")


def route_cache_check(index: DataFrame, cache: DataFrame, key: str, route: str, index_order: str, cache_order: str) -> DataFrame:
    """Per route the id set, and how many rows stand elsewhere than in route order and in key order.

    A cache may keep its route's order or be sorted by key; any other order is refused.
    Order columns and the key are numbers, ascending and unique within a route. Positions
    come from ordered buckets, so a large route is not ranked in one task.
    """
    def placed(df: DataFrame, by: str, out: str) -> DataFrame:
        points = O.split_points(df, by)
        return O.running_totals(df, [by], O.bucket_of(F.col(by), points), {out: F.lit(1).cast("long")}, [route]).select(key, out)

    e = index.select(key, route, F.col(index_order).alias("_i"), F.col(key).alias("_k"))
    c = cache.select(key, F.col(cache_order).alias("_c"))
    known = c.join(e.select(key, route), key)
    j = e.select(key, route, F.lit(True).alias("_e")).join(c.select(key, F.lit(True).alias("_a")), key, "full_outer")
    for df, by, out in ((e, "_i", "_in_route"), (e, "_k", "_by_key"), (known, "_c", "_here")):
        j = j.join(placed(df, by, out), key, "left")
    off = lambda p: F.count_if(F.col("_here") != F.col(p))
    out = j.groupBy(route).agg(
        F.count("_e").alias("expected"), F.count_if(F.col("_e").isNotNull() & F.col("_a").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("extra"), off("_in_route").alias("off_route_order"), off("_by_key").alias("off_key_order"),
    ).withColumn("exact", (F.col("missing") == 0) & (F.col("extra") == 0))
    return out.withColumn("ordered", F.col("exact") & ((F.col("off_route_order") == 0) | (F.col("off_key_order") == 0)))


def pack_rows(df: DataFrame, routes: Mapping, unicode_form: bool = True, required: Sequence[str] = ("id", "first_hyp", "second_hyp", "decode_lang", "lid_lang")) -> DataFrame:
    """Typed hypothesis rows; a missing required column or id is an error."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}")
    lid = F.lower(F.trim(F.coalesce("lid_lang", F.lit(""))))
    chosen = F.when(F.coalesce("decode_lang", F.lit("")) != "", F.col("decode_lang")).otherwise(lid)
    no_id = F.raise_error(F.lit("row without id")).cast(dict(df.dtypes)["id"])
    number = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.select(
        F.when(F.col("id").isNull(), no_id).otherwise(F.col("id")).alias("id"), lid.alias("lid_lang"), number("lid_p1").alias("lid_p1"),
        resolve_route(chosen, **routes).alias("decode_lang"), T.normalize(F.col("first_hyp"), unicode_form=unicode_form).alias("first_hyp"),
        number("first_score").alias("first_score"), T.normalize(F.col("second_hyp"), unicode_form=unicode_form).alias("second_hyp"), number("second_score").alias("second_score"),
    )


def json_records(df: DataFrame, column: str, schema: str, required: Sequence[str], group: str, min_valid: int, lists: Mapping[str, int] | None = None,
                 anchor: tuple[str, float] | None = None) -> DataFrame:
    """Per group the valid JSON records, the sizes of value lists, an anchored number and one ok flag.

    A required field must be a non-blank string; ``lists`` maps a field to its minimum
    number of distinct values; ``anchor`` is a field whose largest value must reach a number.
    """
    parsed = df.select(group, *[c for c in df.columns if c not in (group, column)], F.from_json(column, schema).alias("_j"))
    field = lambda n: F.col(n) if n in df.columns else F.col("_j")[n]
    valid = F.col("_j").isNotNull()
    for name in required:
        valid = valid & (F.trim(F.coalesce(field(name).cast("string"), F.lit(""))) != "")
    aggs = [F.count("*").alias("records"), F.count_if(valid).alias("valid")]
    ok = F.col("valid") >= min_valid
    for name, least in (lists or {}).items():
        aggs.append(F.count_distinct(field(name)).alias(f"n_{name}"))
        ok = ok & (F.col(f"n_{name}") >= least)
    if anchor:
        aggs.append(F.max(field(anchor[0]).cast("double")).alias("anchor"))
        ok = ok & F.coalesce(F.col("anchor") >= anchor[1], F.lit(False))
    return parsed.groupBy(group).agg(*aggs).withColumn("ok", ok)


def route_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of every column, from one aggregate over all of them."""
    fine = df.groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return fine.select("n", F.inline(pairs)).groupBy("column", "value").agg(F.sum("n").alias("n"))


def label_checks(df: DataFrame, key: str, text: str, language: str, expected: Column, *by: str) -> DataFrame:
    """Rows, speakers, duplicates, blanks and foreign languages per part."""
    per_key = df.groupBy(*by, key).agg(
        F.count("*").alias("_n"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("_blank"), F.count_if(F.col(language) != expected).alias("_foreign")
    )
    checks = per_key.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicated"), F.sum("_blank").alias("blank"), F.sum("_foreign").alias("other_language")
    )
    speakers = df.groupBy(*by).agg(F.count_distinct("speaker_id").alias("speakers"))
    return checks.join(speakers, list(by)).withColumn("ok", (F.col("duplicated") == 0) & (F.col("blank") == 0) & (F.col("other_language") == 0))
