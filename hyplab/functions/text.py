"""Text projections as Column functions.

Everything stays in the JVM except Unicode NFKC, which Spark has no function
for; only rows with a non-ASCII character are sent to the Arrow kernel.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from hyplab.functions import fixed

PLACEHOLDERS = ("", ".", "nan", "null", "none")


@F.pandas_udf(StringType())
def _nfkc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC form; ASCII rows never carry their text to Python."""
    return F.coalesce(_nfkc_batch(F.when(c.rlike("[^\\x00-\\x7F]"), c)), c)


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(c, "[\\s\\u0085\\p{Z}]+", " "))


def normalize(c: Column, lowercase: bool = True, unicode_form: bool = True) -> Column:
    """The shared normal form of references and hypotheses; null gives ''.

    ``unicode_form=False`` skips NFKC for text that is known to be ASCII.
    """
    t = F.coalesce(c, F.lit(""))
    if unicode_form:
        t = nfkc(t)
    t = F.regexp_replace(t, "[\\x00-\\x1f\\x7f]", "")
    if lowercase:
        t = F.lower(t)
    t = F.when(F.trim(t).isin("nan", "null", "none"), F.lit("")).otherwise(t)
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}_\\s']+", " ")
    t = F.trim(F.regexp_replace(t, "\\s+", " "))
    t = F.regexp_replace(t, "\\s+'\\s+", " ")
    return F.btrim(t, F.lit("' "))


def words(c: Column) -> Column:
    """Tokens of an already normalised (single-spaced) text; '' gives an empty array."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def n_words(c: Column) -> Column:
    """Token count of a normalised text, without building the token array."""
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(
        F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    )


# --- scoring regimes (B03) and apostrophe profiles (B04) ---------------------------------


def keep(c: Column, unicode_form: bool = True) -> Column:
    t = F.coalesce(c, F.lit(""))
    t = nfkc(t) if unicode_form else t
    return squeeze(F.regexp_replace(t, "[\\p{Cc}\\p{Cf}]", ""))


def strip_punctuation(c: Column, unicode_form: bool = True) -> Column:
    return squeeze(F.regexp_replace(keep(c, unicode_form), "[\\p{P}&&[^']]", " "))


REGIMES: dict[str, Callable[[Column], Column]] = {
    "keep": keep,
    "strip_preserve_case": strip_punctuation,
    "lower_preserve_punctuation": lambda c: F.lower(keep(c)),
    "lower_strip": lambda c: F.lower(strip_punctuation(c)),
}


def _profile_base(c: Column, unicode_form: bool = True) -> Column:
    t = F.coalesce(c, F.lit(""))
    t = F.lower(nfkc(t) if unicode_form else t)
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}_\\s']+", " ")
    return F.btrim(F.regexp_replace(t, "\\s+", " "), F.lit("' "))


def apostrophe_profile(c: Column, profile: str) -> Column:
    """``challenge`` keeps, ``apostrophe_drop`` deletes, ``apostrophe_space`` splits."""
    base = _profile_base(c)
    if profile == "challenge":
        return base
    if profile == "apostrophe_drop":
        return squeeze(F.replace(base, F.lit("'"), F.lit("")))
    if profile == "apostrophe_space":
        return squeeze(F.replace(base, F.lit("'"), F.lit(" ")))
    raise ValueError(f"unknown apostrophe profile: {profile}")


# --- light ablations (B05) ------------------------------------------------------------


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), " {2,}", " "))


def drop_apostrophes(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(F.coalesce(c, F.lit("")), "['\\u2019\\u02bc]", ""))


def collapse_long_vowels(c: Column) -> Column:
    return collapse_spaces(F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)([aeiou])\\1{2,}", "$1"))


ABLATIONS: dict[str, Callable[[Column], Column]] = {
    "baseline": lambda c: F.coalesce(c, F.lit("")),
    "A_collapse_spaces": collapse_spaces,
    "B_strip_apostrophes": drop_apostrophes,
    "C_collapse_elong_vowels": collapse_long_vowels,
    "E_noop": lambda c: F.coalesce(c, F.lit("")),
}


# --- token-array tests and rewrites -----------------------------------------------------


def adjacent_repeats(w: Column) -> Column:
    """Number of tokens equal to the token before them."""
    return F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))


def is_stutter(w: Column) -> Column:
    """Single-letter noise, one short repeated token, or mostly short tokens."""
    n = F.size(w)
    kinds = F.size(F.array_distinct(w))
    short = F.size(F.filter(w, lambda x: F.length(x) <= 2))
    return (
        ((n >= 3) & F.forall(w, lambda x: F.length(x) <= 1))
        | ((n >= 4) & (kinds == 1) & (F.length(F.get(w, F.lit(0))) <= 2))
        | ((n >= 5) & (short / n >= 0.85) & (kinds <= 3))
    )


def _per_language(lang: Column, table: Mapping[str, Column], default: Column) -> Column:
    out: Column | None = None
    for code, value in table.items():
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return default if out is None else out.otherwise(default)


def replace_words(w: Column, lang: Column, maps: Mapping[str, Mapping[str, str]]) -> Column:
    """Exact word replacement by language, from small fixed maps."""

    def mapped(pairs: Mapping[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
        return F.transform(w, lambda x: F.coalesce(F.try_element_at(table, x), x))

    return _per_language(lang, {k: mapped(v) for k, v in maps.items() if v}, w)


def dedupe_short(w: Column, lang: Column, function_words: Mapping[str, tuple[str, ...]]) -> Column:
    """Drop a token equal to the one before it when it is short or a function word.

    Within a run of equal tokens all later ones go, so the previous kept token is
    always the previous token.
    """

    def deduped(extra: tuple[str, ...]) -> Column:
        def kept(x: Column, i: Column) -> Column:
            small = F.length(x) <= 3
            if extra:
                small = small | x.isin(*extra)
            return (i == 0) | (x != F.get(w, i - 1)) | ~small

        return F.filter(w, kept)

    return _per_language(lang, {k: deduped(v) for k, v in function_words.items()}, deduped(()))


def collapse_adjacent(w: Column) -> Column:
    """Keep the first of every run of equal tokens."""
    return F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1)))


def join_phrases(c: Column, phrases: Mapping[str, str]) -> Column:
    """B10, first half: phrase replacement, longest phrase first."""
    for old, new in sorted(phrases.items(), key=lambda kv: -len(kv[0])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def split_tokens(w: Column, table: Mapping[str, str]) -> Column:
    """B10, second half: one token to several."""
    if not table:
        return w
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.flatten(
        F.transform(w, lambda x: F.coalesce(F.split(F.try_element_at(lookup, x), " "), F.array(x)))
    )


def with_postprocess(
    df: DataFrame,
    text: str,
    lang: str,
    out: str,
    *,
    ortho: Mapping[str, Mapping[str, str]] = fixed.ORTHOGRAPHY,
    function_words: Mapping[str, tuple[str, ...]] = fixed.FUNCTION_SHORT,
    joins: Mapping[str, str] | None = None,
    splits: Mapping[str, str] | None = None,
    unicode_form: bool = True,
) -> DataFrame:
    """Stutter test, word map, deduplication, join and split maps, normal form.

    The lexicon step is ``operators.lexicon.split_prefix`` (B08); run it before. Every
    step is a column of its own, so nothing is computed twice in the lambdas.
    """
    raw, w, l = F.col("_raw"), F.col("_w"), F.col(lang)
    joined = F.array_join("_w", " ")
    staged = (
        df.withColumn("_raw", F.trim(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_w", words(normalize(raw, unicode_form=unicode_form)))
        .withColumn("_bad", is_stutter(w))
        .withColumn("_w", replace_words(w, l, ortho))
        .withColumn("_w", dedupe_short(w, l, function_words))
        .withColumn("_j", join_phrases(joined, joins) if joins else joined)
        .withColumn("_o", F.array_join(split_tokens(words(F.col("_j")), splits or {}), " "))
        .withColumn("_o", normalize(F.col("_o"), unicode_form=unicode_form))
    )
    result = F.when(raw.isin("", ".", "nan") | F.col("_bad") | (F.col("_o") == ""), F.lit(".")).otherwise(F.col("_o"))
    return staged.withColumn(out, result).drop("_raw", "_w", "_bad", "_j", "_o")


def strip_trailing(c: Column, fillers: tuple[str, ...]) -> Column:
    """Pop filler tokens from the end of a normalised text."""
    alt = "|".join(fillers)
    return F.regexp_replace(c, f"(^|\\s)({alt})(\\s({alt}))*$", "")


def with_clean_generation(
    df: DataFrame, text: str, seconds: str, out: str, rate: float = 2.2, foreign: str = fixed.FOREIGN
) -> DataFrame:
    """Cut at the first foreign character, cut loops, cap the words by duration.

    A loop is a 1-3 gram that has just come three times in a row; one copy stays.
    """
    w = F.col("_w")
    bad = F.array_position(F.transform(w, lambda x: x.rlike(f"[{foreign}]")), True)

    def ends_loop(i: Column, n: int) -> Column:
        # tokens i-3n+1 .. i (from 0) are three equal n-grams
        ok = i >= 3 * n - 1
        for k in range(2 * n):
            ok = ok & (F.get(w, i - k) == F.get(w, i - k - n))
        return ok

    size = lambda i: F.when(ends_loop(i, 1), 1).when(ends_loop(i, 2), 2).when(ends_loop(i, 3), 3).otherwise(0)
    first = F.array_position(F.transform("_loops", lambda n: n > 0), True).cast("int")
    staged = (
        df.withColumn("_w", words(squeeze(F.coalesce(F.col(text), F.lit("")))))
        .withColumn("_at", bad)
        .withColumn("_w", F.when(F.col("_at") > 0, F.slice(w, F.lit(1), (F.col("_at") - 1).cast("int"))).otherwise(w))
        .withColumn("_loops", F.transform(w, lambda x, i: size(i)))
        .withColumn("_at", first)
        .withColumn(
            "_w",
            F.when(F.col("_at") > 0, F.slice(w, F.lit(1), F.col("_at") - 2 * F.get("_loops", F.col("_at") - 1))).otherwise(w),
        )
    )
    if rate:
        most = F.greatest(F.lit(3), F.floor(F.col(seconds) * rate).cast("int") + 2)
        staged = staged.withColumn("_w", F.slice(w, F.lit(1), most))
    joined = F.array_join("_w", " ")
    return staged.withColumn(out, F.when(joined == "", F.lit(".")).otherwise(joined)).drop("_w", "_at", "_loops")


def has_tail_loop(w: Column, n: int = 3, times: int = 4) -> Column:
    """The text ends in an n-gram that comes at least ``times`` times."""
    size = F.size(w)
    tail = F.slice(w, F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    ok = F.lit(True)
    for k in range(1, times):
        ok = ok & (F.slice(w, F.greatest(size - n * (k + 1) + 1, F.lit(1)), F.lit(n)) == tail)
    return (size >= n * times) & ok


def ngrams(w: Column, n: int) -> Column:
    """Token n-grams of an array, joined by a space."""
    return F.when(
        F.size(w) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))


def repeated_ngrams(w: Column, n: int = 3) -> Column:
    grams = ngrams(w, n)
    return F.size(grams) - F.size(F.array_distinct(grams))


def top_token_count(w: Column) -> Column:
    """How often the most frequent token comes."""
    return F.coalesce(
        F.array_max(
            F.transform(F.array_distinct(w), lambda x: F.size(F.filter(w, lambda y: y == x)))
        ),
        F.lit(0),
    )


def unique_ratio(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))


def structure_ok(
    w: Column,
    floor_w: Column | None = None,
    *,
    min_unique: float = 0.55,
    min_avg_len: float = 2.5,
    max_top_share: float = 0.25,
    max_repeats: int = 1,
    min_bigram_unique: float = 0.55,
    max_unique_drop: float = 0.15,
) -> Column:
    """Reject stutter, collapsed and repetitive texts; optional drop against a floor text."""
    n = F.size(w)
    kinds = F.size(F.array_distinct(w))
    single = F.size(F.filter(w, lambda x: F.length(x) <= 1))
    chars = F.length(F.array_join(w, ""))
    uniq = kinds / n
    bigrams = ngrams(w, 2)
    bad = (
        ((n >= 3) & (single == n))
        | ((n >= 4) & (kinds == 1) & (F.length(F.get(w, F.lit(0))) <= 2))
        | (uniq < min_unique)
        | ((n >= 5) & (single / n >= 0.7))
        | (chars / n < min_avg_len)
        | ((n >= 8) & (top_token_count(w) / n > max_top_share))
        | (adjacent_repeats(w) > max_repeats)
        | ((n >= 8) & (F.size(F.array_distinct(bigrams)) / F.size(bigrams) < min_bigram_unique))
    )
    if floor_w is not None:
        bad = bad | ((F.size(floor_w) > 0) & (uniq < unique_ratio(floor_w) - max_unique_drop))
    return F.when(n == 0, F.lit(False)).otherwise(~bad)


# --- counts over characters and markers -----------------------------------------------------


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + pattern))


def marker_scores(c: Column) -> dict[str, Column]:
    """Weighted marker counts per 100 characters of a normalised text."""
    scale = 100.0 / F.greatest(F.length(c), F.lit(1))
    totals = {
        group: sum((count_of(c, p) * w for p, w in rules), F.lit(0.0)) * scale
        for group, rules in fixed.MARKERS.items()
    }
    return {
        "luo_marker": totals["luo"],
        "ach_marker": totals["ach"],
        "lug_marker": totals["lug"],
        "luo_minus_ach": totals["luo"] - totals["ach"],
    }


def ortho_score(lp_own: Column, lp_others: list[Column], luo_minus_ach: Column, lug_marker: Column) -> Column:
    """Language-model margin and marker score in one number."""
    rival = F.greatest(*lp_others) if len(lp_others) > 1 else lp_others[0]
    return 5.0 * (lp_own - rival) + 0.15 * (luo_minus_ach - 0.3 * lug_marker)


def plausible_language(c: Column, word_pattern: str = fixed.ENGLISH_WORDS) -> Column:
    """Long enough and not mostly ASCII text with three or more foreign function words."""
    t = F.trim(F.coalesce(c, F.lit("")))
    ascii_share = F.length(F.regexp_replace(t, "[^A-Za-z]", "")) / F.greatest(F.length(t), F.lit(1))
    return (F.length(t) >= 8) & ~((ascii_share > 0.85) & (count_of(t, word_pattern) >= 3))


def project_alphabet(c: Column, alphabet: str) -> Column:
    """Keep the characters of a literal alphabet and spaces."""
    return squeeze(F.regexp_replace(c, f"[^{alphabet} ]", ""))


def canonical_apostrophes(c: Column) -> Column:
    return F.translate(nfkc(F.coalesce(c, F.lit(""))), fixed.APOSTROPHES, "'" * len(fixed.APOSTROPHES))


def is_placeholder(norm: Column) -> Column:
    return norm.isin(*PLACEHOLDERS)


def fill_placeholder(c: Column, *fallbacks: Column, default: str = ".", unicode_form: bool = True) -> Column:
    """The first text that is not empty or a sentinel, else ``default``."""
    options = []
    for option in (c, *fallbacks):
        norm = normalize(option, unicode_form=unicode_form)
        options.append(F.when(~is_placeholder(norm), norm))
    return F.coalesce(*options, F.lit(default))


def label_length(w: Column) -> Column:
    """Labels plus a blank between adjacent repeats."""
    return F.size(w) + adjacent_repeats(w)
