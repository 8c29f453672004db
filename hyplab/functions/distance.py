"""Edit counts and pair similarities.

Short pairs go to the bit-vector kernels of ``edits``, long ones to Spark's own distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hyplab.functions import edits as E, text as T

EMPTY_REFERENCE = "<empty>"
# Pairs of up to so many words or characters go to the kernels.
SHORT_WORDS, SHORT_TEXT = 256, 1024
# Tokens of a longer pair become single characters: Latin-1 for up to 200 distinct tokens, a
# block of two-byte characters for up to 20,992, the supplementary planes beyond.
_SHORT, _BLOCK_START, _BLOCK_SIZE = 200, 0x4E00, 20_992
_PLANES_START, _PLANES_SIZE = 0x10000, 0x100000


def _codes(w: Column, vocab: Column, width: int) -> Column:
    if width > 1:
        start, charset = (_BLOCK_START, "UTF-16BE") if width == 2 else (_PLANES_START, "UTF-32")
        one = lambda x: F.lpad(F.hex(F.array_position(vocab, x) + F.lit(start - 1)), 2 * width, "0")
        return F.decode(F.unhex(F.array_join(F.transform(w, one), "")), charset)
    return F.array_join(F.transform(w, lambda x: F.char(F.array_position(vocab, x) + F.lit(32))), "")


def with_word_distance(df: DataFrame, out: str, left: Column, right: Column) -> DataFrame:
    """Add the edit distance of two token arrays.

    Short arrays that differ go to the kernel. In a longer pair every distinct token is
    mapped to one private character, then the built-in character distance does the work.
    The token arrays and the vocabulary are columns of their own, so no lambda computes
    them again per token.
    """
    a, b, v = F.col("_a"), F.col("_b"), F.col("_v")
    short = (F.size(a) <= SHORT_WORDS) & (F.size(b) <= SHORT_WORDS)
    asked = short & (a != b)
    too_wide = F.raise_error(F.lit("more distinct tokens in one pair than can be coded")).cast("int")
    distance = (
        F.when(a == b, F.lit(0))
        .when(F.size(a) == 0, F.size(b))
        .when(F.size(b) == 0, F.size(a))
        .when(short, E.list_distance(F.when(asked, a), F.when(asked, b)))
        .when(F.size(v) <= _SHORT, F.levenshtein(_codes(a, v, 1), _codes(b, v, 1)))
        .when(F.size(v) <= _BLOCK_SIZE, F.levenshtein(_codes(a, v, 2), _codes(b, v, 2)))
        .when(F.size(v) <= _PLANES_SIZE, F.levenshtein(_codes(a, v, 4), _codes(b, v, 4)))
        .otherwise(too_wide)
    )
    return (
        df.withColumns({"_a": left, "_b": right})
        .withColumn("_v", F.when(~short, F.array_distinct(F.concat(a, b))))
        .withColumn(out, distance.cast("long"))
        .drop("_a", "_b", "_v")
    )


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts."""
    short = (F.length(a) <= SHORT_TEXT) & (F.length(b) <= SHORT_TEXT)
    asked = short & (a != b)
    return F.when(a == b, F.lit(0)).when(short, E.text_distance(F.when(asked, a), F.when(asked, b))).otherwise(F.levenshtein(a, b))


def edit_counts(
    df: DataFrame,
    reference: str = "reference",
    hypothesis: str = "hypothesis",
    *,
    normalize: bool = False,
    sentinel: bool = True,
) -> DataFrame:
    """Add we, ce (word and character edits) and nw, nc (reference lengths).

    An empty reference counts as one sentinel token, and an empty hypothesis then
    matches it. This is a narrow transformation; score a pair once and keep the
    result, every later score is a ratio of sums over these four columns.
    """
    ref, hyp = F.col(reference), F.col(hypothesis)
    if normalize:
        ref, hyp = T.normalize(ref), T.normalize(hyp)
    else:
        ref, hyp = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    if sentinel:
        hyp = F.when((ref == "") & (hyp == ""), F.lit(EMPTY_REFERENCE)).otherwise(hyp)
        ref = F.when(ref == "", F.lit(EMPTY_REFERENCE)).otherwise(ref)
    staged = df.withColumns({"_ref": ref, "_hyp": hyp})
    r, h = F.col("_ref"), F.col("_hyp")
    staged = with_word_distance(staged, "we", T.words(r), T.words(h))
    return staged.withColumns(
        {
            "ce": char_distance(r, h).cast("long"),
            "nw": T.n_words(r).cast("long"),
            "nc": F.length(r).cast("long"),
        }
    ).drop("_ref", "_hyp")


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """The distance when it is at most ``limit``, else ``limit + 1``."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(limit + 1)).otherwise(d)


def pair_error(a: Column, b: Column) -> Column:
    """Character edits over the longer text; both empty 0, one empty 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(0.0))
        .when((a == "") | (b == ""), F.lit(1.0))
        .otherwise(char_distance(a, b) / longest)
    )


def with_pair_errors(df: DataFrame, out: str, pairs: str) -> DataFrame:
    """Add the pair errors of an array of structs with texts a and b; a row's pairs stay in the row."""
    short = lambda p: (p["a"] != p["b"]) & (F.length(p["a"]) <= SHORT_TEXT) & (F.length(p["b"]) <= SHORT_TEXT)
    asked = F.transform(pairs, lambda p: F.when(short(p), p["a"])), F.transform(pairs, lambda p: F.when(short(p), p["b"]))

    def error(p: Column, d: Column) -> Column:
        edits = F.coalesce(d, F.levenshtein(p["a"], p["b"]))
        return (
            F.when(p["a"] == p["b"], F.lit(0.0)).when((p["a"] == "") | (p["b"] == ""), F.lit(1.0))
            .otherwise(edits / F.greatest(F.length(p["a"]), F.length(p["b"])))
        )

    # an explode of one element: what stands behind it may use the errors in a lambda, where the kernel itself can't run
    found = df.withColumn("_edits", E.text_distances(*asked))
    return found.select(*df.columns, F.explode(F.array(F.zip_with(pairs, "_edits", error))).alias(out))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the pair error of two trimmed texts; a missing text is empty, two empty texts are alike."""
    return 1.0 - pair_error(F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit(""))))


def word_ratio(new: Column, old: Column) -> Column:
    """Words of ``new`` over words of ``old`` (at least one)."""
    return T.n_words(new) / F.greatest(T.n_words(old), F.lit(1))


def length_ok(new: Column, old: Column, lo: float = 0.5, hi: float = 2.0) -> Column:
    """The word ratio lies in lo..hi; an empty new text fails, an empty old one passes."""
    return (T.n_words(new) > 0) & ((T.n_words(old) == 0) | word_ratio(new, old).between(lo, hi))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(eps)))


def euclidean(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x))
