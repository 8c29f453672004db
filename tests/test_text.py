import unicodedata

import pytest
from pyspark.sql import functions as F

from hyplab.functions import text as T


@pytest.mark.parametrize("raw, want", [
    ("  Hello, WORLD!  ", "hello world"), (None, ""), ("nan", ""), (" NULL ", ""), ("None", ""), ("a\nb", "ab"), ("don't", "don't"),
    ("'quoted'", "quoted"), ("a ' b", "a b"), ("ﬁne Ｗide", "fine wide"), ("Été—là", "été là"), ("x_y", "x_y"), ("", ""),
])
def test_normalize(one, raw, want):
    assert one(lambda a, b: T.normalize(a), raw) == want


def test_nfkc_only_touches_non_ascii(one):
    s = "²½ ﬀ Å"
    assert one(lambda a, b: T.nfkc(a), s) == unicodedata.normalize("NFKC", s)


@pytest.mark.parametrize("text, bad", [("a b c", True), ("aa aa aa aa", True), ("ab cd ab cd ab", True), ("hello there my friend", False), ("", False), ("a b", False)])
def test_stutter(one, text, bad):
    assert one(lambda a, b: T.is_stutter(T.words(a)), text) is bad


def test_structure(one):
    ok = lambda t: one(lambda a, b: T.structure_ok(T.words(a)), t)
    assert not ok("a a a a a") and not ok("x x x x") and not ok("")
    assert ok("pi madiet teng pi man tie yieri matie")


@pytest.mark.parametrize("text, seconds, want", [
    ("one two two two three", 60.0, "one two"), ("a b a b a b c", 60.0, "a b"), ("x y zũ w", 60.0, "x y"), ("a b c d e f g h", 1.0, "a b c d"), ("", 5.0, "."),
])
def test_clean_generation(spark, text, seconds, want):
    df = spark.createDataFrame([(text, seconds)], "t string, s double")
    assert T.with_clean_generation(df, "t", "s", "o").first()["o"] == want


def test_postprocess(spark):
    rows = [("a b c d", "lin", "."), ("nan", "lin", "."), ("eglize ya ya moko", "lin", "eglise ya moko"), ("mhombe mhombe", "sna", "mombe mombe")]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, l string")
    got = [r["o"] for r in T.with_postprocess(df, "t", "l", "o").collect()]
    assert got == [r[2] for r in rows]


def test_placeholder_and_fillers(one):
    assert one(lambda a, b: T.fill_placeholder(a, b), ".", "Hi") == "hi"
    assert one(lambda a, b: T.fill_placeholder(a, b), None, "null") == "."
    assert one(lambda a, b: T.strip_trailing(a, ("aa", "ah")), "ne aa ah aa") == "ne"


def test_long_vowels_and_tail_loop(one):
    assert one(lambda a, b: T.collapse_long_vowels(a), "baaaaa  moo ooo") == "ba moo o"
    assert one(lambda a, b: T.has_tail_loop(T.words(a)), "x a b c a b c a b c a b c") is True
    assert one(lambda a, b: T.has_tail_loop(T.words(a)), "a b c a b c a b c") is False


def test_no_python_in_ascii_projection(spark):
    df = spark.range(1).select(T.normalize(F.lit("Abc"), unicode_form=False).alias("x"))
    plan = df._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
