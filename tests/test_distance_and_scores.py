import random

import pytest
from pyspark.sql import functions as F

from hyplab.functions import distance as D, kernels as K, text as T
from hyplab.operators import fuse as M
from hyplab.operators import pairs as P, score as S


def brute(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    words = ["ka", "été", "na", "moko", "b", "nyonso"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    return [(i, text(), text()) for i in range(60)] + [(60, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(0, 300, 2)))]


def test_edit_counts_match_brute_force(spark, sample):
    df = spark.createDataFrame(sample, "id int, reference string, hypothesis string")
    for r in D.edit_counts(df).collect():
        ref, hyp = r["reference"] or "<empty>", r["hypothesis"]
        if not r["reference"] and not hyp:
            hyp = "<empty>"
        assert (r["we"], r["ce"]) == (brute(ref.split(), hyp.split()), brute(ref, hyp)), r
        assert (r["nw"], r["nc"]) == (len(ref.split()), len(ref))


def test_alignment_agrees_with_word_distance(spark, sample):
    df = spark.createDataFrame([s for s in sample if s[1] and s[2]], "id int, a string, b string")
    out = df.select("a", "b", K.alignment(F.col("a"), F.col("b")).alias("x"), K.alignment(F.col("a"), F.col("b"), True).alias("y")).collect()
    for r in out:
        for ops in (r["x"], r["y"]):
            assert sum(o["op"] != "C" for o in ops) == brute(r["a"].split(), r["b"].split())
            assert [o["ref"] for o in ops if o["ref"] is not None] == r["a"].split()
            assert [o["hyp"] for o in ops if o["hyp"] is not None] == r["b"].split()


def test_scores(spark):
    rows = [("en", "a b", "a b"), ("fr", "c d", "c x"), ("fr", "", "")]
    counts = D.edit_counts(spark.createDataFrame(rows, "language string, reference string, hypothesis string"))
    got = {r["language"]: r for r in S.scores_with_total(counts.withColumn("system", F.lit("s")), ["system"], "language").collect()}
    assert got["en"]["score"] == 0.0 and got["fr"]["wer"] == pytest.approx(1 / 3) and got["overall"]["nw"] == 5
    for c in ("n", "we", "ce", "nw", "nc"):
        assert got["overall"][c] == got["en"][c] + got["fr"][c]
    empty = S.corpus_scores(counts.where("false")).first()
    assert empty["wer"] == 0.0 and empty["score"] == 0.0


@pytest.mark.parametrize("a, b, want", [("", "", 0.0), ("a", "", 1.0), ("abcd", "abcf", 0.25)])
def test_pair_error(one, a, b, want):
    assert one(lambda x, y: D.pair_error(x, y), a, b) == want


def test_guards(one):
    assert one(lambda a, b: D.length_ok(a, b), "a b", "a b") is True
    assert one(lambda a, b: D.length_ok(a, b), "", "a b") is False
    assert one(lambda a, b: D.length_ok(a, b), "a", "") is True
    assert one(lambda a, b: D.length_ok(a, b), "a b c d e", "a b") is False
    assert one(lambda a, b: D.bounded_distance(a, b, 2), "kitten", "sitting") == 3


def test_similarity_and_merge(one):
    assert one(lambda a, b: D.similarity(a, b), "hello", "hello") == 1.0
    assert 0.5 < one(lambda a, b: D.similarity(a, b), "hello world", "hello earth") < 1.0
    assert one(lambda a, b: D.similarity(a, b), "", "x") == 0.0
    merge = lambda a, b, **k: one(lambda x, y: M.word_merge(x, y, K.alignment(x, y), **k), a, b)
    assert merge("the quick brown fox", "the quikc brown fox", min_similarity=0.6) == "the quikc brown fox"
    assert merge("the quick brown fox", "the quikc brwon fxo", min_similarity=0.3, max_edits=2) == "the quikc brwon fox"
    assert merge("the quick brown fox", "the zzzzz brown fox") == "the quick brown fox"
    assert merge("one two", "one two three") == "one two" and merge("one two", "one two three", allow_insert=True) == "one two three"
    assert merge("one two three", "one three", allow_delete=True) == "one three"
    assert merge("", "x y") == "x y" and merge("x y", ".") == "x y" and merge("", "") == "."


def test_alignment_is_cheapest_and_rebuilds_both_sides(spark):
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2))
        for diagonal in (False, True):
            ops = K.align_words(a, b, diagonal)
            assert [o["ref"] for o in ops if o["op"] != "I"] == a and [o["hyp"] for o in ops if o["op"] != "D"] == b
            cost = list(range(len(b) + 1))
            for x in a:
                row = [cost[0] + 1]
                for j, y in enumerate(b):
                    row.append(min(cost[j] + (x != y), cost[j + 1] + 1, row[j] + 1))
                cost = row
            assert sum(o["op"] != "C" for o in ops) == cost[-1]


def test_lattice_path_is_the_best_of_all(spark):
    from itertools import product

    import math

    texts = [("a b c", "a c c d"), ("x a", "a"), ("b", "c b b")]
    uni = spark.createDataFrame([("l", w, n) for w, n in (("a", 4), ("b", 3), ("c", 2), ("<s>", 5), ("d", 1))], "language string, word string, n long")
    counts = {("<s>", "a"): 3, ("a", "b"): 2, ("b", "c"): 2, ("a", "c"): 1, ("c", "d"): 1, ("b", "b"): 1}
    bi = spark.createDataFrame([("l", *k, n) for k, n in counts.items()], "language string, a string, b string, n long")
    df = spark.createDataFrame([(i, "l", x, y) for i, (x, y) in enumerate(texts)], "id long, language string, x string, y string")
    got = {r["id"]: r["fused"] for r in M.lattice_fusion(df, "id", "x", "y", bi, uni).collect()}
    unis = {"a": 4, "b": 3, "c": 2, "<s>": 5, "d": 1}
    for i, (x, y) in enumerate(texts):
        slots = K.align_words(x.split(), y.split(), True)
        value = {}
        for pick in product(*[["ref"] if o["op"] == "C" else ["ref", "hyp"] for o in slots]):
            total, last, words = 0.0, "<s>", []
            for o, side in zip(slots, pick):
                total += 0.2 if side == "ref" and o["op"] != "C" else 0.0
                if o[side] is None:
                    total -= 0.4
                else:
                    total += 0.3 * math.log10((counts.get((last, o[side]), 0) + 0.1) / max(0.1, unis.get(last, 0) + 0.1 * 4))
                    last = o[side]
                    words.append(last)
            value[" ".join(words) or "."] = max(total, value.get(" ".join(words) or ".", -1e9))
        assert value[got[i]] == max(value.values())


def test_prototype_margin(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0])], "label int, v array<double>")
    out = P.prototype_margin(df, P.prototypes(df, "label", "v", (0, 1)), "v", 0, 1).collect()
    assert all((r["margin"] > 0) == (r["label"] == 0) for r in out)


@pytest.mark.parametrize("short, block", [(200, 20_992), (2, 20_992), (2, 3)])
def test_word_distance_with_every_token_coding(spark, monkeypatch, short, block):
    monkeypatch.setattr(D, "_SHORT", short)
    monkeypatch.setattr(D, "_BLOCK_SIZE", block)
    rows = [("a b c d e f", "a x c e f g"), ("a b", "b a"), ("", "a b c d"), ("one two three four five", "one two four five six seven")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = D.with_word_distance(df, "d", T.words(F.col("x")), T.words(F.col("y"))).collect()
    assert [r["d"] for r in got] == [3, 2, 4, 3]


def test_word_distance_of_a_long_pair(spark):
    words = [f"w{i}" for i in range(3000)]
    other = words[:10] + ["new"] + words[10:2000] + words[2005:]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "x string, y string")
    assert D.with_word_distance(df, "d", T.words(F.col("x")), T.words(F.col("y"))).first()["d"] == 6
