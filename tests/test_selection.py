import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyplab.functions import kernels as K
from hyplab.operators import calibrate as C, fuse as M, gates as G, lexicon as X, policy as Y, promote as P, resample as R


def test_fusion_reasons(spark):
    rows = [
        ("", "", None, "lug", "lug", 0.5, "both_empty"), ("a", "", None, "lug", "lug", 0.5, "second_empty"), ("", "b", None, "lug", "lug", 0.5, "first_empty"),
        ("a", "b", None, "ach", "luo", 0.6, "open_set"), ("a", "b", -0.9, "lug", "lug", 0.95, "first_weak"), ("a", "b", -0.05, "lug", "lug", 0.95, "domain_strong"),
        ("a", "b", None, "lug", "eng", 0.3, "default_first"), ("a", "b", None, "lug", "luo", None, "default_first"),
    ]
    df = spark.createDataFrame(rows, "a string, b string, s double, d string, l string, p double, want string")
    for r in df.select("want", M.fuse_two(*[F.col(c) for c in "absdlp"]).alias("f")).collect():
        assert r["f"]["reason"] == r["want"]


def test_overlay(spark):
    floor = spark.createDataFrame([("A", "hello world"), ("B", "")], "id string, t string")
    new = spark.createDataFrame([("A", "hello earth", 2), ("A", "hello moon", 1), ("B", " ", 3)], "id string, t string, o int")
    assert {r["id"]: r["t"] for r in M.overlay(floor, new, "id", "t", "o").collect()} == {"A": "hello earth", "B": "."}
    with pytest.raises(Exception, match="unknown id"):
        M.overlay(floor, spark.createDataFrame([("Z", "x", 1)], "id string, t string, o int"), "id", "t", "o").collect()


def test_lexicon_correction_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abn") for _ in range(n))
    lex = {word(rng.randint(3, 14)): rng.randint(1, 9) for _ in range(400)}
    lex.update({"n" + word(25): 3 for _ in range(40)})
    queries = {word(rng.randint(2, 14)) for _ in range(200)}
    for w in [w for w in lex if len(w) > 20]:
        i = rng.randrange(1, len(w) - 2)
        queries.add(w[:i] + w[i + 1 :])
        queries.add(w[:i] + "x" + w[i:-1])
    from test_distance_and_scores import brute

    want = {}
    for q in queries - set(lex):
        k = 0 if len(q) <= 3 else 1 if len(q) <= 5 else 2
        near = [(brute(q, w), -n, len(w), w) for w, n in lex.items() if k and w[0] == q[0] and abs(len(w) - len(q)) <= k]
        near = [x for x in near if x[0] <= k]
        if near:
            d, n, _, w = min(near)
            if -n >= 2 or d == 1:
                want[q] = w
    texts = spark.createDataFrame([("l", " ".join(queries))], "language string, t string")
    table = spark.createDataFrame([("l", w, n) for w, n in lex.items()], "language string, word string, n long")
    got = {r["word"]: r["new"] for r in X.corrections(texts, "t", table, "language").collect()}
    assert got == want and len(want) > 50


def test_chunk_merge_matches_sequential_rule(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for conv in range(12):
        merged = []
        for turn in range(25):
            w = [rng.choice("abc") for _ in range(rng.choice((0, 1, 2, 5, 13, 20)))]
            rows.append((conv, turn, " ".join(w)))
            k = next((s for s in range(min(12, len(merged), len(w)), 0, -1) if merged[-s:] == w[:s]), 0)
            merged += w[k:]
        want[conv] = " ".join(merged)
    df = spark.createDataFrame(rows, "c long, t long, x string")
    for segment in (3, M.SEGMENT):
        pieces = M.merge_chunks(df, "c", "t", "x", segment)
        got = M.merged_text(pieces, "c", "t")
        assert {r["c"]: r["text"] for r in got.collect()} == want


def test_long_conversation_of_short_turns_merges_in_parts(spark):
    rng = random.Random(8)
    merged, rows = [], []
    for turn in range(6000):
        w = [rng.choice("ab") for _ in range(rng.choice((1, 1, 2, 3)))]
        rows.append((5, turn, " ".join(w)))
        k = next((s for s in range(min(12, len(merged), len(w)), 0, -1) if merged[-s:] == w[:s]), 0)
        merged += w[k:]
    df = spark.createDataFrame(rows, "c long, t long, x string").repartition(6)
    parts = M.merged_parts(M.merge_chunks(df, "c", "t", "x"), "c", "t").collect()
    assert len(parts) > 20 and [r["part"] for r in sorted(parts, key=lambda r: r["part"])] == list(range(len(parts)))
    assert " ".join(r["text"] for r in sorted(parts, key=lambda r: r["part"])) == " ".join(merged)


def test_ablations_join_split_words_of_one_language(spark):
    texts = spark.createDataFrame([
        (1, "l", "to day  we aaare in it's"), (2, "m", "to day we go"), (3, "l", "day to day"), (4, "l", ""), (5, "l", None)],
        "id long, language string, x string")
    lex = spark.createDataFrame([("l", "today", 5), ("m", "today", 9), ("l", "wego", 2)], "language string, word string, n long")
    pairs = spark.createDataFrame([("l", "to", "day", 1)], "language string, a string, b string, n long")
    got = {(r["id"], r["method"]): r["out"] for r in X.ablations(texts, ["id"], "x", lex, pairs, "language", "l").collect()}
    assert len(got) == 5 * 6 and {got[5, m] for m in ("baseline", "D_join_splits", "E_noop")} == {""}
    assert got[2, "D_join_splits"] == "to day we go" and got[3, "D_join_splits"] == "day today" and got[4, "D_join_splits"] == ""
    assert got[1, "A_collapse_spaces"] == "to day we aaare in it's" and got[1, "B_strip_apostrophes"].endswith("its")
    assert got[1, "C_collapse_elong_vowels"] == "to day we are in it's"
    # a pair that was seen twice is no split word
    pairs = pairs.withColumn("n", F.col("n") + 1)
    again = X.ablations(texts, ["id"], "x", lex, pairs, "language", "l").where("id = 3 AND method = 'D_join_splits'").first()
    assert again["out"] == "day to day"


def test_best_alternates_rank_by_corpus_score(spark):
    rows = [("base", 0, 0, 9, 9), ("b", 2, 1, 9, 9), ("a", 1, 2, 9, 9), ("c", 5, 5, 9, 9), ("d", 4, 0, 18, 18)]
    counts = spark.createDataFrame(rows, "system string, we long, ce long, nw long, nc long")
    assert [r["alt"] for r in Y.best_alternates(counts, "base", 3).collect()] == ["d", "a", "b"]


def _calibrate(pos, neg, cap=0.05):
    """The scan over all candidates, for comparison."""
    scores = sorted(set(pos + neg))
    cands = sorted(set(scores + [0.5 * (a + b) for a, b in zip(scores, scores[1:])] + [max(neg) + 1e-9, max(neg) + 1e-3]))
    ok = [(-sum(p >= t for p in pos), sum(n >= t for n in neg), t) for t in cands if sum(n >= t for n in neg) / len(neg) <= cap + 1e-12]
    return min(ok) if ok else None


@pytest.mark.parametrize("seed", range(3))
def test_threshold_calibration(spark, seed):
    rng = random.Random(seed)
    pos = [round(rng.gauss(0.6, 0.2), 2) for _ in range(60)]
    neg = [round(rng.gauss(0.4, 0.2), 2) for _ in range(50)]
    df = spark.createDataFrame([(x, True) for x in pos] + [(x, False) for x in neg], "s double, y boolean")
    r = C.best_threshold(df, "s", F.col("y")).first()
    tp, fp, t = _calibrate(pos, neg)
    assert (r["tp"], r["fp"]) == (-tp, fp) and r["threshold"] == pytest.approx(t)


def test_threshold_fails_closed(spark):
    only = spark.createDataFrame([(0.5, True)], "s double, y boolean")
    assert C.best_threshold(only, "s", F.col("y")).first()["note"] == "empty_class_fail_closed"
    masses = lambda a, b: [(*a, True)] * 20 + [(*b, False)] * 20
    schema = "mass_a double, mass_b double, mass_c double, y boolean"
    good = C.grid_calibration(spark.createDataFrame(masses((0.8, 0.05, 0.1), (0.2, 0.6, 0.1)), schema), F.col("y")).first()
    assert good["tpr"] == 1.0 and good["fpr"] == 0.0 and good["min_a"] == 0.45
    closed = C.grid_calibration(spark.createDataFrame(masses((0.8, 0.05, 0.1), (0.8, 0.05, 0.1)), schema), F.col("y")).first()
    assert closed["note"] == "fail_closed_zero_accept" and closed["min_a"] == 1.01


def test_mixture_weights():
    rng = np.random.default_rng(0)
    a = np.sort(rng.random((29, 3)), axis=0)
    for w in ([0.2, 0.3, 0.5], [1.0, 0.0, 0.0], [0.0, 0.6, 0.4]):
        assert C.simplex_weights(a, a @ np.array(w)) == pytest.approx(w, abs=1e-8)


def test_residual_gate_order(spark):
    base = dict(floor_hyp="pii madit dok i teng yadi", new_hyp="pi madiet teng pi man tie yieri", p1=0.999, lang2="lug", ortho=3.0, lp_own=-1.0, lp_rival=-1.2, error=0.20, already_dual=False)
    cases = [({}, "strict+soft"), ({"already_dual": True}, "already_dual"), ({"new_hyp": "."}, "empty_or_same"), ({"new_hyp": "a b"}, "length_guard"),
             ({"lang2": "ach"}, "lid_mass_fail"), ({"lang2": "eng"}, "lid_mass_fail"), ({"p1": 0.5}, "lid_mass_fail"), ({"ortho": 1.0}, "no_path"), ({"error": 0.4}, "strict")]
    names = list(base)
    rows = [tuple({**base, **change}[n] for n in names) for change, _ in cases]
    df = spark.createDataFrame(rows, "floor_hyp string, new_hyp string, p1 double, lang2 string, ortho double, lp_own double, lp_rival double, error double, already_dual boolean")
    assert [r["reason"] for r in G.residual_stack(df.coalesce(1), min_similarity=None).collect()] == [c[1] for c in cases]


def test_bootstrap_sign(spark):
    rows = [(i, f"s{i % 7}", 1, 1, 2, 2, 10, 50) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, speaker_id string, we long, ce long, base_we long, base_ce long, nw long, nc long")
    for r in (R.group_bootstrap(df, "speaker_id", 1, 50).first(), R.row_bootstrap(df, 1, 20).first(), R.row_mean_bootstrap(df, "speaker_id", 1, 50).first()):
        assert r["mean"] == pytest.approx(0.06) and r["p_gt_0"] == 1.0
    total = R.poisson_weights(df, "id", 3, 40).agg(F.sum("weight") / (140 * 40)).first()[0]
    assert total == pytest.approx(1.0, abs=0.06)


def test_checkpoint_choice(spark):
    rows = [("a", 1, 0.30, False), ("a", 2, 0.20, False), ("a", 3, 0.25, True), ("b", 5, 0.4, False), ("b", 4, 0.4, False)]
    df = spark.createDataFrame(rows, "track string, step int, select_error double, select_beats boolean")
    assert {r["track"]: r["step"] for r in P.choose_checkpoint(df, "track").collect()} == {"a": 3, "b": 4}


def test_report_honesty(spark):
    rows = [(l, s, w, w, 10) for l in ("x", "y", "z") for s, w in (("own", 0.1), ("base", 0.2))]
    m = spark.createDataFrame(rows, "language string, system string, wer double, cer double, n long")
    assert all(r["beats"] and r["all_beat"] for r in P.report_rows(m, "language", "own", "base", report_slice="r", select_slice="s").collect())
    with pytest.raises(ValueError):
        P.report_rows(m, "language", "own", "base", report_slice="r", select_slice="r")
    with pytest.raises(Exception, match="contradicts"):
        P.report_rows(m.withColumn("claim", F.lit(False)), "language", "own", "base", report_slice="r", select_slice="s", claimed="claim").collect()


def test_lattice_fusion(spark):
    df = spark.createDataFrame([(1, "l", "na ko", "na ba ko"), (2, "l", "", "x"), (3, "l", "a", "a")], "id int, language string, f string, s string")
    uni = spark.createDataFrame([("l", w, 5) for w in ("<s>", "</s>", "na", "ba", "ko", "a", "x")], "language string, word string, n long")
    bi = spark.createDataFrame([("l", "na", "ba", 5), ("l", "ba", "ko", 5), ("l", "<s>", "na", 5)], "language string, a string, b string, n long")
    fuse = lambda **k: {r["id"]: r["fused"] for r in M.lattice_fusion(df, "id", "f", "s", bi, uni, **k).collect()}
    assert fuse(lm_weight=0.0, first_bias=1.0, deletion=0.0) == {1: "na ko", 2: ".", 3: "a"}
    assert fuse(lm_weight=0.0, first_bias=-1.0, deletion=0.0) == {1: "na ba ko", 2: "x", 3: "a"}
    assert fuse(lm_weight=1.0, first_bias=0.0, deletion=-5.0)[1] == "na ba ko"


def test_anomaly_reasons_and_medoid(spark):
    rows = [("na ko", "na k", 0.0, 0.0, 0.5, "dangling_one_character_terminal"), ("na moko", "na moko mok", 0.0, 0.0, 0.5, "trailing_prefix_fragment"),
            ("aa bb cc", "aa xx yy zz cc", 0.0, 0.3, 0.1, "localized_one_to_three_expansion;production_oov_blowup_gt_0.10"), ("aa bb", "aa bb", 0.0, 0.0, 0.0, "")]
    df = spark.createDataFrame(rows, "a string, b string, oa double, ob double, d double, want string")
    ops = K.alignment(F.col("a"), F.col("b"))
    got = df.select("want", M.anomaly_reasons(*[F.col(c) for c in ("a", "b", "oa", "ob", "d")], ops).alias("r")).collect()
    # a dangling one-letter word is also a prefix of the word before it in the first row
    assert [set(r["r"].split(";")) >= set(r["want"].split(";")) for r in got] == [True] * 4 and got[3]["r"] == ""
    hyps = spark.createDataFrame([(1, 0, "p", "abcd"), (1, 1, "q", "abce"), (1, 2, "r", "abxe"), (2, 0, "p", "same"), (2, 1, "q", "same")], "id int, pos int, system string, hypothesis string")
    assert {r["id"]: r["text"] for r in M.medoid(hyps, "p").collect()} == {1: "abce", 2: "same"}


def test_fold_pieces_equal_plain_greedy():
    import random

    from hyplab.operators.select import _fold_pieces

    rng = random.Random(3)
    for _ in range(500):
        k = rng.randrange(1, 7)
        sizes = {rng.randrange(1, rng.choice([5, 40, 1000])): rng.randrange(1, rng.choice([3, 30])) for _ in range(rng.randrange(1, 6))}
        histogram = sorted(sizes.items(), reverse=True)
        loads, want, got = [0] * k, [], []
        pieces = _fold_pieces(histogram, k)
        for rows, n in histogram:
            mine = [p for p in pieces if p[0] == rows]
            for pos in range(n):
                fold = loads.index(min(loads))
                loads[fold] += rows
                want.append(fold)
                piece = max((p for p in mine if p[1] <= pos), key=lambda p: p[1])
                got.append(piece[2][(pos - piece[1]) % len(piece[2])])
        assert got == want
    assert len(_fold_pieces([(10**9, 1), (1, 10**10)], 5)) < 20


def test_ids_in_two_parts_are_an_error(spark):
    from hyplab.operators import contracts as C

    good = spark.createDataFrame([(1, "train"), (2, "test"), (1, "train")], "id int, part string")
    assert C.require_disjoint(good, "id", "part").count() == 3
    bad = good.union(spark.createDataFrame([(2, "train")], "id int, part string"))
    with pytest.raises(Exception, match="more than one part: 2"):
        C.require_disjoint(bad, "id", "part").collect()
