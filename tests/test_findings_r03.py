"""One small test per mended finding of round 3."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from hyplab.functions import distance as D, kernels as K
from hyplab.operators import calibrate as C, counts as N, lexicon as X, lm as L, policy as Y, sizing
from hyplab.plans import sources_and_contracts as Q


def test_shards_may_be_folders_of_parts(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.limit(4).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    assert [tuple(r) for r in Q.a02(spark, str(tmp_path)).collect()] == [("documents.parquet", 10)]


def test_broadcast_hint_of_a_lexicon_does_not_reach_its_keys(spark):
    lex = spark.createDataFrame([("en", "mother", 3), ("en", "abandonment", 2)], "language string, word string, n long")
    asked = spark.createDataFrame([("en", "mothre"), ("en", "abandonmnet")], "language string, word string")
    near = X.nearest_words(asked, F.broadcast(lex), "language")
    assert sorted((r["word"], r["new"]) for r in near.collect()) == [("abandonmnet", "abandonment"), ("mothre", "mother")]
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def _distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        above = row
    return above[-1]


def test_kernels_give_the_edit_distance_of_short_and_long_pairs(spark):
    """Lengths around the word size of 64, letters of several planes, empty, equal, null and long texts."""
    r = random.Random(5)
    rows = [("", ""), ("", "a b"), ("a", None), (None, None), ("x y", "x y"), ("ab " * 500, "ba " * 400)]
    for _ in range(300):
        letters = r.choice(["ab ", "abcdefgh ", "aäß€𝄞 "])
        a = [r.choice(letters) for _ in range(r.choice((1, 5, 63, 64, 65, 127, 128, 129, 200)))]
        b = [r.choice(letters) if r.random() < 0.2 else x for x in a if r.random() > 0.1]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, a string, b string")
    df = D.with_word_distance(df.withColumn("c", D.char_distance(F.col("a"), F.col("b"))), "w", F.split("a", " "), F.split("b", " "))
    for i, a, b, c, w in df.where("a IS NOT NULL AND b IS NOT NULL").collect():
        assert (c, w) == (_distance(a, b), _distance(a.split(" "), b.split(" "))), (a, b)
    assert df.where("a IS NULL OR b IS NULL").where("c IS NOT NULL").count() == 0
    plan = D.edit_counts(df.select(F.col("a").alias("reference"), F.col("b").alias("hypothesis")))._jdf.queryExecution().executedPlan().toString()
    assert "list_distance" in plan and "text_distance" in plan


def _in_a_lambda(df, call):
    return any("lambdafunction" in line and call in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_grids_do_not_work_a_value_out_again_for_every_point(spark):
    df = spark.createDataFrame(
        [("t", "abcd", "abcx", 0.1), ("t", "abcd", "abcd", 0.3), ("u", "ab", "xy", 0.2)], "sample string, a string, b string, x double")
    cells = C.grid_cells(df.withColumn("value", D.pair_error(F.col("a"), F.col("b"))), F.col("value"), "sample", [0.0, 0.25, 0.5])
    assert sorted(map(tuple, cells.collect())) == [("t", 0, 1), ("t", 1, 1), ("u", 3, 1)]
    assert not _in_a_lambda(cells, "levenshtein") and not _in_a_lambda(cells, "text_distance")
    counts = df.select("x", *[F.lit(1).alias(c) for c in ("alt_we", "alt_ce", "base_we", "base_ce", "nw", "nc")])
    swept = C.margin_sweep(counts, F.round(F.col("x"), 9), F.col("x") > 0.15, [0.1, 0.2, 0.25])
    assert sorted((r["margin"], r["n_accept"]) for r in swept.collect()) == [(0.1, 3), (0.2, 2), (0.25, 1)]
    assert not _in_a_lambda(swept, "round(")


def test_alignments_of_a_batch_are_those_of_single_pairs(spark):
    """Both orders of preference; empty, null, equal and long texts."""
    r = random.Random(9)
    rows = [("", ""), ("", "a b"), ("a", ""), ("a", None), (None, "a"), ("a b " * 60, "b a " * 50)]
    for _ in range(400):
        a = [r.choice("abcd") for _ in range(r.choice((0, 1, 5, 12, 40)))]
        b = [r.choice("abcd") if r.random() < 0.3 else x for x in a if r.random() > 0.2] + [r.choice("abcd") for _ in range(r.randint(0, 3))]
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for first in (False, True):
        for a, b, ops in df.select("a", "b", K.alignment(F.col("a"), F.col("b"), first)).collect():
            want = None if a is None or b is None else K.align_words(a.split(), b.split(), first)
            assert (ops and [o.asDict() for o in ops]) == want or (not ops and not want), (a, b)


def test_short_alignments_are_not_made_pair_by_pair(monkeypatch):
    monkeypatch.setattr(K, "align_words", None)
    made = K._aligned(pa.array(["a b", "a b"]), pa.array(["a c", "b"]), False).to_pylist()
    assert [[o["op"] for o in ops] for ops in made] == [["C", "S"], ["D", "C"]]


def test_large_models_do_not_shuffle_the_text_with_every_token(spark, monkeypatch):
    rows = [(1, "en", "the cat sat"), (2, "en", "the dog"), (3, "fr", "le chat"), (4, "fr", ""), (5, "en", "a")]
    df = spark.createDataFrame([(*r, "x" + r[2]) for r in rows], "id long, language string, text string, more string")
    train = spark.createDataFrame([(lang, t) for _, lang, t in rows if t], "language string, reference string")
    makers = (
        lambda: L.char_logprobs(df, ["id"], "text", train, ("en", "fr")),
        lambda: L.transition_scores(df, ["id"], "text", train, ("en", "fr")),
        lambda: L.text_features(df, ["id"], "text", train),
    )
    small = [sorted(map(tuple, make().collect())) for make in makers]
    monkeypatch.setattr(L, "sized", lambda t: (t, False))
    for make, want in zip(makers, small):
        large = make()
        got = sorted(map(tuple, large.collect()))
        assert [[round(v, 9) if isinstance(v, float) else v for v in r] for r in got] == [[round(v, 9) if isinstance(v, float) else v for v in r] for r in want]
        keys = [line.split("functions=")[0] for line in large._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys=" in line]
        assert keys and not any("more#" in k for k in keys)


TEXTS = [(1, "a", "en", "the cat the dog"), (2, "a", "en", "the cow eht"), (1, "b", "en", "the the cat"), (3, "a", "fr", "le chat the"),
         (4, "a", "en", ""), (5, "b", "de", "der hund"), (6, "b", None, "the cat")]
LEXICON = {("en", "the"): 9, ("en", "cat"): 3, ("en", "dog"): 1, ("fr", "le"): 5, ("fr", "chat"): 1, ("fr", "the"): 1}


def _texts(spark):
    df = spark.createDataFrame(TEXTS, "id long, system string, language string, hypothesis string")
    lex = spark.createDataFrame([(*k, n) for k, n in LEXICON.items()], "language string, word string, n long")
    return df, lex


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _unknown(language, words):
    return sum((language, w) not in LEXICON for w in words)


def _few(monkeypatch):
    """Two words are frequent, the others are beyond the bound."""
    monkeypatch.setattr(X, "frequent", lambda t: sizing.frequent(t, max_rows=2))


def test_counts_are_cut_where_the_frequent_rows_end(spark):
    _, lex = _texts(spark)
    for most, want in ((1, {"the"}), (2, {"the", "le"}), (3, {"the", "le", "cat"}), (5, {"the", "le", "cat"})):
        hot, rest = sizing.frequent(lex, max_rows=most)
        assert {r["word"] for r in hot.collect()} == want and hot.count() + rest.count() == len(LEXICON)
    hot, rest = sizing.frequent(lex, max_rows=6)
    assert rest is None and hot.count() == 6


def test_tokens_of_frequent_words_are_not_shuffled(spark, monkeypatch):
    df, lex = _texts(spark)
    want = {(i, s): _unknown(l, t.split()) / len(t.split()) for i, s, l, t in TEXTS if t}
    for cut in (False, True):
        if cut:
            _few(monkeypatch)
        shares = Y.oov_share(df, ["id", "system"], "hypothesis", lex)
        assert {(r["id"], r["system"]): r["oov"] for r in shares.collect()} == want
        stats = X.lexical_stats(df, ["id", "system"], "hypothesis", lex, "language")
        assert {(r["id"], r["system"]): r["oov"] for r in stats.collect()} == want | {(4, "a"): 0.0}
        assert not any("hypothesis" in line for line in _plan(stats).splitlines() if "Exchange hashpartitioning" in line)
        for made in (shares, stats):
            assert ("Union" in _plan(made)) == cut and "BroadcastHashJoin" in _plan(made)


def test_types_meet_the_lexicon_once(spark):
    df, lex = _texts(spark)
    made = X.oov_table(df, "hypothesis", lex, "language", "system")
    got = {r["system"]: (r["types"], r["words"], round(r["mean_oov"], 12)) for r in made.collect()}
    for system in "ab":
        texts = [(l, t.split()) for _, s, l, t in TEXTS if s == system and t]
        types, words = len({(l, w) for l, ws in texts for w in ws}), sum(len(ws) for _, ws in texts)
        assert got[system] == (types, words, round(sum(_unknown(l, ws) / len(ws) for l, ws in texts) / len(texts), 12))
    # no join is above the tokens themselves
    assert _plan(made).index("Join") < _plan(made).index("Generate") and "keys=[id" not in _plan(made)


def test_pairs_without_a_known_joined_form_are_not_shuffled(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "en", "the re is a no de to day"), (2, "en", "to day no de"), (3, "fr", "to day")], "id long, language string, text string")
    train = spark.createDataFrame([("en", "no de x"), ("en", "we go")], "language string, reference string")
    lex = spark.createDataFrame([("en", "there", 3), ("en", "node", 9), ("en", "today", 4), ("en", "isa", 9), ("en", "ano", 2)], "language string, word string, n long")
    want = {1: "there is a node today", 2: "today node", 3: "to day"}
    for small in (True, False):
        if not small:
            monkeypatch.setattr(X, "sized", lambda t: (t, False))
        counted = N.bigram_counts(train, "reference", "language", among=X.joinable(lex, "language"))
        made = X.join_split_words(texts, ["id"], "text", lex, counted, "language", "out")
        assert {r["id"]: r["out"] for r in made.collect()} == want
        lines = counted._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert next(i for i, x in enumerate(lines) if "Aggregate" in x) < next(i for i, x in enumerate(lines) if "LeftSemi" in x)
        assert [tuple(r) for r in counted.collect()] == [("en", "no", "de", 1)]


def test_trigrams_of_a_small_model_are_scored_where_the_texts_are(spark, monkeypatch):
    """Unknown contexts, letters of other planes, empty and null texts and languages."""
    df, _ = _texts(spark)
    df = df.unionByName(spark.createDataFrame([(7, "b", "en", "zß𝄞 cat"), (8, "b", "en", None), (9, "b", "xx", "a")], df.schema))
    train = spark.createDataFrame([("en", "the cat"), ("en", "the dog"), ("en", "the ß"), ("fr", "le chat")], "language string, reference string")
    small = L.text_features(df, ["id", "system"], "hypothesis", train)
    assert "trigram_mean" in _plan(small)
    rounded = lambda t: sorted([round(v, 9) if isinstance(v, float) else str(v) for v in r] for r in t.collect())
    want = rounded(small)
    monkeypatch.setattr(L, "sized", lambda t: (t, False))
    monkeypatch.setattr(X, "frequent", lambda t: sizing.frequent(t, max_rows=1))
    assert rounded(L.text_features(df, ["id", "system"], "hypothesis", train)) == want
