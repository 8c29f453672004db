"""F: scores and summaries over scored hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.operators import counts as C, lexicon as X, score as S
from hyplab.plans import views as V
from hyplab.plans.registry import query

RATES = """R6(sum(we)::DOUBLE / sum(nw)) AS wer, R6(sum(ce)::DOUBLE / sum(nc)) AS cer,
  R6(0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(ce)::DOUBLE / sum(nc)) AS score"""
ROW_ERROR = "0.5::DOUBLE * (we::DOUBLE / greatest(nw, 1) + ce::DOUBLE / greatest(nc, 1))"


@query("f01_corpus_scores", f"""
SELECT system, count(*) AS n, sum(we)::BIGINT AS we, sum(ce)::BIGINT AS ce, sum(nw)::BIGINT AS nw, sum(nc)::BIGINT AS nc,
  {RATES} FROM scored GROUP BY system""")
def f01(spark, d):
    return S.corpus_scores(V.scored(spark, d), "system")


@query("f02_scores_by_language", f"""
SELECT system, CASE WHEN GROUPING(language) = 1 THEN 'overall' ELSE language END AS language,
  count(*) AS n, sum(we)::BIGINT AS we, sum(ce)::BIGINT AS ce, sum(nw)::BIGINT AS nw, sum(nc)::BIGINT AS nc, {RATES}
FROM scored GROUP BY GROUPING SETS ((system, language), (system))""")
def f02(spark, d):
    return S.scores_with_total(V.scored(spark, d), ["system"], "language")


@query("f03_macro_scores", """
SELECT system, R6(avg(we::DOUBLE / nw)) AS macro_wer, R6(avg(ce::DOUBLE / nc)) AS macro_cer,
  R6(sum(we::DOUBLE / nw * sqrt(nw)) / sum(sqrt(nw))) AS sqrt_wer,
  R6(sum(ce::DOUBLE / nc * sqrt(nc)) / sum(sqrt(nc))) AS sqrt_cer
FROM scored GROUP BY system""")
def f03(spark, d):
    return S.macro_scores(V.scored(spark, d), "system")


_KEEP = "trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))"
_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', '', 'g'), '[!-#%-&(-*,-/:-;?-@\\[-\\]_{{}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _regime_oracle() -> str:
    from hyplab.plans.oracle_views import edit_select

    k, s = _KEEP.format, _STRIP.format
    forms = {
        "keep": (k("reference"), k("hypothesis")),
        "strip_preserve_case": (s("reference"), s("hypothesis")),
        "lower_preserve_punctuation": (f"lower({k('reference')})", f"lower({k('hypothesis')})"),
        "lower_strip": (f"lower({s('reference')})", f"lower({s('hypothesis')})"),
    }
    parts = []
    for regime, (r, h) in forms.items():
        parts.append(f"SELECT language, 'symmetric' AS comparison, '{regime}' AS regime, {r} AS wr, {h} AS wh, {r} AS cr, {h} AS ch FROM rawutt")
        parts.append(f"SELECT language, 'counterfactual', '{regime}', {k('reference')}, {h}, {k('reference')}, {h} FROM rawutt")
        parts.append(f"SELECT language, 'mixed', '{regime}', {s('reference')}, {s('(' + h + ')')}, {k('reference')}, {k('(' + h + ')')} FROM rawutt")
    union = "\nUNION ALL ".join(parts)
    words = edit_select("forms", "wr", "wh", "language, comparison, regime, cr, ch")
    return f"""
    WITH forms AS ({union}),
    w AS ({words})
    SELECT language, comparison, regime, count(*) AS n, sum(we)::BIGINT AS we, sum(levenshtein(cr, ch))::BIGINT AS ce,
      sum(nw)::BIGINT AS nw, sum(length(cr))::BIGINT AS nc,
      R6(sum(we)::DOUBLE / sum(nw)) AS wer, R6(sum(levenshtein(cr, ch))::DOUBLE / sum(length(cr))) AS cer,
      R6(0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(levenshtein(cr, ch))::DOUBLE / sum(length(cr))) AS score
    FROM w GROUP BY ALL"""


@query("f04_scoring_regimes", _regime_oracle())
def f04(spark, d):
    return S.regime_scores(V.raw_utterances(spark, d), "reference", "hypothesis", "language", unicode_form=False)


@query("f05_beats_baseline", """
WITH t AS (SELECT language, system, sum(we)::DOUBLE / sum(nw) AS wer, sum(ce)::DOUBLE / sum(nc) AS cer FROM scored GROUP BY ALL)
SELECT t.language, t.system, R6(0.5 * t.wer + 0.5 * t.cer) AS mean_error, R6(0.5 * b.wer + 0.5 * b.cer) AS baseline_error,
  (0.5 * t.wer + 0.5 * t.cer < 0.5 * b.wer + 0.5 * b.cer) OR (t.wer < b.wer AND t.cer < b.cer) AS beats
FROM t JOIN t b ON b.language = t.language AND b.system = 'drop7'""")
def f05(spark, d):
    return S.compare_to_baseline(S.corpus_scores(V.scored(spark, d), "language", "system"), "system", "drop7", "language")


@query("f08_join_map", """
WITH t AS (SELECT id, language, string_split(reference, ' ') AS r, string_split(broken, ' ') AS h FROM glued),
g AS (SELECT id, language, r, h, unnest(range(1, len(h))) AS i FROM t),
c AS (SELECT g.language, h[i] || ' ' || h[i + 1] AS phrase, h[i] || h[i + 1] AS joined FROM g
  WHERE list_contains(r, h[i] || h[i + 1]) AND NOT list_contains(h, h[i] || h[i + 1]))
SELECT c.language, phrase, joined, count(*) AS n FROM c JOIN lex l ON l.language = c.language AND l.word = c.joined AND l.n >= 2
GROUP BY ALL HAVING count(*) >= 5""")
def f08_join(spark, d):
    return C.mine_joins(V.glued(spark, d), "reference", "broken", X.lexicon(V.utterances(spark, d)), min_n=5)


@query("f08_split_map", """
WITH t AS (SELECT id, language, string_split(broken, ' ') AS r, string_split(reference, ' ') AS h FROM glued),
g AS (SELECT id, language, r, h, unnest(range(1, len(r))) AS i FROM t),
c AS (SELECT g.language, r[i] AS a, r[i + 1] AS b FROM g
  WHERE list_contains(h, r[i] || r[i + 1]) AND NOT list_contains(r, r[i] || r[i + 1]))
SELECT c.language, c.a || c.b AS joined, c.a || ' ' || c.b AS phrase, count(*) AS n FROM c
JOIN lex la ON la.language = c.language AND la.word = c.a AND la.n >= 2
JOIN lex lb ON lb.language = c.language AND lb.word = c.b AND lb.n >= 2
GROUP BY ALL HAVING count(*) >= 5""")
def f08_split(spark, d):
    return C.mine_splits(V.glued(spark, d), "broken", "reference", X.lexicon(V.utterances(spark, d)), min_n=5)


@query("f09_word_counts", """
SELECT language, word, count(*) AS n FROM (
  SELECT language, unnest(list_concat(['<s>'], toks, ['</s>'])) AS word FROM utt WHERE split <> 'test') GROUP BY ALL""")
def f09_words(spark, d):
    return C.word_counts(V.utterances(spark, d).where("split <> 'test'"), "reference", "language", marks=True)


@query("f09_bigram_counts", """
WITH t AS (SELECT language, list_concat(['<s>'], toks, ['</s>']) AS w FROM utt WHERE split <> 'test')
SELECT language, w[i] AS a, w[i + 1] AS b, count(*) AS n FROM (SELECT language, w, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL""")
def f09_bigrams(spark, d):
    return C.bigram_counts(V.utterances(spark, d).where("split <> 'test'"), "reference", "language", marks=True)


@query("f10_char_ngram_counts", """
WITH t AS (SELECT language, '<' || reference || '>' AS s FROM utt WHERE split <> 'test'),
g AS (SELECT language, s[i : i + 2] AS ctx, s[i + 3 : i + 3] AS ch FROM (SELECT language, s, unnest(range(1, length(s) - 2)) AS i FROM t))
SELECT language, ctx, ch, count(*) AS n, (sum(count(*)) OVER (PARTITION BY language, ctx))::BIGINT AS ctx_n
FROM g GROUP BY language, ctx, ch""")
def f10(spark, d):
    grams = C.char_ngrams(V.utterances(spark, d).where("split <> 'test'"), "reference", "language", n=4)
    return C.with_context_totals(grams, "language")


@query("f11_confusion", """
SELECT language, decode_lang, count(*) AS n, R6(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY language)) AS share
FROM routes GROUP BY language, decode_lang""")
def f11(spark, d):
    return S.confusion(V.routes(spark, d), "language", "decode_lang")


@query("f11_routing_accuracy", """
SELECT decode_lang, count(*) AS n, R6(avg((language = decode_lang)::INT)) AS accuracy,
  R6(count(*)::DOUBLE / sum(count(*)) OVER ()) AS mass FROM routes GROUP BY ALL""")
def f11_accuracy(spark, d):
    from pyspark.sql import Window as W

    per = V.routes(spark, d).groupBy("decode_lang").agg(
        F.count("*").alias("n"), F.avg((F.col("language") == F.col("decode_lang")).cast("int")).alias("accuracy")
    )
    return per.withColumn("mass", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


@query("f12_best_system", """
SELECT language, system, R6(score) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY language ORDER BY score, pos) AS r FROM (
    SELECT language, system, pos, 0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(ce)::DOUBLE / sum(nc) AS score
    FROM scored GROUP BY ALL)) WHERE r = 1""")
def f12(spark, d):
    t = S.corpus_scores(V.scored(spark, d), "language", "system", "pos")
    return S.best_per_group(t, ["language"], F.col("score"), F.col("pos")).select("language", "system", "score")


@query("f13_confidence_summary", """
SELECT system, count(*) AS n, R6(avg(confidence)) AS mean, R6(stddev_pop(confidence)) AS std, R6(min(confidence)) AS min,
  R6(max(confidence)) AS max, R6(quantile_cont(confidence, 0.1)) AS p10, R6(quantile_cont(confidence, 0.5)) AS p50,
  R6(quantile_cont(confidence, 0.9)) AS p90 FROM pairs GROUP BY system""")
def f13(spark, d):
    return S.distribution(V.pairs(spark, d).select("system", "confidence"), "confidence", "system")


@query("f14_comparable", """
WITH t AS (SELECT language, system, avg(confidence) AS mean, stddev_pop(confidence) AS std FROM pairs GROUP BY ALL)
SELECT a.language, a.system AS system_a, b.system AS system_b, R6(abs(a.mean - b.mean)) AS mean_delta,
  R6(greatest(a.std, 1e-9) / greatest(b.std, 1e-9)) AS std_ratio, abs(a.mean - b.mean) < 0.0003::DOUBLE AS comparable
FROM t a JOIN t b ON a.language = b.language AND a.system < b.system""")
def f14(spark, d):
    stats = V.pairs(spark, d).groupBy("language", "system").agg(
        F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std")
    )
    return S.comparable(stats, "system", "language", limit=0.0003)


@query("f15_size_buckets", f"""
SELECT system, CASE WHEN nc < 40 THEN 'short' WHEN nc < 75 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n,
  min(nc) AS size_min, max(nc) AS size_max, count(*) FILTER (trim(hypothesis) IN ('', '.')) AS placeholders,
  sum(we)::BIGINT AS we, sum(ce)::BIGINT AS ce, sum(nw)::BIGINT AS nw, sum(nc)::BIGINT AS nc, {RATES}
FROM scored GROUP BY ALL""")
def f15(spark, d):
    return S.bucket_report(V.scored(spark, d), F.col("nc"), 40, 75, "system")


@query("f16_diff_stats", """
SELECT decode_lang, count(*) AS n, count(*) FILTER (trim(w.drop7) = trim(w.swap11)) AS n_same,
  count(*) FILTER (trim(w.drop7) <> trim(w.swap11)) AS n_diff
FROM routes r JOIN wide w USING (id) GROUP BY ALL""")
def f16(spark, d):
    w = V.wide(spark, d)
    base = V.routes(spark, d).select("id", "decode_lang").join(w.select("id", F.col("drop7").alias("target")), "id")
    return S.diff_stats(base, w.select("id", F.col("swap11").alias("target")), "id", "target", "decode_lang")


@query("f17_family_mass", """
WITH m AS (SELECT id, sum(CASE WHEN code IN ('en', 'de') THEN p ELSE 0 END) AS a, sum(CASE WHEN code IN ('fr', 'es') THEN p ELSE 0 END) AS b,
  sum(CASE WHEN code NOT IN ('en', 'de', 'fr', 'es') THEN p ELSE 0 END) AS o FROM probs GROUP BY id)
SELECT id, R6(a) AS mass_germanic, R6(b) AS mass_romance, R6(o) AS mass_other,
  CASE WHEN a = greatest(a, b, o) THEN 'germanic' WHEN b = greatest(a, b, o) THEN 'romance' ELSE 'other' END AS route FROM m""")
def f17(spark, d):
    return S.family_masses(V.probs(spark, d), "id", {"germanic": ("en", "de"), "romance": ("fr", "es")})


@query("f18_misroute_cost", f"""
SELECT language, R6(avg(1 - {ROW_ERROR}) FILTER (system = 'swap11')) AS own_score,
  R6(avg(1 - {ROW_ERROR}) FILTER (system = 'dup5')) AS other_score,
  R6(avg(1 - {ROW_ERROR}) FILTER (system = 'swap11') - avg(1 - {ROW_ERROR}) FILTER (system = 'dup5')) AS cost
FROM scored GROUP BY language""")
def f18(spark, d):
    return S.misroute_cost(V.scored(spark, d), "language", "swap11", "dup5")


@query("f19_win_counts", f"""
WITH e AS (SELECT id, language, max({ROW_ERROR}) FILTER (system = 'drop7') AS a, max({ROW_ERROR}) FILTER (system = 'swap11') AS b,
  max({ROW_ERROR}) FILTER (system = 'dup5') AS c FROM scored GROUP BY ALL)
SELECT language, count(*) AS n, count(*) FILTER (b < a) AS wins_swap11, count(*) FILTER (c < a) AS wins_dup5,
  count(*) FILTER (b < a OR c < a) AS wins_any FROM e GROUP BY language""")
def f19(spark, d):
    return S.win_counts(V.scored(spark, d), "id", "drop7", ["swap11", "dup5"], "language")


@query("f20_oov_table", """
WITH t AS (SELECT id, language, system, unnest(list_filter(string_split(hypothesis, ' '), lambda x: x <> '')) AS word FROM pairs),
f AS (SELECT t.id, t.language, t.system, avg((l.word IS NULL)::INT) AS oov, count(*) AS words
  FROM t LEFT JOIN lex l ON l.language = t.language AND l.word = t.word GROUP BY ALL),
v AS (SELECT system, count(DISTINCT (language, word)) AS types FROM t GROUP BY system)
SELECT f.system, any_value(v.types) AS types, sum(words)::BIGINT AS words, R6(avg(oov)) AS mean_oov
FROM f JOIN v USING (system) GROUP BY f.system""")
def f20(spark, d):
    return X.oov_table(V.pairs(spark, d), "hypothesis", X.lexicon(V.utterances(spark, d)), "language", "system")
