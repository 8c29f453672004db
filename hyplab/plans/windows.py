"""G and H: picks, splits and ranked selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.functions import distance as D
from hyplab.operators import joins as J, select as S
from hyplab.plans import views as V
from hyplab.plans.registry import query

SEED = 20260809
SETS = {"en": ("en", "fr", "de"), "fr": ("fr", "es")}


@query("g01_max_confidence", """
SELECT id, system, hypothesis, R6(confidence) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, pos) AS r FROM hyp) WHERE r = 1""")
def g01(spark, d):
    return S.pick_max(V.hypotheses(spark, d))


@query("g02_margin_or_primary", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, pos) AS r,
  lead(confidence) OVER (PARTITION BY id ORDER BY confidence DESC, pos) AS second FROM hyp WHERE NOT (pos = 0 AND confidence < -0.09::DOUBLE)),
b AS (SELECT id, system, hypothesis, confidence - coalesce(second, -1e9) AS margin FROM r WHERE r = 1),
p AS (SELECT id, system, hypothesis FROM r WHERE pos = 0)
SELECT b.id, CASE WHEN margin >= 0.02::DOUBLE OR p.id IS NULL THEN b.system ELSE p.system END AS system,
  CASE WHEN margin >= 0.02::DOUBLE OR p.id IS NULL THEN b.hypothesis ELSE p.hypothesis END AS hypothesis, R6(margin) AS margin,
  CASE WHEN margin >= 0.02::DOUBLE THEN 'margin_ok' WHEN p.id IS NOT NULL THEN 'primary_fb' ELSE 'primary_missing' END AS note
FROM b LEFT JOIN p ON p.id = b.id""")
def g02(spark, d):
    return S.pick_margin(V.hypotheses(spark, d).where("not (pos = 0 and confidence < -0.09)"), 0.02)


@query("g03_length_guard_pick", """
WITH c AS (SELECT *, CASE WHEN hypothesis = '' THEN 0 ELSE len(string_split(hypothesis, ' ')) END AS k FROM hyp),
m AS (SELECT *, quantile_cont(k, 0.5) OVER (PARTITION BY id) AS med FROM c),
f AS (SELECT *, med <= 0 OR (k >= 0.9::DOUBLE * med AND k <= 1.15::DOUBLE * med) AS fits FROM m),
g AS (SELECT *, max(fits::INT) OVER (PARTITION BY id) AS any_fit FROM f)
SELECT id, system, hypothesis, R6(confidence) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, pos) AS r FROM g WHERE fits OR any_fit = 0) WHERE r = 1""")
def g03(spark, d):
    return S.pick_max(S.drop_length_outliers(V.hypotheses(spark, d), lo=0.9, hi=1.15))


@query("g04_candidate_sets", """
SELECT id, unnest(range(0, len(c)))::BIGINT AS pos, unnest(c) AS candidate FROM (
  SELECT id, CASE lid_lang WHEN 'en' THEN ['en', 'fr', 'de'] WHEN 'fr' THEN ['fr', 'es'] WHEN 'de' THEN ['de'] ELSE ['fr', 'en'] END AS c FROM routes)""")
def g04(spark, d):
    r = V.routes(spark, d).select("id", "lid_lang")
    return S.candidate_sets(r, "lid_lang", SETS, ("de",), ("fr", "en")).select("id", "pos", "candidate")


@query("g05_hash_holdout", f"""
WITH s AS (SELECT DISTINCT speaker_id FROM utt),
r AS (SELECT speaker_id, row_number() OVER (ORDER BY sha256('{SEED}:' || speaker_id)) AS p, count(*) OVER () AS g FROM s)
SELECT speaker_id, CASE WHEN p <= greatest(1, least(g - 1, round_even(g * 0.25, 0))) THEN 'holdout' ELSE 'tune' END AS fold FROM r""")
def g05(spark, d):
    return S.hash_holdout(V.utterances(spark, d), "speaker_id", SEED, 0.25)


@query("g06_row_target_holdout", f"""
WITH s AS (SELECT speaker_id, count(*) AS rows FROM utt GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS p, coalesce(sum(rows) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  count(*) OVER () AS g, sum(rows) OVER () AS t FROM s WINDOW w AS (ORDER BY sha256('{SEED}:' || speaker_id)))
SELECT speaker_id, rows, CASE WHEN before < greatest(1, round_even(t * 0.2, 0)) AND p < g THEN 'validation' ELSE 'train' END AS fold FROM r""")
def g06(spark, d):
    return S.row_target_holdout(V.utterances(spark, d), "speaker_id", SEED, 0.2)


@query("g07_hash_folds", f"""
SELECT speaker_id, count(*) AS rows, any_value(('0x' || sha256('{SEED}:oof:' || speaker_id)[1:12])::BIGINT % 5) AS fold,
  any_value(('0x' || sha256('20260808' || speaker_id)[1:2])::BIGINT % 2) AS half FROM utt GROUP BY speaker_id""")
def g07(spark, d):
    g = V.utterances(spark, d).groupBy("speaker_id").agg(F.count("*").alias("rows"))
    s = F.col("speaker_id")
    return g.withColumns({"fold": S.hash_fold(s, f"{SEED}:oof", 5), "half": S.hash_half(s, "20260808")})


@query("g08_balanced_folds", """
WITH RECURSIVE s AS (SELECT speaker_id, count(*) AS rows FROM utt GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY rows DESC, sha256(speaker_id), speaker_id) AS p FROM s),
f AS (SELECT 0::BIGINT AS p, ''::VARCHAR AS speaker_id, 0::BIGINT AS rows, -1::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT o.p, o.speaker_id, o.rows, list_position(f.loads, list_min(f.loads)) - 1,
    list_transform(f.loads, lambda x, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN x + o.rows ELSE x END)
  FROM f JOIN o ON o.p = f.p + 1)
SELECT speaker_id, rows, fold FROM f WHERE p > 0""")
def g08(spark, d):
    return S.balanced_folds(V.utterances(spark, d), "speaker_id", 5)


@query("g09_positional_slices", """
SELECT language, id, p - 1 AS position, CASE WHEN p <= 50 THEN 'report' ELSE 'select' END AS slice FROM (
  SELECT id, language, row_number() OVER (ORDER BY id) AS p FROM utt) WHERE p <= 90""")
def g09(spark, d):
    return S.positional_slices(V.utterances(spark, d).select("id", "language"), "id")


@query("g10_locked_halves", """
SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= count(*) OVER () // 2 THEN 'tune' ELSE 'holdout' END AS half FROM utt""")
def g10(spark, d):
    return S.locked_halves(V.utterances(spark, d).select("id"), "id")


@query("g11_seeded_sample", """
SELECT language, id FROM (SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY sha256('42:' || id), id) AS r FROM utt) WHERE r <= 40""")
def g11(spark, d):
    return S.seeded_sample(V.utterances(spark, d).select("language", "id"), "language", "id", 40, 42)


@query("g12_shards", "SELECT id, (row_number() OVER (ORDER BY id) - 1) % 7 AS shard FROM utt")
def g12(spark, d):
    return S.shards(V.utterances(spark, d).select("id"), "id", 7)


@query("g12_position_range", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS p FROM utt) WHERE p > 1000 AND p <= 3500")
def g12_range(spark, d):
    return S.position_range(V.utterances(spark, d).select("id"), "id", 1000, 2500)


ERROR = """CASE WHEN drop7 = swap11 THEN 0 WHEN drop7 = '' OR swap11 = '' THEN 1
  ELSE levenshtein(drop7, swap11)::DOUBLE / greatest(length(drop7), length(swap11)) END"""


@query("h01_ranked_selection", f"""
SELECT id, R6(s) AS score FROM (SELECT w.id, p1 - p2 + 0.5 * (conf_swap11 - conf_drop7) AS s, {ERROR} AS e FROM wide w JOIN routes r USING (id))
WHERE e <= 0.3::DOUBLE ORDER BY round(s, 9) DESC, id LIMIT 25""")
def h01(spark, d):
    j = J.pair_features(V.wide(spark, d), "drop7", "swap11").join(V.routes(spark, d).select("id", "p1", "p2"), "id")
    score = F.col("p1") - F.col("p2") + 0.5 * (F.col("conf_swap11") - F.col("conf_drop7"))
    ok = j.where(F.col("pair_error") <= 0.3).select("id", F.round(score, 9).alias("score"))
    return S.top_n(ok, 25, F.desc("score"), F.col("id"))


@query("h02_top_pools", f"""
SELECT id, R6(e) AS error, R6(p1) AS p1 FROM (SELECT w.id, p1, {ERROR} AS e FROM wide w JOIN routes r USING (id))
WHERE e > 0 AND e <= 0.3::DOUBLE AND p1 >= 0.9::DOUBLE ORDER BY e, p1 DESC, id LIMIT 50""")
def h02(spark, d):
    j = J.pair_features(V.wide(spark, d), "drop7", "swap11").join(V.routes(spark, d).select("id", "p1"), "id")
    ok = j.where("pair_error > 0 and pair_error <= 0.3 and p1 >= 0.9").select("id", F.col("pair_error").alias("error"), "p1")
    return S.top_n(ok, 50, F.col("error"), F.desc("p1"), F.col("id"))


@query("h04_template_order", """
SELECT id, id AS pos, CASE WHEN trim(drop7) = '' THEN '.' ELSE trim(drop7) END AS target FROM wide""")
def h04(spark, d):
    template = V.utterances(spark, d).select("id", F.col("id").alias("pos"))
    return S.template_order(template, V.wide(spark, d).select("id", "drop7"), "id", "pos", "drop7")
