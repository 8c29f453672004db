"""J and D09: gates and threshold calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hyplab.functions import distance as D, fixed, text as T
from hyplab.operators import calibrate as C, gates as G, lm as L, pairs as P, score as S
from hyplab.plans import views as V
from hyplab.plans.distances import _MARGIN, _PROTO
from hyplab.plans.registry import query

PAIR_ERROR = """CASE WHEN {0} = {1} THEN 0 WHEN {0} = '' OR {1} = '' THEN 1
  ELSE levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"""


@query("j01_mass_gate", """
WITH r AS (SELECT id, CASE WHEN mass_a < 0.5::DOUBLE THEN 'mass_a_low' WHEN mass_b > 0.25::DOUBLE THEN 'mass_b_high'
  WHEN mass_a - mass_b < 0.3::DOUBLE THEN 'margin_low' WHEN mass_c > 0.4::DOUBLE THEN 'mass_c_high' ELSE 'accept' END AS reason FROM masses)
SELECT id, reason = 'accept' AS accept, reason FROM r""")
def j01(spark, d):
    gate = G.mass_gate(F.col("mass_a"), F.col("mass_b"), F.col("mass_c"), min_a=0.5, max_b=0.25, min_margin=0.3, max_c=0.4)
    return V.masses(spark, d).select("id", gate.alias("g")).select("id", "g.*")


def _calibration(source: str, key: str) -> str:
    """Brute force: every candidate threshold against every row."""
    return f"""
u AS (SELECT DISTINCT {key} AS s FROM {source}),
nx AS (SELECT s, lead(s) OVER (ORDER BY s) AS v FROM u),
mx AS (SELECT max({key}) AS m FROM {source} WHERE NOT is_pos),
cand AS (SELECT s AS t FROM u UNION SELECT 0.5::DOUBLE * (s + v) FROM nx WHERE v IS NOT NULL UNION SELECT m + 1e-9 FROM mx UNION SELECT m + 1e-3 FROM mx),
tot AS (SELECT count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS q FROM {source}),
rt AS (SELECT t, count(*) FILTER (is_pos AND {key} >= t) AS tp, count(*) FILTER (NOT is_pos AND {key} >= t) AS fp FROM cand, {source} GROUP BY t),
ok AS (SELECT rt.*, tp::DOUBLE / p AS tpr, fp::DOUBLE / q AS fpr FROM rt, tot WHERE fp::DOUBLE / q <= 0.05::DOUBLE + 1e-12),
best AS (SELECT * FROM ok ORDER BY tp DESC, fp, t LIMIT 1)
SELECT R6(t) AS threshold, tp, fp, R6(tpr) AS tpr, R6(fpr) AS fpr, p AS n_pos, q AS n_neg, (SELECT count(*) FROM ok) AS candidates_ok, 'calibrated' AS note FROM best, tot"""


@query("j02_best_threshold", f"WITH {_calibration('scores', 'score')}")
def j02(spark, d):
    return C.best_threshold(V.scores(spark, d), "score", F.col("is_pos"), 0.05)


@query("d09_prototype_fit", f"""
WITH tr AS (SELECT * FROM embeddings WHERE vec_id % 10 >= 3), va AS (SELECT * FROM embeddings WHERE vec_id % 10 < 3 AND label IN (0, 1)),
{_PROTO.format('tr')}, {_MARGIN.format('va')},
mg AS (SELECT vec_id, label = 0 AS is_pos, round(margin, 9) AS margin FROM margin), {_calibration('mg', 'margin')}""")
def d09(spark, d):
    e = V.table(spark, d, "embeddings")
    protos = P.prototypes(e.where("vec_id % 10 >= 3"), "label", "embedding", (0, 1))
    val = P.prototype_margin(e.where("vec_id % 10 < 3 and label in (0, 1)"), protos, "embedding", 0, 1)
    return C.best_threshold(val.select((F.col("label") == 0).alias("is_pos"), F.round("margin", 9).alias("margin")), "margin", F.col("is_pos"))


@query("j03_grid_calibration", """
WITH g AS (SELECT a, b, m, c, row_number() OVER (ORDER BY a, b, m, c) AS k FROM
  (SELECT unnest([0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80])::DOUBLE AS a), (SELECT unnest([0.10, 0.15, 0.20, 0.25, 0.30, 0.35])::DOUBLE AS b),
  (SELECT unnest([0.10, 0.15, 0.20, 0.25, 0.30, 0.40])::DOUBLE AS m), (SELECT unnest([0.30, 0.40, 0.50, 0.60, 0.99])::DOUBLE AS c)),
x AS (SELECT a, b, m, c, k, count(*) FILTER (ok AND is_pos) AS tp, count(*) FILTER (ok AND NOT is_pos) AS fp, count(*) FILTER (is_pos) AS p, count(*) FILTER (NOT is_pos) AS q
  FROM (SELECT g.*, is_pos, mass_a >= a AND mass_b <= b AND mass_a - mass_b >= m AND mass_c <= c AS ok FROM g, masses) y GROUP BY a, b, m, c, k),
ok AS (SELECT *, tp::DOUBLE / p AS tpr, fp::DOUBLE / q AS fpr FROM x WHERE fp::DOUBLE / q <= 0.05::DOUBLE + 1e-12)
SELECT R6(a) AS min_a, R6(b) AS max_b, R6(m) AS min_margin, R6(c) AS max_c, tp, fp, R6(tpr) AS tpr, R6(fpr) AS fpr,
  (SELECT count(*) FROM ok) AS candidates_ok, 'calibrated' AS note FROM ok ORDER BY tp DESC, fp, k LIMIT 1""")
def j03(spark, d):
    return C.grid_calibration(V.masses(spark, d), F.col("is_pos"))


@query("j04_confusion_rates", """
WITH c AS (SELECT language, count(*) AS n, count(*) FILTER (is_pos AND score >= 0.7::DOUBLE) AS tp, count(*) FILTER (NOT is_pos AND score >= 0.7::DOUBLE) AS fp,
  count(*) FILTER (NOT is_pos AND score < 0.7::DOUBLE) AS tn, count(*) FILTER (is_pos AND score < 0.7::DOUBLE) AS fn FROM scores GROUP BY language)
SELECT *, R6(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)) AS tpr, R6(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)) AS fpr FROM c""")
def j04(spark, d):
    return G.confusion_rates(V.scores(spark, d), F.col("score") >= 0.7, F.col("is_pos"), "language")


MARGINS = [round(float(x), 10) for x in np.linspace(-0.05, 0.15, 41)]
SWEEP = f"""
t AS (SELECT a.id, a.language = 'en' AS is_pos, a.confidence - b.confidence + CASE WHEN a.language = 'en' THEN 0.04::DOUBLE ELSE 0 END AS delta,
  a.we AS awe, a.ce AS ace, b.we AS bwe, b.ce AS bce, a.nw, a.nc FROM scored a JOIN scored b ON a.id = b.id AND a.system = 'swap11' AND b.system = 'drop7'),
k AS (SELECT unnest({MARGINS})::DOUBLE AS margin),
x AS (SELECT margin, t.*, round(delta, 9) >= margin AS take FROM t, k),
s AS (SELECT margin, count(*) FILTER (take AND is_pos)::DOUBLE / count(*) FILTER (is_pos) AS tpr,
  count(*) FILTER (take AND NOT is_pos)::DOUBLE / count(*) FILTER (NOT is_pos) AS fpr, count(*) FILTER (take) AS n_accept,
  coalesce(count(*) FILTER (take AND is_pos)::DOUBLE / nullif(count(*) FILTER (take), 0), 0) AS precision,
  sum(CASE WHEN take THEN awe ELSE bwe END)::DOUBLE / sum(nw) AS wer, sum(CASE WHEN take THEN ace ELSE bce END)::DOUBLE / sum(nc) AS cer FROM x GROUP BY margin)"""
SWEEP_COLUMNS = """R6(margin) AS margin, R6(tpr) AS tpr, R6(fpr) AS fpr, n_accept, R6(precision) AS precision, R6(wer) AS wer, R6(cer) AS cer,
  R6(0.5 * wer + 0.5 * cer) AS score"""


def _sweep(spark, d):
    s = V.scored(spark, d)
    alt = s.where("system = 'swap11'").select("id", "language", "nw", "nc", F.col("confidence").alias("ca"), F.col("we").alias("alt_we"), F.col("ce").alias("alt_ce"))
    base = s.where("system = 'drop7'").select("id", F.col("confidence").alias("cb"), F.col("we").alias("base_we"), F.col("ce").alias("base_ce"))
    pos = F.col("language") == "en"
    delta = F.round(F.col("ca") - F.col("cb") + F.when(pos, 0.04).otherwise(0.0), 9)
    return C.margin_sweep(alt.join(base, "id"), delta, pos, MARGINS)


@query("j05_margin_sweep", f"WITH {SWEEP} SELECT {SWEEP_COLUMNS} FROM s")
def j05(spark, d):
    return _sweep(spark, d)


@query("j05_best_margin", f"""
WITH {SWEEP} SELECT {SWEEP_COLUMNS} FROM s ORDER BY (fpr <= 0.10::DOUBLE) DESC, CASE WHEN fpr <= 0.10::DOUBLE THEN 0 ELSE fpr END, tpr DESC,
  round(0.5 * wer + 0.5 * cer, 12), s.margin LIMIT 1""")
def j05_best(spark, d):
    return C.best_margin(_sweep(spark, d))


@query("j06_capped_threshold", """
WITH t AS (SELECT DISTINCT score AS t FROM scores),
r AS (SELECT t, count(*) FILTER (NOT is_pos AND score >= t)::DOUBLE / count(*) FILTER (NOT is_pos) AS fpr, count(*) FILTER (is_pos AND score >= t) AS accepted FROM t, scores GROUP BY t)
SELECT R6(t) AS threshold, R6(fpr) AS fpr, accepted, accepted >= 30 AS enough FROM r WHERE fpr <= 0.05::DOUBLE + 1e-12 ORDER BY accepted DESC, t LIMIT 1""")
def j06(spark, d):
    return C.capped_threshold(V.scores(spark, d), "score", ~F.col("is_pos"), 0.05, 30)


THRESHOLDS = (0.08, 0.10, 0.12, 0.15)
ZERO = f"""
e AS (SELECT language, {PAIR_ERROR.format('swap11', 'dup5')} AS e FROM wide),
r AS (SELECT language, t AS threshold, count(*) FILTER (e <= t) AS false_accepts, avg((e <= t)::INT) AS fpr FROM e, (SELECT unnest([0.08, 0.10, 0.12, 0.15])::DOUBLE AS t) GROUP BY ALL)"""


@query("j07_zero_false_accepts", f"WITH {ZERO} SELECT language, R6(threshold) AS threshold, false_accepts, R6(fpr) AS fpr, false_accepts = 0 AS safe FROM r")
def j07(spark, d):
    return C.zero_false_accepts(V.wide(spark, d), D.pair_error(F.col("swap11"), F.col("dup5")), THRESHOLDS, "language")


@query("j08_best_accuracy", """
WITH q AS (SELECT quantile_cont(score, [""" + ", ".join(f"{i / 100}" for i in range(1, 100)) + """]) AS l FROM scores),
c AS (SELECT unnest(range(1, 100)) AS i, unnest(l) AS t FROM q),
a AS (SELECT i, t, avg(((score > t) = is_pos)::INT) AS acc FROM c, scores GROUP BY i, t)
SELECT R6(t) AS threshold, R6(acc) AS accuracy FROM a ORDER BY round(acc, 12) DESC, i LIMIT 1""")
def j08(spark, d):
    return C.best_accuracy(V.scores(spark, d), "score", F.col("is_pos"))


def _residual(spark, d):
    """Residual features: orthography and model scores of drop7 (floor) and swap11 (new)."""
    w = V.distinct(spark, d, V.wide, "id", "n", "drop7", "swap11", "conf_swap11", "conf_drop7")
    m = T.marker_scores(F.col("swap11"))
    scored = L.char_logprobs(w, ["id"], "swap11", V.utterances(spark, d).where("split <> 'test'"), ("en", "fr", "de"), distinct=True)
    r = V.routes(spark, d).select("id", "p1", "lang2", "p2")
    margin = F.col("lp_en") - F.greatest("lp_fr", "lp_de")
    return scored.join(r, "id").select(
        "id", F.col("drop7").alias("floor_hyp"), F.col("swap11").alias("new_hyp"), "p1", "lang2",
        (5.0 * margin + 3.0).alias("ortho"), margin.alias("ngram"), m["luo_minus_ach"].alias("marker"),
        F.col("lp_en").alias("lp_own"), F.col("lp_fr").alias("lp_rival"), D.pair_error(F.col("drop7"), F.col("swap11")).alias("error"),
        (F.col("conf_swap11") - F.col("conf_drop7")).alias("conf_delta"), (F.col("n") % 13 == 0).alias("already_dual"),
    )


def _residual_sql() -> str:
    from hyplab.plans.language_models import CHAR_LM
    from hyplab.plans.texts import _marker_sql

    return f"""{CHAR_LM},
rs AS (SELECT w.id, drop7 AS f, swap11 AS h, swap11 AS t, swap11 AS u, p1, lang2, 5.0::DOUBLE * (lp_en - greatest(lp_fr, lp_de)) + 3.0::DOUBLE AS ortho,
  lp_en - greatest(lp_fr, lp_de) AS ngram, lp_en - lp_fr AS delta, {PAIR_ERROR.format('drop7', 'swap11')} AS e, conf_swap11 - conf_drop7 AS cd, w.n % 13 = 0 AS dual
  FROM wide w JOIN routes r ON r.id = w.id JOIN lp ON lp.id = w.id AND lp.system = 'swap11'),
rm AS (SELECT *, {_marker_sql('luo')} - {_marker_sql('ach')} AS marker FROM rs)"""


_UNIQ = "len(list_distinct({0}))::DOUBLE / greatest(len({0}), 1)"


@query("j09_residual_stack", f"""
WITH {_residual_sql()},
k AS (SELECT *, list_filter(string_split(h, ' '), lambda x: x <> '') AS w, list_filter(string_split(f, ' '), lambda x: x <> '') AS fw FROM rm),
g AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS bg, len(list_filter(w, lambda x: length(x) <= 1)) AS single FROM k),
s AS (SELECT *, len(w) = 0 OR (len(w) >= 3 AND single = len(w)) OR (len(w) >= 4 AND len(list_distinct(w)) = 1 AND length(w[1]) <= 2)
  OR {_UNIQ.format('w')} < 0.55 OR (len(w) >= 5 AND single::DOUBLE / len(w) >= 0.7) OR length(array_to_string(w, ''))::DOUBLE / greatest(len(w), 1) < 2.5
  OR (len(w) >= 8 AND list_max(list_transform(w, lambda x: len(list_filter(w, lambda y: y = x))))::DOUBLE / len(w) > 0.25)
  OR len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 1 OR (len(w) >= 8 AND len(list_distinct(bg))::DOUBLE / len(bg) < 0.55)
  OR (len(fw) > 0 AND {_UNIQ.format('w')} < {_UNIQ.format('fw')} - 0.15) AS broken,
  ortho >= 2.4::DOUBLE AND delta > 0 AS a, e > 0.15::DOUBLE AND e <= 0.22::DOUBLE AND ortho >= 2.8::DOUBLE AND delta > 0 AS b FROM g),
r AS (SELECT id, 1 - e AS similarity, CASE WHEN dual THEN 'already_dual' WHEN h IN ('', '.') OR h = f THEN 'empty_or_same'
  WHEN NOT (len(w) > 0 AND (len(fw) = 0 OR len(w)::DOUBLE / greatest(len(fw), 1) BETWEEN 0.5 AND 2.0)) THEN 'length_guard' WHEN broken THEN 'structure_fail'
  WHEN p1 < 0.6::DOUBLE OR lang2 IN ('es') THEN 'lid_mass_fail' WHEN 1 - e < 0.8::DOUBLE AND (ortho < 3.0 OR delta <= 0.05::DOUBLE) THEN 'low_similarity_without_strict_ortho'
  WHEN a AND b THEN 'strict+soft' WHEN a THEN 'strict' WHEN b THEN 'soft' ELSE 'no_path' END AS reason FROM s)
SELECT id, R6(similarity) AS similarity, reason, reason IN ('strict+soft', 'strict', 'soft') AS accept FROM r""")
def j09(spark, d):
    out = G.residual_stack(_residual(spark, d), min_p1=0.6, min_similarity=0.8, rivals=("es",), junk=())
    return out.select("id", "similarity", "reason", "accept")


@query("j10_feature_coercion", """
SELECT id, R6(coalesce(nullif(CASE WHEN mass_b > 0.3::DOUBLE THEN NULL ELSE mass_b END, 0), 1.0)) AS error, R6(coalesce(nullif(mass_a, 0), -999)) AS ortho,
  CASE WHEN mass_c > 0.3::DOUBLE THEN 'first' WHEN mass_a > 0.5::DOUBLE THEN 'second' ELSE '' END AS floor_hyp, is_pos AS already_dual, false AS frozen FROM masses""")
def j10(spark, d):
    t = V.masses(spark, d).select(
        "id", F.when(F.col("mass_b") > 0.3, None).otherwise(F.col("mass_b")).alias("error"), F.col("mass_a").alias("ortho"),
        F.when(F.col("mass_c") > 0.3, "first").otherwise("").alias("floor"), F.when(F.col("mass_a") > 0.5, "second").alias("prediction"),
        F.col("is_pos").alias("already_dual"),
    )
    out = G.coerce(t, {"error": 1.0, "ortho": -999.0}, {"floor_hyp": ("floor", "prediction")}, ("already_dual", "frozen"))
    return out.select("id", "error", "ortho", "floor_hyp", "already_dual", "frozen")


@query("j11_ban_checks", """
WITH s AS (SELECT r.decode_lang, count(*) AS total, count(*) FILTER (trim(swap11) <> trim(drop7) AND conf_swap11 > -0.03::DOUBLE) AS changed,
  count(*) FILTER (conf_swap11 - conf_drop7 > 0.01::DOUBLE) AS confidence_only FROM wide w JOIN routes r USING (id) GROUP BY ALL)
SELECT *, total <= 0 OR changed::DOUBLE / total > 0.25 AS mass_rewrite, CASE WHEN total <= 0 OR changed::DOUBLE / total > 0.25 THEN 'FAIL_mass_rewrite' ELSE 'PASS_ban_check' END AS verdict FROM s""")
def j11(spark, d):
    j = V.wide(spark, d).join(V.routes(spark, d).select("id", "decode_lang"), "id")
    s = j.groupBy("decode_lang").agg(
        F.count("*").alias("total"), F.count_if((F.trim("swap11") != F.trim("drop7")) & (F.col("conf_swap11") > -0.03)).alias("changed"),
        F.count_if(G.confidence_only(F.col("conf_swap11"), F.col("conf_drop7"), 0.01)).alias("confidence_only"),
    )
    bad = G.mass_rewrite(F.col("changed"), F.col("total"))
    return s.withColumns({"mass_rewrite": bad, "verdict": F.when(bad, "FAIL_mass_rewrite").otherwise("PASS_ban_check")})


GRID = [float(x) for x in fixed.ECDF_GRID]


def _errors(spark, d):
    """Character error of a pair, labelled by language: two or three classes and the sample to explain."""
    return V.wide(spark, d).select(
        "id", F.when(F.col("split") == "test", "test").otherwise(F.col("language")).alias("sample"),
        D.pair_error(F.col("swap11"), F.col("dup5")).alias("value"),
    )


ECDF = f"""
s AS (SELECT id, CASE WHEN split = 'test' THEN 'test' ELSE language END AS sample, {PAIR_ERROR.format('swap11', 'dup5')} AS value FROM wide),
c AS (SELECT sample, t, avg((value <= t)::INT) AS share FROM s, (SELECT unnest({GRID})::DOUBLE AS t) GROUP BY ALL)"""


@query("j12_mixture_two", f"""
WITH {ECDF},
g AS (SELECT t, max(share) FILTER (sample = 'test') AS ft, max(share) FILTER (sample = 'en') AS fa, max(share) FILTER (sample = 'fr') AS fb FROM c GROUP BY t),
f AS (SELECT greatest(0, least(1, sum((fa - fb) * (ft - fb)) / sum((fa - fb) * (fa - fb)))) AS pi FROM g)
SELECT R6(any_value(pi)) AS pi, R6(sqrt(avg((ft - (pi * fa + (1 - pi) * fb)) ** 2))) AS rmse, R6(sqrt(avg((ft - fb) ** 2))) AS rmse_null FROM g, f""")
def j12(spark, d):
    return C.mixture_two(C.ecdf(_errors(spark, d), F.col("value"), "sample", GRID), "sample", "test", "en", "fr")


# Least squares on the simplex from moments: every support in turn, the feasible one of least error.
MIXTURE = f"""{ECDF},
y3 AS (SELECT t, coalesce(max(share) FILTER (sample = 'test'), 0) AS y, coalesce(max(share) FILTER (sample = 'en'), 0) AS a,
  coalesce(max(share) FILTER (sample = 'fr'), 0) AS b, coalesce(max(share) FILTER (sample = 'de'), 0) AS c FROM c GROUP BY t),
mo AS (SELECT count(*) AS m, sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * c) AS bc,
  sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy FROM y3),
uv AS (SELECT *, aa - 2 * ac + cc AS uu, bb - 2 * bc + cc AS vv, ab - ac - bc + cc AS uv, ay - ac - cy + cc AS uz, by_ - bc - cy + cc AS vz FROM mo),
ca AS (SELECT 1.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc UNION ALL SELECT 0, 1, 0 UNION ALL SELECT 0, 0, 1
  UNION ALL SELECT (ay - ab - by_ + bb) / (aa - 2 * ab + bb), 1 - (ay - ab - by_ + bb) / (aa - 2 * ab + bb), 0 FROM mo
  UNION ALL SELECT uz / uu, 0, 1 - uz / uu FROM uv UNION ALL SELECT 0, vz / vv, 1 - vz / vv FROM uv
  UNION ALL SELECT (uz * vv - vz * uv) / (uu * vv - uv * uv), (vz * uu - uz * uv) / (uu * vv - uv * uv), 1 - (uz * vv - vz * uv + vz * uu - uz * uv) / (uu * vv - uv * uv) FROM uv),
mx AS (SELECT wa, wb, wc FROM ca, mo WHERE least(wa, wb, wc) >= -1e-12
  ORDER BY yy - 2 * (wa * ay + wb * by_ + wc * cy) + wa * wa * aa + wb * wb * bb + wc * wc * cc + 2 * (wa * wb * ab + wa * wc * ac + wb * wc * bc) LIMIT 1)"""


@query("j13_mixture_three", f"""
WITH {MIXTURE}
SELECT R6(wa) AS weight_en, R6(wb) AS weight_fr, R6(wc) AS weight_de, R6(sqrt(avg((y - (wa * a + wb * b + wc * c)) ** 2))) AS rmse FROM mx, y3 GROUP BY wa, wb, wc""")
def j13(spark, d):
    return C.mixture_three(C.ecdf(_errors(spark, d), F.col("value"), "sample", GRID), "sample", "test", ("en", "fr", "de"))


@query("j14_decision_table", f"""
WITH {MIXTURE},
d AS (SELECT sample, t, avg((value <= t)::INT) AS share, count(*) FILTER (value <= t) AS k FROM s, (SELECT unnest({list(fixed.DECISION_GRID)})::DOUBLE AS t) GROUP BY ALL),
g AS (SELECT t, max(share) FILTER (sample = 'en') AS a, max(share) FILTER (sample = 'fr') AS b, max(share) FILTER (sample = 'de') AS c,
  max(k) FILTER (sample = 'test') AS observed FROM d GROUP BY t),
h AS (SELECT g.*, wa * n * a AS ha, wb * n * b AS hb, wc * n * c AS hc FROM g, mx, (SELECT count(*) FILTER (sample = 'test') AS n FROM s))
SELECT R6(t) AS threshold, R6(a) AS rate_en, R6(b) AS rate_fr, R6(c) AS rate_de, observed, R6(ha + hb + hc) AS predicted, R6(ha / (ha + hb + hc)) AS precision,
  R6((ha * {fixed.SWAP_GAIN}::DOUBLE - hb * {fixed.SWAP_LOSS_B}::DOUBLE - hc * {fixed.SWAP_LOSS_C}::DOUBLE) / (ha + hb + hc)) AS value_per_row,
  R6(ha * {fixed.SWAP_GAIN}::DOUBLE - hb * {fixed.SWAP_LOSS_B}::DOUBLE - hc * {fixed.SWAP_LOSS_C}::DOUBLE) AS value_total FROM h""")
def j14(spark, d):
    """Decision value under the fitted three-class mixture."""
    errors = _errors(spark, d)
    weights = C.mixture_three(C.ecdf(errors, F.col("value"), "sample", GRID), "sample", "test", ("en", "fr", "de"))
    cdf = C.ecdf(errors, F.col("value"), "sample", fixed.DECISION_GRID)
    n_test = errors.agg(F.count_if(F.col("sample") == "test").alias("n"))
    return C.decision_table(cdf, "sample", "test", ("en", "fr", "de"), weights, n_test)


@query("j15_expected_delta", f"""
WITH s AS (SELECT threshold, n_accept, precision, (SELECT count(*) FROM utt) AS total FROM (SELECT margin AS threshold, n_accept, precision FROM (
  WITH {SWEEP} SELECT * FROM s)))
SELECT R6(threshold) AS margin, n_accept, R6(CASE WHEN n_accept > 0 THEN precision * 0.577::DOUBLE - (1 - precision) * 0.4::DOUBLE ELSE 0 END) AS unit_gain,
  R6(CASE WHEN n_accept > 0 THEN n_accept::DOUBLE / total * (precision * 0.577::DOUBLE - (1 - precision) * 0.4::DOUBLE) ELSE 0 END) AS delta,
  R6(0.5::DOUBLE + CASE WHEN n_accept > 0 THEN n_accept::DOUBLE / total * (precision * 0.577::DOUBLE - (1 - precision) * 0.4::DOUBLE) ELSE 0 END) AS projected FROM s""")
def j15(spark, d):
    total = V.utterances(spark, d).agg(F.count("*").alias("total"))
    sweep = C.one_row(_sweep(spark, d), total)
    out = C.expected_delta(sweep, F.col("n_accept"), F.col("precision"), F.col("total"), 0.577, 0.40, F.lit(0.5))
    return out.select("margin", "n_accept", "unit_gain", "delta", "projected")


@query("j15_projection_grid", """
WITH m AS (SELECT count(*) FILTER (language = 'en')::DOUBLE / count(*) AS mass FROM utt),
z AS (SELECT 1 - (0.5 * sum(we) FILTER (system = 'swap11')::DOUBLE / sum(nw) FILTER (system = 'swap11') + 0.5 * sum(ce) FILTER (system = 'swap11')::DOUBLE / sum(nc) FILTER (system = 'swap11')) AS zt,
  1 - (0.5 * sum(we) FILTER (system = 'dup5')::DOUBLE / sum(nw) FILTER (system = 'dup5') + 0.5 * sum(ce) FILTER (system = 'dup5')::DOUBLE / sum(nc) FILTER (system = 'dup5')) AS zf FROM scored)
SELECT R6(p) AS p_true, R6(o) AS z_other, R6(mass * (p * zt + (1 - p) * zf) + (1 - mass) * o) AS projected FROM m, z,
  (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS p), (SELECT unnest([0.60, 0.65, 0.68, 0.70, 0.74])::DOUBLE AS o)""")
def j15_grid(spark, d):
    s = S.corpus_scores(V.scored(spark, d), "system")
    z = s.agg(*[(1.0 - F.max(F.when(F.col("system") == sys, F.col("score")))).alias(n) for sys, n in (("swap11", "zt"), ("dup5", "zf"))])
    mass = V.utterances(spark, d).agg((F.count_if(F.col("language") == "en") / F.count("*")).alias("mass"))
    grid = C.projection_grid(C.one_row(z, mass), F.col("mass"), F.col("zt"), F.col("zf"), (0.3, 0.4, 0.5, 0.6, 0.7), (0.60, 0.65, 0.68, 0.70, 0.74))
    return grid.select("p_true", "z_other", "projected")


@query("j16_pool_gates", f"""
WITH {_residual_sql()},
p AS (SELECT id, round(ortho, 9) AS o, round(ngram, 9) AS g, round(marker, 9) AS m, least(1, p1 + 0.4::DOUBLE) AS p, e, cd FROM rm),
t AS (SELECT id, row_number() OVER (ORDER BY o DESC, id) AS k FROM p)
SELECT id, 'p99' AS gate FROM p WHERE o >= 2.0 AND p >= 0.99::DOUBLE UNION ALL SELECT id, 'o05_p99' FROM p WHERE o >= 3.0 AND p >= 0.99::DOUBLE
UNION ALL SELECT id, 'conf' FROM p WHERE o >= 2.0::DOUBLE * 0.85::DOUBLE AND coalesce(cd, -1) >= 0 AND p >= 0.95::DOUBLE
UNION ALL SELECT id, 'dualsoft' FROM p WHERE o >= 2.0 AND e <= 0.28::DOUBLE AND p >= 0.99::DOUBLE
UNION ALL SELECT id, 'dual15' FROM p WHERE o >= 2.0 AND e <= 0.15::DOUBLE AND p >= 0.99::DOUBLE
UNION ALL SELECT id, 'o3_p99' FROM p WHERE o >= 3.0 AND p >= 0.99::DOUBLE UNION ALL SELECT id, 'o24_p99' FROM p WHERE o >= 2.4::DOUBLE AND p >= 0.99::DOUBLE
UNION ALL SELECT id, 'o20_p99' FROM p WHERE o >= 2.0 AND p >= 0.99::DOUBLE
UNION ALL SELECT id, 'ngram_marker' FROM p WHERE g >= 0.15::DOUBLE AND m >= 2.0 AND p >= 0.99::DOUBLE AND o >= 2.0
UNION ALL SELECT id, 'top15' FROM t WHERE k <= 15 UNION ALL SELECT id, 'top30' FROM t WHERE k <= 30 UNION ALL SELECT id, 'top50' FROM t WHERE k <= 50""")
def j16(spark, d):
    r = _residual(spark, d)
    pool = r.select(
        "id", *[F.round(c, 9).alias(c) for c in ("ortho", "ngram", "marker")], F.least(F.lit(1.0), F.col("p1") + 0.4).alias("p1"), "error", "conf_delta"
    )
    return G.pool_gates(pool, "id", thr=2.0, thr_hi=3.0)
