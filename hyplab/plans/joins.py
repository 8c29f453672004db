"""E: joins with contracts, blocked fuzzy join, bands, grids and route lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.operators import joins as J, lexicon as X, policy as Y
from hyplab.plans import views as V
from hyplab.plans.registry import query

LOOKUP = {"specialists": ("en", "fr"), "fallbacks": {"de": ("nl", "en"), "it": ("es", "fr")}, "default": "fr"}


@query("e01_align_to_template", """
SELECT u.id, CASE WHEN p.dup5 IS NULL OR p.dup5 = '' THEN '.' ELSE p.dup5 END AS target
FROM utt u LEFT JOIN (SELECT id, dup5 FROM wide WHERE conf_dup5 > -0.08::DOUBLE) p USING (id)""")
def e01(spark, d):
    preds = V.wide(spark, d).where("conf_dup5 > -0.08").select("id", "dup5")
    return J.align_to_template(V.utterances(spark, d).select("id"), preds, "id", "dup5", unicode_form=False)


@query("e02_complete_inner", """
SELECT u.id, u.reference, u.speaker_id, w.swap11 FROM utt u JOIN wide w ON w.id = u.id""")
def e02(spark, d):
    u = V.utterances(spark, d)
    return J.complete_inner(
        [("labels", u.select("id", "reference")), ("metadata", u.select("id", "speaker_id")), ("hypotheses", V.wide(spark, d).select("id", "swap11"))],
        "id",
    )


@query("e02_coverage", """
WITH k AS (SELECT u.id, count(*) FILTER (p.system = 'drop7') AS a, count(*) FILTER (p.system = 'dup5' AND confidence > -0.05::DOUBLE) AS b
  FROM utt u LEFT JOIN pairs p ON p.id = u.id GROUP BY u.id)
SELECT count(*) AS keys, count(*) AS in_labels, count(*) FILTER (a > 0) AS in_drop7, count(*) FILTER (b > 0) AS in_dup5,
  0::BIGINT AS duplicated_in_labels, count(*) FILTER (a > 1) AS duplicated_in_drop7, count(*) FILTER (b > 1) AS duplicated_in_dup5,
  count(*) FILTER (a > 0 AND b > 0) AS in_all FROM k""")
def e02_coverage(spark, d):
    h = V.hypotheses(spark, d)
    return J.coverage(
        [("labels", V.utterances(spark, d)), ("drop7", h.where("system = 'drop7'")), ("dup5", h.where("system = 'dup5' and confidence > -0.05"))],
        "id",
    )


@query("e03_assemble", """
SELECT u.id, d.hypothesis AS drop7, s.hypothesis AS swap11, p.hypothesis AS dup5,
  CASE WHEN trim(d.hypothesis) <> '' THEN d.hypothesis WHEN trim(s.hypothesis) <> '' THEN s.hypothesis
    WHEN trim(p.hypothesis) <> '' THEN p.hypothesis ELSE '.' END AS chosen
FROM utt u LEFT JOIN (SELECT * FROM hyp WHERE system = 'drop7' AND confidence > -0.06::DOUBLE) d ON d.id = u.id
LEFT JOIN (SELECT * FROM hyp WHERE system = 'swap11' AND confidence > -0.06::DOUBLE) s ON s.id = u.id
LEFT JOIN (SELECT * FROM hyp WHERE system = 'dup5') p ON p.id = u.id""")
def e03(spark, d):
    h = V.hypotheses(spark, d)
    sure = h.where("system = 'dup5' or confidence > -0.06")
    systems = {s: sure.where(F.col("system") == s) for s in V.SYSTEMS}
    return J.assemble(V.utterances(spark, d).select("id"), systems, "id", "hypothesis", V.SYSTEMS)


@query("e04_todo", """
SELECT r.id, r.decode_lang FROM routes r WHERE r.lid_lang <> r.decode_lang
  AND NOT EXISTS (SELECT 1 FROM hyp h WHERE h.id = r.id AND h.confidence > -0.01::DOUBLE)""")
def e04(spark, d):
    pool = V.routes(spark, d).where("lid_lang <> decode_lang").select("id", "decode_lang")
    return J.todo(pool, V.hypotheses(spark, d).where("confidence > -0.01"), "id")


@query("e05_restrict", """
SELECT h.id, h.system, h.hypothesis FROM hyp h WHERE EXISTS (SELECT 1 FROM utt u WHERE u.id = h.id AND u.split = 'validation')""")
def e05(spark, d):
    public = V.utterances(spark, d).where("split = 'validation'").select("id")
    return J.restrict(V.hypotheses(spark, d), public, "id").select("id", "system", "hypothesis")


@query("e06_presence", """
WITH c AS (SELECT 'complete' AS cache, id, id AS pos, drop7 AS text FROM wide
  UNION ALL SELECT 'partial', id + CASE WHEN n % 50 = 0 THEN 50000 ELSE 0 END, id + (n % 9 = 0)::INT, swap11 FROM wide WHERE n % 10 <> 3),
j AS (SELECT k.cache, u.id AS want, c.pos AS got, trim(c.text) AS t, c.id AS cid
  FROM (VALUES ('complete'), ('partial')) k(cache) CROSS JOIN utt u LEFT JOIN c ON c.cache = k.cache AND c.id = u.id
  UNION ALL SELECT c.cache, NULL, c.pos, trim(coalesce(c.text, '')), c.id FROM c WHERE c.id NOT IN (SELECT id FROM utt)),
s AS (SELECT cache, count(want) AS expected, count(got) AS present, count(*) FILTER (got IS NULL) AS missing,
  count(*) FILTER (want IS NULL) AS foreign_rows, count(*) FILTER (t = '') AS "empty", count(*) FILTER (want <> got) AS moved FROM j GROUP BY cache)
SELECT *, missing = 0 AND foreign_rows = 0 AND moved = 0 AS ordered_exact,
  missing = 0 AND foreign_rows = 0 AND moved = 0 AND "empty" = 0 AS complete_exact FROM s""")
def e06(spark, d):
    w = V.wide(spark, d)
    expected = V.utterances(spark, d).select("id", F.col("id").alias("pos"))
    complete = w.select("id", F.col("id").alias("pos"), F.col("drop7").alias("text"))
    partial = w.where("n % 10 <> 3").select(
        (F.col("id") + F.when(F.col("n") % 50 == 0, 50000).otherwise(0)).alias("id"),
        (F.col("id") + F.when(F.col("n") % 9 == 0, 1).otherwise(0)).alias("pos"),
        F.col("swap11").alias("text"),
    )
    return J.presence(expected, {"complete": complete, "partial": partial}, "id", "pos")


# every unknown word against every lexicon word of its block
NEAREST = """q AS (SELECT DISTINCT t.language, t.word, CASE WHEN length(t.word) <= 3 THEN 0 WHEN length(t.word) <= 5 THEN 1 ELSE 2 END AS k
  FROM (SELECT language, unnest(string_split(hypothesis, ' ')) AS word FROM pairs) t
  WHERE t.word <> '' AND NOT regexp_full_match(t.word, '[0-9]+')
    AND NOT EXISTS (SELECT 1 FROM lex l WHERE l.language = t.language AND l.word = t.word)),
lx AS (SELECT language, word, n, word[1:1] AS f, length(word) AS len FROM lex),
c AS (SELECT q.language, q.word, l.word AS cand, l.n, levenshtein(q.word, l.word) AS d, l.len FROM q
  JOIN lx l ON l.language = q.language AND l.f = q.word[1:1] AND abs(length(q.word) - l.len) <= q.k
  WHERE q.k > 0 AND levenshtein(q.word, l.word) <= q.k),
b AS (SELECT *, row_number() OVER (PARTITION BY language, word ORDER BY d, n DESC, len, cand) AS r FROM c)"""


@query("e07_fuzzy_corrections", f"""
WITH {NEAREST}
SELECT language, word, cand AS new, d::BIGINT AS distance, n FROM b WHERE r = 1 AND (n >= 2 OR d = 1)""")
def e07(spark, d):
    p = V.pairs(spark, d)
    return X.corrections(p, "hypothesis", X.lexicon(V.utterances(spark, d)), "language")


@query("e07_corrected_texts", f"""
WITH {NEAREST},
m AS (SELECT language, word, cand AS new FROM b WHERE r = 1 AND (n >= 2 OR d = 1)),
e AS (SELECT id, system, language, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (
  SELECT id, system, language, string_split(hypothesis, ' ') AS w FROM pairs))
SELECT e.id, e.system, string_agg(coalesce(m.new, e.x), ' ' ORDER BY i) AS corrected FROM e LEFT JOIN m ON m.language = e.language AND m.word = e.x GROUP BY e.id, e.system""")
def e07_texts(spark, d):
    p = V.pairs(spark, d).select("id", "system", "language", "hypothesis")
    mapping = X.corrections(p, "hypothesis", X.lexicon(V.utterances(spark, d)), "language")
    return X.apply_word_map(p, ["id", "system"], "hypothesis", "language", mapping, "corrected").select("id", "system", "corrected")


@query("e08_error_band", """
WITH t AS (SELECT id, conf_swap11, CASE WHEN drop7 = swap11 THEN 0 WHEN drop7 = '' OR swap11 = '' THEN 1
  ELSE levenshtein(drop7, swap11)::DOUBLE / greatest(length(drop7), length(swap11)) END AS e FROM wide)
SELECT id, R6(e) AS error FROM t WHERE e > 0.15::DOUBLE AND e <= 0.22::DOUBLE AND conf_swap11 >= -0.05::DOUBLE""")
def e08(spark, d):
    t = J.pair_features(V.wide(spark, d), "drop7", "swap11")
    return t.where(J.in_band(F.col("pair_error"), 0.15, 0.22) & (F.col("conf_swap11") >= -0.05)).select(
        "id", F.col("pair_error").alias("error")
    )


@query("e09_policy_grid", """
WITH f AS (SELECT a.id, a.system AS alt, a.confidence, a.we, a.ce, a.nw, a.nc, b.we AS bwe, b.ce AS bce,
    (len(list_filter(string_split(a.hypothesis, ' '), lambda x: x <> '')) + 1e-6) / (len(list_filter(string_split(b.hypothesis, ' '), lambda x: x <> '')) + 1e-6) AS ratio,
    coalesce(o.oov, 0) AS oov
  FROM scored a JOIN scored b ON b.id = a.id AND b.system = 'drop7'
  LEFT JOIN (SELECT t.id, t.system, avg((l.word IS NULL)::INT) AS oov FROM
      (SELECT id, system, language, unnest(string_split(hypothesis, ' ')) AS word FROM pairs WHERE hypothesis <> '') t
      LEFT JOIN lex l ON l.language = t.language AND l.word = t.word GROUP BY ALL) o ON o.id = a.id AND o.system = a.system
  WHERE a.system <> 'drop7'),
g AS (SELECT lo, hi, oov_max, conf_min FROM (VALUES (0.70::DOUBLE, 1.40::DOUBLE), (0.85::DOUBLE, 1.40::DOUBLE), (0.90::DOUBLE, 1.20::DOUBLE)) l(lo, hi),
  (VALUES (0.20::DOUBLE), (0.35::DOUBLE), (0.50::DOUBLE)) o(oov_max), (SELECT NULL::DOUBLE AS conf_min UNION ALL SELECT unnest([round(quantile_cont(confidence, 0.25), 6), round(quantile_cont(confidence, 0.5), 6)]) FROM f)),
x AS (SELECT f.*, g.*, ratio BETWEEN lo AND hi AND oov <= oov_max AND (conf_min IS NULL OR coalesce(confidence >= conf_min, false)) AS take FROM f, g)
SELECT alt, R6(lo) AS length_lo, R6(hi) AS length_hi, R6(oov_max) AS oov_max, R6(conf_min) AS conf_min, count(*) FILTER (take) AS switched,
  count(*) AS n, R6(0.5 * sum(CASE WHEN take THEN we ELSE bwe END)::DOUBLE / sum(nw) + 0.5 * sum(CASE WHEN take THEN ce ELSE bce END)::DOUBLE / sum(nc)) AS score
FROM x GROUP BY ALL""")
def e09(spark, d):
    feats = Y.pair_table(V.scored(spark, d), "drop7", X.lexicon(V.utterances(spark, d)))
    grid = Y.GUARD_GRID | {"conf_min": Y.confidence_bounds(feats)}
    return Y.grid_scores(feats, grid, by=["alt"]).select(
        "alt", "length_lo", "length_hi", "oov_max", "conf_min", "switched", "n", "score"
    )


@query("e10_route_lookup", """
SELECT id, CASE WHEN lang2 IN ('en', 'fr') THEN lang2 WHEN lang2 = 'de' THEN 'en' ELSE 'fr' END AS route FROM routes""")
def e10(spark, d):
    return V.routes(spark, d).select("id", J.resolve_route(F.col("lang2"), **LOOKUP).alias("route"))
