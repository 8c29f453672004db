"""M, and the alignment-based F06, F07 and H03."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.functions import distance as D, fixed, kernels as K, text as T
from hyplab.functions.fixed import ANOMALY_REASONS
from hyplab.operators import counts as C, errors as E, fuse as M, joins as J, lexicon as X, lm as L, policy as Y, score as S, select as G
from hyplab.plans import views as V
from hyplab.plans.alignment_sql import alignment
from hyplab.plans.registry import query

PAIR_ERROR = """CASE WHEN {0} = {1} THEN 0 WHEN {0} = '' OR {1} = '' THEN 1
  ELSE levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"""
WORDS = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
LANGUAGES = ("en", "fr", "de", "es")


def lexicon(spark, d):
    return X.lexicon(V.utterances(spark, d))


ERROR_OPS = f"""WITH RECURSIVE {alignment("SELECT language, reference AS a, hypothesis AS b FROM pairs WHERE hypothesis NOT IN ('', '.') AND reference <> hypothesis")},
ops AS (SELECT language, op, ref, hyp, count(*) AS n FROM aligned WHERE op <> 'C' GROUP BY ALL)"""


@query("f06_error_types", f"""{ERROR_OPS}
SELECT language, op, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (op <> 'S' AND ((language = 'en' AND coalesce(ref, hyp) IN ('the', 'and', 'of', 'to'))
  OR (language = 'fr' AND coalesce(ref, hyp) IN ('le', 'la', 'de')) OR (language = 'de' AND coalesce(ref, hyp) IN ('und', 'der'))
  OR (language = 'es' AND coalesce(ref, hyp) IN ('de', 'la')))), 0)::BIGINT AS function_words FROM ops GROUP BY ALL""")
def f06(spark, d):
    ops = E.operations(V.pairs(spark, d), "reference", "hypothesis", "language")
    return E.error_types(ops, "language", {"en": ("the", "and", "of", "to"), "fr": ("le", "la", "de"), "de": ("und", "der"), "es": ("de", "la")})


@query("f07_substitution_map", f"""{ERROR_OPS},
b AS (SELECT language, hyp AS word, sum(n)::BIGINT AS total, max((n, ref)) AS best FROM ops WHERE op = 'S' GROUP BY ALL),
c AS (SELECT language, word, best[2] AS new, best[1] AS n, total FROM b)
SELECT c.language, c.word, new, c.n, total FROM c LEFT JOIN lex f ON f.language = c.language AND f.word = c.word
  LEFT JOIN lex g ON g.language = c.language AND g.word = c.new
WHERE c.n >= 5 AND c.n::DOUBLE / total >= 0.7::DOUBLE AND new <> c.word
  AND NOT (coalesce(f.n, 0) >= 20 AND coalesce(f.n, 0) >= coalesce(g.n, 0)) AND coalesce(g.n, 0) >= 2""")
def f07(spark, d):
    ops = E.operations(V.pairs(spark, d), "reference", "hypothesis", "language")
    return E.substitution_map(ops, lexicon(spark, d), "language")


@query("h03_most_common_errors", f"""{ERROR_OPS}
SELECT language, op, ref, hyp, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY language, op ORDER BY n DESC, ref NULLS FIRST, hyp NULLS FIRST) AS rank
  FROM ops WHERE op <> 'S' OR n >= 5) WHERE rank <= 15""")
def h03(spark, d):
    return E.most_common(E.operations(V.pairs(spark, d), "reference", "hypothesis", "language"), "language", top=15)


@query("m01_fuse_two", """
WITH t AS (SELECT w.id, drop7 AS a, dup5 AS b, conf_drop7 AS s, decode_lang, lid_lang, p1 FROM wide w JOIN routes r USING (id)),
k AS (SELECT *, CASE WHEN a = '' AND b = '' THEN 'both_empty' WHEN b = '' THEN 'second_empty' WHEN a = '' THEN 'first_empty'
  WHEN lid_lang = 'fr' AND p1 >= 0.55::DOUBLE THEN 'open_set' WHEN s < -0.05::DOUBLE THEN 'first_weak'
  WHEN decode_lang IN ('en', 'de') AND p1 >= 0.9::DOUBLE THEN 'domain_strong' ELSE 'default_first' END AS reason FROM t)
SELECT id, CASE reason WHEN 'both_empty' THEN '.' WHEN 'first_empty' THEN b WHEN 'open_set' THEN b WHEN 'first_weak' THEN b ELSE a END AS text,
  CASE WHEN reason = 'both_empty' THEN 'empty_fallback' WHEN reason IN ('first_empty', 'open_set', 'first_weak') THEN 'second' ELSE 'first' END AS source, reason
FROM k""")
def m01(spark, d):
    j = V.wide(spark, d).join(V.routes(spark, d).select("id", "decode_lang", "lid_lang", "p1"), "id")
    fused = M.fuse_two(
        F.col("drop7"), F.col("dup5"), F.col("conf_drop7"), F.col("decode_lang"), F.col("lid_lang"), F.col("p1"),
        open_set="fr", floor=-0.05, domain=("en", "de"),
    )
    return j.select("id", fused.alias("f")).select("id", "f.*")


@query("m02_overlay", """
WITH r AS (SELECT id, trim(swap11) AS t, 1 AS o FROM wide WHERE conf_swap11 > -0.02::DOUBLE UNION ALL SELECT id, trim(dup5), 2 FROM wide WHERE n % 5 = 0),
l AS (SELECT id, max_by(t, o) AS t FROM r WHERE t <> '' GROUP BY id)
SELECT id, coalesce(l.t, f) AS target, coalesce(l.t <> f, false) AS changed
FROM (SELECT id, CASE WHEN trim(drop7) = '' THEN '.' ELSE trim(drop7) END AS f FROM wide) LEFT JOIN l USING (id)""")
def m02(spark, d):
    w = V.wide(spark, d)
    floor = w.select("id", F.col("drop7").alias("target"))
    first = w.where("conf_swap11 > -0.02").select("id", F.col("swap11").alias("target"), F.lit(1).alias("o"))
    second = w.where("n % 5 = 0").select("id", F.col("dup5").alias("target"), F.lit(2).alias("o"))
    return M.overlay(floor, first.unionByName(second), "id", "target", "o")


LAYERS = """l AS (SELECT id, 0 AS layer, CASE WHEN trim(drop7) = '' THEN '.' ELSE trim(drop7) END AS text FROM wide
  UNION ALL SELECT id, 1, swap11 FROM wide WHERE conf_swap11 > -0.05::DOUBLE
  UNION ALL SELECT id, 2, dup5 FROM wide WHERE conf_dup5 > -0.03::DOUBLE
  UNION ALL SELECT id, 3, drop7 FROM wide WHERE n % 11 = 0),
s AS (SELECT id, layer, lag(CASE WHEN text = '' THEN '.' ELSE text END) OVER (PARTITION BY id ORDER BY layer) AS before,
  CASE WHEN text = '' THEN '.' ELSE text END AS after FROM l)"""


def _layers(spark, d):
    w = V.wide(spark, d)
    floor = w.select("id", F.col("drop7").alias("text"))
    layer = lambda n, col, cond: w.where(cond).select("id", F.lit(n).alias("layer"), F.col(col).alias("text"))
    return M.layered(
        floor,
        layer(1, "swap11", "conf_swap11 > -0.05").unionByName(layer(2, "dup5", "conf_dup5 > -0.03")).unionByName(layer(3, "drop7", "n % 11 = 0")),
        "id", "text",
    )


@query("m03_layer_counts", f"WITH {LAYERS} SELECT layer::BIGINT AS layer, count(*) AS applied, count(*) FILTER (before <> after) AS changed FROM s WHERE layer > 0 GROUP BY layer")
def m03_counts(spark, d):
    return _layers(spark, d).where("layer > 0").groupBy("layer").agg(F.count("*").alias("applied"), F.count_if("changed").alias("changed"))


@query("m03_layered_texts", f"WITH {LAYERS} SELECT id, max_by(after, layer) AS text FROM s GROUP BY id")
def m03(spark, d):
    return _layers(spark, d).groupBy("id").agg(F.max_by("after", "layer").alias("text"))


@query("m04_word_merge", f"""
WITH RECURSIVE {alignment("SELECT id, reference AS a, swap11 AS b FROM wide WHERE reference <> swap11")},
c AS (SELECT *, op = 'S' AND 1 - levenshtein(ref, hyp)::DOUBLE / greatest(length(ref), length(hyp)) >= 0.4::DOUBLE AS alike FROM aligned),
r AS (SELECT *, sum(alike::INT) OVER (PARTITION BY id ORDER BY step) AS nth FROM c),
m AS (SELECT id, string_agg(CASE WHEN alike AND nth <= 2 THEN hyp ELSE ref END, ' ' ORDER BY step) FILTER (op <> 'I') AS text FROM r GROUP BY id)
SELECT w.id, CASE WHEN swap11 IN ('', '.') THEN CASE WHEN reference = '' THEN '.' ELSE reference END WHEN reference IN ('', '.') THEN swap11
  ELSE coalesce(m.text, reference) END AS text FROM wide w LEFT JOIN m USING (id)""")
def m04(spark, d):
    a, b = F.col("reference"), F.col("swap11")
    return V.wide(spark, d).select("id", M.word_merge(a, b, K.alignment(a, b), min_similarity=0.4, max_edits=2).alias("text"))


@query("m05_consensus", f"""
WITH h AS (SELECT id, pos, CASE WHEN hypothesis = '' THEN '.' ELSE hypothesis END AS t FROM hyp),
c AS (SELECT a.id, a.pos, b.t, CASE WHEN a.pos = b.pos THEN 0 ELSE b.pos + 1 END AS place FROM h a JOIN h b ON a.id = b.id
  WHERE a.pos = b.pos OR {PAIR_ERROR.format('a.t', 'b.t')} <= 0.2::DOUBLE),
k AS (SELECT id, pos, count(*) AS n_agree, first(t ORDER BY {WORDS.format('t')} DESC, length(t) DESC, place) AS text FROM c GROUP BY ALL),
b AS (SELECT id, first(n_agree ORDER BY n_agree DESC, pos) AS n_agree, first(text ORDER BY n_agree DESC, pos) AS text FROM k GROUP BY id),
f AS (SELECT b.*, w.drop7 AS fl FROM b JOIN wide w USING (id))
SELECT id, n_agree, text, CASE WHEN n_agree < 2 THEN 'no_agree' WHEN {PAIR_ERROR.format('text', 'fl')} < 0.08::DOUBLE THEN 'agree_with_floor'
  WHEN {WORDS.format('fl')} > 0 AND NOT ({WORDS.format('text')}::DOUBLE / {WORDS.format('fl')} BETWEEN 0.65::DOUBLE AND 1.45::DOUBLE) THEN 'length_reject'
  ELSE 'replaced' END AS status FROM f""")
def m05(spark, d):
    h = V.hypotheses(spark, d)
    return M.consensus(h, h.where("system = 'drop7'"), agree=0.2)


@query("m06_plurality_vote", """
WITH v AS (SELECT id, pos, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (
  SELECT id, pos, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS w FROM hyp)),
c AS (SELECT id, i, x, count(*) AS k, min(pos) AS p FROM v GROUP BY ALL),
b AS (SELECT id, i, first(x ORDER BY k DESC, p) AS x FROM c GROUP BY ALL),
t AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS text FROM b GROUP BY id)
SELECT u.id, coalesce(t.text, '.') AS text FROM utt u LEFT JOIN t USING (id)""")
def m06(spark, d):
    return M.plurality(V.hypotheses(spark, d))


@query("m07_lattice_fusion")
def m07(spark, d):
    train = V.utterances(spark, d).where("split <> 'test'")
    uni = C.word_counts(train, "reference", "language", marks=True)
    bi = C.bigram_counts(train, "reference", "language", marks=True)
    w = V.wide(spark, d).select("id", "language", "swap11", "dup5")
    return M.lattice_fusion(w, "id", "swap11", "dup5", bi, uni)


@query("m08_medoid_edits", f"""
WITH t AS (SELECT id, CASE WHEN hypothesis = '' THEN '.' ELSE hypothesis END AS t, min(pos) AS pos, max((system = 'drop7')::INT) AS inc FROM hyp GROUP BY ALL),
c AS (SELECT a.id, a.t, a.pos, a.inc, coalesce(sum(1 - (1 - ({PAIR_ERROR.format('a.t', 'b.t')}))), 0) AS cost
  FROM t a LEFT JOIN t b ON a.id = b.id AND a.pos <> b.pos GROUP BY ALL)
SELECT id, first(t ORDER BY round(cost, 9), inc DESC, pos) AS text, R6(first(cost ORDER BY round(cost, 9), inc DESC, pos)) AS cost FROM c GROUP BY id""")
def m08_edits(spark, d):
    return M.medoid(V.hypotheses(spark, d), "drop7")


TIERS = (0.99, 0.98, 0.97, 0.95, 0.9, 0.8)


@query("m09_edit_tiers", f"""
WITH t AS (SELECT id, drop7, swap11, dup5, 1 - ({PAIR_ERROR.format('drop7', 'swap11')}) AS s FROM wide WHERE swap11 <> ''),
k AS (SELECT unnest([0.99, 0.98, 0.97, 0.95, 0.9, 0.8])::DOUBLE AS x),
r AS (SELECT id, 'sim' || round(x * 100)::INT AS tier, s >= x AS take FROM t, k
  UNION ALL SELECT id, 'consensus', swap11 = dup5 FROM t UNION ALL SELECT id, 'full', true FROM t)
SELECT r.id, tier, CASE WHEN take THEN swap11 ELSE drop7 END AS text, take AND swap11 <> drop7 AS changed FROM r JOIN t USING (id)""")
def m09_edits(spark, d):
    return M.similarity_tiers(V.wide(spark, d), "id", "drop7", "swap11", "dup5", TIERS)


@query("m10_exact_agreement", """
SELECT id, swap11 = dup5 AND swap11 <> drop7 AS replaced, CASE WHEN swap11 = dup5 AND swap11 <> drop7 THEN swap11 ELSE drop7 END AS text FROM wide""")
def m10(spark, d):
    hit = M.exact_agreement(F.col("drop7"), F.col("swap11"), F.col("dup5"))
    return V.wide(spark, d).select("id", hit.alias("replaced"), F.when(hit, F.col("swap11")).otherwise(F.col("drop7")).alias("text"))


@query("m11_support_select_edits", f"""
WITH t AS (SELECT id, drop7, swap11, {WORDS.format('swap11')}::DOUBLE / greatest({WORDS.format('drop7')}, 1) BETWEEN 0.8::DOUBLE AND 1.25::DOUBLE
  AND 1 - ({PAIR_ERROR.format('swap11', 'dup5')}) >= 0.75::DOUBLE
  AND 1 - ({PAIR_ERROR.format('swap11', 'dup5')}) >= 1 - ({PAIR_ERROR.format('drop7', 'dup5')}) + 0.01::DOUBLE AS take FROM wide)
SELECT id, take, CASE WHEN take THEN swap11 ELSE drop7 END AS text FROM t""")
def m11_edits(spark, d):
    return M.support_select(V.wide(spark, d), "id", "drop7", "swap11", [("dup5", 0.75)], [("dup5", 0.01)], (0.8, 1.25))


@query("m12_agreement_modes", f"""
WITH t AS (SELECT w.id, drop7 AS a, swap11 AS b, dup5 AS c, r.p1 >= 0.6::DOUBLE AS sure,
  {PAIR_ERROR.format('drop7', 'swap11')} <= 0.2::DOUBLE AS ab, {PAIR_ERROR.format('drop7', 'dup5')} <= 0.2::DOUBLE AS ac,
  {PAIR_ERROR.format('swap11', 'dup5')} <= 0.2::DOUBLE AS bc FROM wide w JOIN routes r USING (id) WHERE r.lid_lang = r.decode_lang)
SELECT id, 'a_c' AS mode, a AS text FROM t WHERE ac AND sure UNION ALL SELECT id, 'b_c', c FROM t WHERE bc AND sure
UNION ALL SELECT id, 'two_of_three', a FROM t WHERE ab::INT + ac::INT + bc::INT >= 2 AND sure
UNION ALL SELECT id, 'all_three', a FROM t WHERE ab AND ac AND bc AND sure""")
def m12(spark, d):
    r = V.routes(spark, d)
    j = V.wide(spark, d).join(r.select("id", "p1"), "id")
    return M.agreement_modes(j, "id", "drop7", "swap11", "dup5", "p1", r.where("lid_lang <> decode_lang"), 0.2, 0.6)


@query("m13_word_op_policies", f"""
WITH RECURSIVE w AS (SELECT id, drop7 AS f, swap11 AS x, dup5 AS m FROM wide WHERE swap11 <> '' AND swap11 <> drop7),
{alignment("SELECT id, 'bm' AS side, f AS a, m AS b FROM w WHERE f <> m UNION ALL SELECT id, 'bx', f, x FROM w UNION ALL SELECT id, 'mx', m, x FROM w WHERE m <> x")},
o AS (SELECT id, side, count(*) FILTER (op = 'S') AS s, count(*) FILTER (op IN ('I', 'D')) AS shift FROM aligned GROUP BY ALL),
c AS (SELECT id, coalesce(max(s) FILTER (side = 'bm'), 0) AS bm_s, coalesce(max(shift) FILTER (side = 'bm'), 0) AS bm_g,
  coalesce(max(s + shift) FILTER (side = 'bx'), 0) AS bx, coalesce(max(s + shift) FILTER (side = 'mx'), 0) AS mx,
  coalesce(max(shift) FILTER (side = 'mx'), 0) AS mx_g FROM o GROUP BY id),
t AS (SELECT w.*, c.* EXCLUDE (id), 1 - ({PAIR_ERROR.format('f', 'x')}) AS sb, 1 - ({PAIR_ERROR.format('x', 'm')}) AS sx,
  {WORDS.format('f')} = {WORDS.format('m')} AS same FROM w LEFT JOIN c USING (id)),
p AS (SELECT *, unnest([{{'policy': 'agree99', 'ok': sx >= 0.99::DOUBLE}}, {{'policy': 'agree98', 'ok': sx >= 0.98::DOUBLE}}, {{'policy': 'agree95', 'ok': sx >= 0.95::DOUBLE}},
  {{'policy': 'agree90', 'ok': sx >= 0.9::DOUBLE}}, {{'policy': 'agree95_wordeq', 'ok': sx >= 0.95::DOUBLE AND same}},
  {{'policy': 'agree95_noinsdel', 'ok': sx >= 0.95::DOUBLE AND bm_g = 0}}, {{'policy': 'agree95_noinsdel_sub2', 'ok': sx >= 0.95::DOUBLE AND bm_g = 0 AND bm_s <= 2}},
  {{'policy': 'agree95_samecount_closer', 'ok': sx >= 0.95::DOUBLE AND same AND mx < bx}},
  {{'policy': 'agree95_xm_noinsdel_dist2', 'ok': sx >= 0.95::DOUBLE AND mx_g = 0 AND mx <= 2}}]) AS q FROM t),
s AS (SELECT *, CASE WHEN sb >= 0.95::DOUBLE THEN 'challenger' WHEN q.ok THEN 'helper' ELSE 'base' END AS source FROM p)
SELECT id, q.policy AS policy, source, CASE source WHEN 'challenger' THEN x WHEN 'helper' THEN m ELSE f END AS text FROM s""")
def m13(spark, d):
    return M.word_op_policies(V.wide(spark, d), "id", "drop7", "swap11", "dup5", sure=0.95)


OOV = """o AS (SELECT t.id, t.system, avg((l.word IS NULL)::INT) AS oov FROM
    (SELECT id, system, language, unnest(string_split(hypothesis, ' ')) AS word FROM pairs WHERE hypothesis <> '') t
    LEFT JOIN lex l ON l.language = t.language AND l.word = t.word GROUP BY ALL)"""


@query("m14_guarded_mixture", f"""
WITH {OOV}
SELECT w.id, take, CASE WHEN take THEN swap11 ELSE drop7 END AS text FROM (
  SELECT w.*, ({WORDS.format('swap11')} + 1e-6) / ({WORDS.format('drop7')} + 1e-6) BETWEEN 0.85::DOUBLE AND 1.4::DOUBLE AND coalesce(o.oov, 0) <= 0.2::DOUBLE
    AND conf_swap11 >= -0.06::DOUBLE AS take FROM wide w LEFT JOIN o ON o.id = w.id AND o.system = 'swap11') w""")
def m14(spark, d):
    two = V.scored(spark, d).where("system in ('drop7', 'swap11')")
    feats = Y.pair_table(two, "drop7", lexicon(spark, d)).withColumn("take", Y.guard((0.85, 1.40), 0.20, -0.06))
    return feats.select("id", "take", F.when(F.col("take"), F.col("alt_text")).otherwise(F.col("base_text")).alias("text"))


def _rule_features(spark, d):
    """L02 features of drop7 (a) and swap11 (b) side by side, with the error counts of both."""
    names = ("oov_rate", "singleton_rate", "unigram_logprob", "char_trigram_logprob", "words", "hypothesis", "we", "ce")
    s = V.scored(spark, d).where("system in ('drop7', 'swap11')").select("id", "speaker_id", "language", "nw", "nc", "system", "hypothesis", "we", "ce")
    f = L.text_features(s, ["id", "system"], "hypothesis", V.utterances(spark, d).where("split <> 'test'"))
    of = lambda sys, c: F.max(F.when(F.col("system") == sys, F.col(c)))
    return f.groupBy("id", "speaker_id", "language", "nw", "nc").agg(
        *[of("drop7", c).alias(f"a_{c}") for c in names], *[of("swap11", c).alias(f"b_{c}") for c in names]
    ).withColumn("pair_error", D.pair_error(F.col("a_hypothesis"), F.col("b_hypothesis")))


FEATURES = """
tr AS (SELECT language, '^^' || reference || '$' AS s FROM utt WHERE split <> 'test'),
tg AS (SELECT language, s[i : i + 2] AS gram, s[i + 2 : i + 2] AS ch FROM (SELECT language, s, unnest(range(1, length(s) - 1)) AS i FROM tr)),
gc AS (SELECT language, gram, count(*) AS n FROM tg GROUP BY ALL), cc AS (SELECT language, gram[1:2] AS ctx, sum(n) AS n FROM gc GROUP BY ALL),
vc AS (SELECT language, count(DISTINCT ch) FILTER (ch <> '$') AS v FROM tg GROUP BY ALL),
hg AS (SELECT id, system, language, s[i : i + 2] AS gram FROM (
  SELECT id, system, language, '^^' || hypothesis || '$' AS s, unnest(range(1, length(hypothesis) + 2)) AS i FROM pairs)),
dg AS (SELECT g.language, g.gram, ln((coalesce(gc.n, 0) + 0.2::DOUBLE) / (coalesce(cc.n, 0) + 0.2::DOUBLE * vc.v)) AS lp
  FROM (SELECT DISTINCT language, gram FROM hg) g LEFT JOIN gc ON gc.language = g.language AND gc.gram = g.gram
  LEFT JOIN cc ON cc.language = g.language AND cc.ctx = g.gram[1:2] JOIN vc ON vc.language = g.language),
gt AS (SELECT id, system, avg(lp) AS glp FROM hg JOIN dg USING (language, gram) GROUP BY ALL),
ft AS (SELECT s.*, coalesce(o.oov, 0) AS oov, coalesce(gt.glp, 0) AS glp, len(w) AS words,
    len(list_filter(w, lambda x: length(x) = 1))::DOUBLE / greatest(len(w), 1) AS single
  FROM (SELECT *, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS w FROM scored) s LEFT JOIN o USING (id, system) LEFT JOIN gt USING (id, system)),
rf AS (SELECT a.id, a.speaker_id, a.nw, a.nc, a.we AS awe, a.ce AS ace, b.we AS bwe, b.ce AS bce, a.hypothesis AS ta, b.hypothesis AS tb,
    b.glp - a.glp > 1e-9 AND a.words <= 8 AND a.single >= 0.3::DOUBLE AND b.words::DOUBLE / greatest(a.words, 1) >= 2.5 AS collapsed,
    b.glp - a.glp > 1e-9 AS better, a.oov - b.oov AS gain, """ + PAIR_ERROR.format("a.hypothesis", "b.hypothesis") + """ AS e
  FROM ft a JOIN ft b ON a.id = b.id AND a.system = 'drop7' AND b.system = 'swap11')"""


@query("m15_collapse_switch", f"""
WITH {OOV}, {FEATURES}
SELECT id, collapsed OR (better AND e <= 0.3::DOUBLE AND gain > -0.2::DOUBLE) AS switched FROM rf""")
def m15(spark, d):
    return _rule_features(spark, d).select("id", M.collapse_switch("a", "b", max_edit=0.3, min_oov_gain=-0.2).alias("switched"))


@query("m16_anomaly_reasons", f"""
WITH RECURSIVE {OOV}, {FEATURES}, {alignment("SELECT id, ta AS a, tb AS b FROM rf WHERE ta <> tb")},
x AS (SELECT id, string_agg(op, '' ORDER BY step) AS letters FROM aligned GROUP BY id),
t AS (SELECT rf.*, coalesce(letters, '') AS letters, list_filter(string_split(tb, ' '), lambda z: z <> '') AS w FROM rf LEFT JOIN x USING (id))
SELECT id, array_to_string(list_filter([
  CASE WHEN len(w) > 0 AND length(w[-1]) <= 1 THEN '{{0}}' END,
  CASE WHEN len(w) >= 2 AND w[-1] <> w[-2] AND (starts_with(w[-2], w[-1]) OR starts_with(w[-1], w[-2])) THEN '{{1}}' END,
  CASE WHEN e <= 0.2::DOUBLE AND regexp_matches(letters, '(^|C)(SII+|ISI+|II+SI*|DIII+|IDII+|IIDI+|III+DI*)(C|$)') THEN '{{2}}' END,
  CASE WHEN -gain > 0.1::DOUBLE THEN '{{3}}' END], lambda z: z IS NOT NULL), ';') AS reasons FROM t""".format(*ANOMALY_REASONS))
def m16(spark, d):
    f = _rule_features(spark, d)
    a, b = F.col("a_hypothesis"), F.col("b_hypothesis")
    reasons = M.anomaly_reasons(a, b, F.col("a_oov_rate"), F.col("b_oov_rate"), F.col("pair_error"), K.alignment(a, b))
    return f.select("id", reasons.alias("reasons"))


@query("m17_artifact_revert", """
WITH t AS (SELECT id, reference, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' ')) AS g FROM noisy),
r AS (SELECT *, len(g) - len(list_distinct(g)) >= 3 OR len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) >= 3
  OR len(w)::DOUBLE / greatest(len(string_split(reference, ' ')), 1) > 1.6 AS back FROM t)
SELECT id, back AS reverted, CASE WHEN back THEN reference ELSE array_to_string(w, ' ') END AS text FROM r""")
def m17(spark, d):
    w = F.col("w")
    t = V.noisy(spark, d).withColumn("back", M.artifact_revert(w, T.n_words(F.col("reference"))))
    return t.select("id", F.col("back").alias("reverted"), F.when(F.col("back"), F.col("reference")).otherwise(F.array_join(w, " ")).alias("text"))


MERGE = """
c AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM chunks WHERE len(w) > 0),
m AS (SELECT conv_id, turn, k, w AS piece, w AS merged FROM c WHERE k = 1
  UNION ALL
  SELECT c.conv_id, c.turn, c.k, c.w[s + 1 :], list_concat(m.merged, c.w[s + 1 :]) FROM (
    SELECT m.conv_id, m.merged, m.k, c.turn, c.w, coalesce(list_max(list_filter(range(1, 13), lambda z: z <= len(m.merged) AND z <= len(c.w)
      AND m.merged[-z:] = c.w[1:z])), 0) AS s FROM m JOIN c ON c.conv_id = m.conv_id AND c.k = m.k + 1) m JOIN c ON c.conv_id = m.conv_id AND c.k = m.k + 1)"""


@query("m18_merge_chunks", f"WITH RECURSIVE {MERGE} SELECT conv_id, turn, array_to_string(piece, ' ') AS piece FROM m")
def m18(spark, d):
    return M.merge_chunks(V.chunks(spark, d), "conv_id", "turn", "text")


@query("m18_merged_text", f"WITH RECURSIVE {MERGE} SELECT conv_id, array_to_string(max_by(merged, k), ' ') AS text FROM m GROUP BY conv_id")
def m18_text(spark, d):
    return M.merged_text(M.merge_chunks(V.chunks(spark, d), "conv_id", "turn", "text"), "conv_id", "turn")


@query("m18_merged_parts", f"""WITH RECURSIVE {MERGE},
p AS (SELECT conv_id, turn, array_to_string(piece, ' ') AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM m WHERE len(piece) > 0)
SELECT conv_id, pos // 4 AS part, string_agg(piece, ' ' ORDER BY turn) AS text FROM p GROUP BY ALL""")
def m18_parts(spark, d):
    # short segments and parts, so that conversations of some ten turns have several
    return M.merged_parts(M.merge_chunks(V.chunks(spark, d), "conv_id", "turn", "text", 4), "conv_id", "turn", 4)


SWEEP = (1.10, 1.15, 1.20, 1.30, 1.50, 2.00, 2.50, 2.75, 3.00)


@query("m19_threshold_sweep", f"""
WITH t AS (SELECT s.id, s.n, s.nw, s.nc, s.we AS cwe, s.ce AS cce, m.we AS mwe, m.ce AS mce, b.we AS bwe, b.ce AS bce,
  {WORDS.format('m.hypothesis')}::DOUBLE / greatest({WORDS.format('b.hypothesis')}, 1) AS r
  FROM scored s JOIN scored m ON m.id = s.id AND m.system = 'dup5' JOIN scored b ON b.id = s.id AND b.system = 'drop7' WHERE s.system = 'swap11'),
k AS (SELECT unnest([1.10, 1.15, 1.20, 1.30, 1.50, 2.00, 2.50, 2.75, 3.00])::DOUBLE AS threshold),
x AS (SELECT threshold, nw, nc, n % 3 = 0 AND r <= threshold AS take, CASE WHEN n % 3 <> 0 THEN cwe WHEN r <= threshold THEN mwe ELSE bwe END AS we,
  CASE WHEN n % 3 <> 0 THEN cce WHEN r <= threshold THEN mce ELSE bce END AS ce FROM t, k)
SELECT R6(threshold) AS threshold, count(*) FILTER (take) AS switches, R6(sum(we)::DOUBLE / sum(nw)) AS wer, R6(sum(ce)::DOUBLE / sum(nc)) AS cer,
  R6(0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(ce)::DOUBLE / sum(nc)) AS score FROM x GROUP BY threshold""")
def m19(spark, d):
    s = V.scored(spark, d)
    part = lambda sys, name: s.where(F.col("system") == sys).select(
        "id", F.col("hypothesis").alias(f"{name}_text"), F.col("we").alias(f"{name}_we"), F.col("ce").alias(f"{name}_ce")
    )
    base = s.where("system = 'swap11'").select("id", "n", "nw", "nc", F.col("we").alias("cand_we"), F.col("ce").alias("cand_ce"))
    j = base.join(part("dup5", "merged"), "id").join(part("drop7", "base"), "id")
    return M.threshold_sweep(j, D.word_ratio(F.col("merged_text"), F.col("base_text")), F.col("n") % 3 == 0, SWEEP)


def _fallback_sql() -> str:
    rules = ["('candidate_all', false)", "('incumbent_all', true)", "('incumbent_if_trailing_aa', regexp_matches(c, '(^| )aa$'))",
             "('incumbent_if_trailing_filler', regexp_matches(c, '(^| )(aa|ah|ee|eh)$'))"]
    rules += [f"('incumbent_if_word_ratio_gt_{t:.2f}', r > {t}::DOUBLE)" for t in fixed.FALLBACK_RATIO_ABOVE]
    rules += [f"('incumbent_if_word_ratio_lt_{t:.2f}', r < {t}::DOUBLE)" for t in fixed.FALLBACK_RATIO_BELOW]
    rules += [f"('incumbent_if_similarity_lt_{t:.2f}', s < {t}::DOUBLE)" for t in fixed.FALLBACK_SIMILARITY_BELOW]
    rules += ["('incumbent_if_duplicate_and_ratio_gt_1.20', twice AND r > 1.2::DOUBLE)"]
    return ", ".join(rules)


@query("m20_fallback_policies", f"""
WITH t AS (SELECT id, dup5 AS c, {WORDS.format('dup5')}::DOUBLE / greatest({WORDS.format('drop7')}, 1) AS r, 1 - ({PAIR_ERROR.format('dup5', 'drop7')}) AS s,
  list_filter(string_split(dup5, ' '), lambda x: x <> '') AS w FROM wide),
d AS (SELECT *, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 0 AS twice FROM t)
SELECT id, p[1] AS policy, p[2] AS fallback FROM (SELECT id, unnest([{_fallback_sql()}]) AS p FROM d)""")
def m20(spark, d):
    return M.fallback_policies(V.wide(spark, d), "id", "dup5", "drop7")


BLEND = """t AS (SELECT language, system, pos, 0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(ce)::DOUBLE / sum(nc) AS score FROM scored GROUP BY ALL),
b AS (SELECT language, first(system ORDER BY score, pos) AS system FROM t GROUP BY language)"""


@query("m21_language_blend", f"WITH {BLEND} SELECT s.id, s.language, s.system, s.hypothesis FROM scored s JOIN b USING (language, system)")
def m21(spark, d):
    return M.language_blend(V.scored(spark, d), 0.9)[0].select("id", "language", "system", "hypothesis")


@query("m21_blend_report", f"""
WITH {BLEND}, x AS (SELECT count(*) AS n, sum(we)::BIGINT AS we, sum(ce)::BIGINT AS ce, sum(nw)::BIGINT AS nw, sum(nc)::BIGINT AS nc FROM scored JOIN b USING (language, system))
SELECT *, R6(we::DOUBLE / nw) AS wer, R6(ce::DOUBLE / nc) AS cer, R6(0.5 * we::DOUBLE / nw + 0.5 * ce::DOUBLE / nc) AS score,
  1 - (0.5 * we::DOUBLE / nw + 0.5 * ce::DOUBLE / nc) > 0.9::DOUBLE + 1e-6 AS promoted FROM x""")
def m21_report(spark, d):
    return M.language_blend(V.scored(spark, d), 0.9)[1]


@query("m22_oracle_pick", """
WITH t AS (SELECT sum(nw) AS tw, sum(nc) AS tc FROM scored WHERE pos = 0),
r AS (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY round((0.5 * we::DOUBLE / tw + 0.5 * ce::DOUBLE / tc) * 1e6, 9), pos) AS k FROM scored s, t)
SELECT system, count(*) AS n, sum(we)::BIGINT AS we, sum(ce)::BIGINT AS ce FROM r WHERE k = 1 GROUP BY system""")
def m22(spark, d):
    return M.oracle_pick(V.scored(spark, d)).groupBy("system").agg(F.count("*").alias("n"), F.sum("we").alias("we"), F.sum("ce").alias("ce"))


FOLD = "('0x' || sha256('20260809:oof:' || speaker_id)[1:12])::BIGINT % 5"


@query("m23_cross_fitted_choice", f"""
WITH p AS (SELECT {FOLD} AS fold, system, pos, count(*) AS n, sum(we) AS we, sum(ce) AS ce, sum(nw) AS nw, sum(nc) AS nc FROM scored GROUP BY ALL),
t AS (SELECT *, 0.5 * (sum(we) OVER s - we)::DOUBLE / (sum(nw) OVER s - nw) + 0.5 * (sum(ce) OVER s - ce)::DOUBLE / (sum(nc) OVER s - nc) AS train
  FROM p WINDOW s AS (PARTITION BY system)),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(train, 12), pos) AS k FROM t)
SELECT fold, system AS selected, n, R6(train) AS train_score, R6(0.5 * we::DOUBLE / nw + 0.5 * ce::DOUBLE / nc) AS heldout_score FROM r WHERE k = 1""")
def m23(spark, d):
    s = V.scored(spark, d).withColumn("fold", G.hash_fold(F.col("speaker_id"), "20260809:oof", 5))
    return M.cross_fitted_choice(s, "fold")


@query("m24_nested_selector")
def m24(spark, d):
    from hyplab.operators.selector import nested_selector

    f = _rule_features(spark, d).withColumn("fold", G.hash_fold(F.col("speaker_id"), "20260809:oof", 5))
    return nested_selector(f, outer=5, inner=4)


@query("m25_nested_rules", f"""
WITH {OOV}, {FEATURES},
g AS (SELECT * FROM (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS max_edit), (SELECT unnest([-0.2, -0.05, 0.0, 0.05])::DOUBLE AS min_gain)),
x AS (SELECT {FOLD} AS fold, g.*, collapsed OR (better AND e <= max_edit AND gain > min_gain) AS sw, rf.* FROM rf, g),
p AS (SELECT fold, max_edit, min_gain, count(*) FILTER (sw AND ta <> tb) AS switches, sum(CASE WHEN sw THEN bwe ELSE awe END) AS we,
  sum(CASE WHEN sw THEN bce ELSE ace END) AS ce, sum(nw) AS nw, sum(nc) AS nc FROM x GROUP BY ALL),
t AS (SELECT *, (sum(switches) OVER s - switches)::BIGINT AS t_switches,
  0.5 * (sum(we) OVER s - we)::DOUBLE / (sum(nw) OVER s - nw) + 0.5 * (sum(ce) OVER s - ce)::DOUBLE / (sum(nc) OVER s - nc) AS train
  FROM p WINDOW s AS (PARTITION BY max_edit, min_gain)),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(train, 12), t_switches, max_edit, min_gain DESC) AS k FROM t)
SELECT fold, R6(max_edit) AS max_edit, R6(min_gain) AS min_gain, t_switches, R6(train) AS train_score,
  R6(0.5 * we::DOUBLE / nw + 0.5 * ce::DOUBLE / nc) AS heldout_score, switches FROM r WHERE k = 1""")
def m25(spark, d):
    f = _rule_features(spark, d).withColumn("fold", G.hash_fold(F.col("speaker_id"), "20260809:oof", 5))
    rows = [
        F.struct(F.lit(e).alias("max_edit"), F.lit(g).alias("min_gain"), M.collapse_switch("a", "b", max_edit=e, min_oov_gain=g).alias("sw"))
        for e in (0.05, 0.1, 0.2, 0.4) for g in (-0.2, -0.05, 0.0, 0.05)
    ]
    pick = lambda c: F.sum(F.when(F.col("sw"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))).alias(c)
    # map-side sums: 16 rules times 5 folds leave every task
    cells = f.select("*", F.inline(F.array(*rows))).groupBy("fold", "max_edit", "min_gain").agg(
        pick("we"), pick("ce"), F.sum("nw").alias("nw"), F.sum("nc").alias("nc"),
        F.count_if(F.col("sw") & (F.col("a_hypothesis") != F.col("b_hypothesis"))).alias("switches"),
    )
    return M.cross_fitted_rules(cells, "fold", ["max_edit", "min_gain"], [F.col("max_edit"), F.desc("min_gain")])


def _caches(spark, d):
    s = V.scored(spark, d)
    index = V.utterances(spark, d).select("id", F.col("language").alias("route"), F.when(F.col("split") == "test", "new").otherwise("old").alias("split"))
    table = S.corpus_scores(s, "language", "system")
    base = table.where("system = 'drop7'").select("language", F.col("score").alias("_base"))
    metrics = table.where("system <> 'drop7'").join(F.broadcast(base), "language").select(
        F.col("language").alias("route"), F.col("system").alias("model"), (F.col("score") < F.col("_base")).alias("strong_pass"),
        (1.0 - F.col("score")).alias("candidate"), (F.col("_base") - F.col("score")).alias("delta"),
    )
    caches = s.where("system = 'swap11' or (system = 'dup5' and n % 100 <> 0)").select(
        F.col("language").alias("route"), F.col("system").alias("model"), "id"
    )
    return caches, metrics, index


CACHE = """
t AS (SELECT language AS route, system AS model, 0.5 * sum(we)::DOUBLE / sum(nw) + 0.5 * sum(ce)::DOUBLE / sum(nc) AS score FROM scored GROUP BY ALL),
m AS (SELECT t.route, t.model, t.score < b.score AS strong, 1 - t.score AS candidate, b.score - t.score AS delta FROM t JOIN t b ON b.route = t.route AND b.model = 'drop7'
  WHERE t.model <> 'drop7'),
c AS (SELECT language AS route, system AS model, count(*) AS cache_rows, count(*) FILTER (split = 'test') AS in_new FROM scored
  WHERE system = 'swap11' OR (system = 'dup5' AND n % 100 <> 0) GROUP BY ALL),
e AS (SELECT language AS route, count(*) AS all_rows, count(*) FILTER (split = 'test') AS new_rows FROM utt GROUP BY ALL),
a AS (SELECT m.*, cache_rows, CASE WHEN cache_rows = all_rows THEN 'all' WHEN cache_rows = new_rows AND in_new = new_rows THEN 'new' END AS scope,
  CASE WHEN NOT strong THEN 'report not passed' WHEN m.route NOT IN ('en', 'fr', 'de') THEN 'unknown route' WHEN cache_rows IS NULL THEN 'no cache'
    WHEN cache_rows <> all_rows AND NOT (cache_rows = new_rows AND in_new = new_rows) THEN 'id set is no accepted scope' ELSE 'eligible' END AS reason
  FROM m LEFT JOIN c USING (route, model) LEFT JOIN e USING (route))"""


@query("m26_cache_audit", f"WITH {CACHE} SELECT route, model, R6(candidate) AS candidate, R6(delta) AS delta, cache_rows, scope, reason FROM a")
def m26(spark, d):
    return M.cache_audit(*_caches(spark, d), ("en", "fr", "de"))


@query("m26_composition", f"""
WITH {CACHE} SELECT route, model, R6(delta) AS delta, cache_rows, R6(delta * cache_rows / (SELECT count(*) FROM utt)) AS projected FROM (
  SELECT *, row_number() OVER (PARTITION BY route ORDER BY candidate DESC, delta DESC, model DESC) AS k FROM a WHERE reason = 'eligible') WHERE k = 1""")
def m26_composition(spark, d):
    caches, metrics, index = _caches(spark, d)
    audit = M.cache_audit(caches, metrics, index, ("en", "fr", "de"))
    total = index.agg(F.count("*").alias("_rows"))
    return M.compose(audit.join(F.broadcast(total), F.lit(True)), F.col("_rows")).select("route", "model", "delta", "cache_rows", "projected")


@query("m27_subset_fallback", """
SELECT u.id, coalesce(s.hypothesis, b.hypothesis) AS target, s.hypothesis IS NOT NULL AS decoded FROM utt u JOIN hyp b ON b.id = u.id AND b.system = 'drop7'
LEFT JOIN hyp s ON s.id = u.id AND s.system = 'swap11' AND s.confidence > -0.05::DOUBLE""")
def m27(spark, d):
    h = V.hypotheses(spark, d)
    done = h.where("system = 'swap11' and confidence > -0.05").select("id", F.col("hypothesis").alias("_new"))
    base = h.where("system = 'drop7'").select("id", "hypothesis")
    return J.restrict(base, V.utterances(spark, d), "id").join(done, "id", "left").select(
        "id", F.coalesce("_new", "hypothesis").alias("target"), F.col("_new").isNotNull().alias("decoded")
    )


@query("m28_hard_route", """
WITH t AS (SELECT w.id, lid_lang, p1, CASE WHEN drop7 = '' THEN '.' ELSE drop7 END AS base,
  CASE lid_lang WHEN 'en' THEN swap11 WHEN 'fr' THEN dup5 END AS single FROM wide w JOIN routes r USING (id)),
u AS (SELECT *, lid_lang IN ('en', 'fr') AND p1 >= 0.8::DOUBLE AS hit FROM t)
SELECT id, CASE WHEN hit THEN 'lid_single' ELSE 'keep_champion' END AS action, CASE WHEN hit THEN CASE WHEN single = '' THEN '.' ELSE single END ELSE base END AS text,
  hit AND CASE WHEN single = '' THEN '.' ELSE single END <> base AS changed FROM u""")
def m28(spark, d):
    j = V.wide(spark, d).join(V.routes(spark, d).select("id", "lid_lang", "p1"), "id")
    return M.hard_route(j, "lid_lang", "p1", "drop7", {"en": "swap11", "fr": "dup5"}, 0.8, keep=("de",)).select("id", "action", "text", "changed")
