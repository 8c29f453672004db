"""D: edit counts, similarities, alignments and prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.functions import distance as D
from hyplab.operators import pairs as P
from hyplab.plans import views as V
from hyplab.plans.alignment_sql import alignment
from hyplab.plans.registry import query


@query("d01_edit_counts", "SELECT id, system, we, ce, nw, nc FROM scored")
def d01(spark, d):
    return V.scored(spark, d).select("id", "system", "we", "ce", "nw", "nc")


@query("d02_bounded_distance", """
SELECT id, system, CASE WHEN levenshtein(reference, hypothesis) <= 5 THEN levenshtein(reference, hypothesis) ELSE 6 END::BIGINT AS distance FROM pairs""")
def d02(spark, d):
    return V.pairs(spark, d).select("id", "system", D.bounded_distance(F.col("reference"), F.col("hypothesis"), 5).alias("distance"))


PAIR_ERROR = """CASE WHEN {0} = {1} THEN 0 WHEN {0} = '' OR {1} = '' THEN 1
  ELSE levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})) END"""


@query("d03_pair_error", f"SELECT id, R6({PAIR_ERROR.format('drop7', 'swap11')}) AS error FROM wide")
def d03(spark, d):
    return V.wide(spark, d).select("id", D.pair_error(F.col("drop7"), F.col("swap11")).alias("error"))


@query("d04_similarity", f"SELECT id, system, R6(1 - ({PAIR_ERROR.format('reference', 'hypothesis')})) AS similarity FROM pairs")
def d04(spark, d):
    return V.pairs(spark, d).select("id", "system", D.similarity(F.col("reference"), F.col("hypothesis")).alias("similarity"))


@query("d05_word_alignment", f"""
WITH RECURSIVE {alignment("SELECT id, system, reference AS a, hypothesis AS b FROM pairs WHERE reference <> hypothesis")}
SELECT id, system, step, op, ref, hyp FROM aligned WHERE op <> 'C'""")
def d05(spark, d):
    return P.alignment_table(V.pairs(spark, d), ["id", "system"], "reference", "hypothesis")


@query("d06_length_guard", """
WITH t AS (SELECT id, len(list_filter(string_split(dup5, ' '), lambda x: x <> '')) AS a,
  len(list_filter(string_split(drop7, ' '), lambda x: x <> '')) AS b FROM wide)
SELECT id, R6(a::DOUBLE / greatest(b, 1)) AS ratio, a > 0 AND (b = 0 OR a::DOUBLE / greatest(b, 1) BETWEEN 0.5 AND 2.0) AS wide_ok,
  a > 0 AND (b = 0 OR a::DOUBLE / greatest(b, 1) BETWEEN 0.65::DOUBLE AND 1.45::DOUBLE) AS tight_ok FROM t""")
def d06(spark, d):
    new, old = F.col("dup5"), F.col("drop7")
    return V.wide(spark, d).select(
        "id", D.word_ratio(new, old).alias("ratio"), D.length_ok(new, old).alias("wide_ok"),
        D.length_ok(new, old, 0.65, 1.45).alias("tight_ok"),
    )


def _pair_counts() -> str:
    from hyplab.plans.oracle_views import edit_select

    return edit_select("j", "ta", "tb", "id, system_a, system_b, ta, tb")


@query("d07_pairwise_agreement", f"""
WITH j AS (SELECT a.id, a.system AS system_a, b.system AS system_b, a.hypothesis AS ta, b.hypothesis AS tb
  FROM hyp a JOIN hyp b ON a.id = b.id AND a.pos < b.pos), c AS ({_pair_counts()})
SELECT id, system_a, system_b, R6({PAIR_ERROR.format('ta', 'tb')}) AS error, ta = tb AS exact,
  CASE WHEN ta = '' THEN len(list_filter(string_split(tb, ' '), lambda x: x <> '')) ELSE we END::BIGINT AS word_distance FROM c""")
def d07(spark, d):
    return P.agreement(V.hypotheses(spark, d))


@query("d07_pair_operations", f"""
WITH RECURSIVE j AS (SELECT a.id, a.system AS system_a, b.system AS system_b, a.hypothesis AS a, b.hypothesis AS b
  FROM hyp a JOIN hyp b ON a.id = b.id AND a.pos < b.pos), {alignment("SELECT * FROM j WHERE a <> b")},
n AS (SELECT id, system_a, system_b, count(*) FILTER (op = 'S') AS s, count(*) FILTER (op = 'I') AS i, count(*) FILTER (op = 'D') AS d
  FROM aligned GROUP BY ALL)
SELECT id, system_a, system_b, coalesce(s, 0) AS substitutions, coalesce(i, 0) AS insertions, coalesce(d, 0) AS deletions
FROM j LEFT JOIN n USING (id, system_a, system_b)""")
def d07_ops(spark, d):
    return P.pair_operations(V.hypotheses(spark, d))


_PROTO = """
proto_raw AS (SELECT label, i, avg(x) AS m FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {0}) WHERE label IN (0, 1) GROUP BY ALL),
proto AS (SELECT label, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-8) AS p FROM proto_raw)"""
_MARGIN = """
e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {0}),
margin AS (SELECT e.vec_id, any_value(e.label) AS label,
  sqrt(sum((x - n.p) * (x - n.p))) - sqrt(sum((x - q.p) * (x - q.p))) AS margin
  FROM e JOIN proto n ON n.label = 1 AND n.i = e.i JOIN proto q ON q.label = 0 AND q.i = e.i GROUP BY e.vec_id)"""


@query("d08_prototype_margin", f"WITH {_PROTO.format('embeddings')}, {_MARGIN.format('embeddings')} SELECT vec_id, R6(margin) AS margin FROM margin")
def d08(spark, d):
    e = V.table(spark, d, "embeddings")
    return P.prototype_margin(e, P.prototypes(e, "label", "embedding", (0, 1)), "embedding", 0, 1).select("vec_id", "margin")
