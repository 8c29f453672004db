"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hyplab.llm import bin_slack, hard_negatives, line_rules, line_templates, mixing, near_duplicates, packing, prefix_trie, quality_classifier, sentence_spans, sharding, simhash, toxicity
from hyplab.llm.store import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def put(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PHRASE = "|".join(line_rules.PHRASES)

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
         FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, g FROM wins GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM wins JOIN again USING (r, g), (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
full_lines AS (SELECT r, l, {_WORDS.replace("text", "l")} AS w FROM lines),
judged AS (SELECT r, l, len(w) AS nw,
    NOT regexp_matches(w[len(w)], '[.!?:;"'')”…»。]$')
    OR len(l) - len(replace(l, '|', '')) >= 3
    OR len(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) * 100 > len(array_to_string(w, '')) * 10
    OR (len(w) >= 3 AND len(regexp_replace(l, '[^A-Z]', '', 'g')) * 100 > len(regexp_replace(l, '[^A-Za-z]', '', 'g')) * 60)
    OR regexp_matches(lower(l), '{_PHRASE}') AS fails
  FROM full_lines WHERE len(w) > 0),
byline AS (SELECT r, count(*) - count(DISTINCT l) AS dups, sum(CASE WHEN fails THEN nw ELSE 0 END) AS lost FROM judged GROUP BY r),
base AS (SELECT d.r, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep USING (r) LEFT JOIN byline USING (r)),
verdict AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words - lost) * 100 >= n_words * 50 AS kept FROM verdict
"""


@register("op6_line_rules", OP6_SQL)
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# Links by counting shared shingles, components by following the least reachable id.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.o, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.o, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS o FROM reach GROUP BY doc_id) m USING (doc_id)
"""


@register("op5_near_duplicates", OP5_SQL)
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("hash")


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


# The mix by sorting: documents by place, taken up to the budget, the one at the boundary if that comes nearer.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
  FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size AS cap, 2 * source_size / w AS r, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER
    (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
l AS (SELECT level FROM f WHERE level * w <= cap ORDER BY r, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM l) * w, cap)), 6) AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
p AS (SELECT d.*, source_size, target, base, target - base * source_size AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS same
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (base + CASE WHEN need > 0 AND (upto <= need OR (upto - same <= need AND (need - (upto - same)) * 2 > same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


@register("op8_source_mixing", OP8_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(mixing.measure(table(spark, sf_dir, "documents")).select("doc_id", "source", "_size", "_place"))
    mixed = mixing.take(slim, mixing.plan(slim, mixing.targets(slim)))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


# Templates as strings: tokens with a digit read <*>, one segment of the rest may be open (~). Different texts are counted.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, i, l, list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
      FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d)),
f AS (SELECT r, i, l, t, len(t) AS n, len(t) || ':' || array_to_string(t[1:3], ' ') AS leaf FROM l WHERE len(t) > 0),
m AS (SELECT r, i, n, leaf, len(t) || ':' || array_to_string(t, ' ') AS template FROM f
      UNION ALL
      SELECT r, i, n, leaf, n || ':' || s || '~' || array_to_string(t[1:3 + ((n - 3) * s) // 4], ' ') || '~' ||
        array_to_string(t[4 + ((n - 3) * (s + 1)) // 4:], ' ') FROM f, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE n >= 8),
distinct_lines AS (SELECT DISTINCT r, leaf, len(t) || ':' || array_to_string(t, ' ') AS template FROM f),
live AS (SELECT leaf FROM distinct_lines GROUP BY leaf HAVING count(*) >= 10),
per AS (SELECT DISTINCT r, template, whole FROM (SELECT m.*, f.n || ':' || array_to_string(f.t, ' ') AS whole FROM m JOIN f USING (r, i) WHERE m.leaf IN (FROM live))),
often AS (SELECT template FROM (SELECT DISTINCT text, template FROM per JOIN d USING (r)) GROUP BY template HAVING count(*) >= 10),
gone AS (SELECT DISTINCT r, i, n FROM m WHERE template IN (FROM often) AND leaf IN (FROM live)),
lost AS (SELECT r, sum(n) AS k, count(*) AS c FROM gone GROUP BY r),
sums AS (SELECT r, sum(n) AS words, count(*) AS lines FROM f GROUP BY r),
v AS (SELECT d.r, doc_id, text, coalesce(lines, 0) AS lines, coalesce(k, 0) AS k, coalesce(c, 0) AS c, coalesce(k = words, false) AS much
      FROM d LEFT JOIN sums USING (r) LEFT JOIN lost USING (r)),
kept AS (SELECT l.r, string_agg(l.l, chr(10) ORDER BY l.i) AS text FROM l JOIN v USING (r) LEFT JOIN gone g ON g.r = l.r AND g.i = l.i
         WHERE c > 0 AND NOT much AND g.r IS NULL GROUP BY l.r)
SELECT doc_id, CAST(lines AS BIGINT) AS n_lines, CAST(CASE WHEN much THEN 0 ELSE c END AS BIGINT) AS n_lines_dropped,
  CAST(CASE WHEN much THEN 0 ELSE k END AS BIGINT) AS n_words_dropped, much AS mostly_recurring,
  CASE WHEN c > 0 AND NOT much THEN coalesce(kept.text, '') ELSE v.text END AS text
FROM v LEFT JOIN kept USING (r)
"""


@register("op10_line_templates", OP10_SQL)
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op4_sentence_spans")
def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))


@register("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints; rows whose id is divisible by 50 also ask how many other rows lie within the radius (n_within)."""
    made = cut(simhash.fingerprints(table(spark, sf_dir, "documents")))
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    queries = made.where(asks)
    around = simhash.near(queries, made).groupBy("query").agg((F.sum("n") - 1).alias("n_within"))
    asked = queries.join(around, queries["fp"] == around["query"], "left").drop("query")
    others = made.where(~asks).withColumn("n_within", F.lit(None).cast("long"))
    return asked.unionByName(others).select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(F.col("fp")).alias("fingerprint"),
        simhash.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_within")


@register("op2_toxicity_chain")
def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taught = toxicity.weak_categories(docs, toxicity.sample_labels(table(spark, sf_dir, "labels")))
    chain = toxicity.fit(cut(taught), (*toxicity.SEEDS, "toxic"))
    scored = toxicity.score(docs, chain)
    return scored.withColumn("held_out", quality_classifier.held_out(F.col("doc_id")))


@register("op11_minimum_bin_slack")
def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = bin_slack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# CRC-32 of a decimal by table; nodes are lists of turns; a subtree holds the nodes that start with its top.
OP13_SQL = r"""
WITH RECURSIVE steps(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 9 AS h FROM own, crc),
paths AS (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS p
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
members AS (SELECT conv_id, p, unnest(range(len(p) + 1)) AS depth FROM paths),
nodes AS (SELECT depth, p[:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, p[:depth]),
kids AS (SELECT depth - 1 AS depth, node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_sums AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[n.depth].t) END AS saved FROM nodes n LEFT JOIN kids USING (depth, node)),
up AS (SELECT leaf, saved, node, unnest(range(depth + 1)) AS top FROM own_sums),
sums AS (SELECT top AS depth, node[:top] AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top, node[:top])
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM own_sums n JOIN sums s ON s.depth = n.depth AND s.node = n.node LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.node = n.node[:n.depth - 1]
"""


@register("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


# Scores of every anchor with every row; whole numbers below 2 ** 53 are exact as doubles.
OP12_SQL = r"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@register("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved))
