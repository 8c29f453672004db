"""A, I and K: table contracts over the derived index."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.operators import contracts as C, score as S
from hyplab.plans import views as V
from hyplab.plans.registry import query
from hyplab.sources import index as I, tables as T


@query("a01_text_scan", "SELECT doc_id, source, text, lang FROM documents")
def a01(spark, d):
    return I.scan_text(spark, f"{d}/documents.parquet", ("doc_id", "source", "text", "lang"))


@query("a02_shard_discovery", "SELECT 'documents.parquet' AS file, count(*) AS rows FROM documents")
def a02(spark, d):
    # a shard is a file or a folder of parts; either way its name is the part of the path that matches
    shard = F.regexp_extract("_metadata.file_path", "^.*/(doc[^/]*[.]parquet)(/[^/]*)?$", 1)
    files = spark.read.parquet(f"{d}/doc*.parquet").select(shard.alias("file"))
    return files.groupBy("file").agg(F.count("*").alias("rows"))


@query("a03_harmonise", """
SELECT doc_id AS "ID", '' AS speaker_id, text AS "Target", CASE WHEN source IN ('src1', 'src2') OR lang = 'es' THEN 'xx' ELSE lang END AS language, '' AS gender,
  'train' AS split, 'cfg' AS hf_config FROM documents""")
def a03(spark, d):
    t = V.table(spark, d, "documents")
    blank = F.when(F.col("source").isin("src1", "src2"), F.lit("")).when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("lang"))
    part = t.select(F.col("doc_id").alias("id"), F.col("text").alias("transcription"), blank.alias("language"))
    return I.harmonise(part, "xx", "train", "cfg")


@query("a05_shard_union", "SELECT id, hypothesis AS prediction FROM hyp WHERE system = 'swap11'")
def a05(spark, d):
    h = V.hypotheses(spark, d).where("system = 'swap11'").select("id", F.col("hypothesis").alias("prediction"), "confidence")
    shards = h.drop("confidence").unionByName(h.where("confidence > -0.05").drop("confidence"))
    return T.union_shards(shards, "id", "prediction")


@query("a05_shard_conflicts", """
SELECT id, 2::BIGINT AS "values", 2::BIGINT AS rows FROM wide WHERE conf_dup5 > -0.05::DOUBLE AND swap11 <> dup5""")
def a05_conflicts(spark, d):
    w = V.wide(spark, d)
    shards = w.select("id", F.col("swap11").alias("prediction")).unionByName(w.where("conf_dup5 > -0.05").select("id", F.col("dup5").alias("prediction")))
    return T.shard_conflicts(shards, "id", "prediction")


@query("a06_index_summary", """
SELECT language, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM utt GROUP BY language""")
def a06(spark, d):
    return I.summary(V.utterances(spark, d))


@query("a06_index_projections", """
SELECT 'train' AS part, id AS "ID", reference AS "Target" FROM utt WHERE split = 'train' UNION ALL SELECT 'test', id, NULL FROM utt WHERE split = 'test'
UNION ALL SELECT 'sample', id, '' FROM utt WHERE split = 'test'""")
def a06_projections(spark, d):
    parts = I.projections(V.utterances(spark, d).select(F.col("id").alias("ID"), F.col("reference").alias("Target"), "language", "split"))
    return I.union_parts(p.withColumn("part", F.lit(name)) for name, p in parts.items()).select("part", "ID", "Target")


@query("a08_training_frame", "SELECT id, split, reference FROM utt WHERE split <> 'test'")
def a08(spark, d):
    return I.training_frame(V.utterances(spark, d)).select("id", "split", "reference")


@query("a09_labelled_union", """
SELECT language, split, id AS "ID", reference AS "Target" FROM (SELECT *, row_number() OVER (PARTITION BY language, split ORDER BY id) AS r FROM utt WHERE split <> 'test') WHERE r <= 500""")
def a09(spark, d):
    u = V.utterances(spark, d).select("id", "language", "split", F.col("reference").alias("transcription"))
    return I.labelled(u, cap=500).select("language", "split", "ID", "Target")


@query("a10_round_trip", "SELECT count(*) AS rows, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) FILTER (drop7 <> swap11) AS changed FROM wide")
def a10(spark, d):
    w = V.wide(spark, d)
    return T.round_trip(w.select("id", F.col("swap11").alias("t")), w.select("id", F.col("drop7").alias("t")), "id", "t")


@query("a11_pivot_wide", "SELECT id, drop7, swap11, dup5 FROM wide")
def a11(spark, d):
    return T.to_wide(V.hypotheses(spark, d), V.SYSTEMS)


@query("a12_report_json")
def a12(spark, d):
    return T.report_json(S.scores_with_total(V.scored(spark, d), ["system"], "language"))


@query("a13_lines_digest", "SELECT doc_id, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR) || chr(10)) AS digest FROM utt GROUP BY doc_id")
def a13(spark, d):
    # the windows of one document: as many as it has text
    u = V.utterances(spark, d).groupBy("doc_id").agg(F.collect_list(F.col("id").cast("string")).alias("ids"))
    return u.select("doc_id", T.lines_digest(F.col("ids")).alias("digest"))


@query("a13_table_digest", """
SELECT split, count(*) AS rows, bit_xor(('0x' || sha256(id::VARCHAR || chr(1) || reference)[1:15])::BIGINT) AS digest FROM utt GROUP BY split""")
def a13_table(spark, d):
    return T.table_digest(V.utterances(spark, d), "id", "reference", by=["split"])


@query("i01_guarded_read", "SELECT id, language FROM utt WHERE split = 'test'")
def i01(spark, d):
    u = V.utterances(spark, d).select("id", "language", "split", "reference")
    return I.guarded(u, ["test"], allow_test=True, label="reference").select("id", "language")


@query("i02_text_leakage", """
SELECT reference, count(DISTINCT split) AS parts FROM utt GROUP BY reference HAVING count(DISTINCT split) > 1""")
def i02(spark, d):
    return C.overlap(V.utterances(spark, d), "reference", "split")


@query("i02_id_leakage", """
WITH p AS (SELECT id, split FROM utt UNION ALL SELECT id, 'test' FROM utt WHERE n % 23 = 0)
SELECT id, count(DISTINCT split) AS parts FROM p GROUP BY id HAVING count(DISTINCT split) > 1""")
def i02_ids(spark, d):
    u = V.utterances(spark, d)
    again = u.where("n % 23 = 0").select("id", F.lit("test").alias("split"))
    return C.overlap(u.select("id", "split").unionByName(again), "id", "split")


@query("i03_submission_check", """
WITH s AS (SELECT id + CASE WHEN n % 97 = 0 THEN 50000 ELSE 0 END AS id, drop7 AS t FROM wide WHERE n % 89 <> 0 UNION ALL SELECT id, drop7 FROM wide WHERE n % 91 = 1 AND n % 89 <> 0 AND n % 97 <> 0),
k AS (SELECT id, count(*) AS n, count(*) FILTER (trim(t) = '') AS blank, count(*) FILTER (t IN ('', '.', 'nan', 'null', 'none')) AS bad FROM s GROUP BY id),
c AS (SELECT count(u.id) AS template_rows, sum(k.n)::BIGINT AS rows, count(*) FILTER (k.id IS NULL) AS missing, count(*) FILTER (u.id IS NULL) AS extra, sum(blank)::BIGINT AS "empty",
  count(*) FILTER (k.n > 1) AS duplicated, sum(bad)::BIGINT AS placeholders FROM utt u FULL OUTER JOIN k ON k.id = u.id)
SELECT *, concat_ws(';', CASE WHEN rows <> template_rows THEN 'row_count' END, CASE WHEN missing > 0 OR extra > 0 THEN 'id_set' END, CASE WHEN "empty" > 0 THEN 'empty' END,
  CASE WHEN duplicated > 0 THEN 'duplicates' END, CASE WHEN placeholders > 0 THEN 'placeholders' END) AS errors,
  rows = template_rows AND missing = 0 AND extra = 0 AND "empty" = 0 AND duplicated = 0 AND placeholders = 0 AS ok FROM c""")
def i03(spark, d):
    w = V.wide(spark, d).where("n % 89 <> 0")
    moved = w.select((F.col("id") + F.when(F.col("n") % 97 == 0, 50000).otherwise(0)).alias("id"), F.col("drop7").alias("t"))
    twice = w.where("n % 91 = 1 and n % 97 <> 0").select("id", F.col("drop7").alias("t"))
    return C.submission_check(V.utterances(spark, d), moved.unionByName(twice), "id", "t", strict=True, unicode_form=False)


@query("i04_order_check", """
SELECT count(*) AS expected_rows, count(*) AS rows, count(*) FILTER (n % 10 = 3) AS moved, count(*) FILTER (n % 10 = 3) = 0 AS ok FROM utt""")
def i04(spark, d):
    u = V.utterances(spark, d)
    expected = u.select("id", F.col("id").alias("pos"))
    actual = u.select((F.col("id") + F.when(F.col("n") % 10 == 3, 1).otherwise(0)).alias("id"), F.col("id").alias("pos"))
    return C.order_check(expected, actual, "id", "pos")


@query("i05_public_check", """
WITH f AS (SELECT CASE WHEN n % 50 = 7 THEN 'X_' ELSE 'ID_' END || id AS id, drop7 AS t FROM wide
  UNION ALL SELECT 'ID_' || id, 'nan' FROM wide WHERE n % 60 = 1 AND n % 50 <> 7),
k AS (SELECT id, count(*) AS n, count(*) FILTER (lower(trim(t)) IN ('', '.', 'nan', 'null', 'none')) AS bad FROM f GROUP BY id),
c AS (SELECT sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicated, count(*) FILTER (NOT starts_with(id, 'ID_')) AS bad_prefix, sum(bad)::BIGINT AS placeholders FROM k)
SELECT *, concat_ws(';', CASE WHEN rows <> (SELECT count(*) FROM utt) THEN 'row_count' END, CASE WHEN duplicated > 0 THEN 'duplicates' END,
  CASE WHEN bad_prefix > 0 THEN 'prefix' END, CASE WHEN placeholders > 0 THEN 'placeholders' END) AS errors,
  rows = (SELECT count(*) FROM utt) AND duplicated = 0 AND bad_prefix = 0 AND placeholders = 0 AS ok FROM c""")
def i05(spark, d):
    w = V.wide(spark, d)
    named = w.select(F.concat(F.when(F.col("n") % 50 == 7, "X_").otherwise("ID_"), F.col("id").cast("string")).alias("id"), F.col("drop7").alias("t"))
    twice = w.where("n % 60 = 1 AND n % 50 <> 7").select(F.concat(F.lit("ID_"), F.col("id").cast("string")).alias("id"), F.lit("nan").alias("t"))
    return C.public_file_check(named.unionByName(twice), "id", "t", V.utterances(spark, d).count(), "ID_")


# The route order is falling ids. English caches keep it, Spanish ones are sorted by id, French ones have
# rows out of place, German ones miss rows, and some rows belong to no route.
@query("i06_route_cache", """
WITH c AS (SELECT id, decode_lang, CASE WHEN decode_lang = 'es' THEN id WHEN decode_lang = 'fr' AND n % 20 = 0 THEN -id - 1000000000 ELSE -id END AS o
  FROM routes WHERE NOT (decode_lang = 'de' AND n % 30 = 0)),
p AS (SELECT id, row_number() OVER (PARTITION BY decode_lang ORDER BY o) AS here FROM c),
e AS (SELECT id, decode_lang, row_number() OVER (PARTITION BY decode_lang ORDER BY -id) AS in_route, row_number() OVER (PARTITION BY decode_lang ORDER BY id) AS by_key FROM routes),
j AS (SELECT decode_lang, count(*) AS expected, count(*) FILTER (here IS NULL) AS missing, 0::BIGINT AS extra, count(*) FILTER (here <> in_route) AS off_route_order,
    count(*) FILTER (here <> by_key) AS off_key_order FROM e LEFT JOIN p USING (id) GROUP BY decode_lang
  UNION ALL SELECT NULL, 0, 0, count(*), 0, 0 FROM routes WHERE n % 40 = 0 HAVING count(*) > 0)
SELECT *, missing = 0 AND extra = 0 AS exact, missing = 0 AND extra = 0 AND (off_route_order = 0 OR off_key_order = 0) AS ordered FROM j""")
def i06(spark, d):
    r = V.routes(spark, d).withColumn("q", -F.col("id"))
    o = F.when(F.col("decode_lang") == "es", F.col("id")).when((F.col("decode_lang") == "fr") & (F.col("n") % 20 == 0), F.col("q") - 1000000000).otherwise(F.col("q"))
    cache = r.where("not (decode_lang = 'de' and n % 30 = 0)").select("id", o.alias("o"))
    stray = r.where("n % 40 = 0").select((-F.col("id") - 1).alias("id"), F.lit(0).cast("long").alias("o"))
    return C.route_cache_check(r, cache.unionByName(stray), "id", "decode_lang", "q", "o")


@query("i07_pack_rows", """
SELECT w.id, lower(trim(upper(r.lid_lang))) AS lid_lang, R6(r.p1) AS lid_p1, CASE WHEN r.decode_lang IN ('en', 'fr') THEN r.decode_lang WHEN r.decode_lang = 'de' THEN 'en' ELSE 'fr' END AS decode_lang,
  drop7 AS first_hyp, R6(conf_drop7) AS first_score, dup5 AS second_hyp, R6(conf_dup5) AS second_score FROM wide w JOIN routes r USING (id)""")
def i07(spark, d):
    from hyplab.plans.joins import LOOKUP

    w = V.wide(spark, d).select("id", F.upper("drop7").alias("first_hyp"), F.col("conf_drop7").alias("first_score"), F.col("dup5").alias("second_hyp"), F.col("conf_dup5").alias("second_score"))
    r = V.routes(spark, d).select("id", F.upper("lid_lang").alias("lid_lang"), F.col("p1").alias("lid_p1"), "decode_lang")
    return C.pack_rows(w.join(r, "id"), LOOKUP, unicode_form=False)


@query("i08_json_records", """
WITH p AS (SELECT user_id, event_type, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events)
SELECT user_id, count(*) AS records, count(*) FILTER (k <> '' AND trim(event_type) <> '') AS valid, count(DISTINCT event_type) AS n_event_type, R6(max(k::BIGINT)) AS anchor,
  count(*) FILTER (k <> '' AND trim(event_type) <> '') >= 60 AND count(DISTINCT event_type) >= 5 AND max(k::BIGINT) >= 98 AS ok FROM p GROUP BY user_id""")
def i08(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_type", "props")
    return C.json_records(e, "props", "k bigint", ("k", "event_type"), "user_id", 60, {"event_type": 5}, ("k", 98))


@query("i09_route_inventory", """
SELECT 'lid_lang' AS "column", lid_lang AS value, count(*) AS n FROM routes GROUP BY ALL UNION ALL SELECT 'decode_lang', decode_lang, count(*) FROM routes GROUP BY ALL
UNION ALL SELECT 'split', split, count(*) FROM utt GROUP BY ALL""")
def i09(spark, d):
    r = V.routes(spark, d).join(V.utterances(spark, d).select("id", "split"), "id")
    return C.route_inventory(r, ("lid_lang", "decode_lang", "split"))


@query("i10_label_checks", """
WITH l AS (SELECT id, speaker_id, split, language AS wanted, CASE WHEN n % 41 = 0 THEN 'xx' ELSE language END AS language, CASE WHEN n % 53 = 0 THEN ' ' ELSE reference END AS t FROM utt
  UNION ALL SELECT id, speaker_id, split, language, language, reference FROM utt WHERE n % 67 = 0),
k AS (SELECT wanted, split, id, count(*) AS n, count(*) FILTER (trim(t) = '') AS blank, count(*) FILTER (language <> wanted) AS other FROM l GROUP BY ALL),
c AS (SELECT wanted, split, sum(n)::BIGINT AS rows, count(*) FILTER (n > 1) AS duplicated, sum(blank)::BIGINT AS blank, sum(other)::BIGINT AS other_language FROM k GROUP BY ALL)
SELECT c.*, s.speakers, duplicated = 0 AND blank = 0 AND other_language = 0 AS ok
FROM c JOIN (SELECT wanted, split, count(DISTINCT speaker_id) AS speakers FROM l GROUP BY ALL) s USING (wanted, split)""")
def i10(spark, d):
    u = V.utterances(spark, d).withColumn("wanted", F.col("language"))
    fetched = u.withColumns({
        "language": F.when(F.col("n") % 41 == 0, "xx").otherwise(F.col("language")),
        "reference": F.when(F.col("n") % 53 == 0, " ").otherwise(F.col("reference")),
    })
    return C.label_checks(fetched.unionByName(u.where("n % 67 = 0")), "id", "reference", "language", F.col("wanted"), "wanted", "split")


@query("k01_set_difference", """
SELECT count(*) AS expected, count(*) FILTER (n % 40 = 5) AS missing, count(*) FILTER (n % 60 = 11) AS extra, false AS equal FROM utt""")
def k01(spark, d):
    u = V.utterances(spark, d)
    actual = u.where("n % 40 <> 5").select("id").unionByName(u.where("n % 60 = 11").select((F.col("id") + 50000).alias("id")))
    return C.set_difference(u, actual, "id")


@query("k02_overlap", """
SELECT id, 2::BIGINT AS parts FROM wide WHERE conf_swap11 > -0.06::DOUBLE AND conf_dup5 > -0.06::DOUBLE""")
def k02(spark, d):
    w = V.wide(spark, d)
    parts = w.where("conf_swap11 > -0.06").select("id", F.lit("a").alias("part")).unionByName(w.where("conf_dup5 > -0.06").select("id", F.lit("b").alias("part")))
    return C.overlap(parts, "id", "part")


@query("k03_change_sets", """
SELECT id, swap11 AS text, dup5 <> drop7 AS failed_id, dup5 <> drop7 AND swap11 = dup5 AS failed_exact FROM wide WHERE swap11 <> drop7""")
def k03(spark, d):
    w = V.wide(spark, d)
    of = lambda s: w.select("id", F.col(s).alias("text"))
    return C.change_sets(of("drop7"), of("swap11"), of("dup5"), "id", "text")


@query("k04_union_spaces", """
SELECT id, 0::BIGINT AS block, -id AS rank FROM utt WHERE split <> 'test' UNION ALL SELECT id, 1, id FROM utt WHERE split = 'test'""")
def k04(spark, d):
    u = V.utterances(spark, d)
    old = u.where("split <> 'test'").select("id", (-F.col("id")).alias("pos"))
    return C.union_spaces(old, u.select("id"), "id", "pos")
