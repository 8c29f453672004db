"""B: text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from hyplab.functions import fixed, text as T
from hyplab.operators import counts as C, lexicon as X
from hyplab.plans import views as V
from hyplab.plans.registry import query
from hyplab.session import spread


def docs(spark, d):
    return spread(V.table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")


NORM = """trim(regexp_replace(trim(regexp_replace(regexp_replace(
  CASE WHEN trim(lower(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', '', 'g'))) IN ('nan', 'null', 'none') THEN ''
  ELSE lower(regexp_replace({0}, '[\\x00-\\x1f\\x7f]', '', 'g')) END,
  '[^\\pL\\pN_\\s'']+', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+''\\s+', ' ', 'g'), ''' ')"""


@query("b01_normalize_text", f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def b01(spark, d):
    return docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("b02_tokenize_words", f"""
WITH t AS (SELECT doc_id, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS kinds, md5(array_to_string(w, '|')) AS digest FROM t""")
def b02(spark, d):
    w = F.col("w")
    return (
        docs(spark, d).withColumn("_n", T.normalize(F.col("text"))).withColumn("w", T.words(F.col("_n")))
        .select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"), F.md5(F.array_join(w, "|")).alias("digest"))
    )


_KEEP = "trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f\\xad]', '', 'g'), '\\s+', ' ', 'g'))"
_STRIP = f"trim(regexp_replace(replace(regexp_replace(replace({_KEEP}, '''', chr(57344)), '\\pP', ' ', 'g'), chr(57344), ''''), '\\s+', ' ', 'g'))"


@query("b03_scoring_regimes", f"""
SELECT doc_id, 'keep' AS regime, {_KEEP} AS out FROM documents
UNION ALL SELECT doc_id, 'strip_preserve_case', {_STRIP} FROM documents
UNION ALL SELECT doc_id, 'lower_preserve_punctuation', lower({_KEEP}) FROM documents
UNION ALL SELECT doc_id, 'lower_strip', lower({_STRIP}) FROM documents""")
def b03(spark, d):
    kept = docs(spark, d).select("doc_id", T.nfkc(F.col("text")).alias("text"))
    kept = kept.select("doc_id", T.keep(F.col("text"), False).alias("k"), T.strip_punctuation(F.col("text"), False).alias("s"))
    forms = {
        "keep": F.col("k"), "strip_preserve_case": F.col("s"),
        "lower_preserve_punctuation": F.lower("k"), "lower_strip": F.lower("s"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("regime"), v.alias("out")) for k, v in forms.items()]))
    return kept.select("doc_id", rows.alias("r")).select("doc_id", "r.*")


_BASE = "trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s'']+', ' ', 'g'), '\\s+', ' ', 'g'), ''' ')"


@query("b04_apostrophe_profiles", f"""
SELECT doc_id, 'challenge' AS profile, {_BASE} AS out FROM documents
UNION ALL SELECT doc_id, 'apostrophe_drop', trim(regexp_replace(replace({_BASE}, '''', ''), '\\s+', ' ', 'g')) FROM documents
UNION ALL SELECT doc_id, 'apostrophe_space', trim(regexp_replace(replace({_BASE}, '''', ' '), '\\s+', ' ', 'g')) FROM documents""")
def b04(spark, d):
    rows = [
        F.struct(F.lit(p).alias("profile"), T.apostrophe_profile(F.col("text"), p).alias("out"))
        for p in ("challenge", "apostrophe_drop", "apostrophe_space")
    ]
    return docs(spark, d).select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


def _vowels(c: str) -> str:
    for v in "aeiou":
        c = f"regexp_replace({c}, '(?i)({v}){v}{{2,}}', '\\1', 'g')"
    return f"trim(regexp_replace({c}, ' {{2,}}', ' ', 'g'), ' ')"


@query("b05_ablation_methods", f"""
WITH t AS (SELECT doc_id, replace(text, 'e', 'eee') AS text FROM documents)
SELECT doc_id, 'baseline' AS method, text AS out FROM t
UNION ALL SELECT doc_id, 'A_collapse_spaces', trim(regexp_replace(text, ' {{2,}}', ' ', 'g'), ' ') FROM t
UNION ALL SELECT doc_id, 'B_strip_apostrophes', trim(regexp_replace(regexp_replace(text, '[''’ʼ]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') FROM t
UNION ALL SELECT doc_id, 'C_collapse_elong_vowels', {_vowels('text')} FROM t
UNION ALL SELECT doc_id, 'E_noop', text FROM t""")
def b05(spark, d):
    t = docs(spark, d).select("doc_id", F.replace("text", F.lit("e"), F.lit("eee")).alias("text"))
    rows = [F.struct(F.lit(m).alias("method"), f(F.col("text")).alias("out")) for m, f in T.ABLATIONS.items()]
    return t.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


_STUTTER = """((len(w) >= 3 AND len(list_filter(w, lambda x: length(x) > 1)) = 0)
  OR (len(w) >= 4 AND len(list_distinct(w)) = 1 AND length(w[1]) <= 2)
  OR (len(w) >= 5 AND len(list_filter(w, lambda x: length(x) <= 2))::DOUBLE / len(w) >= 0.85 AND len(list_distinct(w)) <= 3))"""


@query("b06_stutter", f"SELECT id, {_STUTTER} AS stutter FROM noisy")
def b06(spark, d):
    return V.noisy(spark, d).select("id", T.is_stutter(F.col("w")).alias("stutter"))


ORTHO = {"en": {"the": "ze", "and": "und", "th": "thh"}, "fr": {"le": "el", "de": "ed"}, "de": {"und": "and"}}


def _ortho_case() -> str:
    arms = "".join(
        f" WHEN language = '{lang}' THEN CASE x" + "".join(f" WHEN '{a}' THEN '{b}'" for a, b in m.items()) + " ELSE x END"
        for lang, m in ORTHO.items()
    )
    return f"CASE{arms} ELSE x END"


@query("b07_orthography_map", f"SELECT id, array_to_string(list_transform(toks, lambda x: {_ortho_case()}), ' ') AS out FROM utt")
def b07(spark, d):
    u = V.utterances(spark, d, with_tokens=True)
    return u.select("id", F.array_join(T.replace_words(F.col("toks"), F.col("language"), ORTHO), " ").alias("out"))


@query("b08_prefix_split", """
WITH t AS (SELECT id, system, language, string_split(hypothesis, ' ') AS w FROM pairs WHERE hypothesis <> ''),
e AS (SELECT id, system, language, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
r AS (SELECT e.id, e.system, i, CASE WHEN starts_with(x, 'th') AND length(x) >= 5 AND l.n IS NULL AND coalesce(s.n, 0) >= 3
    THEN 'th ' || x[3:] ELSE x END AS y
  FROM e LEFT JOIN lex l ON l.language = e.language AND l.word = x LEFT JOIN lex s ON s.language = e.language AND s.word = x[3:])
SELECT id, system, string_agg(y, ' ' ORDER BY i) AS out FROM r GROUP BY ALL
UNION ALL SELECT id, system, '' FROM pairs WHERE hypothesis = ''""")
def b08(spark, d):
    p = V.pairs(spark, d).select("id", "system", "language", "hypothesis")
    lex = X.lexicon(V.utterances(spark, d))
    return X.split_prefix(p, ["id", "system"], "hypothesis", lex, "language", "th", "out").select("id", "system", "out")


_DEDUPE = """list_filter({0}, lambda x, i: i = 1 OR x <> {0}[i - 1] OR NOT (length(x) <= 3{1}))"""


@query("b09_dedupe_short", f"""
SELECT id, array_to_string(CASE WHEN language = 'en' THEN {_DEDUPE.format('w', " OR x IN ('then', 'than')")}
  ELSE {_DEDUPE.format('w', '')} END, ' ') AS deduped,
  array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ') AS collapsed FROM noisy""")
def b09(spark, d):
    w = F.col("w")
    return V.noisy(spark, d).select(
        "id",
        F.array_join(T.dedupe_short(w, F.col("language"), {"en": ("then", "than")}), " ").alias("deduped"),
        F.array_join(T.collapse_adjacent(w), " ").alias("collapsed"),
    )


JOINS = {"the th": "theth", "e l": "el", "on e": "one"}
SPLITS = {"the": "t he", "les": "l e s"}


@query("b10_join_split_maps", """
WITH j AS (SELECT id, string_split(replace(replace(replace(reference, 'the th', 'theth'), 'on e', 'one'), 'e l', 'el'), ' ') AS w FROM utt)
SELECT id, array_to_string(list_transform(w, lambda x: CASE x WHEN 'the' THEN 't he' WHEN 'les' THEN 'l e s' ELSE x END), ' ') AS out FROM j""")
def b10(spark, d):
    joined = T.join_phrases(F.col("reference"), JOINS)
    return V.utterances(spark, d).select("id", F.array_join(T.split_tokens(T.words(joined), SPLITS), " ").alias("out"))


@query("b11_postprocess", f"""
WITH a AS (SELECT id, language, w, array_to_string(w, ' ') AS raw, list_transform(w, lambda x: {_ortho_case()}) AS m FROM noisy),
b AS (SELECT *, CASE WHEN language = 'en' THEN {_DEDUPE.format('m', " OR x IN ('then', 'than')")} ELSE {_DEDUPE.format('m', '')} END AS dd FROM a),
c AS (SELECT *, string_split(replace(replace(replace(array_to_string(dd, ' '), 'the th', 'theth'), 'on e', 'one'), 'e l', 'el'), ' ') AS j FROM b)
SELECT id, CASE WHEN raw IN ('', '.', 'nan') OR {_STUTTER} THEN '.'
  ELSE array_to_string(list_transform(j, lambda x: CASE x WHEN 'the' THEN 't he' WHEN 'les' THEN 'l e s' ELSE x END), ' ') END AS out FROM c""")
def b11(spark, d):
    t = V.noisy(spark, d).select("id", "language", F.array_join("w", " ").alias("text"))
    return T.with_postprocess(
        t, "text", "language", "out", ortho=ORTHO, function_words={"en": ("then", "than")},
        joins=JOINS, splits=SPLITS, unicode_form=False,
    ).select("id", "out")


_LEXICON_JOIN = """RECURSIVE t AS (SELECT id, language, string_split(broken, ' ') AS w FROM glued),
p AS (SELECT DISTINCT language, w[i] AS a, w[i + 1] AS b FROM (SELECT language, w, unnest(range(1, len(w))) AS i FROM t)),
ok AS (SELECT p.language, p.a, p.b FROM p JOIN lex l ON l.language = p.language AND l.word = p.a || p.b
  LEFT JOIN bigram g ON g.language = p.language AND g.a = p.a AND g.b = p.b
  WHERE {0} AND length(p.a) >= 2 AND length(p.b) >= 2 AND ((l.n >= 3 AND coalesce(g.n, 0) <= 0)
    OR (l.n >= 5 AND coalesce(g.n, 0) <= 1 AND l.n >= 5 * greatest(coalesce(g.n, 0), 1)))),
f AS (SELECT t.id, w, list(ok.a IS NOT NULL ORDER BY i) AS flags FROM
    (SELECT id, language, w, unnest(range(1, len(w) + 1)) AS i FROM t) t
    LEFT JOIN ok ON ok.language = t.language AND ok.a = w[i] AND ok.b = w[i + 1] GROUP BY t.id, w),
s AS (SELECT id, w, flags, 1 AS i, '' AS out FROM f
  UNION ALL
  SELECT id, w, flags, CASE WHEN flags[i] THEN i + 2 ELSE i + 1 END,
    out || CASE WHEN out = '' THEN '' ELSE ' ' END || CASE WHEN flags[i] THEN w[i] || w[i + 1] ELSE w[i] END
  FROM s WHERE i <= len(w))"""


@query("b12_lexicon_join", f"WITH {_LEXICON_JOIN.format('true')} SELECT id, out FROM s WHERE i > len(w)")
def b12(spark, d):
    u = V.utterances(spark, d)
    lex = X.lexicon(u)
    bigrams = C.bigram_counts(u.where("split <> 'test'"), "reference", "language", among=X.joinable(lex, "language"))
    g = V.glued(spark, d).select("id", "language", "broken")
    return X.join_split_words(g, ["id"], "broken", lex, bigrams, "language", "out").select("id", "out")


_ONE_JOIN = _LEXICON_JOIN.format("p.language = 'fr'")


@query("b05_ablation_texts", f"""
WITH {_ONE_JOIN}
SELECT id, 'D_join_splits' AS method, out FROM s WHERE i > len(w)
UNION ALL SELECT id, 'baseline', broken FROM glued
UNION ALL SELECT id, 'A_collapse_spaces', trim(regexp_replace(broken, ' {{2,}}', ' ', 'g'), ' ') FROM glued
UNION ALL SELECT id, 'B_strip_apostrophes', trim(regexp_replace(regexp_replace(broken, '[''’ʼ]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') FROM glued
UNION ALL SELECT id, 'C_collapse_elong_vowels', {_vowels('broken')} FROM glued
UNION ALL SELECT id, 'E_noop', broken FROM glued""")
def b05_texts(spark, d):
    u = V.utterances(spark, d)
    lex = X.lexicon(u)
    bigrams = C.bigram_counts(u.where("split <> 'test'"), "reference", "language", among=X.joinable(lex, "language"))
    g = V.glued(spark, d).select("id", "language", "broken")
    return X.ablations(g, ["id"], "broken", lex, bigrams, "language", "fr")


@query("b13_trailing_filler", """
SELECT id, regexp_replace(reference || CASE n % 3 WHEN 0 THEN ' aa' WHEN 1 THEN ' ee aa ah' ELSE '' END,
  '(^|\\s)(aa|ah|ee|eh)(\\s(aa|ah|ee|eh))*$', '') AS out FROM utt""")
def b13(spark, d):
    tail = F.when(F.col("n") % 3 == 0, " aa").when(F.col("n") % 3 == 1, " ee aa ah").otherwise("")
    return V.utterances(spark, d).select("id", T.strip_trailing(F.concat("reference", tail), fixed.FILLERS).alias("out"))


@query("b14_clean_generation", """
WITH t AS (SELECT id, n, w, list_transform(range(1, len(w) + 1), lambda i: CASE
    WHEN i >= 3 AND w[i] = w[i - 1] AND w[i] = w[i - 2] THEN 1
    WHEN i >= 6 AND w[i - 1 : i] = w[i - 3 : i - 2] AND w[i - 1 : i] = w[i - 5 : i - 4] THEN 2
    WHEN i >= 9 AND w[i - 2 : i] = w[i - 5 : i - 3] AND w[i - 2 : i] = w[i - 8 : i - 6] THEN 3 ELSE 0 END) AS k FROM looped),
u AS (SELECT id, n, w, k, list_position(list_transform(k, lambda x: x > 0), true) AS p FROM t),
c AS (SELECT id, n, CASE WHEN p > 0 THEN w[1 : p - 2 * k[p]] ELSE w END AS w FROM u)
SELECT id, array_to_string(w[1 : greatest(3, floor((n % 20) * 2.2::DOUBLE)::INT + 2)], ' ') AS out FROM c""")
def b14(spark, d):
    t = V.looped(spark, d).select("id", F.array_join("w", " ").alias("text"), (F.col("n") % 20).alias("seconds"))
    return T.with_clean_generation(t, "text", "seconds", "out").select("id", "out")


@query("b15_tail_loop", """
SELECT id, len(w) >= 12 AND w[-3:] = w[-6:-4] AND w[-3:] = w[-9:-7] AND w[-3:] = w[-12:-10] AS looped FROM looped""")
def b15(spark, d):
    return V.looped(spark, d).select("id", T.has_tail_loop(F.col("w")).alias("looped"))


@query("b16_artifact_stats", """
WITH t AS (SELECT id, w, len(string_split(reference, ' ')) AS k,
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' ')) AS g FROM noisy)
SELECT id, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS adjacent, len(g) - len(list_distinct(g)) AS trigrams,
  R6(len(w)::DOUBLE / greatest(1, k)) AS ratio FROM t""")
def b16(spark, d):
    w = F.col("w")
    return V.noisy(spark, d).select(
        "id", T.adjacent_repeats(w).alias("adjacent"), T.repeated_ngrams(w, 3).alias("trigrams"),
        (F.size(w) / F.greatest(T.n_words(F.col("reference")), F.lit(1))).alias("ratio"),
    )


_UNIQUE = "len(list_distinct({0}))::DOUBLE / len({0})"


@query("b17_structure_ok", f"""
WITH t AS (SELECT id, w, string_split(reference, ' ') AS f, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g,
  len(list_filter(w, lambda x: length(x) <= 1)) AS single FROM noisy)
SELECT id, NOT ((len(w) >= 3 AND single = len(w)) OR (len(w) >= 4 AND len(list_distinct(w)) = 1 AND length(w[1]) <= 2)
  OR {_UNIQUE.format('w')} < 0.55 OR (len(w) >= 5 AND single::DOUBLE / len(w) >= 0.7)
  OR length(array_to_string(w, ''))::DOUBLE / len(w) < 2.5
  OR (len(w) >= 8 AND list_max(list_transform(w, lambda x: len(list_filter(w, lambda y: y = x))))::DOUBLE / len(w) > 0.25)
  OR len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > 1
  OR (len(w) >= 8 AND len(list_distinct(g))::DOUBLE / len(g) < 0.55)
  OR {_UNIQUE.format('w')} < {_UNIQUE.format('f')} - 0.15) AS ok FROM t""")
def b17(spark, d):
    return V.noisy(spark, d).withColumn("f", T.words(F.col("reference"))).select(
        "id", T.structure_ok(F.col("w"), F.col("f")).alias("ok")
    )


@query("b18_lexical_stats", """
WITH t AS (SELECT id, system, language, hypothesis AS h, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS w FROM pairs),
k AS (SELECT e.id, e.system, count(*) AS known FROM (SELECT id, system, language, unnest(w) AS word FROM t) e
  JOIN lex l ON l.language = e.language AND l.word = e.word GROUP BY ALL)
SELECT t.id, t.system, len(w) AS words, length(h) AS chars, R6((len(w) - coalesce(known, 0))::DOUBLE / greatest(len(w), 1)) AS oov,
  R6((length(h) - length(replace(h, '''', '')))::DOUBLE / greatest(length(h), 1)) AS apostrophe,
  R6(len(list_distinct(w))::DOUBLE / greatest(len(w), 1)) AS "unique",
  R6(len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))::DOUBLE / greatest(len(w) - 1, 1)) AS repeat
FROM t LEFT JOIN k USING (id, system)""")
def b18(spark, d):
    p = V.pairs(spark, d).select("id", "system", "language", "hypothesis")
    return X.lexical_stats(p, ["id", "system"], "hypothesis", X.lexicon(V.utterances(spark, d)), "language")


def _marker_sql(group: str) -> str:
    doubled = "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz")
    terms = []
    for pattern, weight in fixed.MARKERS[group]:
        source = "t" if "[a-z]" in pattern else "u"
        pattern = doubled if "[a-z]" in pattern else pattern.replace("'", "''")
        terms.append(f"{weight}::DOUBLE * len(regexp_extract_all({source}, '{pattern}'))")
    return "(" + " + ".join(terms) + ") * (100.0::DOUBLE / greatest(length(t), 1))"


@query("b19_marker_scores", f"""
WITH n0 AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents),
n AS (SELECT doc_id, t, regexp_replace(t, '[^\\x00-\\x7Fŋ]', 'q', 'g') AS u FROM n0),
m AS (SELECT doc_id, {_marker_sql('luo')} AS a, {_marker_sql('ach')} AS b, {_marker_sql('lug')} AS c FROM n)
SELECT doc_id, R6(a) AS luo_marker, R6(b) AS ach_marker, R6(c) AS lug_marker, R6(a - b) AS luo_minus_ach FROM m""")
def b19(spark, d):
    n = docs(spark, d).select("doc_id", T.normalize(F.col("text")).alias("t"))
    return n.select("doc_id", *[c.alias(k) for k, c in T.marker_scores(F.col("t")).items()])


@query("b21_plausible_language", """
WITH t AS (SELECT doc_id, trim(text) AS t FROM documents)
SELECT doc_id, length(t) >= 8 AND NOT (length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(t), 1) > 0.85
  AND len(regexp_extract_all(t, '(?i)\\b(the|and|this|that|with|from|audio|test|approving|transcription|english)\\b')) >= 3) AS ok FROM t""")
def b21(spark, d):
    return docs(spark, d).select("doc_id", T.plausible_language(F.col("text")).alias("ok"))


@query("b22_project_alphabet", f"""
WITH n AS (SELECT doc_id, {NORM.format("translate(text, '‘’ʼʻ`´', '''''''''''''')")} AS t FROM documents),
p AS (SELECT doc_id, t, trim(regexp_replace(regexp_replace(t, '[^a-z'' ]', '', 'g'), '\\s+', ' ', 'g')) AS o FROM n)
SELECT doc_id, o AS out, length(regexp_replace(t, '[a-z'' ]', '', 'g')) AS dropped, o <> t AS changed, o <> '' AS eligible FROM p""")
def b22(spark, d):
    n = docs(spark, d).select("doc_id", T.normalize(T.canonical_apostrophes(F.col("text")), unicode_form=False).alias("t"))
    p = n.withColumn("out", T.project_alphabet(F.col("t"), "a-z'"))
    return p.select(
        "doc_id", "out", F.length(F.regexp_replace("t", "[a-z' ]", "")).alias("dropped"),
        (F.col("out") != F.col("t")).alias("changed"), (F.col("out") != "").alias("eligible"),
    )


@query("b22_dropped_characters", f"""
WITH n AS (SELECT lang, {NORM.format("translate(text, '‘’ʼʻ`´', '''''''''''''')")} AS t FROM documents)
SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(regexp_replace(t, '[a-z'' ]', '', 'g'), '')) AS ch FROM n)
WHERE ch <> '' GROUP BY ALL""")
def b22_chars(spark, d):
    n = docs(spark, d).select("lang", T.normalize(T.canonical_apostrophes(F.col("text")), unicode_form=False).alias("t"))
    dropped = F.regexp_replace("t", "[a-z' ]", "")
    return (
        n.where(dropped != "").select("lang", F.explode(F.split(dropped, "")).alias("ch")).where("ch <> ''")
        .groupBy("lang", "ch").agg(F.count("*").alias("n"))
    )


@query("b23_text_profile", """
SELECT lang, count(*) AS rows, count(*) FILTER (regexp_matches(text, '\\p{Lu}')) AS uppercase_rows,
  count(*) FILTER (regexp_matches(text, '\\pP')) AS punctuation_rows, count(*) FILTER (regexp_matches(text, '^\\s|\\s$')) AS edge_space_rows,
  count(*) FILTER (regexp_matches(text, '\\s{2,}')) AS multi_space_rows FROM documents GROUP BY lang""")
def b23(spark, d):
    c = F.col("text")
    return docs(spark, d).groupBy("lang").agg(
        F.count("*").alias("rows"), F.count_if(c.rlike("\\p{Lu}")).alias("uppercase_rows"),
        F.count_if(c.rlike("\\p{P}")).alias("punctuation_rows"), F.count_if(c.rlike("^\\s|\\s\\z")).alias("edge_space_rows"),
        F.count_if(c.rlike("\\s{2,}")).alias("multi_space_rows"),
    )


@query("b23_punctuation_counts", """
SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(regexp_replace(text, '\\PP', '', 'g'), '')) AS ch FROM documents)
WHERE ch <> '' GROUP BY ALL""")
def b23_punctuation(spark, d):
    only = F.regexp_replace("text", "\\P{P}", "")
    return (
        docs(spark, d).where(only != "").select("lang", F.explode(F.split(only, "")).alias("ch")).where("ch <> ''")
        .groupBy("lang", "ch").agg(F.count("*").alias("n"))
    )


@query("b24_placeholder_fill", """
SELECT id, CASE WHEN drop7 NOT IN ('', '.', 'nan', 'null', 'none') THEN drop7
  WHEN swap11 NOT IN ('', '.', 'nan', 'null', 'none') THEN swap11 ELSE '.' END AS out,
  CASE WHEN drop7 NOT IN ('', '.', 'nan', 'null', 'none') THEN drop7 ELSE '.' END AS marked FROM wide""")
def b24(spark, d):
    return V.wide(spark, d).select(
        "id", T.fill_placeholder(F.col("drop7"), F.col("swap11"), unicode_form=False).alias("out"),
        T.fill_placeholder(F.col("drop7"), unicode_form=False).alias("marked"),
    )


@query("b25_label_length", """
SELECT id, len(w) + len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS tokens,
  length(array_to_string(w, ' ')) AS chars
FROM noisy""")
def b25(spark, d):
    return V.noisy(spark, d).select(
        "id", T.label_length(F.col("w")).alias("tokens"), F.length(F.array_join("w", " ")).alias("chars")
    )
