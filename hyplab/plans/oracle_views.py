"""The derived views as DuckDB SQL; ``views.py`` builds the same rows with Spark."""

FOLD_FROM = "éèêëáàâäíìîïóòôöúùûüñçß"
FOLD_TO = "eeeeaaaaiiiioooouuuuncs"
WIDTH = 12


def edit_select(source: str, ref: str = "reference", hyp: str = "hypothesis", keep: str = "*") -> str:
    """``source`` plus we, ce, nw, nc; tokens become single bytes before the distance."""
    return f"""
    SELECT {keep},
      CASE WHEN r_ = h_ THEN 0 ELSE levenshtein(
        array_to_string(list_transform(rw_, lambda x: chr((32 + list_position(v_, x))::INT)), ''),
        array_to_string(list_transform(hw_, lambda x: chr((32 + list_position(v_, x))::INT)), '')) END::BIGINT AS we,
      CASE WHEN r_ = h_ THEN 0 ELSE levenshtein(r_, h_) END::BIGINT AS ce,
      len(rw_)::BIGINT AS nw, length(r_)::BIGINT AS nc
    FROM (SELECT *, list_distinct(list_concat(rw_, hw_)) AS v_ FROM (
      SELECT *, list_filter(string_split(r_, ' '), lambda x: x <> '') AS rw_,
        list_filter(string_split(h_, ' '), lambda x: x <> '') AS hw_ FROM (
        SELECT *, CASE WHEN {ref} = '' THEN '<empty>' ELSE {ref} END AS r_,
          CASE WHEN {ref} = '' AND {hyp} = '' THEN '<empty>' ELSE {hyp} END AS h_ FROM {source})))
    """


VIEWS: dict[str, str] = {
    "tok": f"""
    SELECT doc_id, source, lang, list_filter(string_split(regexp_replace(
      translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
    FROM documents""",
    "utt": f"""
    SELECT doc_id * 100000 + c AS id, doc_id, doc_id + c AS n, source AS speaker_id, lang AS language,
      CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 IN (1, 2) THEN 'validation' ELSE 'train' END AS split,
      w[c * {WIDTH} + 1 : c * {WIDTH} + {WIDTH}] AS toks,
      array_to_string(w[c * {WIDTH} + 1 : c * {WIDTH} + {WIDTH}], ' ') AS reference
    FROM (SELECT *, unnest(range(0, (len(w) + {WIDTH - 1}) // {WIDTH})) AS c FROM tok WHERE len(w) > 0)""",
    "pairs": """
    SELECT id, doc_id, n, speaker_id, language, split, reference, system, pos,
      array_to_string(hw, ' ') AS hypothesis,
      -((37 * n + 41 * pos) % 100) / 1000.0::DOUBLE AS confidence
    FROM (
      SELECT *, 'drop7' AS system, 0 AS pos, list_filter(toks, lambda x, i: (n + i) % 7 <> 0) AS hw FROM utt
      UNION ALL
      SELECT *, 'swap11', 1, list_transform(toks, lambda x, i: CASE WHEN (3 * n + i) % 11 = 0 THEN reverse(x) ELSE x END) FROM utt
      UNION ALL
      SELECT *, 'dup5', 2, flatten(list_transform(toks, lambda x, i: CASE WHEN (n + i) % 5 = 0 THEN [x, x] ELSE [x] END)) FROM utt)""",
    "hyp": "SELECT id, language, system, pos, hypothesis, confidence FROM pairs",
    "scored": edit_select("pairs", keep="id, doc_id, n, speaker_id, language, split, reference, system, pos, hypothesis, confidence"),
    "wide": """
    SELECT id, n, speaker_id, language, split, reference,
      max(hypothesis) FILTER (system = 'drop7') AS drop7, max(hypothesis) FILTER (system = 'swap11') AS swap11,
      max(hypothesis) FILTER (system = 'dup5') AS dup5,
      max(confidence) FILTER (system = 'drop7') AS conf_drop7, max(confidence) FILTER (system = 'swap11') AS conf_swap11,
      max(confidence) FILTER (system = 'dup5') AS conf_dup5
    FROM pairs GROUP BY ALL""",
    "probs": """
    SELECT id, 1 AS rnk, language AS code, (50 + (13 * n) % 50) / 100.0::DOUBLE AS p FROM utt
    UNION ALL
    SELECT id, 2, CASE language WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' ELSE 'en' END,
      (50 - (13 * n) % 50) / 200.0::DOUBLE FROM utt""",
    "lex": """
    SELECT language, word, count(*) AS n FROM (
      SELECT language, unnest(toks) AS word FROM utt WHERE split <> 'test') GROUP BY ALL""",
    "bigram": """
    SELECT language, a, b, count(*) AS n FROM (
      SELECT language, unnest(list_transform(range(1, len(toks)), lambda i: {'a': toks[i], 'b': toks[i + 1]}), recursive := true)
      FROM utt WHERE split <> 'test') GROUP BY ALL""",
    "scores": """
    SELECT l.doc_id AS id, quality = 1 AS is_pos, d.lang AS language,
      ((29 * l.doc_id) % 1000) / 1000.0::DOUBLE + 0.3::DOUBLE * quality AS score
    FROM labels l JOIN documents d USING (doc_id)""",
    "masses": """
    SELECT doc_id AS id, quality = 1 AS is_pos,
      least((30 + (17 * doc_id) % 40 + 25 * quality) / 100.0::DOUBLE, 0.99::DOUBLE) AS mass_a,
      ((7 * doc_id) % 40) / 100.0::DOUBLE AS mass_b, ((11 * doc_id) % 60) / 100.0::DOUBLE AS mass_c
    FROM labels""",
}

VIEWS["routes"] = """
    SELECT id, n, language, language AS lid_lang, (50 + (13 * n) % 50) / 100.0::DOUBLE AS p1,
      CASE language WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' ELSE 'en' END AS lang2,
      (50 - (13 * n) % 50) / 200.0::DOUBLE AS p2,
      CASE WHEN (7 * n) % 10 < 2 THEN CASE language WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' ELSE 'en' END
        ELSE language END AS decode_lang
    FROM utt"""
VIEWS["glued"] = """
    SELECT id, n, language, split, reference, array_to_string(flatten(list_transform(toks, lambda x, i:
      CASE WHEN (n + i) % 4 = 0 AND length(x) >= 6
        THEN [x[1 : length(x) // 2], x[length(x) // 2 + 1 : length(x)]] ELSE [x] END)), ' ') AS broken
    FROM utt"""
VIEWS["rawutt"] = f"""
    SELECT doc_id * 100000 + c AS id, lang AS language, array_to_string(ws, ' ') AS reference,
      array_to_string(list_transform(ws, lambda x, i: CASE WHEN (doc_id + c + i) % 3 = 0 THEN lower(x)
        WHEN (doc_id + c + i) % 4 = 0 THEN regexp_replace(x, '[^A-Za-z0-9]', '', 'g') ELSE x END), ' ') AS hypothesis
    FROM (SELECT doc_id, lang, c, w[c * {WIDTH} + 1 : c * {WIDTH} + {WIDTH}] AS ws FROM (
      SELECT *, unnest(range(0, (len(w) + {WIDTH - 1}) // {WIDTH})) AS c FROM (
        SELECT doc_id, lang, list_filter(string_split(regexp_replace(translate(text,
          '{FOLD_FROM}' || upper('{FOLD_FROM[:-1]}'), '{FOLD_TO}' || upper('{FOLD_TO[:-1]}')), '\\s+', ' ', 'g'), ' '),
          lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""
VIEWS["noisy"] = """
    SELECT id, n, language, reference, CASE n % 5
      WHEN 0 THEN list_transform(toks, lambda x: x[1:1])
      WHEN 1 THEN list_transform(toks, lambda x: toks[1][1:2])
      WHEN 2 THEN list_transform(toks, lambda x: x[1:2])
      WHEN 3 THEN flatten(list_transform(toks, lambda x: [x, x])) ELSE toks END AS w FROM utt"""
VIEWS["looped"] = """
    SELECT id, n, language, flatten(list_concat([toks], list_transform(range(0, n % 6), lambda i: toks[-3:]))) AS w FROM utt"""
VIEWS["chunk_words"] = f"""
    SELECT conv_id, turn, list_filter(string_split(regexp_replace(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'),
      '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations"""
VIEWS["chunks"] = """
    SELECT c.conv_id, c.turn, list_concat(CASE WHEN c.turn % 4 > 0 AND p.w IS NOT NULL THEN p.w[-(c.turn % 4):] ELSE [] END, c.w) AS w
    FROM chunk_words c LEFT JOIN chunk_words p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"""
