"""Lexicon tables: out-of-vocabulary shares, splits and joins, fuzzy correction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hyplab.functions import text as T
from hyplab.operators import counts as C
from hyplab.operators.sizing import frequent, keep, may_match, sized


def lexicon(index: DataFrame, text: str = "reference", language: str = "language", held_out: str = "test") -> DataFrame:
    """Word counts per language of every row that is not held out; broadcast while it is small."""
    return sized(C.word_counts(index.where(F.col("split") != held_out), text, language))[0]


def looked_up(tokens: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``tokens`` with the columns of a count table (with ``n``), null where it lacks the token.

    Tokens of the frequent words meet a broadcast table where they are; only the few
    others are shuffled, so a frequent word is no hot key.
    """
    hot, rest = frequent(table)
    if rest is None:
        return tokens.join(hot, on, "left")
    return tokens.join(hot, on).unionByName(tokens.join(hot.select(*on), on, "left_anti").join(rest, on, "left"))


def oov_table(df: DataFrame, text: str, lex: DataFrame, language: str, by: str) -> DataFrame:
    """word types, words and mean out-of-vocabulary share per system; ``df`` has one row per text and system.

    A token weighs one over the words of its text, so tokens are summed by type at once and
    the lookup is for types only.
    """
    w = F.col("_w")
    toks = df.select(language, by, T.words(F.col(text)).alias("_w")).select(language, by, F.size(w).alias("_size"), F.posexplode(w).alias("_pos", "word"))
    types = toks.groupBy(by, language, "word").agg(
        F.count("*").alias("words"), F.count_if(F.col("_pos") == 0).alias("_texts"), F.sum(1.0 / F.col("_size")).alias("_weight"))
    known = lex.select(language, "word", F.lit(1).alias("_known"))
    unknown = F.sum(F.when(F.col("_known").isNull(), F.col("_weight")).otherwise(0.0))
    return types.join(known, [language, "word"], "left").groupBy(by).agg(
        F.count("*").alias("types"), F.sum("words").alias("words"), (unknown / F.sum("_texts")).alias("mean_oov"))


def apply_word_map(df: DataFrame, key: list[str], text: str, language: str, mapping: DataFrame, out: str) -> DataFrame:
    """Rewrite words by a (language, word, new) table of any size.

    Only words that the table holds are carried per text; texts without one pass
    through the left join untouched.
    """
    hits = (
        df.select(*key, language, F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))
        .join(mapping.select(language, "word", "new"), [language, "word"])
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("_map"))
    )
    w = T.words(F.col(text))
    rewritten = F.array_join(F.transform(w, lambda x: F.coalesce(F.try_element_at(F.col("_map"), x), x)), " ")
    return df.join(hits, key, "left").withColumn(
        out, F.when(F.col("_map").isNull(), F.col(text)).otherwise(rewritten)
    ).drop("_map")


def split_prefix(
    df: DataFrame, key: list[str], text: str, lex: DataFrame, language: str, prefix: str, out: str,
    min_stem: int = 3, min_count: int = 3,
) -> DataFrame:
    """prefix+stem becomes two words when the whole is unknown and the stem is frequent."""
    n = len(prefix)
    fused = (
        df.select(language, F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))
        .where(F.col("word").startswith(prefix) & (F.length("word") >= n + min_stem))
        .distinct()
        .withColumn("stem", F.expr(f"substr(word, {n + 1})"))
    )
    stems = lex.where(F.col("n") >= min_count).select(language, F.col("word").alias("stem"))
    mapping = (
        fused.join(lex.select(language, "word"), [language, "word"], "left_anti")
        .join(stems, [language, "stem"], "left_semi")
        .select(language, "word", F.concat(F.lit(prefix + " "), "stem").alias("new"))
    )
    return apply_word_map(df, key, text, language, mapping, out)


def joinable(lex: DataFrame, language: str, min_joined: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A filter of word pairs (language, a, b): those whose joined form comes often enough to be joined, and few others."""
    # both rules ask for so many of the joined form
    often, small = sized(lex.where(F.col("n") >= min(min_joined, 5)).select(language, F.col("word").alias("_joined")))

    def among(pairs: DataFrame) -> DataFrame:
        joined, on = pairs.withColumn("_joined", F.concat("a", "b")), [language, "_joined"]
        return (joined.join(often, on, "left_semi") if small else may_match(joined, often, on)).drop("_joined")

    return among


def join_split_words(
    df: DataFrame, key: list[str], text: str, lex: DataFrame, bigrams: DataFrame, language: str, out: str,
    min_joined: int = 3, max_bi: int = 0,
) -> DataFrame:
    """Join adjacent words when the joined form is known and the pair is rare.

    The decision is taken once per distinct pair; only accepted pairs go back to
    the texts, where a left-to-right fold joins them without overlap. Pairs whose joined
    form is unknown are left out before anything is shuffled; ``bigrams`` may lack them, too.
    """
    places = C.exploded_pairs(df, T.words(F.col(text)), *key, language).where((F.length("a") >= 2) & (F.length("b") >= 2))
    places = keep(joinable(lex, language, min_joined)(places))
    pairs = places.select(language, "a", "b").distinct().withColumn("joined", F.concat("a", "b"))
    jc, bc = F.col("_jc"), F.coalesce(F.col("_bc"), F.lit(0))
    accepted, few = sized(
        pairs.join(lex.select(language, F.col("word").alias("joined"), F.col("n").alias("_jc")), [language, "joined"])
        .join(bigrams.select(language, "a", "b", F.col("n").alias("_bc")), [language, "a", "b"], "left")
        .where(((jc >= min_joined) & (bc <= max_bi)) | ((jc >= 5) & (bc <= 1) & (jc >= 5 * F.greatest(bc, F.lit(1)))))
        .select(language, "a", "b")
    )
    on = [language, "a", "b"]
    hits = (
        (places if few else may_match(places, accepted, on))
        .join(accepted, on, "left_semi")
        .groupBy(*key)
        .agg(F.collect_set(F.concat_ws(" ", "a", "b")).alias("_ok"))
    )
    # state: finished words, the pending word, and whether the pending word may still join
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("open")
    )

    def step(s: Column, w: Column) -> Column:
        joins = s["open"] & F.array_contains(F.col("_ok"), F.concat_ws(" ", s["last"], w))
        flushed = F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"])))
        return F.when(
            joins, F.struct(s["done"].alias("done"), F.concat(s["last"], w).alias("last"), F.lit(False).alias("open"))
        ).otherwise(F.struct(flushed.alias("done"), w.alias("last"), F.lit(True).alias("open")))

    folded = F.aggregate(
        T.words(F.col(text)), start, step, lambda s: F.array_join(F.concat(s["done"], F.array(s["last"])), " ")
    )
    return df.join(hits, key, "left").withColumn(
        out, F.when(F.col("_ok").isNull(), F.col(text)).otherwise(folded)
    ).drop("_ok")


def ablations(
    df: DataFrame, key: list[str], text: str, lex: DataFrame, bigrams: DataFrame, language: str, joined_language: str
) -> DataFrame:
    """Every text under each light rewriting: (key, method, out).

    Joining split words reads the counts of one language; texts of the others stay as they are there.
    """
    of_one = lex.where(F.col(language) == joined_language)
    joined = join_split_words(df.select(*key, language, text), key, text, of_one, bigrams, language, "_joined")
    rewritten = {m: f(F.col(text)) for m, f in T.ABLATIONS.items()} | {"D_join_splits": F.coalesce("_joined", F.lit(""))}
    rows = F.array(*[F.struct(F.lit(m).alias("method"), c.alias("out")) for m, c in rewritten.items()])
    return joined.select(*key, F.inline(rows))


def lexical_stats(df: DataFrame, key: list[str], text: str, lex: DataFrame, language: str) -> DataFrame:
    """Words, characters, out-of-vocabulary, apostrophe, unique and repeat shares per text."""
    c, w = F.col(text), F.col("_w")
    split = df.select(*key, language, text, T.words(c).alias("_w"))
    tokens = split.select(*key, language, F.explode(w).alias("word"))
    known = looked_up(tokens, lex.select(language, "word", "n"), [language, "word"]).groupBy(*key).agg(F.count("n").alias("_known"))
    # the shares are taken before the join, so no text is shuffled
    shares = split.select(
        *key,
        F.size(w).alias("words"),
        F.length(c).alias("chars"),
        (F.regexp_count(c, F.lit("'")) / F.greatest(F.length(c), F.lit(1))).alias("apostrophe"),
        T.unique_ratio(w).alias("unique"),
        (T.adjacent_repeats(w) / F.greatest(F.size(w) - 1, F.lit(1))).alias("repeat"),
    )
    oov = (F.col("words") - F.coalesce("_known", F.lit(0))) / F.greatest("words", F.lit(1))
    return shares.join(known, key, "left").select(*key, "words", "chars", oov.alias("oov"), "apostrophe", "unique", "repeat")


# --- E07: fuzzy lexicon correction --------------------------------------------------------

# Tails up to this length are matched by deleted-character variants, longer ones by segments.
_VARIANT_TAIL = 7


def _deletions(t: Column) -> Column:
    """All strings with one character removed."""
    n = F.length(t)
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))),
    ).otherwise(F.array().cast("array<string>"))


def _variant_keys(t: Column, k: int) -> Column:
    """Keys (k, string) of the string and everything within ``k`` deletions: a pair within distance ``k`` shares one."""
    found = [F.array(t)]
    for _ in range(k):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], _deletions))))
    return F.transform(F.array_distinct(F.concat(*found)), lambda x: F.struct(F.lit(k).alias("k"), x.alias("key")))


def _segments(t: Column, parts: int) -> Column:
    """Cut a string in ``parts`` even pieces: keys piece|length|text."""
    n = F.length(t)
    cuts = [F.floor(n * i / parts).cast("int") for i in range(parts + 1)]
    return F.array(
        *[
            F.concat_ws("|", F.lit(i), n, F.substr(t, cuts[i] + 1, cuts[i + 1] - cuts[i]))
            for i in range(parts)
        ]
    )


def _windows(t: Column, parts: int, k: int) -> Column:
    """Pieces of a query that could equal segment i of a word up to k shorter or longer."""
    combos = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i")) for d in range(-k, k + 1) for i in range(parts)])
    shifts = F.array(*[F.lit(x) for x in range(-k, k + 1)])

    def window(c: Column, shift: Column) -> Column:
        size = F.length(t) + c["d"]
        begin = F.floor(size * c["i"] / parts).cast("int")
        width = F.floor(size * (c["i"] + 1) / parts).cast("int") - begin
        start = begin + 1 + shift
        return F.when(
            (start >= 1) & (start + width - 1 <= F.length(t)),
            F.concat_ws("|", c["i"], size, F.substr(t, start, width)),
        )

    every = F.flatten(F.transform(combos, lambda c: F.transform(shifts, lambda s: window(c, s))))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def nearest_words(queries: DataFrame, lex: DataFrame, language: str, max_edit: int = 2) -> DataFrame:
    """Closest lexicon word for every unknown (language, word), exact and without a cap.

    Same first character and a length within k, where k is 0 up to three characters,
    1 up to five, else ``max_edit``. Candidates come from equi-joins on deleted-character
    variants (short words) or on a shared segment (long words), so no task compares a
    whole block of words; the best is a min over (distance, -count, length, word). Keys are
    many times the lexicon, so a broadcast hint on it must not reach them: they are merged.
    """
    k = F.when(F.length("word") <= 3, 0).when(F.length("word") <= 5, min(1, max_edit)).otherwise(min(max_edit, 2))
    q = (
        queries.select(language, "word").distinct()
        .where(~F.col("word").rlike("^[0-9]+$")).withColumn("k", k).where(F.col("k") > 0)
        .withColumns({"first": F.substring("word", 1, 1), "tail": F.expr("substr(word, 2)")})
    )
    words = lex.select(
        language, F.col("word").alias("cand"), "n", F.substring("word", 1, 1).alias("first"), F.expr("substr(word, 2)").alias("_tail")
    )
    short = F.length("tail") <= _VARIANT_TAIL
    # each word goes as deep as its own distance allows; a lexicon word serves the queries of either depth that it can reach
    asked = F.when(F.col("k") == 1, _variant_keys(F.col("tail"), 1)).otherwise(_variant_keys(F.col("tail"), 2))
    size, none = F.length("_tail"), F.array().cast("array<struct<k:int,key:string>>")
    near_one = size.between(2, 5 if max_edit >= 2 else _VARIANT_TAIL + 1)
    near_two = size.between(3, _VARIANT_TAIL + 2) & F.lit(max_edit >= 2)
    offered = F.concat(
        F.when(near_one, _variant_keys(F.col("_tail"), 1)).otherwise(none),
        F.when(near_two, _variant_keys(F.col("_tail"), 2)).otherwise(none),
    )
    by_variant = q.where(short).withColumn("v", F.explode(asked)).select(*q.columns, "v.key").join(
        words.select("*", F.explode(offered).alias("v")).select(*words.columns, "v.k", "v.key").hint("merge"),
        [language, "first", "k", "key"],
    )
    by_segment = q.where(~short).withColumn("key", F.explode(_windows(F.col("tail"), 3, 2))).join(
        words.where(F.length("_tail") >= _VARIANT_TAIL - 2).withColumn("key", F.explode(_segments(F.col("_tail"), 3))).hint("merge"),
        [language, "first", "key"],
    )
    d = F.levenshtein("word", "cand")
    return (
        by_variant.drop("key").unionByName(by_segment.drop("key"))
        .where(F.abs(F.length("word") - F.length("cand")) <= F.col("k"))
        .withColumn("d", d).where(F.col("d") <= F.col("k"))
        .groupBy(language, "word")
        .agg(F.min(F.struct(F.col("d"), (-F.col("n")).alias("neg"), F.length("cand").alias("len"), "cand")).alias("b"))
        .select(language, "word", F.col("b.cand").alias("new"), F.col("b.d").alias("distance"), (-F.col("b.neg")).alias("n"))
    )


def corrections(df: DataFrame, text: str, lex: DataFrame, language: str, max_edit: int = 2) -> DataFrame:
    """Accepted (language, word, new): the new word comes twice or is one edit away."""
    toks = df.select(language, F.explode(T.words(F.col(text))).alias("word")).distinct()
    unknown = toks.join(lex.select(language, "word"), [language, "word"], "left_anti")
    near = nearest_words(keep(unknown), lex, language, max_edit)
    return near.where((F.col("n") >= 2) | (F.col("distance") == 1))
