"""Derived views over the given tables: the stand-ins for hypothesis tables.

Utterances are consecutive windows of ``WIDTH`` tokens, so every document is used
in full and no pair is long. Keys carry their own order (``id``), so no view
needs a global sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hyplab.functions.distance import edit_counts
from hyplab.operators.sizing import sized
from hyplab.plans.oracle_views import FOLD_FROM, FOLD_TO, WIDTH
from hyplab.session import spread

SYSTEMS = ("drop7", "swap11", "dup5")

# First place that a system alters, then every seventh, eleventh or fifth; a window without a number has none.
_FIRST = {"_drop": "int(pmod(-(n + 1), 7))", "_swap": "int(pmod(-(3 * n + 1), 11))", "_dup": "int(pmod(-(n + 1), 5))"}
# Windows of up to twelve tokens are put together from slices: no function runs once per token.
_reversed = lambda i: f"if({i} < size(toks), array(reverse(get(toks, {i}))), array())"
_HYPOTHESIS = {
    "drop7": "if(n is null, array(), concat(slice(toks, 1, _drop), slice(toks, _drop + 2, 6), slice(toks, _drop + 9, 6)))",
    "swap11": f"if(n is null, toks, concat(slice(toks, 1, _swap), {_reversed('_swap')}, slice(toks, _swap + 2, 10), {_reversed('_swap + 11')}))",
    "dup5": "if(n is null, toks, concat(slice(toks, 1, _dup + 1), slice(toks, _dup + 1, 6), slice(toks, _dup + 6, 6), slice(toks, _dup + 11, 6)))",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang and the token array of the whole text."""
    docs = table(spark, d, "documents") if docs is None else docs
    docs = spread(docs.select("doc_id", "source", "lang", "text"), "doc_id")
    low = F.col("_low")  # a column of its own, so that it is made once
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))  # ASCII has no accents
    w = F.array_remove(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), "")
    return docs.withColumn("_low", F.lower("text")).select("doc_id", "source", "lang", w.alias("w"))


def utterances(spark: SparkSession, d: str, with_tokens: bool = False, docs: DataFrame | None = None) -> DataFrame:
    windows = F.expr(f"transform(sequence(0, (size(w) - 1) div {WIDTH}), c -> slice(w, int(c * {WIDTH} + 1), {WIDTH}))")
    out = (
        tokens(spark, d, docs)
        .select("doc_id", "source", "lang", F.posexplode(windows).alias("c", "toks"))
        .where(F.size("toks") > 0)
        .select(
            (F.col("doc_id") * 100000 + F.col("c")).alias("id"),
            "doc_id",
            (F.col("doc_id") + F.col("c")).alias("n"),
            F.col("source").alias("speaker_id"),
            F.col("lang").alias("language"),
            F.when(F.col("doc_id") % 10 == 0, "test")
            .when((F.col("doc_id") % 10).isin(1, 2), "validation")
            .otherwise("train")
            .alias("split"),
            "toks",
            F.array_join("toks", " ").alias("reference"),
        )
    )
    return out if with_tokens else out.drop("toks")


def pairs(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Long table of (id, system) with reference, hypothesis and confidence."""
    system = F.explode(F.array(*[
        F.struct(F.lit(name).alias("system"), F.lit(k).alias("pos"), F.array_join(F.expr(hw), " ").alias("hypothesis"))
        for k, (name, hw) in enumerate(_HYPOTHESIS.items())
    ]))
    return (
        utterances(spark, d, with_tokens=True, docs=docs)
        .withColumns({k: F.expr(e) for k, e in _FIRST.items()})
        .select("id", "doc_id", "n", "speaker_id", "language", "split", "reference", system.alias("s"))
        .select(
            "id", "doc_id", "n", "speaker_id", "language", "split", "reference",
            F.col("s.system").alias("system"),
            F.col("s.pos").alias("pos"),
            F.col("s.hypothesis").alias("hypothesis"),
            (-((37 * F.col("n") + 41 * F.col("s.pos")) % 100) / 1000.0).alias("confidence"),
        )
    )


def hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("id", "language", "system", "pos", "hypothesis", "confidence")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """``pairs`` with edit counts; narrow, no shuffle."""
    return edit_counts(pairs(spark, d))


def wide(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per id with a column per system (text) and conf_<system>."""
    return utterances(spark, d, with_tokens=True, docs=docs).withColumns({k: F.expr(e) for k, e in _FIRST.items()}).select(
        "id", "n", "speaker_id", "language", "split", "reference",
        *[F.array_join(F.expr(e), " ").alias(s) for s, e in _HYPOTHESIS.items()],
        *[(-((37 * F.col("n") + 41 * k) % 100) / 1000.0).alias(f"conf_{s}") for k, s in enumerate(SYSTEMS)],
    )


def distinct(spark: SparkSession, d: str, view: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """Distinct rows of ``pairs`` or ``wide``, with their key among the columns.

    A document whose doc_id comes once cannot give a row twice, so only rows of the others are shuffled.
    """
    docs = table(spark, d, "documents")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null").select("doc_id")
    again, _ = sized(again)
    if not again.count():
        return view(spark, d).select(*columns)
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    of = lambda how: view(spark, d, docs=docs.join(again, same, how)).select(*columns)
    return of("left_anti").unionByName(of("left_semi").distinct())


def probs(spark: SparkSession, d: str) -> DataFrame:
    """Class probabilities, two ranks per id."""
    other = (
        F.when(F.col("language") == "en", "fr").when(F.col("language") == "fr", "de")
        .when(F.col("language") == "de", "es").otherwise("en")
    )
    turn = (13 * F.col("n")) % 50
    ranks = F.explode(
        F.array(
            F.struct(F.lit(1).alias("rnk"), F.col("language").alias("code"), ((50 + turn) / 100.0).alias("p")),
            F.struct(F.lit(2).alias("rnk"), other.alias("code"), ((50 - turn) / 200.0).alias("p")),
        )
    )
    return utterances(spark, d).select("id", ranks.alias("r")).select("id", "r.rnk", "r.code", "r.p")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled scores: id, is_pos, language, score."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"))
    return (
        table(spark, d, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            (F.col("quality") == 1).alias("is_pos"),
            "language",
            ((29 * F.col("doc_id") % 1000) / 1000.0 + 0.3 * F.col("quality")).alias("score"),
        )
    )


def masses(spark: SparkSession, d: str) -> DataFrame:
    """Labelled class masses: id, is_pos, mass_a, mass_b, mass_c."""
    k = F.col("doc_id")
    return table(spark, d, "labels").select(
        k.alias("id"),
        (F.col("quality") == 1).alias("is_pos"),
        F.least((30 + (17 * k) % 40 + 25 * F.col("quality")) / 100.0, F.lit(0.99)).alias("mass_a"),
        ((7 * k) % 40 / 100.0).alias("mass_b"),
        ((11 * k) % 60 / 100.0).alias("mass_c"),
    )


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Detected language with probability, runner-up and the language a row was decoded in."""
    other = (
        F.when(F.col("language") == "en", "fr").when(F.col("language") == "fr", "de")
        .when(F.col("language") == "de", "es").otherwise("en")
    )
    turn = (13 * F.col("n")) % 50
    return utterances(spark, d).select(
        "id", "n", "language", F.col("language").alias("lid_lang"), ((50 + turn) / 100.0).alias("p1"),
        other.alias("lang2"), ((50 - turn) / 200.0).alias("p2"),
        F.when((7 * F.col("n")) % 10 < 2, other).otherwise(F.col("language")).alias("decode_lang"),
    )


def glued(spark: SparkSession, d: str) -> DataFrame:
    """References and a version with some words broken in two."""
    broken = F.expr(
        """flatten(transform(toks, (x, i) -> if((n + i + 1) % 4 = 0 and length(x) >= 6,
            array(substr(x, 1, length(x) div 2), substr(x, length(x) div 2 + 1)), array(x))))"""
    )
    return utterances(spark, d, with_tokens=True).select(
        "id", "n", "language", "split", "reference", F.array_join(broken, " ").alias("broken")
    )


def raw_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Windows of raw tokens with case and punctuation, and a degraded copy."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    upper_from, upper_to = FOLD_FROM[:-1].upper(), FOLD_TO[:-1].upper()
    folded = F.translate("text", FOLD_FROM + upper_from, FOLD_TO + upper_to)
    w = F.filter(F.split(F.regexp_replace(folded, "\\s+", " "), " "), lambda x: x != "")
    windows = F.expr(f"transform(sequence(0, (size(w) - 1) div {WIDTH}), c -> slice(w, int(c * {WIDTH} + 1), {WIDTH}))")
    hyp = F.expr(
        """transform(ws, (x, i) -> case when (doc_id + c + i + 1) % 3 = 0 then lower(x)
            when (doc_id + c + i + 1) % 4 = 0 then regexp_replace(x, '[^A-Za-z0-9]', '') else x end)"""
    )
    return (
        docs.select("doc_id", "lang", w.alias("w"))
        .select("doc_id", "lang", F.posexplode(windows).alias("c", "ws"))
        .where(F.size("ws") > 0)
        .select(
            (F.col("doc_id") * 100000 + F.col("c")).alias("id"), F.col("lang").alias("language"),
            F.array_join("ws", " ").alias("reference"), F.array_join(hyp, " ").alias("hypothesis"),
        )
    )


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Token arrays (w) with single letters, one repeated token, short tokens and doubled tokens."""
    w = F.expr(
        """case n % 5 when 0 then transform(toks, x -> left(x, 1))
            when 1 then transform(toks, x -> left(toks[0], 2))
            when 2 then transform(toks, x -> left(x, 2))
            when 3 then flatten(transform(toks, x -> array(x, x))) else toks end"""
    )
    return utterances(spark, d, with_tokens=True).select("id", "n", "language", "reference", w.alias("w"))


def looped(spark: SparkSession, d: str) -> DataFrame:
    """Token arrays whose last three tokens come up to five times more."""
    w = F.expr("concat(toks, flatten(array_repeat(slice(toks, greatest(-3, -size(toks)), 3), int(n % 6))))")
    return utterances(spark, d, with_tokens=True).select("id", "n", "language", w.alias("w"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns that begin with up to three last words of the turn before: (conv_id, turn, text)."""
    folded = F.translate(F.lower("text"), FOLD_FROM, FOLD_TO)
    w = F.filter(F.split(F.regexp_replace(folded, "[^a-z0-9]+", " "), " "), lambda x: x != "")
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id").select("conv_id", "turn", w.alias("w"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("p"))
    k = (F.col("turn") % 4).cast("int")
    tail = F.when((k > 0) & F.col("p").isNotNull(), F.slice("p", F.greatest(F.size("p") - k + 1, F.lit(1)), k)).otherwise(
        F.array().cast("array<string>")
    )
    return turns.join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.array_join(F.concat(tail, "w"), " ").alias("text"))
