"""Fusion and selection over hypothesis tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from hyplab.functions import distance as D, fixed, kernels as K, text as T
from hyplab.operators import ordering as O, score as S
from hyplab.operators.counts import END, START
from hyplab.operators.sizing import cut, keep


def fuse_two(
    first: Column, second: Column, first_score: Column, decode_lang: Column, lid: Column, p1: Column, *,
    open_set: str = "luo", open_p: float = 0.55, floor: float = -0.12, strong_p: float = 0.9,
    domain: Sequence[str] = fixed.DOMAIN_LANGUAGES,
) -> Column:
    """Pick one of two families; struct(text, source, reason). Texts are normalised."""
    pick = lambda text, source, reason: F.struct(
        text.alias("text"), F.lit(source).alias("source"), F.lit(reason).alias("reason")
    )
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    weak = F.coalesce(first_score < floor, F.lit(False))
    return (
        F.when(empty(first) & empty(second), pick(F.lit("."), "empty_fallback", "both_empty"))
        .when(empty(second), pick(first, "first", "second_empty"))
        .when(empty(first), pick(second, "second", "first_empty"))
        .when((F.lower(lid) == open_set) & F.coalesce(p1 >= open_p, F.lit(False)), pick(second, "second", "open_set"))
        .when(weak, pick(second, "second", "first_weak"))
        .when(F.lower(decode_lang).isin(*domain) & F.coalesce(p1 >= strong_p, F.lit(False)), pick(first, "first", "domain_strong"))
        .otherwise(pick(first, "first", "default_first"))
    )


def overlay(floor: DataFrame, replaces: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Floor texts with keyed replacements; blank ones are skipped, an unknown id is an error, the last by ``order`` wins."""
    new = F.trim(F.coalesce(F.col(text), F.lit("")))
    r = replaces.where(new != "").groupBy(key).agg(F.max_by(new, order).alias("_new"))
    unknown = F.raise_error(F.concat(F.lit("replacement for unknown id "), F.col(key).cast("string"))).cast("string")
    base = floor.select(key, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("_old"), F.lit(True).alias("_in"))
    old = F.when(F.col("_old") == "", ".").otherwise(F.col("_old"))
    j = base.join(r, key, "full_outer")
    return j.select(
        key, F.when(F.col("_in").isNull(), unknown).otherwise(F.coalesce("_new", old)).alias(text),
        (F.coalesce("_new", old) != old).alias("changed"),
    )


def layered(floor: DataFrame, layers: DataFrame, key: str, text: str) -> DataFrame:
    """One row per (id, layer) with the text before and after; ``layers`` has (id, layer, text).

    Every layer that applies sets the text, so the state before a layer is the layer
    under it: a lag over the few layers of an id.
    """
    clean = F.trim(F.coalesce(F.col(text), F.lit("")))
    rows = floor.select(key, F.lit(0).alias("layer"), F.when(clean == "", ".").otherwise(clean).alias(text)).unionByName(
        layers.select(key, "layer", F.when(clean == "", ".").otherwise(clean).alias(text))
    )
    w = W.partitionBy(key).orderBy("layer")
    return rows.select(key, "layer", F.lag(text).over(w).alias("before"), F.col(text).alias("after")).withColumn(
        "changed", F.col("before").isNotNull() & (F.col("before") != F.col("after"))
    )


def consensus(hyps: DataFrame, floor: DataFrame, agree: float = 0.12, min_systems: int = 2, near_floor: float = 0.08,
              ratio: tuple[float, float] = (0.65, 1.45)) -> DataFrame:
    """Largest cluster around a seed, its longest text, and what becomes of it against the floor.

    status: no_agree, agree_with_floor, length_reject or replaced.
    """
    text = F.when(F.coalesce("hypothesis", F.lit("")) == "", ".").otherwise(F.col("hypothesis"))
    each = hyps.where("id IS NOT NULL").select("id", F.struct("pos", text.alias("text"), T.n_words(text).alias("words")).alias("_x"))
    # the texts of an id meet in one row, so a text is shuffled once
    placed = F.transform("_h", lambda h, i: F.struct(i.alias("i"), h["pos"].alias("pos"), h["text"].alias("text"), h["words"].alias("words")))
    of_id = each.groupBy("id").agg(F.collect_list("_x").alias("_h")).select("id", placed.alias("_h"))
    two = lambda x, y: F.struct(x["i"].alias("i"), y["i"].alias("j"), x["text"].alias("a"), y["text"].alias("b"))
    every = F.flatten(F.transform("_h", lambda x: F.transform(F.filter("_h", lambda y: x["i"] < y["i"]), lambda y: two(x, y))))
    alike = F.filter(
        F.zip_with("_p", "_e", lambda p, e: F.struct(p["i"].alias("i"), p["j"].alias("j"), (e <= agree).alias("near"))), lambda p: p["near"])
    found = D.with_pair_errors(of_id.withColumn("_p", every), "_e", "_p").select("id", "_h", alike.alias("_n"))

    def near(x: Column, y: Column) -> Column:
        i, j = F.least(x["i"], y["i"]), F.greatest(x["i"], y["i"])
        return (x["pos"] == y["pos"]) | ((i == j) & F.lit(agree >= 0)) | F.exists("_n", lambda n: (n["i"] == i) & (n["j"] == j))

    def ranked(x: Column, y: Column) -> Column:
        # cluster order: the seed, then the others in candidate order
        place = F.when(x["pos"] == y["pos"], 0).otherwise(y["pos"] + 1)
        return F.struct(y["words"].alias("words"), F.length(y["text"]).alias("size"), (-place).alias("place"), y["text"].alias("text"))

    def cluster(pos: Column) -> Column:
        seeds = F.filter("_h", lambda x: x["pos"].eqNullSafe(pos))
        members = F.flatten(F.transform(seeds, lambda x: F.transform(F.filter("_h", lambda y: near(x, y)), lambda y: ranked(x, y))))
        return F.struct(F.size(members).cast("long").alias("n_agree"), (-pos).alias("place"), F.array_max(members)["text"].alias("text"))

    clusters = F.transform(F.array_distinct(F.transform("_h", lambda x: x["pos"])), cluster)
    best = found.select("id", F.array_max(F.filter(clusters, lambda c: c["n_agree"] > 0)).alias("b")).where("b IS NOT NULL").select(
        "id", F.struct("b.n_agree", "b.text").alias("b"))
    j = best.select("id", "b.*").join(floor.select("id", F.col("hypothesis").alias("_floor")), "id")
    words = T.n_words(F.col("text")) / F.greatest(T.n_words(F.col("_floor")), F.lit(1))
    status = (
        F.when(F.col("n_agree") < min_systems, "no_agree")
        .when(D.pair_error(F.col("text"), F.col("_floor")) < near_floor, "agree_with_floor")
        .when((T.n_words(F.col("_floor")) > 0) & ~words.between(*ratio), "length_reject")
        .otherwise("replaced")
    )
    return j.select("id", "n_agree", "text", status.alias("status"))


def plurality(hyps: DataFrame) -> DataFrame:
    """Majority word per position; ties and lone votes go to the first system that has a word."""
    # one array per system: as many as there are systems of an id
    per_id = hyps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", T.words(F.col("hypothesis")).alias("w")))).alias("h"))
    longest = F.array_max(F.transform("h", lambda s: F.size(s["w"])))

    def winner(i: Column) -> Column:
        votes = F.filter(F.transform("h", lambda s: F.get(s["w"], i)), lambda x: x.isNotNull())
        ranked = F.transform(
            votes, lambda v: F.struct((-F.size(F.filter(votes, lambda y: y == v))).alias("n"), F.array_position(votes, v).alias("p"), v.alias("v"))
        )
        return F.array_min(ranked)["v"]

    out = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), winner), " ")
    return per_id.withColumn("_n", longest).select("id", F.when(F.col("_n") == 0, ".").otherwise(out).alias("text"))


# --- M07: lattice fusion ------------------------------------------------------------------

_STEPS = ArrayType(StructType([StructField("a", StringType()), StructField("b", StringType())]))


@F.pandas_udf(_STEPS)
def _transitions(slots: pd.Series) -> pd.Series:
    """Word pairs that can follow each other on some path through the slots."""

    def pairs(slots) -> list[dict[str, str]]:
        seen: dict[tuple[str, str], None] = {}
        ends = {START}
        for slot in slots:
            words = {w for w in (slot["ref"], slot["hyp"]) if w is not None}
            seen.update({(e, w): None for w in sorted(words) for e in sorted(ends)})
            ends = words | ends if slot["op"] in "DI" else words
        return [{"a": a, "b": b} for a, b in seen]

    return pd.Series([pairs(x) for x in slots])


def _best_path(lm_weight: float, first_bias: float, deletion: float):
    """Exact best path: under a bigram model a path's future depends on its last word only,
    so each slot keeps the best way to every last word."""

    @F.pandas_udf(StringType())
    def kernel(slots: pd.Series, steps: pd.Series) -> pd.Series:
        def solve(slots, lm) -> str:
            logp = {(s["a"], s["b"]): s["lp"] for s in lm} if lm is not None else {}
            best = {START: (0.0, None)}  # last word -> value and chain of words, newest first
            for slot in slots:
                ways: dict[str, tuple[float, tuple | None]] = {}

                def offer(end: str, value: float, chain) -> None:
                    if end not in ways or value > ways[end][0]:
                        ways[end] = (value, chain)

                options = {slot["ref"]: 0.0} if slot["op"] == "C" else {slot["ref"]: first_bias, slot["hyp"]: 0.0}
                for word, bias in options.items():
                    for end, (value, chain) in best.items():
                        if word is None:
                            offer(end, value + bias + deletion, chain)
                        else:
                            offer(word, value + bias + lm_weight * logp[(end, word)], (word, chain))
                best = ways
            chain, words = max(best.values(), key=lambda way: way[0])[1], []
            while chain is not None:
                words.append(chain[0])
                chain = chain[1]
            return " ".join(reversed(words)) or "."

        return pd.Series([solve(*row) for row in zip(slots, steps)])

    return kernel


def lattice_fusion(
    df: DataFrame, key: str, first: str, second: str, bigrams: DataFrame, unigrams: DataFrame, language: str = "language", *,
    lm_weight: float = 0.3, first_bias: float = 0.2, deletion: float = -0.4, smoothing: float = 0.1,
) -> DataFrame:
    """Best path through the alignment of two texts under a bigram model.

    The model is never shipped to the kernel. The distinct word pairs that some path
    uses are scored against the count tables first, so a frequent pair meets them once;
    the kernel gets the scores of its own row.
    """
    f, s = F.col(first), F.col(second)
    differ = df.where(f != s).select(key, language, K.alignment(f, s, True).alias("_slots")).withColumn("_p", _transitions("_slots"))
    vocab = unigrams.where(~F.col("word").isin(START, END)).groupBy(language).agg(F.greatest(F.count("*"), F.lit(2)).alias("_v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lp = F.log10((zero("n") + smoothing) / F.greatest(F.lit(smoothing), zero("_u") + smoothing * F.col("_v")))
    each = differ.select(key, language, F.inline("_p"))
    scored = (
        each.select(language, "a", "b").distinct()
        .join(bigrams, [language, "a", "b"], "left")
        .join(unigrams.select(language, F.col("word").alias("a"), F.col("n").alias("_u")), [language, "a"], "left")
        .join(F.broadcast(vocab), language)
        .select(language, "a", "b", lp.alias("lp"))
    )
    steps = each.join(scored, [language, "a", "b"]).groupBy(key).agg(F.collect_list(F.struct("a", "b", "lp")).alias("_steps"))
    kernel = _best_path(lm_weight, first_bias, deletion)
    fused = differ.join(steps, key, "left").select(key, kernel("_slots", "_steps").alias("fused"))
    return df.join(fused, key, "left").select(
        key, F.coalesce("fused", F.when(f == "", ".").otherwise(f)).alias("fused")
    )


# --- M04: word merge ----------------------------------------------------------------------


def word_merge(floor: Column, other: Column, ops: Column, *, min_similarity: float = 0.72, max_edits: int | None = None,
               allow_insert: bool = False, allow_delete: bool = False) -> Column:
    """The floor with single words taken from the other text, along their word alignment ``ops`` (floor first).

    A substituted word is taken when both forms are similar enough, the first
    ``max_edits`` of them; inserted and deleted words follow the other text only where allowed.
    An empty text or '.' gives way to the other one.
    """
    alike = lambda o: 1.0 - F.levenshtein(o["ref"], o["hyp"]) / F.greatest(F.length(o["ref"]), F.length(o["hyp"])) >= min_similarity
    close = lambda o: (o["op"] == "S") & alike(o)

    def step(acc: Column, o: Column) -> Column:
        take = close(o) & (acc["edits"] < F.lit(max_edits if max_edits is not None else 2**31 - 1))
        word = (
            F.when(o["op"] == "I", o["hyp"] if allow_insert else F.lit(None).cast("string"))
            .when(o["op"] == "D", F.lit(None).cast("string") if allow_delete else o["ref"])
            .when(take, o["hyp"]).otherwise(o["ref"])
        )
        words = F.when(word.isNull(), acc["words"]).otherwise(F.concat(acc["words"], F.array(word)))
        return F.struct((acc["edits"] + take.cast("int")).alias("edits"), words.alias("words"))

    start = F.struct(F.lit(0).alias("edits"), F.array().cast("array<string>").alias("words"))
    merged = F.array_join(F.aggregate(ops, start, step)["words"], " ")
    empty = lambda c: (c == "") | (c == ".")
    return (
        F.when(empty(other), F.when(floor == "", ".").otherwise(floor)).when(empty(floor), other)
        .when(merged == "", floor).otherwise(merged)
    )


# --- similarity-driven selection ----------------------------------------------------------


def medoid(hyps: DataFrame, incumbent: str) -> DataFrame:
    """The observed text with the least disagreement; ties go to the incumbent, then to the first.

    The texts of an id meet in one row, so a text is shuffled once; rows without an id are compared with nothing.
    """
    text = F.when(F.coalesce("hypothesis", F.lit("")) == "", ".").otherwise(F.col("hypothesis"))
    each = hyps.select("id", "pos", (F.col("system") == incumbent).cast("int").alias("inc"), text.alias("text"))
    row = F.struct("text", "pos", "inc")
    texts = F.transform(F.array_distinct(F.transform("_h", lambda h: h["text"])), _summed_up)
    of_id = each.where("id IS NOT NULL").groupBy("id").agg(F.collect_list(row).alias("_h")).select("id", texts.alias("_t"))
    # every two texts of different places, in one order
    two = lambda x, i, y, j: F.struct(
        i.alias("i"), j.alias("j"), x["pos"].alias("p"), y["pos"].alias("q"), F.trim(x["text"]).alias("a"), F.trim(y["text"]).alias("b"))
    every = F.flatten(F.transform("_t", lambda x, i: F.transform("_t", lambda y, j: two(x, i, y, j))))
    met = of_id.withColumn("_p", F.filter(every, lambda p: (p["i"] < p["j"]) & (p["p"] != p["q"])))
    found = D.with_pair_errors(met, "_e", "_p").withColumn(
        "_d", F.zip_with("_p", "_e", lambda p, e: F.struct(p["i"].alias("i"), p["j"].alias("j"), (1.0 - (1.0 - e)).alias("d"))))

    def cost(t: Column, i: Column) -> Column:
        own = F.filter("_d", lambda d: (d["i"] == i) | (d["j"] == i))
        total = F.aggregate(own, F.lit(0.0), lambda acc, d: acc + d["d"])
        return F.struct(
            (F.size("_d") > 0).cast("int").alias("met"), F.size(own).alias("n"), F.round(total, 9).alias("r"), (-t["inc"]).alias("inc"),
            t["pos"].alias("pos"), t["text"].alias("text"), total.alias("cost"))

    # a text that meets no other counts only where none does
    costs = F.filter(F.transform("_t", cost), lambda c: (c["met"] == 0) | (c["n"] > 0))
    least = F.array_min(F.transform(costs, lambda c: F.struct(c["r"].alias("r"), c["inc"].alias("inc"), c["pos"].alias("pos"), c["text"].alias("text"), c["cost"].alias("cost"))))
    alone = each.where("id IS NULL").groupBy("id", "text").agg(F.min("pos").alias("pos"), F.max("inc").alias("inc")).groupBy("id").agg(
        F.min_by(F.struct("text", F.lit(0.0).alias("cost")), F.struct(-F.col("inc"), F.col("pos"))).alias("b"))
    return found.select("id", least.alias("b")).select("id", "b.text", "b.cost").unionByName(alone.select("id", "b.*"))


def _summed_up(text: Column) -> Column:
    own = F.filter("_h", lambda h: h["text"] == text)
    return F.struct(
        text.alias("text"), F.array_min(F.transform(own, lambda h: h["pos"])).alias("pos"), F.array_max(F.transform(own, lambda h: h["inc"])).alias("inc"))


def similarity_tiers(df: DataFrame, key: str, base: str, challenger: str, helper: str, tiers: Sequence[float]) -> DataFrame:
    """Texts under every similarity tier, the exact-consensus tier and the full tier."""
    b, c = F.col(base), F.col(challenger)
    staged = df.where(c != "").withColumn("_s", D.similarity(b, c))
    rows = [F.struct(F.lit(f"sim{round(t * 100)}").alias("tier"), (F.col("_s") >= t).alias("take")) for t in tiers]
    rows += [
        F.struct(F.lit("consensus").alias("tier"), (c == F.col(helper)).alias("take")),
        F.struct(F.lit("full").alias("tier"), F.lit(True).alias("take")),
    ]
    return staged.select("*", F.inline(F.array(*rows))).select(
        key, "tier", F.when(F.col("take"), c).otherwise(b).alias("text"), (F.col("take") & (c != b)).alias("changed")
    )


def exact_agreement(base: Column, a: Column, b: Column) -> Column:
    """The challengers agree exactly and differ from the base."""
    return (a == b) & (a != base)


def support_select(df: DataFrame, key: str, base: str, challenger: str, helpers: Sequence[tuple[str, float]],
                   closer: Sequence[tuple[str, float]], length: tuple[float, float]) -> DataFrame:
    """The challenger needs a minimum similarity to some helpers, to be closer to others
    than the base (by a margin), and a length band."""
    sim = D.similarity
    b, c = F.col(base), F.col(challenger)
    ok = D.word_ratio(c, b).between(*length)
    for helper, least in helpers:
        ok = ok & (sim(c, F.col(helper)) >= least)
    for helper, margin in closer:
        ok = ok & (sim(c, F.col(helper)) >= sim(b, F.col(helper)) + margin)
    return df.select(key, ok.alias("take")).join(df.select(key, base, challenger), key).select(
        key, "take", F.when(F.col("take"), c).otherwise(b).alias("text")
    )


def agreement_modes(df: DataFrame, key: str, a: str, b: str, c: str, p: str, frozen: DataFrame, limit: float, min_p: float) -> DataFrame:
    """Acceptance under the four modes: a-c, b-c, two of three pairs, all three; frozen ids stay out."""
    err = lambda x, y: D.pair_error(F.col(x), F.col(y)) <= limit
    sure = F.col(p) >= min_p
    pool = df.join(frozen.select(key), key, "left_anti").withColumns({"_ab": err(a, b), "_ac": err(a, c), "_bc": err(b, c)})
    pairs = sum((F.col(x).cast("int") for x in ("_ab", "_ac", "_bc")), F.lit(0))
    rows = F.array(
        F.struct(F.lit("a_c").alias("mode"), (F.col("_ac") & sure).alias("take"), F.col(a).alias("text")),
        F.struct(F.lit("b_c").alias("mode"), (F.col("_bc") & sure).alias("take"), F.col(c).alias("text")),
        F.struct(F.lit("two_of_three").alias("mode"), ((pairs >= 2) & sure).alias("take"), F.col(a).alias("text")),
        F.struct(F.lit("all_three").alias("mode"), ((pairs == 3) & sure).alias("take"), F.col(a).alias("text")),
    )
    return pool.select(key, F.inline(rows)).where("take").drop("take")


def word_op_policies(df: DataFrame, key: str, base: str, challenger: str, helper: str, sure: float = 0.99) -> DataFrame:
    """Challenger at near-equality, else helper under guards on word operations; one row per policy."""
    b, x, m = F.col(base), F.col(challenger), F.col(helper)
    ops = lambda left, right: K.alignment(left, right)
    n = lambda col, op: F.size(F.filter(F.col(col), lambda o: o["op"] == op))
    staged = df.where((x != "") & (x != b)).withColumns(
        {"_sb": D.similarity(b, x), "_sx": D.similarity(x, m), "_bm": ops(b, m), "_bx": ops(b, x), "_mx": ops(m, x)}
    )
    wrong = lambda col: n(col, "S") + n(col, "I") + n(col, "D")
    same_count = T.n_words(b) == T.n_words(m)
    no_shift = (n("_bm", "I") == 0) & (n("_bm", "D") == 0)
    guards = {
        "agree99": (0.99, F.lit(True)), "agree98": (0.98, F.lit(True)), "agree95": (0.95, F.lit(True)), "agree90": (0.90, F.lit(True)),
        "agree95_wordeq": (0.95, same_count),
        "agree95_noinsdel": (0.95, no_shift),
        "agree95_noinsdel_sub2": (0.95, no_shift & (n("_bm", "S") <= 2)),
        "agree95_samecount_closer": (0.95, same_count & (wrong("_mx") < wrong("_bx"))),
        "agree95_xm_noinsdel_dist2": (0.95, (n("_mx", "I") == 0) & (n("_mx", "D") == 0) & (wrong("_mx") <= 2)),
    }
    rows = [
        F.struct(
            F.lit(name).alias("policy"),
            F.when(F.col("_sb") >= sure, "challenger").when((F.col("_sx") >= t) & g, "helper").otherwise("base").alias("source"),
        )
        for name, (t, g) in guards.items()
    ]
    return staged.select(key, base, challenger, helper, F.inline(F.array(*rows))).select(
        key, "policy", "source",
        F.when(F.col("source") == "challenger", x).when(F.col("source") == "helper", m).otherwise(b).alias("text"),
    )


def collapse_switch(a: str, b: str, *, max_words: int = 8, min_single: float = 0.30, min_ratio: float = 2.5,
                    max_edit: float = 0.08, min_oov_gain: float = 0.0) -> Column:
    """Leave ``a`` when it collapsed, or when ``b`` is close, has fewer unknown words and a better model score.

    Needs L02 features prefixed with the system names and ``pair_error``.
    """
    better = F.col(f"{b}_char_trigram_logprob") - F.col(f"{a}_char_trigram_logprob") > 0
    collapsed = (
        (F.col(f"{a}_words") <= max_words) & (F.col(f"{a}_singleton_rate") >= min_single)
        & (F.col(f"{b}_words") / F.greatest(F.col(f"{a}_words"), F.lit(1)) >= min_ratio)
    )
    close = (F.col("pair_error") <= max_edit) & (F.col(f"{a}_oov_rate") - F.col(f"{b}_oov_rate") > min_oov_gain)
    return better & (collapsed | close)


def anomaly_reasons(base: Column, other: Column, base_oov: Column, other_oov: Column, disagreement: Column, ops: Column) -> Column:
    """Reasons against an override, joined by ';' ('' is clean).

    ``ops`` aligns the base with the other text. An expansion is a run of differences in
    which one base word stands against three or more.
    """
    w = T.words(other)
    last, before = F.get(w, F.size(w) - 1), F.get(w, F.size(w) - 2)
    letters = F.array_join(F.transform(ops, lambda o: o["op"]), "")
    tests = (
        (F.size(w) > 0) & (F.length(last) <= 1),
        (F.size(w) >= 2) & (last != before) & (before.startswith(last) | last.startswith(before)),
        (disagreement <= 0.20) & letters.rlike("(^|C)(SII+|ISI+|II+SI*|DIII+|IDII+|IIDI+|III+DI*)(C|$)"),
        other_oov > base_oov + 0.10,
    )
    reasons = F.array(*[F.when(test, name) for name, test in zip(fixed.ANOMALY_REASONS, tests)])
    return F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ";")


def artifact_revert(w: Column, incumbent_words: Column) -> Column:
    """Loops or runaway length: go back to the incumbent."""
    return (T.repeated_ngrams(w, 3) >= 3) | (T.adjacent_repeats(w) >= 3) | (F.size(w) / F.greatest(incumbent_words, F.lit(1)) > 1.6)


# --- M18: chunk merge -------------------------------------------------------------------------

MAX_OVERLAP = 12


def _overlap(tail: Column, w: Column) -> Column:
    """Longest suffix of ``tail`` (up to 12 words) that starts ``w``."""
    sizes = F.array(*[F.lit(i) for i in range(MAX_OVERLAP, 0, -1)])
    fits = F.filter(
        sizes,
        lambda s: (s <= F.size(tail)) & (s <= F.size(w)) & (F.slice(tail, F.size(tail) - s + 1, s) == F.slice(w, F.lit(1), s)),
    )
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def _last_words(w: Column) -> Column:
    return F.slice(w, F.greatest(F.size(w) - (MAX_OVERLAP - 1), F.lit(1)), F.lit(MAX_OVERLAP))


SEGMENT = 64
ORDER_BLOCK = 4096  # values of the order column that are numbered in one task


def _numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """``_at``: the place of a row in its group, from 1; ``order`` is a number, such as a turn or a time."""
    block = F.floor(F.col(order) / ORDER_BLOCK)
    return O.running_totals(df, [order], block, {"_at": F.lit(1).cast("long")}, [group])


def merge_chunks(chunks: DataFrame, group: str, order: str, text: str, segment: int = SEGMENT) -> DataFrame:
    """What every chunk adds when exact word overlaps with the text so far are dropped; one row per chunk.

    A group is cut into segments of ``segment`` chunks, whatever their lengths. A segment needs
    only the last 12 words before it. It is folded behind an empty text first, and again where
    the segment before it turns out to end otherwise, until nothing changes. A round settles one
    more segment of every group at least; since each chunk ends the text, ends agree after a few
    chunks and one or two rounds are the rule. Only ends of segments travel between rounds.
    """
    w = chunks.select(group, order, T.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    numbered = _numbered(w, group, order)
    segments = keep(
        numbered.groupBy(group, F.floor((F.col("_at") - 1) / segment).alias("seg")).agg(
            F.sort_array(F.collect_list(F.struct(order, "w"))).alias("_c"))
    )
    nothing = F.array().cast("array<string>")
    new_words = lambda tail, c: F.slice(c["w"], _overlap(tail, c["w"]) + 1, F.size(c["w"]))

    def end(before: str) -> Column:
        return F.aggregate("_c", F.col(before), lambda tail, c: _last_words(F.concat(tail, new_words(tail, c))))

    def folded(s: Column, c: Column) -> Column:
        piece = new_words(s["tail"], c)
        added = F.struct(c[order].cast("bigint").alias(order), piece.alias("piece"))
        return F.struct(_last_words(F.concat(s["tail"], piece)).alias("tail"), F.concat(s["out"], F.array(added)).alias("out"))

    def moved(ends: DataFrame) -> DataFrame:
        """Segments that begin behind other words than they were folded behind."""
        before = ends.select(group, (F.col("seg") + 1).alias("seg"), F.col("_end").alias("_now"))
        return ends.join(before, [group, "seg"]).where(F.col("_now") != F.col("_before")).select(group, "seg", F.col("_now").alias("_before"))

    begun = segments.withColumn("_before", nothing)
    # a group's first segment is right from the start
    if segments.where("seg > 0").limit(1).count():
        ends = cut(begun.select(group, "seg", "_before", end("_before").alias("_end")))
        while (again := cut(moved(ends))).count():
            renewed = segments.join(again, [group, "seg"]).select(group, "seg", "_before", end("_before").alias("_end"))
            ends = cut(ends.join(again, [group, "seg"], "left_anti").unionByName(renewed))
        begun = segments.join(ends.select(group, "seg", "_before"), [group, "seg"])
    start = F.struct(F.col("_before").alias("tail"), F.array().cast(f"array<struct<{order}:bigint,piece:array<string>>>").alias("out"))
    return begun.select(group, F.explode(F.aggregate("_c", start, folded)["out"]).alias("o")).select(
        group, f"o.{order}", F.array_join("o.piece", " ").alias("piece")
    )


def merged_parts(pieces: DataFrame, group: str, order: str, segment: int = SEGMENT) -> DataFrame:
    """The merged text of a group in parts of ``segment`` pieces: (group, part from 0, text); no group is one row."""
    kept = pieces.where(F.col("piece") != "")
    numbered = _numbered(kept, group, order)
    parts = F.sort_array(F.collect_list(F.struct(order, "piece")))
    return numbered.groupBy(group, F.floor((F.col("_at") - 1) / segment).alias("part")).agg(
        F.array_join(F.transform(parts, lambda s: s["piece"]), " ").alias("text")
    )


def merged_text(pieces: DataFrame, group: str, order: str) -> DataFrame:
    """The whole merged text of a group, for groups that fit one string."""
    kept = pieces.where(F.col("piece") != "")
    parts = F.sort_array(F.collect_list(F.struct(order, "piece")))
    return kept.groupBy(group).agg(F.array_join(F.transform(parts, lambda s: s["piece"]), " ").alias("text"))


# --- guards, sweeps and blends ----------------------------------------------------------------


def threshold_sweep(feats: DataFrame, ratio: Column, eligible: Column, thresholds: Sequence[float]) -> DataFrame:
    """Merged text where the word ratio is at most t, else the incumbent; rows without one keep the candidate.

    ``feats`` has cand_/merged_/base_ counts (we, ce) and nw, nc. One pass to at most
    len(thresholds)+2 cells, then the sweep.
    """
    first = F.when(eligible, F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t < ratio))).otherwise(-1)
    names = [f"{s}_{c}" for s in ("cand", "merged", "base") for c in ("we", "ce")]
    cells = feats.groupBy(first.alias("first")).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in (*names, "nw", "nc")])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    take = (F.col("first") >= 0) & (F.col("first") <= F.col("i"))
    pick = lambda c: F.when(F.col("first") < 0, F.col(f"cand_{c}")).when(take, F.col(f"merged_{c}")).otherwise(F.col(f"base_{c}"))
    swept = cells.select("*", F.inline(steps)).groupBy("threshold").agg(
        F.sum(F.when(take, F.col("rows")).otherwise(0)).alias("switches"), F.sum(pick("we")).alias("we"), F.sum(pick("ce")).alias("ce"),
        F.sum("nw").alias("nw"), F.sum("nc").alias("nc"),
    )
    return S.with_rates(swept).select("threshold", "switches", "wer", "cer", "score")


def fallback_policies(df: DataFrame, key: str, candidate: str, incumbent: str) -> DataFrame:
    """Which rows go back to the incumbent under every named policy; (id, policy, fallback)."""
    c, b = F.col(candidate), F.col(incumbent)
    staged = df.withColumns({
        "_r": D.word_ratio(c, b), "_s": D.similarity(c, b),
        "_dup": T.adjacent_repeats(T.words(c)) > 0,
    })
    r, s = F.col("_r"), F.col("_s")
    rules: dict[str, Column] = {
        "candidate_all": F.lit(False), "incumbent_all": F.lit(True),
        "incumbent_if_trailing_aa": c.rlike("(^| )aa$"),
        "incumbent_if_trailing_filler": c.rlike("(^| )(aa|ah|ee|eh)$"),
        **{f"incumbent_if_word_ratio_gt_{t:.2f}": r > t for t in fixed.FALLBACK_RATIO_ABOVE},
        **{f"incumbent_if_word_ratio_lt_{t:.2f}": r < t for t in fixed.FALLBACK_RATIO_BELOW},
        **{f"incumbent_if_similarity_lt_{t:.2f}": s < t for t in fixed.FALLBACK_SIMILARITY_BELOW},
        "incumbent_if_duplicate_and_ratio_gt_1.20": F.col("_dup") & (r > 1.20),
    }
    rows = [F.struct(F.lit(n).alias("policy"), x.alias("fallback")) for n, x in rules.items()]
    return staged.select(key, F.inline(F.array(*rows)))


def language_blend(counts: DataFrame, floor_score: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the best system per language, and the report with the promotion flag; pairs are scored once for either."""
    table = S.corpus_scores(counts, "language", "system", "pos")
    picks = S.best_per_group(table, ["language"], F.col("score"), F.col("pos")).select("language", "system")
    rows = counts.join(F.broadcast(picks), ["language", "system"])
    # the sums of the picked rows are in the table already
    best = F.first("system").over(W.partitionBy("language").orderBy("score", "pos"))
    picked = table.withColumn("_best", best).where(F.col("language").isNotNull() & (F.col("system") == F.col("_best")))
    total = S.with_rates(picked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(c).alias(c) for c in ("we", "ce", "nw", "nc")]))
    return rows, total.withColumn("promoted", 1.0 - F.col("score") > floor_score + 1e-6)


def oracle_pick(counts: DataFrame) -> DataFrame:
    """Per id the system with the least additive error contribution (needs references)."""
    totals = counts.where(F.col("pos") == 0).agg(F.sum("nw").alias("_nw"), F.sum("nc").alias("_nc"))
    cost = 0.5 * F.col("we") / F.col("_nw") + 0.5 * F.col("ce") / F.col("_nc")
    row = F.struct("system", "we", "ce", "nw", "nc")
    j = counts.join(F.broadcast(totals), F.lit(True)).withColumn("_c", F.round(cost * 1e6, 9))
    return j.groupBy("id").agg(F.min_by(row, F.struct("_c", "pos")).alias("b")).select("id", "b.*")


def cross_fitted_choice(counts: DataFrame, fold: str) -> DataFrame:
    """Per fold the best system on the other folds, with its score on the fold.

    One aggregate by (fold, system); training sums are the total minus the fold.
    """
    per = S.sums(counts, [fold, "system", "pos"])
    w = W.partitionBy("system")
    train = {c: F.sum(c).over(w) - F.col(c) for c in ("we", "ce", "nw", "nc")}
    rate = lambda d: 0.5 * d["we"] / d["nw"] + 0.5 * d["ce"] / d["nc"]
    held = {c: F.col(c) for c in ("we", "ce", "nw", "nc")}
    table = per.withColumns({"train_score": rate(train), "heldout_score": rate(held)})
    return S.best_per_group(table, [fold], F.round("train_score", 12), F.col("pos")).select(
        fold, F.col("system").alias("selected"), "n", "train_score", "heldout_score"
    )


def cross_fitted_rules(cells: DataFrame, fold: str, config: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """Per fold the rule that is best on the other folds, ties by ``prefer``; its held-out score.

    ``cells`` has one row per (fold, config) with we, ce, nw, nc, switches.
    """
    w = W.partitionBy(*config)
    names = ("we", "ce", "nw", "nc", "switches")
    train = cells.withColumns({f"t_{c}": F.sum(c).over(w) - F.col(c) for c in names})
    rate = lambda p: 0.5 * F.col(f"{p}we") / F.col(f"{p}nw") + 0.5 * F.col(f"{p}ce") / F.col(f"{p}nc")
    scored = train.withColumns({"train_score": rate("t_"), "heldout_score": rate("")})
    return S.best_per_group(scored, [fold], F.round("train_score", 12), F.col("t_switches"), *prefer).select(
        fold, *config, "t_switches", "train_score", "heldout_score", "switches"
    )


def cache_audit(caches: DataFrame, metrics: DataFrame, route_index: DataFrame, known_routes: Sequence[str]) -> DataFrame:
    """Is the cache of every (route, model) an exact accepted scope with a passed report.

    caches: (route, model, id); route_index: (id, route, split); metrics: (route, model,
    strong_pass, candidate, delta). Id sets are compared by matched and total counts.
    """
    idx = route_index.select("id", F.col("route").alias("_r"), "split")
    expected = route_index.groupBy("route").agg(F.count("*").alias("all_rows"), F.count_if(F.col("split") == "new").alias("new_rows"))
    hit = F.col("_r") == F.col("route")
    seen = caches.join(idx, "id", "left").groupBy("route", "model").agg(
        F.count("*").alias("cache_rows"), F.count_if(hit).alias("_in_all"), F.count_if(hit & (F.col("split") == "new")).alias("_in_new")
    )
    j = metrics.join(seen, ["route", "model"], "left").join(F.broadcast(expected), "route", "left")
    exact_all = (F.col("cache_rows") == F.col("all_rows")) & (F.col("_in_all") == F.col("all_rows"))
    exact_new = (F.col("cache_rows") == F.col("new_rows")) & (F.col("_in_new") == F.col("new_rows"))
    finite = F.col("candidate").isNotNull() & ~F.isnan("candidate") & F.col("delta").isNotNull() & ~F.isnan("delta")
    reason = (
        F.when(~F.coalesce("strong_pass", F.lit(False)), "report not passed")
        .when(~F.col("route").isin(*known_routes), "unknown route")
        .when(F.col("cache_rows").isNull(), "no cache")
        .when(~(exact_all | exact_new), "id set is no accepted scope")
        .when(~finite, "metrics missing")
        .otherwise("eligible")
    )
    scope = F.when(exact_all, "all").when(exact_new, "new")
    return j.select("route", "model", "candidate", "delta", "cache_rows", scope.alias("scope"), reason.alias("reason"))


def compose(audit: DataFrame, total_rows: int | Column) -> DataFrame:
    """The best eligible model per route and its crude projected gain."""
    ok = audit.where(F.col("reason") == "eligible")
    best = S.best_per_group(ok, ["route"], F.desc("candidate"), F.desc("delta"), F.desc("model"))
    return best.withColumn("projected", F.col("delta") * F.col("cache_rows") / total_rows)


def hard_route(df: DataFrame, lid: str, p: str, base: str, single: Mapping[str, str], min_p: float, keep: Sequence[str] = ()) -> DataFrame:
    """Force the single-route text at high confidence; action label and changed flag."""
    text = F.lit(None).cast("string")
    for code, col in single.items():
        text = F.when(F.col(lid) == code, F.col(col)).otherwise(text)
    forced = ~F.col(lid).isin(*keep) if keep else F.lit(True)
    hit = forced & F.col(lid).isin(*single) & (F.coalesce(p, F.lit(0.0)) >= min_p)
    dot = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(c)
    out = F.when(hit, dot(text)).otherwise(dot(F.col(base)))
    return df.withColumns({
        "action": F.when(hit, "lid_single").otherwise("keep_champion"), "text": out, "changed": out != dot(F.col(base)),
    })
