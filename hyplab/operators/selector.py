"""Nested choice between two systems with logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, functions as F

from hyplab.functions import distance as D, text as T
from hyplab.operators import logistic as R, select as G
from hyplab.operators.sizing import keep

_PAIR = ("words", "oov_rate", "apostrophe", "unique", "repeat")
BASIC = (*[f"{s}_{c}" for c in _PAIR for s in "ab"], "log_word_ratio", "log_char_ratio", "word_disagreement", "pair_error", "oov_delta")
MODELS = tuple(f"{s}_{c}" for c in ("unigram_logprob", "char_trigram_logprob") for s in "ab") + ("unigram_delta", "trigram_delta")
FEATURE_SETS = {"basic": BASIC, "lm": BASIC + MODELS}
# Grid of the selector.
THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 0.70)
STRENGTHS = (0.05, 0.2, 1.0, 5.0)
WEIGHTS = ("none", "balanced")

SCHEMA = ("fold long, feature_set string, strength double, weight string, threshold double, inner_score double, n long, "
          "first_share double, heldout_score double")


def features(df: DataFrame) -> DataFrame:
    """Features of systems a and b and the label: the first costs no more. ``df`` has both texts, their counts and model scores."""
    cost = lambda s: F.col(f"{s}_we") / F.greatest("nw", F.lit(1)) + F.col(f"{s}_ce") / F.greatest("nc", F.lit(1))
    log_ratio = lambda a, b: F.log((a + 1.0) / (b + 1.0))
    text = {s: F.coalesce(f"{s}_hypothesis", F.lit("")) for s in "ab"}
    words = {s: T.words(text[s]) for s in "ab"}
    counted = D.with_word_distance(df, "_word_edits", words["a"], words["b"])
    shape = {}
    for s in "ab":
        shape[f"{s}_apostrophe"] = F.regexp_count(text[s], F.lit("'")) / F.greatest(F.length(text[s]), F.lit(1))
        shape[f"{s}_unique"] = T.unique_ratio(words[s])
        shape[f"{s}_repeat"] = T.adjacent_repeats(words[s]) / F.greatest(F.size(words[s]) - 1, F.lit(1))
    return counted.withColumns(shape | {
        "log_word_ratio": log_ratio(F.col("a_words"), F.col("b_words")),
        "log_char_ratio": log_ratio(F.length(text["a"]), F.length(text["b"])),
        "word_disagreement": F.col("_word_edits") / F.greatest(F.size(words["a"]), F.size(words["b"]), F.lit(1)),
        "oov_delta": F.col("a_oov_rate") - F.col("b_oov_rate"),
        "unigram_delta": F.col("a_unigram_logprob") - F.col("b_unigram_logprob"),
        "trigram_delta": F.col("a_char_trigram_logprob") - F.col("b_char_trigram_logprob"),
        "label": (cost("a") <= cost("b")).cast("double"),
    }).drop("_word_edits")


def nested_selector(
    df: DataFrame, outer: int = 5, inner: int = 4, feature_sets: Sequence[str] = tuple(FEATURE_SETS), strengths: Sequence[float] = STRENGTHS,
    weights: Sequence[str] = WEIGHTS, thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Per outer fold: the configuration that is best on inner folds, and its score on the held-out fold.

    ``df`` has what ``features`` reads and ``fold``; inner folds split the remaining speakers
    again by hash. The models of all folds and configurations are fitted together; two more
    passes score the inner and the outer folds. The result has one row per fold with rows.
    """
    names = list(dict.fromkeys(c for s in feature_sets for c in FEATURE_SETS[s]))
    inner_fold = G.hash_fold(F.col("speaker_id"), "inner", inner)
    costs = ("a_we", "a_ce", "b_we", "b_ce", "nw", "nc")
    # a missing or endless value is a gap, which the fit fills
    gap = F.lit(float("nan"))
    base = keep(features(df).where("fold IS NOT NULL").select(
        (F.col("fold") * inner + inner_fold).cast("long").alias("cell"), "label",
        F.array(*[F.coalesce(F.col(c).cast("double"), gap) for c in names]).alias("x"), *[F.col(c).cast("double").alias(c) for c in costs]))

    # training sets: all inner folds but one, and all of them, for every outer fold
    whole = [[f * inner + k for f in range(outer) if f != held for k in range(inner)] for held in range(outer)]
    parts = [[c for c in whole[held] if c % inner != k] for held in range(outer) for k in range(inner)]
    sets = parts + whole
    configs = list(product(feature_sets, strengths, weights))
    column = {c: j for j, c in enumerate(names)}
    models = [
        R.Model(t, tuple(column[c] for c in FEATURE_SETS[s]), strength, weight == "balanced") for t in range(len(sets)) for s, strength, weight in configs]
    fitted, scale = R.fit(base, "x", "label", "cell", sets, models, len(names))
    of_set = fitted.reshape(len(sets), len(configs), -1)
    cuts = np.array(thresholds)

    def sums(p: np.ndarray, cost: list[np.ndarray]) -> np.ndarray:
        """configs x thresholds x (word edits, character edits, rows of the first system)."""
        awe, ace, bwe, bce = cost[:4]
        first = (p[:, :, None] >= cuts).reshape(len(p), -1).astype(float)
        # whole numbers, so the products are exact
        won = first.T @ np.stack([awe - bwe, ace - bce, np.ones(len(p))], axis=-1)
        return (won + [bwe.sum(), bce.sum(), 0.0]).reshape(p.shape[1], len(cuts), 3)

    columns = [F.col("x"), F.col("cell"), *[F.col(c) for c in costs]]

    def inner_scores(arrays: list[np.ndarray]) -> dict[int, np.ndarray]:
        x, cell, *cost = arrays
        out = {}
        for held in range(outer):
            for k in range(inner):
                mine = (cell // inner != held) & (cell % inner == k)
                if mine.any():
                    t = held * inner + k
                    own = [c[mine] for c in cost]
                    made = np.concatenate([sums(R.probabilities(x[mine], t, of_set[t], scale), own).ravel(), [own[4].sum(), own[5].sum(), mine.sum()]])
                    out[held] = out[held] + made if held in out else made
        return out

    def best(total: np.ndarray) -> tuple[float, int, int]:
        nw, nc, _ = total[-3:]
        error = 0.5 * total[:-3].reshape(len(configs), len(cuts), 3)[:, :, 0] / max(nw, 1) + 0.5 * total[:-3].reshape(len(configs), len(cuts), 3)[:, :, 1] / max(nc, 1)
        order = [(round(error[i, j], 12), len(FEATURE_SETS[configs[i][0]]), configs[i][1], i, j) for i in range(len(configs)) for j in range(len(cuts))]
        _, _, _, i, j = min(order)
        return float(error[i, j]), i, j

    chosen = {held: best(total) for held, total in R.summed(base, columns, inner_scores).items()}

    def outer_scores(arrays: list[np.ndarray]) -> dict[int, np.ndarray]:
        x, cell, *cost = arrays
        out = {}
        for held, (_, i, j) in chosen.items():
            mine = cell // inner == held
            if mine.any():
                t = len(parts) + held
                own = [c[mine] for c in cost]
                made = sums(R.probabilities(x[mine], t, of_set[t][[i]], scale), own)[0, j]
                out[held] = np.concatenate([made, [own[4].sum(), own[5].sum(), mine.sum()]])
        return out

    rows = []
    for held, (we, ce, first, nw, nc, n) in sorted(R.summed(base, columns, outer_scores).items()):
        error, i, j = chosen[held]
        name, strength, weight = configs[i]
        rows.append((held, name, strength, weight, float(cuts[j]), error, int(n), float(first / n), float(0.5 * we / max(nw, 1) + 0.5 * ce / max(nc, 1))))
    return df.sparkSession.createDataFrame(rows, SCHEMA)
