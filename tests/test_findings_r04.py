"""One small test per mended finding of round 4."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyplab.functions import ngrams as N
from hyplab.operators import counts as C, fuse as M, lm as L
from hyplab.plans import views as V


def _text(r, letters, size):
    return "".join(r.choice(letters) for _ in range(size))


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_grams_are_counted_by_block_before_they_are_shuffled(spark, monkeypatch, block):
    """Texts of several planes, empty, short and null ones, null groups, and texts longer than a block."""
    monkeypatch.setattr(N, "_COUNTED", block)
    r = random.Random(3)
    rows = [(r.choice(["en", "fr", None]), r.choice([None, "", "a", _text(r, "ab ", 40), _text(r, "aß€𝄞", 9)])) for _ in range(60)]
    want = Counter()
    for lang, text in rows:
        s = f"<{text}>" if text is not None else ""
        want.update((lang, s[i : i + 3], s[i + 3]) for i in range(len(s) - 3))
    counts = C.char_ngrams(spark.createDataFrame(rows, "language string, text string").coalesce(1), "text", "language", n=4)
    assert {(x["language"], x["ctx"], x["ch"]): x["n"] for x in counts.collect()} == want
    assert "MapInArrow" in counts._jdf.queryExecution().executedPlan().toString()


def test_wide_alphabets_are_counted_as_well(monkeypatch):
    import numpy as np

    points = N._points(["abcabcab"])
    at, _ = N._starts(np.array([8]), 3)
    few = N._counted(points, at, np.zeros(len(at), np.int64), 1, 3)
    monkeypatch.setattr(N, "_LARGEST", 1)
    many = N._counted(points, at, np.zeros(len(at), np.int64), 1, 3)
    as_rows = lambda t: sorted((int(g), bytes(w.tobytes()), int(n)) for g, w, n in zip(*t))
    assert as_rows(few) == as_rows(many) and sum(few[2]) == 6


@pytest.mark.parametrize("direct", [1, 1 << 22])
def test_texts_are_scored_where_they_are(spark, monkeypatch, direct):
    """the mean of every gram under either model; no gram is a row, distinct texts are not shuffled."""
    monkeypatch.setattr(N, "_DIRECT", direct)
    r = random.Random(8)
    train = [(r.choice(["en", "fr"]), _text(r, "abc ", r.randint(0, 30))) for _ in range(40)]
    texts = [(i, _text(r, "abcdé ", r.randint(0, 25))) for i in range(60)] + [(60, None), (61, ""), (62, "ab"), (62, "ab")]
    grams, contexts, letters = Counter(), Counter(), {"en": set(), "fr": set()}
    for lang, t in train:
        s = f"<{t}>"
        for i in range(len(s) - 3):
            grams[lang, s[i : i + 4]] += 1
            contexts[lang, s[i : i + 3]] += 1
            letters[lang].add(s[i + 3])

    def mean(lang, text):
        s = f"<{text or ''}>"
        lp = [
            math.log10(max((grams[lang, s[i : i + 4]] + 0.5) / (contexts[lang, s[i : i + 3]] + 0.5 * max(len(letters[lang]), 1)), 1e-12))
            for i in range(len(s) - 3)
        ]
        return sum(lp) / len(lp) if lp else -10.0

    df, tr = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(train, "language string, reference string")
    got = L.char_logprobs(df, ["id"], "text", tr, ("en", "fr")).collect()
    assert len(got) == 63  # equal rows count once
    for x in got:
        assert (x["lp_en"], x["lp_fr"]) == pytest.approx((mean("en", x["text"]), mean("fr", x["text"])), abs=1e-9)
    plan = L.char_logprobs(df, ["id"], "text", tr, ("en", "fr"), distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_only_rows_of_repeated_documents_are_made_distinct(spark, tmp_path):
    docs = [(1, "s", "en", "a b c d e f g h i j k l m n"), (1, "t", "en", "a b c d e f g h i j k l m o"), (2, "s", "fr", "été x y"), (None, "s", "de", "p q"), (None, "s", "de", "p q")]
    names = "doc_id long, source string, lang string, text string"
    spark.createDataFrame(docs, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(docs[2:3], names).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    columns = ("id", "system", "hypothesis")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(V.distinct(spark, str(tmp_path), V.pairs, *columns)) == rows(V.pairs(spark, str(tmp_path)).select(*columns).distinct())
    assert "Aggregate" not in V.distinct(spark, str(tmp_path / "one"), V.pairs, *columns)._jdf.queryExecution().executedPlan().toString()


def test_windows_are_altered_without_a_step_per_token(spark, tmp_path):
    r = random.Random(4)
    docs = [(i, "s", "en", " ".join(_text(r, "abc", 3) for _ in range(r.randint(0, 40)))) for i in range(-30, 50)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {i: text.split() for i, _, _, text in docs}
    want = []
    for i, w in words.items():
        for c in range(0, -(-len(w) // 12)):
            t, n = w[12 * c : 12 * c + 12], i + c
            want.append((n, " ".join(x for k, x in enumerate(t) if (n + k + 1) % 7), " ".join(x if (3 * n + k + 1) % 11 else x[::-1] for k, x in enumerate(t)),
                         " ".join(x if (n + k + 1) % 5 else f"{x} {x}" for k, x in enumerate(t))))
    wide = V.wide(spark, str(tmp_path))
    assert sorted((x["n"], *(x[s] for s in V.SYSTEMS)) for x in wide.select("n", *V.SYSTEMS).collect()) == sorted(want)
    assert sorted((x["n"], x["hypothesis"]) for x in V.pairs(spark, str(tmp_path)).collect()) == sorted((x[0], h) for x in want for h in x[1:])
    assert not any("lambda" in line and "% 7" in line for line in wide._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_blend_report_scores_pairs_once(spark):
    rows = [("en", "a", 0, 1, 2, 10, 50), ("en", "b", 1, 3, 2, 10, 50), ("fr", "a", 0, 5, 9, 10, 50), ("fr", "b", 1, 0, 1, 10, 50), (None, "a", 0, 0, 0, 10, 50), ("fr", "b", 2, 4, 4, 10, 50)]
    counts = spark.createDataFrame(rows * 2, "language string, system string, pos int, we long, ce long, nw long, nc long")
    picked, report = M.language_blend(counts, 0.9)
    got = report.first()
    assert (got["n"], got["we"], got["ce"], got["nw"], got["nc"]) == (6, 10, 14, 60, 300)
    assert picked.agg(F.count("*"), F.sum("we")).first()[:2] == (6, 10)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    nothing = M.language_blend(counts.where("we > 100"), 0.9)[1].first()
    assert (nothing["n"], nothing["we"], nothing["score"]) == (0, None, 0.0)


def test_texts_of_an_id_are_compared_in_one_row(spark):
    """medoids by brute force: repeated, blank, long and missing texts, places and ids; a text is shuffled once."""
    r = random.Random(9)
    texts = [None, "", ".", "ab cd", "ab ce", " ab ce", "zz", "é a", "q" * 1100, "q" * 1099 + "r"]
    rows = [(i, s, k, r.choice(texts)) for i in range(150) for k, s in enumerate("pqz"[: r.randint(1, 3)])] + [(None, "p", 0, "x"), (None, "q", 1, "y"), (None, "q", 2, "x")]

    def distance(a, b):
        above = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
            above = row
        return above[-1]

    known = {(a, b): distance(a, b) for a in {(t or ".").strip() for t in texts} for b in {(t or ".").strip() for t in texts}}

    def error(a, b):
        a, b = a.strip(), b.strip()
        return 0.0 if a == b else 1.0 if "" in (a, b) else known[a, b] / max(len(a), len(b))

    want = {None: ("x", 0.0)}
    for i in range(150):
        of = {}
        for _, s, k, t in (x for x in rows if x[0] == i):
            of.setdefault(t or ".", []).append((k, s))
        costs = [(round(sum(error(t, u) for u in of if u != t), 9), -any(s == "p" for _, s in at), min(at)[0], t) for t, at in of.items()]
        want[i] = min(costs)[3], min(costs)[0]
    got = M.medoid(spark.createDataFrame(rows, "id long, system string, pos int, hypothesis string"), "p")
    assert {x["id"]: (x["text"], round(x["cost"], 9)) for x in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_clusters_are_found_in_one_row(spark):
    """clusters by brute force, with ids and hypotheses that repeat or are missing; only ids and floors are joined."""
    r = random.Random(2)
    texts = [None, "", "ab cd ef", "ab cd eg", "ab cd", "zz", "ab cd efg"]
    rows = [(r.choice([i, i, i, None]), "pqz"[k], k, r.choice(texts)) for i in range(80) for k in range(3)] + [(5, "q", 1, "ab cd eh")]
    error = {}
    for a in texts:
        for b in texts:
            a, b = a or ".", b or "."
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                last, row = row, [i]
                for j, y in enumerate([*b]):
                    row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
            error[a, b] = row[-1] / max(len(a), len(b))
    error |= {(a, b): 1 / 8 for a in ("ab cd eh",) for b in ("ab cd ef", "ab cd eg")}
    error |= {(b, a): e for (a, b), e in error.items() if a == "ab cd eh"} | {("ab cd eh", "ab cd eh"): 0.0}

    def near(a, b):
        return error.get((a, b), 1.0) <= 0.2

    want = {}
    for i in range(80):
        if i == 5:
            continue  # its second text of one place is looked at below
        own = [(k, t or ".") for j, _, k, t in rows if j == i]
        for k, t in own:
            of = [(len(u.split()), len(u), 0 if m == k else -m - 1, u) for m, u in own if m == k or near(t, u)]
            want[i] = max(want.get(i, (0, 0, "")), (len(of), -k, max(of)[3]))
    floor = spark.createDataFrame([(i, "ab cd ef") for i in range(80)], "id long, hypothesis string")
    got = M.consensus(spark.createDataFrame(rows, "id long, system string, pos int, hypothesis string"), floor, agree=0.2)
    found = {x["id"]: (x["n_agree"], x["text"]) for x in got.collect()}
    again = found.pop(5, None)
    assert found == {i: (n, t) for i, (n, _, t) in want.items()} and (again is None or again[0] >= 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
