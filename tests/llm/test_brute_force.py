"""Packing and sentence spans against plain restatements that try everything."""

import re
from collections import defaultdict

import numpy as np

from hyplab.llm import packing, sentence_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_packing(rows, capacity):
    """(doc_id, piece, first_word, n_words, bin or None for a full piece, place) of each span, every bin tried for each tail."""
    sized = sorted(((len(WORD.findall(t or "")) + 1, d, s, t or "") for d, s, t in rows), key=lambda x: (-x[0], x[1]))
    out, tails, bins = [], [], []
    for size, d, source, text in sized:
        whole, tail = divmod(size, capacity)
        out += [(d, k, k * capacity, capacity - (tail == 0 and k == whole - 1), None, 0) for k in range(whole)]
        if tail:
            tails.append((tail, d, source, text, whole))
    for tail, d, source, text, piece in sorted(tails, key=lambda x: -x[0]):
        fits = [(b["free"], i) for i, b in enumerate(bins)
                if b["free"] >= tail and (source is None or source not in b["sources"]) and text not in b["texts"]]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"free": capacity, "sources": set(), "texts": set()})
        out.append((d, piece, piece * capacity, tail - 1, at, capacity - bins[at]["free"]))
        bins[at]["free"] -= tail
        bins[at]["sources"].add(source)
        bins[at]["texts"].add(text)
    return out, [capacity - b["free"] for b in bins]


def test_packing_against_a_scan_of_all_bins(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(400):
        # a hot source, sources of one row, no source; copies under several sources; texts of no, few and many words
        source = ["hot", None, f"s{i % 40}", f"own{i}"][min(3, int(rng.integers(0, 5)))]
        n = int(rng.integers(0, 90)) if i % 9 else int(rng.integers(90, 400))
        rows.append((i, source, [" ".join(f"w{i}x{k}" for k in range(n)), "a copy of one text", None, ""][0 if i % 5 else i // 5 % 4]))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7), capacity=100, cell_rows=1000).collect()
    want, used = plain_packing(rows, 100)
    seen = sorted((r["doc_id"], r["piece"], r["first_word"], r["n_words"], r["place"]) for r in got)
    assert seen == sorted((d, p, f, n, place) for d, p, f, n, _, place in want)
    together, plain = defaultdict(set), defaultdict(set)
    for r in got:
        together[r["sequence_id"]].add((r["doc_id"], r["piece"]))
        assert r["used"] <= 100
    for d, p, _, _, b, _ in want:
        plain[(d, p, "full") if b is None else b].add((d, p))
    assert sorted(map(sorted, together.values())) == sorted(map(sorted, plain.values()))
    fill = {(r["doc_id"], r["piece"]): r["used"] for r in got}
    assert all(fill[d, p] == (100 if b is None else used[b]) for d, p, _, _, b, _ in want)


def plain_sentences(text):
    """Words and start of each sentence of a text whose sentences are short."""
    out, ended, behind = [], True, 0
    for m in WORD.finditer(text):
        if ended or "\n" in text[behind : m.start()]:
            out.append(([], m.start()))
        out[-1][0].append(m[0].lower())
        ended, behind = m[0][-1] in ".!?…。", m.end()
    return out


def plain_runs(sentences, least, words):
    """(first, behind, words) of the shortest runs from and up to each sentence, every run tried."""
    found, n = set(), len(sentences)
    long = lambda a, b: b - a >= least and sum(len(s) for s, _ in sentences[a:b]) >= words
    for i in range(n):
        found |= {(i, j) for j in [next((j for j in range(i + 1, n + 1) if long(i, j)), None)] if j}
        found |= {(j, i + 1) for j in [next((j for j in range(i, -1, -1) if long(j, i + 1)), None)] if j is not None}
    return [(a, b, tuple(w for s, _ in sentences[a:b] for w in s)) for a, b in sorted(found)]


def test_sentence_spans_against_all_runs(spark):
    rng = np.random.default_rng(22)
    pool = []
    for _ in range(40):
        words = [f"{'AbCd'[int(rng.integers(0, 4))]}w{rng.integers(0, 500)}" for _ in range(int(rng.integers(2, 11)))]
        pool.append(" ".join(words) + [".", "!", "?", "…", "\n"][int(rng.integers(0, 5))])
    texts = {i: "  " * (i % 2) + " ".join(pool[k] for k in rng.integers(0, 40, int(rng.integers(0, 9)))) for i in range(60)}
    texts |= {60 + i: " ".join(pool[a : a + 6]) for i, a in enumerate(range(0, 30, 3))}
    texts |= {80: " ".join(pool[:5] * 3), 81: "", 82: " \n\n ", 83: pool[0].upper() + " " + " ".join(pool[1:5])}
    bounds = sentence_spans.Bounds()
    cut = {i: plain_sentences(t) for i, t in texts.items()}
    runs = {i: plain_runs(c, bounds.sentences, bounds.min_words) for i, c in cut.items()}
    first = {}
    for i in sorted(runs):
        for *_, words in runs[i]:
            first.setdefault(words, i)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeats(rows).collect()}
    assert any(r["n_removed"] for r in got.values()) and not all(r["n_removed"] for r in got.values())
    for i, text in texts.items():
        gone, seen = set(), set()
        for a, b, words in runs[i]:
            if first[words] != i or words in seen:
                gone |= set(range(a, b))
            seen.add(words)
        edge = [s for _, s in cut[i]] + [len(text)]
        left = text[: edge[0]] + "".join(text[edge[k] : edge[k + 1]] for k in range(len(cut[i])) if k not in gone)
        r = got[i]
        assert (r["n_sentences"], r["n_removed"], r["text"]) == (len(cut[i]), len(gone), left)
        assert {k for s in r["removed"] for k in range(s["first"], s["behind"])} == gone


def test_rows_without_doc_id_are_documents_of_their_own(spark):
    passage = " ".join(f"p{i} q{i} r{i}." for i in range(24))
    other = " ".join(f"n{i} m{i}." for i in range(20))
    own = [f"Opening {i} words of {i} one text. " for i in range(4)]
    rows = [(None, own[0] + passage), (None, own[1] + passage), (None, own[2] + other), (7, own[3] + other), (None, own[0] + passage), (None, None)]
    got = sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    holders = [r for r in got if r["text"] and "q3" in r["text"]]
    # equal nameless texts are one document; the passage stays in one document, with its copy or without
    assert len({r["text"] for r in holders}) == 1 and len(holders) in (1, 2)
    named = [r for r in got if r["doc_id"] == 7]
    assert named[0]["n_removed"] == 0 and sum("m3" in (r["text"] or "") for r in got) == 1
