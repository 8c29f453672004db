"""Each operator against a plain restatement of its rule on small tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hyplab.llm import (
    components, kernels as K, line_rules, line_templates, mixing, near_duplicates as ND, packing, quality_classifier as QC,
    sentence_spans, sharding, simhash, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def block_of(texts):
    return next(b for _, b in K.blocks(pa.array(texts, pa.string())))


TEXTS = ["", None, "a", " a  bb\nccc \n\n", "éé ñ\tx", "x y z x y z", "\n", "last one."]


def test_words_and_lines():
    b = block_of(TEXTS)
    start, end, at = b.words()
    for i, t in enumerate(TEXTS):
        assert [b.text(start[j], end[j]) for j in range(at[i], at[i + 1])] == WORD.findall(t or "")
    start, end, at = b.lines()
    for i, t in enumerate(TEXTS):
        assert [b.text(start[j], end[j]) for j in range(at[i], at[i + 1])] == (t or "").split("\n")


def test_hashes_name_spans_and_windows_stay_in_texts():
    b = block_of(["a b a b", "a b", "ab", "b a b a b"])
    start, end, at = b.words()
    h = K.Block.span_hash(b.prefix(), start, end)
    names = [b.text(s, e) for s, e in zip(start, end)]
    assert all((h[i] == h[j]) == (names[i] == names[j]) for i in range(len(h)) for j in range(len(h)))
    wins, w_at = K.windows(h, at, 2)
    assert np.diff(w_at).tolist() == [3, 1, 0, 4]
    assert len(set(wins[:3].tolist())) == 2 and wins[0] == wins[3] == wins[5]


def test_blocks_split_a_batch_without_losing_texts(monkeypatch):
    monkeypatch.setattr(K, "BLOCK_BYTES", 16)
    texts = [None, "x" * 40, "", "ab cd", "e" * 15, "f"]
    assert [t for _, b in K.blocks(pa.array(texts, pa.string())) for t in (b.text(b.offsets[i], b.offsets[i + 1]) for i in range(b.n))] == [t or "" for t in texts]


def test_trees_learn_and_flat_traversal_equals_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    m = QC.grow(x, y, trees=30)
    got = m.score(x)
    assert ((got >= 0.5) == y).mean() > 0.95
    for i in range(20):
        total = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_without_labels_or_with_one_class(spark, documents):
    none = QC.fit(documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert QC.score(documents.limit(3), none).select("score").distinct().collect()[0][0] == 0.5
    ones = QC.fit(documents, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
    assert QC.score(documents.limit(3), ones).where("predicted = 1").count() == 3


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = QC.score(docs, QC.fit(docs, labels)).withColumn("h", QC.held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").where("h").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_chain_uses_earlier_categories_and_finds_toxic_texts(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((400, 6)) < 0.3).astype(float)
    y = np.column_stack([x[:, 0], np.maximum(x[:, 0], x[:, 1])])
    chain = toxicity.Chain(("a", "b"), tuple(range(6)), toxicity.fit_chain(x, y, np.arange(400) % 3))
    p = chain.score(x)
    assert len(chain.weights[1]) == 8 and ((p >= 0.5) == y).all()
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    taught = toxicity.weak_categories(docs, toxicity.sample_labels(labels))
    rows = toxicity.score(docs, toxicity.fit(taught, (*toxicity.SEEDS, "toxic"))).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def test_packing_keeps_every_word_and_every_conflict_apart(spark, documents):
    rows = packing.pack(documents, capacity=300, cell_rows=64).collect()
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in documents.collect()}
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_words"]
    assert got == Counter(words)
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
    for members in bins.values():
        names = [source[r["doc_id"]] for r in members]
        assert len(set(names)) == len(names) and members[0]["used"] <= 300
        at = sorted((r["place"], r["n_words"]) for r in members)
        assert all(a + n <= b for (a, n), (b, _) in zip(at, at[1:]))


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, starts = packing.best_fit([6, 5, 4, 3, 3], ["a", "b", "a", "c", "a"], [1, 2, 3, 4, 5], 10)
    assert bins == [0, 1, 1, 0, 2] and starts == [0, 0, 5, 6, 0]
    bins, _ = packing.best_fit([5, 5, 5], [None, None, None], [7, 7, 8], 10)
    assert bins == [0, 1, 0]


def test_sentence_runs_are_removed_from_all_but_the_first(spark):
    passage = "The quick brown fox jumps over the lazy dog near the river bank today. It was seen by nine men who told two more about it at noon. "
    docs = spark.createDataFrame([
        (5, "Alpha one two. " + passage + "Omega end here."), (3, "Start of three. " + passage + "Stop of three."),
        (9, passage + "Then so it goes. " + passage.lower()), (4, "Nothing shared at all in this short text."), (None, passage)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeats(docs).collect()}
    assert got[9]["text"] == "Then so it goes. "
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == 0
    assert got[5]["text"] == "Alpha one two. Omega end here."
    assert got[None]["text"] == ""


def naive_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets, [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
                  and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(rng.choice(vocabulary, 90))
    texts = ["", None, "a b", "A B", "b a"]
    for g in range(12):
        base = rng.choice(vocabulary, int(rng.integers(8, 150))).tolist()
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 25))):
                copy[rng.integers(len(copy))] = "new" + str(rng.integers(50))
            texts.append(" ".join(copy))
    # a passage that many otherwise different texts share
    texts += [" ".join(rng.choice(vocabulary, int(rng.integers(15, 40)))) + " " + common for _ in range(40)]
    sets, links = naive_links(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ND.near_duplicates(docs).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i]["n_shingles"] == len(sets[i])
        assert got[i]["component_id"] == find(i) and got[i]["kept"] == (find(i) == i)


def test_signatures_within_the_distance_meet_in_a_key(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**16, (30, ND.LANES))
    rows = []
    for i, x in enumerate(a):
        y = x.copy()
        flip = rng.choice(ND.LANES, ND.MAX_DISTANCE, replace=False)
        y[flip] ^= rng.integers(1, 2**16, len(flip))
        for lanes, side in ((x, "a"), (y, "b")):
            packed = [sum(int(lanes[4 * c + j]) << (16 * j) for j in range(4)) for c in range(ND.CHUNKS)]
            rows.append((i, side, [p - (1 << 64) if p >> 63 else p for p in packed]))
    df = spark.createDataFrame(rows, "i long, side string, chunks array<long>")
    keyed = df.select("i", "side", "chunks", ND._keys(F.col("chunks")).alias("k"))
    both = keyed.where("side = 'a'").alias("a").join(keyed.where("side = 'b'").alias("b"), "i")
    got = both.select(F.arrays_overlap("a.k", "b.k").alias("meet"), ND.distance(F.col("a.chunks"), F.col("b.chunks")).alias("d")).collect()
    assert all(r["meet"] and r["d"] == ND.MAX_DISTANCE for r in got)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_line_rules_text_and_counts(spark):
    good = "\n".join(f"Word{i} alpha{i} beta{i} gamma{i} delta{i} number {i * 7}." for i in range(12))
    docs = spark.createDataFrame([(1, good + "\nHome | News | Sport | Log in\nAll rights reserved."), (2, "SHOUT " * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.clean_lines(docs).collect()}
    assert got[1]["kept"] and got[1]["text"] == good and got[1]["n_lines_removed"] == 2
    assert got[2]["base_failed"] and not got[2]["kept"]


def test_shards_hold_groups_together_and_are_even(spark, documents):
    docs = documents.union(documents.withColumn("doc_id", F.col("doc_id") + 1000).limit(20))
    rows = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    of = defaultdict(set)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len(r["text"].encode()) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        of[r["text"]].add(r["shard"])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    group = {t: sum(r["size"] for r in rows if r["text"] == t) for t in of}
    assert all(len(s) == 1 for t, s in of.items() if group[t] <= sum(load.values()) // 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= sum(load.values()) / 16 * 1.15


def test_treap_and_best_fit_decreasing_against_lists():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = rng.integers(1, 60, 80).tolist()
        free, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(r, b) for b, r in enumerate(free) if r >= sizes[i]]
            if fits:
                b = min(fits)[1]
            else:
                free.append(100)
                b = len(free) - 1
            free[b] -= sizes[i]
            want[i] = b
        got = Counter()
        for size, b, n in sharding.best_fit_decreasing(Counter(sizes), 100):
            got[size, b] += n
        assert got == Counter(zip(sizes, want))
        assert sharding.best_fit_decreasing(Counter(sizes), 100, len(free) - 1) is None
    sizes = rng.integers(1, 60, 80).tolist()
    load = Counter()
    for size, b, n in sharding.even_bins(Counter(sizes), 7):
        load[b] += size * n
    assert set(load) <= set(range(7)) and sum(load.values()) == sum(sizes) and max(load.values()) <= sum(sizes) / 7 + 2


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_many_groups_of_few_sizes_are_whole_and_even(spark, broadcast_rows):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.expr("repeat('x', id % 7)")).alias("text"))
    docs = docs.union(spark.range(40_000).select(F.col("id") + 200_000, F.lit(""))).union(docs.where("doc_id < 50"))
    got = sharding.shard(docs, broadcast_rows=broadcast_rows).persist()
    assert got.count() == 140_050
    load = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 16 and max(load) - min(load) <= 40_000 and max(load) <= -(-sum(load) // 16) + 26
    assert got.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    slots = got.groupBy("shard").agg(F.min("slot"), F.max("slot") + 1, F.countDistinct("slot"), F.count("*")).collect()
    assert all(r[1] == 0 and r[2] == r[3] == r[4] for r in slots)
    got.unpersist()


def test_a_group_above_a_share_is_split(spark):
    docs = spark.createDataFrame([(i, "the same text again" if i % 3 else f"other {i}") for i in range(900)], "doc_id long, text string")
    load = {r["shard"]: r["b"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(load) == 16 and max(load.values()) < 1.3 * sum(load.values()) / 16


def test_mix_nears_targets_and_nests(spark, documents):
    slim = mixing.measure(documents).select("doc_id", "source", "_size", "_place").persist()
    goals = mixing.targets(slim)
    got = mixing.take(slim, mixing.plan(slim, goals))
    for r in got.groupBy("source").agg(F.sum(F.col("_size") * F.col("copies")).alias("t"), F.max("target").alias("g"), F.max("_size").alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"]
    total = slim.agg(F.sum("_size")).first()[0]
    assert goals.agg(F.sum("target")).first()[0] == pytest.approx(1.5 * total)
    assert got.agg(F.max("copies")).first()[0] <= 2
    lower = mixing.take(slim, mixing.plan(slim, goals.withColumn("target", F.col("target") * 0.6)))
    less = {r["doc_id"]: r["copies"] for r in lower.collect()}
    assert all(less[r["doc_id"]] <= r["copies"] for r in got.collect())


def xxh(data: bytes, seed: int = 42) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def plain_fingerprint(text):
    w = WORD.findall(text)
    hashes = [xxh(b.encode(), xxh(a.encode())) for a, b in zip(w, w[1:])] or [xxh(a.encode()) for a in w]
    return sum(1 << j for j in range(64) if sum(1 if h >> j & 1 else -1 for h in hashes) > 0)


def test_fingerprints_against_plain_votes(spark, documents):
    docs = documents.where("doc_id < 60").select("doc_id", "text").union(
        spark.createDataFrame([(1000, None), (1001, "one"), (1002, "")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in simhash.fingerprints(docs).collect()}
    import hashlib

    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt)
        assert r["fp"] % 2**64 == a and r["edited_fp"] % 2**64 == b
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64 and r["near_next"] == 1 - (a ^ c).bit_count() / 64


def test_fingerprints_of_least_ids_and_of_one_id_on_many_rows(spark):
    least = -(2**63)
    rows = [(least, "the least id of all"), (2**63 - 1, "the largest id"), (None, "no id"), (None, "no id either")]
    rows += [(7, f"text number {i} under one id") for i in range(40)]
    got = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    assert {r["fp"] % 2**64 for r in got} == {plain_fingerprint(t) for _, t in rows}


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, 12)
    fps = base.tolist()
    for b in base.tolist():
        for k in (1, 2, 3, 4, 5):
            x = b % 2**64
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            fps.append(x - 2**64 if x >> 63 else x)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {(r["query"], r["fp"]) for r in simhash.near(df, df).collect()}
    assert got == {(a, b) for a in fps for b in fps if ((a ^ b) % 2**64).bit_count() <= 3}


def test_templates_with_fields_recur_and_copies_stay_whole(spark):
    rng = np.random.default_rng(8)
    letters = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    bodies = {i: "\n".join(" ".join(letters() for _ in range(14)) for _ in range(3)) for i in range(200)}
    body = bodies.get
    rows = [(i, body(i) + f"\nPosted on {i} May by user{i}") for i in range(12)]
    names = "anna bert carl dora emil fritz gerd hans ida jan karl lena".split()
    rows += [(100 + i, body(100 + i) + f"\nWritten for you by our editor {n} with kind regards to all readers") for i, n in enumerate(names)]
    rows += [(200 + i, "An exact copy of one text.\nIt has two lines in it.") for i in range(12)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["text"] == body(i) for i in range(12))
    assert all(got[100 + i]["text"] == body(100 + i) for i in range(12))
    assert all(got[200 + i]["text"] == rows[-1][1] and got[200 + i]["n_lines_dropped"] == 0 for i in range(12))


def test_short_pages_lose_a_shared_line_and_equal_texts_count_once(spark):
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    own = {i: " ".join(word() for _ in range(5)) for i in range(30)}
    rows = [(i, f"{x}\nLicensed under the Apache License\nHome") for i, x in own.items()]
    rows += [(100, "Licensed under the Apache License\nHome"), (101, "Home\n\n"), (None, f"Home\n{word()}")]
    rows += [(200 + i, "Copied page\nMenu\nof one text") for i in range(20)]
    rows += [(300 + i, f"{word()} {word()}\nMenu") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    assert all(got[i]["text"] == x and got[i]["n_lines_dropped"] == 2 and got[i]["n_words_dropped"] == 6 for i, x in own.items())
    assert got[100]["mostly_recurring"] and got[101]["mostly_recurring"] and got[100]["text"] == rows[30][1]
    assert got[None]["text"] == rows[32][1].removeprefix("Home\n") and not got[None]["mostly_recurring"]
    assert all(got[i]["text"] == t for i, t in rows if i is not None and i >= 200)


def test_lines_of_one_document_do_not_make_a_template(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    table = "\n".join(f"the entry for the item called {word()} is listed here" for _ in range(10))
    prose = "\n".join(" ".join(word() for _ in range(14)) for _ in range(30))
    rows = [(1, prose + "\n" + table)] + [(i, " ".join(word() for _ in range(20))) for i in range(2, 20)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_lines_dropped"] == 0 and got[1]["text"] == rows[0][1]


def test_short_pages_lose_their_boilerplate_and_near_copies_count_once(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    own = [" ".join(word() for _ in range(11)) for _ in range(12)]
    common = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = [(i, f"Home\nContact us\n{x}\nLicensed under the Apache License, Version two.") for i, x in enumerate(own)]
    rows += [(100 + i, "\n".join([*common, word()])) for i in range(15)]
    rows += [(200, "Home\nContact us"), (None, f"Home\n{common[0]} {word()}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert all(got[i] == x for i, x in enumerate(own))
    assert all(got[i] == t for i, t in rows if i is not None and 100 <= i <= 200)
    assert got[None] == rows[-1][1].removeprefix("Home\n")


def test_passages_without_marks_are_found_at_every_offset(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    line = lambda n: [word() for _ in range(n)]
    passages = {k: line(50 + k % 11) for k in range(22)}
    rows = [(k, " ".join(line(7) + p + line(5))) for k, p in passages.items()]
    rows += [(100 + k, " ".join(line(k) + p + line(9))) for k, p in passages.items()]
    got = {r["doc_id"]: r["text"] for r in sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in passages.items():
        assert got[k] == rows[k][1]
        assert len(set(p) & set(got[100 + k].split())) <= len(p) // 2
