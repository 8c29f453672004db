"""Near duplicates in large and nameless groups against all pairs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from hyplab.llm import near_duplicates as ND

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> least doc_id reachable, through an index of shared shingles."""
    sets = [shingles(t) for _, t in rows]
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def test_one_shingle_in_a_third_of_the_documents(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(12)]
    rows = []
    for i in range(3000):
        body = [word() for _ in range(rng.randrange(10, 40))]
        rows.append((i, " ".join((body[:5] + passage + body[5:]) if i % 3 == 0 else body)))
    for i in range(0, 300, 3):
        rows.append((3000 + i, " ".join(edited(rng, rows[i][1].split(), rng.randrange(0, 3)))))
    got = {r["doc_id"]: r["component_id"] for r in ND.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_a_third_are_edited_copies_of_one(spark):
    rng = random.Random(8)
    base = [f"b{rng.randrange(5000)}" for _ in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 8)))) for i in range(300)]
    rows += [(i, " ".join(f"x{rng.randrange(5000)}" for _ in range(60))) for i in range(300, 900)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in ND.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_a_near_copy_without_name_is_linked(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(500)}" for _ in range(80)]
    other = edited(rng, base, 1)
    rows = [(4, " ".join(base)), (None, " ".join(other)), (None, " ".join(other)), (9, "something else altogether, not alike at all")]
    got = ND.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, 4, False), (0, 4, False), (4, 4, True), (9, 9, True)]


def test_frequent_shingles_are_counted_exactly(spark):
    rows = [(i, f"common words in every text here {i} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(60)]
    rest = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"), "text")
    cells, known, n = ND._frequencies(rest)
    assert n.tolist() == [60, 60] and len(known) == 2 and cells.sum() == 60 * 21 and cells.min() == 0
