"""The prefix trie against sets of whole prefixes, over one shard and over many."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from hyplab.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, name int"


def rows_of(convs):
    return [(c, None if i == 0 and c % 3 == 0 else i, r, t, None, 1) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


def brute(convs):
    """convs: conv_id -> ordered turns."""
    path = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple((r or "", t or "") for r, t in convs.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in who if len(path[c]) == len(node))))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
            sum(len(x) == len(node) + 1 for x in under), sum(not any(y[:-1] == x for y in members if y) for x in under),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    got = T.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert list(got[0].asDict()) == fields if got else True
    return sorted((tuple(r[f] for f in fields) for r in got), key=str)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_SHARD", 4)


@pytest.mark.parametrize("seed", range(4))
def test_many_shards(spark, tiny, seed):
    rng = random.Random(seed)
    say = [("user", "é"), ("user", "yes"), ("assistant", "é"), (None, None), ("", "")][: rng.choice([2, 5])]
    convs = {rng.randrange(200): [rng.choice(say) for _ in range(rng.randrange(1, 12))] for _ in range(40)}
    assert found(spark, rows_of(convs)) == brute(convs)


def test_a_third_of_the_conversations_are_one(spark, tiny):
    same = [("user", "hello"), ("assistant", "dear me")] * 6
    convs = {c: same for c in range(40)} | {c: same[:3] + [("user", str(c))] * 7 for c in range(40, 60)}
    convs |= {c: same + [("user", str(c % 2))] for c in range(60, 75)} | {1001: [("user", "other")], 1002: [("user", "b")] * 300}
    assert found(spark, rows_of(convs)) == brute(convs)


def test_every_conversation_alike(spark, tiny):
    convs = {5 * c: [("user", "x")] for c in range(30)}
    assert found(spark, rows_of(convs)) == brute(convs)


def test_broadcast_and_shuffle_agree(spark, tiny, monkeypatch):
    convs = {c: [("user", str(c % 3)), ("user", str(c))] * 5 for c in range(30)}
    want = brute(convs)
    assert found(spark, rows_of(convs)) == want
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert found(spark, rows_of(convs)) == want


def test_odd_rows(spark):
    rows = [
        (5, 1, "user", "b", None, None), (5, None, None, None, None, None), (5, 1, "user", "b", None, None),
        (None, 1, "user", "nobody", "p", 1), (7, 1, None, "late", None, None), (None, None, None, None, None, None),
    ]
    convs = {5: [(None, None), ("user", "b"), ("user", "b")], 7: [(None, "late")]}
    assert found(spark, rows) == brute(convs)
    assert found(spark, [(None, 1, "a", "b", "c", 1)]) == []


def test_ties_have_one_order(spark):
    rows = [(5, 1, "user", x, None, None) for x in "cab"]
    assert found(spark, rows) == found(spark, rows[::-1])


def test_empty_table(spark):
    assert T.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_counts_whole_digests():
    a, b, c = b"a" * 16, b"b" * 16, b"a" * 15 + b"c"
    assert [T.shared(x, y) for x, y in ((a, a + b), (a + b, a + c), (b"", a), (a + b + c, a + b + c), (c, a))] == [1, 1, 0, 3, 0]
