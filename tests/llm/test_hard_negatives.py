"""Hard negatives against scores of all pairs; the curve, bounds and exact products by themselves."""

import math
import random

import numpy as np
import pytest

from hyplab.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, curve string, block int, windows string"


def brute(rows, every=100):
    seen = []
    for vec_id, label, v, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(int(max(-(1 << 22), min(1 << 22, math.floor(256 * float(np.float32(x)))))) for x in v)
        if (vec_id, label, q) not in seen:
            seen.append((vec_id, label, q))
    dims = max((len(q) for _, _, q in seen), default=0)
    seen = list(dict.fromkeys((i, y, q + (0,) * (dims - len(q))) for i, y, q in seen))
    out = []
    for a in seen:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in seen if b != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **kw):
    got = H.mine(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def some(rng, n, dims, labels, grain=4):
    return [(i, rng.randrange(labels), [rng.randrange(-grain, grain + 1) / grain for _ in range(dims)], None, None, None) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("MIN_BLOCK_ROWS", 8), ("STRIP", 3), ("CELLS", 20)):
        monkeypatch.setattr(H, name, value)


@pytest.mark.parametrize("seed, dims, labels", [(1, 3, 2), (2, 6, 4)])
def test_many_small_blocks_equal_all_pairs(spark, small, seed, dims, labels):
    rng = random.Random(seed)
    rows = some(rng, 200, dims, labels)
    assert found(spark, rows, every=10) == brute(rows, 10)


def test_slabs_of_asks(spark, small, monkeypatch):
    monkeypatch.setattr(H, "SLAB", 1)
    rows = some(random.Random(4), 120, 4, 3)
    assert found(spark, rows, every=2) == brute(rows, 2)


def test_a_third_of_the_rows_share_one_vector(spark, small):
    rng = random.Random(9)
    rows = some(rng, 60, 4, 3) + [(i, i % 3, [0.5, 0.25, 0.75, 0.5], None, None, None) for i in range(60, 100)]
    assert found(spark, rows, every=10) == brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    rows = some(rng, 30, 3, 2)
    rows += rows[:5] + [(0, 1, [0.1, 0.9, 0.0], "x", 1, "y"), (None, 1, [1.0, 1.0, 1.0], None, None, None), (100, None, [1.0] * 3, None, None, None)]
    rows += [(100, 1, None, None, None, None), (100, 0, [1.0, None, 0.0], None, None, None), (100, 0, [nan, 0.0, 0.0], None, None, None)]
    rows += [(200, 0, [inf, 0.0, 0.0], None, None, None), (300, 0, [], None, None, None), (31, 0, [1.0], None, None, None)]
    rows += [(400, 1, [1e30, -1e30, 3.0, 0.5], None, None, None), (401, 1, [1e30, 0.0], None, None, None), (402, 0, [9e9, 0.0], None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_tables_without_anchors_or_rows(spark):
    assert found(spark, [(1, 1, [1.0], None, None, None), (2, 1, [1.0], None, None, None)]) == []
    assert found(spark, [(None, None, None, None, None, None)]) == []
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = H.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(7)
    a, x = rng.integers(-300, 300, (20, 6)), rng.integers(-300, 300, (50, 6))
    lower, upper = H.bounds(a, x.min(0)[None], x.max(0)[None])
    scores = H.product(a, x)
    assert (scores == a @ x.T).all() and (lower <= scores).all() and (scores <= upper).all()


def test_products_of_large_numbers_are_exact():
    a = np.array([[1 << 22, (1 << 22) - 1, -(1 << 22)]] * 2)
    want = [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in a] for r in a]
    assert H.product(a, a).tolist() == want
    big = np.repeat(a, 300, axis=1)
    assert H.product(big, big).tolist() == [[300 * v for v in r] for r in want]


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(H, "MIN_BLOCK_ROWS", 16)
    rng = random.Random(2)
    centres = [[math.cos(k * math.pi / 4), math.sin(k * math.pi / 4), 0.0] for k in range(8)]
    rows = [(i, i % 3, [c + rng.gauss(0, 0.01) for c in centres[i % 8]], None, None, None) for i in range(400)]
    table, dims = H.quantised(spark.createDataFrame(rows, SCHEMA))
    blocks = H.write_blocks(table, dims, 10)
    asks = H.anchors(blocks)
    assert H.chosen(asks, blocks).count() < 0.8 * asks.count() * len(blocks.names)
    assert found(spark, rows, every=10) == brute(rows, 10)
