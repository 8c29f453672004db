"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups of equal texts.

The driver packs the histogram of group sizes, (size, number of groups), never groups: sizes
enter by falling size the bin with the tightest remaining capacity that fits, found in a
balanced tree, and as many groups of that size as still fit go in at once, which is
where best fit decreasing puts them one by one. The capacity is the least (by
bisection) at which the wanted number of bins is enough. Different sizes are few: n of them need
n * n / 2 bytes of text. Groups of a size that several shards take are told apart by
their rank among hash cells. A group larger than an even share cannot fit any shard; it alone is
split, by a hash of doc_id, into parts of at most about an eighth of a share.

Null texts count as empty ones and have size 1. Ties are settled by hash and doc_id.
Rows alike in doc_id and text stay in one shard and get slots of their own. An empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from hyplab.llm.store import cut

ROWS_PER_CELL = 2000
HOT = 1000


@dataclass
class _Node:
    key: tuple[int, int]
    rank: int
    left: _Node | None = None
    right: _Node | None = None


class ResidualTree:
    """(residual, bin) pairs in a treap: each node's rank is above its children's."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self._seed = 1

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """Nodes below ``key``, and those at or above it."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, above = self._split(node.right, key)
            return node, above
        below, node.left = self._split(node.left, key)
        return below, node

    def _join(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b

    def add(self, key: tuple[int, int]) -> None:
        self._seed = self._seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        below, above = self._split(self.root, key)
        self.root = self._join(self._join(below, _Node(key, self._seed >> 20)), above)

    def take_at_least(self, residual: int) -> tuple[int, int] | None:
        """Remove and return the least pair whose residual is enough."""
        below, above = self._split(self.root, (residual, -1))
        if above is None:
            self.root = below
            return None
        first = above
        while first.left is not None:
            first = first.left
        _, rest = self._split(above, (first.key[0], first.key[1] + 1))
        self.root = self._join(below, rest)
        return first.key


def best_fit_decreasing(counts: Mapping[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, how many) for ``counts`` items of each size, as best fit decreasing puts them; None where it needs over ``most`` bins."""
    tree, out, opened = ResidualTree(), [], 0
    for size in sorted(counts, reverse=True):
        if size > capacity:
            raise ValueError("an item is larger than a bin")
        left = counts[size]
        while left:
            found = tree.take_at_least(size)
            if found is None:
                if opened == most:
                    return None
                found = (capacity, opened)
                opened += 1
            # a bin that took an item is the tightest still, as long as another one fits
            n = min(left, found[0] // size)
            out.append((size, found[1], n))
            tree.add((found[0] - n * size, found[1]))
            left -= n
    return out


def even_bins(counts: Mapping[int, int], n: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing into ``n`` bins of the least capacity that is enough."""
    if not counts:
        return []
    low = max(max(counts), -(-sum(s * c for s, c in counts.items()) // n))
    high, step = low, 1
    while (best := best_fit_decreasing(counts, high, n)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(counts, middle, n)) is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def _ranked(items: DataFrame, n: int) -> DataFrame:
    """``items`` (bytes, key, part; ``n`` rows) with their rank (from 0) among those of equal bytes."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("key", "part"), F.lit(max(1, n // ROWS_PER_CELL))))
    before = W.partitionBy("bytes").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("bytes", "cell").count()
    offsets = counts.select("bytes", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("bytes", "cell").orderBy("key", "part"))
    return dealt.withColumn("inside", inside).join(offsets, ["bytes", "cell"]).select(
        "bytes", "key", "part", (F.col("offset") + F.col("inside") - 1).alias("rank"))


def _placed(items: DataFrame, n_shards: int, broadcast_rows: int) -> DataFrame:
    """key, part and shard of each item (key, part, bytes)."""
    counts = {r["bytes"]: r["count"] for r in items.groupBy("bytes").count().collect()}
    ones, several, ranks = [], [], {}
    for size, bin_, n in even_bins(counts, n_shards):
        start = ranks.get(size, 0)
        ranks[size] = start + n
        if n == counts[size]:
            ones.append((size, bin_))
        else:
            several.append((size, start, start + n, bin_))
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    frame = items.sparkSession.createDataFrame
    alone = items.join(small(frame(ones, "bytes long, shard int"), len(ones)), "bytes").select("key", "part", "shard")
    shared = frame(several, "bytes long, start long, stop long, shard int")
    sizes = {size for size, *_ in several}
    among = items.join(small(frame([(x,) for x in sizes], "bytes long"), len(sizes)), "bytes")
    ranked = _ranked(among, sum(counts[x] for x in sizes))
    return alone.union(ranked.join(small(shared, len(several)), "bytes").where("rank >= start AND rank < stop").select("key", "part", "shard"))


def shard(docs: DataFrame, n_shards: int = 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, law, shard, slot and grown_shard (null under this law).
    Tables of sizes go to the groups up to ``broadcast_rows`` rows and meet them by shuffle beyond."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    n_rows, share = total["n"] or 0, max(1, (total["bytes"] or 0) // n_shards)
    # fewer than n_shards + 1 groups are larger than a share, fewer than HOT hold more rows than their part: these may be broadcast
    split = groups.where(F.col("bytes") > share).select("key", F.ceil(F.col("bytes") * 8 / share).cast("long").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0).cast("long"))
    keyed = rows.join(F.broadcast(split), "key", "left").withColumn("part", part).drop("parts")
    whole = groups.where(F.col("bytes") <= share).select("key", F.lit(0).cast("long").alias("part"), "bytes")
    pieces = keyed.join(F.broadcast(split), "key", "left_semi").groupBy("key", "part").agg(F.sum("size").alias("bytes"))
    placed = cut(_placed(cut(whole.union(pieces)), n_shards, broadcast_rows))
    hot = F.broadcast(groups.where((F.col("n") > n_rows / HOT) | (F.col("bytes") > share)).select("key"))
    many = keyed.join(hot, "key", "left_semi").join(F.broadcast(placed.join(hot, "key", "left_semi")), ["key", "part"])
    few = keyed.join(hot, "key", "left_anti").join(placed.join(hot, "key", "left_anti"), ["key", "part"])
    sharded = cut(many.unionByName(few))

    cells = max(1, n_rows // (n_shards * ROWS_PER_CELL))
    sharded = sharded.withColumn("cell", F.pmod(F.xxhash64("key", "doc_id"), F.lit(cells)))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = sharded.groupBy("shard", "cell").count()
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return sharded.join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
