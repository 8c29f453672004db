"""The trie of conversation prefixes: sorted shards around a skeleton of splitter paths.

A turn is the 128-bit digest of its role and text; a conversation's path is its digests
end to end, so byte order is the order of paths and a prefix of turns is a prefix of
bytes. Paths are range-partitioned by (path, conv_id): each shard is a stretch of the
sorted table, however often one path occurs.

* **Skeleton.** A node whose members lie in several shards is a prefix of what two
  neighbouring shards share at their border. The trie of the splitter paths is broadcast
  as its shared lengths, one number for each border, whatever the paths' length: with the
  sorted shard at hand this tells each node on its left and right edge whether it goes on
  next door, whether it began there, and what its name (a digest of its prefix) is.
* **Shards.** One streaming pass with a stack, as deep as the path at hand: a conversation
  closes the nodes it does not share with its predecessor. Everything but skeleton nodes
  is finished there.
* **Reduction.** For a skeleton node a shard gives partial sums over its own part of the
  subtree. What counts once is counted by the first shard of a node (being a child, its
  own share of ``saved_tokens``) or the last (being a leaf), so the partial rows of a node
  are simply added up by name.

Texts do not travel, only digests and byte counts; a shuffle moves each path twice (as
turns to their conversation, as paths to their shard) and one row per node.

A conversation's digests (24 bytes a turn) are one row, which bounds a conversation to
some ten million turns; how many conversations share a path or prefix has no bound. The
hash of a node's ends is one sequential SHA-256: where they lie in several shards, their
ids stream in order through one task, a shard's ids at a time.

Rows without conv_id name no conversation and take no part. Turns that share a number
stand in the order of their digests, rows that repeat are turns each. Null and empty role
or text are alike. An empty table has no conversations and gives an empty result, not
even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hyplab.llm.store import cut, ship

WIDTH = 16  # bytes of a digest
GROUP = 5
HEADS = 9
ROWS_PER_SHARD = 20_000
MAX_SHARDS = 4096
BROADCAST_ROWS = 200_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
EMITTED = f"{NODE}, ends_sha256 string, name binary, parent_name binary, ends string, shard long"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and one array of (digest, bytes) in the order of turns. Texts are digested before the shuffle."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct(
            F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return slim.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests end to end) and sizes (bytes of each turn's text) of the rebuilt conversations.

    The first h turns come from conversation c - c % 5, h from the CRC of c's decimal; a
    base serves at most five conversations, so this join has no hot key.
    """
    own = cut(turns(conversations))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    base = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("heads"))
    joined = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(base, "base", "left")
    lead = F.when(F.col("heads").isNotNull(), F.slice("heads", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    whole = F.concat(lead, rest)
    # concat of binaries keeps them binary; array_join would make them text
    return joined.select("conv_id", F.transform(whole, lambda t: t["digest"]).alias("digests"), F.transform(whole, lambda t: t["bytes"]).alias("sizes"))


@dataclass
class Node:
    """A node while its members pass by; ``children`` are closed children whose parent's conv_id is still open."""

    depth: int
    size: int
    left: bool
    conv: int | None = None
    n: int = 0
    n_children: int = 0
    leaves: int = 0
    saved: int = 0
    inner: bool = False
    ends: list[int] = field(default_factory=list)
    children: list[tuple] = field(default_factory=list)


def shared(a: bytes, b: bytes) -> int:
    """How many whole digests two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle
    return low


def names(path: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``depth`` turns."""
    running, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(running.digest()[:WIDTH])
        running.update(path[d * WIDTH : (d + 1) * WIDTH])
    return out


class Shard:
    """The nodes of one sorted shard. ``before`` and ``behind`` are the turns shared over its borders, -1 without one."""

    def __init__(self, number: int, before: int, behind: int) -> None:
        self.number, self.before, self.behind = number, before, behind
        self.stack: list[Node] = []
        self.path = b""
        self.rows: list[tuple] = []

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        depth = len(path) // WIDTH
        first = not self.stack
        if first:
            self.stack.append(Node(0, 0, True))
        else:
            self._close(shared(self.path, path), False)
        for d in range(len(self.stack), depth + 1):
            self.stack.append(Node(d, sizes[d - 1], first))
        top = self.stack[-1]
        top.ends.append(conv)
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        self.path = path

    def finish(self) -> None:
        if self.stack:
            self._close(-1, True)

    def _close(self, upto: int, at_border: bool) -> None:
        """Close the open nodes deeper than ``upto``."""
        if len(self.stack) - 1 <= upto:
            return
        ours = [d for d in range(upto + 1, len(self.stack)) if self._began_before(self.stack[d]) or self._goes_on(self.stack[d], at_border)]
        # skeleton nodes are prefixes of the others, so the deepest one bounds the names that are needed
        called = names(self.path, max(ours)) if ours else []
        while len(self.stack) - 1 > upto:
            v = self.stack.pop()
            again, on = self._began_before(v), self._goes_on(v, at_border)
            skeleton = again or on
            leaves = v.leaves + (not v.inner and not on)
            saved = v.saved + v.n * v.size - (0 if again else v.size)
            ends = ",".join(map(str, v.ends))
            mine = (v.conv, v.depth, v.n, v.n_children, leaves, saved)
            for child in v.children:
                self._emit(child, *((None, called[v.depth]) if skeleton else (v.conv, None)))
            if skeleton:
                above = called[v.depth - 1] if v.depth else None
                c, d, *rest = mine
                self.rows.append((c, d, None, *rest, None, called[v.depth], above, ends if v.ends else None, self.number))
            row = (*mine, hashlib.sha256(ends.encode()).hexdigest())
            if self.stack:
                p = self.stack[-1]
                p.conv = v.conv if p.conv is None else min(p.conv, v.conv)
                p.n += v.n
                p.n_children += not again
                p.leaves += leaves
                p.saved += saved
                p.inner = True
                if not skeleton:
                    p.children.append(row)
            elif not skeleton:
                self._emit(row, None, None)

    def _began_before(self, v: Node) -> bool:
        return v.left and v.depth <= self.before

    def _goes_on(self, v: Node, at_border: bool) -> bool:
        return at_border and v.depth <= self.behind

    def _emit(self, row: tuple, parent: int | None, parent_name: bytes | None) -> None:
        conv, depth, n, n_children, leaves, saved, digest = row
        self.rows.append((conv, depth, parent, n, n_children, leaves, saved, digest, None, parent_name, None, self.number))


def _sorted_shards(paths: DataFrame) -> DataFrame:
    """``paths`` sorted over shards of about ROWS_PER_SHARD rows, with ``shard`` numbered in order (some may be missing)."""
    rows = paths.count()
    shards = max(1, min(MAX_SHARDS, -(-rows // ROWS_PER_SHARD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([me] * b.num_rows, pa.int64())], ["conv_id", "path", "sizes", "shard"])

    dealt = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return cut(dealt.select("conv_id", "path", "sizes").mapInArrow(run, "conv_id long, path binary, sizes array<long>, shard long"))


def _borders(sharded: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the turns shared with the shard before it and behind it: the trie of the splitter paths.

    Neighbouring edges meet two by two; the driver sees three numbers a border, at most MAX_SHARDS of them
    (or as many as the session has shuffle partitions).
    """
    held = sorted(r["shard"] for r in sharded.select("shard").distinct().collect())
    if len(held) < 2:
        return {s: (-1, -1) for s in held}
    spark = sharded.sparkSession
    order = spark.createDataFrame(list(zip(held, range(len(held)))), "shard long, place long")
    edges = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).join(F.broadcast(order), "shard")
    ends = edges.select(F.col("place").alias("border"), F.col("last").alias("path"))
    starts = edges.select((F.col("place") - 1).alias("border"), F.col("first").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [shared(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["border", "n"])

    met = ends.join(starts, "border").select("border", "path", "next").mapInArrow(run, "border long, n long")
    n = {r["border"]: r["n"] for r in met.collect()}
    return {s: (n.get(i - 1, -1), n.get(i, -1)) for i, s in enumerate(held)}


def _shard_nodes(sharded: DataFrame) -> DataFrame:
    """What the shards give: finished nodes (without name), and partial rows of skeleton nodes (with name)."""
    skeleton = sharded.sparkSession.sparkContext.broadcast(_borders(sharded))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
        fields = [x.split()[0] for x in EMITTED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for conv, path, sizes, number in zip(*(c.to_pylist() for c in b.columns)):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                        yield batch_of(shard.rows)
                    shard = Shard(number, *skeleton.value[number])
                shard.add(conv, path, sizes)
                if len(shard.rows) >= 10_000:
                    yield batch_of(shard.rows)
                    shard.rows = []
        if shard is not None:
            shard.finish()
            yield batch_of(shard.rows)

    ship(sharded.sparkSession)
    return sharded.select("conv_id", "path", "sizes", "shard").mapInArrow(run, EMITTED)


def _hashed_ends(partial: DataFrame) -> DataFrame:
    """name and ends_sha256: the ids of a node's ends run in order, shard by shard, through one SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, done = None, None, []
        for b in batches:
            for name, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != now:
                    if now is not None:
                        done.append((now, running.hexdigest()))
                    now, running = name, hashlib.sha256(ends.encode())
                else:
                    running.update(b"," + ends.encode())
        if now is not None:
            done.append((now, running.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], ["name", "ends_sha256"])

    held = partial.where("ends IS NOT NULL").select("name", "ends", "shard")
    return held.repartition("name").sortWithinPartitions("name", "shard").select("name", "ends").mapInArrow(run, "name binary, ends_sha256 string")


def _joined_paths(conversations: DataFrame) -> DataFrame:
    """``rebuilt`` with the digests of a conversation as one binary, its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = pa.array([b"".join(x) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), paths, b.column(2)], ["conv_id", "path", "sizes"])

    return rebuilt(conversations).mapInArrow(run, "conv_id long, path binary, sizes array<long>")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    emitted = cut(_shard_nodes(_sorted_shards(cut(_joined_paths(conversations)))))
    fields = [*(x.split()[0] for x in NODE.split(", ")), "ends_sha256"]
    done = emitted.where("name IS NULL AND parent_name IS NULL").select(*fields)
    partial = emitted.where("name IS NOT NULL")
    reduced = partial.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_name").alias("parent_name"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    skeleton = cut(reduced.join(_hashed_ends(partial), "name", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)))
    known = skeleton.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    # the skeleton has at most (shards x shared turns) nodes; beyond a checked size it meets by shuffle
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    waiting = emitted.where("name IS NULL AND parent_name IS NOT NULL").drop("parent_conv_id").join(known, "parent_name").select(*fields)
    return done.unionByName(waiting).unionByName(skeleton.join(known, "parent_name", "left").select(*fields))
