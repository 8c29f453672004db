"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Components are taken as floor(256 * x). Rows are sorted along a Hilbert curve over all
dimensions (two bits each) and written to Parquet as blocks: a block is one Parquet row
with its vectors, labels and ids, and for each dimension the least and greatest value.
The inner product of an anchor with any row of a block lies between

    sum(min(a * low, a * high))  and  sum(max(a * low, a * high)),

so a window of wanted scores names the blocks that must be read, and no others are.

1. **Positives.** The anchor's own block, read where blocks are cut, gives a fifth best
   score among rows of its label; only blocks that can reach it are read.
2. **Floors.** The five windows of an anchor are searched in its own block first, which
   mostly fills them and raises their lower ends.
3. **Negatives.** Blocks whose bounds meet a window are read; strips inside a block have
   zone maps of their own and are scored only for anchors that need them.

The zone map has at most 2 * MAX_BLOCKS rows whatever the table, since blocks grow with
it, and is broadcast; anchors travel to the blocks they need in slabs of bounded size, so
a task holds one block and one slab, however frequent a label or vector. Scores are exact
integers (floats only where every sum fits their mantissa).

Rows with a null label or vector, with a null or non-finite component, or without vec_id
take no part. Rows alike in vec_id, label and vector are one; rows that share only a vec_id
are different rows. Shorter vectors end in zeros; an empty one scores 0. Components beyond
+-16384 count as that. Scores that tie stand by vec_id. An anchor without positives, or a
window without rows, gives no result; an empty table gives an empty one. Columns other
than vec_id, label and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from hyplab.llm.store import cut, ensure_checkpoint_dir, ship

SCALE, LIMIT = 256, 1 << 22
CURVE_BITS = 2
MIN_BLOCK_ROWS, MAX_BLOCKS = 1024, 8192
STRIP = 128
SLAB = 1 << 15
BEST = 5
CELLS = 1 << 21  # scores held at once
LOW, HIGH = -(1 << 62), 1 << 62

BLOCK = "block long, n int, low binary, high binary, ids binary, labels binary, vectors binary, at array<int>, floors array<long>"
WINDOW = "array<struct<key: long, low: long, high: long>>"
ASK = f"vec_id long, label int, vector binary, home long, windows {WINDOW}"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each row of ``cells`` (unsigned, below 2 ** bits) on the Hilbert curve, as bytes that sort alike.

    Gray-code walk over the axes, high bits first: each level undoes the turns of the
    ones above it (exchange or inversion of the low bits against the first axis).
    """
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    if n == 0:
        return [b""] * len(cells)
    for level in range(bits - 1, 0, -1):
        q, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(flip, below, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] >> np.uint32(level) & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)])  # bits, axes, rows
    packed = np.packbits(planes.reshape(bits * n, -1).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T, by floats where every partial sum fits their mantissa."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between ``low`` and ``high`` (rows: zones)."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return product(plus, low) + product(minus, high), product(plus, high) + product(minus, low)


def meets(lower: np.ndarray, upper: np.ndarray, windows: list[list[dict]]) -> np.ndarray:
    """Which zones (columns) each ask (row) must read for one of its windows."""
    out = np.zeros(lower.shape, bool)
    for i, wins in enumerate(windows):
        for w in wins:
            out[i] |= (upper[i] >= w["low"]) & (lower[i] <= w["high"])
    return out


def rows_of(column: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dims)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then rising id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def quantised(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Distinct rows that take part: vec_id, label and vector (array of int); and the number of dimensions."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(fine)
    rows = cut(rows.select("vec_id", F.col("label").cast("int").alias("label"), scaled.alias("vector")).distinct())
    return rows, rows.agg(F.max(F.size("vector"))).first()[0] or 0


@dataclass(frozen=True)
class Blocks:
    """The candidate table on shared storage and its zone map."""

    table: DataFrame
    dims: int
    names: np.ndarray
    low: np.ndarray
    high: np.ndarray


def write_blocks(rows: DataFrame, dims: int, every: int) -> Blocks:
    """Sort ``rows`` along the curve and write them as blocks; rows with an id divisible by ``every`` are anchors."""
    spark = rows.sparkSession
    n = rows.count()
    block_rows = max(MIN_BLOCK_ROWS, -(-n // MAX_BLOCKS))
    span = rows.select(F.explode("vector").alias("x")).agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    least, width = span["a"] or 0, max(1, (span["b"] or 0) - (span["a"] or 0) + 1)
    ship(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = np.zeros((b.num_rows, dims), np.int64)
            for i, v in enumerate(b.column(2).to_pylist()):
                full[i, : len(v)] = v
            keys = hilbert_keys(((full - least) * (1 << CURVE_BITS) // width).clip(0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            vectors = [r.tobytes() for r in full.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary()), pa.array(keys, pa.binary())],
                                             ["vec_id", "label", "vector", "curve"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, held = TaskContext.get().partitionId() << 32, None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= block_rows:
                yield made(held.slice(0, block_rows), name)
                held, name = held.slice(block_rows), name + 1
        if held is not None and held.num_rows:
            yield made(held, name)

    def made(part: pa.Table, name: int) -> pa.RecordBatch:
        ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
        x = rows_of(part["vector"].to_pylist(), dims)
        at = np.flatnonzero(ids % every == 0)
        floors = []
        for i in at:  # the fifth best score in the anchor's own block bounds its fifth positive from below
            own = product(x[i : i + 1], x)[0][(labels == labels[i]) & (np.arange(len(ids)) != i)]
            floors.append(int(np.partition(own, len(own) - BEST)[len(own) - BEST]) if len(own) >= BEST else LOW)
        columns = [pa.array([name]), pa.array([len(ids)], pa.int32()), *(
            pa.array([v.astype(kind).tobytes()], pa.binary())
            for v, kind in ((x.min(0), "<i4"), (x.max(0), "<i4"), (ids, "<i8"), (labels, "<i4"), (x, "<i4"))),
            pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([floors], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCK.split(", ")])

    placed = rows.mapInArrow(keyed, "vec_id long, label int, vector binary, curve binary")
    order = ("curve", "vec_id", "label", "vector")
    # a few blocks a partition; equal vectors are told apart by vec_id, so no partition is hot
    parts = max(1, -(-n // (4 * block_rows)))
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/blocks-{uuid4().hex}"
    dealt.mapInArrow(blocked, BLOCK).write.option("parquet.block.size", 1 << 24).parquet(path)
    table = spark.read.schema(BLOCK).parquet(path)
    zones = table.select("block", "low", "high").collect()  # at most MAX_BLOCKS and one a partition
    return Blocks(table, dims, np.array([z["block"] for z in zones], np.int64),
                  rows_of([bytes(z["low"]) for z in zones], dims), rows_of([bytes(z["high"]) for z in zones], dims))


def anchors(blocks: Blocks) -> DataFrame:
    """vec_id, label, vector, home (their block) and one open window from the floor their block gives."""
    dims = blocks.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if not r["at"]:
                    continue
                at = np.array(r["at"])
                x = np.frombuffer(r["vectors"], "<i4").reshape(r["n"], dims)[at]
                wins = [[{"key": 0, "low": f, "high": HIGH}] for f in r["floors"]]
                yield pa.RecordBatch.from_arrays(
                    [np.frombuffer(r["ids"], "<i8")[at], pa.array(np.frombuffer(r["labels"], "<i4")[at]), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array([r["block"]] * len(at), pa.int64()), pa.array(wins, _window_type())],
                    ["vec_id", "label", "vector", "home", "windows"])

    return blocks.table.select("block", "n", "ids", "labels", "vectors", "at", "floors").mapInArrow(run, ASK)


def _window_type() -> pa.DataType:
    return pa.list_(pa.struct([pa.field(f, pa.int64()) for f in ("key", "low", "high")]))


def chosen(asks: DataFrame, blocks: Blocks) -> DataFrame:
    """``asks`` once for every block that one of their windows must read, with its ``block``."""
    shared = asks.sparkSession.sparkContext.broadcast((blocks.names, blocks.low, blocks.high))
    dims = blocks.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = shared.value
        step = max(1, CELLS // max(1, len(names)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                lower, upper = bounds(rows_of(part.column(2).to_pylist(), dims), low, high)
                ask, zone = np.nonzero(meets(lower, upper, part.column(4).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(ask)).columns, pa.array(names[zone])],
                                                 ["vec_id", "label", "vector", "home", "windows", "block"])

    return asks.mapInArrow(run, f"{ASK}, block long")


def searched(asks: DataFrame, blocks: Blocks, same: bool) -> DataFrame:
    """vec_id, label, vector, home, key, found and score: in each window of an ask the first rows of its block.

    ``asks`` has a ``block``; ``same`` asks for rows of the ask's label (but itself), else for those of others.
    Asks are dealt in slabs, and a block comes once for each slab that names it.
    """
    slabs = max(1, -(-asks.count() // (SLAB * max(1, len(blocks.names)))))
    slab = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(slabs)).cast("int")
    dealt = asks.withColumn("slab", slab)
    wanted = dealt.select(F.col("block").alias("of"), F.col("slab").alias("part")).distinct()
    read = blocks.table.select("block", "n", "ids", "labels", "vectors").join(wanted, F.col("block") == F.col("of"))
    dims = blocks.dims

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]  # ask, key, found, score
        rows = left.num_rows
        if rows and right.num_rows:
            r = {c: right[c][0].as_py() for c in ("n", "ids", "labels", "vectors")}
            ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i4")
            x = np.frombuffer(r["vectors"], "<i4").reshape(r["n"], dims)
            at = np.arange(0, r["n"], STRIP)
            low, high = (np.stack([f(x[i : i + STRIP], 0) for i in at]) for f in (np.min, np.max))
            ask_ids, ask_labels = left["vec_id"].to_numpy(), left["label"].to_numpy()
            asked, windows = rows_of(left["vector"].to_pylist(), dims), left["windows"].to_pylist()
            for a in range(0, rows, step := max(1, CELLS // r["n"])):
                need = meets(*bounds(asked[a : a + step], low, high), windows[a : a + step])
                use = np.flatnonzero(np.repeat(need.any(0), STRIP)[: r["n"]])
                scores = product(asked[a : a + step], x[use])
                u_ids, u_labels = ids[use], labels[use]
                for i in range(a, min(a + step, rows)):
                    s = scores[i - a]
                    good = (u_labels == ask_labels[i]) == same
                    if same:
                        twin = np.flatnonzero(good & (u_ids == ask_ids[i]))
                        good[twin[(x[use[twin]] == asked[i]).all(1)]] = False
                    for w in windows[i]:
                        hit = np.flatnonzero(good & (s >= w["low"]) & (s <= w["high"]))
                        hit = hit[best(s[hit], u_ids[hit], BEST)]
                        for column, values in zip(out, ([i] * len(hit), [w["key"]] * len(hit), u_ids[hit].tolist(), s[hit].tolist())):
                            column += values
        took = left.select(["vec_id", "label", "vector", "home"]).take(pa.array(out[0], pa.int64()))
        for field, values in zip(("key", "found", "score"), out[1:]):
            took = took.append_column(field, pa.array(values, pa.int64()))
        return took

    schema = "vec_id long, label int, vector binary, home long, key long, found long, score long"
    return dealt.groupBy("block", "slab").cogroup(read.groupBy("of", "part")).applyInArrow(run, schema)


def _first(found: DataFrame) -> DataFrame:
    """The first rows of each window over all blocks, with their rank: a block gives at most BEST of them."""
    order = W.partitionBy("vec_id", "label", "vector", "key").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def positives(blocks: Blocks) -> DataFrame:
    """Anchors with their first rows of the same label: vec_id, label, vector, home, rank, found and score."""
    asks = cut(chosen(anchors(blocks), blocks))
    return _first(searched(asks, blocks, same=True)).drop("key")


def negatives(found: DataFrame, blocks: Blocks, least_percent: int = 80) -> DataFrame:
    """For each of ``positives`` the first rows of other labels that score between ``least_percent`` of it and it.

    vec_id, label, vector, key (rank of the positive), found, score and rank.
    """
    # 100 * score >= least_percent * positive, in whole numbers; for a negative positive the window is empty
    low = F.expr(f"-((-{least_percent} * score - pmod(-{least_percent} * score, 100L)) div 100)")
    window = F.struct(F.col("rank").cast("long").alias("key"), low.alias("low"), F.col("score").alias("high"))
    asks = cut(found.where("score >= 0").groupBy("vec_id", "label", "vector", "home").agg(F.collect_list(window).alias("windows")))
    near = searched(asks.withColumn("block", F.col("home")), blocks, same=False)
    floors = near.groupBy("vec_id", "label", "vector", "key").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == BEST)
    known = floors.groupBy("vec_id", "label", "vector").agg(F.map_from_entries(F.collect_list(F.struct("key", "floor"))).alias("floors"))
    raised = F.transform("windows", lambda w: F.struct(
        w["key"].alias("key"), F.greatest(w["low"], F.coalesce(F.col("floors")[w["key"]], w["low"])).alias("low"), w["high"].alias("high")))
    asks = asks.join(known, ["vec_id", "label", "vector"], "left").withColumn("windows", raised).select("vec_id", "label", "vector", "home", "windows")
    return _first(searched(cut(chosen(asks, blocks)), blocks, same=False))


def mine(table: DataFrame, every: int = 100, least_percent: int = 80, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows with an id divisible by ``every``."""
    rows, dims = quantised(table, vector)
    if rows.isEmpty():
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = write_blocks(rows, dims, every)
    found = cut(positives(blocks))
    hard = negatives(found, blocks, least_percent).select(
        "vec_id", "label", "vector", F.col("key").cast("int").alias("place"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    paired = hard.join(found.select("vec_id", "label", "vector", F.col("rank").alias("place"), "found", "score"), ["vec_id", "label", "vector", "place"])
    return paired.select(
        F.col("vec_id").alias("anchor_id"), F.col("found").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
