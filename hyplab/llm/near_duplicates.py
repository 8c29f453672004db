"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, then exact checks.

A document is its set of distinct five-word shingles. Its signature holds 48 lanes,
each the least value of one hash function over the set, cut to 16 bits. Two
signatures differ in as many lanes as MinHash draws differ, on average 48 * (1 - J).

* **Multi-index join.** Twelve chunks of four lanes; signatures that differ in at most
  23 lanes agree, in some chunk, in all lanes but one at most (pigeonhole). Every chunk
  therefore enters four keys, each with one lane left out: the allowed chunk errors.
  All pairs under the threshold meet in a key. At a similarity of 0.75 a pair differs
  in more than 23 lanes and meets nowhere with a chance of 1 in 10 million; above it
  far less.
* **First links.** Members of a key are compared with one leading member, not with each
  other, and pairs that pass in size and signature are confirmed on their full sets.
  That links groups of copies of any size by one row per member. The leader is the member
  that shares most keys with most others, so that a group of edited copies is linked around
  what all of them were. A second turn does the same for components: one member of each
  component in a key with one of its largest.
* **The rest of a key.** Keys whose members are still in several components could hide
  a link. Their documents (and only these) are compared by rare shingles: two sets of
  the wanted similarity share one of their rarest quarter, at a place early enough for
  the overlap that is still possible. Frequent shingles are counted exactly, the others by
  cells of a hash. What remains is confirmed on full sets, too.

Identical sets are one class from the start, so copies are never compared. No key,
bucket or candidate list is capped.

Null and empty texts have an empty set and are linked with nothing. A text of fewer
than five words is one shingle. Rows that share a doc_id and text are the same
document; rows that share only a doc_id are two. A row without doc_id never names a
component; it is kept only where no member has a doc_id. Other columns are ignored; an empty table gives an empty
result; very long texts are worked whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hyplab.llm import kernels as K
from hyplab.llm.components import stars
from hyplab.llm.store import cut, snug

WORDS = 5
SIMILAR = 75  # percent
CHUNKS, PER_CHUNK = 12, 4
LANES = CHUNKS * PER_CHUNK
MAX_DISTANCE = 2 * CHUNKS - 1
RARITY_BITS = 18
OFTEN, EXACT = 16, 1 << 17  # from which count a shingle may be counted exactly, and how many at most are
SLIM_ROWS, TEXT_ROWS = 200_000, 10_000  # rows of a partition, without and with texts
TURNS = 2

_draw = np.random.default_rng(48)
_FACTOR = _draw.integers(0, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _draw.integers(0, 2**63, LANES, dtype=np.uint64)


def sets_of(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    start, end, at = block.words()
    hashes = K.Block.span_hash(block.prefix(K.LOWER), start, end)
    wins, w_at = K.windows(hashes, at, WORDS)
    out = []
    for d in range(block.n):
        if w_at[d + 1] > w_at[d]:
            out.append(np.unique(wins[w_at[d] : w_at[d + 1]]))
        elif at[d + 1] > at[d]:
            few = hashes[at[d] : at[d + 1]] * np.arange(3, 3 + at[d + 1] - at[d], dtype=np.uint64)
            out.append(K.mix(np.array([few.sum()], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = [len(x) for x in out]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def set_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(values), dtype=np.uint64)])
    return K.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def chunks_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signature of each set (none may be empty) as CHUNKS numbers of four 16-bit lanes."""
    out = np.zeros((len(at) - 1, CHUNKS), np.uint64)
    for lane in range(LANES):
        least = np.minimum.reduceat((values ^ _SHIFT[lane]) * _FACTOR[lane], at[:-1])
        out[:, lane // PER_CHUNK] |= (K.mix(least) >> np.uint64(48)) << np.uint64(16 * (lane % PER_CHUNK))
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (name of the set, null when empty), the signature's chunks and hash (of the text)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            values, at = sets_of(block)
            n = np.diff(at)
            full = n > 0
            sig: list = [None] * block.n
            if full.any():
                for d, x in zip(np.flatnonzero(full), chunks_of(values, np.append(at[:-1][full], at[-1]))):
                    sig[d] = x
            yield {
                "doc_id": batch.column(0).slice(row, block.n), "n_shingles": n,
                "node": pa.array(set_ids(values, at), mask=~full), "chunks": pa.array(sig, pa.list_(pa.int64())),
                "hash": batch.column(2).slice(row, block.n),
            }

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    return K.map_batches(keyed, ["doc_id", "text", "hash"], "doc_id long, n_shingles long, node long, chunks array<long>, hash long", run)


def _keys(chunks: Column) -> Column:
    out = []
    for c in range(CHUNKS):
        for lane in range(PER_CHUNK):
            hole = ~(0xFFFF << (16 * lane)) & 0xFFFFFFFFFFFFFFFF
            signed = hole - (1 << 64) if hole >> 63 else hole
            out.append(F.xxhash64(F.lit(c * PER_CHUNK + lane), F.get(chunks, F.lit(c)).bitwiseAND(F.lit(signed))))
    return F.array(*out)


def distance(a: Column, b: Column) -> Column:
    """In how many lanes two signatures differ."""
    total = F.lit(0)
    for c in range(CHUNKS):
        x = F.get(a, F.lit(c)).bitwiseXOR(F.get(b, F.lit(c)))
        for step in (8, 4, 2, 1):  # fold every lane into its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    side = lambda x: classes.select(
        F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("chunks").alias(f"c_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR
    return near.where(sizes).where(distance(F.col("c_a"), F.col("c_b")) <= MAX_DISTANCE).select("a", "b")


def _each_set(column: pa.Array) -> Iterator[np.ndarray]:
    for _, block in K.blocks(column):
        values, at = sets_of(block)
        for d in range(block.n):
            yield values[at[d] : at[d + 1]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of two sorted sets."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * SIMILAR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= (len(a) + len(b) - both) * SIMILAR


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        good = np.fromiter(
            (similar(x, y) for x, y in zip(_each_set(batch.column(2)), _each_set(batch.column(3)))), bool, batch.num_rows)
        yield {"a": batch.column(0).filter(pa.array(good)), "b": batch.column(1).filter(pa.array(good))}

    return K.map_batches(rows, ["a", "b", "t_a", "t_b"], "a long, b long", run)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text per wanted class; ``nodes`` has node and the doc_id (or null) and text hash of a member."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        names = np.concatenate([set_ids(*sets_of(b)) for _, b in K.blocks(batch.column(0))] or [np.zeros(0, np.int64)])
        good = pa.array(names == batch.column(1).to_numpy(zero_copy_only=False))
        yield {"node": batch.column(1).filter(good), "text": batch.column(0).filter(good)}

    named = nodes.select("node", F.col("hash").alias("_hash"), F.col("doc_id").alias("_doc"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = rows.join(named, (F.col("hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    found = K.map_batches(rows, ["text", "node"], "node long, text string", run)
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _frequencies(rest: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often shingles occur in ``rest``: shingles (sorted) that are counted exactly, and counts of hash cells without those.

    Both have a fixed largest size. Only shingles of crowded cells are counted one by one, so
    that a passage which many documents share is known to be frequent however full the cells are.
    """
    shift = np.uint64(64 - RARITY_BITS)

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, block in K.blocks(batch.column(0)):
            cell, n = np.unique((sets_of(block)[0] >> shift).astype(np.int32), return_counts=True)
            yield {"cell": cell, "n": n}

    cells = np.zeros(1 << RARITY_BITS, np.int64)
    for r in K.map_batches(rest, ["text"], "cell int, n long", count).groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        cells[r["cell"]] = r["n"]
    crowded = rest.sparkSession.sparkContext.broadcast(cells >= max(OFTEN, 4 * int(cells.mean())))

    def single(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, block in K.blocks(batch.column(0)):
            values = sets_of(block)[0]
            value, n = np.unique(values[crowded.value[(values >> shift).astype(np.int64)]], return_counts=True)
            yield {"shingle": value.view(np.int64), "n": n}

    exact = K.map_batches(rest, ["text"], "shingle long, n long", single).groupBy("shingle").agg(F.sum("n").alias("n"))
    top = exact.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(EXACT).collect()
    known = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    np.subtract.at(cells, (known >> shift).astype(np.int64), n)  # what is left is the rest of a cell
    order = np.argsort(known)
    return cells, known[order], n[order]


def _rare_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a rare shingle early enough.

    ``rest`` has node, root and text. Any order of shingles that is the same for all sets gives
    every pair; the better it follows their counts, the fewer sets meet in vain.
    """
    shift = np.uint64(64 - RARITY_BITS)
    shared = rest.sparkSession.sparkContext.broadcast(_frequencies(rest))

    def frequency(values: np.ndarray) -> np.ndarray:
        cells, known, n = shared.value
        out = cells[(values >> shift).astype(np.int64)]
        if len(known):  # what is known to be frequent comes after all others
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            out = np.where(known[at] == values, n[at] + cells.max(), out)
        return out

    def rare(batch: pa.RecordBatch) -> Iterator[dict]:
        row = 0
        for values in _each_set(batch.column(2)):
            first = len(values) - -(-len(values) * SIMILAR // 100) + 1
            order = np.lexsort((values, frequency(values)))[:first]
            m = len(order)
            yield {
                "shingle": values[order].view(np.int64), "place": np.arange(m), "n": np.full(m, len(values)),
                "node": np.full(m, batch.column(0)[row].as_py()), "root": np.full(m, batch.column(1)[row].as_py()),
            }
            row += 1

    rows = cut(K.map_batches(rest, ["node", "root", "text"], "shingle long, place long, n long, node long, root long", rare))
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    rows = rows.join(mixed, "shingle")
    side = lambda x: rows.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("place", "n", "node", "root")])
    possible = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    # overlap * 100 >= (n_a + n_b - overlap) * SIMILAR
    enough = possible * (100 + SIMILAR) >= (F.col("n_a") + F.col("n_b")) * SIMILAR
    met = side("a").join(side("b"), "shingle").where("node_a < node_b AND root_a <> root_b").where(enough)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _placed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, company and root (the node itself where it has no links yet)."""
    if roots is None:
        return members.select("key", "node", "company", F.col("node").alias("root"))
    return members.join(roots, "node", "left").select("key", "node", "company", F.coalesce("root", "node").alias("root"))


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _spokes(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): in each key one member of every component with one member of its largest component.

    Rows are linear in ``placed``. The first turn draws the member with most company (the sum of
    members over its keys): among edited copies that is the one nearest to what all of them were,
    and most others are similar to it. Each further turn draws other members.
    """
    draw = F.struct(F.xxhash64("node", F.lit(turn)) if turn else -F.col("company"), "node")
    drawn = placed.groupBy("key", "root").agg(F.min_by("node", draw).alias("node"), F.count("*").alias("n"), F.max("company").alias("company"))
    # where components are equally large, the same one should lead in many keys
    lead = F.max(F.struct("n", "company", "root", "node"))
    hubs = drawn.groupBy("key").agg(lead.alias("hub"), F.count("*").alias("k")).where("k > 1")
    pairs = drawn.join(hubs.select("key", F.col("hub.node").alias("a"), F.col("hub.root").alias("hub")), "key")
    return pairs.where("root <> hub").select("a", F.col("node").alias("b")).distinct()


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``docs`` and, per set: node, the least doc_id that holds it, and root (the same in a component)."""
    sigs = cut(signatures(docs))
    classes = cut(
        sigs.where("node IS NOT NULL").groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")).alias("m"),
             F.first("n_shingles").alias("n_shingles"), F.first("chunks").alias("chunks"))
        .select("node", "m.doc_id", "m.hash", "n_shingles", "chunks")
    )
    keys = classes.select("node", F.explode(_keys(F.col("chunks"))).alias("key"))
    heads = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(heads, "key")
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    members = snug(cut(shared.select("key", "node").join(company, "node")), SLIM_ROWS)
    involved = members.select("node").distinct().join(classes.select("node", "doc_id", "hash"), "node")
    texts = snug(cut(_texts(docs, involved)), TEXT_ROWS)

    roots = None
    for turn in range(TURNS):
        linked = confirm(_plausible(_spokes(_placed(members, roots), turn), classes), texts)
        roots = stars(linked if roots is None else linked.union(_edges(roots)))

    placed = snug(cut(_placed(members, roots)), SLIM_ROWS)
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = cut(placed.join(mixed, "key").select("node", "root").distinct().join(texts, "node"))
    rest = snug(rest, TEXT_ROWS)
    more = cut(confirm(_rare_pairs(rest), texts))
    if more.limit(1).count():
        roots = stars(more.union(_edges(roots)))

    return sigs, classes.select("node", "doc_id").join(roots, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, hash (xxhash64 of the text) and root, the same for all near duplicates; texts without words have no row."""
    sigs, rooted = _linked(docs)
    return sigs.select("doc_id", "hash", "node").distinct().join(rooted.select("node", "root"), "node").select("doc_id", "hash", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept and hash (xxhash64 of the text), one row per row of ``docs``."""
    sigs, rooted = _linked(docs)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = rooted.join(least, "root").select("node", "component_id")
    return sigs.select("doc_id", "n_shingles", "node", "hash").join(names, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"), "hash")
