"""SimHash fingerprints of documents and the search for near ones, in DataFrame functions only.

Terms are pairs of neighbouring words (a single word where a text has one); a term
weighs as often as it occurs. Each occurrence's 64-bit hash votes on 64 signed bits. Two bits share
a sum: the low and the high half of a long count bits j and j + 32, so 32 sums carry all
votes. Rows are dealt by ranges of doc_id once, with their texts; the next document,
the edited text and all votes are worked where the row is, without another shuffle.

``near`` finds fingerprints within a Hamming radius by permuted block tables: 64 bits
in six blocks; fingerprints at most three bits apart agree in three whole blocks, so
one of the twenty choices of three blocks, moved to the front, is an equality key.

Null texts count as empty; a text without words has fingerprint 0. doc_id is taken as
a key: rows that share one are neighbours in the order of their text's hash and are
worked by one task; rows without doc_id come last, spread by that hash. Rows that
repeat are fingerprinted each for itself. A single document is its own next one. Very
long texts are worked whole (sums hold 2**31 terms), an empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hyplab.llm.store import cut
from hyplab.operators.ordering import bucket_of, split_points

HALF = 32
RANGES = 256
ROWS_PER_CELL = 1000
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 3


def terms(text: Column) -> Column:
    """64-bit hashes of neighbouring word pairs, one for each occurrence."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))),
                       lambda a, b: F.xxhash64(a, b))
    return pairs


def _votes(term: Column) -> list[Column]:
    one = F.lit(0x0000000100000001)
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(one)).alias(f"_v{j}") for j in range(HALF)]


def _fingerprint(n: Column) -> Column:
    bits = []
    for j in range(HALF):
        v = F.col(f"_v{j}")
        for place, ones in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + HALF, F.shiftrightunsigned(v, HALF))):
            bits.append(F.when(ones * 2 > n, F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0)).cast("long")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _cells(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with _cell, rising with falling doc_id (then falling _h), and the text's hash _h."""
    n = docs.count()
    per = max(1, -(-n // (RANGES * ROWS_PER_CELL)))
    points = split_points(docs, "doc_id", RANGES)
    ends = [float(x) for x in (points or [0.0])]
    step = bucket_of(F.col("doc_id"), ends)
    low = F.element_at(F.array(*[F.lit(x) for x in [ends[0], *ends]]), step + 1)
    high = F.element_at(F.array(*[F.lit(x) for x in [*ends, ends[-1] + 1]]), step + 1)
    inner = F.greatest(F.lit(0), F.least(F.lit(per - 1), F.floor((F.col("doc_id") - low) * per / F.greatest(high - low, F.lit(1.0)))))
    cell = F.when(F.col("doc_id").isNull(), F.lit(1 << 40) - F.shiftright("_h", 56)).otherwise(-(step.cast("long") * per + inner))
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    return hashed.withColumn("_cell", cell.cast("long"))


def _firsts(rows: DataFrame, value: str) -> DataFrame:
    """For each cell the ``value`` of the next cell's first row, after the last cell the first one's. ``rows`` have _row
    (from 1) in their cell. Only cell numbers are ordered; values travel from one cell to the one before."""
    firsts = rows.where(F.col("_row") == 1).select(F.col("_cell").alias("_after"), F.col(value).alias("_first"))
    over = W.orderBy("_cell")  # one number per cell
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    follows = rows.where(F.col("_row") == 1).select("_cell").select(
        "_cell", F.coalesce(F.lead("_cell").over(over), F.first("_cell").over(whole)).alias("_after"))
    return firsts.hint("merge").join(follows, "_after").select("_cell", "_first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp (long), near_edited and near_next for each document.

    The edited text has its last third replaced by the beginning of the next document
    in falling order of doc_id (after the last, the first).
    """
    placed = _cells(docs)
    falling = [F.col("doc_id").desc_nulls_last(), F.col("_h").desc()]
    in_cell = W.partitionBy("_cell").orderBy(*falling)
    ordered = placed.withColumns({"_row": F.row_number().over(in_cell), "_next": F.lead("text").over(in_cell)})
    rows = ordered.join(_firsts(ordered, "text").hint("merge"), "_cell", "left").select(
        "_cell", "_row", "doc_id", "text", F.coalesce("_next", "_first").alias("_next"), F.char_length("text").cast("long").alias("n_chars"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = (F.col("n_chars") - third).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("_next", F.lit(1), third))
    rows = rows.select("_cell", "_row", "doc_id", "n_chars", "text", edited.alias("_edited"))
    sides = rows.select(
        "_cell", "_row", "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("_edited").alias("t")))).alias("s"))
    each = sides.select("_cell", "_row", "doc_id", "n_chars", "edited_sha256", "s.side", F.explode_outer(terms(F.col("s.t"))).alias("_term"))
    row = ["_cell", "_row", "doc_id", "n_chars", "edited_sha256"]
    votes = each.groupBy(*row, "side").agg(F.count("_term").alias("_n"), *_votes(F.col("_term")))
    voted = votes.select(*row, "side", _fingerprint(F.col("_n")).alias("fp"))
    made = cut(voted.groupBy(*row).agg(
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")))
    following = F.coalesce(F.lead("fp").over(W.partitionBy("_cell").orderBy("_row")), F.col("_first"))
    return made.join(_firsts(made, "fp"), "_cell", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), following).alias("near_next"))


def _tables(fp: Column) -> Column:
    """Keys of a fingerprint in the permuted block tables, each led by its table's number."""
    at, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    keys = []
    for t, chosen in enumerate(combinations(masks, len(BLOCKS) - RADIUS)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("front")))
    return F.array(*keys)


def near(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, fp, distance, n) of distinct fingerprints at most ``radius`` apart (up to RADIUS, the tables' reach);
    n is how many rows of ``corpus`` have fp. Both tables have a long column fp."""
    if radius > RADIUS:
        raise ValueError(f"the tables reach a radius of {RADIUS}")
    asked = queries.select(F.col("fp").alias("query")).distinct()
    known = corpus.groupBy("fp").agg(F.count("*").alias("n"))
    asked = asked.select("query", F.explode(_tables(F.col("query"))).alias("k")).select("query", "k.*")
    known = known.select("fp", "n", F.explode(_tables(F.col("fp"))).alias("k")).select("fp", "n", "k.*")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    met = asked.join(known, ["table", "front"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    return met.select("query", "fp", "distance", "n").distinct()
