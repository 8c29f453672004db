"""Packing documents into training sequences of fixed length: conflict-constrained best fit.

A sequence holds ``capacity`` words. A document takes one place per word and one for
the separator behind it. Whole sequences' worth of a longer document become sequences
of their own; its tail is packed with others. A sequence never holds two documents of
one source, nor two of one duplicate cluster (equal texts unless ``cluster`` names a
column).

Documents are dealt by hash into cells of about ``cell_rows`` rows, whose number grows
with the table; a task packs one cell. Inside a cell, tails go in by falling size. Open
sequences are kept ordered by residual, each with a bitmap of its sources and one of
its duplicate clusters; the search starts at the tightest residual that fits and moves
on to its successors until one is compatible. Only sizes and hashes travel, never texts.
Rows that are alike in all that counts are counted before they travel and dealt out
again, so a document that fills a third of the table is spread over all cells.

Null and empty texts take the separator's place only. A null source conflicts with
nothing. Ties are settled by doc_id and text hash; rows that repeat are packed each for
itself. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hyplab.llm import kernels as K
from hyplab.llm.store import cut, ship

OUT = "doc_id long, piece long, first_word long, n_words long, sequence_id long, place long, used long"


def best_fit(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item and the place where it starts; items come by falling size, none above ``capacity``.

    A source or cluster that occurs once among the items cannot conflict and needs no bit.
    """
    bits: list[dict] = []
    for column in (sources, clusters):
        seen = Counter(x for x in column if x is not None)
        bits.append({x: 1 << i for i, x in enumerate(x for x, n in seen.items() if n > 1)})
    open_bins: list[tuple[int, int]] = []  # (residual, bin), rising
    source_map: list[int] = []
    cluster_map: list[int] = []
    least = min(sizes, default=0)
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = bits[0].get(source, 0), bits[1].get(cluster, 0)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (source_map[open_bins[at][1]] & s or cluster_map[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        source_map[b] |= s
        cluster_map[b] |= c
        bins.append(b)
        starts.append(capacity - residual)
        if residual - size >= least:
            insort(open_bins, (residual - size, b))
    return bins, starts


def pack_cell(rows: pd.DataFrame, capacity: int) -> dict[str, np.ndarray]:
    """Pack one cell: columns cell, doc_id, source, cluster, size."""
    rows = rows.sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], na_position="last", kind="stable")
    base = int(rows["cell"].iloc[0]) << 32
    size = rows["size"].to_numpy()
    whole, tail = size // capacity, size % capacity
    fit = np.flatnonzero(tail)
    fit = fit[np.argsort(-tail[fit], kind="stable")]
    source = rows["source"].astype(object).where(rows["source"].notna(), None).to_numpy()
    cluster = rows["cluster"].to_numpy()
    bins, starts = best_fit(tail[fit].tolist(), source[fit].tolist(), cluster[fit].tolist(), capacity)
    used = np.bincount(bins, tail[fit]).astype(np.int64) if len(fit) else np.zeros(0, np.int64)
    full = np.repeat(np.arange(len(rows)), whole)
    piece = np.concatenate([np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole), whole[fit]])
    row = np.concatenate([full, fit])
    length = np.concatenate([np.full(len(full), capacity), tail[fit]])
    last = np.concatenate([(np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole) == whole[full] - 1)
                           & (tail[full] == 0), np.ones(len(fit), bool)])
    return {
        "row": rows.index.to_numpy()[row], "piece": piece, "first_word": piece * capacity, "n_words": length - last,
        "sequence_id": base + np.concatenate([len(used) + np.arange(len(full)), np.asarray(bins, np.int64)]).astype(np.int64),
        "place": np.concatenate([np.zeros(len(full), np.int64), np.asarray(starts, np.int64)]),
        "used": np.concatenate([np.full(len(full), capacity), used[np.asarray(bins, int)]]).astype(np.int64),
    }


def measure(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, cluster and size (words and a separator) of each row. Narrow."""
    names = ["doc_id", "source", "text", *([cluster] if cluster else [])]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(2)):
            _, _, at = block.words()
            text = K.Block.span_hash(block.prefix(), block.offsets[:-1], block.offsets[1:]).view(np.int64)
            yield {"doc_id": batch.column(0).slice(row, block.n), "source": batch.column(1).slice(row, block.n),
                   "cluster": batch.column(3).slice(row, block.n) if cluster else text, "size": np.diff(at) + 1}

    return K.map_batches(docs, names, "doc_id long, source string, cluster long, size long", run)


def pack(docs: DataFrame, capacity: int = 2048, cell_rows: int = 8192, cluster: str | None = None) -> DataFrame:
    """Spans of documents by sequence: doc_id, piece, first_word, n_words, sequence_id, place (where the span
    starts in its sequence) and used (places taken in the sequence)."""
    alike = cut(measure(docs, cluster).groupBy("doc_id", "source", "cluster", "size").count())
    rows = alike.agg(F.sum("count")).first()[0] or 0
    cells = max(1, -(-rows // cell_rows))
    each = alike.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    dealt = each.withColumn("cell", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(cells)))

    ship(docs.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_cell(rows, capacity)
        ids = rows["doc_id"].loc[out.pop("row")].reset_index(drop=True)
        return pd.DataFrame({"doc_id": ids.astype("Int64")} | out)

    return dealt.groupBy("cell").applyInPandas(run, OUT)
