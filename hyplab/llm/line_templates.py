"""Line dedup by log templates: a fixed-depth parse of every line, recurring templates are dropped.

The tree has fixed levels: number of tokens, then the three leading tokens, then the
rest. Tokens that hold a digit are variable fields and all read alike. The rest of a
line of eight tokens or more is cut into four segments, and a line also belongs to four
wider templates that leave one segment open, so a variable field made of plain words
is generalised, too. A template, narrow or wide, recurs when at least ``min_documents``
documents hold it; its lines are dropped from all of them.

Wide templates are only counted in leaves (same length and leading tokens) that enough
documents reach, which prose rarely does. Counting is by hash with map-side sums, so a
line that a third of all documents share is one row per task. Each line is judged by
itself, whatever its length and its share of a document; only a document that would lose
all its words stays whole and is marked.

Equal texts count as one document, so copies alone make no line recur. With ``classes``
a class of near duplicates counts as one document; without them ten or more different
edits of one text make its lines recur. ``Bounds`` can spare short lines (``min_tokens``)
and documents that would lose more than ``max_loss`` percent of their words.

Null and empty texts come back empty. Rows alike in doc_id and text get the same result;
a null doc_id is a value like any other. Very long texts are worked whole, an
empty table gives an empty result; other columns pass through ``drop_recurring``, but
for names that begin with two underscores and those of its results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hyplab.llm import kernels as K
from hyplab.llm.store import cut

LEADING = 3
SEGMENTS = 4
WIDE_FROM = 8
HOT = 1000
_FIELD = np.uint64(0x0123456789ABCDEF)
_STEP = 0xA0761D6478BD642F


@dataclass(frozen=True)
class Bounds:
    min_documents: int = 10
    min_tokens: int = 1
    max_loss: int = 100


EVERY_LINE = Bounds()


@dataclass
class Lines:
    """Lines with tokens of a block: owner text, byte span, token span and hashes."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: np.ndarray
    leaf: np.ndarray
    narrow: np.ndarray
    wide: np.ndarray  # one column per segment; 0 where a line has no wide templates


def parse(block: K.Block) -> Lines:
    w_start, w_end, w_at = block.words()
    l_start, l_end, l_at = block.lines()
    first = np.searchsorted(w_start, l_start)
    last = np.searchsorted(w_start, l_end)
    full = last > first
    owner = np.repeat(np.arange(block.n), np.diff(l_at))[full]
    l_start, l_end, first, last = l_start[full], l_end[full], first[full], last[full]
    n = last - first

    tokens = K.Block.span_hash(block.prefix(), w_start, w_end)
    digits = np.concatenate([[0], np.cumsum((block.data >= 48) & (block.data <= 57))])
    tokens = np.where(digits[w_end] > digits[w_start], _FIELD, tokens)
    # the place of a token in its line weighs its hash, so sums over token spans name sequences
    place = np.arange(len(tokens)) - np.repeat(first, n) if len(n) else np.zeros(0, np.int64)
    weight = K.mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(tokens ^ weight), dtype=np.uint64)])
    between = lambda a, b: total[b] - total[a]
    count = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    leaf = K.mix(between(first, np.minimum(first + LEADING, last)) + count)
    whole = between(first, last) + count
    wide = np.zeros((len(n), SEGMENTS), np.uint64)
    rest = np.maximum(n - LEADING, 0)
    for s in range(SEGMENTS):
        a = np.minimum(first + LEADING + rest * s // SEGMENTS, last)
        b = np.minimum(first + LEADING + rest * (s + 1) // SEGMENTS, last)
        wide[:, s] = np.where(n >= WIDE_FROM, K.mix(whole - between(a, b) + np.uint64((s + 1) * _STEP % 2**64)), 0)
    return Lines(owner, l_start, l_end, n, leaf, K.mix(whole), wide)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Marks the first place of each key."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def occurrences(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """The distinct lines of each document: __id, __hash (of the text), leaf, opens (1 at the first line of a
    leaf in a document, else 0) and the templates that no line of the document had before."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(2)):
            x = parse(block)
            pick = np.flatnonzero(x.n >= bounds.min_tokens)
            own = K.mix(x.owner[pick].astype(np.uint64) + np.uint64(1))
            once = np.unique(K.mix(x.narrow[pick] ^ own), return_index=True)[1]
            pick, own = pick[once], own[once]
            made = np.column_stack([x.narrow[pick], x.wide[pick]])
            full = np.arange(SEGMENTS + 1)[None, :] < np.where(x.n[pick] >= WIDE_FROM, SEGMENTS + 1, 1)[:, None]
            keep = _firsts(K.mix(made ^ own[:, None]).ravel()).reshape(made.shape) & full
            rows = pa.array(x.owner[pick] + row)
            yield {"__id": batch.column(0).take(rows), "__hash": batch.column(1).take(rows), "leaf": x.leaf[pick].view(np.int64),
                   "opens": _firsts(K.mix(x.leaf[pick] ^ own)).astype(np.int64),
                   "templates": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32), made[keep].view(np.int64))}

    keyed = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), "text")
    return K.map_batches(keyed, ["__id", "__hash", "text"], "__id long, __hash long, leaf long, opens long, templates array<long>", run)


def recurring(docs: DataFrame, bounds: Bounds, classes: DataFrame | None = None) -> DataFrame:
    """__id, __hash and the recurring templates that the document's lines belong to, for documents that have any."""
    seen = occurrences(docs, bounds)
    live = cut(seen.groupBy("leaf").agg(F.sum("opens").alias("n")).where(F.col("n") >= bounds.min_documents))
    # fewer than HOT leaves can hold more than their share of the openings: those go to the lines, the others meet by
    # shuffle, where lines of the former are spread by document
    share = (live.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = live.where(F.col("n") > share).select("leaf", F.lit(True).alias("known"))
    cold = live.where(F.col("n") <= share).select(F.col("leaf").alias("place"), F.lit(True).alias("cold"))
    marked = seen.join(F.broadcast(hot), "leaf", "left")
    marked = marked.withColumn("place", F.when(F.col("known"), F.xxhash64("__id", "__hash")).otherwise(F.col("leaf")))
    met = marked.join(cold, "place", "left").where("known OR cold")
    lines = cut(met.select("__id", "__hash", F.explode("templates").alias("template")))
    if classes is None:
        held = lines.groupBy("template", "__hash").count()
    else:
        known = classes.select(F.col("doc_id").alias("__doc"), F.col("hash").alias("__text"), "root")
        placed = lines.join(known, lines["__id"].eqNullSafe(known["__doc"]) & (lines["__hash"] == known["__text"]))
        held = placed.groupBy("template", "root").count()
    counted = held.groupBy("template").agg(F.sum("count").alias("count"), F.count("*").alias("n"))
    often = cut(counted.where(F.col("n") >= bounds.min_documents).select("template", "count"))
    # fewer than HOT templates can hold more than their share of the lines: those go to the lines, the others meet by shuffle
    share = (often.agg(F.sum("count")).first()[0] or 0) / HOT
    hot = F.broadcast(often.where(F.col("count") > share).select("template"))
    cold = often.where(F.col("count") <= share).select("template")
    met = lines.join(hot, "template").union(lines.join(hot, "template", "left_anti").join(cold, "template"))
    return met.groupBy("__id", "__hash").agg(F.collect_set("template").alias("__drop"))


def drop_recurring(docs: DataFrame, bounds: Bounds = Bounds(), classes: DataFrame | None = None) -> DataFrame:
    """``docs`` with recurring lines gone from ``text`` and n_lines, n_lines_dropped, n_words_dropped (long) and
    mostly_recurring (boolean: left whole because it would lose too much). ``classes`` has doc_id, hash (of the text)
    and root, once for each document with words, as ``near_duplicates.components`` gives them."""
    found = recurring(docs, bounds, classes)
    names = [c for c in docs.columns if c != "text"]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    own = {"text": "string", "n_lines": "bigint", "n_lines_dropped": "bigint", "n_words_dropped": "bigint", "mostly_recurring": "boolean"}
    names = [c for c in names if c not in own]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], "text", F.xxhash64("text").alias("__h"))
    marked = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["__h"] == found["__hash"]), "left")
    schema = ", ".join(f"`{c}` {fields.get(c, own.get(c))}" for c in [*names, *own])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n = len(names)
        drops = batch.column(n + 1)
        for row, block in K.blocks(batch.column(n)):
            x = parse(block)
            part = drops.slice(row, block.n)
            wanted = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            owner = np.repeat(np.arange(block.n), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
            sign = lambda h, o: K.mix(h ^ K.mix(o.astype(np.uint64) + np.uint64(1)))
            marks = np.sort(sign(wanted, owner))
            gone = np.zeros(len(x.n), bool)
            if len(marks):
                for h in (x.narrow, *x.wide.T):
                    keys = sign(h, x.owner)
                    at = np.minimum(np.searchsorted(marks, keys), len(marks) - 1)
                    gone |= (marks[at] == keys) & (h != 0)
            gone &= x.n >= bounds.min_tokens
            words = np.bincount(x.owner, x.n, block.n).astype(np.int64)
            lost = np.bincount(x.owner[gone], x.n[gone], block.n).astype(np.int64)
            much = (lost * 100 > words * bounds.max_loss) | ((lost == words) & (lost > 0))
            gone &= ~much[x.owner]
            texts = batch.column(n).slice(row, block.n)
            changed = np.unique(x.owner[gone])
            if len(changed):
                listed = texts.to_pylist()
                dead = set(zip(x.owner[gone].tolist(), x.start[gone].tolist()))
                for d in changed.tolist():
                    a, b = int(block.offsets[d]), int(block.offsets[d + 1])
                    out, at = [], a
                    for line in block.data[a:b].tobytes().split(b"\n"):
                        if (d, at) not in dead:
                            out.append(line)
                        at += len(line) + 1
                    listed[d] = b"\n".join(out).decode("utf-8", "replace")
                texts = pa.array(listed, pa.string())
            yield {c: batch.column(i).slice(row, block.n) for i, c in enumerate(names)} | {
                "text": texts, "n_lines": np.bincount(x.owner, minlength=block.n),
                "n_lines_dropped": np.bincount(x.owner[gone], minlength=block.n),
                "n_words_dropped": np.where(much, 0, lost), "mostly_recurring": much,
            }

    return K.map_batches(marked, [*[F.col(f"`{c}`") for c in names], "text", "__drop"], schema, run)
