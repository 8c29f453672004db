"""Substring dedup by sliding sentence spans.

A text is cut into sentences (behind a closing mark or at a line end). A sentence of more
than ``longest`` words is cut again before each word whose hash is least among ``around``
words on either side, and every ``longest`` words counted from such a cut: a passage is
cut alike whatever words stand before it. From every sentence, and up to every sentence, the shortest run of at least
``sentences`` consecutive sentences and ``min_words`` words is hashed over its
lower-cased words. Shorter runs are phrases that unrelated documents share by chance; with
``longest`` words a sentence a run has at most 33 words, and nearly every passage of 50
words holds one wherever it stands. A global join finds the runs that occur more than once; the document with the least doc_id keeps its first
occurrence, and every sentence that another occurrence covers is removed.

A document sends each distinct run once, counting is by hash with map-side minima, and
repeats inside one document are settled where its text is. Only documents that lose
something meet their list of runs again, which is as long as their own text allows.

Null and empty texts and texts too short for a run come back as they are. Rows that
share a doc_id count as one document: none of them loses a run to another. A row without
doc_id is a document of its own, named by a number from 2**62 on that its text's hash gives,
so it comes after all smaller ids; equal texts without doc_id count as one document. Very
long texts are worked whole, an empty table gives an empty result, columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hyplab.llm import kernels as K

CLOSERS = tuple(c.encode() for c in ".!?…。！？｡؟۔।॥።")


@dataclass(frozen=True)
class Bounds:
    sentences: int = 2
    min_words: int = 24
    longest: int = 10
    around: int = 2


@dataclass
class Spans:
    """Sentences of a block (owner text, byte where each starts) and the runs that start at them."""

    owner: np.ndarray
    start: np.ndarray
    first: np.ndarray  # sentence at which each run starts
    last: np.ndarray  # sentence behind each run
    hash: np.ndarray


def _closed(data: np.ndarray, w_start: np.ndarray, w_end: np.ndarray) -> np.ndarray:
    """Which words end in a closing mark."""
    out = np.zeros(len(w_end), bool)
    for mark in CLOSERS:
        hit = w_end - w_start >= len(mark)
        for k, byte in enumerate(reversed(mark), 1):
            hit &= data[np.maximum(w_end - k, 0)] == byte
        out |= hit
    return out


def _least(words: np.ndarray, sentence: np.ndarray, around: int) -> np.ndarray:
    """Which words have the least hash among their neighbours in the sentence; of equal ones the first."""
    out = np.ones(len(words), bool)
    for k in range(1, around + 1):
        same, before, behind = sentence[:-k] == sentence[k:], words[:-k], words[k:]
        out[k:] &= ~same | (behind < before)
        out[:-k] &= ~same | (before <= behind)
    return out


def spans(block: K.Block, bounds: Bounds) -> Spans:
    w_start, w_end, w_at = block.words()
    n = len(w_start)
    words = K.Block.span_hash(block.prefix(K.LOWER), w_start, w_end)
    breaks = np.concatenate([[0], np.cumsum(block.data == K.NEWLINE)])
    ends = _closed(block.data, w_start, w_end) if n else np.zeros(0, bool)
    if n:
        ends[:-1] |= breaks[w_start[1:]] > breaks[w_end[:-1]]
        stops = w_at[1:] - 1
        ends[stops[np.diff(w_at) > 0]] = True
    begins = np.concatenate([[True], ends[:-1]]) if n else np.zeros(0, bool)
    if n:
        sentence = np.cumsum(begins) - 1
        begins |= _least(words, sentence, bounds.around) & (np.bincount(sentence)[sentence] > bounds.longest)
    at = np.flatnonzero(begins)
    inside = np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(inside % bounds.longest == 0)
    owner = np.searchsorted(w_at, at, "right") - 1
    count = len(at)
    edge = np.append(at, n)
    last = np.maximum(np.arange(count) + bounds.sentences, np.searchsorted(edge, at + bounds.min_words))
    first = np.flatnonzero(last <= np.searchsorted(owner, owner, "right"))
    # and the shortest run that ends behind each sentence, so that the end of a passage is covered like its start
    behind = np.arange(1, count + 1)
    start = np.minimum(behind - bounds.sentences, np.searchsorted(edge, edge[1:] - bounds.min_words, "right") - 1)
    good = start >= np.searchsorted(owner, owner)
    pair = np.unique(np.concatenate([first * (count + 1) + last[first], start[good] * (count + 1) + behind[good]]))
    first, last = pair // (count + 1), pair % (count + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.zeros(n, np.uint64)])
    up, down = K.powers(n)
    np.cumsum(words * up[:n], out=total[1:])
    a, b = edge[first], edge[last]
    hashed = K.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return Spans(owner, w_start[at] if n else at, first, last, hashed)


def _own(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(owner.astype(np.uint64) + np.uint64(1)))


def _named(doc_id: str, text_hash: Column) -> Column:
    """The doc_id, or for rows without one a number from 2**62 on out of the text's hash."""
    return F.coalesce(doc_id, text_hash.bitwiseAND(2**61 - 1) + F.lit(2**62))


def repeated_runs(docs: DataFrame, bounds: Bounds) -> DataFrame:
    """_id, _hash (of the text) and the runs of the document that an earlier document holds."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(2)):
            x = spans(block, bounds)
            owner = x.owner[x.first]
            pick = np.unique(_own(x.hash, owner), return_index=True)[1]
            rows = pa.array(owner[pick] + row)
            yield {"_id": batch.column(0).take(rows), "_hash": batch.column(1).take(rows), "run": x.hash[pick].view(np.int64)}

    text_hash = F.xxhash64("text")
    keyed = docs.select(_named("doc_id", text_hash).alias("_id"), text_hash.alias("_hash"), "text")
    runs = K.map_batches(keyed, ["_id", "_hash", "text"], "_id long, _hash long, run long", run)
    first = runs.groupBy("run").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first <> _last")
    later = runs.join(first.select("run", "_first"), "run").where("_id <> _first")
    return later.groupBy("_id", "_hash").agg(F.collect_set("run").alias("_runs"))


def remove_repeats(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (spans [first, behind) of sentence numbers) and the text that is left."""
    found = repeated_runs(docs, bounds)
    text_hash = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", _named("doc_id", text_hash).alias("_i"), text_hash.alias("_h"))
    marked = keyed.join(found, (keyed["_i"] == found["_id"]) & (keyed["_h"] == found["_hash"]), "left")
    schema = "doc_id long, n_sentences long, n_removed long, removed array<struct<first: long, behind: long>>, text string"
    span_type = pa.list_(pa.struct([pa.field("first", pa.int64()), pa.field("behind", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            x = spans(block, bounds)
            owner = x.owner[x.first]
            keys = _own(x.hash, owner)
            part = batch.column(2).slice(row, block.n)
            wanted = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            holder = np.repeat(np.arange(block.n), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
            marks = np.sort(_own(wanted, holder))
            hit = np.zeros(len(keys), bool)
            if len(marks):
                at = np.minimum(np.searchsorted(marks, keys), len(marks) - 1)
                hit = marks[at] == keys
            order = np.argsort(keys, kind="stable")
            hit[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True  # again in the same text
            turn = np.zeros(len(x.owner) + 1, np.int64)
            np.add.at(turn, x.first[hit], 1)
            np.add.at(turn, x.last[hit], -1)
            gone = np.cumsum(turn)[:-1] > 0
            n = np.bincount(x.owner, minlength=block.n)
            lost = np.bincount(x.owner[gone], minlength=block.n)
            texts = batch.column(1).slice(row, block.n)
            removed: list = [[] for _ in range(block.n)]
            changed = np.flatnonzero(lost)
            if len(changed):
                listed = texts.to_pylist()
                s_at = np.searchsorted(x.owner, np.arange(block.n + 1))
                for d in changed.tolist():
                    a, b = s_at[d], s_at[d + 1]
                    edge = np.append(x.start[a:b], block.offsets[d + 1])
                    out = [block.data[block.offsets[d] : edge[0]].tobytes()]
                    out += [block.data[edge[i] : edge[i + 1]].tobytes() for i in np.flatnonzero(~gone[a:b])]
                    listed[d] = b"".join(out).decode("utf-8", "replace")
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                    removed[d] = [{"first": int(i), "behind": int(j)} for i, j in flips.reshape(-1, 2)]
                texts = pa.array(listed, pa.string())
            yield {"doc_id": batch.column(0).slice(row, block.n), "n_sentences": n, "n_removed": lost,
                   "removed": pa.array(removed, span_type), "text": texts}

    return K.map_batches(marked, ["doc_id", "text", "_runs"], schema, run)
