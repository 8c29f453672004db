"""Packing tokenised documents into windows with the least slack: bitset subset sums over remaining lengths.

A document is its token ids and an end id. Whole windows' worth of a longer document are
windows of their own; what remains, one length below the capacity for each document, is
packed. The remaining lengths of a cell are a multiset, length -> count:

* **Window.** The longest remaining piece opens it. The sums that the other lengths can
  reach are the bits of one integer; a length with count c enters in powers of two
  (shift and or), and the search ends as soon as the capacity itself is reached. The
  highest bit is the fill closest to the capacity, and walking the steps backwards gives
  how often each length is taken.
* **Many windows at once.** The pattern found is applied as often as the counts allow,
  so the number of searches follows the number of distinct lengths, not of documents.
* **Slack.** Where even the best fill leaves slack, the longest piece left over is cut to
  fill it; its rest returns to the multiset. Only the last window of a cell can stay
  short: it is cut into sequences whose lengths are powers of two, which need no padding.

A cell is the next ``cell_tokens`` ids of a partition of the scan, so all of this is one
narrow pass: no shuffle, no hot key, no rows at the driver, and a lost task is read again
from the table. The ids of a chunk's distinct words are looked up among those seen before in the
worker (words do not influence each other: the pre-tokeniser splits at every white space).

Null and empty texts are the end id alone. Rows that repeat, with or without doc_id,
are packed each for itself; equal lengths are taken in the order of the rows. A very long
text is worked whole (its cell is as long as the text). An empty table gives an empty
result; columns other than doc_id and text are ignored. Tokenizers whose pre-tokeniser
joins words over white space are not served; ``same_by_words`` tells.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hyplab.llm.store import ship

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
CHUNK_BYTES = 1 << 23
CACHED_WORDS, CACHED_PARTS, CACHED_BYTES = 400_000, 800_000, 64  # words and parts of a generation, length of a kept word
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")  # an apostrophe may open a contraction
OLD_LETTERS = "\u0600"  # below it, every version of Unicode agrees on what is a letter
LETTERS = "".join(c for c in map(chr, range(ord(OLD_LETTERS))) if c.lower().isalpha() and max(c.lower()) < OLD_LETTERS)
ENCODE_AT_ONCE = 4096


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length so that the sum comes as close to ``room`` as it can without passing it."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left:
            block = min(block, left)
            before, reach = reach, (reach | reach << (length * block)) & mask
            if reach != before:
                steps.append((length, block, before))
            left -= block
            block *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, block, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + block
            at -= length * block
    return taken


@dataclass
class Stock:
    """Pieces that wait to be packed, by length: documents and the places where the pieces start."""

    pieces: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def put(self, length: int, items: list[tuple[int, int]]) -> None:
        if items:
            self.pieces.setdefault(length, []).extend(items)

    def take(self, length: int, n: int) -> list[tuple[int, int]]:
        held = self.pieces[length]
        taken, rest = held[:n], held[n:]
        if rest:
            self.pieces[length] = rest
        else:
            del self.pieces[length]
        return taken

    def counts(self) -> dict[int, int]:
        return {x: len(p) for x, p in self.pieces.items()}


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0."""
    out: list[tuple[int, int, int, int, int]] = []
    stock, sequence = Stock(), 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            stock.put(n % capacity, [(d, n - n % capacity)])
    while stock.pieces:
        counts = stock.counts()
        longest = max(counts)
        counts[longest] -= 1
        taken = best_fill(counts, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        counts[longest] += 1
        slack = capacity - sum(x * n for x, n in taken.items())
        spare = max((x for x, n in counts.items() if n > taken.get(x, 0)), default=0) if slack else 0
        if slack and not spare:
            break  # the last window
        need = dict(taken)
        if spare:
            need[spare] = need.get(spare, 0) + 1
        copies = min(counts[x] // n for x, n in need.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            for i, (d, start) in enumerate(stock.take(length, n * copies)):
                out.append((d, start, length, sequence + i // n, offset + i % n * length))
            offset += n * length
        if spare:
            cut = stock.take(spare, copies)
            out.extend((d, start, slack, sequence + i, offset) for i, (d, start) in enumerate(cut))
            stock.put(spare - slack, [(d, start + slack) for d, start in cut])
        sequence += copies
    left = [(x, d, start) for x in sorted(stock.pieces, reverse=True) for d, start in stock.pieces[x]]
    rest = sum(x for x, _, _ in left)
    room = 1 << (rest.bit_length() - 1) if rest else 0  # sequences of these lengths, falling, use up the rest
    offset = 0
    for length, d, start in left:
        while length:
            part = min(length, room - offset)
            out.append((d, start, part, sequence, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == room:
                rest -= room
                sequence, offset, room = sequence + 1, 0, 1 << (rest.bit_length() - 1) if rest else 0
    return out


class Seen:
    """What was looked up before, in two generations: a full young one becomes the old one, which is dropped then."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        """The keys that are not known; those that are will be found in ``young``."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        out = []
        for k in keys:
            if k not in self.young:
                if k in self.old:
                    self.young[k] = self.old[k]
                else:
                    out.append(k)
        return out


class Asked(dict):
    """Ids of words. A word that is not known gives a buffer, the same for each time it comes, which is filled before it is read."""

    def __init__(self, old: dict[bytes, bytes]) -> None:
        super().__init__()
        self.old, self.asked = old, {}

    def __missing__(self, word: bytes) -> bytes | bytearray:
        known = self.old.get(word)
        if known is None:
            known = self.asked[word] = bytearray()
        self[word] = known
        return known


def _held(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of an array of strings or binaries, and where its values begin and end there."""
    if not len(array):
        return b"", np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    return data.to_pybytes() if data else b"", at


def _cut(data: bytes, at: np.ndarray) -> list[bytes]:
    ends = at.tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _small(word: bytes) -> bool:
    """Whether a word consists of letters that no normaliser changes: composed, small and of long standing."""
    if word.isalpha():
        return word.islower()
    w = word.decode("utf-8", "replace")
    return w.isalpha() and w == w.lower() and max(w) < OLD_LETTERS and unicodedata.is_normalized("NFC", w)


class Words:
    """Ids of texts by the ids of their words, as little-endian unsigned 32-bit numbers.

    Arrow splits a chunk of texts and numbers its distinct words.
    A word of letters with closing marks behind it is its letters (in lower case where the
    tokenizer ignores case) and its marks; Arrow splits these, too, and the distinct parts are
    looked up, so far fewer words than stand in the texts are encoded. Other words are looked
    up whole. Composed small letters go straight to the tokenizer's byte-level model where that is the same,
    many words as one text: where the model marks the last token of a word, the ids are cut behind it.
    """

    def __init__(self, described: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.tokenizer = Tokenizer.from_str(described)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.words, self.parts = Asked({}), Seen(CACHED_PARTS)
        one = lambda w, t=self.tokenizer: t.encode(w, add_special_tokens=False).ids
        self.caseless = all(one(w) == one(w.lower()) for w in ("A", "Ab", "WORD", "Éa", "Straße"))
        self.apart = all(one(w + m) == one(w) + one(m) for w in ("a", "word", "é") for m in (*MARKS, "...", "?!"))
        self.plain = all(one(w) == one(w, self.model) for w in ("a", "word", "qqxzj", *"bcxyz", "é", "straße", "ñandú", "жук"))

    def _encode(self, words: list[bytes], direct: bool = False) -> Iterator[tuple[bytes, bytes]]:
        tokenizer = self.model if direct else self.tokenizer
        for i in range(0, len(words), ENCODE_AT_ONCE):
            part = words[i : i + ENCODE_AT_ONCE]
            if direct:
                together = tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
                ids = np.asarray(together[0].ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(part):  # a word has one such token at most
                    yield from zip(part, _cut(ids.tobytes(), 4 * np.concatenate(([0], ends))))
                    continue
            for w, e in zip(part, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                ids = e.ids
                yield w, struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, words: list[bytes]) -> list[bytes | bytearray]:
        """Ids of words that are not split."""
        if len(self.words) > CACHED_WORDS:
            self.words = Asked(dict(self.words))
        found = list(map(self.words.__getitem__, words))
        asked, self.words.asked = self.words.asked, {}
        for w, ids in self._encode(list(asked)):
            asked[w] += ids
            if len(w) > CACHED_BYTES:
                del self.words[w]
            else:
                self.words[w] = ids
        return found

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        new = self.parts.missing(parts)
        known = self.parts.young
        known[b""] = b""
        known.update(self._encode([w for w in new if _small(w)] if self.plain else [], direct=True))
        known.update(self._encode([w for w in new if w not in known]))
        return list(map(known.__getitem__, parts))

    def _of_words(self, words: pa.Array) -> pa.Array:
        stems = pc.ascii_rtrim(words, MARKS)
        lettered = pc.ascii_is_alpha(stems).to_numpy(zero_copy_only=False).copy()
        others = np.flatnonzero(~lettered)
        lettered[others] = pc.match_substring_regex(stems.take(pa.array(others)), rf"\A[{LETTERS}]+\z")
        lettered &= self.apart & (pc.binary_length(words).to_numpy() <= CACHED_BYTES)
        split, whole = (pa.array(np.flatnonzero(x)) for x in (lettered, ~lettered))
        stems, marks = stems.take(split), pc.utf8_ltrim(words.take(split), LETTERS)
        parts = pa.concat_arrays([pc.ascii_lower(stems) if self.caseless else stems, marks]).dictionary_encode()
        ids = pa.array(self._parts(_cut(*_held(parts.dictionary))), pa.large_binary()).take(parts.indices)
        ids = pc.binary_join_element_wise(ids[: len(split)], ids[len(split) :], pa.scalar(b"", pa.large_binary()))
        both = pa.concat_arrays([ids, pa.array(self._whole(_cut(*_held(words.take(whole)))), pa.large_binary())])
        return both.take(pa.array(np.argsort(np.concatenate((split, whole)))))

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        # split at exactly the six white space bytes of ASCII
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.dictionary_encode()
        data, at = _held(self._of_words(coded.dictionary).take(coded.indices))
        return _cut(data, at[split.offsets.to_numpy()])


_LOADED: dict[int, Words] = {}


def _words(described: str) -> Words:
    key = hash(described)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Words(described)
    return _LOADED[key]


def same_by_words(described: str, texts: list[str]) -> bool:
    """Whether the tokenizer gives the same ids by words as for whole texts."""
    w = Words(described)
    whole = w.tokenizer.encode_batch(texts, add_special_tokens=False)
    return [np.asarray(e.ids, "<u4").tobytes() for e in whole] == w.ids(texts)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, cell_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of documents by sequence, with their ids (little-endian unsigned 32-bit numbers).

    ``tokenizer`` is the path of a tokenizer file, read by the driver and sent to the tasks.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        described = spark.sparkContext.broadcast(f.read())
    ship(spark)
    end = np.asarray([end_id], "<u4").tobytes()

    def emit(names: list, held: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack_lengths([len(x) // 4 for x in held], capacity)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        ids = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
        columns = [pa.array([names[d] for d in doc.tolist()], pa.int64()), start, length,
                   np.array([len(x) // 4 for x in held], np.int64)[doc], sequence + base, offset, pa.array(ids, pa.binary())]
        made = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns],
                                          ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        return made, base + int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(described.value)
        names, held, tokens = [], [], 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, "right")))
                for ids in words.ids(texts.slice(at, to - at)):
                    held.append(ids + end)
                    tokens += len(held[-1]) // 4
                names += ids_of[at:to]
                at = to
                if tokens >= cell_tokens:
                    made, base = emit(names, held, base)
                    yield made
                    names, held, tokens = [], [], 0
        if held:
            yield emit(names, held, base)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id and ids (array of int): each sequence's pieces in order, padded unless its length is a power of two."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                short = len(ids) & (len(ids) - 1) != 0
                rows.append(np.pad(ids, (0, capacity - len(ids)), constant_values=pad_id) if short else ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    # a sequence has at most ``capacity`` pieces
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    return packed.groupBy("sequence_id").agg(parts).mapInArrow(run, "sequence_id long, ids array<int>")
