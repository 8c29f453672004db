"""Packing with least slack against exhaustive sums, and the whole operator against direct encoding."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hyplab.llm import bin_slack as B
from hyplab.llm.queries import op11_minimum_bin_slack

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_best_fill_equals_exhaustive_search():
    rng = random.Random(11)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(0, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(0, 60)
        sums = [sum(x * n for x, n in zip(counts, take)) for take in product(*[range(n + 1) for n in counts.values()])]
        taken = B.best_fill(counts, room)
        assert all(0 < n <= counts[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)


def check(lengths, pieces, capacity):
    """Every id in one piece, offsets without gaps, full sequences but for at most a few powers of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, start, n, seq, offset in pieces:
        by_doc[d].append((start, n))
        by_seq[seq].append((offset, n))
    for d, want in enumerate(lengths):
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at and n > 0
            at += n
        assert at == want
    short = []
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
        if at != capacity:
            assert at & (at - 1) == 0
            short.append(at)
    assert len(short) == len(set(short)) and sum(short) < capacity
    return by_seq


@pytest.mark.parametrize("seed", range(20))
def test_pack_lengths(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 64, 100])
    lengths = [rng.randrange(1, rng.choice([5, 3 * capacity + 2])) for _ in range(rng.randrange(0, 200))]
    check(lengths, B.pack_lengths(lengths, capacity), capacity)


def test_equal_lengths_are_packed_in_bulk(monkeypatch):
    calls = []
    real = B.best_fill
    monkeypatch.setattr(B, "best_fill", lambda *a: calls.append(1) or real(*a))
    lengths = [1500] * 50_000 + [548] * 20_000 + [31]
    check(lengths, B.pack_lengths(lengths, 2048), 2048)
    assert len(calls) < 200


def test_pieces_are_cut_only_where_no_set_fills_the_window():
    pieces = B.pack_lengths([60, 40, 70, 30, 50, 50], 100)
    assert Counter(p[2] for p in pieces) == Counter([60, 40, 70, 30, 50, 50])


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    some = [*"aAΣσςßéİ1२🙂.,'", "́", " ", " ", "\x1c", "\u0085", "\t", "\n", "<|endoftext|>", "'s", "中文"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert B.same_by_words(open(FILE, encoding="utf-8").read(), texts)


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(B, "CACHED_WORDS", 3)
    monkeypatch.setattr(B, "CACHED_PARTS", 2)
    monkeypatch.setattr(B, "CACHED_BYTES", 6)
    w = B.Words(open(FILE, encoding="utf-8").read())
    texts = ["one two three", "four fivefivefive six one", None, "", "two " * 9]
    want = [np.asarray(w.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [w.ids([t])[0] for t in texts] == want and w.ids(texts[:2]) == want[:2]


def _pieces(rows):
    docs = defaultdict(list)
    for i, r in enumerate(rows):
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], i))
    return docs


def test_whole_operator_equals_direct_encoding(spark, sf, documents):
    rows = op11_minimum_bin_slack(spark, sf).collect()
    encode = Tokenizer.from_file(FILE).encode
    by = _pieces(rows)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert by.keys() == texts.keys()
    for d, text in texts.items():
        ids = np.asarray([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, n, total, i in sorted(by[d]):
            assert start == at and total == len(ids)
            assert rows[i]["ids_crc32"] == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_odd_rows_and_small_cells(spark, odd):
    packed = B.pack(odd, FILE, capacity=50, cell_tokens=120)
    rows = packed.collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert sorted(r["doc_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert len([r for r in rows if r["doc_id"] == 8 and r["start"] == 0]) == 2
    got = B.sequences(packed, 50, pad_id=9).collect()
    held = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["offset"]):
        held[r["sequence_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert {r["sequence_id"] for r in got} == held.keys()
    for r in got:
        want = held[r["sequence_id"]]
        assert r["ids"][: len(want)] == want and set(r["ids"][len(want) :]) <= {9}
        assert len(r["ids"]) == 50 or (len(r["ids"]) == len(want) and len(want) & (len(want) - 1) == 0)


def test_empty_table(spark, odd):
    assert B.pack(odd.where("false"), FILE).count() == 0
    assert B.sequences(B.pack(odd.where("false"), FILE)).count() == 0


def test_words_are_looked_up_once_and_kept_by_generations(monkeypatch):
    """Known words, words that come again in a batch, long words and a full cache give the ids of whole texts."""
    monkeypatch.setattr(B, "CACHED_WORDS", 3)
    with open(FILE, encoding="utf-8") as f:
        words = B.Words(f.read())
    batches = [["a cat, a dog", "", None, "a " + "long" * 40], ["the cat sat on the " + "long" * 40, "a dog"], ["a cat"], ["sat sat"]]
    for texts in batches * 2:
        whole = words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert words.ids(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in whole]
        assert not words.words.asked and all(type(x) is bytes and len(w) <= B.CACHED_BYTES for w, x in words.words.items())


def test_a_chunk_looks_a_word_up_once_and_encodes_new_words_together(monkeypatch):
    """Work follows the distinct words of a chunk, and new words are one text for the model, with or without marks of a word's end."""
    with open(FILE, encoding="utf-8") as f:
        described = f.read()
    rng = random.Random(7)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" \t" + " ".join(rng.choices(made, k=400)) + rng.choice(["", "\n", "\x1f\v"]) for _ in range(100)] + [None, "", " ", "\f\r"]
    for closes in (True, False):
        words = B.Words(described)
        if not closes:
            words.closes[:] = False
        looked, given = [], []
        get, encode = B.Asked.__getitem__, words.model.encode_batch_fast
        monkeypatch.setattr(B.Asked, "__getitem__", lambda self, w: looked.append(w) or get(self, w), raising=False)
        words.model = type("Model", (), {"encode_batch_fast": staticmethod(lambda t, **k: given.append(len(t)) or encode(t, **k))})
        got = words.ids(pa.array(["left out", *texts]).slice(1))
        monkeypatch.undo()
        whole = words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert got == [np.asarray(e.ids, "<u4").tobytes() for e in whole]
        assert len(looked) <= 2 * len({b"", *" ".join(t or "" for t in texts).encode().split()})  # asked and filled
        assert not closes or sum(given) == 1


def test_words_of_letters_are_kept_by_their_parts_only():
    """Letters of any kind, case and marks give the ids of whole texts; only other words are kept whole."""
    with open(FILE, encoding="utf-8") as f:
        words = B.Words(f.read())
    rng = random.Random(9)
    letters = ["a", "Z", "é", "É", "ß", "İ", "Ⱥ", "ª", "µ", "Σ", "ς", "ж", "א", "́", "中", "ص"]
    plain = ["".join(rng.choices(["a", "Z", "é", "É", "ß", "Σ", "ж", "א"], k=rng.randrange(1, 9))) + rng.choice(["", ".", ",***", "]-^\\"]) for _ in range(500)]
    mixed = ["".join(rng.choices([*letters, "1", "'", ".", "\x00", "\x1c"], k=rng.randrange(1, 9))) for _ in range(2000)]
    for texts in ([" ".join(plain)], [None, *mixed, "x" * 65, ("é" * 33) + "."], plain):
        whole = words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert words.ids(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in whole]
        assert not words.words.keys() & {w.encode() for w in plain}
