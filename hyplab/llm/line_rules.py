"""Line-first quality rules: judge every line, drop the failing ones, then judge what a document lost.

A line fails when it lacks closing punctuation, separates menu entries, is mostly
symbols or capitals, or carries a boilerplate phrase. A document is kept when it
passes two whole-text checks (length and repetition) and at least half of its words
stand in lines that passed.

Null and empty texts have no words, fail the base check and come back with an empty
cleaned text. Very long texts are worked whole. Rows that repeat are judged each for
itself, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hyplab.llm import kernels as K

SYMBOLS = "#*$%&|<>"
CLOSERS = ".!?:;\"')"
WIDE_CLOSERS = ("”", "…", "»", "。")
PHRASES = (
    "all rights reserved", "licensed under", "cookie", "privacy policy", "terms of use", "terms of service",
    "copyright", "javascript", "subscribe", "click here", "sign up", "log in",
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; shares are in percent, so every comparison is between integers."""

    min_words: int = 50
    max_repeat_share: int = 50
    menu_bars: int = 3
    max_symbol_share: int = 10
    max_capital_share: int = 60
    min_kept_share: int = 50


SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_left long, text string"""


def _ends_with_closer(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the byte span that ends at ``ends`` closes with one of the closing marks."""
    out = np.isin(data[ends - 1], np.frombuffer(CLOSERS.encode(), np.uint8))
    for mark in WIDE_CLOSERS:
        code = np.frombuffer(mark.encode(), np.uint8)
        hit = ends >= len(code)
        for back, byte in enumerate(code[::-1], 1):
            hit = hit & (data[np.maximum(ends - back, 0)] == byte)
        out |= hit
    return out


def _phrase_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(starts), bool)
    low = K.LOWER[data].tobytes()
    for phrase in PHRASES:
        code, at = phrase.encode(), -1
        while (at := low.find(code, at + 1)) >= 0:
            hit[np.searchsorted(starts, at, "right") - 1] = True
    return hit


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def repeated_in_text(windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more in their text."""
    keys = K.salt(windows, bounds)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text: words inside a window of ``k`` words that occurs twice or more."""
    wins, at = K.windows(hashes, bounds, k)
    hit = np.flatnonzero(repeated_in_text(wins, at))
    owner = np.searchsorted(at, hit, "right") - 1
    first = bounds[owner] + hit - at[owner]
    covered = np.zeros(len(hashes), bool)
    for j in range(k):
        covered[first + j] = True
    return K.per_text(covered, bounds)


def judge(block: K.Block, rules: Rules) -> dict[str, np.ndarray | list[str]]:
    data = block.data
    w_start, w_end, w_at = block.words()
    l_start, l_end, l_at = block.lines()
    prefix = block.prefix()
    n_words = np.diff(w_at)
    in_word = K.IN_WORD[data]
    symbols = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    chars = in_word & ~K.CONTINUATION[data]

    l_first = np.searchsorted(w_start, l_start)
    l_words = np.searchsorted(w_start, l_end) - l_first
    full = l_words > 0
    hashes = K.Block.span_hash(prefix, l_start, l_end)[full]
    owner = np.repeat(np.arange(block.n), np.diff(l_at))[full]
    order = np.lexsort((hashes, owner))
    again = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    n_dup = np.bincount(owner[order[1:]][again], minlength=block.n)

    last = w_end[np.maximum(l_first + l_words - 1, 0)] if len(w_end) else np.zeros(len(l_start), np.int64)
    fails = ~_ends_with_closer(data, np.maximum(last, 1)) if len(data) else np.ones(len(l_start), bool)
    l_chars = _sums(chars, l_start, l_end)
    fails |= _sums(data == ord("|"), l_start, l_end) >= rules.menu_bars
    fails |= _sums(symbols, l_start, l_end) * 100 > l_chars * rules.max_symbol_share
    capital = _sums((data >= 65) & (data <= 90), l_start, l_end)
    small = _sums((data >= 97) & (data <= 122), l_start, l_end)
    fails |= (capital * 100 > (capital + small) * rules.max_capital_share) & (l_words >= 3)
    fails |= _phrase_lines(data, l_start)
    fails &= full

    repeat = repeated_words(K.Block.span_hash(prefix, w_start, w_end), w_at)
    left = n_words - K.per_text(np.where(fails, l_words, 0), l_at)
    base = (n_words < rules.min_words) | (repeat * 100 > n_words * rules.max_repeat_share)
    texts = [
        "\n".join(block.text(l_start[i], l_end[i]) for i in range(l_at[d], l_at[d + 1]) if not fails[i])
        for d in range(block.n)
    ]
    return {
        "n_words": n_words, "word_chars": K.per_text(chars, block.offsets), "n_symbols": K.per_text(symbols, block.offsets),
        "n_dup_lines": n_dup, "n_repeat_words": repeat, "base_failed": base,
        "kept": ~base & (left * 100 >= n_words * rules.min_kept_share),
        "n_lines": K.per_text(full, l_at), "n_lines_removed": K.per_text(fails, l_at), "n_words_left": left, "text": texts,
    }


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, verdict and the text without its failing lines. Narrow: no shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, block in K.blocks(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(row, block.n), **judge(block, rules)}

    return K.map_batches(docs, ["doc_id", "text"], SCHEMA, run)
