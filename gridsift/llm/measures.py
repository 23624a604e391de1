"""Counts of whole texts, for Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridsift.llm.words import SPACE, Words, find_words, mix, span_hashes, text_buffers, window_hashes

SYMBOLS = b"#*$%&|<>"


def byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SYMBOL = byte_table(SYMBOLS)
IS_UPPER, IS_LETTER, IS_DIGIT = byte_table(bytes(range(65, 91))), byte_table(bytes([*range(65, 91), *range(97, 123)])), byte_table(b"0123456789")
IS_PUNCTUATION = byte_table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
FIRST_BYTE = np.ones(256, bool)
FIRST_BYTE[0x80:0xC0] = False


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring edges."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(upto[edges])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def own_keys(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values of one text."""
    return mix(value + mix(doc.astype(np.uint64) + np.uint64(1)))


def repeat_words(words: Words, h: np.ndarray, size: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more in it."""
    value, begins = window_hashes(words, h, size, short=False)
    doc = np.searchsorted(words.first, begins, "right") - 1
    again = begins[repeated(own_keys(value, doc))]
    steps = np.zeros(len(h) + size + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + size, -1)
    return per_text(np.cumsum(steps)[: len(h)] > 0, words.first)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line; lines end at a line feed or at the end of the text."""
    breaks = np.flatnonzero(data == 10)
    docs = np.arange(len(offsets) - 1)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([offsets[1:], breaks])
    of_start = np.concatenate([docs, np.searchsorted(offsets[1:], breaks, "right")])
    # Sorted by text and place, the k-th start belongs to the k-th end.
    first, last = np.lexsort((starts, of_start)), np.lexsort((ends, of_start))
    return starts[first], ends[last], of_start[first]


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text with a word and equal to an earlier line; and all lines with a word."""
    starts, ends, doc = line_spans(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
    filled = solid[ends] > solid[starts]
    starts, ends, doc = starts[filled], ends[filled], doc[filled]
    keys = own_keys(span_hashes(data, starts, ends), doc)
    n = len(offsets) - 1
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(doc, minlength=n)
    return lines - np.bincount(doc[first], minlength=n), lines


def base_measures(texts: pa.Array) -> tuple[Words, np.ndarray, dict[str, np.ndarray]]:
    """Words, their hashes, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = text_buffers(texts)
    words = find_words(data, offsets)
    h = words.hashes()
    dup, _ = duplicate_lines(data, offsets)
    return words, h, {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(FIRST_BYTE[data] & ~SPACE[data], offsets),
        "n_symbols": per_text(IS_SYMBOL[data], offsets),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": repeat_words(words, h),
    }
