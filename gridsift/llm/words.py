"""Words of whole Arrow text batches, found and hashed with numpy on the UTF-8 bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``; all separators are single bytes, so
words can be found in the bytes.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
PIECE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h + np.uint64((seed * int(_A) + int(_C)) % (1 << 64)))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one entry more); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, content = texts.buffers()
    if not len(texts) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_slices(batch: pa.RecordBatch, text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``limit`` bytes of text (one row at least)."""
    _, offsets = text_buffers(batch.column(text))
    at, rows = 0, batch.num_rows
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text ``d``; ``starts``/``ends`` are bytes of ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    filled = np.diff(offsets) > 0
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[offsets[:-1][filled]] = solid[offsets[:-1][filled]]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[offsets[1:][filled] - 1] = solid[offsets[1:][filled] - 1]
    starts = np.flatnonzero(opens)
    return Words(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, taken eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * _A ^ (eight[starts] & _FIRST[np.minimum(left, 8)]))
    rest = np.flatnonzero(left > 8)
    done = 8
    while len(rest):
        block = eight[starts[rest] + done] & _FIRST[np.minimum(left[rest] - done, 8)]
        h[rest] = mix(h[rest] * _A ^ block)
        done += 8
        rest = rest[left[rest] > done]
    return h


def window_hashes(words: Words, h: np.ndarray, size: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of ``size`` words within a text.

    With ``short`` a text of 1 to ``size - 1`` words gives one window of all its words.
    """
    n = len(h)
    counts = words.counts
    last = np.repeat(words.first[1:], counts)
    begins = np.flatnonzero(np.arange(n) + size <= last)
    h = mix(h + _C)
    value = np.full(len(begins), size, np.uint64)
    for k in range(size):
        value = mix(value * _A + h[begins + k])
    if short and (few := np.flatnonzero((counts > 0) & (counts < size))).size:
        own = np.empty(len(few), np.uint64)
        for i, d in enumerate(few):
            v = np.full(1, counts[d], np.uint64)
            for x in range(words.first[d], words.first[d + 1]):
                v = mix(v * _A + h[x : x + 1])
            own[i] = v[0]
        begins = np.concatenate([begins, words.first[few]])
        value = np.concatenate([value, own])
        order = np.argsort(begins, kind="stable")
        begins, value = begins[order], value[order]
    return value, begins
