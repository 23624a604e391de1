"""Byte-level BPE encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no token of the vocabulary is a certain
cut: no merge can ever reach across it.  Texts are cut there and where the pre-tokenizer
cuts, each distinct fragment of a slice of texts is merged once, and the ids of the
fragments are put in a row.  All cuts of a slice are found at once on its bytes.

The pre-tokenizer's words are runs of letters, of numbers, or of other signs, with one
space in front; an apostrophe with one of ``ENDINGS`` behind a word; and runs of white
space, of which the last sign stands alone if a word without a space in front follows.
Strings of added tokens are found first and keep their ids.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.words import small_slices, span_hashes, text_buffers
from gridsift.session import ship_package

# Fixed values of the pre-tokenizer.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SLICE_BYTES = 2 << 20
#: Fragments of up to so many bytes are merged many at a time.
SHORT = 32
#: Kept fragments of a worker, by number and by bytes; they are forgotten together.
KEPT, KEPT_BYTES = 1 << 19, 1 << 23
#: So many ids are decoded at a time (of one row at least).
DECODED_IDS = 1 << 18


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a vocabulary file: itself if it is printable, else one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [chr(b) for b in range(256)], 0
    for b in range(256):
        if b not in plain:
            out[b] = chr(0x100 + more)
            more += 1
    return out


def sign_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, SPACES + "+")):
        for run in regex.finditer(pattern, everything):
            out[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    return out


class Bpe:
    """A vocabulary file: merges by rank, tokens as bytes, and the table of cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        _check(told)
        value = {sign: b for b, sign in enumerate(byte_signs())}
        vocabulary = told["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.added.values()])
        self.token = [b""] * size
        for token, i in vocabulary.items():
            self.token[i] = bytes(value[sign] for sign in token)
        for token, i in self.added.items():
            self.token[i] = token.encode()
        self.single = [vocabulary[sign] for sign in byte_signs()]
        self.merges = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        keys = np.array([left << 32 | right for left, right in self.merges], np.int64)
        found = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.pair, self.rank, self.joined = keys[order], found[order, 0], found[:, 1]
        self.single_ids = np.array(self.single, np.int64)
        #: Whether a cut is certain between two bytes, by 256 * left + right.
        self.cut = np.ones(1 << 16, bool)
        for i in vocabulary.values():
            token = np.frombuffer(self.token[i], np.uint8).astype(np.int64)
            self.cut[token[:-1] * 256 + token[1:]] = False
        self.classes = sign_classes()
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.kept: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.kept.clear()
        self.kept_ids, self.kept_at, self.kept_bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: the merge of least rank, then the leftmost, is done first, again and again."""
        ids = [self.single[b] for b in fragment]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, joined = heapq.heappop(heap)
            other = after[k]
            if ids[k] != left or other >= n or ids[other] != right:
                continue
            ids[k], ids[other] = joined, -1
            after[k] = end = after[other]
            if end < n:
                before[end] = k
                if found := merges.get((joined, ids[end])):
                    heapq.heappush(heap, (found[0], k, joined, ids[end], found[1]))
            if (front := before[k]) >= 0 and (found := merges.get((ids[front], joined))):
                heapq.heappush(heap, (found[0], front, ids[front], joined, found[1]))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs, a rank of no merge where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], len(self.pair))

    def merged_many(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short fragments in a row, and their numbers: each step does the next merge of every fragment."""
        lengths, none = np.array([len(f) for f in fragments], np.int64), len(self.pair)
        ids = self.single_ids[np.frombuffer(b"".join(fragments), np.uint8)]
        owner = np.repeat(np.arange(len(fragments)), lengths)
        rank = np.full(len(ids), none, np.int64)
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pairs] = self._ranks(ids[pairs], ids[pairs + 1])
        done = []
        while len(ids):
            n = len(ids)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank * n + np.arange(n), first)
            open_ = least < none * n
            live = np.repeat(open_, np.diff(np.append(first, n)))
            done.append((owner[~live], ids[~live]))
            at = least[open_] % n
            ids[at] = self.joined[rank[at]]
            live[at + 1] = False
            place = np.cumsum(live) - 1
            at = place[at]
            ids, owner, rank = ids[live], owner[live], rank[live]
            # Ranks change where a merge was done: of the pair behind it, and of the one in front.
            rank[at] = none
            front = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            behind = at[at + 1 < len(ids)]
            behind = behind[owner[behind + 1] == owner[behind]]
            changed = np.concatenate([front, behind])
            rank[changed] = self._ranks(ids[changed], ids[changed + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (owner, ids)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(fragments))

    def word_starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which bytes begin a word of the pre-tokenizer; the texts stand in ``raw`` one after another."""
        first = (raw & 0xC0) != 0x80
        at = np.flatnonzero(first)
        signs = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[signs]
        n = len(signs)
        begins = np.zeros(n + 1, bool)
        begins[np.searchsorted(at, offsets)] = True
        ends = begins[1:]
        begin = begins[:-1].copy()
        # Where the class changes, a word or a run of white space begins ...
        begin[1:] |= kind[1:] != kind[:-1]
        # ... but the last sign of a run of white space in front of a word is not of the run:
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE)
        last &= ~ends
        joins = last & (signs == 32)
        begin |= last
        # a space goes with the word, another sign stands alone.
        begin[1:] &= ~joins[:-1]
        # An apostrophe that begins a word takes an ending with it; what is left is a word of its own.
        for k in np.flatnonzero(begin & (signs == 39)).tolist() if (signs == 39).any() else ():
            for ending in ENDINGS:
                stop = k + 1 + len(ending)
                if stop <= n and not begins[k + 1 : stop].any() and all(signs[k + 1 + i] == ord(c) for i, c in enumerate(ending)):
                    begin[k + 1] = False
                    if stop < n:
                        begin[stop] |= not joins[stop - 1]
                    break
        out = np.zeros(len(raw), bool)
        out[at] = begin
        return out

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin."""
        if not len(raw):
            return np.zeros(0, np.int64)
        begin = self.word_starts(raw, offsets)
        begin[1:] |= self.cut[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        return np.flatnonzero(begin)

    def _places(self, fragments: list[bytes]) -> np.ndarray:
        """Where the kept ids of fragments are; new ones are merged."""
        if len(self.kept) > KEPT or self.kept_bytes > KEPT_BYTES:
            self._forget()
        kept = self.kept
        for some in ([f for f in fragments if len(f) <= SHORT and f not in kept], [f for f in fragments if len(f) > SHORT and f not in kept]):
            if not some:
                continue
            if len(some[0]) <= SHORT:
                ids, counts = self.merged_many(some)
            else:
                each = [self.merged(f) for f in some]
                ids, counts = np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
            kept.update(zip(some, range(len(kept), len(kept) + len(some)), strict=True))
            self.kept_at = np.concatenate([self.kept_at, self.kept_at[-1] + np.cumsum(counts)])
            self.kept_ids = np.concatenate([self.kept_ids, ids])
            self.kept_bytes += sum(map(len, some))
        return np.array([kept[f] for f in fragments], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number in each text."""
        raw, offsets = text_buffers(texts)
        data = raw.tobytes()
        # Added tokens stand between texts of their own.
        cuts, tokens = [], []
        if any(t.encode() in data for t in self.added):
            import regex

            pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)).encode())
            edges = set(offsets.tolist())
            for text_start, text_end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for found in pattern.finditer(data, text_start, text_end):
                    cuts.append(found.span())
                    tokens.append(self.added[found[0].decode()])
            edges = np.array(sorted(edges.union(*map(set, cuts))), np.int64)
        else:
            edges = offsets
        starts = self.fragments(raw, edges)
        ends = np.append(starts[1:], len(raw))
        if cuts:
            # The fragments of an added token make way for one that spans it.
            span = np.array(cuts, np.int64)
            inside = np.searchsorted(span[:, 0], starts, "right") - 1
            own = (inside >= 0) & (starts < span[inside, 1])
            starts, ends = starts[~own], ends[~own]
        hashes = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        code, distinct = pd.factorize(hashes)
        where = np.zeros(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        if not same_spans(raw, starts, ends, starts[where][code], ends[where][code]):
            code, found = pd.factorize(np.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
            where = np.zeros(len(found), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
        place = self._places([data[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        flat, at, lengths = self.kept_ids, self.kept_at[place], self.kept_at[place + 1] - self.kept_at[place]
        if cuts:
            order = np.argsort(np.concatenate([starts, span[:, 0]]), kind="stable")
            starts = np.concatenate([starts, span[:, 0]])[order]
            code = np.concatenate([code, np.arange(len(place), len(place) + len(tokens))])[order]
            at = np.concatenate([at, len(flat) + np.arange(len(tokens))])
            lengths = np.concatenate([lengths, np.ones(len(tokens), np.int64)])
            flat = np.concatenate([flat, np.array(tokens, np.int32)])
        ids = gathered(flat, at, lengths, code)
        upto = np.concatenate([[0], np.cumsum(lengths[code])])
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and where each begins (one entry more)."""
        data = gathered(self.flat, self.places, self.lengths, ids)
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        return data, upto[np.concatenate([[0], np.cumsum(counts)])]


def _check(told: dict) -> None:
    """Only files whose rules are those of this module are read."""
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    splits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in told["added_tokens"])
    if not (plain and splits and added) or told["normalizer"] is not None or (told["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError("not a byte-level vocabulary file of the known kind")


def gathered(flat: np.ndarray, places: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The spans ``code`` of a flat table, one after another."""
    n = lengths[code]
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(places[code] - upto[:-1], n) + np.arange(upto[-1])]


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_ends: np.ndarray) -> bool:
    """Whether each span has the bytes of the other one."""
    left = ends - starts
    if not (left == other_ends - other).all():
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rest, done = np.flatnonzero(starts != other), 0
    while len(rest):
        short = np.minimum(left[rest] - done, 8).astype(np.uint64)
        mask = np.where(short == 8, ~np.uint64(0), (np.uint64(1) << (short % np.uint64(8) * np.uint64(8))) - np.uint64(1))
        if ((eight[starts[rest] + done] ^ eight[other[rest] + done]) & mask).any():
            return False
        done += 8
        rest = rest[left[rest] > done]
    return True


_READ: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """The vocabulary of this Python worker."""
    if path not in _READ:
        _READ[path] = Bpe(path)
    return _READ[path]


def _encoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for part in small_slices(batch, 1, SLICE_BYTES):
                ids, counts = own.encode(part.column(1))
                places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(places), pa.array(ids))], ["id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids.

    ``path`` is a vocabulary file that all executors can read; it is not changed.  Ids
    are those the file's library gives without special tokens around the text; strings
    of added tokens in a text get their ids.  A null or empty text has no ids.  Ids of rows
    keep their type, null and repeated ones too, and other columns are not read.  Texts
    of any length are encoded whole; a task holds a slice of about a megabyte, or one text.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return slim.mapInArrow(_encoded(path), f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def _decoded(path: str, kept: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + DECODED_IDS, "right")) - 1)
                part, counts = batch.slice(at, end - at), np.diff(upto[at : end + 1])
                data, edges = own.decode(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *(part.column(c) for c in kept)], ["id", "text", *kept])
                at = end

    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """Texts of encoded rows: id, text (null or no ids: an empty text) and the columns ``keep``, which may name the ids.

    Added tokens give their strings.  Bytes that are not UTF-8, which ids of no text can
    give, become replacement signs.
    """
    ship_package(encoded.sparkSession)
    given = [ids_col, *(c for c in keep if c != ids_col)]
    slim = encoded.select(F.col(id_col).alias("id"), *given)
    kinds = ", ".join([f"id {slim.schema['id'].dataType.simpleString()}", "text string", *(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)])
    return slim.mapInArrow(_decoded(path, list(keep)), kinds).withColumnRenamed("id", id_col)
