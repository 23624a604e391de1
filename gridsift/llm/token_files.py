"""Token ids in binary files: frequency-ranked, byte-aligned variable-length codes.

A file is a row of blocks, each followed by one line feed.  All numbers are little-endian.

    head       magic FRVB, version, length of the block, part, block, documents, ids, ranks
    documents  id (8 bytes), 1 byte for a null id, ids (4 bytes), column after column
    ranks      the token id of each rank (4 bytes), the most frequent of the block first
    control    2 bits for each id, four to a byte from the low end: bytes of its rank less one
    data       the bytes of the ranks

The ids of a block are replaced by their rank in it, so the 256 most frequent take
one byte of data each.  Control bytes stand apart from the data: decoding looks the
four lengths of a control byte up in a table, sums them to places, and gathers.
Parts and blocks are numbered in document order.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.shared import running_sums, saved
from gridsift.llm.words import LOWER, find_words, small_slices, span_hashes, text_buffers
from gridsift.session import ship_package

END_ID = 2
BLOCK_IDS = 1 << 21
BLOCKS_PER_FILE = 16
CACHED_WORDS = 1 << 19
SLICE_BYTES = 4 << 20

HEAD = struct.Struct("<4sIQIIIQI")
LENGTHS = np.array([[(c >> (2 * k)) & 3 for k in range(4)] for c in range(256)], np.uint8) + np.uint8(1)

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _places(data: bytes, wanted: bytes) -> Iterator[int]:
    at = data.find(wanted)
    while at >= 0:
        yield at
        at = data.find(wanted, at + 1)


class Encoder:
    """Token ids of whole texts from a ``tokenizers`` file, without special tokens.

    ``by_word`` is for tokenizers that drop white space and never join across it (as
    those that split before and lower-case do): every distinct word is given to the
    library once and its ids are kept.  Only ASCII words are lower-cased beforehand,
    and a last full stop or comma is cut off only behind an ASCII letter or digit;
    words with the text of an added token, in any letter case, stay as they are, since
    the library looks for these before it lower-cases.  So neither changes what the
    library returns.  Texts stay whole if an added token holds white space.  At most
    ``CACHED_WORDS`` words and one slice are held.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = by_word and not any(re.search(r"\s", x) for x in added)
        self.added = [x.encode().lower() for x in added]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, counts.sum()), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number in each text."""
        if not self.by_word:
            return self._ids_of([t or "" for t in texts.to_pylist()])
        data, offsets = text_buffers(texts)
        words = find_words(data, offsets)
        starts, ends = words.starts, words.ends
        high = np.concatenate([[0], np.cumsum(data >= 128)])
        added = np.zeros(len(starts), bool)
        lower = LOWER[data]
        # Texts stand side by side, so a match may run into the next one: all places count.
        places = np.array([k for x in self.added for k in _places(lower.tobytes(), x)], np.int64)
        added[np.searchsorted(starts, places, "right") - 1] = True
        foreign = np.flatnonzero((high[ends] > high[starts]) | added)
        steps = np.zeros(len(data) + 1, np.int8)
        steps[starts[foreign]] += 1
        steps[ends[foreign]] -= 1
        data = np.where(np.cumsum(steps[:-1], dtype=np.int8) > 0, data, lower)
        last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        cut = np.flatnonzero(~added & (ends - starts > 1) & ((last == 46) | (last == 44)) & ALNUM[data[np.maximum(ends - 2, 0)]])
        first = words.first + np.searchsorted(cut, words.first)
        starts, ends = np.insert(starts, cut + 1, ends[cut] - 1), np.insert(ends, cut, ends[cut] - 1)

        code, distinct = pd.factorize(span_hashes(data, starts, ends))
        if len(self.slots) + len(distinct) > CACHED_WORDS:
            self._forget()
        where = np.zeros(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        slots = np.fromiter(map(self.slots.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        if (new := np.flatnonzero(slots < 0)).size:
            raw = data.tobytes()
            spans = zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)
            ids, counts = self._ids_of([raw[a:b].decode("utf-8", "replace") for a, b in spans])
            slots[new] = np.arange(len(new)) + len(self.at) - 1
            self.slots.update(zip(distinct[new].tolist(), slots[new].tolist(), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        slot = slots[code]
        counts = self.at[slot + 1] - self.at[slot]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.at[slot] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[first])


def pack_block(ids: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray, counts: np.ndarray, part: int, block: int) -> bytes:
    often = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.argsort(-often, kind="stable")[: np.count_nonzero(often)].astype("<u4")
    rank_of = np.zeros(len(often), "<u4")
    rank_of[table] = np.arange(len(table))
    ranks = rank_of[ids]
    more = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control = np.concatenate([more, np.zeros(-len(more) % 4, np.uint8)]).reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    body = b"".join(x.tobytes() for x in (doc_ids.astype("<i8"), no_id.astype(np.uint8), counts.astype("<u4"), table, control.astype(np.uint8), data))
    return HEAD.pack(b"FRVB", 1, HEAD.size + len(body), part, block, len(doc_ids), len(ids), len(table)) + body


def unpack_blocks(content: memoryview) -> Iterator[tuple]:
    """(part, block, doc ids, null ids, counts, token ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, version, length, part, block, docs, n, ranked = HEAD.unpack_from(content, at)
        if magic != b"FRVB" or version != 1 or content[at + length] != 10:
            raise ValueError("not a block of token ids")
        place = at + HEAD.size

        def take(kind, count):
            nonlocal place
            out = np.frombuffer(content, kind, count, place)
            place += out.nbytes
            return out

        doc_ids, no_id, counts, table, control = take("<i8", docs), take(np.uint8, docs), take("<u4", docs), take("<u4", ranked), take(np.uint8, -(-n // 4))
        data = take(np.uint8, at + length - place)
        lengths = LENGTHS[control].reshape(-1)[:n]
        places = np.cumsum(lengths, dtype=np.int64) - lengths
        ranks = data[places].astype(np.uint32) if n else np.zeros(0, np.uint32)
        for k in range(1, 4):
            if (longer := np.flatnonzero(lengths > k)).size:
                ranks[longer] |= data[places[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        yield part, block, doc_ids, no_id, counts, table[ranks]
        at += length + 1


def _packed(path: str, by_word: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, held, size = _encoder(path, by_word), TaskContext.get().partitionId(), 0, [], 0

        def full():
            nonlocal block, held, size
            ids, doc_ids, no_id, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            block, held, size = block + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([pack_block(ids, doc_ids, no_id, counts, part, block - 1)], pa.binary())], ["record"])

        for batch in batches:
            for piece in small_slices(batch, 1, SLICE_BYTES):
                ids, counts = encoder.encode(piece.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                no_id = piece.column(0).is_null().to_numpy(zero_copy_only=False)
                held.append((ids, piece.column(0).fill_null(0).to_numpy(), no_id, counts + 1))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield full()
        if held:
            yield full()

    return run


_ENCODERS: dict = {}


def _encoder(path: str, by_word: bool) -> Encoder:
    """The encoder of this Python worker, with the words it has met so far."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True, end_id: int = END_ID) -> None:
    """Write the ids of every text to ``folder``, in ascending id order (null ids first, rows of one id by the hash of their text).

    ``tokenizer`` is the path of a ``tokenizers`` file that all executors can read.
    A null text counts as empty; every document ends with ``end_id``.  The text
    writer commits whole files only, so a lost executor leaves no half file.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ship_package(docs.sparkSession)
    # By id and text, so rows of one id, or without, are dealt to many tasks.
    tied = slim.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    blocks = ordered.mapInArrow(_packed(tokenizer, by_word, end_id), "record binary")
    blocks.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(folder)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            content = memoryview(batch.column(0)[row].as_buffer())
            for part, block, doc_ids, no_id, counts, ids in unpack_blocks(content):
                upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(upto.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, block, np.int64)), pa.array(doc_ids, pa.int64(), mask=no_id.astype(bool)),
                        pa.array(upto[:-1]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()),
                    ],
                    ["part", "block", "id", "inside", "n_tokens", "ids_crc32"],
                )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            for _, _, doc_ids, no_id, counts, ids in unpack_blocks(memoryview(batch.column(0)[row].as_buffer())):
                places = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=no_id.astype(bool)), pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32)))], ["id", "ids"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files: id and ids, in no order."""
    return _files(spark, folder).mapInArrow(_documents, "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_table(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start (ids before it in file order), n_tokens, ids_crc32."""
    rows = saved(_files(spark, folder).mapInArrow(_summaries, "part long, block long, id long, inside long, n_tokens long, ids_crc32 long"), "tokens")
    blocks = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    bases = running_sums(blocks, [], ["part", "block"], {"n": "base"}).select("part", "block", "base")
    return rows.join(bases, ["part", "block"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
