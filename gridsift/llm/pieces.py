"""Sampled SentencePiece segmentations, and their lossless decoding.

The lattice of a text has an edge for each piece of the vocabulary that occurs in it.
Forward filtering sums the weights of all ways to each place; backward sampling draws
the last piece in proportion to its share, then the one before it, and so on, which
samples whole segmentations in proportion to the product of their piece weights.  A
piece of rank r weighs (1 + r) ** -sharpness, as the vocabulary is in order of rank.

Some pieces are runs of word marks, and no piece has a mark behind another sign, so
lattices fall apart where a run of marks begins, exactly (a run and the word behind it
are one chunk; for a model with other pieces, marks open no chunk).  The forward sums of
each distinct chunk of a slice of texts are taken once, many chunks at a time along a
trie of the pieces, and only the draws are made per occurrence.  A draw is a hash of
seed, row key, number of the chunk in the text and number of the draw, so it depends on
nothing else.

Spaces stand as one byte that UTF-8 never has, so a literal word mark, a line feed and
all that no piece covers go through byte pieces, and every text decodes to itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm.words import mix, seeded, small_slices, span_hashes, text_buffers
from gridsift.session import ship_package

SHARPNESS = 1.0
SEED = 1
MARK = 0xFF
#: Chunks of up to so many bytes are filtered many at a time.
SHORT = 32
CELLS = 1 << 20
#: So many ids are decoded at a time (of one row at least).
DECODED_IDS = 1 << 18
BYTE_WEIGHT = -30.0


class Lattice:
    """Pieces of a model file, and the lattices of texts."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        known: dict[bytes, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.encode().replace("▁".encode(), bytes([MARK]))
                self.bytes_of.append(text)
                known.setdefault(text, (i, -sharpness * float(np.log1p(i))))
        self.known = known
        self.longest = max(map(len, known))
        # Every byte can stand alone as a byte piece, unless it is a piece itself.
        self.alone = np.array([known.get(bytes([b]), (int(self.byte_id[b]), BYTE_WEIGHT))[0] for b in range(256)])
        self.alone_weight = np.array([known.get(bytes([b]), (0, BYTE_WEIGHT))[1] for b in range(256)])
        inside = np.zeros(256, bool)
        inside[list(set(b"".join(known)))] = True
        self.breaks = ~inside
        self.marks_open = not any(bytes([MARK]) in x.lstrip(bytes([MARK])) for x in known)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.array([len(x) for x in self.bytes_of])
        self.at = np.cumsum(self.lengths) - self.lengths
        self._plant()

    def _plant(self) -> None:
        """The trie of the pieces: ``next[node, sign]`` (0: none, 1: the root), and the piece that ends at a node."""
        signs = sorted(set(b"".join(self.known)))
        self.sign = np.full(256, len(signs), np.int64)
        self.sign[signs] = np.arange(len(signs))
        children: list[dict[int, int]] = [{}, {}]
        ends: dict[int, tuple[int, float]] = {}
        for text, piece in self.known.items():
            node = 1
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = piece
        self.next = np.zeros((len(children), len(signs) + 1), np.int32)
        for node, own in enumerate(children):
            for byte, child in own.items():
                self.next[node, self.sign[byte]] = child
        self.ids, self.weights = np.zeros(len(children), np.int32), np.full(len(children), -np.inf)
        for node, (piece, weight) in ends.items():
            self.ids[node], self.weights[node] = piece, weight

    def _filter(self, block: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ways into each place of chunks of one length (rows): count per place, then share summed up, id and length."""
        n, size = block.shape
        most = min(size, self.longest)
        weight = np.full((n, size, most), -np.inf)
        ids = np.zeros((n, size, most), np.int32)
        sign, node = self.sign[block], np.ones((n, size), np.int32)
        for length in range(1, most + 1):
            node = self.next[node[:, : size - length + 1], sign[:, length - 1 :]]
            if not node.any():
                break
            weight[:, length - 1 :, length - 1], ids[:, length - 1 :, length - 1] = self.weights[node], self.ids[node]
        weight[:, :, 0], ids[:, :, 0] = self.alone_weight[block], self.alone[block]
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        for end in range(1, size + 1):
            width = min(end, most)
            ways = weight[:, end - 1, :width] + total[:, end - width : end][:, ::-1]
            top = ways.max(axis=1)
            total[:, end] = top + np.log(np.exp(ways - top[:, None]).sum(axis=1))
            weight[:, end - 1, :width] = np.exp(ways - total[:, end, None])
            weight[:, end - 1, width:] = 0
        open_ = weight > 0
        share = np.cumsum(weight, axis=2)
        lengths = np.broadcast_to(np.arange(1, most + 1, dtype=np.int32), weight.shape)
        return open_.sum(axis=2).reshape(-1), share[open_], ids[open_], lengths[open_]

    def _filter_long(self, chunk: bytes) -> tuple[np.ndarray, ...]:
        """The same for one chunk of any length, place by place."""
        total = np.full(len(chunk) + 1, -np.inf)
        total[0] = 0
        counts, upto, way, back = [], [], [], []
        for end in range(1, len(chunk) + 1):
            last = chunk[end - 1]
            found = [(self.alone_weight[last] + total[end - 1], self.alone[last], 1)]
            for length in range(2, min(end, self.longest) + 1):
                if (piece := self.known.get(chunk[end - length : end])) is not None:
                    found.append((piece[1] + total[end - length], piece[0], length))
            ways = np.array([f[0] for f in found])
            total[end] = ways.max() + np.log(np.exp(ways - ways.max()).sum())
            share = np.exp(ways - total[end])
            some = share > 0
            counts.append(int(some.sum()))
            upto.append(np.cumsum(share)[some])
            way += [f[1] for f, s in zip(found, some, strict=True) if s]
            back += [f[2] for f, s in zip(found, some, strict=True) if s]
        return np.array(counts), np.concatenate(upto), np.array(way, np.int32), np.array(back, np.int32)

    def _ways(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ways into the places of chunks: ``base[chunk] + end - 1`` is the row of a place, ``edge[row]:edge[row + 1]`` its ways."""
        base, counts, parts, rows = np.empty(len(starts), np.int64), [], [], 0
        for size in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == size)
            step = max(1, CELLS // (size * min(size, self.longest))) if size <= SHORT else 1
            for k in range(0, len(group), step):
                own = group[k : k + step]
                if size <= SHORT:
                    found = self._filter(data[starts[own][:, None] + np.arange(size)])
                else:
                    found = self._filter_long(data[starts[own[0]] : starts[own[0]] + size].tobytes())
                base[own] = rows + np.arange(len(own)) * size
                counts.append(found[0])
                parts.append(found[1:])
                rows += len(own) * size
        edge = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return base, edge, *(np.concatenate(x) for x in zip(*parts, strict=True))

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each chunk (and the end of all), and the first chunk of each text.  Every text begins with a mark."""
        cut = self.breaks[data]
        mark = (data == MARK) & self.marks_open
        opens = mark | cut
        opens[1:] = (mark[1:] & ~mark[:-1]) | cut[1:] | cut[:-1]
        opens[offsets[:-1]] = True
        starts = np.flatnonzero(opens)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts in a row, and their number in each text."""
        raw, offsets = text_buffers(texts)
        data = np.insert(np.where(raw == 32, np.uint8(MARK), raw), offsets[:-1], MARK)
        offsets = offsets + np.arange(len(offsets))
        starts, ends, first = self.chunks(data, offsets)
        code, distinct = pd.factorize(span_hashes(data, starts, ends))
        where = np.zeros(len(distinct), np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        base, edge, share, way, back = self._ways(data, starts[where], (ends - starts)[where])

        counts = np.diff(first)
        number = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        noise = mix(np.repeat(seeded(keys.astype(np.int64).view(np.uint64), seed), counts) + mix(number.astype(np.uint64)))
        base, left = base[code], ends - starts
        live = np.arange(len(starts))
        drawn, pieces = [], np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            step += 1
            u = (seeded(noise[live], step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            row = base[live] + left[live] - 1
            at, last = edge[row], edge[row + 1] - 1
            open_ = np.flatnonzero((at < last) & (share[at] <= u))
            while len(open_):
                at[open_] += 1
                open_ = open_[(at[open_] < last[open_]) & (share[at[open_]] <= u[open_])]
            drawn.append((live, way[at]))
            pieces[live] += 1
            left[live] -= back[at]
            live = live[left[live] > 0]
        upto = np.concatenate([[0], np.cumsum(pieces)])
        ids = np.empty(upto[-1], np.int32)
        # Draws go from the end of a chunk to its start.
        place = upto[1:] - 1
        for chunk, drawn_ids in drawn:
            ids[place[chunk]] = drawn_ids
            place[chunk] -= 1
        return ids, np.diff(upto[first])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and where each begins (one entry more)."""
        lengths = self.lengths[ids]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        data = self.flat[np.repeat(self.at[ids] - upto[:-1], lengths) + np.arange(upto[-1])]
        edges = upto[np.concatenate([[0], np.cumsum(counts)])]
        # The mark in front of each text is no space of it.
        data = np.delete(np.where(data == MARK, np.uint8(32), data), edges[:-1][counts > 0])
        return data, edges - np.concatenate([[0], np.cumsum(counts > 0)])


_LATTICES: dict = {}


def lattice(path: str, sharpness: float = SHARPNESS) -> Lattice:
    """The lattice of this Python worker."""
    if (path, sharpness) not in _LATTICES:
        _LATTICES[path, sharpness] = Lattice(path, sharpness)
    return _LATTICES[path, sharpness]


def _encoded(path: str, sharpness: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, sharpness)
        for batch in batches:
            for part in small_slices(batch, 1, 1 << 20):
                ids, counts = own.encode(part.column(1), part.column(0).fill_null(0).to_numpy(), seed)
                data, offsets = text_buffers(part.column(1))
                back, edges = own.decode(ids, counts)
                if len(back) != len(data) or not (back == data).all() or not (edges == offsets).all():
                    raise ValueError("a text does not decode to itself")
                places = np.concatenate([[0], np.cumsum(counts)])
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                text_crc = [zlib.crc32(text[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64())]
                names = ["id", "n_pieces", "ids_crc32", "decoded_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_pieces, ids_crc32, decoded_crc32 and, with ``with_ids``, ids.

    ``model`` is the path of a SentencePiece model that all executors can read; it is
    not trained or changed.  Ids depend on the text, the row's id and the seed only, so
    reruns and repeated rows agree (a null id samples as 0).  A null text counts as
    empty; an empty text is one word mark.  Every text is decoded again and must
    come out byte by byte; ``decoded_crc32`` is the CRC-32 of what came out.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = "id long, n_pieces long, ids_crc32 long, decoded_crc32 long" + ", ids array<int>" * with_ids
    return slim.mapInArrow(_encoded(model, sharpness, seed, with_ids), kinds).withColumnRenamed("id", id_col)


def _decoded(path: str, kept: list[str]):
    """(id, ids, ...) batches to id, text and the columns ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + DECODED_IDS, "right")) - 1)
                part, counts = batch.slice(at, end - at), np.diff(upto[at : end + 1])
                data, edges = own.decode(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *(part.column(c) for c in kept)], ["id", "text", *kept])
                at = end

    return run


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """Texts of encoded rows: id, text (null or no ids: an empty text) and the columns ``keep``, which may name the ids."""
    ship_package(encoded.sparkSession)
    given = [ids_col, *(c for c in keep if c != ids_col)]
    slim = encoded.select(F.col(id_col).cast("long").alias("id"), *given)
    kinds = ", ".join(["id long", "text string", *(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)])
    return slim.mapInArrow(_decoded(model, list(keep)), kinds).withColumnRenamed("id", id_col)
