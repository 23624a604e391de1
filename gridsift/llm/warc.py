"""WARC archives of pages, with repeated payloads as revisits, and their chunk table.

Writing: payload digests are merged over all pages first, so each page knows whether
it is the first with its payload.  A payload over ``SEGMENT`` bytes is written as a
segmented record (the first segment in the response, the others in ``continuation``
records), so no archive record is larger.  Spark's text writer puts the two line
ends behind each record and commits whole files.

Reading: archives are inflated and parsed piece by piece into rows of a record
identifier and a chunk number, at most ``CHUNK`` bytes each.  A SHA-1 state goes
along with the chunks of a payload, so the digest is known at its last chunk and
no payload is put together.  (The compressed bytes of an archive come as one value, and a
page's html as one text, as Spark hands them out: up to 2 GB each.)
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.exact_dedup import RUNS, SAME, merge_runs
from gridsift.llm.shared import saved
from gridsift.llm.words import text_buffers
from gridsift.plans.joins import join_small
from gridsift.session import ship_package

SEGMENT = 1 << 20
CHUNK = 1 << 16
LEAST_REVISIT = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(page: int | None, url: str | None, payload: memoryview, digest: str, first: int | None, revisit: bool, suffix: str = "") -> Iterator[bytes]:
    """The archive records of a page, without the line ends behind them; a payload is copied a segment at a time."""
    name = f"{ID}{'' if page is None else page}{suffix}"
    about = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        about.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        yield _record("revisit", name, [*about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{'' if first is None else first}>"), kind], http)
        return
    if len(http) + len(payload) <= SEGMENT:
        yield _record("response", name, [*about, kind], http + bytes(payload))
        return
    at = SEGMENT - len(http)
    yield _record("response", name, [*about, ("WARC-Segment-Number", "1"), kind], http + bytes(payload[:at]))
    number = 2
    while at < len(payload):
        piece = bytes(payload[at : at + SEGMENT])
        at += len(piece)
        end = [("WARC-Segment-Total-Length", str(len(http) + len(payload)))] if at >= len(payload) else []
        yield _record("continuation", f"{name}#{number}", [("WARC-Segment-Number", str(number)), ("WARC-Segment-Origin-ID", f"<{name}>"), *end], piece)
        number += 1


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, html, digest, first, revisit, suffix) rows to archive records, each row on its own."""
    for batch in batches:
        data, places = text_buffers(batch.column(2))
        view, places = memoryview(data), places.tolist()
        page, url, digest, first, revisit, suffix = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))
        out, size = [], 0
        for row in range(batch.num_rows):
            payload = view[places[row] : places[row + 1]]
            for record in page_records(page[row], url[row], payload, base32(digest[row]), first[row], revisit[row], suffix[row]):
                out.append(record)
                size += len(record)
                if size >= 4 * SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write one record per row of ``pages`` (gzip archives).

    A null payload is empty.  Of equal payloads of at least ``least`` bytes the
    smallest id (a null id last) is a response and the others revisit it; rows that
    repeat id and payload revisit one of them.  A null url leaves its header out.  Record
    names of ids with several rows end in the payload digest, and in the row's number where
    that repeats too.  Ids are cast to long; other columns are not read.

    Each row meets its own role by id and digest, so rows of one id, or without id, are
    written by many tasks; what a task got is one archive file.  A row's html is held once,
    and its record is cut from it a segment at a time.
    """
    ship_package(pages.sparkSession)
    slim = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # One key without nulls for ids and digests together.
    key = F.struct(F.col("page").isNull().alias("none"), F.coalesce("page", F.lit(0)).alias("id"))
    slim = slim.withColumns({"key": key, "digest": F.unhex(F.sha1(F.col("html").cast("binary")))})
    best = F.struct(F.col("page").isNull().alias("no_id"), F.col("page").alias("id"))
    keys = slim.select(
        "key", F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), F.monotonically_increasing_id().alias("row"),
        "digest", F.octet_length("html").cast("long").alias("same_length"), F.xxhash64("html").alias("same_hash"), best.alias("best"),
    )
    roles = merge_runs(saved(keys, "payloads")).groupBy("key", "digest").agg(F.first("winner.best.id").alias("first"), F.max("same_length").alias("size"), F.count(F.lit(1)).alias("n"))
    roles = saved(roles, "roles")
    several = roles.groupBy("key").agg(F.sum("n").alias("rows")).where("rows > 1").select("key")
    named = join_small(roles, several.withColumn("several", F.lit(True)), ["key"], "left")
    suffix = F.when(F.col("several"), F.concat(F.lit(":"), F.lower(F.hex("digest")))).otherwise("")
    roles = saved(named.select("key", "digest", "first", "size", "n", suffix.alias("suffix")), "roles")
    own = F.col("first").eqNullSafe(F.col("page"))
    columns = ["page", "url", "html", "digest", "first"]
    again = roles.where("n > 1").select("key", "digest")
    repeated = not again.isEmpty()
    single = join_small(slim, again, ["key", "digest"], "left_anti") if repeated else slim
    # Hashed on the roles, so that no html is sorted.
    records = single.join(roles.hint("shuffle_hash"), ["key", "digest"]).select(*columns, (~own & (F.col("size") >= least)).alias("revisit"), "suffix")
    if repeated:
        # Rows of one id and payload are numbered, once; the first of them may be the response.
        copies = saved(join_small(slim, again, ["key", "digest"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "copies")
        heads = copies.groupBy("key", "digest").agg(F.min("row").alias("head"))
        told = copies.join(roles.join(heads, ["key", "digest"]), ["key", "digest"])
        head = own & (F.col("row") == F.col("head"))
        records = records.unionByName(told.select(
            *columns, (~head & (F.col("size") >= least)).alias("revisit"), F.concat("suffix", F.lit("."), F.col("row").cast("string")).alias("suffix")
        ))
    written = records.mapInArrow(_archived, "record binary").select(F.col("record").cast("string"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip (or plain) file in pieces."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), CHUNK):
            yield bytes(content[at : at + CHUNK])
        return
    at, inflate = 0, zlib.decompressobj(31)
    while True:
        rest = inflate.unconsumed_tail
        if not rest:
            rest = bytes(content[at : at + CHUNK])
            at += len(rest)
        if inflate.eof:
            rest = inflate.unused_data + rest
            if not rest:
                return
            inflate = zlib.decompressobj(31)
        if not rest:
            raise ValueError("an archive ends early")
        if piece := inflate.decompress(rest, CHUNK):
            yield piece


def archive_chunks(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Chunk rows of an archive given in pieces.

    (record, chunk, kind, page, refers_to, stated digest, stated bytes, data, bytes so
    far, digest so far, last).  ``record`` is the identifier of the first segment;
    continuations go on with its chunk numbers and its digest.
    """
    held = b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, b"")
        held += piece
        return bool(piece)

    def header() -> tuple[str, dict[str, str], int]:
        """First line, fields, and bytes of the header in front."""
        nonlocal held
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("an archive ends early")
        top, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        held = held[end + 4 :]
        return top, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4

    while held or more():
        top, head, _ = header()
        if not top.startswith("WARC/"):
            raise ValueError("not an archive record")
        left = int(head["content-length"])
        if head["warc-type"] != "continuation":
            _, http, taken = header()
            left -= taken
            name, number, done, sha = head["warc-record-id"].strip("<>"), 0, 0, hashlib.sha1()
            page = name.removeprefix(ID).split(":")[0]
            first = head.get("warc-refers-to", "").strip("<>").removeprefix(ID)
            size = int(http["content-length"])
            fields = (head["warc-type"], int(page) if page else None, int(first) if first else None, head["warc-payload-digest"].removeprefix("sha1:"), size)
            total = size if head["warc-type"] == "response" else 0
        while True:
            if left and not held and not more():
                raise ValueError("an archive ends early")
            data = held[: min(left, CHUNK)]
            held, left, done = held[len(data) :], left - len(data), done + len(data)
            sha.update(data)
            yield (name, number, *fields, data, done, base32(sha.copy().digest()), done >= total)
            number += 1
            if not left:
                break
        while len(held) < 4 and more():
            pass
        if held[:4] != b"\r\n\r\n":
            raise ValueError("not the end of an archive record")
        held = held[4:]


FIELDS = "record string, chunk long, record_type string, page long, refers_to long, stated_digest string, stated_bytes long, data binary, bytes_so_far long, digest_so_far string, last boolean"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def _chunks(with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = [list(x) for x in zip(*rows, strict=True)]
            if not with_data:
                columns[7] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, KINDS, strict=True)], NAMES)

        for batch in batches:
            for row in range(batch.num_rows):
                out, size = [], 0
                for chunk in archive_chunks(_inflated(memoryview(batch.column(0)[row].as_buffer()))):
                    out.append(chunk)
                    size += len(chunk[7])
                    if size >= 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    return run


def read_chunks(spark: SparkSession, folder: str, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives: every payload as rows of record and chunk number.

    Each row has the digest of the payload up to and with its chunk.  A revisit is one
    row without data; an empty payload is one row of no bytes.  ``with_data=False``
    leaves ``data`` null where only digests are wanted.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_chunks(with_data), FIELDS)


def record_table(chunks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record: page, payload_bytes, payload_digest, record_type, refers_to, intact.

    A response's bytes and digest are those read; ``intact`` says that they are the stated
    ones.  A revisit has what it states of the payload it refers to.
    """
    response = F.col("record_type") == "response"
    return chunks.where("last").select(
        F.col("page").alias(id_col),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (~response | ((F.col("bytes_so_far") == F.col("stated_bytes")) & (F.col("digest_so_far") == F.col("stated_digest")))).alias("intact"),
    )
