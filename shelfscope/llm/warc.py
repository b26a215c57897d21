"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames. Two skippable frames follow: an index that maps
record identifiers to frame, offset in the frame's content and length, and the seek table of the
seekable format (compressed and plain size of each frame, their number, magic). A plain
decompressor gives the WARC file; ``Bundle.record`` decompresses only the frame it needs.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm.files import read_binary, write_binary
from shelfscope.llm.shared import chunks, kept, only, same

# Fixed values of the formats.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENDING = struct.pack("<I", SEEKABLE)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date
RECORD = np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def record_uri(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """A response record, or without payload a revisit of ``response``."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if response is not None:
        head += [f"WARC-Refers-To: {record_uri(response)}", f"WARC-Profile: {REVISIT}"]
    block = payload if response is None else b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Writer:
    """Collects records into frames of about ``frame_bytes``."""

    def __init__(self, frame_bytes: int):
        self._limit, self._press = frame_bytes, zstandard.ZstdCompressor(level=3)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._open: list[bytes] = []
        self._filled, self.size = 0, 0
        self._index: list[tuple] = []

    def add(self, page: int | None, data: bytes) -> None:
        self._index.append((page or 0, page is None, len(self._frames), self._filled, len(data)))
        self._open.append(data)
        self._filled += len(data)
        if self._filled >= self._limit:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._press.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._filled))
            self.size += len(frame)
            self._open, self._filled = [], 0

    def finish(self) -> bytes:
        """The bundle but for its last four bytes."""
        self._close()
        index = np.array(self._index, RECORD).tobytes()
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = [(len(f), s) for f, (_, s) in zip(self._frames, self._sizes, strict=True)]
        entries.append((len(index), 0))  # the index decompresses to nothing
        table = b"".join(struct.pack("<II", *e) for e in entries)
        footer = struct.pack("<IB", len(entries), 0)
        seek = struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + footer
        return b"".join([*self._frames, index, seek])


class Bundle:
    """Random access to an archive's bytes."""

    def __init__(self, content: bytes):
        if content[-4:] != ENDING:
            raise ValueError("no seek table")
        frames = struct.unpack_from("<I", content, len(content) - 9)[0]
        table = np.frombuffer(content, "<u4", 2 * frames, len(content) - 9 - 8 * frames).reshape(-1, 2)
        ends = np.cumsum(table[:, 0].astype(np.int64))
        self._content, self._starts = content, ends - table[:, 0]
        at, size = int(self._starts[-1]) + 8, int(table[-1, 0]) - 8
        self.index = np.frombuffer(content, RECORD, size // RECORD.itemsize, at)
        self._ends = ends
        self._press = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, number: int) -> bytes:
        if self._last[0] != number:
            part = self._content[self._starts[number] : self._ends[number]]
            self._last = (number, self._press.decompress(part))
        return self._last[1]

    def at(self, row: int) -> bytes:
        """A record by its place in the index."""
        entry = self.index[row]
        return self._frame(int(entry["frame"]))[int(entry["offset"]) : int(entry["offset"] + entry["length"])]

    def record(self, page: int) -> bytes:
        """A record by its identifier."""
        rows = np.flatnonzero((self.index["id"] == page) & (self.index["null"] == 0))
        if not len(rows):
            raise KeyError(page)
        return self.at(int(rows[0]))


def with_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """Rows of id, url, payload and ``response``: the id a row refers to, null if it is one."""
    rows = only(pages, id=id_col, url=url_col, text=payload_col).withColumn(
        "text", F.coalesce("text", F.lit("")).cast("binary")
    )
    # Public pairs of pages have one SHA-1 and differ: length and another hash tell these apart.
    key = ["key", "size", "second"]
    hashes = [F.unhex(F.sha1("text")), F.length("text"), F.xxhash64("text")]
    keyed = rows.withColumns(dict(zip(key, hashes)))
    shared = (
        keyed.where(F.col("size") >= least)
        .groupBy(*key)
        .agg(F.max("id").alias("largest"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = keyed.join(kept(shared, "payloads"), key, "left")
    refers = F.when(~same(F.col("id"), F.col("largest")), F.col("largest"))
    return joined.select("id", "url", "text", refers.alias("response"))


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    frame_bytes: int = 256 << 10,
    archive_bytes: int = 64 << 20,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write a record per page: full for one page of each payload, a revisit for the others.

    Of pages with equal payloads of at least ``least_bytes`` the largest id has the payload; if
    several rows share that id, each has it. A null payload is an empty one. Null ids refer to
    the largest id there is, and have the payload if there is none. An empty table makes no file.
    """
    rows = with_responses(pages, id_col, url_col, payload_col, least_bytes)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for part in chunks(batch, "text"):
                for row in part.to_pylist():
                    writer = writer or Writer(frame_bytes)
                    data = record(row["id"], row["url"], row["text"], row["response"])
                    writer.add(row["id"], data)
                    if writer.size >= archive_bytes:
                        yield pa.record_batch([pa.array([writer.finish()], pa.binary())], ["file"])
                        writer = None
        if writer:
            yield pa.record_batch([pa.array([writer.finish()], pa.binary())], ["file"])

    write_binary(rows.mapInArrow(bundle, "file binary"), "file", path, ENDING)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of its block as read; if its headers say otherwise, the
    archive is damaged and reading fails. A revisit has no block, so they are those of its headers.
    ``with_payload`` adds url and the record's own block (empty for a revisit).
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    if with_payload:
        schema += ", url string, payload binary"
        names, kinds = [*names, "url", "payload"], [*kinds, pa.string(), pa.binary()]

    def rows(bundle: Bundle) -> Iterator[tuple]:
        for row in range(len(bundle.index)):
            head, block = parse(bundle.at(row))
            refers = head.get("WARC-Refers-To")
            told = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
            found = told if refers else (len(block), digest(block))
            if found != told:
                raise ValueError(f"record {head['WARC-Record-ID']} has {found}, its headers say {told}")
            yield (
                page_of(head["WARC-Record-ID"]),
                *found,
                head["WARC-Type"],
                page_of(refers) if refers else None,
                head["WARC-Target-URI"],
                block,
            )[: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                columns = zip(*rows(Bundle(content.as_py())), strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return read_binary(spark, path).mapInArrow(read, schema)
