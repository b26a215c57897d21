"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the
next chunk of those ids that have one, and so on. A continuation bitmap of each level says which
ids go on, and its rank directory (ones before every block of 512 bits) leads to their place in
the next level, so ``Shard.token`` reads any id with a few look-ups and decodes no block.

A file holds consecutive documents, about ``shard_tokens`` ids:

    magic, head (numbers below), document ids, null flags, ends of the documents, levels, ending

Files are numbered by range partition and place in it, which is the order of their documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.llm.files import read_binary, write_binary
from shelfscope.llm.shared import chunks, kept, only
from shelfscope.llm.tokens import ID_TYPE, encoder

MAGIC, ENDING = b"DACTOK01", b"\x01KOTCAD\n"
HEAD = struct.Struct("<IIQQI")  # partition, place in it, documents, ids, levels
BLOCK = 64  # bytes of bitmap to an entry of the rank directory
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack(ids: np.ndarray) -> tuple[int, bytes]:
    """The levels of some ids: their number, and each as length, chunks, bitmap and directory."""
    parts, levels, left = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(ONES[bits].astype(np.uint64), range(0, len(bits), BLOCK)) if len(bits) else []
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        chunk = (left & 0xFF).astype(np.uint8)
        parts += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        left, levels = left[more] >> 8, levels + 1
    return levels, b"".join(parts)


class Shard:
    """One file's documents. Arrays are views of its bytes."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC or content[-len(ENDING) :] != ENDING:
            raise ValueError("not a token file, or a part of one")
        self.partition, self.place, docs, self.n_tokens, levels = HEAD.unpack_from(content, len(MAGIC))
        self._at, self._content = len(MAGIC) + HEAD.size, content
        self.doc_ids, self.nulls = self._take("<i8", docs), self._take("u1", docs)
        self.ends = self._take("<u8", docs)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            size = (n + 7) // 8
            self.levels.append(
                (self._take("u1", n), self._take("u1", size), self._take("<u8", -(-size // BLOCK) + 1))
            )

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._content, kind, n, self._at)
        self._at += out.nbytes
        return out

    def token(self, position: int) -> int:
        """The id at a place of the file."""
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[position]) << shift
            byte, bit = divmod(position, 8)
            if not bits[byte] >> bit & 1:
                break
            block = byte // BLOCK
            before = int(ranks[block]) + int(ONES[bits[block * BLOCK : byte]].sum())
            position = before + int(ONES[bits[byte] & ((1 << bit) - 1)])
            shift += 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_tokens, ID_TYPE)
        at = np.arange(self.n_tokens)
        for shift, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk.astype(ID_TYPE) << (8 * shift)
            at = at[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out


def shard(partition: int, place: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file's bytes but for its ending; ``docs``: document id and its ids."""
    ids = np.frombuffer(b"".join(b for _, b in docs), ID_TYPE)
    levels, coded = pack(ids)
    return b"".join(
        [
            MAGIC,
            HEAD.pack(partition, place, len(docs), len(ids), levels),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([d is None for d, _ in docs], "u1").tobytes(),
            np.cumsum([len(b) // ID_TYPE.itemsize for _, b in docs]).astype("<u8").tobytes(),
            coded,
        ]
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    partitions: int | None = None,
    shard_tokens: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending id order.

    A null text counts as empty. A null id comes first; rows with equal ids stand side by side
    in no set order. An empty table makes no file. A file has more than ``shard_tokens`` ids only
    if its last document is long. ``partitions`` defaults to ``spark.sql.shuffle.partitions``.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], ID_TYPE).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, held, size = TaskContext.get().partitionId(), 0, [], 0
        coder = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = part.column("id").to_pylist()
                coded = coder.encode(part.column("text").fill_null("").to_pylist())
                for doc, tokens in zip(ids, coded, strict=True):
                    held.append((doc, tokens + end))
                    size += len(tokens) // ID_TYPE.itemsize + 1
                    if size >= shard_tokens:
                        yield one(shard(number, place, held))
                        place, held, size = place + 1, [], 0
        if held:
            yield one(shard(number, place, held))

    def one(content: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([content], pa.binary())], ["file"])

    rows = only(docs, id=id_col, text=text_col)
    ordered = rows.repartitionByRange(partitions, F.col("id").asc()).sortWithinPartitions("id")
    write_binary(ordered.mapInArrow(encode, "file binary"), "file", path, ENDING)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document of the files: id, ids before it, number of ids and their CRC-32.

    ``with_ids`` adds the ids themselves, as little-endian 32-bit integers. The files are read once, when
    this is called; how many ids lie before a file is a join with one row for each file.
    """
    files = read_binary(spark, path)
    schema = "part int, place int, doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["part", "place", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                part = Shard(content.as_py())
                data, size = part.tokens().tobytes(), ID_TYPE.itemsize
                ends = part.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                slices = [memoryview(data)[a * size : b * size] for a, b in zip(starts, ends, strict=True)]
                columns = [
                    pa.array(np.full(len(ends), part.partition, np.int32)),
                    pa.array(np.full(len(ends), part.place, np.int32)),
                    pa.array(part.doc_ids, pa.int64(), mask=part.nulls.astype(bool)),
                    pa.array(starts),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(s) for s in slices], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(s) for s in slices], pa.binary()))
                yield pa.record_batch(columns, names)

    found = kept(files.mapInArrow(decode, schema + ", ids binary" * with_ids), "decoded")
    sizes = found.groupBy("part", "place").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # Over one row for each partition of the writer.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.sum("n").over(earlier).alias("before"))
    none = F.lit(0)
    bases = sizes.withColumn("own", F.sum("n").over(inside)).join(parts, "part")
    bases = bases.select("part", "place", (F.coalesce("own", none) + F.coalesce("before", none)).alias("base"))
    placed = found.join(bases, ["part", "place"]).withColumn("start", F.col("start") + F.col("base"))
    return placed.select(*names[2:])
