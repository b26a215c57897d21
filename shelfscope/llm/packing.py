"""Power-of-two packing: sequences that hold a piece of one document each, without padding.

A document of n ids gives as many pieces of ``max_length`` (a power of two) as fit, then one
piece for every bit set in the rest, longest first. A piece is a sequence of its own in the
bucket of its length, so no sequence crosses documents and batches are drawn bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfscope.llm.shared import chunks, only
from shelfscope.llm.tokens import ID_TYPE, encoder

PIECES = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
    "ids": pa.binary(),
}


def cuts(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    rest = n % max_length
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [max_length] * (n // max_length) + bits


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    max_length: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with their ids, each with the sequence that it makes up.

    Columns: doc_id, start and length (in ids of the document), doc_tokens, sequence_id, offset
    (always 0), ids (little-endian 32-bit integers). A sequence id is made of its bucket, the
    input partition and a running number there, so that a bucket's sequences have one range of
    ids and numbering needs no shuffle.

    A null or empty text is the end id alone. Null and repeated document ids are kept row by row.
    """
    if max_length & (max_length - 1):
        raise ValueError("max_length is a power of two")
    end = np.array([end_id], ID_TYPE).tobytes()
    size = ID_TYPE.itemsize
    schema = pa.schema(PIECES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder, placed = TaskContext.get().partitionId(), encoder(tokenizer), {}
        for batch in batches:
            for some in chunks(batch, "text"):
                rows = []
                ids = coder.encode(some.column("text").fill_null("").to_pylist())
                for doc, tokens in zip(some.column("id").to_pylist(), ids, strict=True):
                    tokens, at = tokens + end, 0
                    total = len(tokens) // size
                    for length in cuts(total, max_length):
                        place = placed[length] = placed.get(length, -1) + 1
                        sequence = (length.bit_length() - 1 << 58) + (part << 35) + place
                        data = tokens[at * size : (at + length) * size]
                        rows.append((doc, at, length, total, sequence, 0, data))
                        at += length
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.record_batch(arrays, schema=schema)

    out = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return only(docs, id=id_col, text=text_col).mapInArrow(pieces, out)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder for each length, to draw batches of equal sequences from."""
    pieces.write.partitionBy("length").parquet(path)
