"""Removal of repeated passages by relative Lempel-Ziv parsing against earlier documents.

The reference is every block of ``window`` words of every document; its index maps a block to
the earliest document that has it. A document is parsed greedily from left to right: at a word
whose block is indexed for an earlier document, the factor runs on as long as the following
blocks continue in the same place of the same source; where it ends, the blocks across its border
are looked up themselves, as another source may continue them. Factors have at least ``window``
words, and their words are the duplicate spans.

The index need not hold blocks that cannot repeat. In each block the run of ``GRAM`` words with the
smallest hash is its anchor, about one word in twenty. Equal blocks have equal anchors, so only
blocks whose anchor occurs in two documents are indexed. Documents with all words equal are
represented by the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.shared import chunks, kept, only
from shelfscope.llm.words import Words, mix, row_keys, words_of

GRAM = 8


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words, whatever the rows. ``h``: hashes of the words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    # Doubling: runs of one, two, four ... words are put together by the bits of the size.
    part, length, done = h, 1, 0
    while length <= size:
        if size & length:
            out = mix(out * factor + part[done : done + len(out)])
            done += length
        if 2 * length <= size:
            part = mix(part[:-length] * factor ^ part[length:]) if len(part) > length else part[:0]
        length *= 2
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, length = values, 1
    while length * 2 <= width:
        out = np.minimum(out[:-length], out[length:]) if len(out) > length else out[:0]
        length *= 2
    rest = width - length
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def blocks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, hash and anchor of every block that lies in one row."""
    h = words.hashes
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = min(GRAM, window)
    whole, anchor = runs(h, window), least(runs(h, gram), window - gram + 1)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    at = np.flatnonzero(row[: len(whole)] == row[window - 1 :])
    return row[at], at - words.first[row[at]], whole[at], anchor[at]


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield part, words_of(part.column("text"))


def lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """A list per row of the values, whose rows ascend."""
    ends = np.searchsorted(row, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def repeats(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that an earlier document has (id and key of the text, and a list of place, source and
    place there), and the table of all ids and keys."""

    def anchors(batches):
        for part, words in batches_of(batches):
            row, _, _, anchor = blocks(words, window)
            new = np.ones(len(row), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            found = lists(anchor[new].view(np.int64), row[new], part.num_rows)
            keys = pa.array(row_keys(words), pa.binary())
            yield pa.record_batch([part.column("id"), keys, found], ["id", "key", "anchors"])

    schema = "id long, key binary, anchors array<long>"
    marked = kept(docs.where("id IS NOT NULL").mapInArrow(anchors, schema), "anchors")
    firsts = marked.groupBy("key").agg(F.min("id").alias("id"))
    own = marked.join(kept(firsts, "firsts"), ["key", "id"], "left_semi").select(
        "id", F.explode("anchors").alias("anchor")
    )
    shared = own.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    wanted = own.join(kept(shared.select("anchor"), "shared"), "anchor")
    wanted = wanted.groupBy("id").agg(F.collect_set("anchor").alias("anchors"))

    def candidates(batches):
        for part, words in batches_of(batches):
            row, at, block, anchor = blocks(words, window)
            held = part.column("anchors")
            owner = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy())
            mark = mix(owner.astype(np.uint64))
            listed = held.flatten().to_numpy().view(np.uint64) ^ mark
            hit = np.isin(anchor ^ mix(row.astype(np.uint64)), listed)
            hashes = lists(block[hit].view(np.int64), row[hit], part.num_rows)
            places = lists(at[hit].astype(np.int32), row[hit], part.num_rows)
            keys = pa.array(row_keys(words), pa.binary())
            yield pa.record_batch([part.column("id"), keys, hashes, places], names)

    names = ["id", "key", "hashes", "places"]
    schema = "id long, key binary, hashes array<long>, places array<int>"
    held = kept(docs.join(wanted, "id").mapInArrow(candidates, schema), "blocks")
    pairs = F.arrays_zip("hashes", "places")
    block = held.select("id", "key", F.explode(pairs).alias("b")).select(
        "id", "key", F.col("b.hashes").alias("block"), F.col("b.places").alias("pos")
    )
    index = block.groupBy("block").agg(
        F.min(F.struct("id", "pos")).alias("source"), F.max("id").alias("last")
    )
    index = index.where("source.id < last").select("block", "source")
    found = block.join(kept(index, "index"), "block").where("source.id < id")
    hit = F.struct("pos", F.col("source.id").alias("source"), F.col("source.pos").alias("source_pos"))
    return found.groupBy("id", "key").agg(F.sort_array(F.collect_list(hit)).alias("hits")), marked


def parse(pos: np.ndarray, source: np.ndarray, source_pos: np.ndarray, window: int) -> list[tuple]:
    """Factors (start, end, source, start in source) from the indexed blocks of a document."""
    if not len(pos):
        return []
    goes_on = (np.diff(pos) == 1) & (np.diff(source) == 0) & (np.diff(source_pos) == 1)
    first = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
    last = np.concatenate([first[1:] - 1, [len(pos) - 1]])
    return [
        (int(pos[a]), int(pos[b]) + window, int(source[a]), int(source_pos[a]))
        for a, b in zip(first, last, strict=True)
    ]


SPANS = "array<struct<start: int, end: int, source: long, source_start: int>>"


def duplicate_spans(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, text, spans, kept_text, n_words, n_removed.

    ``spans`` are the factors in words (start, end, source document and start there); factors may
    overlap. ``kept_text`` has the words outside them, with one space between. Words are taken as
    they are. A document is judged against those with a smaller id, as they were given: rows with
    equal ids do not judge each other, and rows without id lose nothing and judge nobody. A null
    or empty text has no words; a text below ``window`` words loses none.
    """
    rows = only(docs, id=id_col, text=text_col)
    hits, marked = repeats(rows, window)
    first = marked.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = kept(first.where("first < last").select("key", "first"), "copies")
    copies = marked.select("id", "key").distinct().join(first, "key").where("first < id")
    no_hits = F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")
    found = hits.withColumn("first", F.lit(None).cast("long")).unionByName(
        copies.select("id", "key", no_hits, "first")
    )
    # One entry, but for ids that several texts have.
    found = found.groupBy("id", "key").agg(F.max("first").alias("first"), F.max("hits").alias("hits"))
    found = found.groupBy("id").agg(F.collect_list(F.struct("key", "first", "hits")).alias("found"))

    def cut(batches):
        for part, words in batches_of(batches):
            out = []
            texts, keys, known = part.column("text").to_pylist(), row_keys(words), part.column("found")
            for row, (n, text) in enumerate(zip(words.counts, texts, strict=True)):
                spans, keep = [], np.ones(n, bool)
                for entry in known[row].values if known[row].is_valid else ():
                    if entry["key"].as_py() != keys[row]:
                        continue
                    if entry["first"].is_valid:
                        spans = [(0, int(n), entry["first"].as_py(), 0)] if n >= window else []
                    else:
                        hit = entry["hits"].values
                        spans = parse(*[hit.field(k).to_numpy() for k in range(3)], window)
                for start, end, *_ in spans:
                    keep[start:end] = False
                # Bytes split at the six ASCII spaces, which are those between words.
                left = b" ".join(compress((text or "").encode().split(), keep))
                out.append((left.decode(), spans, int(n), int(n - keep.sum())))
            kinds = [pa.string(), spans_type, pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch(
                [part.column("id"), part.column("text"), *columns],
                ["doc_id", "text", "kept_text", "spans", "n_words", "n_removed"],
            )

    spans_type = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
    )
    schema = f"doc_id long, text string, kept_text string, spans {SPANS}, n_words long, n_removed long"
    return rows.join(found, "id", "left").mapInArrow(cut, schema)
