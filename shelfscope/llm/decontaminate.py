"""Benchmark decontamination: rare word n-grams as seeds, then Smith-Waterman alignment.

The n-grams of a benchmark item are ranked by the number of documents that have them, counted over
the whole corpus; in every stretch of ``stretch`` n-grams the rarer half are its seeds. Wherever
a document has a seed, the item is aligned with the words around it, so copies with words
changed, dropped or added score too. An item's score is that of its best local alignment,
divided by the score of a full copy.

The benchmark goes through the corpus in blocks of at most ``block_words`` words, which is all that is
sent to the executors at once; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.shared import chunks, only
from shelfscope.llm.words import M1, mix, words_of

MATCH, MISMATCH, GAP = 2, -1, -1


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, whatever the rows."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = mix((out ^ h[k : k + len(out)]) * M1 + np.uint64(k))
    return out


@dataclass
class Block:
    """Some items: their ids and words, and the places of their n-grams by hash."""

    ids: list
    words: list[np.ndarray]
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    size: int

    def near(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are among the block's."""
        distinct = np.unique(self.gram)
        seen = np.zeros(1 << 20, bool)
        seen[distinct >> np.uint64(44)] = True
        out = seen[h >> np.uint64(44)]
        at = np.flatnonzero(out)
        out[at] = np.isin(h[at], distinct)
        return out


def block_of(items: list[tuple], size: int) -> Block:
    words = words_of(pa.array([text for _, text in items], pa.string()), plain=True)
    own = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:])]
    # An item shorter than an n-gram is one n-gram of all its words, padded.
    own_grams = [grams(np.append(w, np.zeros(max(0, size - len(w)), np.uint64)) if len(w) else w, size) for w in own]
    counts = [len(g) for g in own_grams]
    return Block(
        [i for i, _ in items],
        own,
        np.concatenate([*own_grams, np.zeros(0, np.uint64)]),
        np.repeat(np.arange(len(items)), counts),
        np.concatenate([*map(np.arange, counts), np.zeros(0, np.int64)]),
        size,
    )


def blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[Block]:
    """Items with at least ``size`` words, in blocks of ``most`` words (or of one item)."""
    held, total = [], 0
    for row in benchmark.toLocalIterator():
        n = len((row.text or "").split())
        if held and total + n > most:
            yield block_of(held, size)
            held, total = [], 0
        held.append((row.id, row.text))
        total += n
    if held:
        yield block_of(held, size)


def rarest(block: Block, documents: np.ndarray, stretch: int) -> Block:
    """The rarer half of each stretch of an item's n-grams; ``documents``: how many have each."""
    part = block.place // stretch
    order = np.lexsort((block.place, documents, part, block.item))
    new = np.ones(len(order), bool)
    new[1:] = (block.item[order][1:] != block.item[order][:-1]) | (part[order][1:] != part[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.arange(len(order)) - first
    sizes = np.bincount(np.cumsum(new) - 1)
    keep = order[rank < (np.repeat(sizes, sizes) + 1) // 2]
    return Block(block.ids, block.words, block.gram[keep], block.item[keep], block.place[keep], block.size)


def frequencies(rows: DataFrame, block: Block) -> np.ndarray:
    """Number of documents that have each n-gram of a block, over the whole corpus."""
    distinct, inverse = np.unique(block.gram, return_inverse=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(distinct), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"), plain=True)
                found = grams(words.hashes, block.size)
                row = np.searchsorted(words.first, np.arange(len(found)), "right") - 1
                at = np.flatnonzero(block.near(found))
                pairs = np.unique(np.stack([row[at], np.searchsorted(distinct, found[at])], 1), axis=0)
                total += np.bincount(pairs[:, 1], minlength=len(distinct))
        live = np.flatnonzero(total)
        yield pa.record_batch([pa.array(live), pa.array(total[live])], ["gram", "n"])

    out = np.zeros(len(distinct), np.int64)
    summed = rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # no more rows than the block has n-grams
        out[row.gram] = row.n
    return out[inverse]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score, and the place in ``text`` after its last word."""
    at = np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        line = np.zeros(len(text) + 1, np.int64)
        line[1:] = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        line = np.maximum(np.maximum(line, above + GAP), 0)
        # Gaps in the item: the best of what lies to the left, less the gap for each step.
        line = np.maximum.accumulate(line - GAP * at) + GAP * at
        top = int(line.argmax())
        if line[top] > best:
            best, end = int(line[top]), top
        above = line
    return best, end


def regions(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged ranges around the places where a copy would start, with room for added words."""
    room = max(4, length // 2)
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > length + 2 * room) + 1
    return [
        (int(some[0]) - room, int(some[-1]) + length + room) for some in np.split(starts, cut) if len(some)
    ]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = 0.5,
    gram_words: int = 3,
    stretch: int = 8,
    block_words: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Row per document and item found in it: doc_id, item_id, score, start, end.

    The score is rounded to six places; ``least`` or more counts. ``start`` and ``end`` are the place of
    the best alignment in the document's words (folded ASCII letters, split at spaces and ASCII
    punctuation), the first one among equals. Null and empty texts hold nothing, items without a
    word or shorter than an n-gram are in no document. Rows with equal ids are searched each by
    itself, so they can give equal rows; null ids stay null.
    """
    rows = only(docs, id=id_col, text=text_col)
    items = only(benchmark, id=item_col, text=item_text_col)
    kind = {"bigint": "long", "int": "int", "string": "string"}[dict(items.dtypes)["id"]]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"doc_id {dict(rows.dtypes)['id']}, item_id {kind}, score double, start int, end int"
    names = ["doc_id", "item_id", "score", "start", "end"]

    def search(block: Block):
        order = np.argsort(block.gram, kind="stable")
        gram, item, place = block.gram[order], block.item[order], block.place[order]

        def found(words: np.ndarray, number: int, starts: np.ndarray) -> tuple | None:
            own = block.words[number]
            best = None
            for low, high in regions(starts, len(own)):
                low, high = max(0, low), min(len(words), high)
                score, end = align(own, words[low:high])
                share = round(score / (MATCH * len(own)), 6)
                if share >= least and (best is None or share > best[0]):
                    best = (share, low, low + end)
            if best is None:
                return None
            share, low, end = best
            _, length = align(own[::-1], words[low:end][::-1])
            return block.ids[number], share, end - length, end

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "text"):
                    words = words_of(part.column("text"), plain=True)
                    all_grams = grams(words.hashes, block.size)
                    row = np.searchsorted(words.first, np.arange(len(all_grams)), "right") - 1
                    at = np.flatnonzero(block.near(all_grams))
                    at = at[at + block.size <= words.first[row[at] + 1]]
                    low = np.searchsorted(gram, all_grams[at], "left")
                    times = np.searchsorted(gram, all_grams[at], "right") - low
                    hit = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    owner, where = np.repeat(row[at], times), np.repeat(at, times)
                    start = where - words.first[owner] - place[hit]
                    order = np.lexsort((start, item[hit], owner))
                    owner, number, start = owner[order], item[hit][order], start[order]
                    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(number) != 0)) + 1
                    out = []
                    for some in np.split(np.arange(len(owner)), new):
                        if len(some):
                            r = owner[some[0]]
                            own = words.hashes[words.first[r] : words.first[r + 1]]
                            one = found(own, int(number[some[0]]), start[some])
                            if one:
                                out.append((part.column("id")[int(r)].as_py(), *one))
                    if out:
                        kinds = [part.column("id").type, arrow, pa.float64(), pa.int32(), pa.int32()]
                        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)]
                        yield pa.record_batch(columns, names)

        return rows.mapInArrow(scan, schema)

    passes = []
    for block in blocks(items, gram_words, block_words):
        passes.append(search(rarest(block, frequencies(rows, block), stretch)))
    return reduce(DataFrame.union, passes) if passes else docs.sparkSession.createDataFrame([], schema)
