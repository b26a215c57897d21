"""How far the sources of a language differ in their words: a sparse merge for each pair of sources.

Each source's kept terms lie in sorted (term id, count) arrays, cut into blocks of ids. A task takes
two tiles of sources of a block, co-grouped, and prices each unordered pair both ways: the terms both
have are found by a galloping intersection, those of one side are priced by their distinct counts, and
those of neither at once, as they all cost the same. No array, tile or group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.shared import chunks, kept
from shelfscope.llm.words import buffers

UNIT = 1_000_000_000  # what all terms of a group weigh together
BLOCK_TERMS = 16_384  # in a block, on average
TILE = 32  # sources in a tile, on average

LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[65:91] = LETTER[97:123] = True


def terms_of(texts: pa.Array, inside: np.ndarray = LETTER) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows, one after another, and the place of each row's first (with the end).

    A term is a longest run of bytes that are ``inside``; only A to Z are lower-cased.
    """
    data, borders = buffers(texts)
    own = inside[data]
    before = np.zeros_like(own)
    before[1:] = own[:-1]
    before[borders[(borders > 0) & (borders < len(data))]] = False
    starts = np.flatnonzero(own & ~before)
    packed = data[own]
    packed = packed + ((packed >= 65) & (packed <= 90)) * np.uint8(32)
    at = (np.cumsum(own) - own)[starts] if len(starts) else np.zeros(0, np.int64)
    offsets = np.append(at, len(packed)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return terms, np.searchsorted(starts, borders)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, and a row without term for each
    of these groups."""
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        for part in chunks(batch, "text"):
            terms, first = terms_of(part.column("text"))
            coded = terms.dictionary_encode()
            pairs = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
            labels = pa.table({"lang": pairs.field(0), "source": pairs.field(1)})
            known = labels.group_by(["lang", "source"]).aggregate([])
            number = {pair: i for i, pair in enumerate(zip(*(known.column(c).to_pylist() for c in ("lang", "source"))))}
            group = np.array([number[p] for p in zip(*(labels.column(c).to_pylist() for c in ("lang", "source")))], np.int64)
            size = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            by_row, times = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            by_group, owner = np.unique(group[by_row // size] * size + by_row % size, return_inverse=True)
            n = np.bincount(owner, times, len(by_group)).astype(np.int64)
            docs = np.bincount(owner, minlength=len(by_group))
            none = np.zeros(len(number), np.int64)
            of = pa.array(np.concatenate([by_group // size, np.arange(len(number))]))
            term = pa.concat_arrays([coded.dictionary.take(pa.array(by_group % size)), pa.nulls(len(number), pa.string())])
            columns = [known.column(c).combine_chunks().take(of) for c in ("lang", "source")]
            columns += [term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))]
            yield pa.record_batch(columns, names)


def weight(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), where total is no less than count + 1.

    A long division by thousands, so that nothing is beyond 64 bits below nine billion million terms.
    """
    left, out = count + 1, F.lit(0)
    for _ in range(3):
        out = out * 1000 + F.call_function("div", left * 1000, total)
        left = (left * 1000) % total
    return out + 1


def weights(count: np.ndarray, total: int) -> np.ndarray:
    """The same for an array of counts."""
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        out = out * 1000 + left * 1000 // total
        left = left * 1000 % total
    return out + 1


def cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(small: np.ndarray, large: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted arrays of what they share.

    The larger one is entered where the last run ended, and left by doubling strides.
    """
    if len(small) > len(large):
        there, here = gallop(large, small, step)
        return here, there
    out, low = [], 0
    for start in range(0, len(small), step):
        run, stride = small[start : start + step], step
        while low + stride < len(large) and large[low + stride] < run[-1]:
            stride *= 2
        at = low + np.searchsorted(large[low : low + stride + 1], run)
        hit = np.flatnonzero(large[np.minimum(at, len(large) - 1)] == run) if len(large) else at[:0]
        out.append((start + hit, at[hit]))
        low = int(at[-1])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


class Side:
    """A source's terms of one block."""

    def __init__(self, source: str, ids: np.ndarray, counts: np.ndarray, total: int):
        self.source, self.ids = source, ids
        self.distinct, self.code, self.times = np.unique(counts, return_inverse=True, return_counts=True)
        self.weights = weights(self.distinct, total)
        self.absent = weights(np.zeros(1, np.int64), total)


def prices(a: Side, b: Side, size: int) -> tuple[int, int]:
    """What a costs against b, and b against a, over the ``size`` terms of a block."""
    here, there = gallop(a.ids, b.ids)
    code_a, code_b = a.code[here], b.code[there]
    p, q = a.weights[code_a], b.weights[code_b]
    only_a = a.times - np.bincount(code_a, minlength=len(a.times))
    only_b = b.times - np.bincount(code_b, minlength=len(b.times))
    neither = size - len(a.ids) - len(b.ids) + len(here)

    def one_way(both, x, only_x, y, only_y):
        out = both.sum() + (only_x * cost(x.weights, y.absent)).sum() + (only_y * cost(x.absent, y.weights)).sum()
        return int(out + neither * cost(x.absent, y.absent)[0])

    return one_way(cost(p, q), a, only_a, b, only_b), one_way(cost(q, p), b, only_b, a, only_a)


PRICED = "lang string, source string, item string, value long"


def price_tiles(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Both ways of each unordered pair of a source of one tile and one of the other."""

    def sides(table: pa.Table) -> list[Side]:
        rows = zip(*(table.column(c).to_pylist() for c in ("source", "total")))
        ids, counts = ([x.values for x in table.column(c)] for c in ("ids", "counts"))
        none = np.zeros(0, np.int64)
        arrays = [[none if v is None else v.to_numpy() for v in x] for x in (ids, counts)]
        return [Side(s, i, c, max(1, t)) for (s, t), i, c in zip(rows, *arrays)]

    out = []
    if left.num_rows and right.num_rows:
        size = left.column("size")[0].as_py()
        for a in (first := sides(left)):
            for b in first if key[2].as_py() == key[3].as_py() else sides(right):
                if key[2].as_py() != key[3].as_py() or a.source < b.source:
                    forth, back = prices(a, b, size)
                    out += [(a.source, b.source, forth), (b.source, a.source, back)]
    lang = pa.array([key[0].as_py()] * len(out), pa.string())
    kinds = [pa.string(), pa.string(), pa.int64()]
    columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
    return pa.table([lang, *columns], names=["lang", "source", "item", "value"])


def audit(
    docs: DataFrame,
    least_docs: int = 3,
    top: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Divergence of sources within each language: lang, source, part, item, value, rank.

    A term is a run of letters and other characters beyond ASCII, with A to Z lower-cased. A language keeps the
    terms of at least ``least_docs`` of its rows. A group (a source of a language, or a language) gives
    each kept term p = 1 + floor(10**9 * (count + 1) / (N + V)), with N its occurrences of all V
    kept terms; p costs floor((p - q)**2 / q) against another group's q. Part ``pair``: the cost against each other
    source of the language, over all kept terms. Part ``term``: the ``top`` terms that the source has
    and weighs more than the language, by their cost. Higher values rank first, equal ones by item.

    Null texts, languages and sources are taken as empty strings. A row is a document, so repeated rows
    count each; ids play no part. A group without terms has pairs, and no term. Other columns are left
    out. Tables are written when this is called.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(text_col), empty).alias("text"),
        *[F.coalesce(F.col(c), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
    )
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = kept(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    present = counts.where("term IS NOT NULL")
    terms = present.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = terms.where(F.col("docs") >= least_docs).drop("docs").sortWithinPartitions("lang", "term")
    # Written with its number, so the number stays.
    terms = kept(terms.withColumn("id", F.monotonically_increasing_id()), "terms")
    langs = kept(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "langs")
    # As many blocks as a language's terms ask for, however they are partitioned.
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / BLOCK_TERMS)).alias("block")
    terms = terms.join(langs, "lang").select("lang", "term", "lang_n", "id", block)
    held = kept(present.drop("docs").join(terms, ["lang", "term"]), "held")

    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total"])
    groups = kept(
        groups.select(
            "lang", "source", (F.col("total") + F.col("v")).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total")
        ),
        "groups",
    )

    priced = held.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        F.col("term").alias("item"),
        weight(F.col("n"), F.col("total")).alias("p"),
        weight(F.col("lang_n"), F.col("lang_total")).alias("q"),
    )
    over = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    high = priced.where("p > q").select("lang", "source", "item", F.call_function("div", over, F.col("q")).alias("value"))

    blocks = terms.groupBy("lang", "block").agg(F.count("*").alias("size"))
    # One more block without terms, so that every pair is priced if a language keeps none.
    blocks = blocks.union(groups.select("lang", F.lit(-1).cast("long"), F.lit(0).cast("long")).distinct())
    blocks = kept(blocks, "blocks")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = groups.join(tiles, "lang").select(
        "lang", "source", "total", "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    )
    arrays = held.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))
    arrays = arrays.select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    cells = tiled.join(blocks, "lang").join(arrays, ["lang", "source", "block"], "left")
    cells = kept(cells, "cells")
    columns = ["lang", "block", "low", "high", "size", "source", "total", "ids", "counts"]
    keys = columns[:4]
    left = cells.withColumn("low", F.col("tile")).withColumn("high", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    right = cells.withColumn("high", F.col("tile")).withColumn("low", F.explode(F.sequence(F.lit(0), "tile")))
    left, right = left.select(*columns), right.select(*columns)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(price_tiles, PRICED)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(best_first)

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    ranked = part("pair", pairs.withColumn("rank", rank))
    return ranked.union(part("term", high.withColumn("rank", rank).where(F.col("rank") <= top)))
