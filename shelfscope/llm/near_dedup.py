"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its word shingles. Each shingle of weight w is a set of independent
Poisson processes over the weight's dyadic intervals [0, 1), [1, 2), [2, 4), ... with a rate equal
to an interval's width; the last interval is usually cut by w, and its points carry their own place
in it so that those above w are left out. A point has a time and one of the signature's registers,
all drawn from the shingle's hash. A register keeps its earliest point, so two documents agree in a
register with a probability equal to their weighted Jaccard similarity. Only points that can
still be earliest are drawn: about m log m for m registers, however many shingles there are.

Documents that agree in a band of registers are candidates. In every bucket a hub is compared with
the others; a bucket whose documents are all connected by then needs nothing more, and the others
get further hubs. What is left is cut into tiles of bounded size, and every two tiles of a bucket
meet in a task of their own, which gives the links between classes and no pairs. Comparisons are
exact: the overlap of the two multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.shared import chunks, kept, only, release_idle
from shelfscope.llm.words import M1, M2, M3, mix, row_keys, shingles, words_of

#: Text that a task takes at once: a shingle's points take some twenty arrays.
TEXT_BYTES = 3 << 20


def weights(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and count of the distinct values of each row, ascending in both."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], values[at], np.diff(np.append(at, len(values)))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Times of the earliest points, one line of ``m`` registers a row; infinite without shingles."""
    out = np.full((rows, m), np.inf)
    total = np.bincount(row, count, rows)
    # A process for each dyadic interval below the count: its stream, rate, lower end.
    depth = np.where(count > 1, np.floor(np.log2(np.maximum(count - 1, 1))).astype(np.int64) + 2, 1)
    owner = np.repeat(np.arange(len(row)), depth)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth)
    lower = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    rate = np.where(level > 0, lower, 1.0)
    stream = mix(value[owner] ^ mix(level.astype(np.uint64) * M2))
    of, most = row[owner], count[owner]
    limit = np.where(total > 0, m * (np.log(m) + 3) / np.maximum(total, 1), 0)
    while True:
        live = np.flatnonzero(limit[of] > 0)
        time, step = np.zeros(len(live)), 0
        while len(live):
            bits = mix(stream[live] + np.uint64(step * int(M1) % 2**64))
            time = time - np.log(uniform(bits)) / rate[live]
            near = time <= limit[of[live]]
            live, time, bits = live[near], time[near], bits[near]
            more = mix(bits ^ M3)
            place = lower[live] + np.floor(uniform(mix(more ^ M2)) * rate[live] * (1 - 2.0**-53))
            fits = place < most[live]
            register = (more % np.uint64(m)).astype(np.int64)
            np.minimum.at(out, (of[live[fits]], register[fits]), time[fits])
            step += 1
        # A register without a point needs a later limit; few rows come here.
        open_rows = (total > 0) & np.isinf(out).any(axis=1)
        if not open_rows.any():
            return out
        limit = np.where(open_rows, limit * 2, 0)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of registers."""
    lines = signature.view(np.uint64).reshape(len(signature), bands, -1)
    out = np.broadcast_to(mix(np.arange(bands).astype(np.uint64) * M1 + M3), lines.shape[:2]).copy()
    for k in range(lines.shape[2]):
        out = mix((out ^ lines[:, :, k]) * M1)
    return out


def overlap(a: pa.StructScalar, b: pa.StructScalar) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def marks(rows: DataFrame, size: int, bands: int, registers: int) -> DataFrame:
    """Per row with an id: key of its words, and its bands' hashes (none if shorter than a shingle)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_idle()
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                words = words_of(part.column("text"))
                row, value, count = weights(*shingles(words, size))
                signature = signatures(row, value, count, part.num_rows, bands * registers)
                found = band_hashes(signature, bands).view(np.int64)
                long_enough = words.counts >= size
                ends = np.concatenate([[0], np.cumsum(long_enough * bands)])
                listed = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(found[long_enough].ravel())
                )
                keys = pa.array(row_keys(words), pa.binary(), mask=words.counts == 0)
                yield pa.record_batch([part.column("id"), keys, listed], ["id", "key", "bands"])

    return rows.mapInArrow(sign, "id long, key binary, bands array<long>")


def bags(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Multisets of the wanted ids: sorted hashes and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_idle()
        for batch in batches:
            for part in chunks(batch, "text", TEXT_BYTES):
                words = words_of(part.column("text"))
                row, value, times = weights(*shingles(words, size))
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.array(row_keys(words), pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    ["id", "key", "hashes", "counts"],
                )

    found = rows.join(wanted, "id", "left_semi").mapInArrow(
        count, "id long, key binary, hashes array<long>, counts array<int>"
    )
    one = found.groupBy("id").agg(F.min_by(F.struct("hashes", "counts"), "key").alias("bag"))
    return kept(one, "bags")


def links(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose overlap is large enough, with the similarity."""

    def side(name: str) -> DataFrame:
        return held.select(F.col("id").alias(name), F.col("bag").alias(f"bag_{name}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sides = [batch.column("bag_a"), batch.column("bag_b")]
            ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            for row, (a, b) in enumerate(ids):
                x, y = [
                    [s.field(k)[row].values.to_numpy(zero_copy_only=False) for k in (0, 1)] for s in sides
                ]
                out.append((a, b, overlap(x, y)))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.record_batch(columns, ["a", "b", "similarity"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bag_a", "bag_b")
    compared = both.mapInArrow(compare, "a long, b long, similarity double")
    return compared.where(F.col("similarity") >= least)


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shared weight of every two multisets, by products of their incidence in shared elements."""
    owner = np.repeat(np.arange(len(bags)), [int(times.sum()) for _, times in bags])
    # The k-th copy of a hash is an element of its own, so that a multiset is a set.
    copies = np.concatenate([np.arange(n) for _, times in bags for n in times.tolist()] or [np.zeros(0)])
    value = np.concatenate([np.repeat(h, times) for h, times in bags]).view(np.uint64)
    element = mix(value ^ mix(copies.astype(np.uint64) + M2))
    distinct, at, times = np.unique(element, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    row, column = owner[shared], place[at[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(bags), len(bags)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        part = np.zeros((len(bags), 2048), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    np.fill_diagonal(out, [times.sum() for _, times in bags])  # also what nobody shares
    return out


def tile_links(inner: DataFrame, held: DataFrame, least: float, tile: int) -> DataFrame:
    """Links between different classes of each bucket of ``inner`` (bucket, id, class).

    A bucket is cut into tiles of about ``tile`` documents, and any two of them (or one, if there
    are no more) are compared in one group. Each document then names one partner of each class.
    """
    sizes = inner.groupBy("bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    placed = inner.join(kept(sizes, "tiles"), "bucket").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "class"
    )
    full = kept(placed, "placed").join(held, "id")

    def compare(group: pa.Table) -> pa.Table:
        bag = group.column("bag").combine_chunks()
        found = [
            tuple(bag.field(k)[row].values.to_numpy(zero_copy_only=False) for k in (0, 1))
            for row in range(group.num_rows)
        ]
        both = overlaps(found).astype(np.float64)
        total = np.array([times.sum() for _, times in found], np.float64)
        cls, ids = group.column("class").to_numpy(), group.column("id").to_numpy()
        alike = both / (total[:, None] + total[None, :] - both) >= least
        x, y = np.nonzero(alike & (cls[:, None] != cls[None, :]))
        _, first = np.unique(np.stack([x, cls[y]], 1), axis=0, return_index=True)
        x, y = ids[x[first]], ids[y[first]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least id reachable from each id that has an edge (id, class).

    In each turn an id takes the least class among its neighbours', and then the class of that
    id, until nothing changes; paths at least halve. One small table is written a turn, and the
    edges are read, so they should be a stored table; repeated ones do no harm.
    """
    edges = edges.select("a", "b")
    both = edges.union(edges.select("b", "a"))
    now = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    now = kept(now.select("id", F.least("id", "near").alias("class")), "classes")
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
        lowered = now.join(near.agg(F.min("class").alias("near")), "id").select(
            "id", F.col("class").alias("old"), F.least("class", "near").alias("low")
        )
        jump = now.select(F.col("id").alias("low"), F.col("class").alias("lower"))
        turned = lowered.join(jump, "low", "left").select(
            "id", "old", F.least("low", F.coalesce("lower", "low")).alias("class")
        )
        turned = kept(turned, "classes")
        now = turned.select("id", "class")
        if turned.where("class <> old").isEmpty():
            return now


def joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes (id, class), as ``components`` gives them, with further edges between their ids or new ones.

    Only the edges between different classes are followed: one for every two classes.
    """

    def side(name: str) -> DataFrame:
        return classes.select(F.col("id").alias(name), F.col("class").alias(f"class_{name}"))

    between = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = between.selectExpr("coalesce(class_a, a) AS a", "coalesce(class_b, b) AS b").where("a <> b")
    between = kept(between.distinct(), "between")
    if between.isEmpty():
        return classes
    # A class goes by its least id, so these are names of classes, or ids that had none.
    merged = components(between)
    lowered = classes.join(merged.select(F.col("id").alias("class"), F.col("class").alias("low")), "class", "left")
    lowered = lowered.select("id", F.coalesce("low", "class").alias("class"))
    return kept(lowered.union(merged.join(classes, "id", "left_anti")), "classes")


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle_words: int = 5,
    bands: int = 25,
    registers: int = 5,
    hub_rounds: int = 2,
    tile: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, class_id (least id of its class), class_size (rows), is_first.

    Documents are linked if the multisets of their word shingles overlap by ``similarity`` or
    more (shared weight by total weight), and a class is what links connect. Equal sequences of
    words are always linked; texts shorter than a shingle only so. Texts without words, null
    ones too, are linked with nothing. Rows with equal ids are one document: they share a class,
    and only texts of the least key stand for it in comparisons. A row without id has no class.
    With the default bands a link at 0.8 becomes a candidate with a probability of 0.99995.
    """
    rows = only(docs, id=id_col, text=text_col)
    named = rows.where("id IS NOT NULL")
    marked = kept(marks(named, shingle_words, bands, registers), "marks")
    # Texts with equal words, and so equal bands: the least id stands for all.
    equal = marked.where("key IS NOT NULL").groupBy("key")
    firsts = kept(equal.agg(F.min("id").alias("first"), F.any_value("bands").alias("bands")), "firsts")
    member = kept(
        marked.join(firsts.drop("bands"), "key", "left").select("id", F.coalesce("first", "id").alias("first")),
        "members",
    )
    # An id that several texts have ties what stands for them together.
    several = member.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("last"))
    several = several.where("a < last").select("id", "a")
    tied = kept(member.join(several, "id").where("a < first").selectExpr("a", "first AS b"), "tied")
    # An id that several texts have may be in a bucket twice, which costs a little and changes nothing.
    band = firsts.select(F.col("first").alias("id"), F.explode("bands").alias("bucket"))
    hubs = band.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
    hubs = kept(hubs.where("hub < last").select("bucket", "hub"), "hubs")
    inside = kept(band.join(hubs, "bucket"), "buckets")
    held = bags(named, inside.select("id").distinct(), shingle_words)

    def pairs(crossing: DataFrame) -> DataFrame:
        one, two = F.col("id"), F.col("hub")
        return crossing.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()

    asked = kept(pairs(inside.where("id <> hub")), "pairs")
    classes = components(tied.union(kept(links(asked, held, similarity).select("a", "b"), "links")))
    open_buckets = inside.select("bucket", "id")
    for turn in [*range(hub_rounds), None]:
        labelled = kept(
            open_buckets.join(classes, "id", "left").select(
                "bucket", "id", F.coalesce("class", "id").alias("class")
            ),
            "labelled",
        )
        size = labelled.groupBy("bucket").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")
        )
        # Two documents of a bucket have been compared already.
        left = kept(size.where("low < high AND n > 2").select("bucket"), "unsettled")
        if left.isEmpty():
            break
        inner = kept(labelled.join(left, "bucket"), "unsettled")
        open_buckets = inner.select("bucket", "id")
        if turn is None:
            classes = joined(classes, kept(tile_links(inner, held, similarity, tile), "links"))
            break
        # Another hub for each bucket, compared with the documents of other classes.
        order = F.xxhash64("id", F.lit(turn))
        hub = inner.groupBy("bucket").agg(F.min_by(F.struct("id", "class"), order).alias("to"))
        hub = hub.select("bucket", F.col("to.id").alias("hub"), F.col("to.class").alias("other"))
        crossing = inner.join(kept(hub, "hubs"), "bucket").where("class <> other")
        new = kept(pairs(crossing).join(asked, ["a", "b"], "left_anti"), "pairs")
        if not new.isEmpty():
            asked = asked.union(new)
            classes = joined(classes, kept(links(new, held, similarity).select("a", "b"), "links"))

    of_first = classes.withColumnRenamed("id", "first")
    per_id = member.join(of_first, "first", "left").select("id", F.coalesce("class", "first").alias("class_id"))
    per_id = kept(per_id.groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")), "labels")
    sizes = kept(per_id.groupBy("class_id").agg(F.sum("n").alias("class_size")), "sizes")
    labelled = per_id.join(sizes, "class_id")
    return (
        rows.select("id")
        .join(labelled, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            "class_id",
            "class_size",
            (F.col("id") == F.col("class_id")).alias("is_first"),
        )
    )
