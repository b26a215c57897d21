"""Ranked lexical search: documents as paths of a frequency-ordered trie, searched branch by branch.

Only terms of the queried items matter, so each document is restricted to these, the most frequent
term first. In the tree that a task builds of its documents, equal beginnings share a path, and every
subtree is a run of documents. An item's search goes depth first, the most promising child first: a
subtree's bound comes from the largest count of each of the item's terms in it and from its smallest
document norm, and a subtree that cannot reach the item's last place so far is left out.

The items go through the corpus in blocks of at most ``block_words`` terms, which is all that is sent to
the executors at once.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfscope.llm.divergence import LETTER, terms_of
from shelfscope.llm.shared import chunks, kept, only

ALNUM = LETTER.copy()
ALNUM[48:58] = True

LEAF_DOCS = 64
DEPTH = 24
TREE_ENTRIES = 2_000_000


def item_terms(text: str | None) -> list[str]:
    return terms_of(pa.array([text or ""], pa.string()), ALNUM)[0].to_pylist()


def gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times adds for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def largest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the largest value of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.maximum.reduceat(value[order], starts) if len(starts) else value[:0]


class Tree:
    """Documents in the order of their paths, and the nodes over runs of them.

    A path is a document's restricted terms, most frequent first. It is followed until a run has no
    more than ``LEAF_DOCS`` documents or ``DEPTH`` terms are used up. Nodes are in breadth-first order,
    so the children of one lie together, and so do the bounds of their terms.
    """

    def __init__(self, ids: list, norms: np.ndarray, first: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.arange(len(terms)) - first[doc]
        path = np.full((len(sizes), min(DEPTH, int(sizes.max(initial=0)))), -1, np.int32)
        near = depth < path.shape[1]
        path[doc[near], depth[near]] = terms[near]
        order = np.lexsort(path.T[::-1]) if path.shape[1] else np.arange(len(sizes))
        self.ids, norms, sizes = [ids[i] for i in order], norms[order], sizes[order]
        self.entry = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first[order] - self.entry[:-1], sizes) + np.arange(self.entry[-1])
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.terms = terms[at]
        self.gains = gain(counts[at], norms[self.doc])
        self._grow(path[order])
        self._bound(counts[at], norms)

    def _grow(self, path: np.ndarray) -> None:
        low, high, depth, parent, first, last = [0], [len(path)], [0], [-1], [], []
        at = 0
        while at < len(low):
            a, b, d = low[at], high[at], depth[at]
            first.append(len(low))
            while b - a > LEAF_DOCS and d < path.shape[1]:
                cut = np.flatnonzero(np.diff(path[a:b, d])) + a + 1
                d += 1
                if len(cut):
                    borders = [a, *cut.tolist(), b]
                    low += borders[:-1]
                    high += borders[1:]
                    depth += [d] * (len(cut) + 1)
                    parent += [at] * (len(cut) + 1)
                    break
            last.append(len(low))
            at += 1
        self.low, self.high, self.first, self.last, self.parent = low, high, first, last, np.array(parent)

    def _bound(self, counts: np.ndarray, norms: np.ndarray) -> None:
        """For each node and term in its subtree: the gain of the largest count at the smallest norm."""
        nodes, low = len(self.low), np.array(self.low)
        leaf = np.array(self.first) == np.array(self.last)
        by_place = np.flatnonzero(leaf)[np.argsort(low[leaf], kind="stable")]
        leaf_of = np.repeat(by_place, np.array(self.high)[by_place] - low[by_place])
        norm = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(norm, leaf_of, norms)
        level = np.zeros(nodes, np.int64)
        for node in range(1, nodes):
            level[node] = level[self.parent[node]] + 1
        for node in range(nodes - 1, 0, -1):
            norm[self.parent[node]] = min(norm[self.parent[node]], norm[node])
        width = int(self.terms.max(initial=0)) + 1
        key, most = largest(leaf_of[self.doc] * width + self.terms, counts)
        of = level[key // width]
        done, up = [], (key[:0], most[:0])
        for d in range(int(level.max()), -1, -1):
            own = of == d
            now = largest(np.append(up[0], key[own]), np.append(up[1], most[own]))
            done.append(now)
            up = (self.parent[now[0] // width] * width + now[0] % width, now[1])
        key, most = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(key, kind="stable")
        self.node, self.node_terms = key[order] // width, (key[order] % width).astype(np.int32)
        self.node_gains = gain(most[order], norm[self.node])
        self.node_entry = np.searchsorted(self.node, np.arange(nodes + 1))

    def search(self, weights: np.ndarray, k: int, found: list[tuple]) -> None:
        """Put the documents that are among the k best so far into ``found``: (-score, id).

        ``weights`` has the item's weight of every term, 0 for those it lacks.
        """
        stack = [(np.inf, 0)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or len(found) >= k and bound < -found[k - 1][0]:
                continue
            first, last = self.first[node], self.last[node]
            if first == last:
                self._score(weights, self.low[node], self.high[node], k, found)
                continue
            a, b = self.node_entry[first], self.node_entry[last]
            sums = weights[self.node_terms[a:b]] * self.node_gains[a:b]
            # Sums of integers below 2 ** 53 are exact in double precision.
            bounds = np.bincount(self.node[a:b] - first, sums, last - first)
            order = np.argsort(bounds, kind="stable")
            stack += zip(bounds[order].tolist(), (order + first).tolist())

    def _score(self, weights: np.ndarray, low: int, high: int, k: int, found: list[tuple]) -> None:
        a, b = self.entry[low], self.entry[high]
        sums = weights[self.terms[a:b]] * self.gains[a:b]
        scores = np.bincount(self.doc[a:b] - low, sums, high - low)
        least = max(1, -found[k - 1][0]) if len(found) >= k else 1
        for at in np.flatnonzero(scores >= least):
            insort(found, (-int(scores[at]), self.ids[low + at]))
            del found[k:]


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items as (number, id, terms with their repeats), in blocks of ``most`` terms (or of one item)."""
    held, total = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        terms = Counter(item_terms(row.text))
        if held and total + terms.total() > most:
            yield held
            held, total = [], 0
        held.append((number, row.id, terms))
        total += terms.total()
    if held:
        yield held


def vectors_of(rows: DataFrame, vocabulary: list[str], id_type: str) -> DataFrame:
    """Length, and number and count of the vocabulary's terms, of each document with a term."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.string())
        for batch in batches:
            for part in chunks(batch, "text"):
                terms, first = terms_of(part.column("text"), ALNUM)
                number = pc.fill_null(pc.index_in(terms, wanted), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                size = len(vocabulary) + 1
                pairs, times = np.unique((row * size + number)[number >= 0], return_counts=True)
                ends = np.searchsorted(pairs // size, np.arange(part.num_rows + 1))
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t))
                    for x, t in ((pairs % size, pa.int32()), (times, pa.int64()))
                ]
                out = pa.record_batch([part.column("id"), pa.array(np.diff(first)), *lists], ["id", "n", "terms", "counts"])
                yield out.filter(pa.array(np.diff(first) > 0))

    return rows.mapInArrow(restrict, f"id {id_type}, n long, terms array<int>, counts array<long>")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    block_words: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``k`` documents of highest score for each item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, with A to Z lower-cased. N documents with a
    term hold L terms; a document of n terms has the norm m = 75 + 25 * n * N div L; a term in df
    documents weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and one that occurs tf times adds
    w * (10**9 * tf div (1000 * tf + 12 * m)) for each time that the item has it. Scores of 0 have no
    rank, and equal ones go by the smaller id.

    Null and empty texts have no term; such items have no row. Repeated rows, and rows with equal ids, are
    documents by themselves, and so are items. Rows without id count in N, L and df, and have no rank.
    Other columns are left out. Two tables are written, and an item block's counts are fetched, when this
    is called.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id_col, text=text_col)
    asked = only(items, id=item_col, text=item_text_col)
    id_type, item_type = (dict(x.dtypes)["id"] for x in (rows, asked))
    schema = f"number long, item_id {item_type}, doc_id {id_type}, score long"
    item_kind = to_arrow_type(asked.schema["id"].dataType)
    parts = []
    for block in item_blocks(asked, block_words):
        vocabulary = sorted({t for _, _, terms in block for t in terms})
        vectors = kept(vectors_of(rows, vocabulary, id_type), "vectors")
        total = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(vocabulary), np.int64)
        # No more rows than the block has terms.
        for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
            df[row.t] = row.n
        parts.append(_search(vectors.where("id IS NOT NULL AND size(terms) > 0"), block, vocabulary, df, total, k, schema, item_kind))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    found = reduce(DataFrame.union, parts)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(
    vectors: DataFrame, block: list, vocabulary: list[str], df: np.ndarray, total, k: int, schema: str, item_kind: pa.DataType
) -> DataFrame:
    """Each task's k best documents of each item of a block."""
    frequent_first = np.lexsort((np.arange(len(df)), -df))
    order = np.empty(len(df), np.int32)
    order[frequent_first] = np.arange(len(df))
    number = {t: i for i, t in enumerate(vocabulary)}
    weight = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(n) + 1))) for n in df]
    queries = [
        (item, item_id, {int(order[number[t]]): weight[number[t]] * times for t, times in terms.items()})
        for item, item_id, terms in block
    ]
    n_docs, n_terms = total.docs, max(1, total.terms)
    id_kind = to_arrow_type(vectors.schema["id"].dataType)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size > TREE_ENTRIES:
                yield grown(held)
                held, size = [], 0
        if held:
            yield grown(held)

    def grown(held: list[pa.RecordBatch]) -> Tree:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").combine_chunks()
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        terms = order[lists.flatten().to_numpy()]
        counts = table.column("counts").combine_chunks().flatten().to_numpy()
        by_rank = np.lexsort((terms, np.repeat(np.arange(len(lengths)), lengths)))
        norms = 75 + 25 * table.column("n").to_numpy() * n_docs // n_terms
        return Tree(table.column("id").to_pylist(), norms, first, terms[by_rank], counts[by_rank])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        weights = np.zeros(len(order), np.int64)
        for tree in trees(batches):
            for (_, _, own), found in zip(queries, best):
                weights[list(own)] = list(own.values())
                tree.search(weights, k, found)
                weights[list(own)] = 0
        out = [(n, i, doc, -s) for (n, i, _), found in zip(queries, best) for s, doc in found]
        if out:
            yield pa.record_batch(
                [
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], item_kind),
                    pa.array([x[2] for x in out], id_kind),
                    pa.array([x[3] for x in out], pa.int64()),
                ],
                ["number", "item_id", "doc_id", "score"],
            )

    return vectors.mapInArrow(search, schema)
