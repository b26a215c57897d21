"""Nearest neighbours by inner product: a tree of k-means clusters, searched best bin first.

The tree is fitted on a bounded sample of the distinct vectors; every vector is then put into one of
its leaves. A query goes down the tree with a priority queue: the node whose cluster promises the
largest product comes first, whatever its depth, and its leaves are visited in that order. How many
leaves a query visits is widened until a sample of queries finds the wanted share of its true
neighbours, which a pass over all vectors gives.

Equal vectors are one entry that keeps its least ids, as no more of them can be in a result. What
meets in a task is a slice of a leaf with a slice of the queries that visit it, both of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.shared import kept

NAME = ["a", "b"]  # 128 bits of hashes that stand for a vector


@dataclass
class Tree:
    """Nodes in breadth-first order: the children of ``i`` are ``first[i]`` to ``last[i]``.

    ``spread`` is how far above the product with the centre a cluster's best is expected: three
    standard deviations of the part of a residual that points along a query of length 1.
    """

    centers: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree by the nearest centre."""
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live := live[self.last[node[live]] > self.first[node[live]]]):
            for parent in np.unique(node[live]):
                own = live[node[live] == parent]
                children = np.arange(self.first[parent], self.last[parent])
                node[own] = children[closest(x[own], self.centers[children])]
        return self.leaf[node]

    def promises(self, queries: np.ndarray) -> np.ndarray:
        """What each node promises each query."""
        length = np.linalg.norm(queries, axis=1)
        return queries @ self.centers.T + length[:, None] * self.spread

    def visits(self, promise: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a query's visits."""
        queue = [(-promise[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for child in range(self.first[node], self.last[node]):
                heapq.heappush(queue, (-promise[child], child))


def closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * (x @ centers.T)).argmin(1)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 10) -> np.ndarray:
    """Cluster of each vector by k-means, from centres that are far apart with high chance."""
    centers = x[[rng.integers(len(x))]]
    while len(centers) < k:
        away = (x**2).sum(1) + ((centers**2).sum(1) - 2 * (x @ centers.T)).min(1)
        away = np.where(away > 1e-9, away, 0)
        if not away.any():
            break
        centers = np.vstack([centers, x[[rng.choice(len(x), p=away / away.sum())]]])
    for _ in range(turns):
        near = closest(x, centers)
        centers = np.array([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
    return closest(x, centers)


def fit(x: np.ndarray, leaf_rows: int, branching: int, seed: int = 1) -> Tree:
    """Split the sample into clusters, and these again, until a cluster has ``leaf_rows`` or less."""
    rng = np.random.default_rng(seed)
    parts, first, last, leaf = [np.arange(len(x))], [], [], []
    at = leaves = 0
    while at < len(parts):
        own = parts[at]
        k = min(branching, -(-len(own) // leaf_rows))
        near = clusters(x[own], k, rng) if k > 1 else np.zeros(len(own), int)
        split = np.unique(near)
        first.append(len(parts))
        if len(split) > 1:
            parts += [own[near == c] for c in split]
            leaf.append(-1)
        else:
            leaf.append(leaves)
            leaves += 1
        last.append(len(parts))
        at += 1
    centers = np.array([x[own].mean(0) for own in parts])
    rms = np.array([np.sqrt(((x[own] - c) ** 2).sum(1).mean()) for own, c in zip(parts, centers)])
    spread = 3 * rms / np.sqrt(x.shape[1])
    return Tree(centers, spread, np.array(first), np.array(last), np.array(leaf))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def nearest_of(q: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a query and of a vector, and their product: of each query the ``k`` largest that reach its
    ``floor``, and all that a rounding error could put among them. Products are added in the same order for
    every pair."""
    scores = q @ x.T
    k = min(k, len(x))
    least = np.maximum(-np.partition(-scores, k - 1, 1)[:, k - 1], floor)
    at, there = np.nonzero(scores >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
    step = max(1, (1 << 20) // x.shape[1])
    exact = [np.einsum("ij,ij->i", q[at[i : i + step]], x[there[i : i + step]]) for i in range(0, len(at), step)]
    return at, there, np.concatenate(exact)


def usable(v: str) -> Column:
    """Not null, of finite components, not all of them zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0)


def neighbours(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    recall: float = 0.95,
    leaf_rows: int = 2000,
    branching: int = 16,
    sample: int = 20_000,
    sample_bytes: int = 16 << 20,
    calibration: int = 200,
    tile: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest of every row for which ``asks`` holds: query_id, rank, vec_id, score.

    Nearest is the largest inner product; equal products go by the smaller id. A row is no neighbour of
    itself. Rows with equal ids and vectors count once; different vectors under one id are each a
    candidate, and each a query. Rows without id, and vectors that are null, zero or have a null or
    non-finite component, take no part; nor do vectors of another length than most have (of equally
    many, the shorter). A query has fewer rows if there are fewer candidates. Other columns are
    left out.

    The tree is fitted on at most about ``sample`` distinct vectors and ``sample_bytes`` of them, and
    ``calibration`` queries tell how many leaves give ``recall``. Tables are written and the sample is
    fetched when this is called.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("v"))
    named = rows.select("*", F.size("v").alias("dims"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    named = kept(named.groupBy("id", "v", "dims", *NAME).agg(F.max("asks").alias("asks")), "vectors")
    sizes = named.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    if most is None or not most.q:
        return spark.createDataFrame([], schema)
    dims = most.dims
    named = named.where(F.col("dims") == dims)

    def share(df: DataFrame, rows: int) -> DataFrame:
        """About ``rows`` rows, told by their hashes."""
        of = df.count()
        mark = F.pmod(F.xxhash64(F.lit(2), *NAME), F.lit(1 << 30))
        return df.where(mark < int(min(1.0, rows / max(of, 1)) * (1 << 30)))

    distinct = named.select(*NAME).distinct()
    total = distinct.count()
    wanted = min(sample, sample_bytes // (4 * dims))
    drawn = share(distinct, wanted).join(named.select(*NAME, "v"), NAME).dropDuplicates(NAME)
    x = matrix(drawn.orderBy(*NAME).select("v").toArrow().column("v"), dims)
    if not len(x):  # few vectors, and none drawn
        x = matrix(named.select("v").limit(1).toArrow().column("v"), dims)
    tree = fit(x, max(4, leaf_rows * len(x) // max(total, 1)), branching)

    # Entries: distinct vectors with their least ids. A hot vector's rows are cut before the shuffle.
    by_id = Window.partitionBy(*NAME).orderBy("id")
    least = named.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries = least.groupBy(*NAME).agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column("v"), dims)) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("leaf", pa.array(leaf.astype(np.int32)))

    schema_of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    indexed = kept(entries.mapInArrow(place, f"{schema_of}, leaf int"), "indexed")
    asked = kept(named.where("asks").select("id", *NAME, "v"), "queries")
    queries = asked.dropDuplicates(NAME).select(*NAME, "v")
    visits = leaves_to_visit(tree, indexed, share(queries.select(*NAME, "v"), calibration), k, recall, dims)

    # No more rows than the tree has leaves.
    counted = indexed.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
    held = np.zeros(tree.leaves, np.int64)
    held[counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for promise in tree.promises(matrix(batch.column("v"), dims)) if batch.num_rows else []:
                own, seen = [], 0
                for leaf in tree.visits(promise):
                    if len(own) >= visits and seen > k:
                        break
                    own.append(leaf)
                    seen += held[leaf]
                lists.append(own)
            yield batch.append_column("leaves", pa.array(lists, pa.list_(pa.int32())))

    vector = named.schema["v"].dataType.simpleString()
    walked = kept(queries.mapInArrow(walk, f"a long, b long, v {vector}, leaves array<int>"), "walks")
    number = F.xxhash64(F.lit(3), *NAME)
    keys = ["leaf", "q", "n"]

    def visit(visiting: DataFrame) -> DataFrame:
        """The best entries of each visited leaf that reach the query's floor."""
        sides = visiting.groupBy("leaf").agg(F.count("*").alias("q")).join(
            indexed.groupBy("leaf").agg(F.count("*").alias("n")), "leaf"
        )
        parts = [F.ceil(F.col(c) / tile).cast("int").alias(f"{c}_parts") for c in ("q", "n")]
        slices = kept(sides.select("leaf", *parts), "slices")

        def sliced(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in its slice, once for every slice of the other side."""
            df = df.join(slices, "leaf").withColumn(own, F.pmod(number, F.col(f"{own}_parts")).cast("int"))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)))

        left = sliced(visiting, "q", "n").select(*keys, *NAME, "v", "floor")
        right = sliced(indexed, "n", "q").select(*keys, *NAME, "v", "ids")
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        return met.applyInArrow(compare, f"n int, a long, b long, score double, itself boolean, ids array<{kind}>")

    def compare(key, asking: pa.Table, there: pa.Table) -> pa.Table:
        names = [asking.column(c).to_numpy() for c in NAME]
        others = [there.column(c).to_numpy() for c in NAME]
        at = other = np.zeros(0, np.int64)
        score = np.zeros(0)
        if asking.num_rows and there.num_rows:
            floor = asking.column("floor").to_numpy()
            at, other, score = nearest_of(matrix(asking.column("v"), dims), matrix(there.column("v"), dims), k + 1, floor)
        itself = (names[0][at] == others[0][other]) & (names[1][at] == others[1][other])
        part = np.full(len(at), key[2].as_py(), np.int32)
        columns = [pa.array(c) for c in (part, names[0][at], names[1][at], score, itself)]
        ids = there.column("ids").take(pa.array(other)).combine_chunks()
        return pa.table([*columns, ids], names=["n", *NAME, "score", "itself", "ids"])

    # What the first leaf has of a query bounds what the others have to show.
    unbounded = F.lit(float("-inf")).alias("floor")
    first = kept(visit(walked.select(*NAME, "v", unbounded, F.get("leaves", F.lit(0)).alias("leaf"))), "first")
    full = first.groupBy(*NAME, "n").agg(F.count("*").alias("many"), F.min("score").alias("least"))
    floors = full.where(F.col("many") > k).groupBy(*NAME).agg(F.max("least").alias("floor"))
    others = F.explode(F.slice("leaves", F.lit(2), F.greatest(F.size("leaves") - 1, F.lit(0)))).alias("leaf")
    rest = walked.select(*NAME, "v", others).join(kept(floors, "floors"), NAME, "left")
    found = first.unionByName(visit(rest.withColumn("floor", F.coalesce("floor", unbounded))))
    found = found.select(*NAME, "score", "itself", F.explode("ids").alias("vec_id"))
    nearest_first = [F.desc("score"), F.asc("vec_id")]
    # One more than k, as the query itself is among them.
    top = found.withColumn("r", F.row_number().over(Window.partitionBy(*NAME).orderBy(*nearest_first)))
    top = kept(top.where(F.col("r") <= k + 1).drop("r"), "found")
    results = asked.select(F.col("id").alias("query_id"), *NAME).join(top, NAME)
    results = results.where("NOT (itself AND query_id = vec_id)")
    rank = F.row_number().over(Window.partitionBy("query_id", *NAME).orderBy(*nearest_first))
    return results.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def leaves_to_visit(tree: Tree, indexed: DataFrame, queries: DataFrame, k: int, recall: float, dims: int) -> int:
    """The least number of visits at which a sample of queries finds the share ``recall``.

    The sample's true neighbours come from all entries: each task keeps its best ones, and
    no more than ``k`` of each query in the sample reach the driver.
    """
    drawn = queries.orderBy(*NAME).toArrow()
    if not drawn.num_rows:
        return tree.leaves
    q = matrix(drawn.column("v"), dims)
    own = np.stack([drawn.column(c).to_numpy() for c in NAME], 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, leaf = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = q @ matrix(batch.column("v"), dims).T
            names = np.stack([batch.column(c).to_numpy() for c in NAME], 1)
            new[(own[:, None] == names[None]).all(2)] = -np.inf
            scores = np.hstack([scores, new])
            leaf = np.hstack([leaf, np.broadcast_to(batch.column("leaf").to_numpy(), new.shape)])
            if scores.shape[1] > k:
                at = np.argpartition(-scores, k, 1)[:, :k]
                scores, leaf = np.take_along_axis(scores, at, 1), np.take_along_axis(leaf, at, 1)
        row = np.repeat(np.arange(len(q), dtype=np.int32), scores.shape[1])
        live = np.isfinite(scores.ravel())
        columns = [row[live], scores.ravel()[live], leaf.ravel().astype(np.int32)[live]]
        yield pa.record_batch([pa.array(c) for c in columns], ["q", "score", "leaf"])

    seen = indexed.select(*NAME, "v", "leaf").mapInArrow(scan, "q int, score double, leaf int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    truth = seen.withColumn("r", rank).where(F.col("r") <= k).select("q", "leaf").toArrow()
    row, leaf = truth.column("q").to_numpy(), truth.column("leaf").to_numpy()
    times = np.zeros(tree.leaves + 1, np.int64)
    for number, promise in enumerate(tree.promises(q)):
        turn = np.zeros(tree.leaves, np.int64)
        turn[list(tree.visits(promise))] = np.arange(1, tree.leaves + 1)
        times += np.bincount(turn[leaf[row == number]], minlength=tree.leaves + 1)
    reached = np.cumsum(times) >= recall * times.sum()
    return int(np.argmax(reached)) or 1
