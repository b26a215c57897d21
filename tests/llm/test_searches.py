"""Nearest neighbours, source divergence and ranked search against brute force on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import EDGES, edited, words
from shelfscope.llm import divergence, nearest, ranking


def true_neighbours(rows, asks, k):
    """(query id, candidate id, score) of every query, nearest first."""
    def fits(v):
        return v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    distinct = {(i, tuple(v)) for i, v in rows if i is not None and fits(v)}
    out = set()
    for i, v in distinct:
        if asks(i):
            others = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in distinct if (j, w) != (i, v)]
            out |= {(i, rank + 1, j, round(-s, 9)) for rank, (s, j) in enumerate(sorted(others)[:k])}
    return out


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]  # copies, more than any result holds
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [1.0, math.nan, 0.0, 0.0])]
    rows += [(280, [math.inf, 0.0, 0.0, 0.0]), (300, [1.0]), (None, [9.0] * 4), (320, [])]
    rows += [rows[0], rows[0], (20, [0.5, 0.5, 0.5, 0.5])]  # repeated rows; two vectors of one id
    return rows


@pytest.mark.parametrize("id_type", ["long", "int", "string"])
def test_neighbours_of_odd_vectors(spark, odd_vectors, id_type):
    df = spark.createDataFrame(odd_vectors, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumn("vec_id", F.col("vec_id").cast(id_type)).withColumns({c: F.lit(1) for c in ("id", "v", "a", "leaf")})
    as_id = str if id_type == "string" else int
    rows = [(i if i is None else as_id(i), v) for i, v in odd_vectors]
    found = nearest.neighbours(df, F.col("vec_id").cast("int") % 20 == 0, k=7, recall=1.0, leaf_rows=5, tile=16, branching=3)
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()}
    assert got == true_neighbours(rows, lambda i: int(i) % 20 == 0, 7)
    assert dict(found.dtypes)["vec_id"] == dict(df.dtypes)["vec_id"]


def test_neighbours_without_rows_or_queries(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, "vec_id long, embedding array<double>")
    assert nearest.neighbours(df.limit(0), F.lit(True)).count() == 0
    assert nearest.neighbours(df, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert nearest.neighbours(one, F.lit(True)).count() == 0


def test_neighbours_are_found(spark, small):
    df = spark.read.parquet(small.replace("0.001", "0.01") + "/embeddings.parquet")
    found = nearest.neighbours(df, F.col("vec_id") % 20 == 0).collect()
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(dict)
    for r in found:
        got[r.query_id][r.vec_id] = r.score
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[at]
        scores[at] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]].tolist()
        hits, total = hits + len(set(best) & set(got[ids[at]])), total + 20
        assert len(got[ids[at]]) == 20
        assert all(abs(s - x[at] @ x[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in got[ids[at]].items())
    assert hits / total >= 0.9


GROUPS = [(lang, source) for lang in ("en", "xx", None) for source in ("a", "b", "c", None)]


def corpus(seed, n):
    rng = random.Random(seed)
    bag = [w.upper() if i % 7 == 0 else w for i, w in enumerate(words(60, seed).split())] + ["É", "it's", "12x", "ÀB"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(GROUPS)
        kind = rng.random()
        text = None if kind < 0.05 else "" if kind < 0.1 else " ".join(rng.choices(bag, k=rng.randint(1, 40)))
        rows.append((text, lang, source))
    return [*rows, rows[3], rows[3], ("1 2 3", "digits", "only"), (None, "digits", "other")]


def true_divergence(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[A-Za-z\x80-\U0010FFFF]+", text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups.add((lang, source))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        others = [s for g, s in groups if g == lang and s != source]
        total = Counter()
        for s in [source, *others]:
            total.update(counts[lang, s])

        def p(of):
            w = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (of[t] + 1) // w for t in kept}

        mine, whole = p(counts[lang, source]), p(total)
        pairs = {}
        for s in others:
            theirs = p(counts[lang, s])
            pairs[s] = sum((mine[t] - theirs[t]) ** 2 // theirs[t] for t in kept)
        terms = {t: (mine[t] - whole[t]) ** 2 // whole[t] for t in kept if counts[lang, source][t] and mine[t] > whole[t]}
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(values, key=lambda i: (-values[i], i.encode()))[:most]
            out |= {(lang, source, part, i, values[i], r + 1) for r, i in enumerate(order)}
    return out


def test_divergence_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 8)
    monkeypatch.setattr(divergence, "TILE", 2)
    rows = corpus(3, 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "block", "tile", "item")})
    found = {tuple(r) for r in divergence.audit(df, top=5).collect()}
    assert found == true_divergence(rows, 3, 5)
    assert divergence.audit(df.limit(0)).count() == 0


def test_gallop_finds_what_arrays_share():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (7, 7), (3, 5000), (5000, 4000), (1, 1)):
        a, b = (np.unique(rng.integers(0, 9000, size)) for size in (n, m))
        here, there = divergence.gallop(a, b, step=16)
        assert a[here].tolist() == b[there].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_weights_are_exact_for_large_counts():
    total = 9 * 10**15
    counts = np.array([0, 1, 12345678901234, total - 1])
    assert divergence.weights(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_weight_column_equals_weights(spark):
    rows = [(0, 1), (3, 10), (12345678901234, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15)]
    df = spark.createDataFrame(rows, "c long, t long").select(divergence.weight(F.col("c"), F.col("t")))
    assert [r[0] for r in df.collect()] == [1 + 10**9 * (c + 1) // t for c, t in rows]


def true_ranking(docs, items, k):
    def terms(text):
        return ["".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or "")]

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = 0
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("id_type", ["long", "string"])
def test_ranking_of_odd_texts(spark, monkeypatch, id_type):
    monkeypatch.setattr(ranking, "LEAF_DOCS", 4)
    monkeypatch.setattr(ranking, "DEPTH", 6)
    monkeypatch.setattr(ranking, "TREE_ENTRIES", 300)
    base = words(40, 8)
    docs = EDGES + [(100 + i, edited(base, 3 + i % 9, i)) for i in range(60)] + [(200, "É é it's 12,5")]
    items = [(1, base), (2, words(80, 1)), (3, None), (4, ""), (5, "é It's 12 it's nowhere"), (1, "word WORD " + base[:50])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumns({c: F.lit(1) for c in ("id", "n", "terms", "score")})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumn("number", F.lit(2))
    for block_words in (10, 200_000):
        found = sorted(tuple(r) for r in ranking.ranked(df, asked, k=6, block_words=block_words).collect())
        as_id = str if id_type == "string" else int
        assert found == true_ranking([(i if i is None else as_id(i), t) for i, t in docs], items, 6)
    assert ranking.ranked(df.limit(0), asked).count() == 0
    assert ranking.ranked(df, asked.limit(0)).count() == 0
