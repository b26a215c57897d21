from collections import Counter

import numpy as np
from samples import edited, words
from shelfscope.llm import near_dedup


def brute(docs, least=0.8):
    """Classes by comparing all pairs."""
    bags, cls = {}, {d: d for d, _ in docs}

    def find(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for d, text in docs:
        w = text.split()
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), tuple(w)
    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b:
                x, y = bags[a][0], bags[b][0]
                both = (x & y).total()
                alike = both / max(1, x.total() + y.total() - both) >= least
                if alike or (bags[a][1] and bags[a][1] == bags[b][1]):
                    one, two = sorted((find(a), find(b)))
                    cls[two] = one
    return {d: find(d) for d in ids}


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(7)
    value = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    row = np.repeat([0, 1], 60)
    sign = near_dedup.signatures(row, np.tile(value, 2), np.concatenate([a, b]), 2, 20_000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 0.015


def test_signature_of_one_document_does_not_depend_on_its_batch():
    value = np.arange(1, 40).astype(np.uint64)
    alone = near_dedup.signatures(np.zeros(39, int), value, np.ones(39, int), 1, 125)
    row = np.concatenate([np.zeros(39, int), np.full(39, 2)])
    three = near_dedup.signatures(row, np.tile(value, 2), np.ones(78, int), 3, 125)
    assert (three[[0, 2]] == alone).all() and np.isinf(three[1]).all()


def test_classes_equal_all_pairs(spark):
    docs = [(k, words(60 + k, k)) for k in range(12)]
    for k in range(12):
        docs += [(100 + 10 * k + e, edited(docs[k][1], every, e)) for e, every in enumerate((12, 25, 40, 70))]
    docs += [(300 + k, docs[k][1]) for k in range(3)] + [(400, "a b"), (401, "a b"), (402, "a c"), (403, "")]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == brute(docs)


def test_a_large_group_needs_more_than_one_hub(spark):
    """Copies that differ from each other by more than from their source, and the source late."""
    base = words(100, 5)
    docs = [(k, edited(base, 90 - k % 3, k)) for k in range(60)] + [(900, base)]
    docs += [(500 + k, words(80, 1000 + k)) for k in range(20)]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == brute(docs)


def test_no_link_is_lost_in_the_last_turn(spark):
    docs = [(k, edited(words(100, 5), 60, k)) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for rounds in (0, 1):
        found = near_dedup.near_duplicates(frame, hub_rounds=rounds, tile=8)
        assert {r.doc_id: r.class_id for r in found.collect()} == brute(docs)


def test_overlaps_equal_counters():
    rng = np.random.default_rng(4)
    bags = []
    for _ in range(20):
        value, times = np.unique(rng.integers(0, 30, rng.integers(1, 60)), return_counts=True)
        bags.append((value, times.astype(np.int32)))
    counters = [Counter(dict(zip(v.tolist(), t.tolist()))) for v, t in bags]
    got = near_dedup.overlaps(bags)
    assert got.tolist() == [[(x & y).total() for y in counters] for x in counters]


def test_further_edges_give_the_classes_of_all_edges(spark, monkeypatch):
    rng = np.random.default_rng(11)
    drawn = [sorted(rng.choice(90, 2, replace=False).tolist()) for _ in range(70)]
    edges = spark.createDataFrame(drawn + drawn[:5], "a long, b long")
    first, more = (spark.createDataFrame(part, "a long, b long") for part in (drawn[:40], drawn[35:]))
    classes = near_dedup.joined(near_dedup.components(first), more)
    assert sorted(classes.collect()) == sorted(near_dedup.components(edges).collect())
    nothing = near_dedup.joined(near_dedup.components(first.limit(0)), more)
    assert sorted(nothing.collect()) == sorted(near_dedup.components(more).collect())
    # Edges inside classes take no turn at all.
    monkeypatch.setattr(near_dedup, "components", None)
    assert near_dedup.joined(classes, edges) is classes
