import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from samples import edited, words
from shelfscope.llm import decontaminate, line_crf, line_templates, near_dedup, quality_rules, substrings, toxicity
from pyspark.sql import functions as F
from shelfscope.llm.shared import chunks
from shelfscope.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_words_are_runs_of_other_characters():
    texts = ["a b  c\n", None, "", " x", "l" * 50 + " " + "l" * 51 + "\t" + "l" * 50, "é　ü\té\x0b."]
    found = words_of(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    spelled = [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
    assert found.counts.tolist() == [len(w) for w in want]
    assert spelled == [w for ws in want for w in ws]
    assert len(set(found.hashes.tolist())) == len(set(spelled))


def test_passages_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [words(70, 900 + k) for k in range(4)]
    docs = []
    for k in range(60):
        parts = [words(rng.randint(0, 60), k)] + [rng.choice(pool)[: rng.randint(100, 500)] for _ in range(2)]
        docs.append((rng.randint(0, 10**6), " ".join(parts + [words(20, k + 500)])))
    docs += [(10**7, docs[3][1]), (10**7 + 1, "a " * 200), (10**7 + 2, "a " * 90 + "b")]
    first, want = {}, {}
    for doc, text in sorted(docs):
        w = text.split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), doc)
    for doc, text in docs:
        w = text.split()
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < doc:
                keep[i : i + 50] = [False] * 50
        want[doc] = " ".join(x for x, k in zip(w, keep, strict=True) if k)
    found = substrings.duplicate_spans(frame(spark, docs)).collect()
    assert {r.doc_id: r.kept_text for r in found} == want
    assert sum(r.n_removed for r in found) > 1000
    by_id = dict(docs)
    for r in found:
        for s in r.spans:
            source = by_id[s.source].split()
            own = r.text.split()[s.start : s.end]
            assert s.end - s.start >= 50 and source[s.source_start : s.source_start + len(own)] == own


def test_recurring_templates_are_dropped(spark):
    def doc(k, *lines):
        prose = [words(12, 1000 * k + j) + "." for j in range(6)]
        return k, "\n".join([*prose[:3], *lines, *prose[3:]])

    names = ["anna", "ben", "carla", "dora", "emil", "fritz"]
    docs = [doc(k, f"Posted by the author {names[k]} on our site", f"Page {k} of 17", "All rights reserved.") for k in range(6)]
    docs += [doc(10, "Posted by the author of some quite different line"), doc(11, "Seen only once here")]
    docs += [(20 + k, "\n".join(words(9, 7000 + j) for j in range(5))) for k in range(6)]  # copies
    found = {r.doc_id: r for r in line_templates.drop_lines(frame(spark, docs)).collect()}
    for k in range(6):
        assert found[k].n_dropped == 3
        assert found[k].text == doc(k)[1]
    for k in (10, 11, *range(20, 26)):
        assert (found[k].n_dropped, found[k].text) == (0, dict(docs)[k])


def test_templates_go_from_documents_of_little_else_but_not_from_classes_of_copies(spark):
    notices = [f"Notice {k}: " + words(9, 6000 + k) for k in range(3)]
    docs = [(k, "\n".join([notices[k % 3], notices[(k + 1) % 3], *[words(15, 100 * k + j) for j in range(6)]])) for k in range(9)]
    docs += [(9, "\n".join([*notices, words(6, 1)])), (10, "\n".join([notices[0], notices[2]]))]
    body = [words(16, 7000 + j) for j in range(30)]
    docs += [(20 + k, "\n".join([*body[:k], words(16, 8000 + k), *body[k + 1 :]])) for k in range(6)]  # near copies
    classes = near_dedup.near_duplicates(frame(spark, docs[11:]))
    singles = frame(spark, docs[:11]).selectExpr("doc_id", "doc_id AS class_id")
    classes = classes.select("doc_id", "class_id").union(singles)
    found = {r.doc_id: r for r in line_templates.drop_lines(frame(spark, docs), classes=classes).collect()}
    for k in range(9):
        assert (found[k].n_dropped, found[k].text) == (2, "\n".join(dict(docs)[k].split("\n")[2:]))
    assert (found[9].n_dropped, found[9].text) == (3, words(6, 1))
    assert (found[10].n_dropped, found[10].text) == (2, "")
    for k in range(20, 26):
        assert (found[k].n_dropped, found[k].text) == (0, dict(docs)[k])


def test_pages_of_mostly_boilerplate_lose_it(spark):
    """Such pages are near copies of each other, and still their notices recur."""
    notices = [words(12, 400 + k) for k in range(6)]
    docs = [(k, "\n".join([*notices[:3], words(5 if k < 40 else 40, 900 + k), *notices[3:]])) for k in range(80)]
    docs += [(100 + k, docs[0][1]) for k in range(5)]
    found = line_templates.drop_lines(frame(spark, docs)).collect()
    own = {k: text.split("\n")[3] for k, text in docs}
    assert {(r.doc_id, r.text, r.n_dropped) for r in found} == {(k, own[k], 6) for k in own}


def slow_lines(docs, min_docs=4, least_tokens=4, constant=0.6, leading=3):
    """The rule for single lines in plain Python: what stays of each text."""
    def form(line):
        return tuple(None if any(c in "0123456789" for c in t) else t for t in WORD.findall(line))

    classes = {}  # a class of documents of equal words has one number
    members = {tuple(WORD.findall(t)): n for n, t in enumerate(t for _, t in docs if t is not None)}
    for _, text in docs:
        for line in (text or "").split("\n"):
            if form(line):
                classes.setdefault(form(line), set()).add(members[tuple(WORD.findall(text))])
    leaves = {}
    for f, who in classes.items():
        leaves.setdefault((len(f), f[:leading]), {})[f] = who
    templates = {}
    for (size, _), forms in leaves.items():
        if len(set().union(*forms.values())) < min_docs:
            continue
        seen = Counter()
        for f, who in forms.items():
            if size >= least_tokens:
                seen.update({(place, t): len(who) for place, t in enumerate(f)})
        for f, who in forms.items():
            stays = tuple((i, t) for i, t in enumerate(f) if t is not None and seen[i, t] >= min_docs)
            general = size >= least_tokens and len(stays) >= constant * size
            templates.setdefault(((size, f[:leading]), stays) if general else f, []).append((f, who))
    dropped = {f for t in templates.values() if len(set().union(*(w for _, w in t))) >= min_docs for f, _ in t}
    return [
        (i, t if t is None else "\n".join(line for line in t.split("\n") if not form(line) or form(line) not in dropped))
        for i, t in docs
    ]


def test_line_templates_equal_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = slow_lines(docs)
    found = line_templates.drop_lines(frame(spark, docs)).select("doc_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert sum(a != b for (_, a), (_, b) in zip(docs, want)) > 20


def test_line_templates_of_ids_of_any_type(spark):
    docs = [(k, f"{words(9, 77)}\n{words(9, k)}") for k in range(6)] + [(None, words(9, 77)), (3, words(9, 77))]
    for kind in ("int", "string", "long"):
        df = frame(spark, docs).withColumn("doc_id", F.col("doc_id").cast(kind))
        found = [tuple(r) for r in line_templates.drop_lines(df).select("doc_id", "text").collect()]
        want = [(k, words(9, k)) for k in range(6)] + [(None, ""), (3, "")]
        as_id = str if kind == "string" else int
        assert sorted(found, key=str) == sorted([(k if k is None else as_id(k), t) for k, t in want], key=str)


def test_other_columns_stay(spark):
    docs = frame(spark, [(1, "a b c d e"), (2, "f g h i j")]).selectExpr("'x' AS forms", "doc_id", "text", "doc_id AS id")
    found = line_templates.drop_lines(docs)
    assert found.columns == ["forms", "doc_id", "text", "id", "n_lines", "n_dropped"]
    assert sorted(map(tuple, found.collect())) == [("x", 1, "a b c d e", 1, 1, 0), ("x", 2, "f g h i j", 2, 1, 0)]


def brute_align(item, text):
    best = 0
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i, j in itertools.product(range(1, len(item) + 1), range(1, len(text) + 1)):
        step = 2 if item[i - 1] == text[j - 1] else -1
        h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - 1, h[i, j - 1] - 1)
        best = max(best, h[i, j])
    return best


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = (rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, end = decontaminate.align(item, text)
        assert score == brute_align(item.tolist(), text.tolist())
        assert score == brute_align(item.tolist(), text[:end].tolist())


def test_copies_and_edited_copies_of_items_are_found(spark):
    items = [(k, words(35, 5000 + k)) for k in range(8)]
    docs = []
    for k in range(40):
        before, after = words(90, 2 * k), words(60, 2 * k + 1)
        middle = ["", items[k % 8][1], edited(items[k % 8][1].upper(), 8, k), "common " * 40][k % 4]
        docs.append((k, f"{before} {middle}, {after}"))
    found = decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id int, text string"))
    small = decontaminate.leaks(
        frame(spark, docs), spark.createDataFrame(items, "item_id int, text string"), block_words=60
    )
    rows = sorted(map(tuple, found.collect()))
    assert sorted(map(tuple, small.collect())) == rows
    assert {(r[0], r[1]) for r in rows} == {(k, k % 8) for k in range(40) if k % 4 in (1, 2)}
    assert all(r[2] == 1.0 and r[3] == 90 for r in rows if r[0] % 4 == 1)


def test_lines_get_the_marginals_of_all_labelings():
    rng = np.random.default_rng(5)
    unary, transition = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 9])
    good, pair = line_crf.passes(unary, transition, first)
    for a, b in zip(first, first[1:]):
        total, marginal, pairs = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(np.dot(y, unary[a:b]) + sum(transition[s, t] for s, t in zip(y, y[1:])))
            total += p
            marginal += p * np.array(y)
            for t in range(1, b - a):
                pairs[t, y[t - 1], y[t]] += p
        assert np.allclose(good[a:b], marginal / total)
        inner = np.setdiff1d(np.arange(9), first[:-1])
        for t in range(1, b - a):
            assert np.allclose(pair[list(inner).index(a + t)], pairs[t] / total)


def test_good_and_bad_lines_are_told_apart(spark):
    docs, labels = [], []
    for k in range(400):
        lines = [words(10, 40 * k + j) for j in range(5)]
        if k % 3 == 0:
            lines = [x.upper() + " !!" for x in lines[:4]] + lines[4:]
        docs.append((k, "\n".join(lines)))
        labels.append((k, int(k % 3 != 0)))
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int")
    scored = line_crf.score(frame(spark, docs), line_crf.train(frame(spark, docs), known)).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in scored if r.held_out or r.doc_id >= 300]) > 0.97
    kept = line_crf.keep_good(frame(spark, docs), line_crf.train(frame(spark, docs), known))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if r.predicted}


def test_chain_finds_what_its_words_tell(spark):
    rng, docs, labels = random.Random(8), [], []
    for k in range(1500):
        rude, threat = k % 4 == 0, k % 8 == 0
        more = rng.sample(["zorg", "blarf", "quux"], 2) * rude + ["menace"] * threat
        text = words(40, k).split() + more
        rng.shuffle(text)
        docs.append((k, " ".join(text).title() + "."))
        labels.append((k, int(rude), int(threat)))
    known = spark.createDataFrame(labels[:1000], "doc_id long, rude int, threat int")
    found = toxicity.classify(frame(spark, docs), known, ["rude", "threat"]).collect()
    held = [r for r in found if r.doc_id >= 1000]
    assert np.mean([r.is_rude == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert np.mean([r.is_threat == (r.doc_id % 8 == 0) for r in held]) > 0.97


def base_counts(text):
    w = text.split()
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if x.split()]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    rng, docs = random.Random(3), []
    for k in range(40):
        parts = [words(rng.randint(1, 12), rng.randint(0, 15)) for _ in range(rng.randint(1, 12))]
        docs.append((k, rng.choice(["\n", " ", "\n\n", " | #"]).join(parts)))
    found = quality_rules.judge(frame(spark, docs).selectExpr("*", "'en' AS lang")).collect()
    for r in found:
        assert tuple(r)[1:6] == base_counts(dict(docs)[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_mixes_are_far_from_the_usual(spark):
    rng, docs = random.Random(9), []
    for k in range(200):
        text = [w for x in words(150, k).split() for w in (x, rng.choice(["the", "of", "and", "to"]))]
        docs.append((k, " ".join(text).upper() if k % 20 == 0 else " ".join(text)))
    judged = quality_rules.judge(frame(spark, docs).selectExpr("*", "'en' AS lang"))
    assert {r.doc_id for r in judged.where("NOT kept").collect()} == {k for k in range(200) if k % 20 == 0}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bad_lines_in_good_documents_are_found(spark, small):
    """Lines of held-out junk, planted into held-out good documents."""
    folder = small.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = line_crf.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    rng = random.Random(2)
    junk = [line for i, q in sorted(held.items()) if not q for line in texts[i].split("\n") if len(line.split()) > 3]
    planted, at = [], {}
    for i, q in sorted(held.items()):
        lines = [line for line in texts[i].split("\n") if line.strip()]
        if q and len(lines) > 4:
            at[i] = rng.randrange(1, len(lines))
            lines.insert(at[i], rng.choice(junk))
            planted.append((i, "\n".join(lines)))
    found = {r.doc_id: r for r in line_crf.mark_lines(frame(spark, planted), model).collect()}
    hits = sum(at[i] in r.bad_lines for i, r in found.items())
    others = sum(len(r.bad_lines) for r in found.values()) - hits
    assert hits / len(found) >= 0.8
    assert others / sum(r.n_lines - 1 for r in found.values()) <= 0.25
    assert all(0 <= r.bad_share <= 1 and len(r.bad_lines) <= r.n_lines for r in found.values())
    empty = line_crf.mark_lines(frame(spark, [(1, None), (2, ""), (3, "a\n\nb")]), None).collect()
    assert [(r.n_lines, r.bad_lines, r.bad_share) for r in sorted(empty, key=lambda r: r.doc_id)] == [
        (0, [], 0.0), (0, [], 0.0), (2, [], 0.0),
    ]


def test_many_short_lines_take_bounded_memory():
    """A megabyte of lines of two bytes, in one batch, is cut by lines."""
    batch = pa.record_batch([pa.array(["a\n" * 5_000] * 100)], ["text"])
    parts = list(chunks(batch, "text", line_crf.CHUNK_TEXT, line_crf.CHUNK_LINES))
    assert sum(p.num_rows for p in parts) == 100
    assert max(p.num_rows for p in parts) * 5_000 <= line_crf.CHUNK_LINES + 5_000


def test_every_language_has_its_characters_judged(spark):
    """A fifth language, without common words, and a text of it that is all capitals and digits."""
    docs = [(k, words(120, 50 + k), "it") for k in range(30)]
    docs += [(100, words(120, 7).upper().replace("A", "7"), "it"), (101, words(120, 9).upper(), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert all(found[k].kept and found[k].class_distance is not None for k in range(30))
    assert all(r.word_distance is None for r in found.values())
    assert not found[100].kept and found[100].class_distance > 0.5
    assert found[101].kept and found[101].class_distance is None
