"""Document quality from lines: a linear-chain conditional random field.

Each line of a document is good or bad. The potentials are linear in features of the line and of
its neighbours, and transitions tie adjacent lines. Only documents have labels; those of lines are
hidden. Training starts with the document's label on each line, and then takes turns: lines get the
probabilities that the model and the document's label give them, and the model is fitted to
these, so that a good document may hold bad lines and transitions learn how often that is. A document's quality is the mean of its lines' probabilities of being
good, from forward and backward passes over all of it, weighted by their lengths, and a logistic
curve fitted on the training documents turns it into the probability of the label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.linear import fit_logistic, in_training, predict, sampled, sigmoid
from shelfscope.llm.shared import chunks, only, release_idle
from shelfscope.llm.words import M1, buffers, hashes, mix, spans

WORD = re.compile(r"[^\x20\x09-\x0D]")

#: Lines whose features are held at once; a longer single text is taken alone.
CHUNK_LINES = 20_000
CHUNK_TEXT = 2 << 20

# What the features count.
KINDS = [
    np.isin(np.arange(256), np.arange(65, 91)),  # capitals
    np.isin(np.arange(256), np.arange(48, 58)),  # digits
    np.isin(np.arange(256), list(b"#*$%&<>@^~=+_\\")),  # symbols
    np.isin(np.arange(256), list(b"|")),
    np.isin(np.arange(256), list(b"!?")),
    np.isin(np.arange(256), list(b".,;:")),
]


@dataclass
class Chains:
    """Lines of some documents, one after another: features, lengths, and first line of each."""

    features: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def chains(texts: pa.Array) -> Chains:
    """Lines with a word; a text without any counts as one line without words."""
    data, borders = buffers(texts)
    rows = len(texts)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([borders[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    w0, w1 = spans(data, borders)
    at = np.searchsorted(w0, np.append(starts, len(data)))
    live = np.diff(at) > 0
    starts, lo, hi = starts[live], at[:-1][live], at[1:][live]
    row = np.searchsorted(borders, starts, "right") - 1
    n_lines = len(starts)

    def per_line(values: np.ndarray) -> np.ndarray:
        """Sums over the words of each line."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[hi] - total[lo]

    words = (hi - lo).astype(float)
    size = per_line(w1 - w0)
    h = hashes(data, w0, w1)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    length = np.maximum(size, 1)
    columns = []
    for kind in KINDS:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        columns.append(per_line(total[w1] - total[w0]) / length)
    # A line is the sum of its words' hashes, with their places, and may stand in the text before.
    place = np.arange(len(h)) - np.repeat(lo, hi - lo) if n_lines else np.zeros(0, np.int64)
    mixed = mix(h ^ mix((place + 1).astype(np.uint64) * M1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    line = mix((sums[hi] - sums[lo]) ^ mix(row.astype(np.uint64)))
    _, first_seen, inverse = np.unique(line, return_index=True, return_inverse=True)
    seen = (first_seen[inverse] != np.arange(n_lines)).astype(float)
    short = per_line((w1 - w0) <= 3) / np.maximum(words, 1)
    columns += [
        np.sqrt(columns[0]),
        np.sqrt(columns[2]),
        np.sqrt(columns[3]),
        np.log1p(words) / 5,
        np.minimum(size / np.maximum(words, 1), 30) / 10,
        short,
        per_line(again) / np.maximum(words, 1),
        seen,
    ]
    own = np.stack(columns, 1) if n_lines else np.zeros((0, len(KINDS) + 8))
    # Room for texts without a line.
    counts = np.bincount(row, minlength=rows)
    padded = np.maximum(counts, 1)
    first = np.concatenate([[0], np.cumsum(padded)])
    to = first[row] + np.arange(n_lines) - np.concatenate([[0], np.cumsum(counts)])[row]
    full = np.zeros((first[-1], own.shape[1]))
    weight = np.ones(first[-1])
    full[to], weight[to] = own, size
    before, after = np.zeros_like(full), np.zeros_like(full)
    before[1:], after[:-1] = full[:-1], full[1:]
    is_first, is_last = np.zeros(len(full)), np.zeros(len(full))
    is_first[first[:-1]] = is_last[first[1:] - 1] = 1
    before[is_first == 1], after[is_last == 1] = 0, 0
    edges = np.stack([is_first, is_last, np.ones(len(full))], 1)
    return Chains(np.hstack([full, before, after, edges]), weight, first)


def in_slices(texts: pa.Array) -> Chains:
    """The same for many texts: only the features of a slice are ever held in double precision."""
    batch = pa.record_batch([texts], ["text"])
    parts = []
    for part in chunks(batch, "text", 1 << 20, CHUNK_LINES):
        found = chains(part.column("text"))
        parts.append(Chains(found.features.astype(np.float32), found.weight, np.diff(found.first)))
    features, weight, lengths = (np.concatenate(x) for x in zip(*((p.features, p.weight, p.first) for p in parts)))
    return Chains(features, weight, np.concatenate([[0], np.cumsum(lengths)]))


def passes(unary: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and of each pair of neighbours' states, all chains at once.

    ``unary``: log potential of good over bad; ``transition``: 2 x 2 log potentials.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    emit = np.stack([np.zeros_like(unary), unary], 1)
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), "left")  # chains longer than t
    for t in range(longest):
        at = start[: live[t]] + t
        if t == 0:
            forward[at] = emit[at]
        else:
            came = forward[at - 1][:, :, None] + transition
            forward[at] = emit[at] + np.logaddexp(came[:, 0], came[:, 1])
    for t in range(longest - 1, 0, -1):
        at = start[: live[t]] + t
        goes = (emit[at] + backward[at])[:, None, :] + transition
        backward[at - 1] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
    both = forward + backward
    good = sigmoid(both[:, 1] - both[:, 0])
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + transition + (emit[at] + backward[at])[:, None, :]
    pair = np.exp(pair - np.logaddexp(both[at, 0], both[at, 1])[:, None, None])
    return good, pair


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    curve: np.ndarray

    def good_lines(self, lines: Chains) -> np.ndarray:
        """Probability of good of each line."""
        x = (lines.features - self.mean) / self.scale
        return passes(x @ self.weights, self.transition, lines.first)[0]

    def judge(self, lines: Chains) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean of the lines' probabilities of good, and share of bad lines, of each document."""
        good = self.good_lines(lines)
        doc = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        bad, total = lines.weight * (good < 0.5), np.bincount(doc, lines.weight)
        return np.bincount(doc, good * lines.weight) / total, np.bincount(doc, bad) / total

    def quality(self, lines: Chains) -> np.ndarray:
        return self.judge(lines)[0]

    def score(self, lines: Chains) -> np.ndarray:
        return predict(self.curve, self.quality(lines)[:, None])


def fit(
    lines: Chains,
    label: np.ndarray,
    turns: int = 120,
    rate: float = 0.1,
    ridge: float = 1e-3,
    rounds: int = 3,
    round_turns: int = 30,
    trust: float = 1.0,
) -> Model:
    """Maximum likelihood by gradient steps with momentum and per-weight rates (Adam), in ``rounds``.

    In the first, lines have their document's label; in each later one the probabilities of the last
    model, with ``trust`` added to the log potential of the document's label.
    """
    kind = lines.features.dtype
    mean, scale = lines.features.mean(0, dtype=float), lines.features.std(0, dtype=float)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (lines.features - mean.astype(kind)) / scale.astype(kind)
    doc = np.repeat(np.arange(len(label)), np.diff(lines.first))
    # Each document counts alike, however many lines it has.
    share = (1 / np.diff(lines.first))[doc] / len(label)
    inner = np.ones(len(doc), bool)
    inner[lines.first[:-1]] = False
    at = np.flatnonzero(inner)
    y = label[doc]
    given = np.zeros((2, 2))
    np.add.at(given, (y[at - 1].astype(int), y[at].astype(int)), share[at])

    def unary(theta: np.ndarray) -> np.ndarray:
        return (x @ theta[:-4].astype(kind)).astype(float)

    theta = np.zeros(x.shape[1] + 4)
    for number in range(rounds):
        if number:
            told = trust * (2 * label[doc] - 1)
            y, pair = passes(unary(theta) + told, theta[-4:].reshape(2, 2), lines.first)
            given = (pair * share[at, None, None]).sum(0)
        first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
        for turn in range(1, (round_turns if number else turns) + 1):
            good, pair = passes(unary(theta), theta[-4:].reshape(2, 2), lines.first)
            off = ((good - y) * share).astype(kind)
            slope = np.concatenate([x.T @ off, ((pair * share[at, None, None]).sum(0) - given).ravel()])
            slope += ridge * theta
            first_moment = 0.9 * first_moment + 0.1 * slope
            second_moment = 0.999 * second_moment + 0.001 * slope**2
            theta -= rate * (first_moment / (1 - 0.9**turn)) / (np.sqrt(second_moment / (1 - 0.999**turn)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), np.zeros(2))
    model.curve = fit_logistic(model.quality(lines)[:, None], label, ridge=1e-3)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 4_000,
    sample_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model | None:
    """A model of about ``sample`` labelled documents and ``sample_bytes`` at most; none without both kinds.

    They are chosen by a hash of the id among those whose id's CRC-32 has a remainder modulo five, and
    fetched when this is called. Ids with contradicting labels are left out; of several texts of an id, one
    is taken.
    """
    rows = only(docs, id=id_col, text=text_col)
    found = sampled(rows, only(labels, id=id_col, label=label_col), ["label"], sample, sample_bytes)
    label = found.column("label").to_numpy().astype(float)
    if not 0 < label.sum() < len(label):
        return None
    texts = found.column("text").combine_chunks().cast(pa.string())
    del found
    lines = in_slices(texts)
    del texts
    return fit(lines, label)


def score(
    docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, held_out, score (probability of a good document), predicted (0 or 1), bad_share.

    ``bad_share`` is the share of bad lines, by length.
    ``held_out`` marks ids that no model is trained on. A null or empty text is scored like a line
    without words. Without a model every score is 0.5. A null id is held out.
    """
    rows = only(docs, id=id_col, text=text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_TEXT, CHUNK_LINES):
                p, bad = np.full(part.num_rows, 0.5), np.zeros(part.num_rows)
                if model:
                    quality, bad = model.judge(chains(part.column("text")))
                    p = predict(model.curve, quality[:, None])
                yield pa.record_batch([part.column("id"), pa.array(p), pa.array(bad)], ["doc_id", "score", "bad_share"])

    scored = rows.mapInArrow(apply, f"doc_id {dict(rows.dtypes)['id']}, score double, bad_share double")
    return scored.select(
        "doc_id",
        (~F.coalesce(in_training(F.col("doc_id")), F.lit(False))).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "bad_share",
    )


def mark_lines(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_lines (lines with a word), bad_lines (numbers of the bad ones among all lines, from 0)
    and bad_share (their share of the words' bytes).

    A line is bad if its probability of good is below a half. Lines end at line feeds. A null or empty text,
    or no model, has no bad line.
    """
    rows = only(docs, id=id_col, text=text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_TEXT, CHUNK_LINES):
                lines = chains(part.column("text"))
                texts = part.column("text").to_pylist()
                numbers = [[n for n, line in enumerate((t or "").split("\n")) if WORD.search(line)] for t in texts]
                good = model.good_lines(lines) if model else np.ones(len(lines.weight))
                out = [[], [], []]
                for row, own in enumerate(numbers):
                    at = lines.first[row] + np.arange(len(own))
                    bad = good[at] < 0.5
                    weight = lines.weight[at]
                    out[0].append(len(own))
                    out[1].append([n for n, b in zip(own, bad) if b])
                    out[2].append(float(weight[bad].sum() / weight.sum()) if len(own) else 0.0)
                kinds = [pa.int32(), pa.list_(pa.int32()), pa.float64()]
                yield pa.record_batch(
                    [part.column("id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                    ["doc_id", "n_lines", "bad_lines", "bad_share"],
                )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(apply, f"doc_id {kind}, n_lines int, bad_lines array<int>, bad_share double")


def keep_good(
    docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_idle()
        for batch in batches:
            for part in chunks(batch, text_col, CHUNK_TEXT, CHUNK_LINES):
                good = model.score(chains(part.column(text_col))) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(choose, docs.schema) if model else docs
