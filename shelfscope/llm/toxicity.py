"""Toxicity by a chain of linear classifiers over words.

The categories are learned in a given order. The model of a category sees which of its indicator
words a document has, and the probabilities of the categories before it. For training these are
out-of-fold predictions, so that a later model meets earlier probabilities of the kind it will get
for new documents. Indicator words are those that tell the category best in the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.linear import fit_logistic, predict, sampled
from shelfscope.llm.shared import chunks, only
from shelfscope.llm.words import words_of


@dataclass
class Link:
    """One category: its words' hashes, ascending, the model and the least probability to say yes."""

    name: str
    words: np.ndarray
    model: np.ndarray
    threshold: float


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct words of each row."""
    words = words_of(texts, plain=True)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    order = np.lexsort((words.hashes, row))
    row, value = row[order], words.hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def indicators(row: np.ndarray, value: np.ndarray, label: np.ndarray, most: int, least_docs: int) -> np.ndarray:
    """Hashes of the words with the largest chi-squared for the label, ascending."""
    distinct, at = np.unique(value, return_inverse=True)
    n, yes = len(label), label.sum()
    docs = np.bincount(at, minlength=len(distinct)).astype(float)
    both = np.bincount(at, label[row], len(distinct))
    off = (both * n - docs * yes) ** 2 / np.maximum(docs * (n - docs) * yes * (n - yes) / n, 1e-9)
    off[docs < least_docs] = 0
    best = np.argsort(-off, kind="stable")[:most]
    # 15: of words without any relation to the label, one in ten thousand gets that far.
    return np.sort(distinct[best[off[best] > 15]])


def presence(row: np.ndarray, value: np.ndarray, words: np.ndarray, rows: int) -> np.ndarray:
    """One where a row has a word."""
    out = np.zeros((rows, len(words)), np.float32)
    if len(words):
        at = np.minimum(np.searchsorted(words, value), len(words) - 1)
        hit = words[at] == value
        out[row[hit], at[hit]] = 1
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that separates with the largest F1."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    # Only the last of equal probabilities is a place to cut.
    f1[:-1][np.diff(p[order]) == 0] = -1
    at = int(f1.argmax())
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0)) / 2)


def fit_chain(
    texts: pa.Array, labels: dict[str, np.ndarray], folds: int = 5, most_words: int = 400, least_docs: int = 5
) -> list[Link]:
    """Learn the categories of ``labels`` (0 or 1 a row) in their order."""
    row, value = word_sets(texts)
    n = len(texts)
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    chain = []
    for name, y in labels.items():
        y = y.astype(float)
        words = indicators(row, value, y, most_words, least_docs)
        x = np.hstack([presence(row, value, words, n), before])
        out_of_fold = np.zeros(n)
        for k in range(folds):
            held = fold == k
            if held.any():
                # Words are chosen without the fold as well.
                inner = indicators(row[~held[row]], value[~held[row]], np.where(held, 0, y), most_words, least_docs)
                own = np.hstack([presence(row, value, inner, n), before])
                out_of_fold[held] = predict(fit_logistic(own[~held], y[~held]), own[held])
        chain.append(Link(name, words, fit_logistic(x, y), best_threshold(out_of_fold, y)))
        before = np.hstack([before, out_of_fold[:, None]])
    return chain


def predict_chain(chain: Sequence[Link], texts: pa.Array) -> np.ndarray:
    """Probabilities, a column for each category."""
    row, value = word_sets(texts)
    out = np.zeros((len(texts), len(chain)))
    for k, link in enumerate(chain):
        x = np.hstack([presence(row, value, link.words, len(texts)), out[:, :k]])
        out[:, k] = predict(link.model, x)
    return out


def classify(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    sample: int = 12_000,
    sample_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, p_<category> (six places) and is_<category> for each category of the chain.

    ``labels`` has the id and a column of 0 or 1 for each category; rows with a null there are not
    learned from, nor ids with contradicting ones. The chain is fitted on the driver on about ``sample``
    labelled documents and ``sample_bytes`` at most, one text of an id, chosen by a hash of the id among those whose id's CRC-32 has a remainder modulo five; every row
    is classified. Null and empty texts get what the models say of no words. A category without
    both kinds of labels gets the probability of its only kind; with no labels at all it is 0.
    """
    rows = only(docs, id=id_col, text=text_col)
    known = labels.select(F.col(id_col).alias("id"), *categories)
    found = sampled(rows, known, categories, sample, sample_bytes)
    texts = found.column("text").combine_chunks().cast(pa.string())
    given = {c: found.column(c).to_numpy().astype(float) for c in categories}
    chain = fit_chain(texts, given) if len(texts) else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                p = predict_chain(chain, part.column("text"))
                p = p if chain else np.zeros((part.num_rows, len(categories)))
                columns = [part.column("id")]
                for k, category in enumerate(categories):
                    least = chain[k].threshold if chain else 1.0
                    columns += [pa.array(np.round(p[:, k], 6)), pa.array(p[:, k] > least)]
                yield pa.record_batch(columns, names)

    names = ["doc_id", *[f"{kind}_{c}" for c in categories for kind in ("p", "is")]]
    schema = f"doc_id {dict(rows.dtypes)['id']}, " + ", ".join(
        f"p_{c} double, is_{c} boolean" for c in categories
    )
    return rows.mapInArrow(score, schema)
