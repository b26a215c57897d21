"""Line deduplication by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its ``leading`` first tokens,
where a token with a digit counts as a variable field. In a leaf, a token stays part of the
template if enough documents have it at that place, and else becomes a variable field too. A
template that recurs in ``min_docs`` documents is dropped wherever it stands, whatever its share of
a document. Exact copies (of all words) count as one document, so that they alone make no line recur; a
caller who has classes of near copies may hand them in, and then each class counts as one.

Only counts are gathered: of documents for each leaf and each form of a line (its tokens with the
variable fields), then of tokens by place for leaves that recur. No leaf is ever held together. Texts go
by a hash, as equal texts lose the same lines: rows need no id of a certain type, and two texts of one
hash would only be asked for each other's lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.shared import chunks, kept, release_idle
from shelfscope.llm.words import M1, M3, hashes, mix, spans

FIELD = np.uint64(0xF1E1D)  # stands for a variable field
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


class Lines:
    """Lines with a token of a batch's texts: row, place of its bytes, leaf and form."""

    def __init__(self, texts: pa.Array, leading: int):
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]]
        borders = at - at[0]
        breaks = np.flatnonzero(data == 10)
        # A line starts at a row's start and after each line feed, and ends at the next of these.
        starts = np.unique(np.concatenate([borders[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        self.row_of_all = np.searchsorted(borders, starts, "right") - 1
        token_starts, token_ends = spans(data, borders)
        first = np.searchsorted(token_starts, np.append(starts, len(data)))
        self.has = np.diff(first) > 0
        self.rows = len(texts)
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        tokens = hashes(data, token_starts, token_ends)
        self.words, self.first_word = tokens.copy(), np.searchsorted(token_starts, borders)
        tokens[digits[token_ends] > digits[token_starts]] = FIELD
        self.tokens, self.first, self.counts = tokens, first[:-1], np.diff(first)
        size = self.counts.astype(np.uint64)
        self.leaf, self.form = mix(size * M1), mix(size * M3)
        live = np.flatnonzero(self.has)
        step = 0
        while len(live):
            token = tokens[self.first[live] + step]
            self.form[live] = mix((self.form[live] ^ token) * M1 + np.uint64(step))
            if step < leading:
                self.leaf[live] = mix((self.leaf[live] ^ token) * M3)
            step += 1
            live = live[self.counts[live] > step]
        self.row = self.row_of_all

    def copies(self) -> pa.Array:
        """A hash of all words of each row."""
        ends = zip(self.first_word, self.first_word[1:])
        found = [xxhash.xxh3_64_intdigest(self.words[a:b].tobytes()) for a, b in ends]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    def lists(self, values: np.ndarray, of: np.ndarray) -> pa.Array:
        """A list per row of the values of the lines ``of``."""
        ends = np.searchsorted(self.row[of], np.arange(self.rows + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def parts(batches: Iterator[pa.RecordBatch], leading: int) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    release_idle()
    for batch in batches:
        for part in chunks(batch, "text"):
            yield part, Lines(part.column("text"), leading)


def documents_of(lines: DataFrame, *keys: str) -> DataFrame:
    """Number of classes of documents, and the least text, of each key."""
    classes = lines.groupBy(*keys, "class").agg(F.min("key").alias("first"))
    return classes.groupBy(*keys).agg(F.count("*").alias("n"), F.min("first").alias("first"))


def templates(
    texts: DataFrame, leading: int, min_docs: int, least_tokens: int, constant: float, classes: DataFrame | None
) -> DataFrame:
    """The forms of lines that recur, by text: (key, forms). ``texts`` has key and text."""

    def marks(batches):
        for part, lines in parts(batches, leading):
            of = np.flatnonzero(lines.has)
            yield pa.record_batch(
                [
                    part.column("key"),
                    lines.copies(),
                    lines.lists(lines.leaf[of].view(np.int64), of),
                    lines.lists(lines.form[of].view(np.int64), of),
                ],
                ["key", "class", "leaves", "forms"],
            )

    schema = "key long, class long, leaves array<long>, forms array<long>"
    marked = kept(texts.mapInArrow(marks, schema), "lines")
    lines = marked.select("key", "class", F.explode(F.arrays_zip("leaves", "forms")).alias("x")).select(
        "key", "class", F.col("x.leaves").alias("leaf"), F.col("x.forms").alias("form")
    )
    leaves = kept(documents_of(lines, "leaf").where(F.col("n") >= min_docs).select("leaf"), "leaves")
    inside = lines.join(leaves, "leaf")
    if classes is not None:
        inside = inside.drop("class").join(classes, "key")
    inside = kept(inside, "inside")
    # Each form with its classes.
    forms = kept(documents_of(inside, "leaf", "form"), "forms")
    wanted = kept(forms.groupBy(F.col("first").alias("key")).agg(F.collect_set("form").alias("wanted")), "wanted")

    def fetch(batches):
        for part, lines in parts(batches, leading):
            owner = np.repeat(np.arange(part.num_rows), part.column("wanted").value_lengths().to_numpy())
            asked = part.column("wanted").flatten().to_numpy().view(np.uint64)
            salt = mix(owner.astype(np.uint64))
            hit = lines.has & np.isin(lines.form ^ mix(lines.row.astype(np.uint64)), asked ^ salt)
            of = np.flatnonzero(hit)
            counts = lines.counts[of]
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = np.repeat(lines.first[of] - ends[:-1], counts) + np.arange(ends[-1])
            tokens = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(lines.tokens[at].view(np.int64))
            )
            yield pa.record_batch([pa.array(lines.form[of].view(np.int64)), tokens], ["form", "tokens"])

    # Sorted on both sides, at any size: the plan and its cost for each row stay the same.
    fetched = texts.join(wanted.hint("merge"), "key").mapInArrow(fetch, "form long, tokens array<long>")
    fetched = fetched.dropDuplicates(["form"]).join(forms, "form")
    placed = kept(
        fetched.where(F.size("tokens") >= least_tokens).select(
            "leaf", "form", "n", F.posexplode("tokens").alias("place", "token")
        ),
        "places",
    )
    fixed = placed.groupBy("leaf", "place", "token").agg(F.sum("n").alias("docs"))
    fixed = kept(fixed.where(F.col("docs") >= min_docs).select("leaf", "place", "token"), "constants")
    marked_fixed = fixed.withColumn("stays", F.lit(1))
    is_field = F.col("token") == int(FIELD)
    generalised = (
        placed.join(marked_fixed, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "form")
        .agg(
            F.sort_array(
                F.collect_list(F.when(F.col("stays").isNotNull() & ~is_field, F.struct("place", "token")))
            ).alias("stays"),
            F.count("*").alias("tokens"),
        )
        .where(F.size("stays") >= constant * F.col("tokens"))
        .select("form", F.xxhash64("leaf", "stays").alias("template"))
    )
    # Short lines and those of few constants are templates of their own.
    named = forms.join(generalised, "form", "left").select(
        "form", F.coalesce("template", "form").alias("template")
    )
    named = kept(named, "templates")
    by_template = documents_of(inside.select("key", "class", "form").join(named, "form"), "template")
    dropped = kept(
        named.join(by_template.where(F.col("n") >= min_docs).select("template"), "template").select("form"),
        "dropped",
    )
    found = lines.select("key", "form").join(dropped, "form").groupBy("key")
    return kept(found.agg(F.collect_set("form").alias("forms")), "found")


def drop_lines(
    docs: DataFrame,
    leading: int = 3,
    min_docs: int = 4,
    least_tokens: int = 4,
    constant: float = 0.6,
    classes: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows with their columns, the text without the dropped lines, and two columns more:
    n_lines (those with a token) and n_dropped, which replace columns of these names.

    A line of fewer than ``least_tokens`` tokens, or whose template would keep less than the share
    ``constant`` of them, recurs only as it is (but for its fields with digits). Lines end at
    line feeds; those without a token stay. A document counts once for a line however often it has
    it, and so do all documents of equal words, repeated rows among them. Recurring lines go from every
    document that has them, so a document of nothing else becomes empty. ``classes`` (doc_id, class_id), as
    ``near_duplicates`` gives them, makes all documents of a class count once; near copies that it
    does not join count each, and lose the lines that enough of them share. A document without a class
    counts for none. Ids may be of any type, null or repeated: without ``classes`` they play no part. A null
    text stays null. Tables are written when this is called.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    rest = F.struct(F.lit(0).alias("_"), *[docs[c] for c in others])
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), rest.alias("rest"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    if classes is not None:
        named = classes.select(F.col("doc_id").alias("id"), F.xxhash64("class_id").alias("class"))
        by_text = rows.select("id", "key").join(named, "id").groupBy("key").agg(F.min("class").alias("class"))
        classes = kept(by_text, "classes")
    texts = rows.where("text IS NOT NULL").select("key", "text")
    found = templates(texts, leading, min_docs, least_tokens, constant, classes)

    def cut(batches):
        for part, lines in parts(batches, leading):
            asked = part.column("forms")
            sizes = asked.value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(np.arange(part.num_rows), sizes)
            listed = asked.flatten().to_numpy().view(np.uint64) ^ mix(owner.astype(np.uint64))
            drop = lines.has & np.isin(lines.form ^ mix(lines.row.astype(np.uint64)), listed)
            n_lines = np.bincount(lines.row, lines.has, part.num_rows).astype(np.int64)
            n_dropped = np.bincount(lines.row, drop, part.num_rows).astype(np.int64)
            texts = part.column("text").to_pylist()
            first = np.searchsorted(lines.row, np.arange(part.num_rows))
            for row in np.flatnonzero(n_dropped):
                # A text's last line may be the empty one after its last line feed.
                keep = np.ones(texts[row].count("\n") + 1, bool)
                own = drop[first[row] : first[row + 1] if row + 1 < part.num_rows else None]
                keep[: len(own)] = ~own
                pieces = texts[row].split("\n")
                texts[row] = "\n".join([p for p, k in zip(pieces, keep, strict=True) if k])
            yield pa.record_batch(
                [
                    *[part.column("id"), pa.array(texts, pa.string()), part.column("rest")],
                    *[pa.array(n_lines), pa.array(n_dropped)],
                ],
                ["id", "text", "rest", "n_lines", "n_dropped"],
            )

    counts = T.StructType().add("n_lines", "long").add("n_dropped", "long")
    schema = T.StructType([*rows.drop("key").schema.fields, *counts.fields])
    joined = rows.join(found.hint("merge"), "key", "left")
    cleaned = joined.select("id", "text", "rest", "forms").mapInArrow(cut, schema)
    own = {id_col: F.col("id"), text_col: F.col("text")}
    columns = [own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns if c not in counts.names]
    return cleaned.select(*columns, *counts.names)
