"""Quality rules from built-in expressions: base counts, and divergence from a language's usual mix.

A document's characters fall into classes and its words into the common words of its language and
others. Both histograms are compared with the language's reference, which is the sum over all
its documents that pass the base rules, by Jensen-Shannon distance (base 2, so 0 to 1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.shared import kept, only

# White space between words, and character classes that are rare in plain prose.
SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
CLASSES = [r"\p{Lu}", r"\p{Nd}", SYMBOLS, r"[.,:;!?'\"()\[\]{}/_=+@~-]"]

# The dozen most frequent short words of some languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit auf für ist".split(),
    "en": "the of and to a in is that it for on was".split(),
    "es": "de la que el en y a los se del las un".split(),
    "fr": "de la le et les des en un du une que est".split(),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def matching(text: Column, characters: str) -> Column:
    """Number of characters of a class; runs of them go at once."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters + "+", ""))).cast("long")


def windows(w: Column, size: int) -> Column:
    """A hash of every run of ``size`` words, empty if there are fewer."""
    at = F.sequence(F.lit(1), F.size(w) - (size - 1))
    runs = F.transform(at, lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered_twice(hashes: Column, size: int) -> Column:
    """Words within windows whose hash occurs again."""
    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k)["x"] == x["x"], F.lit(False))

        return F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1))

    at = F.sort_array(F.transform(let(ordered, repeated), lambda x: x["i"]))
    zero = F.struct(F.lit(-size).alias("last"), F.lit(0).cast("long").alias("n"))
    summed = F.aggregate(
        at,
        zero,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(size), i - a["last"])).alias("n")),
    )["n"]
    # Most texts repeat no window, and finding that out needs no sorting.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(summed)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^" + SPACE[1:]))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def profile(
    docs: DataFrame,
    common: Mapping[str, Sequence[str]],
    window: int,
    id_col: str,
    text_col: str,
    lang_col: str,
) -> DataFrame:
    """Per row: base counts, counts of character classes, and of common words and others."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("h", windows(F.col("w"), window))
    text, w = F.col("text"), F.col("w")
    counted = [matching(text, c) for c in CLASSES]
    listed = F.create_map(*[x for k in sorted(common) for x in (F.lit(k), F.array(*map(F.lit, common[k])))])
    any_common = sorted({word for k in common for word in common[k]})
    own = F.coalesce(listed[F.col("lang")], F.array().cast("array<string>"))
    seen = F.filter(w, lambda x: x.isin(any_common))
    found = F.struct(seen.alias("seen"), own.alias("own"))
    counts = let(
        found,
        lambda f: F.transform(f["own"], lambda k: F.size(F.filter(f["seen"], lambda x: x == k)).cast("long")),
    )
    return rows.select(
        "doc_id",
        "lang",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        matching(text, SYMBOLS).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        covered_twice(F.col("h"), window).alias("n_repeat_words"),
        F.array(*counted).alias("classes"),
        counts.alias("commons"),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def with_rest(values: Column, of: Column) -> Column:
    """Counts, with what is left of ``of`` as the last."""
    return F.concat(values, F.array(of - total(values)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of counts; null if either adds up to zero."""

    def shares(x: Column) -> Column:
        n = total(x)
        return F.transform(x, lambda v: v / n)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def half(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return (term(a, m) + term(b, m)) / 2

    apart = F.aggregate(F.zip_with(shares(p), shares(q), half), F.lit(0.0), lambda a, x: a + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(apart, F.lit(0.0))))


def judge(
    docs: DataFrame,
    common: Mapping[str, Sequence[str]] = COMMON_WORDS,
    max_class_distance: float = 0.22,
    class_slack: float = 2.0,
    max_word_distance: float = 0.2,
    word_slack: float = 0.7,
    least_chars: int = 100,
    least_words: int = 60,
    least_base_words: int = 20,
    max_repeat_percent: int = 30,
    window: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance (both rounded to 4 places).

    The distance of a sample shrinks with its length, so a limit is ``max_*_distance`` and a slack
    divided by the square root of the number of characters or words.
    A text shorter than ``least_chars`` or ``least_words`` is not judged by the histogram of that
    kind; one in a language that ``common`` has no words of by its characters alone; and one without a
    language, or whose language has no document that passes the base rules, by neither. A distance
    that is not judged is null, and without any only the base rules count.
    A null or empty text has no words and fails them. Every row gives one row, ids as they are.
    """
    counted = kept(profile(docs, common, window, id_col, text_col, lang_col), "profiles")
    failed = (F.col("n_words") < least_base_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    counted = counted.withColumns(
        {
            "base_failed": failed,
            "classes": with_rest(F.col("classes"), F.col("word_chars")),
            "commons": with_rest(F.col("commons"), F.col("n_words")),
        }
    )
    longest = max([len(v) for v in common.values()], default=0) + 1

    def sums(column: str, n: int) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)) for i in range(n)])

    # Every language has a reference of its own. Their number is not bounded, so the join has no hint.
    usual = (
        counted.where("NOT base_failed AND lang IS NOT NULL")
        .groupBy("lang")
        .agg(
            sums("classes", len(CLASSES) + 1).alias("usual_classes"),
            sums("commons", longest).alias("usual_commons"),
        )
    )
    near = counted.join(usual, "lang", "left").withColumn(
        "usual_commons", F.slice("usual_commons", 1, F.size("commons"))
    )
    by_class = F.when(F.col("word_chars") >= least_chars, distance(F.col("classes"), F.col("usual_classes")))
    has_words = (F.col("n_words") >= least_words) & F.col("lang").isin(sorted(common))
    by_word = F.when(has_words, distance(F.col("commons"), F.col("usual_commons")))
    near = near.withColumns({"by_class": by_class, "by_word": by_word})
    class_limit = max_class_distance + class_slack / F.sqrt("word_chars")
    word_limit = max_word_distance + word_slack / F.sqrt("n_words")
    far = F.coalesce(F.col("by_class") > class_limit, F.lit(False)) | F.coalesce(
        F.col("by_word") > word_limit, F.lit(False)
    )
    return near.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"),
        F.round("by_class", 4).alias("class_distance"),
        F.round("by_word", 4).alias("word_distance"),
    )
