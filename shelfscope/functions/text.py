"""Name cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut from an app name, and the runs that make up a word.
NAME_NOISE = r"(?U)^\s+|;|-|,|:|\)|\("
OUTER_SPACE = r"(?U)^\s+|\s+$"
WORD_RUNS = (
    r"([\p{IsUppercase}\p{IsLowercase}\p{Lt}]+|[^\p{IsUppercase}\p{IsLowercase}\p{Lt}]+)"
)


def strip_noise(name: Column) -> Column:
    """Name without leading space, punctuation marks and outer space."""
    return F.regexp_replace(F.regexp_replace(name, NAME_NOISE, ""), OUTER_SPACE, "")


def title_words(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others.

    ``initcap`` starts words at spaces only; here ``3d`` becomes ``3D`` and ``it's`` ``It'S``.
    """
    runs = F.regexp_extract_all(text, F.lit(WORD_RUNS), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(
                F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2)))
            ),
        ),
        "",
    )


def clean_app_name(name: Column) -> Column:
    return title_words(strip_noise(name))


def column_name(label: str) -> str:
    """A label as the name of a column: lower case, with one underscore for all that is odd."""
    return re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")
