"""Value bands: right-closed, with the lowest edge left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfscope.schemas import PRICE_EDGES, PRICE_LABELS, TENURE_EDGES, TENURE_LABELS


def band(value: Column, upper_edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first upper edge that is not exceeded; the last label is open-ended."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(upper_edges, labels):
        chain = chain.when(value <= F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def tenure_band(
    months: Column, lowest: Column, highest: Column, labels: Sequence[str] = TENURE_LABELS
) -> Column:
    """Band of a tenure in months between two observed edges.

    Values outside ``(lowest, highest]`` have no band, so neither has the lowest value itself.
    """
    inside = (months > lowest) & (months <= highest)
    return F.when(inside, band(months, TENURE_EDGES, labels))


def price_band(price: Column) -> Column:
    return F.coalesce(band(price, PRICE_EDGES, PRICE_LABELS), F.lit(PRICE_LABELS[0]))
