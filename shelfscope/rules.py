"""Thresholds and analysis dates, all of them parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """What a run of the market tables may vary.

    An account above ``max_revenue`` or ``max_transactions`` is an outlier; one with at most
    ``low_limit`` transactions is a low user. ``months`` and ``categories`` get a column each in the
    spread tables; None takes all that the data has, a given list leaves the others out. The
    zoom limits only place the bins of the closer histograms.
    """

    max_revenue: float = 10000
    max_transactions: int = 1000
    low_limit: int = 101
    retention: float = 0.6
    z: float = 1.96
    spike_day: dt.date = dt.date(2016, 7, 4)
    last_week: dt.date = dt.date(2016, 9, 12)
    short_week: dt.date = dt.date(2016, 8, 22)
    months: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    zoom_revenue: float = 2000
    zoom_transactions: int = 400
    not_subscription: tuple[str, ...] = ("Games", "Social Networking")
