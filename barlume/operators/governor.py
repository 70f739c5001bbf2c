"""Which trades an R budget lets in.

The budget of a day and of a month is told by a few figures of what happened in them: the sum of R, its lowest and
highest, and counts. A period is over budget for good once its sum has touched a limit, so the extremes say that, and a
decision is a pure function of the figures. Refused trades do not happen, which feeds back into the
figures: a sequential fold per symbol over entries and exits.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal as D
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from barlume.schema import DAY_NS


class Limits(NamedTuple):
    """Fixed values of the rule set."""

    positions: int = 5
    targets: int = 2
    day_loss: D = D(-4)
    month_loss: D = D(-8)
    month_gain: D = D(8)
    early_gain: D = D(6)
    early_days: int = 14
    rest_below: D = D(-7)


@dataclass
class Figures:
    """Of one day or month."""

    r: D = D(0)
    lowest: D = D(0)
    highest: D = D(0)
    opened: int = 0
    targets: int = 0
    low_on: int = 0  # day of the last exit that left the sum at ``rest_below`` or less

    def add(self, r: D, target: bool) -> None:
        self.r += r
        self.lowest, self.highest = min(self.lowest, self.r), max(self.highest, self.r)
        self.targets += target


def decide(day: Figures, month: Figures, date: int, limits: Limits = Limits()) -> tuple[bool, bool, str]:
    """(allowed, cover leg allowed, reason) for an entry on the day of month ``date``. Reasons are fixed values."""
    refusals = {
        "daily_halt": day.lowest <= limits.day_loss or day.targets >= limits.targets or day.opened >= limits.positions,
        "monthly_halt": month.lowest <= limits.month_loss or month.highest >= limits.month_gain,
        "monthly_minus_seven_day_pause": month.low_on == date,
        "monthly_plus_six_pause": date <= limits.early_days and month.r >= limits.early_gain,
    }
    # a cover leg may lose one R more, and must leave both budgets open after the first
    left_day, left_month = day.r - limits.day_loss, month.r - limits.month_loss
    cover = limits.positions - day.opened >= 2 and min(left_day, left_month) >= 2 and month.r - 1 > limits.rest_below
    refusals |= {"daily_risk_reservation": left_day < 1 + cover, "monthly_risk_reservation": left_month < 1 + cover}
    for reason, holds in refusals.items():
        if holds:
            return False, False, reason
    return True, cover, "allowed"


class Governor:
    """The figures of one account, by day and month."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits
        self.days: dict[tuple[int, int, int], Figures] = defaultdict(Figures)
        self.months: dict[tuple[int, int], Figures] = defaultdict(Figures)

    def ask(self, date: tuple[int, int, int]) -> tuple[bool, bool, str]:
        return decide(self.days[date], self.months[date[:2]], date[2], self.limits)

    def opened(self, date: tuple[int, int, int]) -> None:
        self.days[date].opened += 1

    def closed(self, date: tuple[int, int, int], r: D, leg: int, target: bool) -> None:
        day, month = self.days[date], self.months[date[:2]]
        for figures in (day, month):
            figures.add(r, leg == 1 and target)
        if month.r <= self.limits.rest_below:
            month.low_on = date[2]
        for held, last in ((self.days, date), (self.months, date[:2])):  # what is over is not asked for again
            for key in [k for k in held if k < last]:
                del held[key]


def _date(ns: int) -> tuple[int, int, int]:
    t = pd.Timestamp(ns // DAY_NS * DAY_NS)
    return t.year, t.month, t.day


def governed(trades: DataFrame) -> DataFrame:
    """(symbol, trade_id, allowed, cover_enabled, reason) of trades (symbol, trade_id, entry_time_ns, exit_time_ns, r, leg,
    exit_reason)."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, governor, pending = None, Governor(), []
        for df in rows:
            out = []
            for x in df.itertuples(index=False):
                if x.symbol != symbol:
                    symbol, governor, pending = x.symbol, Governor(), []
                while pending and pending[0][0] <= x.entry_time_ns:
                    at, _, r, leg, hit = heapq.heappop(pending)
                    governor.closed(_date(at), r, leg, hit)
                today = _date(x.entry_time_ns)
                allowed, cover, reason = governor.ask(today)
                if allowed:
                    governor.opened(today)
                    heapq.heappush(pending, (x.exit_time_ns, x.trade_id, D(str(x.r)), x.leg, x.exit_reason == "take_profit"))
                out.append((x.symbol, x.trade_id, allowed, cover, reason))
            yield pd.DataFrame(out, columns=["symbol", "trade_id", "allowed", "cover_enabled", "reason"])

    columns = ["symbol", "trade_id", "entry_time_ns", "exit_time_ns", "r", "leg", "exit_reason"]
    dealt = trades.select(*columns).repartition("symbol").sortWithinPartitions("symbol", "entry_time_ns", "trade_id")
    return dealt.mapInPandas(run, "symbol string, trade_id long, allowed boolean, cover_enabled boolean, reason string")
