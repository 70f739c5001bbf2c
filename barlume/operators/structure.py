"""Signals at hunted structure levels, as joins and running values over bars.

A level forms where the color turns (``bars.structure_levels``). A bar may hunt the last ``age`` levels of each kind that
formed before it: it must reach strictly beyond the level's wick and beyond every bar in between, none of which
may have closed beyond the bodies of the pair that formed the level. So each bar meets at most ``age`` numbered levels of a
kind by equality, and what lies between is a running maximum over the bars that meet the same level. Lows are
highs of the negated prices, so both kinds are one computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlume.operators.bars import segment
from barlume.operators.joins import running
from barlume.sources.shared import written

AGE = 3
LEAST_PARTS = 7


def _turns(bars: DataFrame) -> DataFrame:
    """``bars`` with the bar before (p_open, p_high, p_low, p_close), whether they form a high or a low, and how many of each
    formed before (n_high, n_low)."""
    known = ("open", "high", "low", "close")
    lag = {f"p_{c}": ("lag", F.col(f"{c}_ticks")) for c in known}
    out = running(bars, ["symbol"], ["close_time_ns"], segment("close_time_ns"), lag)
    up, was_up = F.signum(F.col("close_ticks") - F.col("open_ticks")), F.signum(F.col("p_close") - F.col("p_open"))
    out = out.withColumns({"forms_high": F.coalesce((was_up > 0) & (up < 0), F.lit(False)), "forms_low": F.coalesce((was_up < 0) & (up > 0), F.lit(False))})
    counts = {f"n_{k}": ("sum", F.col(f"forms_{k}").cast("int")) for k in ("high", "low")}
    out = running(out, ["symbol"], ["close_time_ns"], segment("close_time_ns"), counts)
    return out.withColumns({f"n_{k}": F.col(f"n_{k}") - F.col(f"forms_{k}").cast("int") for k in ("high", "low")})


def _signed(kind: str, high: str, low: str) -> Column:
    """The price that reaches in the kind's direction, so that further is greater."""
    return F.col(high) if kind == "high" else -F.col(low)


def _levels(turns: DataFrame, kind: str) -> DataFrame:
    """(symbol, kind, number, formed_ns, wick, body), numbered from 0 per symbol."""
    body = [_signed(kind, c, c) for c in ("p_open", "p_close", "open_ticks", "close_ticks")]
    return turns.where(f"forms_{kind}").select(
        "symbol", F.lit(kind).alias("kind"), F.col(f"n_{kind}").alias("number"), F.col("close_time_ns").alias("formed_ns"),
        F.greatest(_signed(kind, "high_ticks", "low_ticks"), _signed(kind, "p_high", "p_low")).alias("wick"), F.greatest(*body).alias("body"),
    )


def hunts(turns: DataFrame, age: int = AGE) -> DataFrame:
    """(symbol, close_time_ns, kind, hunted_ticks, hunted_ns): the newest level that each bar hunts, if any."""
    asks, levels = None, None
    for kind in ("high", "low"):
        numbers = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col(f"n_{kind}") - age), F.col(f"n_{kind}") - 1)
        some = turns.where(F.col(f"n_{kind}") > 0).select(
            "symbol", "close_time_ns", F.lit(kind).alias("kind"), F.explode(numbers).alias("number"),
            _signed(kind, "high_ticks", "low_ticks").alias("reach"), _signed(kind, "close_ticks", "close_ticks").alias("close"),
        )
        asks = some if asks is None else asks.unionByName(some)
        levels = _levels(turns, kind) if levels is None else levels.unionByName(_levels(turns, kind))
    between = {"furthest": ("max_before", F.col("reach")), "closed": ("max_before", F.col("close"))}
    met = running(asks, ["symbol", "kind", "number"], ["close_time_ns"], segment("close_time_ns"), between).join(levels, ["symbol", "kind", "number"])
    hunted = (F.col("reach") > F.greatest("wick", "furthest")) & F.coalesce(F.col("closed") <= F.col("body"), F.lit(True))
    found = met.where(hunted).groupBy("symbol", "close_time_ns", "kind").agg(F.max_by(F.struct("wick", "formed_ns"), "number").alias("x"))
    wick = F.when(F.col("kind") == "high", F.col("x.wick")).otherwise(-F.col("x.wick"))
    return found.select("symbol", "close_time_ns", "kind", wick.alias("hunted_ticks"), F.col("x.formed_ns").alias("hunted_ns"))


def structure_signals(bars: DataFrame, age: int = AGE, least_parts: int = LEAST_PARTS) -> DataFrame:
    """Signals of bars (symbol, close_time_ns, OHLC, delta, parts, session_high, session_low).

    A reversal needs a one-sided shadow and a hunted level, an engulfing bar a break of the session's extreme and of the
    body before; both need the volume delta against the move, from ``least_parts`` parts or more. A bar with a setup on
    both sides gives none."""
    # both are read several times: written once
    columns = ["symbol", "close_time_ns", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "delta", "parts", "session_high", "session_low"]
    turns = written(_turns(written(bars.select(*columns), "signal-bars")), "signal-turns")
    known = hunts(turns, age).groupBy("symbol", "close_time_ns").pivot("kind", ["high", "low"]).agg(F.first("hunted_ticks"))
    at = turns.join(known.withColumnsRenamed({"high": "hunted_high", "low": "hunted_low"}), ["symbol", "close_time_ns"], "left")
    o, h, low, c = (F.col(f"{x}_ticks") for x in ("open", "high", "low", "close"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    body, upper, lower = top - bottom, h - top, bottom - low

    def side(kind: str, near: Column, far: Column, against: Column, engulfs: Column) -> tuple[Column, Column]:
        agrees = (F.col("parts") >= least_parts) & against
        shadow = (near > body) & (near > far) & (far < 7 * body)
        yes = lambda x: F.coalesce(x, F.lit(False))
        return yes(agrees & shadow & F.col(f"hunted_{kind}").isNotNull()), yes(agrees & engulfs)

    long = side("low", lower, upper, F.col("delta") < 0, (F.col("p_close") < F.col("p_open")) & (c > o) & (low < F.least("session_low", F.least("p_open", "p_close"))) & F.col("session_low").isNotNull())
    short = side("high", upper, lower, F.col("delta") > 0, (F.col("p_close") > F.col("p_open")) & (c < o) & (h > F.greatest("session_high", F.greatest("p_open", "p_close"))) & F.col("session_high").isNotNull())
    at = at.withColumns({"__long": long[0] | long[1], "__short": short[0] | short[1]}).where("__long <> __short")
    pick = lambda a, b: F.when(F.col("__long"), a).otherwise(b)
    reversal, engulfing = pick(long[0], short[0]), pick(long[1], short[1])
    return at.select(
        "symbol",
        "close_time_ns",
        pick(F.lit("LONG"), F.lit("SHORT")).alias("direction"),
        F.when(reversal & engulfing, "LS_ENGULF").when(reversal, "LS").otherwise("ENGULF").alias("setup"),
        pick(low, h).alias("stop_ticks"),
        pick(top, bottom).alias("cover_stop_ticks"),
        F.when(reversal, pick(F.col("hunted_low"), F.col("hunted_high"))).alias("hunted_ticks"),
    )
