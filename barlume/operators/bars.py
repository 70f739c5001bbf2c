"""Time-series access over bars: scans, as-of, last rows, merges, resampling, forming bars, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlume.operators.joins import asof_join, last_n, latest_by, running, sliding
from barlume.schema import DAY_NS, NS, TIMEFRAMES

#: As-of joins cut a symbol's time into stretches of this length, so no symbol is one task.
SEGMENT_NS = 30 * DAY_NS
OHLC = ["open_ticks", "high_ticks", "low_ticks", "close_ticks"]


def segment(time: str) -> Column:
    return F.floor(F.col(time) / SEGMENT_NS)


def resample(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Ticks (symbol, tick_id, time_ns, price_ticks, volume) to closed bars of a fixed-length timeframe."""
    n = TIMEFRAMES[timeframe] * NS
    start, at = F.col("time_ns") - F.pmod("time_ns", F.lit(n)), F.struct("time_ns", "tick_id")
    made = ticks.groupBy("symbol", start.alias("open_time_ns")).agg(
        F.min_by("price_ticks", at).alias("open_ticks"),
        F.max("price_ticks").alias("high_ticks"),
        F.min("price_ticks").alias("low_ticks"),
        F.max_by("price_ticks", at).alias("close_ticks"),
        F.count("*").alias("tick_volume"),
        F.sum("volume").alias("real_volume"),
        (F.max_by("volume", at) % 10).cast("int").alias("source_spread_points"),
    )
    made = made.withColumns({"timeframe": F.lit(timeframe), "close_time_ns": F.col("open_time_ns") + n})
    return sequenced(made).select("symbol", "timeframe", "open_time_ns", "close_time_ns", *OHLC, "tick_volume", "real_volume", "source_spread_points", "sequence")


def sequenced(bars: DataFrame) -> DataFrame:
    """``sequence`` from 0 per symbol in time order; a symbol is as many tasks as it has stretches of time."""
    counted = running(bars, ["symbol", "timeframe"], ["open_time_ns"], segment("open_time_ns"), {"sequence": ("count", F.lit(1))})
    return counted.withColumn("sequence", F.col("sequence") - 1)


def rollup(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars to bars of a longer fixed-length timeframe."""
    n = TIMEFRAMES[timeframe] * NS
    start, at = F.col("open_time_ns") - F.pmod("open_time_ns", F.lit(n)), F.col("open_time_ns")
    return bars.groupBy("symbol", start.alias("open_time_ns")).agg(*_ohlcv(at)).withColumns({"timeframe": F.lit(timeframe), "close_time_ns": F.col("open_time_ns") + n})


def _ohlcv(at: Column) -> list[Column]:
    return [
        F.min_by("open_ticks", at).alias("open_ticks"),
        F.max("high_ticks").alias("high_ticks"),
        F.min("low_ticks").alias("low_ticks"),
        F.max_by("close_ticks", at).alias("close_ticks"),
        F.sum("tick_volume").alias("tick_volume"),
        F.sum("real_volume").alias("real_volume"),
        F.max_by("source_spread_points", at).alias("source_spread_points"),
    ]


# --- scans -------------------------------------------------------------------------------------------------


def scan(bars: DataFrame, symbol: str | None = None, start_ns: int | None = None, end_ns: int | None = None, on: str = "open_time_ns", complete_only: bool = False) -> DataFrame:
    """start <= time < end on the open (range scans) or close time (batches); all filters reach the reader."""
    out = bars
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol)
    if start_ns is not None:
        out = out.where(F.col(on) >= start_ns)
    if end_ns is not None:
        out = out.where(F.col(on) < end_ns)
    return out.where("is_complete") if complete_only else out


def load(bars: DataFrame, limit: int, **where) -> DataFrame:
    return scan(bars, **where).orderBy("open_time_ns").limit(limit)


def available(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "timeframe").distinct()


def latest_closed(bars: DataFrame, at_ns: int) -> DataFrame:
    """Per series the last bar closed at or before ``at_ns``."""
    return latest_by(bars.where(F.col("close_time_ns") <= at_ns), ["symbol", "timeframe"], ["close_time_ns"])


def window(bars: DataFrame, at_ns: int, n: int) -> DataFrame:
    return last_n(bars.where(F.col("close_time_ns") <= at_ns), ["symbol", "timeframe"], ["close_time_ns"], n)


def with_latest_closed(points: DataFrame, bars: DataFrame, columns: list[str], time: str = "time_ns") -> DataFrame:
    """Every point with the bar of its symbol that closed last at or before it."""
    return asof_join(points, bars, ["symbol"], time, "close_time_ns", columns, segment_ns=SEGMENT_NS)


def close_batches(*series: DataFrame) -> DataFrame:
    """(close_time_ns, bars): the bars that close together, by symbol, timeframe name and open time."""
    both = series[0]
    for s in series[1:]:
        both = both.unionByName(s)
    one = F.struct("symbol", "timeframe", "open_time_ns", *OHLC)
    return both.groupBy("close_time_ns").agg(F.array_sort(F.collect_list(one)).alias("bars"))


# --- forming bars and boundaries --------------------------------------------------------------------------


def boundaries(base: DataFrame, targets: DataFrame) -> DataFrame:
    """Base bars with the interval of the target bar that holds them whole (boundary_open_ns, boundary_close_ns)."""
    spans = targets.select("symbol", F.col("open_time_ns").alias("boundary_open_ns"), F.col("close_time_ns").alias("boundary_close_ns"))
    got = asof_join(base, spans, ["symbol"], "open_time_ns", "boundary_open_ns", ["boundary_open_ns", "boundary_close_ns"], segment_ns=SEGMENT_NS)
    return got.where(F.col("close_time_ns") <= F.col("boundary_close_ns"))


def forming(base: DataFrame, targets: DataFrame) -> DataFrame:
    """The unfinished target bar as each base bar closes: open < observed < close."""
    w = Window.partitionBy("symbol", "boundary_open_ns").orderBy("open_time_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = boundaries(base, targets)
    out = held.select(
        "symbol",
        "boundary_open_ns",
        "boundary_close_ns",
        F.col("close_time_ns").alias("observed_time_ns"),
        F.first("open_ticks").over(w).alias("open_ticks"),
        F.max("high_ticks").over(w).alias("high_ticks"),
        F.min("low_ticks").over(w).alias("low_ticks"),
        "close_ticks",
        F.sum("tick_volume").over(w).alias("tick_volume"),
    )
    return out.where(F.col("observed_time_ns") < F.col("boundary_close_ns"))


def forming_at(base: DataFrame, timeframe: str, at_ns: int) -> DataFrame:
    """One aggregate per symbol of the base bars since the target's open that closed by ``at_ns``."""
    n = TIMEFRAMES[timeframe] * NS
    start = at_ns - at_ns % n
    part = base.where((F.col("open_time_ns") >= start) & (F.col("close_time_ns") <= min(at_ns, start + n)))
    return part.groupBy("symbol").agg(*_ohlcv(F.col("open_time_ns")), F.max("close_time_ns").alias("observed_time_ns"))


# --- views and indicators -----------------------------------------------------------------------------------


SERIES = ["symbol", "timeframe"]


def history(bars: DataFrame, n: int) -> DataFrame:
    """Every bar with the closes of the last ``n`` bars, itself included, and their count."""
    values = {
        "closes": lambda w: F.collect_list("close_ticks").over(w.rowsBetween(-(n - 1), 0)),
        "known": lambda w: F.count("*").over(w.rowsBetween(-(n - 1), 0)),
    }
    return sliding(bars, SERIES, ["open_time_ns"], segment("open_time_ns"), n, values).drop("__i")


def conflicts(bars: DataFrame) -> DataFrame:
    """Series and close times that hold bars of different values."""
    return bars.groupBy("symbol", "timeframe", "close_time_ns").agg(F.count_distinct(F.struct(*OHLC)).alias("variants")).where("variants > 1")


def clock_aligned(base: DataFrame, seconds: int) -> DataFrame:
    """Bars of ``seconds`` from shorter ones, only where the bucket is covered from start to end."""
    n = seconds * NS
    start = F.col("open_time_ns") - F.pmod("open_time_ns", F.lit(n))
    once = base.dropDuplicates(["symbol", "open_time_ns"])
    made = once.groupBy("symbol", start.alias("bucket_ns")).agg(*_ohlcv(F.col("open_time_ns")), F.min("open_time_ns").alias("first_ns"), F.max("close_time_ns").alias("last_ns"))
    return made.where((F.col("first_ns") == F.col("bucket_ns")) & (F.col("last_ns") == F.col("bucket_ns") + n)).drop("first_ns", "last_ns")


def direction(bars: DataFrame, time: str = "open_time_ns") -> DataFrame:
    """``direction``: 1 or -1 by the body; without one by the change from the close before; unchanged: as before, at first 1."""
    body = F.col("close_ticks") - F.col("open_ticks")
    near = running(bars, ["symbol"], [time], segment(time), {"__was": ("lag", F.col("close_ticks"))})
    own = F.signum(F.when(body != 0, body).otherwise(F.col("close_ticks") - F.col("__was")))
    marked = near.withColumn("__own", F.when(own != 0, own.cast("int"))).drop("__was")
    return running(marked, ["symbol"], [time], segment(time), {"direction": ("last", F.col("__own"))}).withColumn("direction", F.coalesce("direction", F.lit(1))).drop("__own")


def volume_delta(parts: DataFrame, parents: DataFrame, least: int) -> DataFrame:
    """(symbol, parent_ns, delta, parts): signed volume of the directed parts within each parent; below ``least`` parts 0."""
    held = boundaries(parts.withColumnRenamed("bucket_ns", "open_time_ns"), parents)
    out = held.groupBy("symbol", F.col("boundary_open_ns").alias("parent_ns")).agg(F.sum(F.col("direction") * F.col("tick_volume")).alias("delta"), F.count("*").alias("parts"))
    return out.withColumn("delta", F.when(F.col("parts") >= least, F.col("delta")).otherwise(0))


def sma_cross(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """``cross``: 1 where the fast mean rises through the slow one, -1 where it falls through; needs slow + 1 bars.

    Means are compared as whole numbers: sum * other length."""
    mean = lambda n, m, back: lambda w: F.sum("close_ticks").over(w.rowsBetween(-(n - 1) - back, -back)) * m
    sums = {"__a": mean(fast, slow, 0), "__b": mean(slow, fast, 0), "__pa": mean(fast, slow, 1), "__pb": mean(slow, fast, 1)}
    out = sliding(bars, SERIES, ["open_time_ns"], segment("open_time_ns"), slow + 1, sums, "__n")
    up, down = (F.col("__pa") <= F.col("__pb")) & (F.col("__a") > F.col("__b")), (F.col("__pa") >= F.col("__pb")) & (F.col("__a") < F.col("__b"))
    cross = F.when(F.col("__n") <= slow, 0).when(up, 1).when(down, -1).otherwise(0)
    return out.withColumn("cross", cross).drop("__a", "__b", "__pa", "__pb", "__n")


def local_minute(time_ns: str = "open_time_ns", zone: str = "UTC") -> tuple[Column, Column]:
    """(local date, minute of the local day) of a time."""
    local = F.from_utc_timestamp(F.timestamp_micros(F.expr(f"{time_ns} div 1000")), zone)
    return F.to_date(local), (F.hour(local) * 60 + F.minute(local)).cast("int")


def session_box(bars: DataFrame, start: int, end: int, step: int = 15, zone: str = "UTC") -> DataFrame:
    """Per symbol and local day the high and low of the slots from minute ``start`` to ``end``; ``missing`` counts absent slots."""
    day, minute = local_minute("open_time_ns", zone)
    held = bars.withColumns({"local_date": day, "minute": minute}).where(F.col("minute").between(start, end - 1) & ((F.col("minute") - start) % step == 0))
    slots = (end - start + step - 1) // step
    return held.groupBy("symbol", "local_date").agg(
        F.max("high_ticks").alias("high_ticks"),
        F.min("low_ticks").alias("low_ticks"),
        (F.lit(slots) - F.count_distinct("minute")).alias("missing"),
        F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step)), F.collect_set("minute"))), ",").alias("missing_minutes"),
    )


def in_session(bars: DataFrame, start: int, end: int, zone: str = "UTC") -> DataFrame:
    day, minute = local_minute("open_time_ns", zone)
    return bars.withColumn("local_date", day).where((minute >= start) & (minute < end))


def session_extremes(bars: DataFrame, start: int, end: int, zone: str = "UTC") -> DataFrame:
    """Every bar of the session with the session's high and low before it (null for the first)."""
    w = Window.partitionBy("symbol", "local_date").orderBy("open_time_ns").rowsBetween(Window.unboundedPreceding, -1)
    return in_session(bars, start, end, zone).withColumns({"high_before": F.max("high_ticks").over(w), "low_before": F.min("low_ticks").over(w)})


def shape() -> dict[str, Column]:
    """Body, shadows and the long and short one-sided shapes of a bar."""
    top, bottom = F.greatest("open_ticks", "close_ticks"), F.least("open_ticks", "close_ticks")
    body, upper, lower = top - bottom, F.col("high_ticks") - top, bottom - F.col("low_ticks")
    return {
        "body": body,
        "upper_shadow": upper,
        "lower_shadow": lower,
        "color": F.signum(F.col("close_ticks") - F.col("open_ticks")).cast("int"),
        "long_shape": (lower > body) & (lower > upper) & (upper < 7 * body),
        "short_shape": (upper > body) & (upper > lower) & (lower < 7 * body),
    }


def structure_levels(bars: DataFrame) -> DataFrame:
    """Levels that form where the color turns: up then down a high, down then up a low (the pair's extreme)."""
    color = F.signum(F.col("close_ticks") - F.col("open_ticks"))
    near = {"__pc": ("lag", color), "__ph": ("lag", F.col("high_ticks")), "__pl": ("lag", F.col("low_ticks"))}
    out = running(bars, SERIES, ["open_time_ns"], segment("open_time_ns"), near).withColumn("__c", color)
    high, low = (F.col("__pc") > 0) & (F.col("__c") < 0), (F.col("__pc") < 0) & (F.col("__c") > 0)
    out = out.withColumn("kind", F.when(high, "high").when(low, "low")).where("kind is not null")
    level = F.when(F.col("kind") == "high", F.greatest("high_ticks", "__ph")).otherwise(F.least("low_ticks", "__pl"))
    return out.withColumn("level_ticks", level).drop("__c", "__pc", "__ph", "__pl")


def downsample(bars: DataFrame, points: int, value: str = "close_ticks") -> DataFrame:
    """At most ``points`` rows per series that keep its envelope: of each of (points - 2) / 2 index buckets the
    lowest and highest row, besides the first and the last row."""
    buckets = max(1, (points - 2) // 2)
    numbers = {"__i": ("count", F.lit(1)), "__n": ("total", F.lit(1))}
    ranked = running(bars, SERIES, ["open_time_ns"], segment("open_time_ns"), numbers).withColumn("__i", F.col("__i") - 1)
    inner = F.when((F.col("__i") > 0) & (F.col("__i") < F.col("__n") - 1), F.floor((F.col("__i") - 1) * buckets / F.greatest(F.col("__n") - 2, F.lit(1))))
    bucket = F.when(F.col("__n") <= points, F.lit(-1) - F.col("__i")).when(F.col("__i") == 0, -1).when(F.col("__i") == F.col("__n") - 1, -2).otherwise(inner)
    ranked = ranked.withColumn("__b", bucket)
    row = F.struct("open_time_ns", F.col(value).alias("value"))
    low, high = F.min_by(row, F.struct(F.col(value), F.col("__i"))), F.max_by(row, F.struct(F.col(value), -F.col("__i")))
    picked = ranked.groupBy(*SERIES, "__b").agg(low.alias("a"), high.alias("b"))
    return picked.select(*SERIES, F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select(*SERIES, "x.open_time_ns", "x.value")


def extent(df: DataFrame, value: str) -> DataFrame:
    """Least and greatest finite value per symbol."""
    finite = F.when(~F.isnan(F.col(value)) & (F.abs(value) < float("inf")), F.col(value))
    return df.groupBy("symbol").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))


def boxes_on_or_before(days: DataFrame, boxes: DataFrame, columns: list[str]) -> DataFrame:
    """Each (symbol, local_date) with the latest box on or before it."""
    return asof_join(days, boxes.withColumnRenamed("local_date", "box_date"), ["symbol"], "local_date", "box_date", ["box_date", *columns])


def keep_days(df: DataFrame, days: int, time: str = "open_time_ns") -> DataFrame:
    """Rows of the last ``days`` days before each symbol's newest row."""
    newest = df.groupBy("symbol").agg(F.max(time).alias("__max"))
    return df.join(newest, "symbol").where(F.col(time) >= F.col("__max") - days * DAY_NS).drop("__max")
