"""Trades against the bars they live in: activity per bar, event bars, what followed the exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlume.operators.bars import SEGMENT_NS, segment
from barlume.operators.joins import BLOCK, asof_join, interval_join, running

HORIZONS = (4, 16, 32, 96)


def bounded(bars: DataFrame) -> DataFrame:
    """``bars`` with ``lower_ns``: the close before (the first: its open less 1), so gaps belong to the next bar."""
    before = running(bars, ["symbol"], ["close_time_ns"], segment("close_time_ns"), {"lower_ns": ("lag", F.col("close_time_ns"))})
    return before.withColumn("lower_ns", F.coalesce("lower_ns", F.col("open_time_ns") - 1))


def overlaps(bars: DataFrame, trades: DataFrame, width_ns: int) -> DataFrame:
    """(bar, trade) pairs where the trade is active: entry <= close and exit > lower."""
    return interval_join(bounded(bars), trades, ["symbol"], "lower_ns", "close_time_ns", "entry_time_ns", "exit_time_ns", width_ns)


def event_bars(trades: DataFrame, bars: DataFrame, event: str, prefix: str) -> DataFrame:
    """``trades`` with the bar (sequence, close) whose (lower, close] holds the event; null outside all bars."""
    b = bounded(bars).select("symbol", F.col("close_time_ns").alias(f"{prefix}_close_ns"), F.col("sequence").alias(f"{prefix}_sequence"), F.col("lower_ns").alias("__lo"))
    got = asof_join(trades, b, ["symbol"], event, f"{prefix}_close_ns", [f"{prefix}_close_ns", f"{prefix}_sequence", "__lo"], forward=True, segment_ns=SEGMENT_NS)
    inside = F.col("__lo") < F.col(event)
    return got.withColumns({c: F.when(inside, F.col(c)) for c in (f"{prefix}_close_ns", f"{prefix}_sequence")}).drop("__lo")


COUNTS = ("active", "active_long", "active_short", "entries", "exits", "stop_exits", "target_exits", "realized_pnl", "net_lots")


def ends(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """``trades`` that are active in some bar, with its first and last one (``first_sequence``; ``last_sequence`` is null where
    the bars end before the trade) and whether it enters within the first (``enters``)."""
    b = bounded(bars.select("symbol", "sequence", "open_time_ns", "close_time_ns"))

    def first_close(df: DataFrame, time: str, name: str) -> DataFrame:
        there = b.select("symbol", F.col("close_time_ns").alias("__c"), F.col("sequence").alias(f"{name}_sequence"), F.col("lower_ns").alias(f"__{name}"))
        return asof_join(df, there, ["symbol"], time, "__c", [f"{name}_sequence", f"__{name}"], forward=True, segment_ns=SEGMENT_NS)

    got = first_close(first_close(trades, "entry_time_ns", "first"), "exit_time_ns", "last")
    # the bar that holds the exit is the last one; an exit before all bars is in none
    lives = F.col("last_sequence").isNull() | ((F.col("last_sequence") >= F.col("first_sequence")) & (F.col("exit_time_ns") > F.col("__last")))
    got = got.where(F.col("first_sequence").isNotNull() & lives)
    return got.withColumn("enters", F.col("entry_time_ns") > F.col("__first")).drop("__first", "__last")


def _changes(held: DataFrame) -> DataFrame:
    """Two rows a trade at most: (symbol, sequence, opens, and the trade) where it begins and where it ends."""
    sides = F.array(
        F.struct(F.col("first_sequence").alias("sequence"), F.lit(True).alias("opens")),
        F.struct(F.col("last_sequence").alias("sequence"), F.lit(False).alias("opens")),
    )
    return held.withColumn("__x", F.explode(sides)).where("__x.sequence is not null").select("*", "__x.sequence", "__x.opens").drop("__x")


def activity(bars: DataFrame, trades: DataFrame, width_ns: int | None = None, ids: bool = False) -> DataFrame:
    """A row for every bar: active trades by side, entries, exits, profit realized and net lots; with ``ids`` also the ids of
    the active trades, by entry.

    A trade is two rows, +1 where it begins and -1 behind its last bar, however long it lives; running sums over
    stretches of bars tell how many are active. ``ids`` costs a row per bar and trade (in buckets of ``width_ns``);
    ``active_changes`` tells the same in two."""
    long = F.col("side") == "LONG"
    lots = F.when(long, F.col("lots")).otherwise(-F.col("lots"))
    opens, leaves = F.col("opens"), ~F.col("opens")
    at = _changes(ends(bars, trades)).groupBy("symbol", "sequence").agg(
        F.count_if(opens).alias("__in"),
        F.count_if(opens & long).alias("__in_long"),
        F.sum(F.when(opens, lots).otherwise(0)).alias("__in_lots"),
        F.count_if(leaves & long).alias("__out_long"),
        F.sum(F.when(leaves, lots).otherwise(0)).alias("__out_lots"),
        F.count_if(opens & F.col("enters")).alias("entries"),
        F.count_if(leaves).alias("exits"),
        F.count_if(leaves & (F.col("exit_reason") == "stop_loss")).alias("stop_exits"),
        F.count_if(leaves & (F.col("exit_reason") == "take_profit")).alias("target_exits"),
        F.coalesce(F.sum(F.when(leaves, F.col("net_pnl"))), F.lit(0)).alias("realized_pnl"),
    )
    changed = [c for c in at.columns if c not in ("symbol", "sequence")]
    out = bars.select("symbol", "sequence", "close_time_ns").join(at, ["symbol", "sequence"], "left").fillna(0, changed)
    net = {
        "active": ("sum", F.col("__in") - F.col("exits")),
        "active_long": ("sum", F.col("__in_long") - F.col("__out_long")),
        "net_lots": ("sum", F.col("__in_lots") - F.col("__out_lots")),
    }
    # what ends in a bar is active in it still
    out = running(out, ["symbol"], ["sequence"], F.expr(f"sequence div {BLOCK}"), net).withColumns(
        {"active": F.col("active") + F.col("exits"), "active_long": F.col("active_long") + F.col("__out_long"), "net_lots": F.col("net_lots") + F.col("__out_lots")}
    )
    out = out.withColumn("active_short", F.col("active") - F.col("active_long")).select("symbol", "sequence", "close_time_ns", *COUNTS)
    if not ids:
        return out
    pairs = overlaps(bars.select("symbol", "sequence", "open_time_ns", "close_time_ns"), trades.select("symbol", "trade_id", "entry_time_ns", "exit_time_ns"), width_ns or SEGMENT_NS)
    listed = pairs.groupBy("symbol", "sequence").agg(_by_entry(F.collect_list(F.struct("entry_time_ns", "trade_id"))).alias("active_ids"))
    return out.join(listed, ["symbol", "sequence"], "left").fillna("", ["active_ids"])


def _by_entry(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: x["trade_id"].cast("string")), ",")


def active_changes(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """The bars in which the set of active trades changes: (symbol, sequence, opened_ids, closed_ids), each by entry. A closed
    trade is active in its bar still."""
    each = _changes(ends(bars, trades.select("symbol", "trade_id", "entry_time_ns", "exit_time_ns")))
    listed = lambda held: _by_entry(F.collect_list(F.when(held, F.struct("entry_time_ns", "trade_id"))))
    return each.groupBy("symbol", "sequence").agg(listed(F.col("opens")).alias("opened_ids"), listed(~F.col("opens")).alias("closed_ids"))


def candle_map(bars: DataFrame, trades: DataFrame, width_ns: int) -> DataFrame:
    """A row per bar and trade active in it, with what happens there."""
    pairs = overlaps(bars, trades, width_ns)
    return pairs.select(
        "symbol",
        "sequence",
        "close_time_ns",
        "trade_id",
        "side",
        (F.col("entry_time_ns") > F.col("lower_ns")).alias("is_entry"),
        (F.col("exit_time_ns") <= F.col("close_time_ns")).alias("is_exit"),
        "exit_reason",
    )


def post_exit(trades: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Per trade and horizon: bars seen after the exit's, the greatest move with and against the trade from the exit
    price, and whether and when the entry price and the original target were reached again.

    The bars after the exit are found by sequence: buckets of the longest horizon, an equality join."""
    most, long = max(horizons), F.col("side") == "LONG"
    at = event_bars(trades, bars, "exit_time_ns", "exit")
    want = at.where("exit_sequence is not null").withColumn("__b", F.explode(F.array(F.expr(f"(exit_sequence + 1) div {most}"), F.expr(f"(exit_sequence + 1) div {most} + 1"))))
    have = bars.select("symbol", "sequence", "high_ticks", "low_ticks", F.expr(f"sequence div {most}").alias("__b"))
    k = F.col("sequence") - F.col("exit_sequence")
    path = want.join(have, ["symbol", "__b"]).where((k >= 1) & (k <= most)).withColumn("k", k)
    up, down = F.greatest(F.lit(0), F.col("high_ticks") - F.col("exit_price_ticks")), F.greatest(F.lit(0), F.col("exit_price_ticks") - F.col("low_ticks"))
    path = path.withColumns(
        {
            "with": F.when(long, up).otherwise(down),
            "against": F.when(long, down).otherwise(up),
            "back": F.when(F.when(long, F.col("high_ticks") >= F.col("entry_price_ticks")).otherwise(F.col("low_ticks") <= F.col("entry_price_ticks")), F.col("k")),
            "hit": F.when(F.when(long, F.col("high_ticks") >= F.col("take_profit_ticks")).otherwise(F.col("low_ticks") <= F.col("take_profit_ticks")), F.col("k")),
        }
    )
    aggs = []
    for h in horizons:
        near = F.col("k") <= h
        aggs.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.count_if(near).alias("observed"),
                F.coalesce(F.max(F.when(near, F.col("with"))), F.lit(0)).alias("with_ticks"),
                F.coalesce(F.max(F.when(near, F.col("against"))), F.lit(0)).alias("against_ticks"),
                F.min(F.when(near, F.col("back"))).alias("bars_to_entry"),
                F.min(F.when(near, F.col("hit"))).alias("bars_to_target"),
            )
        )
    got = path.groupBy("trade_id").agg(F.array(*aggs).alias("all"))
    none = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(0).cast("bigint").alias("observed"), F.lit(0).cast("bigint").alias("with_ticks"), F.lit(0).cast("bigint").alias("against_ticks"), F.lit(None).cast("bigint").alias("bars_to_entry"), F.lit(None).cast("bigint").alias("bars_to_target")) for h in horizons))
    out = trades.select("trade_id", "exit_reason").join(got, "trade_id", "left").select("trade_id", "exit_reason", F.explode(F.coalesce("all", none)).alias("x"))
    return out.select("trade_id", "exit_reason", "x.*").withColumn("stop_hunt_class", stop_hunt())


def stop_hunt() -> Column:
    return (
        F.when(F.col("exit_reason") != "stop_loss", "NOT_STOP_LOSS")
        .when(F.col("bars_to_target").isNotNull(), "ORIGINAL_TARGET_REACHED")
        .when(F.col("bars_to_entry").isNotNull(), "ENTRY_RECOVERED")
        .otherwise("NO_RECOVERY")
    )


def summary(trades: DataFrame, followed: DataFrame, entries: DataFrame, exits: DataFrame, horizon: int) -> DataFrame:
    """One row per symbol: outcomes, stopped trades that recovered, trades without a bar."""
    stopped = F.col("exit_reason") == "stop_loss"
    a = trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(F.col("net_pnl") > 0).alias("wins"), F.count_if(F.col("net_pnl") < 0).alias("losses"), F.count_if(F.col("net_pnl") == 0).alias("breakeven"), F.count_if(stopped).alias("stopped"), F.count_if(F.col("exit_reason") == "take_profit").alias("targets"))
    back = stopped & F.col("bars_to_entry").isNotNull()
    hit = stopped & F.col("bars_to_target").isNotNull()
    b = trades.select("trade_id", "symbol").join(followed.where(F.col("horizon") == horizon), "trade_id").groupBy("symbol").agg(F.count_if(back).alias("recovered"), F.count_if(hit).alias("reached_target"))
    c = entries.groupBy("symbol").agg(F.count_if(F.col("entry_sequence").isNull()).alias("unmapped_entries"))
    d = exits.groupBy("symbol").agg(F.count_if(F.col("exit_sequence").isNull()).alias("unmapped_exits"))
    out = a.join(b, "symbol", "left").join(c, "symbol", "left").join(d, "symbol", "left")
    return out.withColumn("recovered_percent", F.when(F.col("stopped") > 0, F.col("recovered") * 100.0 / F.col("stopped")).otherwise(0.0))


def excursions(trades: DataFrame, bars: DataFrame, width_ns: int) -> DataFrame:
    """Set-wise greatest move against and with each trade over the bars it is active in, in ticks."""
    long = F.col("side") == "LONG"
    up, down = F.col("high_ticks") - F.col("entry_price_ticks"), F.col("entry_price_ticks") - F.col("low_ticks")
    pairs = overlaps(bars, trades, width_ns)
    return pairs.groupBy("trade_id").agg(F.greatest(F.lit(0), F.max(F.when(long, down).otherwise(up))).alias("mae_ticks"), F.greatest(F.lit(0), F.max(F.when(long, up).otherwise(down))).alias("mfe_ticks"))
