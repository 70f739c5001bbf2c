"""Run figures at any cursor, from figures stored at stretches of time.

The figures of a stretch merge with those before it: counts and sums add, the peak is the greater, and the deepest
drawdown is the deepest of both and of the earlier peak over the later low. So one row per run and stretch holds the
figures of all that came before its end, and a cursor reads one row a run and the stretch it is in. What it
reads does not grow with the run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barlume.operators.metrics import _div, _r
from barlume.sources import snapshots

SUMS = ("trades", "wins", "losses", "gross_profit", "gross_loss", "net_pnl", "r_sum", "r_count", "total_cost")


def _stretch(time: str, every_ns: int) -> Column:
    return F.floor(F.col(time) / every_ns).cast("bigint")


def _partial(trades: DataFrame, equity: DataFrame, by: Sequence[str], every_ns: int) -> DataFrame:
    """(by, stretch, the sums, peak, low, last, drawdown) of each stretch by itself."""
    n, r = F.col("net_pnl"), _r()
    sums = trades.groupBy(*by, _stretch("exit_time_ns", every_ns).alias("stretch")).agg(
        F.count("*").alias("trades"),
        F.count_if(n > 0).alias("wins"),
        F.count_if(n < 0).alias("losses"),
        F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).alias("gross_profit"),
        (-F.coalesce(F.sum(F.when(n < 0, n)), F.lit(0))).alias("gross_loss"),
        F.sum(n).alias("net_pnl"),
        F.coalesce(F.sum(r), F.lit(0.0)).alias("r_sum"),
        F.count(r).alias("r_count"),
        F.sum(F.col("commission") + F.col("spread_cost") + F.col("slippage_cost")).alias("total_cost"),
    )
    inside = Window.partitionBy(*by, "stretch").orderBy("time_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = equity.select(*by, "time_ns", "equity", _stretch("time_ns", every_ns).alias("stretch")).withColumn("__gap", F.max("equity").over(inside) - F.col("equity"))
    curve = curve.groupBy(*by, "stretch").agg(
        F.max("equity").alias("peak"), F.min("equity").alias("low"), F.max_by("equity", "time_ns").alias("last"), F.max("__gap").alias("drawdown")
    )
    both = sums.join(curve, [*by, "stretch"], "full")
    return both.fillna(0, list(SUMS))


def prefixes(trades: DataFrame, equity: DataFrame, by: Sequence[str], every_ns: int) -> DataFrame:
    """(by, stretch, next_stretch, the figures of everything up to the end of ``stretch``): a row per run and stretch in which
    something happens, good until ``next_stretch`` begins (null: from then on)."""
    parts = _partial(trades, equity, by, every_ns)
    w = Window.partitionBy(*by).orderBy("stretch")  # a row per stretch
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    deep = F.greatest(F.col("drawdown"), F.max("peak").over(before) - F.col("low"))
    parts = parts.withColumns({"__deep": deep, "next_stretch": F.lead("stretch").over(w)})
    return parts.select(
        *by, "stretch", "next_stretch", *(F.sum(c).over(upto).alias(c) for c in SUMS), F.max("peak").over(upto).alias("peak"),
        F.last("last", ignorenulls=True).over(upto).alias("last"), F.max("__deep").over(upto).alias("drawdown"),
    )


def write(trades: DataFrame, equity: DataFrame, path: str, by: Sequence[str], every_ns: int) -> snapshots.Version:
    """Publishes the prefixes, and trades and equity, all sorted by time so that a cursor's stretch is a few row groups."""
    spark = trades.sparkSession
    small = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 16)}
    sorted_ = lambda df, time: snapshots.Table(df.repartitionByRange(time).sortWithinPartitions(time), options=small)
    tables = {"prefixes": sorted_(prefixes(trades, equity, by, every_ns), "stretch"), "trades": sorted_(trades, "exit_time_ns"), "equity": sorted_(equity, "time_ns")}
    return snapshots.publish(spark, path, tables, note={"by": list(by), "every_ns": every_ns})


def at_cursor(stored: snapshots.Version, spark: SparkSession, at_ns: int, initial: float) -> DataFrame:
    """(by, trades, wins, final_balance, profit_factor, average_r, total_cost, equity, max_drawdown_amount) of everything up to
    ``at_ns``: the prefix before the cursor's stretch, merged with the rows of that stretch. Runs that have not begun are left out."""
    by, every_ns = stored.note["by"], stored.note["every_ns"]
    stretch = at_ns // every_ns
    saved = stored.read(spark, "prefixes").where((F.col("stretch") < stretch) & (F.col("next_stretch").isNull() | (F.col("next_stretch") >= stretch)))
    since = lambda name, time: stored.read(spark, name).where((F.col(time) >= stretch * every_ns) & (F.col(time) <= at_ns))
    now = _partial(since("trades", "exit_time_ns"), since("equity", "time_ns"), by, every_ns)
    names = [*SUMS, "peak", "low", "last", "drawdown"]
    now = now.select(*by, *(F.col(c).alias(f"__{c}") for c in names))
    both = saved.drop("stretch", "next_stretch").join(now, by, "full")
    add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
    out = both.select(
        *by, *map(add, SUMS), F.coalesce("__last", "last").alias("equity"),
        F.greatest("drawdown", "__drawdown", F.col("peak") - F.col("__low")).alias("max_drawdown_amount"),
    )
    return out.select(
        *by, "trades", "wins", (F.lit(initial) + F.col("net_pnl")).alias("final_balance"),
        F.when(F.col("losses") > 0, _div(F.col("gross_profit"), F.col("gross_loss"))).alias("profit_factor"),
        F.when(F.col("r_count") > 0, F.col("r_sum") / F.col("r_count")).alias("average_r"), "total_cost", "equity", "max_drawdown_amount",
    )
