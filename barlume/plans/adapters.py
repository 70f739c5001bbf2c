"""Views of the driver's tables in the domain's terms, as DataFrames and as SQL of the same meaning.

ticks: ``events`` with the type as symbol, the value in hundredths as price and ``props.k`` as volume.
bars: ticks by clock bucket. trades: ``orders`` (metrics) and purchase events (aligned with the bars).
equity: running profit of the trades per symbol, which serves as run.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlume.operators.bars import resample
from barlume.schema import NS, TIMEFRAMES

INITIAL = 10_000_000
STEP_NS = 900 * NS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _us(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("tick_id"),
        (_us("ts") * 1000).alias("time_ns"),
        F.round(F.col("value") * 100).cast("bigint").alias("price_ticks"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
    )


def bars(spark: SparkSession, sf: str, timeframe: str = "M15") -> DataFrame:
    return resample(ticks(spark, sf), timeframe)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    entry = (_us("o_orderdate") + k % 24 * 3_600_000_000) * 1000
    base = o.select(
        k.alias("trade_id"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        entry.alias("entry_time_ns"),
        (entry + (1 + k % 96) * STEP_NS).alias("exit_time_ns"),
        (cents % 20001 - 9000).alias("net_pnl"),
        (cents % 7).alias("commission"),
        (cents % 5).alias("spread_cost"),
        (cents % 3).alias("slippage_cost"),
        F.lit(0).cast("bigint").alias("swap"),
        (2000 + cents % 8000).alias("initial_risk"),
        (cents % 3000).alias("mae"),
        (cents % 5000).alias("mfe"),
        (cents % 13 == 0).alias("intrabar_ambiguous"),
        F.when(cents % 10 < 4, "stop_loss").when(cents % 10 < 7, "take_profit").when(cents % 10 == 7, "stop_out").when(cents % 10 == 8, "manual").otherwise("end_of_data").alias("exit_reason"),
    )
    return base.withColumn("gross_pnl", F.col("net_pnl") + F.col("commission") + F.col("spread_cost") + F.col("slippage_cost") - F.col("swap"))


def equity(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).groupBy("symbol", F.col("exit_time_ns").alias("time_ns")).agg(F.sum("net_pnl").alias("pnl"))
    w = Window.partitionBy("symbol").orderBy("time_ns").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("symbol", "time_ns", (F.sum("pnl").over(w) + INITIAL).alias("equity"))


def bar_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades on the symbol ``view`` that lie within its bars' time."""
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    i, price = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint")
    entry = _us("ts") * 1000
    return e.select(
        i.alias("trade_id"),
        F.lit("view").alias("symbol"),
        F.when(i % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        entry.alias("entry_time_ns"),
        (entry + (1 + i % 96) * STEP_NS).alias("exit_time_ns"),
        price.alias("entry_price_ticks"),
        (price + i % 401 - 200).alias("exit_price_ticks"),
        F.when(i % 2 == 0, price + 50 + i % 300).otherwise(price - 50 - i % 300).alias("take_profit_ticks"),
        (1 + i % 5).alias("lots"),
        ((i % 401 - 200) * F.when(i % 2 == 0, 1).otherwise(-1) * (1 + i % 5)).alias("net_pnl"),
        F.when(i % 3 == 0, "stop_loss").when(i % 3 == 1, "take_profit").otherwise("manual").alias("exit_reason"),
    )


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """An event log: kind, priority and payload per run (the user modulo 8)."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") % 8).alias("run_id"),
        (_us("ts") * 1000).alias("time_ns"),
        kind.alias("kind"),
        F.when(kind == "purchase", 10).when(kind == "click", 20).when(kind == "view", 30).otherwise(40).alias("priority"),
        F.col("event_id").alias("source_sequence"),
        (F.col("user_id") % 50).alias("entity_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.col("props").alias("payload"),
    )


# --- the same as SQL -----------------------------------------------------------------------------------

_TICKS = """ticks AS (
    SELECT event_type AS symbol, event_id AS tick_id, epoch_us(ts) * 1000 AS time_ns,
        CAST(round(value * 100) AS BIGINT) AS price_ticks, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events)"""


@lru_cache
def bars_sql(timeframe: str = "M15", name: str = "bars") -> str:
    n = TIMEFRAMES[timeframe] * NS
    return f"""{name} AS (
    SELECT symbol, '{timeframe}' AS timeframe, time_ns - time_ns % {n} AS open_time_ns, time_ns - time_ns % {n} + {n} AS close_time_ns,
        arg_min(price_ticks, (time_ns, tick_id)) AS open_ticks, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks,
        arg_max(price_ticks, (time_ns, tick_id)) AS close_ticks, count(*) AS tick_volume, CAST(sum(volume) AS BIGINT) AS real_volume,
        CAST(arg_max(volume, (time_ns, tick_id)) % 10 AS INTEGER) AS source_spread_points,
        CAST(row_number() OVER (PARTITION BY symbol ORDER BY time_ns - time_ns % {n}) - 1 AS BIGINT) AS sequence
    FROM ticks GROUP BY symbol, time_ns - time_ns % {n})"""


_TRADES = f"""raw_trades AS (
    SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority AS symbol,
        (epoch_us(o_orderdate) + o_orderkey % 24 * 3600000000) * 1000 AS entry_time_ns FROM orders),
trades AS (
    SELECT k AS trade_id, symbol, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, entry_time_ns,
        entry_time_ns + (1 + k % 96) * {STEP_NS} AS exit_time_ns, cents % 20001 - 9000 AS net_pnl, cents % 7 AS commission,
        cents % 5 AS spread_cost, cents % 3 AS slippage_cost, CAST(0 AS BIGINT) AS swap, 2000 + cents % 8000 AS initial_risk,
        cents % 3000 AS mae, cents % 5000 AS mfe, cents % 13 = 0 AS intrabar_ambiguous,
        CASE WHEN cents % 10 < 4 THEN 'stop_loss' WHEN cents % 10 < 7 THEN 'take_profit' WHEN cents % 10 = 7 THEN 'stop_out'
            WHEN cents % 10 = 8 THEN 'manual' ELSE 'end_of_data' END AS exit_reason,
        cents % 20001 - 9000 + cents % 7 + cents % 5 + cents % 3 AS gross_pnl FROM raw_trades)"""

_EQUITY = f"""by_exit AS (SELECT symbol, exit_time_ns AS time_ns, sum(net_pnl) AS pnl FROM trades GROUP BY ALL),
equity AS (SELECT symbol, time_ns, CAST({INITIAL} + sum(pnl) OVER (PARTITION BY symbol ORDER BY time_ns) AS BIGINT) AS equity FROM by_exit)"""

_BAR_TRADES = f"""bar_trades AS (
    SELECT event_id AS trade_id, 'view' AS symbol, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
        epoch_us(ts) * 1000 AS entry_time_ns, epoch_us(ts) * 1000 + (1 + event_id % 96) * {STEP_NS} AS exit_time_ns,
        CAST(round(value * 100) AS BIGINT) AS entry_price_ticks, CAST(round(value * 100) AS BIGINT) + event_id % 401 - 200 AS exit_price_ticks,
        CAST(round(value * 100) AS BIGINT) + CASE WHEN event_id % 2 = 0 THEN 50 + event_id % 300 ELSE -50 - event_id % 300 END AS take_profit_ticks,
        1 + event_id % 5 AS lots, (event_id % 401 - 200) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (1 + event_id % 5) AS net_pnl,
        CASE WHEN event_id % 3 = 0 THEN 'stop_loss' WHEN event_id % 3 = 1 THEN 'take_profit' ELSE 'manual' END AS exit_reason
    FROM events WHERE event_type = 'purchase')"""

_TIMELINE = """timeline AS (
    SELECT user_id % 8 AS run_id, epoch_us(ts) * 1000 AS time_ns, event_type AS kind,
        CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 20 WHEN 'view' THEN 30 ELSE 40 END AS priority,
        event_id AS source_sequence, user_id % 50 AS entity_id, CAST(round(value * 100) AS BIGINT) AS amount, props AS payload FROM events)"""

_PARTS = {"ticks": [_TICKS], "trades": [_TRADES], "equity": [_TRADES, _EQUITY], "bar_trades": [_BAR_TRADES], "timeline": [_TIMELINE]}


def sql(body: str, *views: str) -> str:
    """``body`` after the common table expressions of ``views``; ``bars:H1`` or ``bars:H1:name`` are bars."""
    parts: list[str] = []
    for v in views:
        if v.startswith("bars"):
            _, tf, name = [*v.split(":"), "bars"][:3] if ":" in v else ("", "M15", "bars")
            parts += [_TICKS, bars_sql(tf, name)]
        else:
            parts += _PARTS[v]
    head = ",\n".join(dict.fromkeys(parts))
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}{',' if body.startswith('--cte') else ''}\n{body.removeprefix('--cte')}"
