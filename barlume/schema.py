"""Canonical tables. Times are nanoseconds since the epoch (BIGINT), prices whole ticks (BIGINT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: timeframe -> seconds; a month has none. Fixed values.
TIMEFRAMES = {
    "M1": 60,
    "M2": 120,
    "M3": 180,
    "M4": 240,
    "M5": 300,
    "M6": 360,
    "M10": 600,
    "M12": 720,
    "M15": 900,
    "M20": 1200,
    "M30": 1800,
    "H1": 3600,
    "H2": 7200,
    "H3": 10800,
    "H4": 14400,
    "H6": 21600,
    "H8": 28800,
    "H12": 43200,
    "D1": 86400,
    "W1": 604800,
    "MN1": None,
}
NS = 1_000_000_000
DAY_NS = 86_400 * NS

BARS = (
    "symbol string, timeframe string, open_time_ns bigint, close_time_ns bigint, open_ticks bigint, high_ticks bigint, low_ticks bigint, "
    "close_ticks bigint, tick_volume bigint, real_volume bigint, source_spread_points int, sequence bigint, source_row bigint, is_complete boolean"
)
TRADES = (
    "trade_id string, run_id string, symbol string, side string, volume_lots decimal(18,4), entry_time_ns bigint, exit_time_ns bigint, "
    "entry_price_ticks decimal(20,8), exit_price_ticks decimal(20,8), gross_pnl decimal(20,8), commission decimal(20,8), spread_cost decimal(20,8), "
    "slippage_cost decimal(20,8), swap decimal(20,8), net_pnl decimal(20,8), initial_risk decimal(20,8), realized_r_multiple decimal(20,8), "
    "mae decimal(20,8), mfe decimal(20,8), intrabar_ambiguous boolean, exit_reason string"
)
EQUITY = "run_id string, time_ns bigint, balance decimal(20,8), equity decimal(20,8), floating_pnl decimal(20,8), margin decimal(20,8), drawdown_amount decimal(20,8), drawdown_percent decimal(20,8)"


def timeframes(spark: SparkSession) -> DataFrame:
    """The timeframe dimension (timeframe, seconds)."""
    return spark.createDataFrame(list(TIMEFRAMES.items()), "timeframe string, seconds bigint")
