"""Trades on bars (inventory 2.7 J1-J3, 2.8 G13-G14, 2.9 W9-W10, B13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import enrich as E
from barlume.plans.adapters import bar_trades, bars, sql
from barlume.plans.registry import query
from barlume.schema import NS

WIDTH = 3600 * NS


def views(spark, sf):
    return bars(spark, sf, "H1").where("symbol = 'view'")


_B = """--cte b AS (SELECT *, coalesce(lag(close_time_ns) OVER (PARTITION BY symbol ORDER BY close_time_ns), open_time_ns - 1) AS lower_ns FROM bars WHERE symbol = 'view'),
    pairs AS (SELECT b.*, t.* EXCLUDE (symbol) FROM b JOIN bar_trades t ON t.entry_time_ns <= b.close_time_ns AND t.exit_time_ns > b.lower_ns)"""
_ARGS = ("bar_trades", "bars:H1")


@query("k6_candle_trade_map", sql(_B + " SELECT symbol, sequence, close_time_ns, trade_id, side, entry_time_ns > lower_ns AS is_entry, exit_time_ns <= close_time_ns AS is_exit, exit_reason FROM pairs", *_ARGS))
def candle_trade_map(spark, sf):
    return E.candle_map(views(spark, sf), bar_trades(spark, sf), WIDTH)


@query(
    "g14_candle_activity",
    sql(
        _B
        + """, g AS (SELECT sequence, count(*) AS active, count(*) FILTER (side = 'LONG') AS active_long, count(*) FILTER (side = 'SHORT') AS active_short, count(*) FILTER (entry_time_ns > lower_ns) AS entries,
            count(*) FILTER (exit_time_ns <= close_time_ns) AS exits, count(*) FILTER (exit_time_ns <= close_time_ns AND exit_reason = 'stop_loss') AS stop_exits, count(*) FILTER (exit_time_ns <= close_time_ns AND exit_reason = 'take_profit') AS target_exits,
            CAST(coalesce(sum(net_pnl) FILTER (exit_time_ns <= close_time_ns), 0) AS BIGINT) AS realized_pnl, CAST(sum(CASE WHEN side = 'LONG' THEN lots ELSE -lots END) AS BIGINT) AS net_lots,
            string_agg(CAST(trade_id AS VARCHAR), ',' ORDER BY entry_time_ns, trade_id) AS active_ids FROM pairs GROUP BY sequence)
        SELECT symbol, b.sequence, close_time_ns, coalesce(active, 0) AS active, coalesce(active_long, 0) AS active_long, coalesce(active_short, 0) AS active_short, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits,
            coalesce(stop_exits, 0) AS stop_exits, coalesce(target_exits, 0) AS target_exits, coalesce(realized_pnl, 0) AS realized_pnl, coalesce(net_lots, 0) AS net_lots, coalesce(active_ids, '') AS active_ids FROM b LEFT JOIN g USING (sequence)""",
        *_ARGS,
    ),
)
def candle_activity(spark, sf):
    return E.activity(views(spark, sf), bar_trades(spark, sf), WIDTH, ids=True)


@query(
    "g14_activity_by_ends",
    sql(
        _B
        + """ SELECT symbol, sequence, count(*) AS active, count(*) FILTER (side = 'LONG') AS active_long, CAST(sum(CASE WHEN side = 'LONG' THEN lots ELSE -lots END) AS BIGINT) AS net_lots,
            count(*) FILTER (exit_time_ns <= close_time_ns) AS exits FROM pairs GROUP BY symbol, sequence""",
        *_ARGS,
    ),
)
def activity_by_ends(spark, sf):
    """Two rows a trade; bars without an active one are left out, as the pairs of the SQL have none."""
    return E.activity(views(spark, sf), bar_trades(spark, sf)).where("active > 0").select("symbol", "sequence", "active", "active_long", "net_lots", "exits")


@query(
    "g14_active_changes",
    sql(
        _B
        + """, ended AS (SELECT symbol, trade_id, entry_time_ns, min(sequence) AS f, max(sequence) AS l, bool_or(exit_time_ns <= close_time_ns) AS done FROM pairs GROUP BY ALL),
        e AS (SELECT symbol, f AS sequence, trade_id, entry_time_ns, true AS opens FROM ended UNION ALL SELECT symbol, l, trade_id, entry_time_ns, false FROM ended WHERE done)
        SELECT symbol, sequence, coalesce(string_agg(CAST(trade_id AS VARCHAR), ',' ORDER BY entry_time_ns, trade_id) FILTER (opens), '') AS opened_ids,
            coalesce(string_agg(CAST(trade_id AS VARCHAR), ',' ORDER BY entry_time_ns, trade_id) FILTER (NOT opens), '') AS closed_ids FROM e GROUP BY symbol, sequence""",
        *_ARGS,
    ),
)
def active_changes(spark, sf):
    return E.active_changes(views(spark, sf), bar_trades(spark, sf))


def _event(name: str, event: str):
    @query(f"j2_{name}_bar", sql(_B + f" SELECT t.trade_id, b.sequence AS {name}_sequence, b.close_time_ns AS {name}_close_ns FROM bar_trades t LEFT JOIN b ON b.lower_ns < t.{event} AND t.{event} <= b.close_time_ns", *_ARGS))
    def run(spark, sf):
        return E.event_bars(bar_trades(spark, sf), views(spark, sf), event, name).select("trade_id", f"{name}_sequence", f"{name}_close_ns")


_event("entry", "entry_time_ns")
_event("exit", "exit_time_ns")

_POST = (
    _B
    + """, ended AS (SELECT t.*, b.sequence AS exit_sequence FROM bar_trades t JOIN b ON b.lower_ns < t.exit_time_ns AND t.exit_time_ns <= b.close_time_ns),
    path AS (SELECT ended.*, b.sequence - exit_sequence AS k, greatest(0, CASE WHEN side = 'LONG' THEN high_ticks - exit_price_ticks ELSE exit_price_ticks - low_ticks END) AS fav,
        greatest(0, CASE WHEN side = 'LONG' THEN exit_price_ticks - low_ticks ELSE high_ticks - exit_price_ticks END) AS adv,
        CASE WHEN side = 'LONG' THEN high_ticks >= entry_price_ticks ELSE low_ticks <= entry_price_ticks END AS back, CASE WHEN side = 'LONG' THEN high_ticks >= take_profit_ticks ELSE low_ticks <= take_profit_ticks END AS hit
        FROM ended JOIN b ON b.sequence BETWEEN exit_sequence + 1 AND exit_sequence + 96),
    post AS (SELECT t.trade_id, t.exit_reason, CAST(h AS INTEGER) AS horizon, count(k) AS observed, coalesce(max(fav), 0) AS with_ticks, coalesce(max(adv), 0) AS against_ticks, min(k) FILTER (back) AS bars_to_entry, min(k) FILTER (hit) AS bars_to_target
        FROM bar_trades t CROSS JOIN (SELECT unnest([4, 16, 32, 96]) AS h) LEFT JOIN path p ON p.trade_id = t.trade_id AND k <= h GROUP BY ALL),
    hunts AS (SELECT *, CASE WHEN exit_reason <> 'stop_loss' THEN 'NOT_STOP_LOSS' WHEN bars_to_target IS NOT NULL THEN 'ORIGINAL_TARGET_REACHED' WHEN bars_to_entry IS NOT NULL THEN 'ENTRY_RECOVERED' ELSE 'NO_RECOVERY' END AS stop_hunt_class FROM post)"""
)


@query("w9_post_exit", sql(_POST + " SELECT * FROM hunts", *_ARGS))
def post_exit(spark, sf):
    return E.post_exit(bar_trades(spark, sf), views(spark, sf))


@query("w10_stop_hunt", sql(_POST + " SELECT horizon, stop_hunt_class, count(*) AS trades FROM hunts GROUP BY ALL", *_ARGS))
def stop_hunt(spark, sf):
    return E.post_exit(bar_trades(spark, sf), views(spark, sf)).groupBy("horizon", "stop_hunt_class").agg(F.count("*").alias("trades"))


@query(
    "g13_enrich_summary",
    sql(
        _POST
        + """ SELECT 'view' AS symbol, count(*) AS trades, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses, count(*) FILTER (net_pnl = 0) AS breakeven, count(*) FILTER (t.exit_reason = 'stop_loss') AS stopped,
        count(*) FILTER (t.exit_reason = 'take_profit') AS targets, count(*) FILTER (t.exit_reason = 'stop_loss' AND bars_to_entry IS NOT NULL) AS recovered, count(*) FILTER (t.exit_reason = 'stop_loss' AND bars_to_target IS NOT NULL) AS reached_target,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM b WHERE b.lower_ns < t.entry_time_ns AND t.entry_time_ns <= b.close_time_ns)) AS unmapped_entries,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM b WHERE b.lower_ns < t.exit_time_ns AND t.exit_time_ns <= b.close_time_ns)) AS unmapped_exits,
        round(count(*) FILTER (t.exit_reason = 'stop_loss' AND bars_to_entry IS NOT NULL) * 100.0 / count(*) FILTER (t.exit_reason = 'stop_loss'), 6) AS recovered_percent
        FROM bar_trades t JOIN hunts h ON h.trade_id = t.trade_id AND h.horizon = 96""",
        *_ARGS,
    ),
)
def enrich_summary(spark, sf):
    t, b = bar_trades(spark, sf), views(spark, sf)
    got = E.summary(t, E.post_exit(t, b), E.event_bars(t, b, "entry_time_ns", "entry"), E.event_bars(t, b, "exit_time_ns", "exit"), 96)
    return got.withColumn("recovered_percent", F.round("recovered_percent", 6))


@query(
    "b13_excursions",
    sql(
        _B
        + """ SELECT trade_id, greatest(0, max(CASE WHEN side = 'LONG' THEN entry_price_ticks - low_ticks ELSE high_ticks - entry_price_ticks END)) AS mae_ticks,
        greatest(0, max(CASE WHEN side = 'LONG' THEN high_ticks - entry_price_ticks ELSE entry_price_ticks - low_ticks END)) AS mfe_ticks FROM pairs GROUP BY trade_id""",
        *_ARGS,
    ),
)
def excursions(spark, sf):
    return E.excursions(bar_trades(spark, sf), views(spark, sf), WIDTH)
