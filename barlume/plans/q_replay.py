"""Replay, compaction, paging, set operations and breadth (inventory 2.9 W6-W14, 2.10, 2.12, 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import replay as R
from barlume.operators.joins import interval_join
from barlume.plans.adapters import bar_trades, bars, equity, sql, table, ticks, timeline, trades
from barlume.plans.q_series import T10, T15, T20
from barlume.plans.registry import query
from barlume.schema import NS
from barlume.sources.shared import shared_path

DAY = 86_400 * NS
KEYS = ["run_id", "entity_id"]
_LATEST = "QUALIFY row_number() OVER (PARTITION BY run_id, entity_id ORDER BY time_ns DESC, source_sequence DESC) = 1"


@query("w6_timeline_order", sql("SELECT run_id, source_sequence, row_number() OVER (PARTITION BY run_id ORDER BY time_ns, priority, source_sequence) AS sequence FROM timeline", "timeline"))
def timeline_order(spark, sf):
    return R.ordered(timeline(spark, sf)).select("run_id", "source_sequence", "sequence")


@query("t3_half_open_range", sql(f"SELECT run_id, source_sequence, time_ns FROM timeline WHERE time_ns > {T10} AND time_ns <= {T15}", "timeline"))
def half_open_range(spark, sf):
    return R.between(timeline(spark, sf), T10, T15).select("run_id", "source_sequence", "time_ns")


@query("t2_keyset_page", sql("""SELECT * FROM (SELECT 'after' AS side, source_sequence, kind FROM timeline WHERE source_sequence > 500 ORDER BY source_sequence LIMIT 100)
    UNION ALL SELECT * FROM (SELECT 'before', source_sequence, kind FROM timeline WHERE source_sequence < 500 ORDER BY source_sequence DESC LIMIT 100)""", "timeline"))
def keyset_page(spark, sf):
    t = timeline(spark, sf)
    side = lambda d, s: d.select(F.lit(s).alias("side"), "source_sequence", "kind")
    return side(R.page(t, "source_sequence", after=500), "after").unionByName(side(R.page(t, "source_sequence", before=500), "before"))


@query("w7_last_n_per_type", sql("SELECT kind, run_id, source_sequence FROM timeline QUALIFY row_number() OVER (PARTITION BY kind, run_id ORDER BY time_ns DESC, source_sequence DESC) <= 10", "timeline"))
def last_n_per_type(spark, sf):
    return R.recent(timeline(spark, sf), ["kind", "run_id"], 10).select("kind", "run_id", "source_sequence")


@query("w8_latest_by_key", sql(f"SELECT run_id, entity_id, time_ns, source_sequence, amount FROM timeline {_LATEST}", "timeline"))
def latest_by_key(spark, sf):
    return R.compact(timeline(spark, sf), KEYS).select(*KEYS, "time_ns", "source_sequence", "amount")


@query("j6_state_at", sql(f"SELECT run_id, entity_id, time_ns, source_sequence, amount FROM timeline WHERE time_ns <= {T15 + 7 * 3600 * NS} {_LATEST}", "timeline"))
def state_at(spark, sf):
    t, at = timeline(spark, sf), T15 + 7 * 3600 * NS
    return R.state_at(t, KEYS, at, R.checkpoints(t, KEYS, DAY), DAY)


@query(
    "l12_window_seed",
    sql(f"SELECT run_id, entity_id, source_sequence, true AS is_seed FROM (SELECT * FROM timeline WHERE time_ns <= {T15} {_LATEST}) UNION ALL SELECT run_id, entity_id, source_sequence, false FROM timeline WHERE time_ns > {T15} AND time_ns <= {T20}", "timeline"),
)
def window_seed(spark, sf):
    return R.window_with_seed(timeline(spark, sf), KEYS, T15, T20).select(*KEYS, "source_sequence", "is_seed")


@query("l11_bootstrap", sql(f"""SELECT 'bars' AS part, count(*) AS n, CAST(sum(close_ticks) AS BIGINT) AS total FROM (SELECT close_ticks FROM bars WHERE close_time_ns <= {T15} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY close_time_ns DESC) <= 50)
    UNION ALL SELECT 'timeline', count(*), CAST(sum(source_sequence) AS BIGINT) FROM (SELECT source_sequence FROM timeline WHERE time_ns <= {T15} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY time_ns DESC, source_sequence DESC) <= 20)
    UNION ALL SELECT 'state', count(*), CAST(sum(amount) AS BIGINT) FROM (SELECT amount FROM timeline WHERE time_ns <= {T15} {_LATEST})""", "bars", "timeline"))
def bootstrap(spark, sf):
    got = R.bootstrap(bars(spark, sf), timeline(spark, sf), KEYS, T15, 50, 20)
    total = {"bars": "close_ticks", "timeline": "source_sequence", "state": "amount"}
    return R.union_all(*(got[k].agg(F.count("*").alias("n"), F.sum(c).alias("total")).select(F.lit(k).alias("part"), "n", "total") for k, c in total.items()))


@query("t5_live_overrides", sql("""SELECT run_id, entity_id, CASE WHEN max(amount) FILTER (kind = 'purchase') IS NOT NULL THEN 'live' ELSE 'completed' END AS origin FROM timeline GROUP BY run_id, entity_id""", "timeline"))
def live_overrides(spark, sf):
    t = timeline(spark, sf).select(*KEYS, "kind").distinct()
    done = t.select(*KEYS).distinct().withColumn("origin", F.lit("completed"))
    live = t.where("kind = 'purchase'").select(*KEYS).distinct().withColumn("origin", F.lit("live"))
    return R.merge_live(done, live, KEYS)


@query("w13_right_wins_merge", sql("SELECT symbol, open_time_ns, coalesce(h.close_ticks * 2, b.close_ticks) AS close_ticks FROM bars b FULL JOIN hours h USING (symbol, open_time_ns)", "bars", "bars:H1:hours"))
def right_wins_merge(spark, sf):
    left = bars(spark, sf).select("symbol", "open_time_ns", "close_ticks")
    right = bars(spark, sf, "H1").select("symbol", "open_time_ns", (F.col("close_ticks") * 2).alias("close_ticks"))
    return R.merge_live(left, right, ["symbol", "open_time_ns"])


@query("w11_equity_sample", sql("""--cte n AS (SELECT symbol AS run_id, time_ns, equity, row_number() OVER (PARTITION BY symbol ORDER BY time_ns) AS n FROM equity) SELECT run_id, time_ns, equity FROM n WHERE n = 1 OR n % 10 = 0 OR equity % 7 = 0""", "equity"))
def equity_sample(spark, sf):
    e = equity(spark, sf).withColumnRenamed("symbol", "run_id").withColumn("has_event", F.col("equity") % 7 == 0)
    return R.sample_equity(e, 10).drop("has_event")


@query("w12_ring_buffer", sql("SELECT symbol, open_time_ns FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ns DESC) <= 240", "bars"))
def ring_buffer(spark, sf):
    from barlume.operators.joins import last_n

    return last_n(bars(spark, sf), ["symbol"], ["open_time_ns"], 240).select("symbol", "open_time_ns")


@query("w14_prune_series", sql(f"SELECT run_id, entity_id, source_sequence FROM timeline t WHERE time_ns >= coalesce((SELECT max(time_ns) FROM timeline x WHERE x.run_id = t.run_id AND x.entity_id = t.entity_id AND x.time_ns <= {T15}), {T15})", "timeline"))
def prune_series(spark, sf):
    return R.prune_series(timeline(spark, sf), KEYS, T15).select(*KEYS, "source_sequence")


def _drawings(spark, sf):
    e = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "marker").when(i % 5 == 1, "horizontal_line").when(i % 5 == 2, "ray").otherwise("rectangle")
    d = e.where("event_id % 10 < 7").select(i.alias("drawing_id"), i.alias("ordinal"), (i % 3).alias("z_index"), kind.alias("kind"), at.alias("anchor_a_ns"), (at + (i % 2000 - 300) * 3600 * NS).alias("anchor_b_ns"))
    start, end = R.time_bounds()
    return d.withColumns({"from_ns": start, "to_ns": end})


_DRAW = f"""--cte raw AS (SELECT event_id AS drawing_id, CASE event_id % 5 WHEN 0 THEN 'marker' WHEN 1 THEN 'horizontal_line' WHEN 2 THEN 'ray' ELSE 'rectangle' END AS kind, epoch_us(ts) * 1000 AS a,
        epoch_us(ts) * 1000 + (event_id % 2000 - 300) * {3600 * NS} AS b FROM events WHERE event_id % 10 < 7),
    drawings AS (SELECT drawing_id, kind, CASE kind WHEN 'horizontal_line' THEN NULL WHEN 'marker' THEN a ELSE least(a, b) END AS from_ns, CASE WHEN kind IN ('horizontal_line', 'ray') THEN NULL WHEN kind = 'marker' THEN a ELSE greatest(a, b) END AS to_ns FROM raw)"""


@query("f18_drawing_bounds", sql(_DRAW.replace("--cte ", "WITH ", 1) + " SELECT * FROM drawings"))
def drawing_bounds(spark, sf):
    return _drawings(spark, sf).select("drawing_id", "kind", "from_ns", "to_ns")


_B6 = 6 * 3600 * NS
_WIDE = (T20 - T15) * 0.15


@query(
    "a18_viewport_index",
    sql(
        _DRAW.replace("--cte ", "WITH ", 1)
        + f""" SELECT drawing_id FROM drawings WHERE coalesce(floor(to_ns / {_B6}) - floor(from_ns / {_B6}) + 1 > 64, true) OR (floor(from_ns / {_B6}) <= {int((T20 + _WIDE) // _B6)} AND floor(to_ns / {_B6}) >= {int((T15 - _WIDE) // _B6)}) ORDER BY drawing_id DESC LIMIT 1500"""
    ),
)
def viewport_index(spark, sf):
    return R.viewport(_drawings(spark, sf), T15, T20, 1500).select("drawing_id")


@query(
    "a18_stored_viewport",
    sql(
        _DRAW.replace("--cte ", "WITH ", 1)
        + f""" SELECT drawing_id, from_ns, to_ns FROM drawings WHERE coalesce(floor(to_ns / {_B6}) - floor(from_ns / {_B6}) + 1 > 64, true)
        OR (floor(from_ns / {_B6}) <= {int((T20 + _WIDE) // _B6)} AND floor(to_ns / {_B6}) >= {int((T15 - _WIDE) // _B6)}) ORDER BY drawing_id DESC LIMIT 1500"""
    ),
)
def stored_viewport(spark, sf):
    """The same view from a published interval index."""
    index = R.write_viewport_index(_drawings(spark, sf), shared_path(spark, "viewport"))
    return R.read_viewport(index, spark, T15, T20, 1500).select("drawing_id", "from_ns", "to_ns")


@query("j11_suppressed_drawings", sql("SELECT event_id AS drawing_id FROM events WHERE event_id % 10 < 7 AND event_id NOT IN (SELECT trade_id FROM bar_trades)", "bar_trades"))
def suppressed_drawings(spark, sf):
    return _drawings(spark, sf).join(bar_trades(spark, sf).select(F.col("trade_id").alias("drawing_id")), "drawing_id", "left_anti").select("drawing_id")


@query("l14_progress", sql(f"SELECT symbol, greatest(0.0, least(1.0, ({T15} - min(open_time_ns)) / CAST(max(close_time_ns) - min(open_time_ns) AS DOUBLE))) AS progress FROM bars GROUP BY symbol", "bars"))
def progress(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(R.progress(F.lit(T15), F.min("open_time_ns"), F.max("close_time_ns")).alias("progress"))


@query("l15_session_seek", sql(f"""SELECT symbol, timeframe, max(close_time_ns) AS cursor_ns FROM (SELECT symbol, timeframe, close_time_ns FROM bars UNION ALL SELECT symbol, timeframe, close_time_ns FROM hours) WHERE close_time_ns <= {T15} GROUP BY symbol, timeframe""", "bars", "bars:H1:hours"))
def session_seek(spark, sf):
    both = bars(spark, sf).unionByName(bars(spark, sf, "H1"))
    return both.where(F.col("close_time_ns") <= T15).groupBy("symbol", "timeframe").agg(F.max("close_time_ns").alias("cursor_ns"))


@query("l4_frame_coalescing", sql(f"SELECT run_id, kind, time_ns // {3600 * NS} AS frame, count(*) AS items, max(source_sequence) AS newest FROM timeline GROUP BY ALL", "timeline"))
def frame_coalescing(spark, sf):
    return timeline(spark, sf).groupBy("run_id", "kind", F.expr(f"time_ns div {3600 * NS}").alias("frame")).agg(F.count("*").alias("items"), F.max("source_sequence").alias("newest"))


# --- set operations and breadth -------------------------------------------------------------------------------


@query("t6_set_difference", "SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_difference(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


@query("t7_set_intersection", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_intersection(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


@query("j12_calculation_samples", "SELECT p_partkey, side, lots, p_size * lots * CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS exposure FROM part CROSS JOIN (SELECT unnest(['BUY', 'SELL']) AS side) CROSS JOIN (SELECT CAST(unnest([1, 5, 10]) AS INTEGER) AS lots)")
def calculation_samples(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))).alias("side")).select("*", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("lots"))
    return p.select("p_partkey", "side", "lots", (F.col("p_size") * F.col("lots") * F.when(F.col("side") == "BUY", 1).otherwise(-1)).cast("int").alias("exposure"))


@query("j7_profile_join", sql("SELECT t.trade_id, n_name, t.net_pnl FROM trades t JOIN orders o ON t.trade_id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE t.side = 'LONG' AND t.net_pnl > 9000", "trades"))
def profile_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("trade_id"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    t = trades(spark, sf).where("side = 'LONG' and net_pnl > 9000")
    return t.join(o, "trade_id").join(c, "o_custkey").join(n, "c_nationkey").select("trade_id", "n_name", "net_pnl")


@query("j8_manifest_fallback", "SELECT p.p_partkey, coalesce(s.s_name, 'discovered') AS source FROM part p LEFT JOIN supplier s ON p.p_partkey = s.s_suppkey")
def manifest_fallback(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    return table(spark, sf, "part").join(s, "p_partkey", "left").select("p_partkey", F.coalesce("s_name", F.lit("discovered")).alias("source"))


@query("j10_snapshot_checks", """SELECT s.s_suppkey, c.name, c.ok FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey, LATERAL (SELECT unnest(['known', 'balance', 'region']) AS name, unnest([n.n_name IS NOT NULL, s.s_acctbal >= 0, coalesce(n.n_regionkey < 3, false)]) AS ok) c""")
def snapshot_checks(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    s = table(spark, sf, "supplier").join(n, "s_nationkey", "left")
    checks = {"known": F.col("n_name").isNotNull(), "balance": F.col("s_acctbal") >= 0, "region": F.coalesce(F.col("n_regionkey") < 3, F.lit(False))}
    return s.select("s_suppkey", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("ok")) for k, v in checks.items()))).alias("x")).select("s_suppkey", "x.name", "x.ok")


@query("f13_order_filters", sql("SELECT side, exit_reason, count(*) AS n FROM trades WHERE exit_reason IN ('stop_loss', 'manual') AND commission > 2 GROUP BY ALL", "trades"))
def order_filters(spark, sf):
    return trades(spark, sf).where(F.col("exit_reason").isin("stop_loss", "manual") & (F.col("commission") > 2)).groupBy("side", "exit_reason").agg(F.count("*").alias("n"))


@query("w15_client_state", sql("SELECT run_id, entity_id, CAST(sum(CASE kind WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS open_positions, count(*) AS events FROM timeline GROUP BY ALL", "timeline"))
def client_state(spark, sf):
    step = F.when(F.col("kind") == "purchase", 1).when(F.col("kind") == "error", -1).otherwise(0)
    return timeline(spark, sf).groupBy(*KEYS).agg(F.sum(step).alias("open_positions"), F.count("*").alias("events"))


@query("j1_interval_join", sql("""SELECT a.trade_id AS left_id, count(*) AS n FROM bar_trades a JOIN bar_trades b ON b.entry_time_ns <= a.entry_time_ns AND b.exit_time_ns > a.entry_time_ns - 1 GROUP BY a.trade_id""", "bar_trades"))
def self_overlap(spark, sf):
    t = bar_trades(spark, sf)
    points = t.select("symbol", F.col("trade_id").alias("left_id"), F.col("entry_time_ns").alias("hi"), (F.col("entry_time_ns") - 1).alias("lo"))
    return interval_join(points, t.select("symbol", "entry_time_ns", "exit_time_ns"), ["symbol"], "lo", "hi", "entry_time_ns", "exit_time_ns", 4 * 3600 * NS).groupBy("left_id").agg(F.count("*").alias("n"))


@query("breadth_cube", "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return table(spark, sf, "customer").join(n, "c_nationkey").cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("breadth_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("breadth_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("breadth_sessions", sql("""--cte g AS (SELECT symbol, time_ns, tick_id, CASE WHEN time_ns - lag(time_ns) OVER (PARTITION BY symbol ORDER BY time_ns, tick_id) < 1800000000000 THEN 0 ELSE 1 END AS s FROM ticks),
    i AS (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY time_ns, tick_id) AS k FROM g) SELECT symbol, min(time_ns) AS start_ns, count(*) AS n FROM i GROUP BY symbol, k""", "ticks"))
def sessions(spark, sf):
    t = ticks(spark, sf).withColumn("at", F.timestamp_micros(F.expr("time_ns div 1000")))
    return t.groupBy("symbol", F.session_window("at", "30 minutes")).agg(F.min("time_ns").alias("start_ns"), F.count("*").alias("n")).select("symbol", "start_ns", "n")
