"""Scans, as-of, windows, merges, resampling, indicators (inventory 2.1, 2.5, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import bars as B
from barlume.operators.joins import last_n
from barlume.plans.adapters import bar_trades, bars, sql, table, ticks
from barlume.plans.registry import query
from barlume.schema import NS

#: 2024-01-10, -15 and -20 00:00 UTC.
T10, T15, T20 = (1_704_067_200 * NS + d * 86_400 * NS for d in (9, 14, 19))
OHLC = "open_ticks, high_ticks, low_ticks, close_ticks"
BAR = ["symbol", "open_time_ns", *OHLC.split(", ")]


@query("a4_bars_hourly", sql(f"SELECT symbol, timeframe, open_time_ns, close_time_ns, {OHLC}, tick_volume, real_volume, source_spread_points, sequence FROM bars", "bars:H1"))
def bars_hourly(spark, sf):
    return bars(spark, sf, "H1")


_D1 = """SELECT symbol, open_time_ns - open_time_ns % 86400000000000 AS open_time_ns, arg_min(open_ticks, open_time_ns) AS open_ticks, max(high_ticks) AS high_ticks,
    min(low_ticks) AS low_ticks, arg_max(close_ticks, open_time_ns) AS close_ticks, CAST(sum(tick_volume) AS BIGINT) AS tick_volume
    FROM bars GROUP BY symbol, open_time_ns - open_time_ns % 86400000000000"""


@query("l8_bars_daily", sql(_D1, "bars"))
def bars_daily(spark, sf):
    return B.rollup(bars(spark, sf), "D1").select(*BAR, "tick_volume")


@query("s8_scan_range", sql(f"SELECT symbol, open_time_ns, {OHLC} FROM bars WHERE symbol = 'view' AND open_time_ns >= {T10} AND open_time_ns < {T15}", "bars"))
def scan_range(spark, sf):
    return B.scan(bars(spark, sf), "view", T10, T15).select(*BAR)


@query("s9_load_limit", sql(f"SELECT symbol, open_time_ns, {OHLC} FROM bars WHERE symbol = 'view' AND open_time_ns >= {T10} ORDER BY open_time_ns LIMIT 100", "bars"))
def load_limit(spark, sf):
    return B.load(bars(spark, sf), 100, symbol="view", start_ns=T10).select(*BAR)


@query("s10_iter_by_close", sql(f"SELECT symbol, open_time_ns, {OHLC} FROM bars WHERE close_time_ns >= {T10} AND close_time_ns < {T15}", "bars"))
def iter_by_close(spark, sf):
    return B.scan(bars(spark, sf), None, T10, T15, on="close_time_ns").select(*BAR)


@query("s11_available", sql("SELECT DISTINCT symbol, timeframe FROM (SELECT symbol, timeframe FROM bars UNION ALL SELECT symbol, timeframe FROM hours)", "bars", "bars:H1:hours"))
def available(spark, sf):
    return B.available(bars(spark, sf).unionByName(bars(spark, sf, "H1")))


@query("s5_last_open_time", sql("SELECT symbol, arg_max(open_time_ns, sequence) AS last_open_ns FROM bars GROUP BY symbol", "bars"))
def last_open_time(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(F.max_by("open_time_ns", "sequence").alias("last_open_ns"))


@query("a1_latest_closed", sql(f"SELECT symbol, arg_max(open_time_ns, close_time_ns) AS open_time_ns, arg_max(close_ticks, close_time_ns) AS close_ticks FROM bars WHERE close_time_ns <= {T15} GROUP BY symbol", "bars"))
def latest_closed(spark, sf):
    return B.latest_closed(bars(spark, sf), T15).select("symbol", "open_time_ns", "close_ticks")


@query(
    "a1_asof_join",
    sql("SELECT t.trade_id, b.open_time_ns, b.close_ticks FROM bar_trades t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.entry_time_ns >= b.close_time_ns", "bar_trades", "bars"),
)
def asof_trades(spark, sf):
    return B.with_latest_closed(bar_trades(spark, sf), bars(spark, sf), ["open_time_ns", "close_ticks"], "entry_time_ns").select("trade_id", "open_time_ns", "close_ticks")


@query(
    "j5_latest_state",
    sql(
        "SELECT c.tick_id, v.price_ticks AS view_price, v.tick_id AS view_id FROM (SELECT * FROM ticks WHERE symbol = 'click') c ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'view') v ON c.time_ns >= v.time_ns",
        "ticks",
    ),
)
def latest_state(spark, sf):
    from barlume.operators.joins import asof_join

    t = ticks(spark, sf)
    views = t.where("symbol = 'view'").select(F.lit(1).alias("g"), F.col("time_ns").alias("v_ns"), F.col("price_ticks").alias("view_price"), F.col("tick_id").alias("view_id"))
    clicks = t.where("symbol = 'click'").withColumn("g", F.lit(1))
    # one key only: cut by day, so the window is one per day
    return asof_join(clicks, views, ["g"], "time_ns", "v_ns", ["view_price", "view_id"], order=["view_id"], segment_ns=86_400 * NS).select("tick_id", "view_price", "view_id")


@query("a2_last_window", sql(f"SELECT symbol, open_time_ns, {OHLC} FROM bars WHERE close_time_ns <= {T15} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY close_time_ns DESC) <= 20", "bars"))
def last_window(spark, sf):
    return B.window(bars(spark, sf), T15, 20).select(*BAR)


@query(
    "a3_close_batches",
    sql(
        """--cte every AS (SELECT symbol, timeframe, open_time_ns, close_time_ns, close_ticks FROM bars UNION ALL SELECT symbol, timeframe, open_time_ns, close_time_ns, close_ticks FROM hours)
        SELECT close_time_ns, count(*) AS n_bars, string_agg(symbol || '/' || timeframe || '/' || open_time_ns || '/' || close_ticks, ';' ORDER BY symbol, timeframe, open_time_ns) AS members FROM every GROUP BY close_time_ns""",
        "bars",
        "bars:H1:hours",
    ),
)
def close_batches(spark, sf):
    got = B.close_batches(bars(spark, sf), bars(spark, sf, "H1"))
    text = F.array_join(F.transform("bars", lambda b: F.concat_ws("/", b["symbol"], b["timeframe"], b["open_time_ns"].cast("string"), b["close_ticks"].cast("string"))), ";")
    return got.select("close_time_ns", F.size("bars").cast("bigint").alias("n_bars"), text.alias("members"))


_HELD = """--cte held AS (SELECT b.*, h.open_time_ns AS boundary_open_ns, h.close_time_ns AS boundary_close_ns FROM bars b JOIN hours h
        ON b.symbol = h.symbol AND b.open_time_ns >= h.open_time_ns AND b.open_time_ns < h.close_time_ns AND b.close_time_ns <= h.close_time_ns)"""


@query(
    "a5_forming_bars",
    sql(
        _HELD
        + """ SELECT symbol, boundary_open_ns, boundary_close_ns, close_time_ns AS observed_time_ns, first(open_ticks) OVER w AS open_ticks, max(high_ticks) OVER w AS high_ticks,
        min(low_ticks) OVER w AS low_ticks, close_ticks, CAST(sum(tick_volume) OVER w AS BIGINT) AS tick_volume FROM held
        WINDOW w AS (PARTITION BY symbol, boundary_open_ns ORDER BY open_time_ns ROWS UNBOUNDED PRECEDING) QUALIFY close_time_ns < boundary_close_ns""",
        "bars",
        "bars:H4:hours",
    ),
)
def forming_bars(spark, sf):
    return B.forming(bars(spark, sf), bars(spark, sf, "H4"))


@query("a6_boundaries", sql(_HELD + " SELECT symbol, open_time_ns, boundary_open_ns, boundary_close_ns FROM held", "bars", "bars:H4:hours"))
def boundaries(spark, sf):
    return B.boundaries(bars(spark, sf), bars(spark, sf, "H4")).select("symbol", "open_time_ns", "boundary_open_ns", "boundary_close_ns")


@query(
    "a4_forming_at",
    sql(
        f"""SELECT symbol, arg_min(open_ticks, open_time_ns) AS open_ticks, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks, arg_max(close_ticks, open_time_ns) AS close_ticks,
        CAST(sum(tick_volume) AS BIGINT) AS tick_volume, max(close_time_ns) AS observed_time_ns FROM bars WHERE open_time_ns >= {T15} AND close_time_ns <= {T15 + 10 * 3600 * NS} GROUP BY symbol""",
        "bars",
    ),
)
def forming_at(spark, sf):
    return B.forming_at(bars(spark, sf), "D1", T15 + 10 * 3600 * NS).select("symbol", *OHLC.split(", "), "tick_volume", "observed_time_ns")


@query(
    "a7_history",
    sql(
        "SELECT symbol, open_time_ns, string_agg(CAST(close_ticks AS VARCHAR), ',') OVER w AS closes, count(*) OVER w AS known FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ns ROWS 4 PRECEDING)",
        "bars",
    ),
)
def history(spark, sf):
    got = B.history(bars(spark, sf), 5)
    return got.select("symbol", "open_time_ns", F.array_join(F.transform("closes", lambda c: c.cast("string")), ",").alias("closes"), "known")


@query("a7_conflicts", sql("SELECT symbol, price_ticks % 50 AS slot, count(DISTINCT volume) AS variants FROM ticks GROUP BY ALL HAVING count(DISTINCT volume) > 1", "ticks"))
def conflicts(spark, sf):
    t = ticks(spark, sf).select("symbol", F.lit("x").alias("timeframe"), (F.col("price_ticks") % 50).alias("close_time_ns"), *(F.col("volume").alias(c) for c in B.OHLC))
    return B.conflicts(t).select("symbol", F.col("close_time_ns").alias("slot"), "variants")


_M2 = """--cte parts AS (SELECT symbol, open_time_ns - open_time_ns % 1800000000000 AS bucket_ns, arg_min(open_ticks, open_time_ns) AS open_ticks, max(high_ticks) AS high_ticks,
        min(low_ticks) AS low_ticks, arg_max(close_ticks, open_time_ns) AS close_ticks, CAST(sum(tick_volume) AS BIGINT) AS tick_volume
        FROM bars GROUP BY symbol, open_time_ns - open_time_ns % 1800000000000
        HAVING min(open_time_ns) % 1800000000000 = 0 AND max(close_time_ns) % 1800000000000 = 0)"""
_DIRECTED = """, own AS (SELECT *, nullif(sign(CASE WHEN close_ticks <> open_ticks THEN close_ticks - open_ticks ELSE close_ticks - lag(close_ticks) OVER (PARTITION BY symbol ORDER BY bucket_ns) END), 0) AS s FROM parts),
    directed AS (SELECT *, CAST(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket_ns ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS direction FROM own)"""


@query("a8_clock_aligned", sql(_M2 + f" SELECT symbol, bucket_ns, {OHLC}, tick_volume FROM parts", "bars"))
def clock_aligned(spark, sf):
    return B.clock_aligned(bars(spark, sf), 1800).select("symbol", "bucket_ns", *OHLC.split(", "), "tick_volume")


@query("a9_direction", sql(_M2 + _DIRECTED + " SELECT symbol, bucket_ns, direction FROM directed", "bars"))
def directions(spark, sf):
    return B.direction(B.clock_aligned(bars(spark, sf), 1800), "bucket_ns").select("symbol", "bucket_ns", "direction")


@query(
    "a10_volume_delta",
    sql(
        _M2
        + _DIRECTED
        + """ SELECT d.symbol, h.open_time_ns AS parent_ns, CAST(CASE WHEN count(*) >= 3 THEN sum(direction * d.tick_volume) ELSE 0 END AS BIGINT) AS delta, count(*) AS parts
        FROM directed d JOIN hours h ON d.symbol = h.symbol AND bucket_ns >= h.open_time_ns AND bucket_ns + 1800000000000 <= h.close_time_ns GROUP BY d.symbol, h.open_time_ns""",
        "bars",
        "bars:H4:hours",
    ),
)
def volume_delta(spark, sf):
    parts = B.direction(B.clock_aligned(bars(spark, sf), 1800), "bucket_ns").withColumn("close_time_ns", F.col("bucket_ns") + 1800 * NS)
    return B.volume_delta(parts, bars(spark, sf, "H4"), 3)


@query(
    "a11_sma_cross",
    sql(
        """--cte m AS (SELECT symbol, open_time_ns, sum(close_ticks) OVER (PARTITION BY symbol ORDER BY open_time_ns ROWS 4 PRECEDING) * 20 AS a,
        sum(close_ticks) OVER (PARTITION BY symbol ORDER BY open_time_ns ROWS 19 PRECEDING) * 5 AS b, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ns) AS n FROM bars),
        p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM m WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ns))
        SELECT symbol, open_time_ns, CASE WHEN n <= 20 THEN 0 WHEN pa <= pb AND a > b THEN 1 WHEN pa >= pb AND a < b THEN -1 ELSE 0 END AS cross_sign FROM p""",
        "bars",
    ),
)
def sma_cross(spark, sf):
    return B.sma_cross(bars(spark, sf), 5, 20).select("symbol", "open_time_ns", F.col("cross").alias("cross_sign"))


_MINUTE = "CAST(open_time_ns // 60000000000 % 1440 AS INTEGER)"


@query(
    "a12_session_box",
    sql(
        f"""--cte held AS (SELECT *, CAST(make_timestamp(open_time_ns // 1000) AS DATE) AS local_date, {_MINUTE} AS minute FROM bars WHERE {_MINUTE} BETWEEN 90 AND 209)
        SELECT symbol, local_date, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks, 8 - count(DISTINCT minute) AS missing,
        array_to_string(list_filter(range(90, 210, 15), lambda m: NOT list_contains(list(minute), CAST(m AS INTEGER))), ',') AS missing_minutes
        FROM held GROUP BY symbol, local_date""",
        "bars",
    ),
)
def session_box(spark, sf):
    got = B.session_box(bars(spark, sf), 90, 210)
    # minutes sort as numbers
    return got.withColumn("missing_minutes", F.array_join(F.transform(F.array_sort(F.transform(F.filter(F.split("missing_minutes", ","), lambda x: x != ""), lambda x: x.cast("int"))), lambda x: x.cast("string")), ","))


@query(
    "a13_session_extremes",
    sql(
        f"""--cte held AS (SELECT *, CAST(make_timestamp(open_time_ns // 1000) AS DATE) AS local_date FROM bars WHERE {_MINUTE} >= 480 AND {_MINUTE} < 1020)
        SELECT symbol, open_time_ns, max(high_ticks) OVER w AS high_before, min(low_ticks) OVER w AS low_before FROM held
        WINDOW w AS (PARTITION BY symbol, local_date ORDER BY open_time_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "bars",
    ),
)
def session_extremes(spark, sf):
    return B.session_extremes(bars(spark, sf), 480, 1020).select("symbol", "open_time_ns", "high_before", "low_before")


@query("f12_session_membership", sql(f"SELECT symbol, count(*) AS n_bars, count(DISTINCT open_time_ns // 86400000000000) AS n_days FROM bars WHERE {_MINUTE} >= 480 AND {_MINUTE} < 1020 GROUP BY symbol", "bars"))
def session_membership(spark, sf):
    return B.in_session(bars(spark, sf), 480, 1020).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.count_distinct("local_date").alias("n_days"))


@query(
    "f11_candle_shapes",
    sql(
        """--cte s AS (SELECT *, greatest(open_ticks, close_ticks) AS t, least(open_ticks, close_ticks) AS b FROM bars),
        p AS (SELECT symbol, open_time_ns, t - b AS body, high_ticks - t AS upper_shadow, b - low_ticks AS lower_shadow, CAST(sign(close_ticks - open_ticks) AS INTEGER) AS color FROM s)
        SELECT *, lower_shadow > body AND lower_shadow > upper_shadow AND upper_shadow < 7 * body AS long_shape, upper_shadow > body AND upper_shadow > lower_shadow AND lower_shadow < 7 * body AS short_shape FROM p""",
        "bars",
    ),
)
def candle_shapes(spark, sf):
    return bars(spark, sf).select("symbol", "open_time_ns", *(c.alias(n) for n, c in B.shape().items()))


@query(
    "a14_structure_levels",
    sql(
        """--cte c AS (SELECT *, sign(close_ticks - open_ticks) AS s, lag(sign(close_ticks - open_ticks)) OVER w AS ps, lag(high_ticks) OVER w AS ph, lag(low_ticks) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ns))
        SELECT symbol, open_time_ns, CASE WHEN s < 0 THEN 'high' ELSE 'low' END AS kind, CASE WHEN s < 0 THEN greatest(high_ticks, ph) ELSE least(low_ticks, pl) END AS level_ticks FROM c WHERE s * ps < 0""",
        "bars",
    ),
)
def structure_levels(spark, sf):
    return B.structure_levels(bars(spark, sf)).select("symbol", "open_time_ns", "kind", "level_ticks")


@query(
    "a16_downsample",
    sql(
        """--cte r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ns) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
        k AS (SELECT *, CASE WHEN n <= 202 THEN -1 - i WHEN i = 0 THEN -1 WHEN i = n - 1 THEN -2 ELSE (i - 1) * 100 // greatest(n - 2, 1) END AS b FROM r)
        SELECT DISTINCT symbol, open_time_ns, value FROM (SELECT symbol, arg_min(open_time_ns, (close_ticks, i)) AS open_time_ns, min(close_ticks) AS value FROM k GROUP BY symbol, b
        UNION ALL SELECT symbol, arg_max(open_time_ns, (close_ticks, -i)), max(close_ticks) FROM k GROUP BY symbol, b)""",
        "bars",
    ),
)
def downsample(spark, sf):
    return B.downsample(bars(spark, sf), 202).drop("timeframe")


@query(
    "a16_pyramid_view",
    sql(
        f"""--cte i AS (SELECT symbol, timeframe, open_time_ns, close_ticks, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ns) - 1 AS i FROM bars),
        k AS (SELECT symbol, timeframe, i // 16 AS node, min(open_time_ns) AS first_ns, arg_min(close_ticks, open_time_ns) AS first_value, max(open_time_ns) AS last_ns, arg_max(close_ticks, open_time_ns) AS last_value,
            arg_min(open_time_ns, (close_ticks, i)) AS low_ns, min(close_ticks) AS low_value, arg_max(open_time_ns, (close_ticks, -i)) AS high_ns, max(close_ticks) AS high_value FROM i GROUP BY ALL)
        SELECT symbol, node, CAST(first_ns AS BIGINT) AS first_ns, CAST(first_value AS DOUBLE) AS first_value, last_ns, CAST(last_value AS DOUBLE) AS last_value, low_ns, CAST(low_value AS DOUBLE) AS low_value,
            high_ns, CAST(high_value AS DOUBLE) AS high_value FROM k WHERE last_ns >= {T10} AND first_ns <= {T20}""",
        "bars",
    ),
)
def pyramid_view(spark, sf):
    """The fourth level of a stored pyramid, built in blocks of eight, between two times."""
    from barlume.operators import pyramid
    from barlume.sources.shared import shared_path

    stored = pyramid.write(bars(spark, sf), shared_path(spark, "pyramid"), levels=3)
    return pyramid.nodes(stored, spark, 4, T10, T20).drop("timeframe", "level", "n")


@query("a17_extent", "SELECT event_type AS symbol, min(value) AS low, max(value) AS high FROM events WHERE isfinite(value) GROUP BY event_type")
def extent(spark, sf):
    return B.extent(table(spark, sf, "events").withColumnRenamed("event_type", "symbol"), "value")


@query(
    "a19_box_on_or_before",
    sql(
        """--cte days AS (SELECT DISTINCT symbol, CAST(make_timestamp(open_time_ns // 1000) AS DATE) AS local_date FROM bars),
        boxes AS (SELECT symbol, CAST(make_timestamp(open_time_ns // 1000) AS DATE) AS box_date, max(high_ticks) AS high_ticks FROM bars WHERE open_time_ns // 86400000000000 % 3 = 0 GROUP BY ALL)
        SELECT d.symbol, d.local_date, b.box_date, b.high_ticks FROM days d ASOF LEFT JOIN boxes b ON d.symbol = b.symbol AND d.local_date >= b.box_date""",
        "bars",
    ),
)
def box_on_or_before(spark, sf):
    b = bars(spark, sf).withColumn("local_date", B.local_minute()[0])
    boxes = b.where(F.expr("open_time_ns div 86400000000000 % 3 = 0")).groupBy("symbol", "local_date").agg(F.max("high_ticks").alias("high_ticks"))
    return B.boxes_on_or_before(b.select("symbol", "local_date").distinct(), boxes, ["high_ticks"])


@query("a19_keep_days", sql("SELECT symbol, count(*) AS n_bars FROM bars b WHERE open_time_ns >= (SELECT max(open_time_ns) FROM bars x WHERE x.symbol = b.symbol) - 7 * 86400000000000 GROUP BY symbol", "bars"))
def keep_days(spark, sf):
    return B.keep_days(bars(spark, sf), 7).groupBy("symbol").agg(F.count("*").alias("n_bars"))


@query("t1_first_and_last", sql(f"""SELECT * FROM (SELECT 'first' AS side, symbol, open_time_ns, close_ticks FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ns) <= 5)
    UNION ALL SELECT 'last', symbol, open_time_ns, close_ticks FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time_ns DESC) <= 5""", "bars"))
def first_and_last(spark, sf):
    b = bars(spark, sf)
    first = last_n(b.withColumn("__r", -F.col("open_time_ns")), ["symbol"], ["__r"], 5).select(F.lit("first").alias("side"), "symbol", "open_time_ns", "close_ticks")
    return first.unionByName(last_n(b, ["symbol"], ["open_time_ns"], 5).select(F.lit("last").alias("side"), "symbol", "open_time_ns", "close_ticks"))


@query(
    "entry_daily_ranges",
    sql(
        """--cte d AS (SELECT symbol, open_time_ns // 86400000000000 AS day, max(high_ticks) - min(low_ticks) AS range_ticks, arg_max(close_ticks, open_time_ns) AS close_ticks FROM bars GROUP BY ALL)
        SELECT symbol, day, range_ticks, close_ticks - lag(close_ticks) OVER (PARTITION BY symbol ORDER BY day) AS change_ticks FROM d ORDER BY range_ticks DESC, symbol, day LIMIT 20""",
        "bars",
    ),
)
def daily_ranges(spark, sf):
    from pyspark.sql import Window

    d = B.rollup(bars(spark, sf), "D1").select("symbol", F.expr("open_time_ns div 86400000000000").alias("day"), (F.col("high_ticks") - F.col("low_ticks")).alias("range_ticks"), "close_ticks")
    w = Window.partitionBy("symbol").orderBy("day")
    d = d.select("symbol", "day", "range_ticks", (F.col("close_ticks") - F.lag("close_ticks").over(w)).alias("change_ticks"))
    return d.orderBy(F.desc("range_ticks"), "symbol", "day").limit(20)
