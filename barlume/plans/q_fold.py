"""Sequential runs (inventory 2.6, A14-A15, G18, U)."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from barlume.operators import bars as B, fold, governor, structure
from barlume.operators.book import Profile, Rules
from barlume.plans.adapters import bars, sql, trades
from barlume.plans.registry import query





def profiles(spark, sf):
    return {r.symbol: Profile(r.symbol) for r in bars(spark, sf, "H1").select("symbol").distinct().collect()}  # a profile per symbol


RULES = Rules(balance=D(10**9), spread_points=2, commission=("PER_LOT_SIDE", D("3.5")), max_margin_percent=D(100))
_ORDERS = """--cte o AS (SELECT symbol, sequence AS n, close_time_ns AS at, close_ticks - 2500 AS stop, close_ticks + 4000 AS target FROM bars WHERE sequence % 20 = 0),
    e AS (SELECT o.*, b.sequence AS s, b.open_ticks + 2 AS entry, b.open_time_ns AS entry_ns, row_number() OVER (PARTITION BY o.symbol, o.n ORDER BY b.sequence) AS k FROM o JOIN bars b ON b.symbol = o.symbol AND b.open_time_ns >= o.at),
    f AS (SELECT * FROM e WHERE k = 1), ok AS (SELECT * FROM f WHERE entry > stop AND entry < target),
    h AS (SELECT ok.symbol, ok.n, min(b.sequence) AS x FROM ok JOIN bars b ON b.symbol = ok.symbol AND b.sequence >= ok.s AND (b.low_ticks <= stop OR b.high_ticks >= target) GROUP BY ALL),
    z AS (SELECT symbol, max(sequence) AS zs, arg_max(close_ticks, sequence) AS zc, max(close_time_ns) AS zt FROM bars GROUP BY symbol),
    t AS (SELECT ok.symbol, ok.n, entry_ns, entry, coalesce(b.close_time_ns, zt) AS exit_ns,
        CASE WHEN b.sequence IS NULL THEN zc WHEN b.low_ticks <= stop THEN least(b.open_ticks, stop) ELSE greatest(b.open_ticks, target) END AS exit_price,
        CASE WHEN b.sequence IS NULL THEN 'end_of_data' WHEN b.low_ticks <= stop THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason, b.sequence IS NOT NULL AND b.low_ticks <= stop AND b.high_ticks >= target AS ambiguous
        FROM ok JOIN z USING (symbol) LEFT JOIN h USING (symbol, n) LEFT JOIN bars b ON b.symbol = ok.symbol AND b.sequence = h.x)"""


def _scripted(spark, sf):
    b = bars(spark, sf, "H1").withColumn("run_id", F.col("symbol"))
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.col("sequence").cast("string")).alias("client"), "symbol", F.lit(True).alias("buy"), F.lit("MARKET").alias("kind"), F.lit("1").alias("lots"), (F.col("close_ticks") - 2500).alias("stop"), (F.col("close_ticks") + 4000).alias("target")))
    commands = b.where("sequence % 20 = 0").select("run_id", F.col("close_time_ns").alias("at_ns"), F.lpad(F.col("sequence").cast("string"), 12, "0").alias("tie"), body.alias("body"))
    return fold.simulate(fold.bar_rows(b).unionByName(fold.command_rows(commands)), RULES, profiles(spark, sf))


@query("b1_b3_b6_fold_single_position", sql(_ORDERS + " SELECT symbol, 'c' || n AS client, entry_ns, entry, exit_ns, exit_price, exit_reason, ambiguous, CAST((exit_price - entry) - 7 AS DOUBLE) AS net_pnl FROM t", "bars:H1"))
def fold_single_position(spark, sf):
    t = fold.trades(_scripted(spark, sf))
    return t.select("symbol", "client", F.col("entry_time_ns").alias("entry_ns"), F.col("entry_price").cast("bigint").alias("entry"), F.col("exit_time_ns").alias("exit_ns"), "exit_price", "exit_reason", "ambiguous", F.col("net_pnl").cast("double").alias("net_pnl"))


@query("b20_b22_order_states", sql(_ORDERS + """ SELECT symbol AS run_id, 'FILLED' AS state, count(*) AS n FROM ok GROUP BY symbol UNION ALL SELECT symbol, 'REJECTED', count(*) FROM f WHERE NOT (entry > stop AND entry < target) GROUP BY symbol
    UNION ALL SELECT o.symbol, 'ACCEPTED', count(*) FROM o LEFT JOIN f USING (symbol, n) WHERE f.n IS NULL GROUP BY o.symbol""", "bars:H1"))
def order_states(spark, sf):
    out = _scripted(spark, sf)
    mine = out.where("kind = 'order.created'").select("run_id", F.col("ref").alias("order_id"))
    return fold.orders(out).join(mine, ["run_id", "order_id"], "left_semi").groupBy("run_id", "state").agg(F.count("*").alias("n"))


@query("b22_transition_errors", "SELECT '' AS before, '' AS state, '' AS run_id, CAST(0 AS BIGINT) AS order_id, CAST(0 AS BIGINT) AS seq WHERE false")
def transition_errors(spark, sf):
    out = _scripted(spark, sf)
    e = out.where("kind like 'order.%' and kind <> 'order.modified'").select("run_id", F.col("ref").alias("order_id"), "seq", F.upper(F.substring("kind", 7, 20)).alias("state"))
    return fold.transition_errors(e)


@query("b26_fold_reports", sql(_ORDERS + """, r AS (SELECT symbol, count(*) AS trades, count(*) FILTER (exit_price - entry - 7 > 0) AS wins, count(*) FILTER (exit_price - entry - 7 < 0) AS losses, CAST(sum(exit_price - entry - 7) AS DOUBLE) AS net_pnl FROM t GROUP BY symbol)
    SELECT symbol AS run_id, (SELECT count(*) FROM bars b WHERE b.symbol = r.symbol) AS bars, trades, wins, losses, net_pnl, 1000000000 + net_pnl AS balance FROM r""", "bars:H1"))
def fold_reports(spark, sf):
    return fold.reports(_scripted(spark, sf)).select("run_id", "bars", "trades", "wins", "losses", F.col("net_pnl").cast("double").alias("net_pnl"), F.col("balance").cast("double").alias("balance"))


def grid(run_id: str) -> dict:
    _, fast, slow = run_id.rsplit("/", 2)
    return {"fast": int(fast), "slow": int(slow)}


def _many(spark, sf):
    sets = F.array(*(F.lit(f"/{a}/{b}") for a in (3, 5, 8) for b in (15, 20, 30)))
    return bars(spark, sf, "M15").withColumn("p", F.explode(sets)).withColumn("run_id", F.concat("symbol", "p")).drop("p")


@query("b_fold_many_runs")
def fold_many_runs(spark, sf):
    out = fold.simulate(fold.bar_rows(_many(spark, sf)), Rules(balance=D(100_000), spread_points=2, sizing=("RISK_PERCENT", D(1)), hedging=False), profiles(spark, sf), "barlume.operators.signals:SmaCross", grid, account_every=50)
    return fold.reports(out)


@query("b4_b7_fold_box_breakout")
def fold_box_breakout(spark, sf):
    b = bars(spark, sf, "M15").withColumn("run_id", F.col("symbol"))
    out = fold.simulate(fold.bar_rows(b), Rules(balance=D(1_000_000), spread_points=2, sizing=("FIXED_CASH", D(500))), profiles(spark, sf), "barlume.operators.signals:BoxBreakout", lambda _: {})
    return fold.trades(out)


@query("u4_chart_commands")
def chart_commands(spark, sf):
    b = bars(spark, sf, "H1").withColumn("run_id", F.concat("symbol", F.lit("/5/20")))
    out = fold.simulate(fold.bar_rows(b), RULES, profiles(spark, sf), "barlume.operators.signals:SmaCross", grid)
    return out.where("kind in ('chart', 'log')").select("run_id", "seq", "time_ns", F.get_json_object("payload", "$.command").alias("command"), "payload")


_SIGNALS = """--cte own AS (SELECT *, nullif(sign(CASE WHEN close_ticks <> open_ticks THEN close_ticks - open_ticks ELSE close_ticks - lag(close_ticks) OVER (PARTITION BY symbol ORDER BY open_time_ns) END), 0) AS s FROM quarters),
    directed AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY open_time_ns ROWS UNBOUNDED PRECEDING), 1) AS d FROM own),
    delta AS (SELECT symbol, open_time_ns - open_time_ns % 3600000000000 AS open_time_ns, sum(d * tick_volume) AS delta FROM directed GROUP BY ALL),
    b AS (SELECT bars.*, delta, row_number() OVER w AS i, lag(open_ticks) OVER w AS po, lag(high_ticks) OVER w AS ph, lag(low_ticks) OVER w AS pl, lag(close_ticks) OVER w AS pc,
        max(high_ticks) OVER v AS sh, min(low_ticks) OVER v AS sl FROM bars JOIN delta USING (symbol, open_time_ns)
        WINDOW w AS (PARTITION BY symbol ORDER BY close_time_ns), v AS (PARTITION BY symbol, open_time_ns // 86400000000000 ORDER BY open_time_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT symbol, i, CASE WHEN pc > po THEN 1 ELSE -1 END AS k, CASE WHEN pc > po THEN greatest(ph, high_ticks) ELSE -least(pl, low_ticks) END AS wick,
        CASE WHEN pc > po THEN greatest(po, pc, open_ticks, close_ticks) ELSE -least(po, pc, open_ticks, close_ticks) END AS body FROM b WHERE (pc > po AND close_ticks < open_ticks) OR (pc < po AND close_ticks > open_ticks)),
    three AS (SELECT b.symbol, b.i, l.k, l.i AS f, l.wick, l.body, CASE WHEN l.k > 0 THEN b.high_ticks ELSE -b.low_ticks END AS reach FROM b JOIN levels l ON l.symbol = b.symbol AND l.i < b.i
        QUALIFY row_number() OVER (PARTITION BY b.symbol, b.i, l.k ORDER BY l.i DESC) <= 3),
    met AS (SELECT t.symbol, t.i, t.k, t.f, any_value(t.wick) AS wick, any_value(t.body) AS body, any_value(t.reach) AS reach, max(CASE WHEN t.k > 0 THEN x.high_ticks ELSE -x.low_ticks END) AS far, max(t.k * x.close_ticks) AS c
        FROM three t LEFT JOIN b x ON x.symbol = t.symbol AND x.i > t.f AND x.i < t.i GROUP BY ALL),
    hunted AS (SELECT symbol, i, arg_max(wick, f) FILTER (k > 0) AS hh, -arg_max(wick, f) FILTER (k < 0) AS hl FROM met WHERE reach > greatest(wick, coalesce(far, wick)) AND coalesce(c <= body, true) GROUP BY symbol, i),
    m AS (SELECT b.*, hh, hl, greatest(open_ticks, close_ticks) AS t, least(open_ticks, close_ticks) AS u FROM b LEFT JOIN hunted USING (symbol, i)),
    n AS (SELECT *, coalesce(delta < 0 AND hl IS NOT NULL AND u - low_ticks > t - u AND u - low_ticks > high_ticks - t AND high_ticks - t < 7 * (t - u), false) AS lr,
        coalesce(delta > 0 AND hh IS NOT NULL AND high_ticks - t > t - u AND high_ticks - t > u - low_ticks AND u - low_ticks < 7 * (t - u), false) AS sr,
        coalesce(delta < 0 AND pc < po AND close_ticks > open_ticks AND low_ticks < sl AND low_ticks < least(po, pc), false) AS le,
        coalesce(delta > 0 AND pc > po AND close_ticks < open_ticks AND high_ticks > sh AND high_ticks > greatest(po, pc), false) AS se FROM m)
    SELECT symbol, close_time_ns, CASE WHEN lr OR le THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN (lr AND le) OR (sr AND se) THEN 'LS_ENGULF' WHEN lr OR sr THEN 'LS' ELSE 'ENGULF' END AS setup,
        CASE WHEN lr OR le THEN low_ticks ELSE high_ticks END AS stop_ticks, CASE WHEN lr OR le THEN t ELSE u END AS cover_stop_ticks, CASE WHEN lr THEN hl WHEN sr THEN hh END AS hunted_ticks FROM n WHERE (lr OR le) <> (sr OR se)"""


@query("a15_structure_signals", sql(_SIGNALS, "bars:H1", "bars:M15:quarters"))
def structure_signals(spark, sf):
    b = bars(spark, sf, "H1")
    half = B.direction(bars(spark, sf, "M15").withColumnRenamed("open_time_ns", "bucket_ns"), "bucket_ns")
    delta = B.volume_delta(half, b, 1).withColumnRenamed("parent_ns", "open_time_ns")
    session = B.session_extremes(b, 0, 1440).select("symbol", "open_time_ns", F.col("high_before").alias("session_high"), F.col("low_before").alias("session_low"))
    rows = b.join(delta, ["symbol", "open_time_ns"]).join(session, ["symbol", "open_time_ns"]).withColumn("parts", F.col("parts") + 6)
    return structure.structure_signals(rows)


@query("g18_risk_governor")
def risk_governor(spark, sf):
    t = trades(spark, sf).withColumns({"leg": (F.col("trade_id") % 2 + 1).cast("int"), "r": F.round(F.col("net_pnl") / F.col("initial_risk"), 4).cast("string")})
    return governor.governed(t)
