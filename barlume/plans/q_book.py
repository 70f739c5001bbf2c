"""Scripted runs whose outcome SQL can tell: entries, groups, sizes, closes, changes, netting, strategies
(inventory 2.6, U)."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal as D

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlume.operators import fold
from barlume.operators.book import Rules
from barlume.plans.adapters import bars, sql
from barlume.plans.q_fold import _ORDERS, RULES, profiles
from barlume.plans.registry import query
from barlume.sources import store
from barlume.sources.shared import shared_path
from barlume.streaming import live

ROOMY = {"balance": D(10**9), "spread_points": 2, "max_margin_percent": D(100)}


def _at(b: DataFrame, when: str, tie: str = "0", **fields: Column | str) -> DataFrame:
    """One command for each bar that fits ``when``, made when the bar closes."""
    made = {"symbol": F.col("symbol")} if "do" not in fields else {}
    values = made | {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    body = F.to_json(F.struct(*(v.alias(k) for k, v in values.items())))
    return b.where(when).select("run_id", F.col("close_time_ns").alias("at_ns"), F.lit(tie).alias("tie"), body.alias("body"))


def _client(letter: str) -> Column:
    return F.concat(F.lit(letter), F.col("sequence").cast("string"))


def _run(b: DataFrame, commands: list[DataFrame], rules: Rules, known: Mapping) -> DataFrame:
    rows = fold.bar_rows(b)
    for c in commands:
        rows = rows.unionByName(fold.command_rows(c))
    return fold.simulate(rows, rules, dict(known))


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf, "H1").withColumn("run_id", F.col("symbol"))


def _ordered(out: DataFrame) -> DataFrame:
    """(run_id, order_id, client) of the orders that commands made."""
    made = out.where("kind = 'order.created'")
    return made.select("run_id", F.col("ref").alias("order_id"), F.get_json_object("payload", "$.client").alias("client"))


def _fills(out: DataFrame) -> DataFrame:
    found = fold.fills(out).select("run_id", "order_id", "time_ns", "price", "reason")
    return _ordered(out).join(found, ["run_id", "order_id"])


@query(
    "b2_b3_pending_fills",
    sql(
        """--cte o AS (SELECT symbol, sequence AS n, sequence % 40 // 10 AS what, close_ticks AS c FROM bars WHERE sequence % 10 = 0),
        p AS (SELECT *, CASE WHEN what IN (0, 3) THEN c - 1500 ELSE c + 1500 END AS price FROM o),
        h AS (SELECT p.symbol, n, min(b.sequence) AS s FROM p JOIN bars b ON b.symbol = p.symbol AND b.sequence > n
            AND CASE what WHEN 0 THEN low_ticks + 2 <= price WHEN 1 THEN high_ticks >= price
                WHEN 2 THEN high_ticks + 2 >= price ELSE low_ticks <= price END GROUP BY ALL)
        SELECT p.symbol, 'c' || n AS client,
            CASE WHEN CASE what WHEN 0 THEN open_ticks + 2 <= price WHEN 1 THEN open_ticks >= price
                WHEN 2 THEN open_ticks + 2 >= price ELSE open_ticks <= price END THEN open_time_ns ELSE close_time_ns END AS time_ns,
            CASE what WHEN 0 THEN least(least(open_ticks + 2, price) + 5, price) WHEN 1 THEN greatest(greatest(open_ticks, price) - 5, price)
                WHEN 2 THEN greatest(open_ticks + 2, price) + 3 ELSE least(open_ticks, price) - 3 END AS price,
            CASE WHEN what < 2 THEN 'limit_fill' ELSE 'stop_fill' END AS reason
        FROM p JOIN h USING (symbol, n) JOIN bars b ON b.symbol = p.symbol AND b.sequence = h.s""",
        "bars:H1",
    ),
)
def pending_fills(spark, sf):
    """Limits and stops of both sides: touch, gap, slippage, which takes no limit beyond its price."""
    b = _hourly(spark, sf)
    kinds = (("LIMIT", True, -1500), ("LIMIT", False, 1500), ("STOP", True, 1500), ("STOP", False, -1500))
    commands = [
        _at(b, f"sequence % 40 = {10 * i}", client=_client("c"), buy=F.lit(buy), kind=kind, lots="1", price=F.col("close_ticks") + away)
        for i, (kind, buy, away) in enumerate(kinds)
    ]
    out = _run(b, commands, Rules(**ROOMY, slip_limit=5, slip_stop=3), profiles(spark, sf))
    return _fills(out).select(F.col("run_id").alias("symbol"), "client", "time_ns", "price", "reason")


@query(
    "b4_one_cancels_other",
    sql(
        """--cte o AS (SELECT symbol, sequence AS n, close_ticks + 1500 AS up, close_ticks - 1500 AS down FROM bars WHERE sequence % 20 = 0),
        h AS (SELECT o.symbol, n, min(b.sequence) AS s FROM o JOIN bars b ON b.symbol = o.symbol AND b.sequence > n
            AND (high_ticks + 2 >= up OR low_ticks <= down) GROUP BY ALL),
        x AS (SELECT o.symbol, n, CASE WHEN open_ticks + 2 >= up THEN 'u' WHEN open_ticks <= down THEN 'd'
                WHEN high_ticks + 2 >= up AND low_ticks <= down THEN '' WHEN high_ticks + 2 >= up THEN 'u' ELSE 'd' END AS won,
            CASE WHEN open_ticks + 2 >= up OR open_ticks <= down THEN open_time_ns ELSE close_time_ns END AS time_ns
            FROM o JOIN h USING (symbol, n) JOIN bars b ON b.symbol = o.symbol AND b.sequence = h.s)
        SELECT x.symbol, side || n AS client, CASE WHEN won = side THEN 'FILLED' ELSE 'CANCELLED' END AS state,
            CASE won WHEN side THEN 'stop_fill' WHEN '' THEN 'oco_intrabar_ambiguous' ELSE 'oco_sibling_terminal' END AS reason, time_ns
        FROM x, (VALUES ('u'), ('d')) s(side)""",
        "bars:H1",
    ),
)
def one_cancels_other(spark, sf):
    """A buy stop above and a sell stop below in one group: the first to be touched, none where a bar touches both."""
    b = _hourly(spark, sf)
    extra = F.struct(_client("g").alias("oco"), F.lit(True).alias("oco_cancel_all"))
    commands = [
        _at(b, "sequence % 20 = 0", tie, client=_client(tie), buy=F.lit(buy), kind="STOP", lots="1", price=F.col("close_ticks") + away, extra=extra)
        for tie, buy, away in (("u", True, 1500), ("d", False, -1500))
    ]
    out = _run(b, commands, Rules(**ROOMY), profiles(spark, sf))
    ended = _ordered(out).join(fold.orders(out).where("state in ('FILLED', 'CANCELLED')"), ["run_id", "order_id"])
    return ended.select(F.col("run_id").alias("symbol"), "client", "state", "reason", "time_ns")


@query(
    "b5_b7_stop_and_reverse",
    sql(
        _ORDERS
        + """, r AS (SELECT t.symbol, t.n, t.exit_ns AS e_ns, t.exit_price AS e, h.x, o.stop + 3000 AS rs, t.exit_price - 2 * (o.stop + 3000 - t.exit_price) AS rt
            FROM t JOIN o USING (symbol, n) JOIN h USING (symbol, n) WHERE exit_reason = 'stop_loss'),
        g AS (SELECT r.symbol, r.n, min(b.sequence) AS y FROM r JOIN bars b ON b.symbol = r.symbol AND b.sequence > x
            AND (high_ticks + 2 >= rs OR low_ticks + 2 <= rt) GROUP BY ALL)
        SELECT symbol, 'k' || n AS chain, 'LONG' AS side, entry_ns, CAST(entry AS BIGINT) AS entry, exit_ns, exit_price, exit_reason FROM t
        UNION ALL SELECT r.symbol, 'k' || r.n, 'SHORT', e_ns, e, coalesce(b.close_time_ns, zt),
            CASE WHEN b.sequence IS NULL THEN zc + 2 WHEN high_ticks + 2 >= rs THEN greatest(open_ticks + 2, rs) ELSE least(open_ticks + 2, rt) END,
            CASE WHEN b.sequence IS NULL THEN 'end_of_data' WHEN high_ticks + 2 >= rs THEN 'stop_loss' ELSE 'take_profit' END
        FROM r JOIN z USING (symbol) LEFT JOIN g USING (symbol, n) LEFT JOIN bars b ON b.symbol = r.symbol AND b.sequence = g.y""",
        "bars:H1",
    ),
)
def stop_and_reverse(spark, sf):
    """Longs that turn at their stop: a short at the stop's price, its target twice the distance to its own stop."""
    b = _hourly(spark, sf)
    c = F.col("close_ticks")
    extra = F.struct((c + 500).alias("reverse_stop"), F.lit("2").alias("reverse_reward"), _client("k").alias("chain"))
    command = _at(b, "sequence % 20 = 0", client=_client("c"), buy=F.lit(True), kind="MARKET", lots="1", stop=c - 2500, target=c + 4000, extra=extra)
    t = fold.trades(_run(b, [command], Rules(**ROOMY), profiles(spark, sf)))
    entry = F.col("entry_price").cast("bigint").alias("entry")
    return t.select("symbol", "chain", "side", F.col("entry_time_ns").alias("entry_ns"), entry, F.col("exit_time_ns").alias("exit_ns"), "exit_price", "exit_reason")


@query(
    "b8_b19_execution_resize",
    sql(
        """--cte o AS (SELECT symbol, sequence AS n, close_ticks - 2500 AS stop FROM bars WHERE sequence % 20 = 0),
        e AS (SELECT o.*, b.open_ticks + 2 AS entry, b.open_time_ns AS time_ns FROM o JOIN bars b ON b.symbol = o.symbol AND b.sequence = n + 1)
        SELECT symbol, time_ns, entry, CAST(least(100000 // (entry - stop), 10000) AS DOUBLE) / 100 AS lots, entry + (3 * (entry - stop) + 1) // 2 AS target
        FROM e WHERE entry > stop AND 100000 // (entry - stop) >= 1""",
        "bars:H1",
    ),
)
def execution_resize(spark, sf):
    """Size (1,000 at risk) and target (1.5 times the risk) follow from the price of execution."""
    b = _hourly(spark, sf)
    extra = F.struct(F.lit("1.5").alias("reward_risk"))
    command = _at(b, "sequence % 20 = 0", client=_client("c"), buy=F.lit(True), kind="MARKET", lots="1", stop=F.col("close_ticks") - 2500, extra=extra)
    out = _run(b, [command], Rules(**ROOMY, sizing=("FIXED_CASH", D(1000))), profiles(spark, sf))
    p = F.from_json("payload", "price bigint, lots string, target bigint")
    opened = out.where("kind = 'position.opened'").select(F.col("run_id").alias("symbol"), "time_ns", p.alias("p"))
    return opened.select("symbol", "time_ns", F.col("p.price").alias("entry"), F.col("p.lots").cast("double").alias("lots"), "p.target")


@query(
    "b9_capacity",
    sql(
        """--cte o AS (SELECT symbol, sequence AS n, sequence % 20 = 0 AS buy, row_number() OVER (PARTITION BY symbol, sequence % 20 ORDER BY sequence) AS k,
            sequence < max(sequence) OVER (PARTITION BY symbol) AS runs FROM bars QUALIFY n % 10 = 0)
        SELECT symbol, 'c' || n AS client, CASE WHEN NOT runs THEN 'ACCEPTED' WHEN buy AND k <= 3 THEN 'FILLED' ELSE 'REJECTED' END AS state,
            CASE WHEN NOT runs THEN NULL WHEN NOT buy THEN 'short trading is disabled' WHEN k <= 3 THEN 'market_open' ELSE 'max_open_positions exceeded' END AS reason FROM o""",
        "bars:H1",
    ),
)
def capacity(spark, sf):
    """Three positions at most and no shorts."""
    b = _hourly(spark, sf)
    command = _at(b, "sequence % 10 = 0", client=_client("c"), buy=F.expr("sequence % 20 = 0"), kind="MARKET", lots="1")
    out = _run(b, [command], Rules(**ROOMY, max_positions=3, allow_short=False), profiles(spark, sf))
    last = _ordered(out).join(fold.orders(out), ["run_id", "order_id"])
    return last.select(F.col("run_id").alias("symbol"), "client", "state", "reason")


@query(
    "b10_netting",
    sql(
        """--cte e AS (SELECT o.symbol, o.sequence AS n, o.sequence // 80 AS cycle, o.sequence % 80 // 20 AS leg, b.open_ticks AS bid, b.open_time_ns AS ns
            FROM bars o JOIN bars b ON b.symbol = o.symbol AND b.sequence = o.sequence + 1 WHERE o.sequence % 20 = 0),
        w AS (SELECT a.symbol, a.n, a.bid + 2 AS e0, a.ns AS t0, b.bid + 2 AS e1, c.bid AS e2, c.ns AS t2, c.n AS n2, d.bid + 2 AS e3, d.ns AS t3
            FROM e a JOIN e b ON b.symbol = a.symbol AND b.cycle = a.cycle AND b.leg = 1 JOIN e c ON c.symbol = a.symbol AND c.cycle = a.cycle AND c.leg = 2
            LEFT JOIN e d ON d.symbol = a.symbol AND d.cycle = a.cycle AND d.leg = 3 WHERE a.leg = 0)
        SELECT symbol, 'c' || n AS client, 'LONG' AS side, CAST(2 AS DOUBLE) AS lots, t0 AS entry_ns, CAST(e0 + e1 AS DOUBLE) / 2 AS entry, t2 AS exit_ns, e2 AS exit_price,
            CAST(2 * e2 - e0 - e1 - 14 AS DOUBLE) AS net_pnl FROM w
        UNION ALL SELECT symbol, 'c' || n2, 'SHORT', CAST(1 AS DOUBLE), t2, CAST(e2 AS DOUBLE), t3, e3, CAST(e2 - e3 - 7 AS DOUBLE) FROM w WHERE e3 IS NOT NULL""",
        "bars:H1",
    ),
)
def netting(spark, sf):
    """One net position a symbol: two buys at their mean price, a sale that turns it, a buy that closes it."""
    b = _hourly(spark, sf)
    lots = F.when(F.expr("sequence % 80 = 40"), "3").otherwise("1")
    command = _at(b, "sequence % 20 = 0", client=_client("c"), buy=F.expr("sequence % 80 <> 40"), kind="MARKET", lots=lots)
    out = _run(b, [command], Rules(**ROOMY, hedging=False, commission=("PER_LOT_SIDE", D("3.5"))), profiles(spark, sf))
    t = fold.trades(out).where("exit_reason = 'netting_reduction'")
    numbers = [F.col(c).cast("double").alias(name) for c, name in (("lots", "lots"), ("entry_price", "entry"), ("net_pnl", "net_pnl"))]
    return t.select("symbol", "client", "side", F.col("entry_time_ns").alias("entry_ns"), F.col("exit_time_ns").alias("exit_ns"), "exit_price", *numbers)


@query(
    "b11_b23_partial_close",
    sql(
        """--cte o AS (SELECT o.symbol, o.sequence AS n, b.open_ticks + 2 AS entry FROM bars o JOIN bars b ON b.symbol = o.symbol AND b.sequence = o.sequence + 1 WHERE o.sequence % 40 = 0),
        z AS (SELECT symbol, max(sequence) AS zs, arg_max(close_ticks, sequence) AS zc, max(close_time_ns) AS zt FROM bars GROUP BY symbol),
        x AS (SELECT o.*, b.open_ticks AS price, b.open_time_ns AS ns FROM o LEFT JOIN bars b ON b.symbol = o.symbol AND b.sequence = n + 21)
        SELECT symbol, 'c' || n AS client, 0.5::DOUBLE AS lots, ns AS exit_ns, price AS exit_price, 'strategy_exit' AS exit_reason, (price - entry) / 2.0::DOUBLE - 3.5::DOUBLE AS net_pnl
        FROM x WHERE price IS NOT NULL
        UNION ALL SELECT symbol, 'c' || n, CASE WHEN price IS NULL THEN 2 ELSE 1.5 END::DOUBLE, zt, zc, 'end_of_data',
            CASE WHEN price IS NULL THEN 2 * (zc - entry) - 14 ELSE 1.5 * (zc - entry) - 10.5 END::DOUBLE FROM x JOIN z USING (symbol)""",
        "bars:H1",
    ),
)
def partial_close(spark, sf):
    """A quarter of each position is closed, with its share of the costs; the end of the data closes the rest."""
    b = _hourly(spark, sf)
    position = F.expr("cast((sequence - 20) div 40 + 1 as bigint)")
    commands = [
        _at(b, "sequence % 40 = 0", client=_client("c"), buy=F.lit(True), kind="MARKET", lots="2"),
        _at(b, "sequence % 40 = 20", client=_client("x"), buy=F.lit(False), kind="MARKET", lots="0.5", reduce_only=F.lit(True), position=position),
    ]
    t = fold.trades(_run(b, commands, Rules(**ROOMY, commission=("PER_LOT_SIDE", D("3.5"))), profiles(spark, sf)))
    lots, net = F.col("lots").cast("double").alias("lots"), F.col("net_pnl").cast("double").alias("net_pnl")
    return t.select("symbol", "client", lots, F.col("exit_time_ns").alias("exit_ns"), "exit_price", "exit_reason", net)


@query(
    "b12_protection_orders",
    sql(
        _ORDERS
        + """, p AS (SELECT symbol, unnest(['STOP', 'LIMIT']) AS order_type, exit_reason FROM t)
        SELECT symbol, order_type, CASE WHEN w THEN 'FILLED' ELSE 'CANCELLED' END AS state,
            CASE WHEN w THEN exit_reason ELSE 'protection_replaced_or_position_closed' END AS reason, count(*) AS n
        FROM (SELECT *, exit_reason = CASE order_type WHEN 'STOP' THEN 'stop_loss' ELSE 'take_profit' END AS w FROM p) GROUP BY ALL""",
        "bars:H1",
    ),
)
def protection_orders(spark, sf):
    """How the stops and targets of positions end: the one that closes is filled, the other withdrawn."""
    b = _hourly(spark, sf)
    c = F.col("close_ticks")
    command = _at(b, "sequence % 20 = 0", client=_client("c"), buy=F.lit(True), kind="MARKET", lots="1", stop=c - 2500, target=c + 4000)
    out = _run(b, [command], Rules(**ROOMY), profiles(spark, sf))
    p = F.from_json("payload", "owned string, order_type string, reason string")
    ended = out.where("kind in ('order.filled', 'order.cancelled')").select(F.col("run_id").alias("symbol"), F.upper(F.substring("kind", 7, 20)).alias("state"), p.alias("p"))
    return ended.where("p.owned = 'protection'").groupBy("symbol", "p.order_type", "state", "p.reason").agg(F.count("*").alias("n"))


@query(
    "b21_modify_cancel",
    sql(
        """--cte o AS (SELECT a.symbol, a.sequence AS n, a.close_ticks - 6000 AS p0, m.close_ticks - 1500 AS p1, x.close_time_ns AS gone
            FROM bars a LEFT JOIN bars m ON m.symbol = a.symbol AND m.sequence = a.sequence + 10 LEFT JOIN bars x ON x.symbol = a.symbol AND x.sequence = a.sequence + 20
            WHERE a.sequence % 40 = 0),
        h AS (SELECT o.symbol, n, min(b.sequence) AS s FROM o JOIN bars b ON b.symbol = o.symbol AND b.sequence BETWEEN n + 1 AND n + 20
            AND low_ticks + 2 <= CASE WHEN b.sequence <= n + 10 THEN p0 ELSE p1 END GROUP BY ALL),
        f AS (SELECT o.*, b.sequence AS s, open_ticks + 2 AS ask, open_time_ns, close_time_ns, CASE WHEN s <= n + 10 THEN p0 ELSE p1 END AS p
            FROM o LEFT JOIN h USING (symbol, n) LEFT JOIN bars b ON b.symbol = o.symbol AND b.sequence = h.s)
        SELECT symbol, 'c' || n AS client, CASE WHEN s IS NULL THEN 'CANCELLED' ELSE 'FILLED' END AS state, CASE WHEN s IS NULL THEN 'requested' ELSE 'limit_fill' END AS reason,
            CASE WHEN s IS NULL THEN gone WHEN ask <= p THEN open_time_ns ELSE close_time_ns END AS time_ns, CASE WHEN s IS NOT NULL THEN least(ask, p) END AS price
        FROM f WHERE s IS NOT NULL OR gone IS NOT NULL""",
        "bars:H1",
    ),
)
def modify_cancel(spark, sf):
    """Limits that get a nearer price after ten bars and are withdrawn after twenty."""
    b = _hourly(spark, sf)
    order = F.expr("cast(sequence div 40 + 1 as bigint)")
    commands = [
        _at(b, "sequence % 40 = 0", client=_client("c"), buy=F.lit(True), kind="LIMIT", lots="1", price=F.col("close_ticks") - 6000),
        _at(b, "sequence % 40 = 10", do="modify", order_id=order, price=F.col("close_ticks") - 1500),
        _at(b, "sequence % 40 = 20", do="cancel", order_id=order),
    ]
    out = _run(b, commands, Rules(**ROOMY), profiles(spark, sf))
    ended = _ordered(out).join(fold.orders(out).where("state in ('FILLED', 'CANCELLED')"), ["run_id", "order_id"])
    prices = fold.fills(out).select("run_id", "order_id", "price")
    return ended.join(prices, ["run_id", "order_id"], "left").select(F.col("run_id").alias("symbol"), "client", "state", "reason", "time_ns", "price")


# --- strategies ------------------------------------------------------------------------------------------

_TRADES = _ORDERS + " SELECT symbol, 'c' || n AS client, entry_ns, CAST(entry AS BIGINT) AS entry, exit_ns, exit_price, exit_reason FROM t"


def _columns(t: DataFrame) -> DataFrame:
    entry = F.col("entry_price").cast("bigint").alias("entry")
    return t.select("symbol", "client", F.col("entry_time_ns").alias("entry_ns"), entry, F.col("exit_time_ns").alias("exit_ns"), "exit_price", "exit_reason")


class Every(fold.Strategy):
    """Buys after every n-th bar of a series, by what the market shows; logs the order of its callbacks."""

    def on_start(self, context):
        self.calls = {"bars": 0, "orders": 0}
        context.log("info", "start")

    def on_bar(self, context, bar):
        self.calls["bars"] += 1
        last = context.market.latest(bar.symbol, bar.timeframe)
        if last.sequence == self.parameters.get("fail_at"):
            raise ArithmeticError("asked to fail")
        if last.sequence % self.parameters["every"] == 0:
            context.order(bar.symbol, True, D(1), client=f"c{last.sequence}", stop=last.close_ticks - 2500, target=last.close_ticks + 4000)

    def on_order(self, context, kind, ref, values):
        self.calls["orders"] += kind == "fill"

    def on_stop(self, context, reason):
        context.log("info", "stop", reason=reason, held=context.market.count("view", "H1"), **self.calls)


def every(run_id: str) -> dict:
    return {"every": 20} | ({"fail_at": 30} if run_id == "view" else {})


_PATH = "barlume.plans.q_book:Every"


@query("u1_u5_strategy_orders", sql(_TRADES, "bars:H1"))
def strategy_orders(spark, sf):
    """A strategy loaded by name trades like the script of the same orders."""
    b = _hourly(spark, sf)
    return _columns(fold.trades(fold.simulate(fold.bar_rows(b), RULES, profiles(spark, sf), _PATH, lambda _: {"every": 20})))


@query(
    "u7_callbacks",
    sql(
        _ORDERS
        + """, n AS (SELECT symbol, 2 * count(*) AS fills FROM t GROUP BY symbol)
        SELECT b.symbol AS run_id, 'start' AS message, CAST(NULL AS BIGINT) AS bars, CAST(NULL AS BIGINT) AS orders FROM bars b GROUP BY ALL
        UNION ALL SELECT b.symbol, 'stop', count(*), any_value(coalesce(fills, 0)) FROM bars b LEFT JOIN n USING (symbol) GROUP BY ALL""",
        "bars:H1",
    ),
)
def callbacks(spark, sf):
    """What a strategy has been called for: start, every bar, every fill, stop."""
    out = fold.simulate(fold.bar_rows(_hourly(spark, sf)), RULES, profiles(spark, sf), _PATH, lambda _: {"every": 20})
    said = F.from_json("payload", "message string, bars bigint, orders bigint")
    return out.where("kind = 'log'").select("run_id", said.alias("p")).select("run_id", "p.*")


@query(
    "u6_failed_runs",
    sql(
        "SELECT symbol AS run_id, CASE WHEN symbol = 'view' THEN 'run.failed' ELSE 'report' END AS kind, CASE WHEN symbol = 'view' THEN 'asked to fail' END AS message FROM bars GROUP BY symbol",
        "bars:H1",
    ),
)
def failed_runs(spark, sf):
    """A strategy that raises ends its own run; the others report."""
    out = fold.simulate(fold.bar_rows(_hourly(spark, sf)), RULES, profiles(spark, sf), _PATH, every)
    return out.where("kind in ('run.failed', 'report')").select("run_id", "kind", F.get_json_object("payload", "$.message").alias("message"))


@query("l9_stream_scripted", sql(_TRADES + " WHERE exit_reason <> 'end_of_data'", "bars:H1"))
def stream_scripted(spark, sf):
    """The script's trades from a stream of three files, with the run's state kept between them."""
    b = _hourly(spark, sf)
    c = F.col("close_ticks")
    command = _at(b, "sequence % 20 = 0", client=_client("c"), buy=F.lit(True), kind="MARKET", lots="1", stop=c - 2500, target=c + 4000)
    rows = fold.bar_rows(b).unionByName(fold.command_rows(command))
    path, out = shared_path(spark, "scripted"), shared_path(spark, "scripted-out")
    first, last = b.agg(F.min("close_time_ns"), F.max("close_time_ns")).first()
    third = (last - first) // 3
    for lo, hi in ((0, first + third), (first + third, first + 2 * third), (first + 2 * third, 2**63 - 1)):
        rows.where((F.col("at_ns") >= lo) & (F.col("at_ns") < hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.run_to_end(live.live_runs(stream, RULES, profiles(spark, sf)), out)
    return _columns(fold.trades(spark.read.parquet(out)))


@query(
    "s16_packages",
    """SELECT * FROM (VALUES ('a', '1', 'usable'), ('e', '2', 'usable'), ('a', '', 'repeated id'), ('c', '', 'path leaves its folder'),
        ('d', '', 'entry must be module:object')) v(id, version, verdict)""",
)
def packages(spark, sf):
    entries = [
        {"id": "a", "version": "1", "entry": "m:O"},
        {"id": "a", "version": "2", "entry": "m:O"},
        {"id": "b", "version": "1", "entry": "m:O", "enabled": False},
        {"id": "c", "version": "1", "entry": "m:O", "path": "../x"},
        {"id": "d", "version": "1", "entry": "m"},
        {"id": "e", "version": "2", "entry": "m:O", "path": "x/y"},
    ]
    usable, problems = store.packages(entries)
    rows = [(e["id"], e["version"], "usable") for e in usable] + [(*p.split(": ", 1)[:1], "", p.split(": ", 1)[1]) for p in problems]
    return spark.createDataFrame(rows, "id string, version string, verdict string")
