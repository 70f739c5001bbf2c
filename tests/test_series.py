"""Helpers and figures on tiny frames, and properties over random ones."""

import random

from pyspark.sql import Window, functions as F

from barlume.functions import pricing, text
from barlume.operators import bars as B, joins, metrics as M, quality, replay

DAY = 86_400 * 10**9


def test_asof_directions_and_segments(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(1000), i) for i in range(200)]
    right = [(rng.choice("ab"), rng.randrange(1000), i) for i in range(80)]
    dl, dr = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, u long, v long")
    for forward in (False, True):
        for inclusive in (False, True):
            for seg in (None, 100):
                got = {r.i: r.u for r in joins.asof_join(dl, dr, ["k"], "t", "u", ["u", "v"], ["v"], inclusive, forward, seg).collect()}
                for k, t, i in left:
                    ok = [u for a, u, _ in right if a == k and ((u >= t if inclusive else u > t) if forward else (u <= t if inclusive else u < t))]
                    assert got[i] == ((min if forward else max)(ok) if ok else None), (forward, inclusive, seg, k, t)


def test_interval_join_is_complete(spark):
    rng = random.Random(4)
    points = [("s", a, a + rng.randint(1, 20), i) for i, a in enumerate(rng.sample(range(3000), 100))]
    spans = [("s", a, a + rng.choice([1, 5, 50, 900, 2900]), i) for i, a in enumerate(rng.sample(range(3000), 60))]
    p, s = spark.createDataFrame(points, "k string, lo long, hi long, i long"), spark.createDataFrame(spans, "k string, a long, b long, j long")
    got = sorted((r.i, r.j) for r in joins.interval_join(p, s, ["k"], "lo", "hi", "a", "b", 2, most=8).collect())
    assert got == sorted((i, j) for _, lo, hi, i in points for _, a, b, j in spans if a <= hi and b > lo)


def trades(spark):
    rows = [(i, "r", "LONG" if i % 2 else "SHORT", a * DAY, b * DAY, n, 1, 2, 0, 0, n + 3, 50, 10, 20, i == 4, "x") for i, (a, b, n) in enumerate([(1, 2, 100), (2, 3, -50), (4, 5, 150), (6, 7, -25)], 1)]
    return spark.createDataFrame(rows, "trade_id long, run string, side string, entry_time_ns long, exit_time_ns long, net_pnl long, commission long, spread_cost long, slippage_cost long, swap long, gross_pnl long, initial_risk long, mae long, mfe long, intrabar_ambiguous boolean, exit_reason string")


def equity(spark):
    return spark.createDataFrame([("r", (i + 1) * DAY, e) for i, e in enumerate([10000, 10100, 10050, 10020, 10200, 10180, 10175])], "run string, time_ns long, equity long")


def test_known_figures(spark):
    p = M.performance(trades(spark), ["run"], 10_000).first()
    assert round(p.profit_factor, 6) == round(250 / 75, 6) and p.net_pnl == 175
    assert M.behavior(trades(spark), ["run"]).first().win_rate_percent == 50
    assert M.costs(trades(spark), ["run"]).first().total_cost == 12
    assert M.risk(equity(spark), ["run"], 10_000).first().max_drawdown_amount == 80
    e = M.episodes(equity(spark), ["run"]).orderBy("start_time_ns").collect()
    assert [(x.start_time_ns // DAY, x.trough_time_ns // DAY, x.recovery_time_ns and x.recovery_time_ns // DAY, x.max_drawdown_amount) for x in e] == [(2, 4, 5, 80), (5, 7, None, 25)]
    assert M.streaks(trades(spark), ["run"]).first()[1:] == (1, 1)
    assert M.exposure(trades(spark), ["run"]).first().stretches == 3


def test_one_point_and_no_trades(spark):
    none, one = trades(spark).limit(0), equity(spark).limit(1)
    assert M.performance(none, ["run"], 1.0).count() == 0 and M.episodes(one, ["run"]).count() == 0
    assert M.rolling(one, ["run"], 10_000).first().sharpe is None
    assert M.histogram(trades(spark).where("trade_id = 1"), F.col("net_pnl"), ["run"]).collect()[0].n == 1


def test_forming_bars(spark):
    h = 3600 * 10**9
    base = spark.createDataFrame([("X", "M1", 0, 60, 10, 12, 9, 11, 100, 0, 0), ("X", "M1", 60, 120, 11, 15, 10, 14, 100, 0, 0)], "symbol string, timeframe string, open_time_ns long, close_time_ns long, open_ticks long, high_ticks long, low_ticks long, close_ticks long, tick_volume long, real_volume long, source_spread_points int")
    targets = spark.createDataFrame([("X", 0, h), ("X", h, 2 * h)], "symbol string, open_time_ns long, close_time_ns long")
    got = B.forming(base, targets).orderBy("observed_time_ns").collect()
    assert [(r.open_ticks, r.high_ticks, r.low_ticks, r.close_ticks, r.tick_volume) for r in got] == [(10, 12, 9, 11, 100), (10, 15, 9, 14, 200)]


def test_state_does_not_depend_on_checkpoints(spark):
    rng = random.Random(5)
    ev = spark.createDataFrame([(rng.randrange(3), rng.randrange(5), rng.randrange(1000), i, rng.randrange(99)) for i in range(300)], "run_id long, entity_id long, time_ns long, source_sequence long, amount long")
    for at in (0, 137, 500, 999):
        a = sorted(map(tuple, replay.state_at(ev, ["run_id", "entity_id"], at).collect()))
        b = sorted(map(tuple, replay.state_at(ev.repartition(5), ["run_id", "entity_id"], at, replay.checkpoints(ev, ["run_id", "entity_id"], 100), 100).collect()))
        assert a == b


def test_prices(spark):
    f = F.lit
    got = spark.range(1).select(
        pricing.price_pnl(f("LONG"), f(260007), f(260100), f(0.5), f(1)), pricing.half_spread_cost(f(7), f(0.5), f(1)), pricing.normalize_volume(f(0.257), f(0.01), f(100.0), f(0.01)), pricing.spread_ticks(f(5), 2)
    ).first()
    assert (got[0], got[1], round(got[2], 6), got[3]) == (46.5, 1.75, 0.25, 3)
    df = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run string, n int, x string")
    assert text.run_digest(df, ["run"], ["n"], F.col("x")).first().digest == text.run_digest(df.orderBy(F.desc("n")), ["run"], ["n"], F.col("x")).first().digest


def test_running_values_do_not_depend_on_segments(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), t, rng.choice([None, *range(9)])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v int")
    w = Window.partitionBy("k").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumns({"n": F.row_number().over(w).cast("long"), "top": F.max("v").over(upto), "held": F.last("v", ignorenulls=True).over(upto), "was": F.lag("v").over(w)})
    values = {"n": ("count", F.lit(1)), "top": ("max", F.col("v")), "held": ("last", F.col("v")), "was": ("lag", F.col("v"))}
    for width in (1, 7, 60, 1000):
        got = joins.running(df, ["k"], ["t"], F.floor(F.col("t") / width), values)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.select(*want.columns).schema.simpleString() == want.schema.simpleString()
    assert joins.running(df.limit(0), ["k"], ["t"], F.col("t"), values).count() == 0


def test_code_counts_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRETCH", 10)
    rows = spark.range(1, 500).selectExpr("'s' AS symbol", "id AS source_row", "CASE WHEN id % 3 = 0 THEN 'x' WHEN id % 70 = 1 THEN 'y' END AS reject_code")
    got = {r.reject_code: (r.rows, r.sample_rows) for r in quality.code_counts(rows, ["symbol"]).collect()}
    assert got == {"x": (166, [3, 6, 9, 12, 15]), "y": (6, [1, 71, 211, 281, 421])}
