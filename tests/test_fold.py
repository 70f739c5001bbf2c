"""Folds: any dealing of the rows and a stream give the same as one batch."""

from decimal import Decimal as D

import pandas as pd
from pyspark.sql import functions as F

from barlume.operators import enrich, fold, governor, signals, structure
from barlume.operators.book import Profile, Rules
from barlume.plans import adapters
from barlume.plans.q_fold import grid, profiles
from barlume.streaming import live

SF = "/root/testdata/sf0.001"
SMA = "barlume.operators.signals:SmaCross"


def rows(spark):
    return fold.bar_rows(adapters.bars(spark, SF, "H1").withColumn("run_id", F.concat("symbol", F.lit("/3/10"))))


def test_dealing_does_not_matter(spark):
    p = profiles(spark, SF)
    rules = Rules(spread_points=2, hedging=False)
    a = sorted(map(tuple, fold.simulate(rows(spark), rules, p, SMA, grid).collect()))
    b = sorted(map(tuple, fold.simulate(rows(spark).repartition(7), rules, p, SMA, grid).collect()))
    assert a == b and len(a) > 500


def test_stream_equals_batch(spark, tmp_path):
    p, r = profiles(spark, SF), rows(spark)
    cut = r.agg(F.expr("percentile(at_ns, 0.5)")).first()[0]
    for part in (r.where(F.col("at_ns") < cut), r.where(F.col("at_ns") >= cut)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rules = Rules(spread_points=2, hedging=False)
    live.run_to_end(live.live_runs(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), rules, p, SMA, grid), f"{tmp_path}/out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, fold.simulate(r, rules, p, SMA, grid, liquidate=False).where("kind <> 'report'").collect()))
    assert got == want


def test_commands_and_typed_outputs(spark):
    bars = pd.DataFrame([("r", "X", "M1", i * 60, (i + 1) * 60, 1000 + i, 1010 + i, 990 + i, 1001 + i, 0, i) for i in range(6)], columns=["run_id", *fold.BAR])
    b = spark.createDataFrame(bars)
    c = spark.createDataFrame([("r", 60, "1", '{"client":"a","symbol":"X","buy":true,"kind":"MARKET","lots":"2"}'), ("r", 120, "1", '{"do":"protect","position_id":1,"stop":900,"target":2000}'), ("r", 180, "1", '{"do":"close","position":1}'), ("r", 240, "1", '{"do":"cancel","order_id":99}')], "run_id string, at_ns long, tie string, body string")
    out = fold.simulate(fold.bar_rows(b).unionByName(fold.command_rows(c)), Rules(), {"X": Profile("X", contract=D(1))}).cache()
    t = fold.trades(out).first()
    assert (t.entry_price, t.exit_price, t.net_pnl, t.exit_reason) == (D(1001), 1003, D(4), "strategy_exit")
    assert fold.fills(out).count() == 2 and fold.equity(out).count() == 6
    assert out.where("kind = 'command.refused'").count() == 1
    states = {r.order_id: r.state for r in fold.orders(out).collect()}
    assert sorted(states.values()) == ["CANCELLED", "CANCELLED", "FILLED", "FILLED"]


def test_excursions_of_the_fold_equal_the_set_wise_ones(spark):
    bars = adapters.bars(spark, SF, "H1").where("symbol = 'view'").withColumn("run_id", F.lit("v"))
    orders = bars.where("sequence % 15 = 0").select("run_id", F.col("close_time_ns").alias("at_ns"), F.lpad(F.col("sequence").cast("string"), 9, "0").alias("tie"), F.to_json(F.struct(F.concat(F.lit("c"), F.col("sequence").cast("string")).alias("client"), "symbol", (F.col("sequence") % 2 == 0).alias("buy"), F.lit("MARKET").alias("kind"), F.lit("1").alias("lots"))).alias("body"))
    out = fold.simulate(fold.bar_rows(bars).unionByName(fold.command_rows(orders)), Rules(balance=D(10**9)), {"view": Profile("view", contract=D(1))})
    t = fold.trades(out).cache()
    as_set = t.select(F.col("trade_id"), "symbol", "side", (F.col("entry_time_ns") + 1).alias("entry_time_ns"), "exit_time_ns", F.col("entry_price").cast("bigint").alias("entry_price_ticks"))
    got = {r.trade_id: (r.mae_ticks, r.mfe_ticks) for r in enrich.excursions(as_set, bars, 3600 * 10**9).collect()}
    mine = {r.trade_id: (int(r.mae), int(r.mfe)) for r in t.collect()}
    assert got == mine and len(mine) > 5


def test_governor_limits():
    g = governor.Governor()
    day = (2024, 1, 3)
    assert g.ask(day) == (True, True, "allowed")
    for _ in range(4):
        g.opened(day)
    assert g.ask(day) == (True, False, "allowed")
    g.opened(day)
    assert g.ask(day)[2] == "daily_halt"
    g.closed((2024, 1, 4), D(-4), 1, False)
    assert g.ask((2024, 1, 4))[2] == "daily_halt"
    g.closed((2024, 1, 4), D(2), 1, False)
    assert g.ask((2024, 1, 4))[2] == "daily_halt"  # once over budget, over for the day
    g.closed((2024, 1, 5), D(-5), 1, False)
    g.closed((2024, 1, 5), D(6), 2, False)
    assert g.ask((2024, 1, 5))[2] == "daily_halt" and g.ask((2024, 1, 6))[2] == "allowed"
    g.closed((2024, 1, 8), D("-3.5"), 1, False)
    g.closed((2024, 1, 9), D("-2.5"), 1, False)
    assert g.ask((2024, 1, 9))[2] == "monthly_minus_seven_day_pause" and g.ask((2024, 1, 10)) == (True, False, "allowed")
    g.closed((2024, 1, 10), D("-0.5"), 1, False)
    assert g.ask((2024, 1, 11)) == (False, False, "monthly_risk_reservation")
    g.closed((2024, 2, 1), D(6), 1, True)
    assert g.ask((2024, 2, 1))[2] == "monthly_plus_six_pause" and g.ask((2024, 2, 15))[0]
    g.closed((2024, 2, 15), D(2), 1, True)
    assert g.ask((2024, 2, 16))[2] == "monthly_halt"
    g.closed((2024, 3, 1), D(1), 1, True)
    g.closed((2024, 3, 1), D(1), 1, True)
    assert g.ask((2024, 3, 1))[2] == "daily_halt"
    g.closed((2024, 4, 1), D("-3.5"), 1, False)
    assert g.ask((2024, 4, 1))[2] == "daily_risk_reservation"


def test_structure_hunt(spark):
    """A high at 115 is hunted by the bar beyond it, not by one short of the reach since; a close beyond the bodies ends it."""
    rows = [
        (1, 100, 112, 99, 110, 0, 0), (2, 110, 115, 100, 101, 0, 0), (3, 101, 120, 100, 103, 5, 9), (4, 103, 119, 102, 104, 5, 9),
        (5, 104, 125, 103, 124, 5, 9), (6, 124, 160, 123, 125, 5, 9), (7, 125, 126, 90, 124, 0, 9),
    ]
    bars = spark.createDataFrame([("X", *r, None, None) for r in rows], "symbol string, close_time_ns long, open_ticks long, high_ticks long, low_ticks long, close_ticks long, delta long, parts long, session_high long, session_low long")
    got = [tuple(r)[1:] for r in structure.structure_signals(bars).orderBy("close_time_ns").collect()]
    assert got == [(3, "SHORT", "LS", 120, 101, 115)]
    # with four parts the delta is not known
    assert structure.structure_signals(bars.withColumn("parts", F.lit(4))).count() == 0


class Watcher(signals.Strategy):
    """Logs what each callback can see."""

    def on_bar(self, context, bar):
        f = context.market.forming(bar.symbol, "H4", context.now)
        h = context.market.latest(bar.symbol, "H4")
        context.log("info", "seen", timeframe=bar.timeframe, close=bar.close_time_ns, forming=f["observed_time_ns"] if f else None, volume=f["tick_volume"] if f else None, last=h.close_time_ns if h else None, known=context.market.count(bar.symbol, bar.timeframe))


def test_several_timeframes_forming_bars_and_warm_up(spark):
    from barlume.operators import bars as B

    m, h = (adapters.bars(spark, SF, tf).where("symbol = 'view'").withColumn("run_id", F.lit("v")) for tf in ("H1", "H4"))
    start = m.agg(F.expr("percentile_disc(0.3) within group (order by close_time_ns)")).first()[0]
    rows = fold.bar_rows(m.unionByName(h), "H1").unionByName(fold.forming_rows(B.forming(m, h).withColumn("run_id", F.lit("v")), "H4"))
    out = fold.simulate(rows, Rules(), {"view": Profile("view")}, "tests.test_fold:Watcher", start_ns=int(start))
    seen = [r[0] for r in out.where("kind = 'log'").orderBy("seq").select(F.from_json("payload", "timeframe string, close long, forming long, volume long, last long, known long")).collect()]
    bars4 = {r.close_time_ns: r.open_time_ns for r in h.collect()}
    closes1 = sorted(r.close_time_ns for r in m.collect())
    assert [s.close for s in seen if s.timeframe == "H1"] == [c for c in closes1 if c > start]
    assert [s.close for s in seen if s.timeframe == "H4"] == sorted(c for c in bars4 if c > start)
    for s in seen:
        done = [c for c in bars4 if c <= s.close]
        assert s.last == (max(done) if done else None)
        if s.timeframe == "H1":
            assert s.known == sum(c <= s.close for c in closes1)
            inside = [c for c, o in bars4.items() if o < s.close < c]
            assert s.forming == (s.close if inside else None)
    assert fold.reports(out).first().bars == sum(c > start for c in closes1)


def test_frames_pacing_and_late_rows(spark, tmp_path):
    schema = "k string, t long, v long"
    for part in ([("a", 1, 1), ("a", 3, 2), ("b", 1, 3)], [("a", 2, 4), ("b", 5, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = lambda: live.read_ticks(spark, f"{tmp_path}/in", schema, 1)
    live.run_to_end(live.split_late(rows(), ["k"], "t"), f"{tmp_path}/late")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/late").where("late").collect())) == [("a", 2, 4, True)]
    live.latest_frame(rows(), ["k"], f"{tmp_path}/frames", "t")
    got = spark.read.parquet(f"{tmp_path}/frames")
    assert sorted((r.frame, r.k, r.v) for r in got.collect()) == [(0, "a", 2), (0, "b", 3), (1, "a", 4), (1, "b", 5)]
    assert [live.publish_rate(s) for s in (1, 1_000, 10_000, 1_000_000)] == [30, 20, 12, 8]
    assert live.pace(600, 10) == {"maxFilesPerTrigger": 3, "trigger": {"processingTime": "50 milliseconds"}}


class Faulty(fold.Strategy):
    """Raises, never returns, or looks back too far, as its parameter says."""

    def on_bar(self, context, bar):
        how = self.parameters["how"]
        if bar.sequence == 3:
            if how == "raises":
                raise ZeroDivisionError("by design")
            while how == "hangs":
                pass
            if how == "looks":
                context.market.history(bar.symbol, bar.timeframe, 11)
        context.log("INFO", how)


class Counting(fold.Observer):
    def __init__(self):
        self.bars = 0

    def on_bar(self, run_id, bar, snapshot):
        self.bars += 1

    def on_result(self, run_id, time_ns, kind, ref, values, snapshot):
        if kind == "report":
            values["observed"] = self.bars
            assert values["bars"] == self.bars and snapshot["active"] == 0


def _runs(spark, names, n=6):
    bars = pd.DataFrame([(r, "X", "M1", i * 60, (i + 1) * 60, 1000, 1010, 990, 1000, 0, i) for r in names for i in range(n)], columns=["run_id", *fold.BAR])
    return fold.bar_rows(spark.createDataFrame(bars))


def test_a_faulty_strategy_ends_its_own_run(spark):
    names = ["fine", "raises", "hangs", "looks", "unmade"]
    out = fold.simulate(_runs(spark, names).coalesce(1), Rules(), {"X": Profile("X")}, "tests.test_fold:Faulty", lambda r: {"how": r} if r != "unmade" else {}["how"], limit=0.5, history=10).collect()
    kinds = lambda r: [x.kind for x in out if x.run_id == r]
    assert kinds("fine").count("log") == 6 and kinds("fine")[-1] == "report"
    why = {r.run_id: r.payload for r in out if r.kind == "run.failed"}
    assert set(why) == {"raises", "hangs", "looks", "unmade"}
    assert "ZeroDivisionError" in why["raises"] and "TooSlow" in why["hangs"] and "history" in why["looks"] and "KeyError" in why["unmade"]
    assert all(kinds(r).count("log") == 3 and "report" not in kinds(r) for r in ("raises", "hangs", "looks"))


def test_history_is_as_deep_as_the_run_says(spark):
    out = fold.simulate(_runs(spark, ["looks"], 20), Rules(), {"X": Profile("X")}, "tests.test_fold:Faulty", lambda r: {"how": r}, history=None)
    assert out.where("kind = 'log'").count() == 20


def test_an_observer_sees_bars_and_rows(spark):
    out = fold.simulate(_runs(spark, ["a", "b"]), Rules(), {"X": Profile("X")}, observer="tests.test_fold:Counting")
    assert out.where("kind = 'report'").count() == 2


def test_snapshot_holds_active_and_last_ended_orders():
    from barlume.operators import book

    b = book.Book(Rules(), {"X": Profile("X")})
    b.bar("X", 0, 60, 1000, 1010, 990, 1000, 0, 0)
    made = [b.submit(f"c{i}", "X", True, "LIMIT", D(1), 60 + i, price=900).id for i in range(book.RECENT + 20)]
    for i in made[:-5]:
        b.cancel(i, 10_000, "x")
    shot = b.snapshot()
    assert shot["active"] == 5 and [o.id for o in shot["orders"]] == made[-5:] + made[-5 - book.RECENT : -5]
    assert len(b.orders) == 5


def test_a_slow_viewer_gets_the_newest():
    s = live.Subscriber(3)
    for i in range(8):
        s.put(i)
    assert s.take() == [6, 7] and s.dropped == 6 and s.take() == []
