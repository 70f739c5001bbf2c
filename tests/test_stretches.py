"""Values over stretches, blocks, ranges and stored levels against whole-key windows and plain Python."""

import bisect
import random

import pytest
from pyspark.sql import Window, functions as F

from barlume.operators import bars as B, enrich as E, joins, metrics as M, prefixes, pyramid, quality as Q, quantiles, replay as R
from barlume.schema import DAY_NS, NS

HOUR = 3600 * NS
OHLC = "open_ticks long, high_ticks long, low_ticks long, close_ticks long, tick_volume long"
BAR = f"symbol string, timeframe string, open_time_ns long, close_time_ns long, sequence long, {OHLC}"


def plan_windows(df):
    """The partition columns of every window in the physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "windowspecdefinition(" in line]


def cuts_keys(df, *whole):
    """No window is partitioned by the named columns alone (each also has a stretch or block)."""
    found = plan_windows(df)
    assert found
    for line in found:
        for spec in line.split("windowspecdefinition(")[1:]:
            parts = [p.strip().split("#")[0] for p in spec.split(" ASC")[0].split(",")]
            # the table of one row a stretch is ordered by the stretch itself
            assert parts[-1] in ("__seg", "__side", "__i", "__n", "stretch") or set(parts[:-1]) - set(whole) or "__seg" in spec, spec


@pytest.fixture
def rows(spark):
    rng = random.Random(8)
    out, t = [], {}
    for i in range(600):
        k = rng.choice(["a", "b", "b", "b", None])
        t[k] = t.get(k, 0) + rng.choice([1, 1, 1, 2, 90])  # empty stretches between
        out.append((k, t[k], rng.choice([None, *range(9)]), i))
    return spark.createDataFrame(out, "k string, t long, v int, i int")


def test_all_running_kinds(spark, rows):
    w = Window.partitionBy("k").orderBy("t")
    upto, before, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    want = rows.withColumns(
        {
            "n": F.row_number().over(w).cast("long"), "added": F.sum("v").over(upto), "top": F.max("v").over(upto), "was_top": F.max("v").over(before), "held": F.last("v", ignorenulls=True).over(upto),
            "was": F.lag("v").over(w), "next": F.lead("v").over(w), "all": F.count("*").over(every), "end": F.max("t").over(every), "state": F.max(F.struct("v", "t")).over(upto),
        }
    )
    v = F.col("v")
    values = {
        "n": ("count", F.lit(1)), "added": ("sum", v), "top": ("max", v), "was_top": ("max_before", v), "held": ("last", v), "was": ("lag", v), "next": ("lead", v),
        "all": ("total", F.lit(1)), "end": ("greatest", F.col("t")), "state": ("max", F.struct("v", "t")),
    }
    for width in (1, 5, 50, 100_000):
        got = joins.running(rows, ["k"], ["t"], F.floor(F.col("t") / width), values).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), width
    only = joins.running(rows, ["k"], ["t"], F.floor(F.col("t") / 5), {"next": ("lead", v)})
    assert sorted(map(str, only.select("i", "next").collect())) == sorted(map(str, want.select("i", "next").collect()))
    cuts_keys(got, "k")
    # the rows are shuffled once: what is added is one row a stretch
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(k") <= 3


def test_sliding_windows_reach_over_block_ends(spark, rows):
    w = Window.partitionBy("k").orderBy("t")
    for n, block in ((1, 1), (2, 3), (7, 7), (7, 20), (30, 8), (4, 10_000)):
        frame = w.rowsBetween(-(n - 1), 0)
        want = rows.select("i", F.sum("v").over(frame).alias("s"), F.collect_list("i").over(frame).alias("l"), F.row_number().over(w).cast("long").alias("__i"))
        values = {"s": lambda x: F.sum("v").over(x.rowsBetween(-(n - 1), 0)), "l": lambda x: F.collect_list("i").over(x.rowsBetween(-(n - 1), 0))}  # noqa: B023
        got = joins.sliding(rows, ["k"], ["t"], F.floor(F.col("t") / 13), n, values, block=block)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), (n, block)


def series(spark, n, seed=1, symbols="AB", step=HOUR, timeframe="H1"):
    rng, out = random.Random(seed), []
    for s in symbols:
        t, p = 0, 1000
        for i in range(n):
            t += step * rng.choice([1, 1, 1, 4, 900])
            o, p = p, p + rng.randint(-9, 9)
            out.append((s, timeframe, t, t + step, i, o, max(o, p) + rng.randint(0, 3), min(o, p) - rng.randint(0, 3), p, rng.randint(1, 50)))
    return spark.createDataFrame(out, BAR)


def test_indicators_have_no_window_over_a_series(spark):
    bars = series(spark, 120)
    w = Window.partitionBy("symbol").orderBy("open_time_ns")
    want = bars.withColumns({"closes": F.collect_list("close_ticks").over(w.rowsBetween(-4, 0))})
    got = B.history(bars, 5)
    assert sorted((r.symbol, r.sequence, tuple(r.closes)) for r in got.collect()) == sorted((r.symbol, r.sequence, tuple(r.closes)) for r in want.collect())
    plain = {}
    for s in "AB":
        closes = [r.close_ticks for r in bars.where(f"symbol = '{s}'").orderBy("sequence").collect()]
        for i in range(len(closes)):
            if i >= 10:
                now = [sum(closes[i - n + 1 : i + 1]) * m for n, m in ((3, 10), (10, 3))]
                was = [sum(closes[i - n : i]) * m for n, m in ((3, 10), (10, 3))]
                plain[s, i] = 1 if was[0] <= was[1] and now[0] > now[1] else -1 if was[0] >= was[1] and now[0] < now[1] else 0
            else:
                plain[s, i] = 0
    cross = B.sma_cross(bars, 3, 10)
    assert {(r.symbol, r.sequence): r.cross for r in cross.collect()} == plain and 1 in plain.values()
    for df in (got, cross, B.structure_levels(bars), B.downsample(bars, 20), E.bounded(bars), R.ordered(bars.selectExpr("symbol AS run_id", "open_time_ns AS time_ns", "1 AS priority", "sequence AS source_sequence"))):
        cuts_keys(df, "symbol", "timeframe", "run_id")


def test_episodes_streaks_and_exposure_on_random_cuts(spark, monkeypatch):
    rng = random.Random(21)
    curve, trades, t = [], [], 0
    for i in range(300):
        t += rng.choice([1, 1, 5, 400])
        curve.append(("r", t, 1000 + rng.randint(-30, 30) + i // 9))
        trades.append(("r", i, t, t + rng.choice([0, 1, 30, 700]), rng.choice([-1, -1, 0, 1, 1, 1])))
    equity = spark.createDataFrame(curve, "run string, time_ns long, equity long")
    deals = spark.createDataFrame(trades, "run string, trade_id int, entry_time_ns long, exit_time_ns long, net_pnl int")
    # plain versions
    episodes, peak, start, low = [], None, None, None
    for _, at, e in curve:
        if peak is None or e >= peak:
            if low and low[0] > 0:
                episodes.append((start, low[1], at, low[0]))
            peak, start, low = e, at, (0, at)
        elif peak - e > low[0]:
            low = (peak - e, at)
    if low[0] > 0:
        episodes.append((start, low[1], None, low[0]))
    longest, run = {1: 0, -1: 0}, (0, 0)
    for *_, n in sorted(trades, key=lambda x: (x[3], x[1])):
        run = (n, run[1] + 1 if n == run[0] else 1)
        if n:
            longest[n] = max(longest[n], run[1])
    merged: list[list[int]] = []
    for _, _, a, b, _ in sorted(trades, key=lambda x: (x[2], x[3])):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for width in (3, 40, 1_000, 10**9):
        monkeypatch.setattr(M, "SEGMENT_NS", width)
        got = M.episodes(equity, ["run"])
        assert sorted((r.start_time_ns, r.trough_time_ns, r.recovery_time_ns, r.max_drawdown_amount) for r in got.collect()) == sorted(episodes, key=lambda x: x[0])
        assert tuple(M.streaks(deals, ["run"]).first())[1:] == (longest[1], longest[-1])
        stretches = M.exposure(deals, ["run"]).first()
        assert stretches.stretches == len(merged) and round(stretches.exposure_minutes * M.MINUTE_NS) == sum(b - a for a, b in merged)
    for df in (got, M.streaks(deals, ["run"]), M.exposure(deals, ["run"])):
        cuts_keys(df, "run")


def test_activity_by_ends(spark):
    bars = series(spark, 80, seed=3)
    rng = random.Random(5)
    last = bars.agg(F.max("close_time_ns")).first()[0]
    deals = []
    for i in range(150):
        a = rng.randrange(-5 * HOUR, last + 5 * HOUR)
        deals.append((i, rng.choice("AB"), rng.choice(["LONG", "SHORT"]), a, a + rng.choice([0, 1, HOUR, 30 * HOUR, 5000 * HOUR]), rng.choice(["stop_loss", "take_profit", "x"]), rng.randint(1, 3), rng.randint(-9, 9)))
    trades = spark.createDataFrame(deals, "trade_id int, symbol string, side string, entry_time_ns long, exit_time_ns long, exit_reason string, lots int, net_pnl int")
    got = {(r.symbol, r.sequence): r for r in E.activity(bars, trades, 100 * HOUR, ids=True).collect()}
    changes = {(r.symbol, r.sequence): r for r in E.active_changes(bars, trades).collect()}
    assert len(got) == 160
    for s in "AB":
        lower, known = None, []
        for b in bars.where(f"symbol = '{s}'").orderBy("sequence").collect():
            lower = b.open_time_ns - 1 if lower is None else lower
            here = sorted((d[3], d[0], d) for d in deals if d[1] == s and d[3] <= b.close_time_ns and d[4] > lower)
            here = [d for *_, d in here]
            gone = [d for d in here if d[4] <= b.close_time_ns]
            r = got[s, b.sequence]
            assert (r.active, r.active_long, r.active_short) == (len(here), sum(d[2] == "LONG" for d in here), sum(d[2] == "SHORT" for d in here))
            assert (r.entries, r.exits, r.stop_exits) == (sum(d[3] > lower for d in here), len(gone), sum(d[5] == "stop_loss" for d in gone))
            assert (r.realized_pnl, r.net_lots) == (sum(d[7] for d in gone), sum(d[6] if d[2] == "LONG" else -d[6] for d in here))
            assert r.active_ids == ",".join(str(d[0]) for d in here)
            c = changes.get((s, b.sequence))
            new = [d[0] for d in here if d[0] not in known]
            assert (c.opened_ids if c else "") == ",".join(map(str, new)) and (c.closed_ids if c else "") == ",".join(str(d[0]) for d in gone)
            known, lower = [d[0] for d in here], b.close_time_ns


def test_a_long_trade_costs_two_rows(spark):
    bars = series(spark, 400, symbols="A", step=60 * NS)
    a, b = bars.agg(F.min("open_time_ns"), F.max("close_time_ns")).first()
    trades = spark.createDataFrame([(1, "A", "LONG", a, b, "x", 1, 5)], "trade_id int, symbol string, side string, entry_time_ns long, exit_time_ns long, exit_reason string, lots int, net_pnl int")
    assert E._changes(E.ends(bars, trades)).count() == 2
    assert E.activity(bars, trades).where("active = 1").count() == 400


def test_audit_with_targets_that_do_not_nest(spark):
    """Timeframes whose bars cut each other, have holes or miss some of the base, against a search per target bar."""
    rng = random.Random(12)
    base = series(spark, 300, seed=6, symbols="AB", step=60 * NS, timeframe="M1")
    rows, targets = base.collect(), []
    for timeframe, width, shift in (("M5", 300, 0), ("M15", 900, 120), ("H1", 3600, 0), ("H4", 14400, 3600)):
        for s in "AB":
            for start in range(-shift, 300 * 200 * 60, width):
                inside = [r for r in rows if r.symbol == s and start * NS <= r.open_time_ns < (start + width) * NS]
                if not inside and rng.random() < 0.99 or rng.random() < 0.1:
                    continue
                inside = inside or rows[:1]
                bar = [inside[0].open_ticks, max(r.high_ticks for r in inside), min(r.low_ticks for r in inside), inside[-1].close_ticks + (rng.random() < 0.1), sum(r.tick_volume for r in inside)]
                targets.append((s, timeframe, start * NS, (start + width) * NS, 0, *bar))
    got = {(r.symbol, r.timeframe, r.open_time_ns): r.different for r in Q.cross_audit(base, spark.createDataFrame(targets, BAR)).collect()}
    fields = ["open_ticks", "high_ticks", "low_ticks", "close_ticks", "tick_volume"]
    want = {}
    for s in "AB":
        mine = [r for r in rows if r.symbol == s]
        lo, hi, opens = mine[0].open_time_ns, mine[-1].close_time_ns, [r.open_time_ns for r in mine]
        for _, tf, a, b, _, *bar in (t for t in targets if t[0] == s):
            if a >= lo and b <= hi:
                inside = mine[bisect.bisect_left(opens, a) : bisect.bisect_left(opens, b)]
                made = inside and [inside[0].open_ticks, max(r.high_ticks for r in inside), min(r.low_ticks for r in inside), inside[-1].close_ticks, sum(r.tick_volume for r in inside)]
                want[s, tf, a] = [f for f, x, y in zip(fields, bar, made, strict=True) if x != y] if made else None
    assert got == want and any(want.values()) and None in want.values()
    with pytest.raises(ValueError, match="Z9"):
        Q.cross_audit(base, spark.createDataFrame([("A", "Z9", 0, 1, 0, 1, 1, 1, 1, 1)], BAR))


def scanned(df):
    """Rows that the plan's file scans put out."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            p = p.plan()
        if "FileSourceScan" in p.getClass().getSimpleName():
            total += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.length())]
    return total


def test_a_viewport_reads_what_it_shows(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(40_000):
        a = rng.randrange(0, 4000 * DAY_NS)
        span = rng.choice([0, HOUR, 20 * HOUR, 9 * DAY_NS])
        rows.append((i, i, a, a + span))
    rows += [(50_000 + i, 50_000 + i, 10 * i * DAY_NS, None if i % 2 else (10 * i + 100) * DAY_NS) for i in range(50)]
    rows += [(60_000, 60_000, None, None)]
    drawings = spark.createDataFrame(rows, "drawing_id int, ordinal int, from_ns long, to_ns long").repartition(4)
    index = R.write_viewport_index(drawings, str(tmp_path / "index"), group_bytes=1 << 14)
    for lo, hi in ((100, 103), (2000, 2030), (0, 1), (3999, 4100)):
        want = R.viewport(drawings, lo * DAY_NS, hi * DAY_NS, 700)
        got = R.read_viewport(index, spark, lo * DAY_NS, hi * DAY_NS, 700)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = R.read_viewport(index, spark, 2000 * DAY_NS, 2003 * DAY_NS, 5000)
    assert scanned(seen) < 10 * seen.count() + 2000 < 40_000


def test_pyramid_levels_and_views(spark, tmp_path):
    bars = series(spark, 333, seed=9, symbols="AB").unionByName(series(spark, 5, seed=2, symbols="C"))
    stored = pyramid.write(bars, str(tmp_path / "p"), levels=3)
    flat = {s: [(r.open_time_ns, float(r.close_ticks)) for r in bars.where(f"symbol = '{s}'").orderBy("open_time_ns").collect()] for s in "ABC"}
    for level in (0, 1, 3, 4, 9):
        want = set()
        for s, x in flat.items():
            for k in range(0, len(x), 1 << level):
                part = x[k : k + (1 << level)]
                low, high = min(part, key=lambda p: (p[1], p[0])), max(part, key=lambda p: (p[1], -p[0]))
                want.add((s, k >> level, len(part), *part[0], *part[-1], *low, *high))
        got = pyramid.nodes(stored, spark, level).drop("timeframe", "level")
        assert {tuple(r) for r in got.select("symbol", *got.columns[:-1] if got.columns[-1] == "symbol" else got.columns[1:]).collect()} == want, level
    # few enough rows: all of them; else the envelope of one level
    a, b = flat["A"][50][0], flat["A"][59][0]
    some = pyramid.view(stored, spark, 20, a, b, {"symbol": "A"})
    assert sorted((r.open_time_ns, r.value) for r in some.collect()) == flat["A"][50:60]
    whole = pyramid.view(stored, spark, 40)
    for s in "AB":
        values = [r.value for r in whole.where(f"symbol = '{s}'").collect()]
        assert len(values) <= 40 and (min(values), max(values)) == (min(v for _, v in flat[s]), max(v for _, v in flat[s]))
    few = [r.value for r in whole.where("symbol = 'C'").collect()]
    assert (min(few), max(few)) == (min(v for _, v in flat["C"]), max(v for _, v in flat["C"])) and B.downsample(bars.where("symbol = 'C'"), 40).count() == 5


def test_figures_at_a_cursor_read_one_stretch(spark, tmp_path):
    rng, trades, curve = random.Random(6), [], []
    for run in ("x", "y"):
        t, e = 0, 10_000
        for i in range(400):
            t += rng.choice([1, 2, 3, 500]) if i < 380 else 40
            n = rng.randint(-50, 55)
            e += n
            trades.append((run, i, t, n, 1, 2, 0, rng.choice([0, 10, 20])))
            curve.append((run, t, e))
    deals = spark.createDataFrame(trades, "run string, trade_id int, exit_time_ns long, net_pnl long, commission long, spread_cost long, slippage_cost long, initial_risk long")
    equity = spark.createDataFrame(curve, "run string, time_ns long, equity long")
    stored = prefixes.write(deals, equity, str(tmp_path / "p"), ["run"], 100)
    for at in (-5, 3, 99, 100, 2_000, 5_555, 20_000, 10**6):
        got = {r.run: r for r in prefixes.at_cursor(stored, spark, at, 10_000.0).collect()}
        want = {r.run: r for r in M.run_totals(deals.where(F.col("exit_time_ns") <= at), ["run"], 10_000.0).collect()}
        assert got.keys() == want.keys()
        dd = {r.run: r.d for r in M.drawdowns(equity.where(F.col("time_ns") <= at), ["run"]).groupBy("run").agg(F.max("drawdown_amount").alias("d")).collect()}
        for run, r in got.items():
            w = want[run]
            assert (r.trades, r.wins, r.final_balance, r.total_cost, r.max_drawdown_amount) == (w.trades, w.wins, w.final_balance, w.total_cost, dd[run]), (at, run)
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in ((r.profit_factor, w.profit_factor), (r.average_r, w.average_r)))
    saved = stored.read(spark, "prefixes").where("stretch < 100 and (next_stretch is null or next_stretch >= 100)")
    assert saved.count() <= 2  # a row a run, however many trades went before


def test_exact_quantiles_of_any_distribution(spark):
    rng, rows = random.Random(10), []
    rows += [("ties", rng.choice([1, 1, 1, 2, 3])) for _ in range(3000)] + [("one", 7)] + [("two", 5), ("two", 9)] + [("null", None)]
    rows += [("wide", int(10 ** rng.uniform(0, 15)) * rng.choice([-1, 1])) for _ in range(3000)] + [(None, v) for v in range(500)]
    rows += [("edge", 0)] * 1000 + [("edge", 1)] * 1000
    df = spark.createDataFrame(rows, "k string, v long")
    shares = [0.0, 0.05, 0.25, 0.5, 0.7, 0.95, 0.99, 1.0]
    want = df.where("v is not null").groupBy("k").agg(*(F.percentile("v", F.lit(s)).alias(f"l{i}") for i, s in enumerate(shares)), *(F.expr(f"percentile_disc({s}) within group (order by v)").alias(f"r{i}") for i, s in enumerate(shares)))
    want = {r.k: r for r in want.collect()}
    for most, accuracy in ((20, 64), (10_000, 10_000)):
        for method, mark in (("linear", "l"), ("rank", "r")):
            got = quantiles.quantiles(df, "v", ["k"], shares, method, most, accuracy).collect()
            assert len(got) == len(want) * len(shares)
            for r in got:
                assert r.value == pytest.approx(want[r.k][f"{mark}{shares.index(r.share)}"], rel=1e-12), (r, most)
    assert quantiles.quantiles(df.limit(0), "v", ["k"], [0.5]).collect() == []
    assert quantiles.quantiles(df.where("k = 'ties'"), "v", [], [0.5], "rank", 20, 64).first().value == 1
