"""Sources and sinks, written to the shared folder and read back (inventory 2.1, 2.2)."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from barlume.operators import enrich, fold, quality as Q
from barlume.operators.book import Rules
from barlume.plans.adapters import bar_trades, bars, sql, trades
from barlume.plans.q_enrich import _B, WIDTH, views
from barlume.plans.q_fold import grid, profiles
from barlume.plans.q_rows import _FAULTY, checked, faulty
from barlume.plans.registry import query
from barlume.sources import csv_bars, store
from barlume.sources.shared import shared_path


@query("k1_s13_store_roundtrip", sql("SELECT symbol, timeframe, open_time_ns, close_ticks, sequence FROM (SELECT * FROM bars UNION ALL SELECT * FROM hours) WHERE symbol = 'view' AND open_time_ns >= 1705276800000000000", "bars", "bars:H1:hours"))
def store_roundtrip(spark, sf):
    path = shared_path(spark, "bars")
    store.write_bars(bars(spark, sf).unionByName(bars(spark, sf, "H1")), path)
    got = store.read_bars(spark, path).where("symbol = 'view' and open_time_ns >= 1705276800000000000")
    return got.select("symbol", "timeframe", "open_time_ns", "close_ticks", "sequence")


@query("k2_content_cache", sql("SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol", "bars:H1"))
def content_cache(spark, sf):
    root, key = shared_path(spark, "cache"), store.content_key("source", {"timeframe": "H1"})
    store.cached(spark, root, key, lambda: bars(spark, sf, "H1"))
    return store.cached(spark, root, key, lambda: None, "read_only").groupBy("symbol").agg(F.count("*").alias("bars"))


@query("k3_import_report", sql("--cte " + _FAULTY + " SELECT symbol, reject_code, count(*) AS rows FROM coded WHERE reject_code IS NOT NULL GROUP BY ALL", "ticks"))
def import_report(spark, sf):
    path = shared_path(spark, "report")
    try:
        store.write_report({"codes": Q.code_counts(checked(spark, sf), ["symbol"])}, path, failed=True)
    except RuntimeError:
        return store.read_table(spark, path, "codes").select("symbol", "reject_code", "rows")
    raise AssertionError("a failed import must raise")


@query("s4_s5_csv_rows", sql("--cte " + _FAULTY + " SELECT source_row, open_time_ns, reject_code FROM coded WHERE symbol = 'view' AND reject_code IS NULL", "ticks"))
def csv_rows(spark, sf):
    path = shared_path(spark, "csv")
    columns = list(csv_bars.NAMES.values())
    rows = faulty(spark, sf).where("symbol = 'view'")
    lines = rows.select(F.col("source_row").alias("n"), F.array_join(F.array(*columns), "\t").alias("value"))
    head = spark.createDataFrame([(1, "\t".join(csv_bars.NAMES))], "n long, value string")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return Q.accepted(Q.parse_rows(csv_bars.read(spark, path, "M1"), "M1", "UTC", 2, 5)).select("source_row", "open_time_ns", "reject_code")


@query("k4_trades_files", sql("SELECT symbol, count(*) AS n, CAST(sum(net_pnl) AS BIGINT) AS net_pnl FROM trades GROUP BY symbol", "trades"))
def trades_files(spark, sf):
    path = shared_path(spark, "trades")
    store.write_trades(trades(spark, sf), path)
    csv = spark.read.option("header", True).csv(store.latest(spark, path).path("trades.csv"))
    return csv.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("net_pnl").cast("bigint")).alias("net_pnl"))


@query("k5_market_with_trades", sql(_B + """, g AS (SELECT sequence, count(*) AS active FROM pairs GROUP BY sequence) SELECT symbol, timeframe, b.sequence, close_ticks, coalesce(active, 0) AS active FROM b LEFT JOIN g USING (sequence)""", "bar_trades", "bars:H1"))
def market_with_trades(spark, sf):
    path, b = shared_path(spark, "market"), views(spark, sf)
    store.market_with_trades(b, enrich.activity(b, bar_trades(spark, sf), WIDTH), path)
    return store.read_table(spark, path, "market").select("symbol", "timeframe", "sequence", "close_ticks", "active")


@query("k7_s14_bundle_catalog", sql("SELECT 'r1' AS run_id, 'trades' AS name, count(*) AS rows FROM trades UNION ALL SELECT 'r1', 'bars', count(*) FROM bars UNION ALL SELECT 'r2', 'bars', count(*) FROM bars WHERE symbol = 'view'", "trades", "bars:H1"))
def bundle_catalog(spark, sf):
    root, b = shared_path(spark, "runs"), bars(spark, sf, "H1")
    store.write_bundle({"trades": trades(spark, sf), "bars": b}, f"{root}/r1", "r1")
    store.write_bundle({"bars": b.where("symbol = 'view'")}, f"{root}/r2", "r2")
    return store.run_catalog(spark, root).select("run_id", F.col("table").alias("name"), "rows")


@query("s12_output_streams")
def output_streams(spark, sf):
    path = shared_path(spark, "streams")
    b = bars(spark, sf, "H1").withColumn("run_id", F.concat("symbol", F.lit("/3/10")))
    store.write_streams(fold.simulate(fold.bar_rows(b), Rules(balance=D(10**9), spread_points=2), profiles(spark, sf), "barlume.operators.signals:SmaCross", grid), path)
    return store.read_stream(spark, path, "chart").select("run_id", "seq", "time_ns", "payload")


@query("b10_b15_netting_and_stop_out")
def netting_and_stop_out(spark, sf):
    """A small account in netting mode: reversals, margin calls, forced exits."""
    b = bars(spark, sf, "M15").withColumn("run_id", F.concat("symbol", F.lit("/3/15")))
    rules = Rules(balance=D(3_000), leverage=D(10), spread_points=2, hedging=False, sizing=("FIXED_LOT", D(1)))
    out = fold.simulate(fold.bar_rows(b), rules, profiles(spark, sf), "barlume.operators.signals:SmaCross", grid, account_every=1000)
    return out.where("kind in ('account.margin_call', 'account.stop_out', 'position.liquidated', 'trade', 'order.rejected')").groupBy("run_id", "kind").agg(F.count("*").alias("n"))
