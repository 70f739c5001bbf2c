"""Streams over the events table (inventory 2.12)."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from barlume.operators import fold
from barlume.operators.book import Rules
from barlume.plans.adapters import bars, sql, ticks
from barlume.plans.q_fold import profiles
from barlume.plans.q_series import T10, T20
from barlume.plans.registry import query
from barlume.sources.shared import shared_path
from barlume.streaming import journal, live


def _ticks_files(spark, sf, parts: int = 4) -> str:
    """The ticks as files that follow each other in time, as a feed would leave them."""
    path = shared_path(spark, "ticks")
    ticks(spark, sf).repartitionByRange(parts, "time_ns").write.parquet(path)
    return path


@query(
    "l1_l6_stream_bars",
    sql("SELECT symbol, open_time_ns, close_time_ns, open_ticks, high_ticks, low_ticks, close_ticks, tick_volume FROM bars WHERE close_time_ns <= (SELECT max(time_ns) // 1000 * 1000 FROM ticks) - 600000000000", "bars:H1"),
)
def stream_bars(spark, sf):
    path = _ticks_files(spark, sf)
    out = shared_path(spark, "stream-bars")
    live.run_to_end(live.closed_bars(live.read_ticks(spark, path, spark.read.parquet(path).schema), "H1"), out)
    return spark.read.parquet(out)


@query("l7_late_rows", sql("--cte n AS (SELECT symbol, tick_id, time_ns, max(time_ns) OVER (PARTITION BY symbol ORDER BY tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks) SELECT symbol, count(*) AS rows, count(*) FILTER (time_ns <= top) AS late FROM n GROUP BY symbol", "ticks"))
def late_rows(spark, sf):
    path, out = shared_path(spark, "arrivals"), shared_path(spark, "late")
    ticks(spark, sf).coalesce(1).sortWithinPartitions("tick_id").write.parquet(path)
    live.run_to_end(live.split_late(live.read_ticks(spark, path, spark.read.parquet(path).schema), ["symbol"], "time_ns"), out)
    return spark.read.parquet(out).groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if("late").alias("late"))


@query("l9_stream_fold")
def stream_fold(spark, sf):
    rows = fold.bar_rows(bars(spark, sf, "H1").withColumn("run_id", F.concat("symbol", F.lit("/3/10"))))
    path, out = shared_path(spark, "bar-rows"), shared_path(spark, "stream-fold")
    for a, b in ((0, T10), (T10, T20), (T20, 2**63 - 1)):  # one file after the other: the source takes them by age
        rows.where((F.col("at_ns") >= a) & (F.col("at_ns") < b)).coalesce(1).write.mode("append").parquet(path)
    from barlume.plans.q_fold import grid

    rules = Rules(balance=D(100_000), spread_points=2, hedging=False)
    live.run_to_end(live.live_runs(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), rules, profiles(spark, sf), "barlume.operators.signals:SmaCross", grid), out)
    return fold.trades(spark.read.parquet(out)).select("run_id", "trade_id", "side", "entry_time_ns", "exit_time_ns", "exit_reason")


@query("l2_l10_seek", sql("SELECT symbol AS run_id, count(*) AS bars FROM bars WHERE close_time_ns <= 1705276800000000000 GROUP BY symbol", "bars:H1"))
def seek(spark, sf):
    rows = fold.bar_rows(bars(spark, sf, "H1").withColumn("run_id", F.col("symbol")))
    out = live.seek(rows, 1_705_276_800_000_000_000, rules=Rules(), profiles=profiles(spark, sf))
    return fold.reports(out).select("run_id", "bars")


@query("l10_journal", sql("SELECT symbol, count(*) AS rows, CAST(sum(tick_id) AS BIGINT) AS ids, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY symbol", "ticks"))
def journalled(spark, sf):
    """Ticks journalled file by file; the writer dies between a batch's rows and its commit, and is started again."""
    path, root = _ticks_files(spark, sf), shared_path(spark, "journal")
    stream = lambda: live.read_ticks(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)

    def die(batch: int) -> None:
        if batch == 2:
            raise InterruptedError("stopped in batch 2")

    try:
        journal.write(stream(), root, die)
    except StreamingQueryException as e:
        if "stopped in batch 2" not in str(e):
            raise
    assert journal.batches(spark, root) == [0, 1]
    journal.write(stream(), root)
    return journal.read(spark, root).groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("tick_id").alias("ids"), F.sum("volume").alias("volume"))
