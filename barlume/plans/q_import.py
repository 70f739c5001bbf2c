"""Imports by content, published versions, hashes of files (inventory 2.1, 2.2: S4, S6, S7, K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlume.plans.adapters import bars, sql
from barlume.plans.registry import query
from barlume.schema import NS
from barlume.sources import csv_bars, ingest, manifest, snapshots
from barlume.sources.shared import shared_path

DAY = 86_400 * NS


def write_series(series: DataFrame, folder: str) -> None:
    """One file per symbol and timeframe, as a terminal would write it."""
    spark = series.sparkSession
    at = F.timestamp_micros(F.expr("open_time_ns div 1000"))
    price = lambda c: (F.col(c) / 100).cast("decimal(20,2)").cast("string")
    cells = [
        F.date_format(at, "yyyy.MM.dd"), F.date_format(at, "HH:mm:ss"), *(price(f"{c}_ticks") for c in ("open", "high", "low", "close")),
        F.col("tick_volume").cast("string"), F.lit("0"), F.lit("1"),
    ]
    lines = series.select("symbol", "timeframe", F.col("open_time_ns").alias("at"), F.concat_ws("\t", *cells).alias("value"))
    heads = series.select("symbol", "timeframe").distinct().select("symbol", "timeframe", F.lit(-1).cast("long").alias("at"), F.lit("\t".join(csv_bars.NAMES)).alias("value"))
    made = f"{folder}-parts"
    # a file is in order, so it is one task's
    lines.unionByName(heads).repartition("symbol", "timeframe").sortWithinPartitions("symbol", "timeframe", "at").select("symbol", "timeframe", "value").write.partitionBy(
        "symbol", "timeframe"
    ).text(made)
    fs, to = snapshots._at(spark, folder)
    fs.mkdirs(to)
    for r in manifest.list_files(spark, made, "*.txt", recursive=True).collect():  # a row per series
        symbol, timeframe = (part.split("=")[1] for part in r.path.split("/")[-3:-1])
        was, name = snapshots._at(spark, r.path)[1], snapshots._at(spark, f"{folder}/{symbol}_{timeframe}_202401010000_202501010000.csv")[1]
        if not fs.rename(was, name):
            raise RuntimeError(f"{name} is there already")


@query(
    "k2_incremental",
    sql(
        """SELECT upper(symbol) AS symbol, timeframe, count(*) - CASE WHEN symbol = 'view' THEN 1 ELSE 0 END AS rows, symbol <> 'view' AS reused FROM bars GROUP BY symbol, timeframe
        UNION ALL SELECT upper(symbol), timeframe, count(*), true FROM days GROUP BY symbol, timeframe""",
        "bars:H1",
        "bars:H4:days",
    ),
)
def incremental_import(spark, sf):
    """Files of two timeframes are imported, one of them changes, and all are imported again."""
    folder, out = shared_path(spark, "series"), shared_path(spark, "import")
    hours = bars(spark, sf, "H1")
    write_series(hours.unionByName(bars(spark, sf, "H4")), folder)
    first = ingest.import_folder(spark, folder, out)["files"]
    assert first.where("reused").isEmpty()
    again = shared_path(spark, "series")
    last = hours.where("symbol = 'view'").agg(F.max("open_time_ns")).first()[0]
    write_series(hours.where((F.col("symbol") == "view") & (F.col("open_time_ns") < last)), again)
    name = "view_H1_202401010000_202501010000.csv"
    fs, old = snapshots._at(spark, f"{folder}/{name}")
    fs.delete(old, False)
    fs.rename(snapshots._at(spark, f"{again}/{name}")[1], old)
    return ingest.import_folder(spark, folder, out)["files"].select("symbol", "timeframe", "rows", "reused")


@query(
    "k1_atomic_publish",
    sql(
        """SELECT CAST(1 AS INTEGER) AS version, symbol, count(*) AS bars, CAST(sum(close_ticks) AS BIGINT) AS total FROM bars WHERE symbol = 'view' GROUP BY symbol
        UNION ALL SELECT 2, symbol, count(*), CAST(sum(close_ticks) AS BIGINT) FROM bars GROUP BY symbol""",
        "bars:H1",
    ),
)
def atomic_publish(spark, sf):
    """Two versions and the readers pinned to them, with a write that fails half-way and one that comes late between."""
    path, b = shared_path(spark, "versions"), bars(spark, sf, "H1")
    one = snapshots.publish(spark, path, {"bars": b.where("symbol = 'view'")})
    broken = b.withColumn("close_ticks", F.when(F.col("sequence") == 10, F.raise_error(F.lit("half-way")).cast("bigint")).otherwise(F.col("close_ticks")))
    try:
        snapshots.publish(spark, path, {"other": b, "bars": broken})
    except Exception as e:
        if "half-way" not in str(e):
            raise
    two = snapshots.publish(spark, path, {"bars": snapshots.Table(b, partition_by=("symbol",))}, expect=one.number)
    try:
        snapshots.publish(spark, path, {"bars": b.limit(1)}, expect=one.number)
    except snapshots.Conflict:
        pass
    current = snapshots.current(spark, path)
    assert (current.number, current.changed(spark)) == (two.number, [])
    counted = lambda v: v.read(spark, "bars").groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("close_ticks").alias("total"))
    return counted(one).select(F.lit(1).alias("version"), "*").unionByName(counted(current).select(F.lit(2).alias("version"), "*"))


@query(
    "s7_chunked_hash",
    sql(
        f"""--cte l AS (SELECT symbol, open_time_ns // {DAY} AS day, open_time_ns, open_time_ns || ',' || open_ticks || ',' || close_ticks || chr(10) AS line FROM bars)
        SELECT symbol, day, CAST(strlen(string_agg(line, '' ORDER BY open_time_ns)) AS BIGINT) AS size_bytes, sha256(string_agg(line, '' ORDER BY open_time_ns)) AS sha256 FROM l GROUP BY symbol, day""",
        "bars",
    ),
)
def chunked_hash(spark, sf):
    """A file per symbol and day, hashed as a stream where it lies."""
    path = shared_path(spark, "lines")
    b = bars(spark, sf).withColumn("day", F.expr(f"open_time_ns div {DAY}"))
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("open_time_ns", "open_ticks", "close_ticks")))
    dealt = b.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "open_time_ns")
    dealt.select("symbol", "day", line.alias("value")).write.partitionBy("symbol", "day").text(path)
    found = manifest.file_manifest(spark, path, "*.txt", recursive=True)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    return found.select(part("symbol").alias("symbol"), part("day").cast("bigint").alias("day"), "size_bytes", "sha256")
