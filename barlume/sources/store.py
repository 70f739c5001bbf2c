"""Bars, run outputs and reports at rest: published versions of Parquet, JSON and CSV, content keys, catalogues."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlume.sources import snapshots
from barlume.sources.snapshots import Table, Version
from barlume.sources.staging import Missing

__all__ = ["Missing"]

RESERVED = ("active", "active_long", "active_short", "entries", "exits", "stop_exits", "target_exits", "realized_pnl", "net_lots", "active_ids")


def latest(spark: SparkSession, path: str) -> Version:
    found = snapshots.current(spark, path)
    if not found:
        raise Missing(f"nothing is published in {path}")
    return found


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version published last."""
    return latest(spark, path).read(spark, name)


# --- bars ---------------------------------------------------------------------------------------------------


def write_bars(bars: DataFrame, path: str) -> Version:
    """One folder per symbol and timeframe (both prune scans), sorted by open time (row groups skip). Dealt by
    range, so a series of any length is written by many tasks and each file holds a stretch of time."""
    order = ("symbol", "timeframe", "open_time_ns")
    dealt = bars.repartitionByRange(*order).sortWithinPartitions(*order)
    return snapshots.publish(bars.sparkSession, path, {"bars": Table(dealt, partition_by=("symbol", "timeframe"), options={"compression": "zstd"})})


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "bars")


def content_key(source_hash: str, *settings: dict) -> str:
    """Identity of an import: the file's hash and everything that shapes its result."""
    return hashlib.sha256(json.dumps([source_hash, *settings], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame], mode: str = "reuse") -> DataFrame:
    """The frame stored under ``key``, or made and stored. Modes: reuse, refresh (make again), read_only (never make).

    One whose rows are no longer those that were published is made again (or is an error when read-only)."""
    path = f"{root.rstrip('/')}/{key}"
    if mode != "refresh":
        found = snapshots.current(spark, path)
        if found and not found.changed(spark):
            return found.read(spark, "rows")
        if mode == "read_only":
            raise Missing(f"{key} {'was changed' if found else 'is not stored'}")
    return snapshots.publish(spark, path, {"rows": make()}).read(spark, "rows")


# --- reports and run outputs ----------------------------------------------------------------------------------


def write_report(tables: dict[str, DataFrame], path: str, failed: bool, message: str = "") -> Version:
    """Publishes every table of a report, and only then raises if the import failed."""
    spark = next(iter(tables.values())).sparkSession
    out = snapshots.publish(spark, path, {name: Table(df, "json") for name, df in tables.items()}, note={"failed": failed})
    if failed:
        raise RuntimeError(message or f"import failed, see {path}")
    return out


def write_trades(trades: DataFrame, path: str) -> Version:
    """trades.parquet and trades.csv, both by entry time and id. Each part of the latter begins with a byte-order mark and
    the header, and parts follow each other in order, so no task writes them all."""
    ordered = trades.orderBy("entry_time_ns", "trade_id")
    flat = ordered.select(*(F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in ordered.dtypes))
    marked = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    return snapshots.publish(trades.sparkSession, path, {"trades.parquet": ordered, "trades.csv": Table(marked, "csv", options={"header": "true"})})


def market_with_trades(bars: DataFrame, activity: DataFrame, path: str) -> Version:
    """Bars with their trade activity, per symbol and timeframe; every bar once, or nothing is published."""
    clash = set(bars.columns) & set(RESERVED)
    if clash:
        raise ValueError(f"bars already have the columns {sorted(clash)}")
    expected, added = bars.count(), [c for c in RESERVED if c in activity.columns]
    joined = bars.join(activity.select("symbol", "sequence", *added), ["symbol", "sequence"], "left")

    def every_bar(told: dict[str, dict]) -> None:
        if told["market"]["rows"] != expected:
            raise RuntimeError(f"{told['market']['rows']} bars of {expected}")

    return snapshots.publish(bars.sparkSession, path, {"market": Table(joined, partition_by=("symbol", "timeframe"))}, check=every_bar)


def write_streams(out: DataFrame, path: str) -> Version:
    """A fold's output as JSON lines: actions, chart commands, logs."""
    kinds = {"actions": "kind like 'order.%' or kind like 'position.%' or kind = 'fill'", "chart": "kind = 'chart'", "logs": "kind = 'log'"}
    return snapshots.publish(out.sparkSession, path, {name: Table(out.where(where).sortWithinPartitions("run_id", "seq"), "json") for name, where in kinds.items()})


def read_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_table(spark, path, name)


def write_bundle(tables: dict[str, DataFrame], path: str, run_id: str) -> DataFrame:
    """Publishes a run's tables; returns its manifest (run_id, table, rows, digest)."""
    spark = next(iter(tables.values())).sparkSession
    told = snapshots.publish(spark, path, tables, note={"run_id": run_id}).tables
    return spark.createDataFrame([(run_id, name, t["rows"], t["digest"]) for name, t in told.items()], "run_id string, table string, rows long, digest string")


def run_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, table, rows, digest, path) of all bundles below ``root``, the last version of each; broken commits are left out."""
    schema = "version long, data string, note struct<run_id:string>, tables map<string,struct<rows:long,digest:string>>"
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "0*.json").json(root)
    run = F.regexp_replace(F.col("_metadata.file_path"), "/commits/[^/]*$", "")
    found = found.select("*", run.alias("run"), F.col("_metadata.file_path").alias("file")).where("note.run_id is not null and run <> file and version is not null")
    last = found.groupBy("run").agg(F.max_by(F.struct("note.run_id", "data", "tables"), "version").alias("v"))
    each = last.select("v.run_id", "run", "v.data", F.explode("v.tables").alias("table", "told"))
    return each.select("run_id", "table", "told.rows", "told.digest", F.concat_ws("/", "run", "data", "table").alias("path"))


def verify_bundle(spark: SparkSession, catalog: DataFrame, run_id: str) -> list[str]:
    """Tables of a run whose rows are not those of its manifest."""
    found = catalog.where(F.col("run_id") == run_id).collect()  # a row per table of one run
    return [r.table for r in found if snapshots.seal(spark.read.parquet(r.path)) != (r.rows, r.digest)]


def packages(entries: Sequence[dict], known: Sequence[str] = ()) -> tuple[list[dict], list[str]]:
    """(usable, problems) of package descriptions (id, version, entry, enabled): skips disabled ones, refuses
    repeated ids, paths that leave their folder, and entries that are not ``module:object``."""
    usable, problems, seen = [], [], set(known)
    for e in entries:
        if not e.get("enabled", True):
            continue
        wrong = (
            "repeated id" if e["id"] in seen else "path leaves its folder" if ".." in e.get("path", "").split("/") or e.get("path", "").startswith("/") else "entry must be module:object" if e.get("entry", "").count(":") != 1 else None
        )
        if wrong:
            problems.append(f"{e['id']}: {wrong}")
        else:
            seen.add(e["id"])
            usable.append(e)
    return usable, problems
