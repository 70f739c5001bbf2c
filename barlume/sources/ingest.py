"""Import of raw bar files: read, check, number, store, audit, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlume.functions import parsing as P
from barlume.operators import quality as Q
from barlume.sources import csv_bars, manifest, snapshots, staging, store


def import_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    zone: str = "UTC",
    digits: int = 2,
    tick_points: int = 1,
    policy: str = "mark",
    watermark_ns: int | None = None,
    fail_on_warnings: bool = False,
    recursive: bool = False,
    mode: str = "reuse",
) -> dict[str, DataFrame]:
    """Imports every bar file of a folder; returns the report's tables after writing them, the bars, and ``files`` (whether
    each was reused).

    Parsed rows are kept by the content of each file and what shapes them (``staging``): an import parses only files that
    were not parsed before (``reuse``), all of them (``refresh``), or must find all (``read_only``).
    Any rejected row, misnamed or repeated file is an error; then the report is written and RuntimeError raised."""
    listing = csv_bars.discover(spark, folder, recursive)
    kinds = listing.groupBy("symbol", "timeframe").agg(F.count("*").alias("files"), F.count_if(F.col("size_bytes") == 0).alias("empty")).collect()  # a row per series
    if not kinds:
        raise FileNotFoundError(f"no bar files in {folder}")
    if any(r.symbol is None or r.files > 1 or r.empty for r in kinds):
        names = [r.name for r in listing.where("symbol is null or size_bytes = 0").orderBy("name").collect()]
        raise ValueError(f"files with wrong names or nothing in them: {names}; repeated series: {sorted((r.symbol, r.timeframe) for r in kinds if r.symbol and r.files > 1)}")
    listed = snapshots.publish(spark, f"{out}/listing", {"files": manifest.hashed(listing)})  # hashed once

    def parse(timeframe: str, paths: list[str]) -> DataFrame:
        raw = csv_bars.read_all(spark, paths, timeframe)
        told = P.file_name(F.element_at(F.split(F.col("path"), "/"), -1))
        raw = raw.withColumns({"symbol": told["symbol"], "timeframe": F.lit(timeframe)}).drop("path")
        return Q.parse_rows(raw, timeframe, zone, digits, tick_points)

    shape = {"zone": zone, "digits": digits, "tick": tick_points}
    everything, entries = staging.stage(spark, f"{out}/staged", listed.read(spark, "files"), shape, parse, mode)
    by_timeframe = {r.timeframe for r in kinds}
    good = Q.accepted(everything)
    if watermark_ns is None:
        last = good.groupBy("symbol", "timeframe").agg(F.max_by("open_time_ns", "source_row").alias("last_open_ns"))
        watermark_ns = Q.watermark(last.join(_seconds(spark), "timeframe")).first()[0]
    bars = Q.number(Q.complete(good, watermark_ns or 0, policy), ["symbol", "timeframe"]).drop("local_time", "reject_code")
    store.write_bars(bars, f"{out}/bars")
    stored = store.read_bars(spark, f"{out}/bars")
    base = Q.audit_base(stored.select("symbol", "timeframe").distinct().join(_seconds(spark), "timeframe"))
    base = base.withColumnRenamed("base_timeframe", "timeframe")
    of_base = stored.join(base, ["symbol", "timeframe"], "left_semi")
    others = stored.join(base, ["symbol", "timeframe"], "left_anti")
    audit = Q.audit_summary(Q.cross_audit(of_base, others))
    counts = Q.code_counts(everything, ["symbol", "timeframe"])
    checks = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [Q.time_checks(good.where(F.col("timeframe") == tf), ["symbol", "timeframe"], tf) for tf in sorted(by_timeframe)],
    )
    # written before they are summed up, so that no check runs twice
    found = snapshots.publish(spark, f"{out}/findings", {"reject_codes": counts, "time_checks": checks, "audit": audit})
    tables = {name: found.read(spark, name) for name in found.tables}
    errors = tables["reject_codes"].select("symbol", F.lit("ERROR").alias("severity"))
    warnings = tables["audit"].where("mismatching > 0").select("symbol", F.lit("WARNING").alias("severity"))
    told = Q.severity(errors.unionByName(warnings), ["symbol"], fail_on_warnings)
    tables |= {"files": entries.select("symbol", "timeframe", "name", "rows", "reused"), "severity": told}
    store.write_report(tables, f"{out}/report", failed=not told.where("not success").isEmpty())
    return {"bars": stored} | tables


def _seconds(spark: SparkSession) -> DataFrame:
    from barlume.schema import timeframes

    return F.broadcast(timeframes(spark))
