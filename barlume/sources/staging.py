"""Parsed files, kept by content: an import parses only files that it has not parsed before.

A file's key is the hash of its bytes with everything that shapes its rows (name, timeframe, settings). Its rows lie
in the folder of the import that parsed it; a published manifest says which keys are there:

    root/rows/batch=<import>/key=<file>     parsed rows
    root/manifest                           versions of (key, batch, symbol, timeframe, rows, digest)

The listing of an import meets the manifest by key. What it lacks is parsed, one scan a timeframe, and published as
one more batch; everything else is read where it lies. Rows of imports that were killed have no entry, so
nothing reads them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from barlume.sources import snapshots

MANIFEST = "key string, batch string, symbol string, timeframe string, name string, rows long, digest string"


class Missing(LookupError):
    """Read-only use of something that is not stored."""


def keyed(files: DataFrame, settings: dict) -> DataFrame:
    """``files`` (sha256, symbol, timeframe) with ``key``."""
    shape = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)
    return files.withColumn("key", F.concat(F.lit("k"), F.sha2(F.concat_ws("\n", "sha256", "symbol", "timeframe", F.lit(shape)), 256)))


def _told(rows: DataFrame) -> DataFrame:
    """(batch, key, rows, digest) of stored rows; the digest is the sum of the rows' hashes."""
    columns = [c for c in rows.columns if c not in ("batch", "key")]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("batch", "key").agg(F.count("*").alias("rows"), total.alias("digest"))


def _stored(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{root}/rows")


def _rows_of(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The stored rows of ``entries`` (batch, key); folders of others are pruned."""
    return stored.join(entries.select("batch", "key"), ["batch", "key"], "left_semi")


def sound(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Those of ``entries`` whose stored rows are still what was published."""
    # a file without rows has none to lose
    there = _told(_rows_of(stored, entries)).withColumnsRenamed({"rows": "rows_now", "digest": "digest_now"})
    met = entries.join(there, ["batch", "key"], "left")
    return met.where((F.col("rows") == F.coalesce("rows_now", F.lit(0))) & F.col("digest").eqNullSafe(F.col("digest_now"))).select(entries.columns)


def stage(
    spark: SparkSession, root: str, files: DataFrame, settings: dict, parse: Callable[[str, list[str]], DataFrame], mode: str = "reuse"
) -> tuple[DataFrame, DataFrame]:
    """(rows, entries) of ``files`` (path, name, symbol, timeframe, sha256), parsed by ``parse(timeframe, paths)`` where they
    are not stored yet; its rows have ``symbol`` and ``timeframe``, which name their file.

    Modes: ``reuse``; ``refresh`` parses all of them anew; ``read_only`` raises ``Missing`` with the names of files that are
    not stored. ``entries`` has ``reused``."""
    wanted = keyed(files, settings)
    last = snapshots.current(spark, f"{root}/manifest")
    known = last.read(spark, "files") if last else spark.createDataFrame([], MANIFEST)
    mine = known.join(wanted.select("key"), "key", "left_semi")
    have = mine.limit(0)
    if last and mode != "refresh" and snapshots.exists(spark, f"{root}/rows"):
        have = sound(_stored(spark, root, last.note["schema"]), mine)
    todo = wanted.join(have.select("key"), "key", "left_anti").select("key", "path", "name", "symbol", "timeframe").orderBy("timeframe", "path").collect()
    if todo and mode == "read_only":
        raise Missing(f"not stored: {[f.name for f in todo]}")
    if not todo:
        return _rows_of(_stored(spark, root, last.note["schema"]), have).drop("batch", "key"), have.withColumn("reused", F.lit(True))
    batch = f"b{uuid.uuid4().hex}"
    parts: dict[str, list] = {}
    for f in todo:
        parts.setdefault(f.timeframe, []).append(f)
    for timeframe, some in parts.items():  # one scan a timeframe, 21 at most
        names = spark.createDataFrame([(f.symbol, f.timeframe, f.key) for f in some], "symbol string, timeframe string, key string")
        rows = parse(timeframe, [f.path for f in some]).join(names, ["symbol", "timeframe"]).withColumn("batch", F.lit(batch))
        rows.write.mode("append").partitionBy("batch", "key").parquet(f"{root}/rows")
    schema = rows.select(*(c for c in rows.columns if c not in ("batch", "key")), "batch", "key").schema.json()
    stored = _stored(spark, root, schema)
    new = spark.createDataFrame([(f.key, batch, f.symbol, f.timeframe, f.name) for f in todo], "key string, batch string, symbol string, timeframe string, name string")
    new = new.join(_told(stored.where(F.col("batch") == batch)), ["batch", "key"], "left")
    new = new.select("key", "batch", "symbol", "timeframe", "name", F.coalesce("rows", F.lit(0)).alias("rows"), "digest")
    old = known.join(new.select("key"), "key", "left_anti")
    published = snapshots.publish(spark, f"{root}/manifest", {"files": old.unionByName(new)}, expect=last.number if last else 0, note={"schema": schema})
    entries = published.read(spark, "files").join(wanted.select("key"), "key", "left_semi").withColumn("reused", F.col("batch") != batch)
    return _rows_of(stored, entries).drop("batch", "key"), entries


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = snapshots.GRACE_SECONDS) -> list[str]:
    """Deletes batches that no entry of the last ``keep`` manifests names, once they are older than ``grace_seconds``."""
    import time

    kept: set[str] = set()
    for n in snapshots.numbers(spark, f"{root}/manifest")[-keep:]:
        files = snapshots.version(spark, f"{root}/manifest", n).read(spark, "files")
        kept |= {r.batch for r in files.select("batch").distinct().collect()}  # a row per import that is still in use
    listed = [(name, at) for name, at in snapshots._listed(spark, f"{root}/rows") if name.startswith("batch=")]
    gone = [name for name, at in listed if name.removeprefix("batch=") not in kept and time.time() - at > grace_seconds]
    for name in gone:
        snapshots.delete(spark, f"{root}/rows/{name}")
    return gone + snapshots.vacuum(spark, f"{root}/manifest", keep, grace_seconds)
