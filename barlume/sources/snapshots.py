"""Published versions of tables in a folder.

A write goes to a folder of its own; one small commit file, created only if no other has its number, makes it the
current version. So a reader sees all of a version or none of it, a writer that fails or is killed half-way
leaves the version before as it was, and of two writers that started from the same version one gets ``Conflict``.

    root/data/<id>/<table>          the tables of one version
    root/commits/<number>.json     what version they are, with each table's rows and digest

The commit file is written under another name and then given its own, which on HDFS (rename) and on POSIX file
systems (link) fails if the name is taken. A store without either needs a catalogue in front of it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

COMMIT = "{:012d}.json"
GRACE_SECONDS = 24 * 3600


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Table:
    """A frame and how it is to lie: format, options, folders per value, and columns that the digest leaves out."""

    rows: DataFrame
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Version:
    number: int
    root: str
    data: str
    tables: dict[str, dict]
    note: dict

    def path(self, name: str) -> str:
        return f"{self.root}/{self.data}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The table as it was written: its format, options and columns."""
        told = self.tables[name]
        schema = StructType.fromJson(json.loads(told["schema"]))
        return spark.read.format(told["format"]).options(**told["options"]).schema(schema).load(self.path(name))

    def changed(self, spark: SparkSession) -> list[str]:
        """Tables whose rows are no longer those that were published."""
        return [name for name, told in self.tables.items() if seal(self.read(spark, name)) != (told["rows"], told["digest"])]


# --- files -------------------------------------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, time of change in seconds) of a folder's entries."""
    fs, at = _at(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    return [name for name, _ in _listed(spark, path)]


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _at(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def _claim(spark: SparkSession, made: str, name: str) -> bool:
    """Gives the file ``made`` its name, if no file has it; whether it did."""
    fs, at = _at(spark, name)
    if fs.getUri().getScheme() == "file":
        here, there = urlparse(made).path, urlparse(name).path
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
        return True
    done = not fs.exists(at) and fs.rename(spark._jvm.org.apache.hadoop.fs.Path(made), at)
    if not done:
        delete(spark, made)
    return done


# --- versions ----------------------------------------------------------------------------------------------


def seal(df: DataFrame) -> tuple[int, str]:
    """(rows, digest): the digest is free of order, the sum of the rows' hashes."""
    got = df.agg(*_seal(df)).first()
    return got["rows"], str(got["digest"])


def _seal(df: DataFrame) -> list:
    fields = sorted(df.schema.fields, key=lambda f: f.name)  # folders' columns change places when they are read
    hashed = [F.to_json(f.name) if f.dataType.simpleString().startswith("map") else F.col(f"`{f.name}`") for f in fields]
    total = F.sum(F.xxhash64(*hashed).cast("decimal(38,0)"))
    return [F.count("*").alias("rows"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("digest")]


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name.split(".")[0]) for name, _ in _listed(spark, f"{root}/commits") if name.endswith(".json") and name[0].isdigit())


def version(spark: SparkSession, root: str, number: int) -> Version:
    root = root.rstrip("/")
    told = json.loads(_read_text(spark, f"{root}/commits/{COMMIT.format(number)}"))
    return Version(number, root, told["data"], told["tables"], told["note"])


def current(spark: SparkSession, root: str) -> Version | None:
    """The version published last; what is read from it stays that version's until it is vacuumed."""
    known = numbers(spark, root.rstrip("/"))
    return version(spark, root, known[-1]) if known else None


def publish(
    spark: SparkSession,
    root: str,
    tables: Mapping[str, DataFrame | Table],
    expect: int | None = None,
    note: Mapping | None = None,
    check: Callable[[dict[str, dict]], None] | None = None,
) -> Version:
    """Writes ``tables`` as the next version. ``expect``: the number that must be current (0: none), else
    ``Conflict``; by default whatever is current now, so that only a writer in between conflicts. ``check`` sees
    each table's rows and digest before the commit, and may raise. Rows are counted as they are written."""
    root = root.rstrip("/")
    known = numbers(spark, root)
    base = known[-1] if known else 0
    if expect is not None and expect != base:
        raise Conflict(f"{root} is at version {base}, not {expect}")
    data = f"data/{uuid.uuid4().hex}"
    try:
        told = {}
        for name, some in tables.items():
            t = some if isinstance(some, Table) else Table(some)
            seen = Observation()
            out = t.rows.observe(seen, *_seal(t.rows)).write.format(t.format).options(**t.options)
            (out.partitionBy(*t.partition_by) if t.partition_by else out).save(f"{root}/{data}/{name}")
            parts = set(t.partition_by)  # folders' columns come last when they are read
            schema = StructType([f for f in t.rows.schema.fields if f.name not in parts] + [t.rows.schema[p] for p in t.partition_by])
            got = seen.get
            told[name] = {"rows": got["rows"], "digest": str(got["digest"]), "format": t.format, "options": dict(t.options), "schema": schema.json()}
        if check:
            check(told)
        text = json.dumps({"version": base + 1, "data": data, "tables": told, "note": dict(note or {})})
        made = f"{root}/commits/_{uuid.uuid4().hex}"
        _write_text(spark, made, text)
        if not _claim(spark, made, f"{root}/commits/{COMMIT.format(base + 1)}"):
            raise Conflict(f"{root}: version {base + 1} was published by another writer")
    except BaseException:
        delete(spark, f"{root}/{data}")
        raise
    return version(spark, root, base + 1)


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = GRACE_SECONDS, now: float | None = None) -> list[str]:
    """Deletes what no version of the last ``keep`` holds: older versions, and folders of writers that were killed.
    Nothing younger than ``grace_seconds`` goes, since its writer or a reader may be at work."""
    import time

    root, now = root.rstrip("/"), time.time() if now is None else now
    known = numbers(spark, root)
    kept = {version(spark, root, n).data for n in known[-keep:]}
    gone = [f"data/{name}" for name, at in _listed(spark, f"{root}/data") if f"data/{name}" not in kept and now - at > grace_seconds]
    for n in known[:-keep]:
        if version(spark, root, n).data in gone:
            gone.append(f"commits/{COMMIT.format(n)}")
    gone += [f"commits/{name}" for name, at in _listed(spark, f"{root}/commits") if name.startswith("_") and now - at > grace_seconds]
    for path in sorted(gone):  # commits first: a version that is listed has its data
        delete(spark, f"{root}/{path}")
    return gone
