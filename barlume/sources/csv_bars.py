"""Raw bar files: CSV with a strict header, one line per bar, in file order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barlume.functions import parsing as P
from barlume.sources.manifest import list_files

NAMES = {"<DATE>": "date", "<TIME>": "time", "<OPEN>": "open", "<HIGH>": "high", "<LOW>": "low", "<CLOSE>": "close", "<TICKVOL>": "tickvol", "<VOL>": "vol", "<SPREAD>": "spread"}


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name, size_bytes, symbol, timeframe, declared_start, declared_end); nulls where the name is none of a bar file."""
    found = list_files(spark, folder, "*.csv", recursive)
    return found.select("path", "name", "size_bytes", *(c.alias(k) for k, c in P.file_name(F.col("name")).items()))


def read_all(spark: SparkSession, paths: Sequence[str], timeframe: str) -> DataFrame:
    """(path, source_row, date, time, ... spread) of any number of files of one timeframe as text, in one scan;
    ``source_row`` is the line number, the first data line 2.

    Header lines are checked first, all in one aggregate; a wrong one is an error that names its file. Columns are
    found by each file's own header and separator. Lines keep their number by the file's own byte order:
    rows per split are counted, then numbered from the count before; no line goes through one task."""
    lines = spark.read.text(list(paths))
    at = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    splits = at.groupBy("path", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.min_by("value", "__id").alias("__top"))
    header = F.rtrim(F.ltrim(F.col("__top"), F.lit("\ufeff")), F.lit("\r"))
    heads = splits.where("__block = 0").select("path", header.alias("__header"))
    told = heads.select("path", F.when(F.trim("__header") == "", "empty header").otherwise(P.header_error(F.col("__header"), timeframe == "D1")).alias("error"))
    wrong = told.where("error is not null").orderBy("path").first()
    if wrong:
        raise ValueError(f"{wrong.path}: {wrong.error}")
    if not heads.isEmpty():
        heads = heads.withColumn("__sep", P.delimiter(F.col("__header")))
    else:
        heads = heads.withColumn("__sep", F.lit(None).cast("string"))
    # a row per split: the numbers before it within its file
    upto = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).select("path", "__block", "__first", "__before")
    quoted = F.concat(F.lit("\\Q"), F.col("__sep"), F.lit("\\E"))
    heads = heads.select("path", quoted.alias("__sep"), F.transform(F.split("__header", quoted), lambda c: F.upper(F.trim(c))).alias("__names"))
    rows = at.join(before, ["path", "__block"]).join(heads, "path").withColumn("source_row", F.col("__id") - F.col("__first") + F.col("__before") + 1)
    rows = rows.where((F.col("source_row") > 1) & (F.trim("value") != "")).withColumn("p", F.split(F.rtrim(F.regexp_replace("value", "\r$", "")), F.col("__sep")))
    cell = lambda c: F.get("p", (F.array_position("__names", c) - 1).cast("int"))
    cells = {k: F.when(F.array_contains("__names", c), cell(c)) for c, k in NAMES.items()}
    cells["time"] = F.when(F.array_contains("__names", "<TIME>"), cells["time"]).otherwise(F.lit("00:00:00"))
    return rows.select("path", "source_row", *(cells[c].alias(c) for c in NAMES.values()))


def read(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """``read_all`` of one file, without its path."""
    return read_all(spark, [path], timeframe).drop("path")


def preflight(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(rows, first_ns, last_ns, nonzero_volume, decimals) of raw rows; dates may be written in several ways."""
    both = F.concat_ws(" ", "date", "time")
    at = F.coalesce(*(F.try_to_timestamp(both, F.lit(f)) for f in ("yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")))
    digits = F.greatest(*(F.length(F.regexp_extract(c, r"\.([0-9]+)\s*$", 1)) for c in ("open", "high", "low", "close")))
    ns = F.unix_micros(at) * 1000
    return raw.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(ns).alias("first_ns"), F.max(ns).alias("last_ns"), F.count_if(P.whole_number(F.col("tickvol")) != 0).alias("nonzero_volume"), F.max(digits).alias("decimals"))
