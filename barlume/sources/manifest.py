"""Dataset manifests: what a file or series holds, for later comparison."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlume.functions.text import run_digest
from barlume.operators.bars import segment

#: Bytes of a file that a task holds at a time.
CHUNK = 4 << 20


def build_manifest(bars: DataFrame, size: Column, block: int = 10_000) -> DataFrame:
    """(symbol, timeframe, sha256, size_bytes, row_count, start_ns, end_ns) of canonical bars.

    The hash is that of the hashes of blocks of ``block`` bars in time order, so a series of any length is
    hashed by many tasks and no task gathers it."""
    keys = ["symbol", "timeframe"]
    line = F.concat_ws(",", F.col("open_time_ns").cast("string"), F.col("close_ticks").cast("string"))
    found = run_digest(bars, keys, ["open_time_ns"], line, block, segment("open_time_ns"))
    digest = found.select(*keys, F.col("digest").alias("sha256"))
    told = bars.groupBy(*keys).agg(
        F.sum(size).alias("size_bytes"), F.count("*").alias("row_count"), F.min("open_time_ns").alias("start_ns"), F.max("open_time_ns").alias("end_ns")
    )
    return digest.join(told, keys)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(path, name, size_bytes) of files; only the listing is read. Spark's reader skips files without a byte, so those are
    added from its index (a path per file, as the driver holds it anyway)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    paths = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()]
    found = spark.createDataFrame(paths, "path string").join(files.select("path", "length"), "path", "left")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.coalesce("length", F.lit(0)).alias("size_bytes"))


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(path, name, size_bytes, sha256) of files."""
    return hashed(list_files(spark, folder, pattern, recursive))


# --- hashes of files -----------------------------------------------------------------------------------------


def open_file(path: str):
    """A stream of the file's bytes: local paths by Python, others by Arrow's file systems."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return open(unquote(at.path), "rb", buffering=0)
    system, inside = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_stream(inside)


def digest(path: str, chunk: int = CHUNK) -> tuple[str, int]:
    """(SHA-256, bytes) of a file of any size, ``chunk`` bytes at a time."""
    total, n = hashlib.sha256(), 0
    with open_file(path) as f:
        while block := f.read(chunk):
            total.update(block)
            n += len(block)
    return total.hexdigest(), n


def _arrow_reads(path: str) -> bool:
    if urlparse(path).scheme in ("", "file"):
        return True
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def hashed(files: DataFrame, by_lines: bool | None = None) -> DataFrame:
    """``files`` (path, size_bytes and more) with ``sha256``.

    A file is one sequence for its hash, so it is one task's, which holds ``CHUNK`` bytes of it. Files are dealt in the
    order of their sizes, so that no task gets all the large ones. Where only Spark's readers reach the files
    (``by_lines``; by default found out from the first path), their lines are streamed to the task in order instead."""
    n, first = files.agg(F.count("*"), F.min("path")).first()
    if by_lines is None:
        by_lines = first is not None and not _arrow_reads(first)
    if by_lines:
        return files.join(_hashed_by_lines(files), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(p)[0] for p in b.column(b.schema.get_field_index("path")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "sha256"])

    tasks = max(1, min(n, files.sparkSession.sparkContext.defaultParallelism * 4))
    dealt = files.orderBy(F.desc("size_bytes"), "path").repartition(tasks)
    return dealt.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields), "sha256 string"]))


def _hashed_by_lines(files: DataFrame) -> DataFrame:
    """(path, sha256): the bytes of a file are its lines and the line feeds between them; its size tells whether one ends it."""
    spark = files.sparkSession
    sizes = {r.path: r.size_bytes for r in files.select("path", "size_bytes").collect()}  # as the listing itself
    lines = spark.read.option("lineSep", "\n").text(list(sizes))
    at = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").cast("binary").alias("line"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, size, n, total = None, 0, 0, None

        def close() -> pa.RecordBatch:
            if n < size:
                total.update(b"\n")
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total.hexdigest()])], names=["path", "sha256"])

        for b in batches:
            for p, s, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), strict=True):
                if p != path:
                    if path is not None:
                        yield close()
                    path, size, n, total = p, s, 0, hashlib.sha256()
                else:
                    total.update(b"\n")
                    n += 1
                total.update(line.as_buffer())
                n += len(line.as_buffer())
        if path is not None:
            yield close()

    found = at.repartition("path").sortWithinPartitions("path", "block", "id").mapInArrow(run, "path string, sha256 string")
    empty = [(p, hashlib.sha256().hexdigest()) for p, n in sizes.items() if n == 0]
    return found.unionByName(spark.createDataFrame(empty, "path string, sha256 string")) if empty else found
