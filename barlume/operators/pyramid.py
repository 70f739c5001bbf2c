"""Min/max pyramids: a series at every power of two, so that a view of any width is read from one level.

A node of level L stands for 2^L rows that follow each other: how many there are, the first and last, the lowest and
highest (of equals the first), each with its time. Levels are made by blocks: a task has a block of
2^``BLOCK_LEVELS`` nodes in order, halves it until one is left, and gives all levels in between; the blocks'
last nodes are the next round's input. So a series of any length takes a round per 2^``BLOCK_LEVELS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barlume.operators.bars import SERIES, segment
from barlume.operators.joins import running
from barlume.sources import snapshots

BLOCK_LEVELS = 12
NODE = "level int, node long, n long, first_ns long, first_value double, last_ns long, last_value double, low_ns long, low_value double, high_ns long, high_value double"
_FIELDS = [f.split()[0] for f in NODE.split(", ")][2:]


def leaves(bars: DataFrame, value: str) -> DataFrame:
    """Level 0: a node per row, numbered per series in time order."""
    some = bars.select(*SERIES, "open_time_ns", F.col(value).cast("double").alias("__value"))
    rows = running(some, SERIES, ["open_time_ns"], segment("open_time_ns"), {"__i": ("count", F.lit(1))})
    at = [F.col("open_time_ns").alias(f"{k}_ns") for k in ("first", "last", "low", "high")]
    values = [F.col("__value").alias(f"{k}_value") for k in ("first", "last", "low", "high")]
    return rows.select(*SERIES, F.lit(0).alias("level"), (F.col("__i") - 1).alias("node"), F.lit(1).cast("long").alias("n"), *(x for pair in zip(at, values, strict=True) for x in pair))


def _halve(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes two by two; an odd last one stays as it is."""
    odd = len(x["n"]) % 2
    a = {k: v[0::2] for k, v in x.items()}
    b = {k: (np.append(v[1::2], v[-1:]) if odd else v[1::2]) for k, v in x.items()}
    lower, higher = b["low_value"] < a["low_value"], b["high_value"] > a["high_value"]
    out = {"n": a["n"] + b["n"], "first_ns": a["first_ns"], "first_value": a["first_value"], "last_ns": b["last_ns"], "last_value": b["last_value"]}
    if odd:
        out["n"][-1] = x["n"][-1]
    for k in ("ns", "value"):
        out[f"low_{k}"] = np.where(lower, b[f"low_{k}"], a[f"low_{k}"])
        out[f"high_{k}"] = np.where(higher, b[f"high_{k}"], a[f"high_{k}"])
    return out


def _above(nodes: DataFrame, level: int, levels: int) -> DataFrame:
    """All levels above ``level`` within blocks of 2^``levels`` of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            x = {k: np.concatenate([part[k] for part in held]) for k in _FIELDS}
            *names, block = key
            for up in range(1, levels + 1):
                x = _halve(x)
                first, size = block << (levels - up), len(x["n"])
                columns = [pa.array([k] * size, pa.string()) for k in names]
                columns += [pa.array(np.full(size, level + up, np.int32)), pa.array(np.arange(first, first + size)), *(pa.array(x[k]) for k in _FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, names=[*SERIES, "level", "node", *_FIELDS])

        for b in batches:
            column = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
            of = [column[k] for k in (*SERIES, "block")]
            new = np.zeros(max(0, b.num_rows - 1), bool)
            for c in of:
                new |= c[1:] != c[:-1]
            ends = [*(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if start == end:
                    continue
                now = (of[0][start], of[1][start], int(of[2][start]))
                if now != key:
                    if held:
                        yield from close()
                    key, held = now, []
                held.append({k: column[k][start:end].copy() for k in _FIELDS})
        if held:
            yield from close()

    dealt = nodes.select(*SERIES, F.expr(f"node div {1 << levels}").alias("block"), "node", *_FIELDS)
    dealt = dealt.repartition(*SERIES, "block").sortWithinPartitions(*SERIES, "block", "node")
    return dealt.mapInArrow(run, f"symbol string, timeframe string, {NODE}")


def write(bars: DataFrame, path: str, value: str = "close_ticks", levels: int = BLOCK_LEVELS, group_bytes: int = 1 << 20) -> snapshots.Version:
    """Publishes the pyramid of every series of ``bars``: a folder per level, sorted by series and time."""
    spark = bars.sparkSession
    order = (*SERIES, "node")
    rounds = [snapshots.publish(spark, f"{path}/rounds", {"nodes": leaves(bars, value)})]
    at, parts = 0, [rounds[0].read(spark, "nodes")]
    while parts[-1].where(F.col("level") == at).agg(F.max("node")).first()[0]:  # some series has more than one node
        done = snapshots.publish(spark, f"{path}/rounds", {"nodes": _above(parts[-1].where(F.col("level") == at), at, levels)})
        rounds.append(done)
        parts.append(done.read(spark, "nodes"))
        at += levels
    rows = reduce(DataFrame.unionByName, parts).repartitionByRange("level", *order).sortWithinPartitions("level", *order)
    options = {"parquet.block.size": str(group_bytes), "parquet.page.size": str(min(group_bytes, 1 << 16))}
    out = snapshots.publish(spark, path, {"nodes": snapshots.Table(rows, partition_by=("level",), options=options)})
    snapshots.delete(spark, f"{path}/rounds")
    return out


def nodes(pyramid: snapshots.Version, spark: SparkSession, level: int, from_ns: int | None = None, to_ns: int | None = None, where: dict[str, str] | None = None) -> DataFrame:
    """The nodes of one level that touch [from, to]; ``where``: symbol and timeframe."""
    out = pyramid.read(spark, "nodes").where(F.col("level") == level)
    for k, v in (where or {}).items():
        out = out.where(F.col(k) == v)
    if from_ns is not None:
        out = out.where(F.col("last_ns") >= from_ns)
    return out if to_ns is None else out.where(F.col("first_ns") <= to_ns)


def level_for(pyramid: snapshots.Version, spark: SparkSession, points: int, from_ns: int | None = None, to_ns: int | None = None, where: dict[str, str] | None = None) -> int:
    """The lowest level at which every series' view takes at most ``points`` rows (two a node, and its ends).

    Begins where whole series would fit and looks down, so it reads about as many nodes as the view has points."""
    top = max(int(name.split("=")[1]) for name in snapshots.entries(spark, pyramid.path("nodes")) if name.startswith("level="))
    longest = nodes(pyramid, spark, top, where=where).agg(F.max("n")).first()[0] or 0
    best = 0
    while best < top and 2 * -(-longest // (1 << best)) + 2 > points and (best or longest > points):
        best += 1
    for level in range(best - 1, -1, -1):
        most = nodes(pyramid, spark, level, from_ns, to_ns, where).groupBy(*SERIES).count().agg(F.max("count")).first()[0] or 0
        if (2 * most + 2 if level else most) > points:
            break
        best = level
    return best


def view(pyramid: snapshots.Version, spark: SparkSession, points: int, from_ns: int | None = None, to_ns: int | None = None, where: dict[str, str] | None = None) -> DataFrame:
    """(symbol, timeframe, open_time_ns, value): at most ``points`` rows per series that keep its envelope, from one level: the
    lowest and highest row of each node in view, and the first and last row. All rows, where they are few enough."""
    level = level_for(pyramid, spark, points, from_ns, to_ns, where)
    found = nodes(pyramid, spark, level, from_ns, to_ns, where)
    row = lambda k: F.struct(F.col(f"{k}_ns").alias("open_time_ns"), F.col(f"{k}_value").alias("value"))
    ends = found.groupBy(*SERIES).agg(F.min_by(row("first"), "node").alias("a"), F.max_by(row("last"), "node").alias("b"))
    rows = found.select(*SERIES, F.explode(F.array(row("low"), row("high"))).alias("x")).unionByName(ends.select(*SERIES, F.explode(F.array("a", "b")).alias("x")))
    return rows.distinct().select(*SERIES, "x.open_time_ns", "x.value")
