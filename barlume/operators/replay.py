"""Replay of stored runs: ordered timelines, state at a time, windows with their seed, paging, views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlume.operators.bars import segment
from barlume.operators.joins import last_n, latest_by, running
from barlume.schema import NS

SIX_HOURS_NS = 6 * 3600 * NS


def ordered(timeline: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """``sequence`` from 1 per run by time, priority, source sequence."""
    order = ["time_ns", "priority", "source_sequence"]
    return running(timeline, run, order, segment("time_ns"), {"sequence": ("count", F.lit(1))})


def between(timeline: DataFrame, after_ns: int, until_ns: int) -> DataFrame:
    """(after, until]."""
    return timeline.where((F.col("time_ns") > after_ns) & (F.col("time_ns") <= until_ns))


def page(df: DataFrame, key: str, after: int | None = None, before: int | None = None, limit: int = 100) -> DataFrame:
    """Keyset paging: the rows right after a cursor, or right before one; both in ascending order."""
    if before is not None:
        return df.where(F.col(key) < before).orderBy(F.desc(key)).limit(limit).orderBy(key)
    return (df.where(F.col(key) > after) if after is not None else df).orderBy(key).limit(limit)


def checkpoints(events: DataFrame, keys: Sequence[str], every_ns: int) -> DataFrame:
    """State per entity at every multiple of ``every_ns`` in which it changed: (keys, checkpoint_ns, time_ns, sequence, amount)."""
    cut = events.withColumn("checkpoint_ns", (F.floor(F.col("time_ns") / every_ns) + 1).cast("bigint") * every_ns)
    return latest_by(cut.select(*keys, "checkpoint_ns", "time_ns", "source_sequence", "amount"), [*keys, "checkpoint_ns"], ["time_ns", "source_sequence"])


def state_at(events: DataFrame, keys: Sequence[str], at_ns: int, saved: DataFrame | None = None, every_ns: int | None = None) -> DataFrame:
    """The latest row per entity at ``at_ns``: from the saved checkpoint before it and only the events since."""
    columns = [*keys, "time_ns", "source_sequence", "amount"]
    if saved is None:
        return latest_by(events.where(F.col("time_ns") <= at_ns).select(*columns), keys, ["time_ns", "source_sequence"])
    base = at_ns - at_ns % every_ns
    old = saved.where(F.col("checkpoint_ns") <= base).select(*columns)
    new = events.where((F.col("time_ns") >= base) & (F.col("time_ns") <= at_ns)).select(*columns)
    return latest_by(old.unionByName(new), keys, ["time_ns", "source_sequence"])


def window_with_seed(timeline: DataFrame, keys: Sequence[str], after_ns: int, until_ns: int) -> DataFrame:
    """The window's rows, and before it the latest row of each series."""
    seed = latest_by(timeline.where(F.col("time_ns") <= after_ns), keys, ["time_ns", "source_sequence"])
    return seed.withColumn("is_seed", F.lit(True)).unionByName(between(timeline, after_ns, until_ns).withColumn("is_seed", F.lit(False)))


def compact(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the latest revision; of equal revisions the later row."""
    return latest_by(timeline, keys, ["time_ns", "source_sequence"])


def merge_live(completed: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union by key where live rows override completed ones."""
    both = completed.withColumn("__live", F.lit(0)).unionByName(live.withColumn("__live", F.lit(1)))
    return latest_by(both, keys, ["__live"]).drop("__live")


def recent(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` per type."""
    return last_n(df, keys, ["time_ns", "source_sequence"], n)


def sample_equity(bars: DataFrame, every: int, event: str = "has_event") -> DataFrame:
    """The first row of each run, every k-th, and those with an event."""
    counted = running(bars, ["run_id"], ["time_ns"], segment("time_ns"), {"__n": ("count", F.lit(1))})
    return counted.where((F.col("__n") == 1) | (F.col("__n") % every == 0) | F.col(event)).drop("__n")


def time_bounds() -> tuple[Column, Column]:
    """Where a drawing begins and ends, by kind: a point, a line between anchors, or open to the right (null end)."""
    a, b = F.col("anchor_a_ns"), F.col("anchor_b_ns")
    start = F.when(F.col("kind").isin("horizontal_line"), F.lit(None)).when(F.col("kind") == "marker", a).otherwise(F.least(a, b))
    end = F.when(F.col("kind").isin("horizontal_line", "ray"), F.lit(None)).when(F.col("kind") == "marker", a).otherwise(F.greatest(a, b))
    return start.cast("bigint"), end.cast("bigint")


def viewport(drawings: DataFrame, from_ns: int, to_ns: int, limit: int, margin: float = 0.15, bucket_ns: int = SIX_HOURS_NS, most: int = 64) -> DataFrame:
    """Drawings (drawing_id, ordinal, z_index, from_ns, to_ns) that may show between two times: those that share a
    bucket with the widened view, and those too long (or without end) to be bucketed; the ``limit`` most recent."""
    wide = max(1, to_ns - from_ns) * margin
    lo, hi = int((from_ns - wide) // bucket_ns), int((to_ns + wide) // bucket_ns)
    a, b = F.floor(F.col("from_ns") / bucket_ns), F.floor(F.col("to_ns") / bucket_ns)
    everywhere = F.coalesce(b - a + 1 > most, F.lit(True))
    seen = drawings.where(everywhere | ((a <= hi) & (b >= lo)))
    return seen.orderBy(F.desc("ordinal")).limit(limit)


#: Buckets of an index level: each is so many times as wide as those of the level below.
SPREAD = 8
LONG = -1


def viewport_rows(drawings: DataFrame, bucket_ns: int = SIX_HOURS_NS, most: int = 64) -> DataFrame:
    """``drawings`` as rows of an interval index: (level, bucket, first_bucket, and the drawing).

    A drawing's level is the first whose buckets are as wide as its span, so it touches two of them at most. Those too long
    (or without end) to be bucketed are a level of their own, ``LONG``, with one row."""
    a, b = F.floor(F.col("from_ns") / bucket_ns), F.floor(F.col("to_ns") / bucket_ns)
    widths = _widths(most)
    level = F.when(F.coalesce(b - a + 1 > most, F.lit(True)), F.lit(LONG))
    for k, w in enumerate(widths):
        level = level.when(b - a + 1 <= w, F.lit(k))
    wide = F.lit(1).cast("bigint")
    for k, w in enumerate(widths):
        wide = F.when(F.col("level") == k, F.lit(w).cast("bigint")).otherwise(wide)
    out = drawings.withColumn("level", level)
    first, last = F.floor(a / wide), F.floor(b / wide)
    held = F.when(F.col("level") == LONG, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, last))
    return out.withColumn("first_bucket", F.when(F.col("level") == LONG, F.lit(0).cast("bigint")).otherwise(first)).withColumn("bucket", F.explode(held))


def _widths(most: int) -> list[int]:
    """Widths of the levels' buckets, in buckets of the first."""
    out = [1]
    while out[-1] < most:
        out.append(min(most, out[-1] * SPREAD))
    return out


def write_viewport_index(drawings: DataFrame, path: str, bucket_ns: int = SIX_HOURS_NS, most: int = 64, group_bytes: int = 1 << 20):
    """Publishes the index: a folder per level, sorted by bucket, in row groups that readers skip by it."""
    from barlume.sources import snapshots

    order = ("level", "bucket", "ordinal")
    rows = viewport_rows(drawings, bucket_ns, most).repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"parquet.block.size": str(group_bytes), "parquet.page.size": str(min(group_bytes, 1 << 16))}
    note = {"bucket_ns": bucket_ns, "most": most}
    return snapshots.publish(drawings.sparkSession, path, {"drawings": snapshots.Table(rows, partition_by=("level",), options=options)}, note=note)


def read_viewport(index, spark: SparkSession, from_ns: int, to_ns: int, limit: int, margin: float = 0.15) -> DataFrame:
    """``viewport`` from a published index: of each level only the buckets in view are read, and the long ones."""
    bucket_ns, most = index.note["bucket_ns"], index.note["most"]
    wide = max(1, to_ns - from_ns) * margin
    lo, hi = int((from_ns - wide) // bucket_ns), int((to_ns + wide) // bucket_ns)
    rows = index.read(spark, "drawings")
    seen = rows.where(F.col("level") == LONG)
    a, b = F.floor(F.col("from_ns") / bucket_ns), F.floor(F.col("to_ns") / bucket_ns)
    for k, w in enumerate(_widths(most)):
        first, last = lo // w, hi // w
        part = rows.where((F.col("level") == k) & (F.col("bucket") >= first) & (F.col("bucket") <= last))
        # a drawing in two buckets is taken from the first of them in view
        seen = seen.unionByName(part.where((F.col("bucket") == F.greatest(F.col("first_bucket"), F.lit(first))) & (a <= hi) & (b >= lo)))
    return seen.drop("level", "bucket", "first_bucket").orderBy(F.desc("ordinal")).limit(limit)


def progress(at: Column, start: Column, end: Column) -> Column:
    """Share of the run behind ``at``, within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((at - start).cast("double"), (end - start).cast("double")), F.lit(1.0))))


def prune_series(points: DataFrame, keys: Sequence[str], start_ns: int) -> DataFrame:
    """Points from the one before ``start_ns`` on."""
    edge = points.where(F.col("time_ns") <= start_ns).groupBy(*keys).agg(F.max("time_ns").alias("__edge"))
    return points.join(edge, list(keys), "left").where(F.col("time_ns") >= F.coalesce("__edge", F.lit(start_ns))).drop("__edge")


def bootstrap(bars: DataFrame, timeline: DataFrame, keys: Sequence[str], at_ns: int, bars_n: int, items_n: int) -> dict[str, DataFrame]:
    """All that a view at ``at_ns`` starts from: last bars, last timeline items, state."""
    from barlume.operators.bars import window

    past = timeline.where(F.col("time_ns") <= at_ns)
    return {"bars": window(bars, at_ns, bars_n), "timeline": recent(past, ["run_id"], items_n), "state": state_at(timeline, keys, at_ns)}


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
