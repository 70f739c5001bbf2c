"""Live bars and live runs.

A stream is read from files as they come (or all there are, ``availableNow``), closed by a watermark, and
written with a checkpoint, so it stops and resumes without loss. Seeking back is a fresh checkpoint, or the
batch fold up to a time.
"""

from __future__ import annotations

import pickle
import threading
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barlume.operators import fold
from barlume.operators.book import Profile, Rules
from barlume.schema import NS, TIMEFRAMES

#: Updates a second by replay speed (bars a second up to which each holds); fixed values of the display.
RATES = ((200, 30), (2_000, 20), (20_000, 12), (float("inf"), 8))


def publish_rate(speed: float) -> int:
    return next(rate for most, rate in RATES if speed <= most)


def pace(speed: float, bars_per_file: int) -> dict:
    """Reader and trigger options that replay about ``speed`` bars a second."""
    rate = publish_rate(speed)
    return {"maxFilesPerTrigger": max(1, round(speed / rate / max(1, bars_per_file))), "trigger": {"processingTime": f"{1000 // rate} milliseconds"}}


def read_ticks(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def closed_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of streamed ticks (symbol, tick_id, time_ns, price_ticks, volume), each put out once, when the watermark has
    passed its close: a bar that may still change is never seen."""
    at = F.struct("time_ns", "tick_id")
    timed = ticks.withColumn("ts", F.timestamp_micros(F.expr("time_ns div 1000"))).withWatermark("ts", delay)
    made = timed.groupBy(F.window("ts", f"{TIMEFRAMES[timeframe]} seconds").alias("w"), "symbol").agg(
        F.min_by("price_ticks", at).alias("open_ticks"), F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks"), F.max_by("price_ticks", at).alias("close_ticks"), F.count("*").alias("tick_volume")
    )
    ns = lambda c: (F.unix_micros(c) * 1000).cast("bigint")
    return made.select("symbol", ns(F.col("w.start")).alias("open_time_ns"), ns(F.col("w.end")).alias("close_time_ns"), "open_ticks", "high_ticks", "low_ticks", "close_ticks", "tick_volume")


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; the sink is exactly-once over its checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", path + ".checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def split_late(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``rows`` with ``late``: it came after a row of its key with a later or equal time. Keeps one number per key."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        for df in frames:
            top = df[time].cummax().shift()
            if newest is not None:
                top = top.fillna(newest).clip(lower=newest)
            yield df.assign(late=df[time] <= top)
            newest = max(df[time].max(), newest) if newest is not None else df[time].max()
        state.update((int(newest),))

    from pyspark.sql.streaming.state import GroupStateTimeout
    from pyspark.sql.types import BooleanType, StructType

    schema = StructType([*rows.schema.fields]).add("late", BooleanType())
    return rows.groupBy(*keys).applyInPandasWithState(check, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def live_runs(rows: DataFrame, rules: Rules, profiles: dict[str, Profile], strategy: str | None = None, parameters=None, account_every: int = 1) -> DataFrame:
    """``fold.simulate`` over a stream of the same rows: a run's whole state is one value between batches.

    Rows of a batch are sorted; a batch must not hold times before the last one's (close bars by ``closed_bars``)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            run = pickle.loads(state.get[0])
        else:
            made = fold.load(strategy)(**(parameters(key[0]) if parameters else {})) if strategy else None
            run = fold.Run(key[0], rules, profiles, made, account_every)
        every = pd.concat(list(frames)).sort_values(["at_ns", "rank", "tie"], kind="stable")
        for r in every.itertuples(index=False):
            run.row(r.at_ns, r.kind, r.body)
        out, run.out = run.out, []
        state.update((pickle.dumps(run),))
        yield pd.DataFrame(out, columns=["run_id", "seq", "kind", "time_ns", "ref", "payload"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy("run_id").applyInPandasWithState(step, fold.OUT, "run binary", "append", GroupStateTimeout.NoTimeout)


def latest_frame(df: DataFrame, keys: list[str], path: str, order: str) -> StreamingQuery:
    """Keeps the newest row per key of what each batch brings (a frame), as one Parquet folder per batch."""
    from barlume.operators.joins import latest_by

    def put(batch: DataFrame, number: int) -> None:
        latest_by(batch, keys, [order]).write.mode("overwrite").parquet(f"{path}/frame={number}")

    q = df.writeStream.foreachBatch(put).option("checkpointLocation", path + ".checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def seek(rows: DataFrame, until_ns: int, **options) -> DataFrame:
    """The state at a time, by folding again up to it."""
    return fold.simulate(rows.where(F.col("at_ns") <= until_ns), liquidate=False, **options)


def delay_ns(minutes: int) -> int:
    return minutes * 60 * NS


class Subscriber:
    """A bounded queue for one viewer that is slower than the run: when it is full, all that waits is dropped for
    the newest message, since each frame replaces those before it. ``dropped`` counts them."""

    def __init__(self, most: int):
        self.waiting: deque = deque()
        self.most, self.dropped, self.lock = max(1, most), 0, threading.Lock()

    def put(self, message: object) -> None:
        with self.lock:
            if len(self.waiting) >= self.most:
                self.dropped += len(self.waiting)
                self.waiting.clear()
            self.waiting.append(message)

    def take(self) -> list:
        """All that waits, oldest first."""
        with self.lock:
            out = list(self.waiting)
            self.waiting.clear()
        return out
