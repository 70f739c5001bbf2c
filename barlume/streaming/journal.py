"""An append journal of a stream: committed by batch number, so a restart neither loses nor repeats rows.

    root/data/<id>              rows of one attempt at one batch
    root/commits/<batch>.json   which attempt counts

A batch that was written but not committed is written again under another id; one that was committed is not written a
second time, however often the stream replays it. Readers see committed batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from barlume.sources import snapshots


def append(rows: DataFrame, root: str, batch: int, before_commit: Callable[[int], None] | None = None) -> bool:
    """Commits ``rows`` as batch number ``batch``; False if that batch is there already."""
    spark, name = rows.sparkSession, f"{root}/commits/{snapshots.COMMIT.format(batch)}"
    if snapshots.exists(spark, name):
        return False
    data = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{data}")
    if before_commit:
        before_commit(batch)
    made = f"{root}/commits/_{uuid.uuid4().hex}"
    snapshots._write_text(spark, made, json.dumps({"batch": batch, "data": data, "schema": rows.schema.json()}))
    done = snapshots._claim(spark, made, name)
    if not done:
        snapshots.delete(spark, f"{root}/{data}")
    return done


def read(spark: SparkSession, root: str) -> DataFrame:
    """All committed rows."""
    told = spark.read.schema("batch long, data string, schema string").option("pathGlobFilter", "0*.json").json(f"{root}/commits")
    found = told.where("data is not null").orderBy("batch").collect()  # a row per batch
    if not found:
        raise LookupError(f"nothing is committed in {root}")
    return spark.read.schema(StructType.fromJson(json.loads(found[-1].schema))).parquet(*(f"{root}/{r.data}" for r in found))


def batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed batches."""
    return snapshots.numbers(spark, root)


def write(stream: DataFrame, root: str, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Journals what the stream has now and stops; called again, it goes on where it ended."""
    query = stream.writeStream.foreachBatch(lambda rows, n: append(rows, root, n, before_commit) and None)
    running = query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return running
