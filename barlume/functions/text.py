"""Text and record helpers: exit kinds, payload reads, canonical JSON and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def exit_kind(reason: Column) -> Column:
    """A free exit reason as one of a few kinds, by what it contains."""
    r = F.replace(F.replace(F.lower(F.trim(reason)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    has = lambda *w: F.rlike(r, F.lit("|".join(w)))
    return F.when(has("stop_out", "liquidat"), "liquidation").when(has("stop_loss", "^sl$"), "stop_loss").when(has("take_profit", "^tp$", "target"), "take_profit").when(has("end_of", "final"), "end_of_data").otherwise("other")


def payload(column: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value."""
    return F.coalesce(*(F.get_json_object(column, p) for p in paths))


def canonical_json(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The row as compact JSON, keys sorted, nulls dropped."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns or df.columns))))


def run_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], record: Column, block: int = 10_000, segment: Column | None = None) -> DataFrame:
    """(keys, records, digest): SHA-256 over a key's records in order, as a tree: blocks of ``block`` records are
    digested alone and their digests together, so no key is gathered in one task. ``segment`` cuts keys of any
    length into stretches to number the records (it must not fall with ``order``)."""
    from barlume.operators.joins import running

    some = df.withColumn("__r", record).select(*keys, *order, "__r", (segment if segment is not None else F.lit(0)).alias("__stretch"))
    numbered = running(some, keys, list(order), F.col("__stretch"), {"__n": ("count", F.lit(1))}).withColumn("__b", F.floor((F.col("__n") - 1) / block))
    joined = lambda found, name: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(found)), lambda x: x[name]), "\n"), 256)
    parts = numbered.groupBy(*keys, "__b").agg(joined(F.struct("__n", "__r"), "__r").alias("__d"), F.count("*").alias("__c"))
    return parts.groupBy(*keys).agg(F.sum("__c").alias("records"), joined(F.struct("__b", "__d"), "__d").alias("digest"))


def short_id(prefix: str, run: Column, number: Column) -> Column:
    """prefix_hash_counter, the same for the same run and counter."""
    return F.concat_ws("_", F.lit(prefix), F.substring(F.sha2(run.cast("string"), 256), 1, 12), F.lpad(number.cast("string"), 8, "0"))


def chain_id(orders: DataFrame, chains: DataFrame) -> DataFrame:
    """``orders`` (order_id, tag, client_id) with ``chain``: the tag; else the only chain whose name the client id
    contains; else the only chain there is; else null."""
    known = chains.select("chain").distinct()
    some = known.limit(2).collect()
    only = F.lit(some[0].chain if len(some) == 1 else None).cast("string")
    words = orders.where("tag is null").select("order_id", F.explode(F.split("client_id", "[^A-Za-z0-9]+")).alias("chain")).distinct()
    hits = words.join(known, "chain").groupBy("order_id").agg(F.when(F.count("*") == 1, F.first("chain")).alias("__hit"))
    return orders.join(hits, "order_id", "left").withColumn("chain", F.coalesce("tag", "__hit", only)).drop("__hit")
