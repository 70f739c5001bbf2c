"""Exact order statistics of groups of any size, by counting in ranges that shrink.

``percentile`` and ``percentile_disc`` gather a group's values in one task. Here each wanted rank of a group is
bracketed by two of its values, taken from a mergeable sketch of what is still open; one pass counts what lies below,
at, between and above the two, which proves where the rank is: at one of them, and it is found, or strictly inside one
of the three ranges, which is the next bracket. A bracket of few rows is sorted. Ranks, not values, decide how fast
brackets shrink (some thousand times a pass), so a group of 10^12 rows takes three or four passes, whatever its
distribution; and as the two values themselves always leave, ties cannot stall it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barlume.sources.shared import written

#: Rows of a bracket that are sorted in one task.
MOST = 10_000
ACCURACY = 10_000


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], method: str = "linear", most: int = MOST, accuracy: int = ACCURACY) -> DataFrame:
    """(by, share, value) for every group and share in 0..1, nulls left out. ``linear`` interpolates at (n - 1) * share, as
    a double; ``rank`` is the least value with at least that share of the rows at or below it, in its own type."""
    if method not in ("linear", "rank"):
        raise ValueError(f"unknown method {method}")
    rows = df.select(*by, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    share, n = F.col("share"), F.col("n")
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in dict.fromkeys(shares)))).alias("share")
    groups = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*by, wanted, "n")
    if method == "linear":
        first = F.floor((n - 1) * share).cast("bigint")
        ranks = F.array(first, F.least(first + 1, n - 1))
    else:
        ranks = F.array(F.greatest(F.lit(0).cast("bigint"), F.ceil(share * n).cast("bigint") - 1))
    none = F.lit(None).cast(rows.schema["__v"].dataType)
    state = groups.select(*by, "share", "n", F.posexplode(ranks).alias("which", "rank"))
    state = written(state.withColumns({"below": F.lit(0).cast("bigint"), "size": n, "lo": none, "hi": none, "value": none}), "quantile-state")
    wide = F.col("value").isNull() & (F.col("size") > most)
    while not state.where(wide).isEmpty():
        state = written(state.where(~wide).unionByName(_narrowed(rows, state.where(wide), by, accuracy)), "quantile-state")
    small = _inside(rows, state.where("value is null"), by).groupBy(*state.columns).agg(F.sort_array(F.collect_list("__v")).alias("__all"))
    found = small.withColumn("value", F.get("__all", (F.col("rank") - F.col("below")).cast("int"))).drop("__all").unionByName(state.where("value is not null"))
    at = lambda i: F.max(F.when(F.col("which") == i, F.col("value")))
    if method == "rank":
        return found.groupBy(*by, "share").agg(at(0).alias("value"))
    out = found.groupBy(*by, "share", "n").agg(at(0).cast("double").alias("__a"), at(1).cast("double").alias("__b"))
    part = (n - 1) * share - F.floor((n - 1) * share)
    return out.select(*by, "share", (F.col("__a") + (F.col("__b") - F.col("__a")) * part).alias("value"))


def _inside(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each bracket of ``state`` with the rows of its group strictly inside it."""
    names = [f"__by{i}" for i in range(len(by))]
    values = rows.withColumnsRenamed(dict(zip(by, names, strict=True)))
    meet = F.lit(True)
    for b, n in zip(by, names, strict=True):
        meet = meet & state[b].eqNullSafe(values[n])
    inside = (F.col("lo").isNull() | (F.col("__v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("__v") < F.col("hi")))
    return state.join(values, meet).where(inside).select(*state.columns, "__v")


def _narrowed(rows: DataFrame, wide: DataFrame, by: Sequence[str], accuracy: int) -> DataFrame:
    """``wide``, each rank found or in a smaller bracket."""
    steps = max(8, accuracy // 4)
    rel = F.col("rank") - F.col("below")
    # the sketch gives a grid of values; of those the two around the rank
    grid = _inside(rows, wide, by).groupBy(*wide.columns).agg(F.percentile_approx("__v", F.array(*(F.lit(i / steps) for i in range(steps + 1))), accuracy).alias("__grid"))
    low = F.greatest(F.lit(0), F.floor(rel / F.col("size") * steps) - 1).cast("int")
    high = F.least(F.lit(steps), F.ceil((rel + 1) / F.col("size") * steps) + 1).cast("int")
    tried = grid.withColumns({"__x": F.get("__grid", low), "__y": F.get("__grid", high)}).drop("__grid")
    tried = written(tried, "quantile-tried")
    v, x, y = F.col("__v"), F.col("__x"), F.col("__y")
    counted = _inside(rows, tried, by).groupBy(*tried.columns).agg(
        F.count_if(v < x).alias("__a"), F.count_if(v == x).alias("__b"), F.count_if((v > x) & (v < y)).alias("__c"), F.count_if((v == y) & (y > x)).alias("__d")
    )
    a, b, c, d = (F.col(f"__{k}") for k in "abcd")
    place = F.when(rel < a, 0).when(rel < a + b, 1).when(rel < a + b + c, 2).when(rel < a + b + c + d, 3).otherwise(4)
    p = F.col("__p")
    below = F.col("below") + F.when(p == 2, a + b).when(p == 4, a + b + c + d).otherwise(0)
    size = F.when(p == 0, a).when(p == 2, c).when(p == 4, F.col("size") - (a + b + c + d)).otherwise(F.lit(1).cast("bigint"))
    return counted.withColumn("__p", place).select(
        *by, "share", "n", "which", "rank", below.alias("below"), size.alias("size"),
        F.when(p == 2, x).when(p == 4, y).otherwise(F.col("lo")).alias("lo"), F.when(p == 0, x).when(p == 2, y).otherwise(F.col("hi")).alias("hi"),
        F.when(p == 1, x).when(p == 3, y).alias("value"),
    )
