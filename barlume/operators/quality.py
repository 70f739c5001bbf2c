"""Import quality: reject codes, duplicates and gaps in file order, completeness, audits, conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlume.functions import parsing as P
from barlume.operators.joins import running
from barlume.schema import NS, TIMEFRAMES

#: Rows of a file that are one task where order matters.
STRETCH = 1 << 16


def _settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed: a filter above cannot be pushed into their expressions, which it would
    otherwise repeat many times over."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__x")).select("__x.*")


def parse_rows(raw: DataFrame, timeframe: str, zone: str, digits: int, tick_points: int = 1) -> DataFrame:
    """Raw text rows (source_row, date, time, open, high, low, close, tickvol, vol, spread and key columns) to typed
    ones with ``reject_code`` (null: accepted). Prices become ticks of ``tick_points`` points."""
    prices = {f"{c}_points": P.scaled_integer(F.col(c), digits) for c in ("open", "high", "low", "close")}
    volumes = {"tick_volume": P.whole_number(F.col("tickvol")), "real_volume": P.whole_number(F.col("vol")), "source_spread_points": P.whole_number(F.col("spread"))}
    keys = [c for c in raw.columns if c not in ("date", "time", "open", "high", "low", "close", "tickvol", "vol", "spread")]
    rows = raw.select(*keys, P.local_datetime(F.col("date"), F.col("time")).alias("local_time"), *(c.alias(k) for k, c in (prices | volumes).items()))
    rows = _settled(_settled(rows).withColumn("open_time_ns", P.localize_ns(F.col("local_time"), zone)))
    rows = rows.withColumn("close_time_ns", P.close_ns(F.col("local_time"), F.col("open_time_ns"), timeframe, zone))
    parsed = F.lit(True)
    for c in (*prices, *volumes, "open_time_ns", "close_time_ns"):
        parsed = parsed & F.col(c).isNotNull()
    code = P.reject_code([F.col(c) for c in prices], tick_points, [F.col(c) for c in volumes], P.aligned(F.col("local_time"), timeframe), parsed)
    rows = _settled(rows).withColumn("reject_code", code)
    return rows.withColumns({f"{c}_ticks": F.expr(f"{c}_points div {tick_points}") for c in ("open", "high", "low", "close")}).drop(*prices)


def _stretch() -> Column:
    return F.expr(f"source_row div {STRETCH}")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_code is null")


def code_counts(rows: DataFrame, keys: Sequence[str], samples: int = 5) -> DataFrame:
    """Rejected rows by code, with the first ``samples`` row numbers, in one pass: each stretch of a file brings its
    count and first rows, and the first ``samples`` stretches that have a code hold its first rows. No list
    grows with the file."""
    group = [*keys, "reject_code"]
    first = F.slice(F.array_sort(F.collect_list("source_row")), 1, samples)  # a stretch has at most STRETCH rows
    parts = rows.where("reject_code is not null").groupBy(*group, _stretch().alias("__part")).agg(F.count("*").alias("__rows"), first.alias("__first"))
    w = Window.partitionBy(*group)
    ranked = parts.withColumns({"__n": F.row_number().over(w.orderBy("__part")), "rows": F.sum("__rows").over(w)}).where(F.col("__n") <= samples)
    found = ranked.groupBy(*group).agg(F.max("rows").alias("rows"), F.flatten(F.collect_list("__first")).alias("__all"))
    return found.select(*group, "rows", F.slice(F.array_sort("__all"), 1, samples).alias("sample_rows"))


def time_checks(rows: DataFrame, keys: Sequence[str], timeframe: str, time: str = "open_time_ns") -> DataFrame:
    """Duplicates, steps back and gaps between accepted rows that follow each other in the file."""
    seconds = TIMEFRAMES[timeframe]
    near = running(rows.select(*keys, time, "source_row"), keys, ["source_row"], _stretch(), {"__was": ("lag", F.col(time))})
    d = near.select(*keys, time, (F.col(time) - F.col("__was")).alias("__d"))
    agg = [F.count("*").alias("rows"), F.count_if(F.col("__d") == 0).alias("duplicates"), F.count_if(F.col("__d") < 0).alias("out_of_order"), F.min(time).alias("first_ns"), F.max(time).alias("last_ns")]
    if seconds:
        s = F.expr(f"__d div {NS}")
        gap = s > seconds
        agg += [F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.expr(f"__d div {NS} div {seconds} - 1"))), F.lit(0)).alias("estimated_missing"), F.coalesce(F.max(F.when(gap, s)), F.lit(0)).alias("longest_gap_seconds")]
    return d.groupBy(*keys).agg(*agg)


def complete(rows: DataFrame, watermark_ns: int | Column, policy: str = "mark") -> DataFrame:
    """``is_complete``: closed by the watermark. Policies: mark keeps all, drop removes open bars, reject keeps all
    and leaves the decision to ``violations``."""
    out = rows.withColumn("is_complete", F.col("close_time_ns") <= (F.lit(watermark_ns) if isinstance(watermark_ns, int) else watermark_ns))
    return out.where("is_complete") if policy == "drop" else out


def number(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``sequence`` 0..n-1 over the rows that are put out, in file order."""
    counted = running(rows, keys, ["source_row"], _stretch(), {"sequence": ("count", F.lit(1))})
    return counted.withColumn("sequence", F.col("sequence") - 1)


def watermark(series: DataFrame) -> DataFrame:
    """One row: per symbol the last open at its finest fixed timeframe, then the least over symbols.

    ``series``: (symbol, timeframe, seconds, last_open_ns)."""
    finest = series.where("seconds is not null").groupBy("symbol").agg(F.max_by("last_open_ns", F.struct(-F.col("seconds"), F.col("last_open_ns"))).alias("at"))
    return finest.agg(F.min("at").alias("watermark_ns"))


def audit_base(series: DataFrame) -> DataFrame:
    """Per symbol the timeframe with the fewest seconds."""
    return series.where("seconds is not null").groupBy("symbol").agg(F.min_by("timeframe", F.struct("seconds", "timeframe")).alias("base_timeframe"))


def _whole(spans: DataFrame, others: DataFrame) -> DataFrame:
    """``spans`` (symbol, at_open, at_close) with ``whole``: none of ``others`` opens or closes strictly inside."""
    from barlume.operators.bars import SEGMENT_NS
    from barlume.operators.joins import asof_join

    edges = others.select("symbol", F.explode(F.array("open_time_ns", "close_time_ns")).alias("edge")).distinct()
    got = asof_join(spans, edges, ["symbol"], "at_open", "edge", ["edge"], inclusive=False, forward=True, segment_ns=SEGMENT_NS)
    return got.withColumn("whole", F.col("edge").isNull() | (F.col("edge") >= F.col("at_close"))).drop("edge")


def cross_audit(base: DataFrame, targets: DataFrame, tolerance: int = 0, volume: bool = True) -> DataFrame:
    """Every target bar against the base bars that open in [open, close), within the base's coverage.

    A base bar belongs to the target bar that opened last at or before it, if that has not closed: an as-of join on
    the targets' own times, so intervals may follow any zone's clock and calendar.

    The base is shuffled once, whatever the number of timeframes: its bars are first merged within the bars of the
    finest timeframe, and those partial bars then meet all timeframes. A bar of the finest timeframe that another one's
    open or close cuts is not merged; nor are base bars outside all of them. They meet the timeframes one by one."""
    from barlume.operators.bars import OHLC, SEGMENT_NS
    from barlume.operators.joins import asof_join
    from barlume.sources.shared import written

    targets = written(targets, "audit-targets")  # read five times, and small beside the base
    kinds = sorted((r.timeframe for r in targets.select("timeframe").distinct().limit(len(TIMEFRAMES) + 1).collect()), key=str)  # a row per timeframe
    unknown = [k for k in kinds if k not in TIMEFRAMES]
    if unknown:
        raise ValueError(f"unknown timeframes: {unknown}")
    cover = base.groupBy("symbol").agg(F.min("open_time_ns").alias("lo"), F.max("close_time_ns").alias("hi"))
    values = [*OHLC, "tick_volume"]
    merge = [
        F.min_by("open_ticks", F.col("at")).alias("open_ticks"),
        F.max("high_ticks").alias("high_ticks"),
        F.min("low_ticks").alias("low_ticks"),
        F.max_by("close_ticks", F.col("at")).alias("close_ticks"),
        F.sum("tick_volume").alias("tick_volume"),
    ]
    parts = base.select("symbol", F.col("open_time_ns").alias("at"), *values)
    spans = targets.select("symbol", "timeframe", F.col("open_time_ns").alias("at_open"), F.col("close_time_ns").alias("at_close"))
    if len(kinds) > 1:
        finest = min(kinds, key=lambda k: TIMEFRAMES[k] or float("inf"))
        fine = _whole(spans.where(F.col("timeframe") == finest).drop("timeframe"), targets.where(F.col("timeframe") != finest))
        held = asof_join(parts, fine, ["symbol"], "at", "at_open", ["at_open", "at_close", "whole"], segment_ns=SEGMENT_NS)
        merged = F.coalesce(F.col("whole") & (F.col("at") < F.col("at_close")), F.lit(False))
        group = held.withColumns({"merged": merged, "of": F.when(merged, F.col("at_open")).otherwise(F.col("at"))})
        parts = group.groupBy("symbol", "merged", "of").agg(*merge, F.min("at").alias("first")).withColumnRenamed("first", "at").select("symbol", "at", *values)
    dealt = parts.withColumn("timeframe", F.explode(F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<string>")))
    held = asof_join(dealt, spans, ["symbol", "timeframe"], "at", "at_open", ["at_open", "at_close"], segment_ns=SEGMENT_NS)
    made = held.where("at < at_close").groupBy("symbol", "timeframe", F.col("at_open").alias("open_time_ns")).agg(*merge)
    made = made.select("symbol", "timeframe", "open_time_ns", *(F.col(c).alias(f"b_{c}") for c in values))
    inside = targets.join(cover, "symbol").where((F.col("open_time_ns") >= F.col("lo")) & (F.col("close_time_ns") <= F.col("hi"))).drop("lo", "hi")
    pairs = inside.join(made, ["symbol", "timeframe", "open_time_ns"], "left")
    fields = [*OHLC, *(["tick_volume"] if volume else [])]
    wrong = F.array_compact(F.array(*(F.when(F.abs(F.col(f) - F.col(f"b_{f}")) > (tolerance if f in OHLC else 0), F.lit(f)) for f in fields)))
    return pairs.withColumns({"found": F.col("b_open_ticks").isNotNull(), "different": F.when(F.col("b_open_ticks").isNotNull(), wrong)})


def audit_summary(audited: DataFrame) -> DataFrame:
    ok = F.size("different") == 0
    return audited.groupBy("symbol", "timeframe").agg(
        F.count_if("found").alias("compared"), F.count_if(F.col("found") & ok).alias("matching"), F.count_if(F.col("found") & ~ok).alias("mismatching"), F.count_if(~F.col("found")).alias("source_only"), F.lit(0).cast("bigint").alias("aggregate_only")
    )


def conformance(manifest: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, expected, actual): declared figures (null: not declared) that the file's own contradict."""
    checks = {"SOURCE_HASH_MISMATCH": "sha256", "SOURCE_SIZE_MISMATCH": "size_bytes", "SOURCE_ROW_COUNT_MISMATCH": "row_count", "DECLARED_START_MISMATCH": "start_ns", "DECLARED_END_MISMATCH": "end_ns"}
    both = manifest.alias("m").join(actual.alias("a"), list(keys))
    found = [F.when(F.col(f"m.{c}") != F.col(f"a.{c}"), F.struct(F.lit(code).alias("code"), F.col(f"m.{c}").cast("string").alias("expected"), F.col(f"a.{c}").cast("string").alias("actual"))) for code, c in checks.items()]
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("x")).select(*keys, "x.*")


def severity(issues: DataFrame, keys: Sequence[str], fail_on_warnings: bool = False) -> DataFrame:
    """(errors, warnings, success) per key of ``issues`` (severity)."""
    out = issues.groupBy(*keys).agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    ok = F.col("errors") == 0
    return out.withColumn("success", ok & (F.col("warnings") == 0) if fail_on_warnings else ok)


def missing(needed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are needed and absent."""
    return needed.select(*keys).distinct().join(present, list(keys), "left_anti")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def violations(df: DataFrame, rules: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, rule) for every row and rule (a SQL condition) that does not hold; a null condition does not."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def tolerance_check(expected: Column, actual: Column, absolute: Column, bps: Column) -> Column:
    """Passed where equal, within the absolute tolerance, or within basis points of the expected (of zero: none)."""
    gap = F.abs(expected - actual)
    relative = F.when(expected == 0, F.when(gap == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(gap, F.abs(expected)) * 10_000)
    return (gap <= absolute) | (relative <= bps)
