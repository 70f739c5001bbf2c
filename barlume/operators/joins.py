"""Composition helpers that Spark's public API lacks: as-of and interval joins, running values, latest rows.

None needs a theta join, which would plan as a nested loop over both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], order: Sequence[str] = (), inclusive: bool = True, forward: bool = False, segment_ns: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` (same ``by``) at or before the left row's time
    (``inclusive``; else before it), or with ``forward`` the first at or after it.

    Union of both sides and one ordered window per key: one shuffle, no join. A left row keeps its place
    only by its own columns, so all of them travel. ``order`` breaks ties on the right. A hot key can be
    cut into time segments of ``segment_ns``: each segment then also starts from the last right row before
    it, which a second, small window over one row per segment finds.
    """
    first = (1 if inclusive else -1) * (-1 if forward else 1)
    lcols = [c for c in left.columns if c not in by]
    side_l = left.select(*by, F.col(left_time).alias("__t"), F.lit(first).alias("__s"), F.struct(*lcols).alias("__l"), F.lit(None).cast(_struct(right, columns)).alias("__r"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)))
    side_r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(side_l.schema["__l"].dataType).alias("__l"), F.struct(*columns).alias("__r"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)))
    both = side_l.unionByName(side_r)
    keys = [*by]
    if segment_ns:
        both = both.withColumn("__seg", F.floor(F.col("__t") / segment_ns))
        keys.append("__seg")
    sort = [F.col(c).desc() if forward else F.col(c).asc() for c in ("__t", "__s", *(f"__o{i}" for i in range(len(order))))]
    span = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("__m", F.last("__r", ignorenulls=True).over(span))
    if segment_ns:
        ends = side_r.withColumn("__seg", F.floor(F.col("__t") / segment_ns)).groupBy(*by, "__seg").agg((F.min_by if forward else F.max_by)("__r", F.struct("__t", *(f"__o{i}" for i in range(len(order))))).alias("__e"))
        segs = both.select(*by, "__seg").distinct().join(ends, [*by, "__seg"], "left")
        over = Window.partitionBy(*by).orderBy(F.col("__seg").desc() if forward else F.col("__seg")).rowsBetween(Window.unboundedPreceding, -1)
        before = segs.withColumn("__b", F.last("__e", ignorenulls=True).over(over)).select(*by, "__seg", "__b")
        got = got.join(before, [*by, "__seg"], "left").withColumn("__m", F.coalesce("__m", "__b"))
    return got.where(F.col("__l").isNotNull()).select(*by, *(F.col(f"__l.{c}").alias(c) for c in lcols), *(F.col(f"__m.{c}").alias(c) for c in columns))


def _struct(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(*columns).alias("x")).schema["x"].dataType


def interval_join(points: DataFrame, spans: DataFrame, by: Sequence[str], low: str, high: str, start: str, end: str, width: int, most: int = 64) -> DataFrame:
    """Pairs whose ranges (low, high] of ``points`` and [start, end) of ``spans`` meet: start <= high and end > low.

    Both sides are cut into buckets of ``width`` and meet on (by, bucket) by equality; a pair is kept in
    the first bucket both touch. Spans over more than ``most`` buckets take buckets ``most`` times as wide,
    and those over more again, so a span makes at most ``most`` rows short of the widest level.
    """
    levels, out = [width * most**i for i in range(3)], None
    for i, level in enumerate(levels):
        fits = lambda w: F.floor(F.col(end) / w) - F.floor(F.col(start) / w) < most
        mine = spans if i == 0 else spans.where(~fits(levels[i - 1]))
        mine = mine.where(fits(level)) if i < len(levels) - 1 else mine
        p0, s0 = F.floor(F.col(low) / level), F.floor(F.col(start) / level)
        p = points.withColumn("__b", F.explode(F.sequence(p0, F.floor(F.col(high) / level))))
        s = mine.withColumn("__b", F.explode(F.sequence(s0, F.floor(F.col(end) / level))))
        meet = (F.col(start) <= F.col(high)) & (F.col(end) > F.col(low)) & (F.col("__b") == F.greatest(p0, s0))
        part = p.join(s, [*by, "__b"]).where(meet).drop("__b")
        out = part if out is None else out.unionByName(part)
    return out


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; aggregates before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return got.select(*keys, *(F.col(f"__x.{c}").alias(c) for c in rest)).select(*df.columns)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key by ``order``. Spark limits a rank filter per task before the
    shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


#: kind -> (a segment's part, what is carried into a segment from the parts before it, the value of a row)
def _kinds(place: Column, before: WindowSpec, after: WindowSpec, every: WindowSpec, at: WindowSpec, upto: WindowSpec) -> dict[str, tuple]:
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "count": (lambda c: F.count("*"), lambda p: F.sum(p).over(before), lambda c: F.sum(c).over(upto)),
        "sum": (F.sum, lambda p: F.sum(p).over(before), lambda c: F.sum(c).over(upto)),
        "max": (F.max, lambda p: F.max(p).over(before), lambda c: F.max(c).over(upto)),
        "max_before": (F.max, lambda p: F.max(p).over(before), lambda c: F.max(c).over(earlier)),
        "last": (lambda c: F.max_by(c, F.when(c.isNotNull(), place)), lambda p: F.last(p, ignorenulls=True).over(before), lambda c: F.last(c, ignorenulls=True).over(upto)),
        "lag": (lambda c: F.max_by(c, place), lambda p: F.last(p).over(before), lambda c: F.lag(c).over(at)),
        "lead": (lambda c: F.min_by(c, place), lambda p: F.first(p).over(after), lambda c: F.lead(c).over(at)),
        "total": (lambda c: F.count("*"), lambda p: F.sum(p).over(every), lambda c: F.first(c).over(upto)),
        "greatest": (F.max, lambda p: F.max(p).over(every), lambda c: F.first(c).over(upto)),
    }


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column, values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running values of each key in ``order``, for keys of any size: no task has more than a ``segment``.

    ``values``: name -> (kind, column). Kinds: ``count`` (rows so far, from 1), ``sum``, ``max``, ``max_before`` (of the rows
    before), ``last`` (that is not null), ``lag`` and ``lead`` (the row before and after), and of the whole key ``total`` (rows)
    and ``greatest``. ``segment`` must not fall with ``order``.

    A table of one row a segment is scanned first and tells what each segment starts from. That row then goes
    into the segment's window, before its rows (for ``lead`` one after them), so the rows are shuffled once and no
    join follows. A ``max`` of structs carries whatever belongs to the greatest row.
    """
    keys, columns = [*by, "__seg"], list(values.values())
    cut = df.withColumns({"__seg": segment} | {f"__v{i}": F.lit(1).cast("long") if k in ("count", "total") else c for i, (k, c) in enumerate(columns)})
    of = Window.partitionBy(*by).orderBy("__seg")
    before, after = of.rowsBetween(Window.unboundedPreceding, -1), of.rowsBetween(1, Window.unboundedFollowing)
    at = Window.partitionBy(*keys).orderBy("__side", *order)
    kinds = _kinds(F.struct(*order), before, after, Window.partitionBy(*by), at, at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = cut.groupBy(*keys).agg(*(kinds[k][0](F.col(f"__v{i}")).alias(f"__v{i}") for i, (k, _) in enumerate(columns)))
    carried = parts.select(*keys, *(kinds[k][1](F.col(f"__v{i}")).alias(f"__v{i}") for i, (k, _) in enumerate(columns)))
    late = [k == "lead" for k, _ in columns]
    sides = F.explode(F.array(F.lit(0), F.lit(2))) if any(late) else F.lit(0)
    # before the rows, and for ``lead`` behind them
    edges = carried.withColumn("__side", sides)
    edges = edges.withColumns({f"__v{i}": F.when(F.col("__side") == (2 if after_ else 0), F.col(f"__v{i}")) for i, after_ in enumerate(late)})
    rows = cut.withColumn("__side", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    done = {name: kinds[k][2](F.col(f"__v{i}")).alias(name) for i, (name, (k, _)) in enumerate(values.items())}
    kept = [c for c in df.columns if c not in done]
    return rows.select(*kept, "__side", *done.values()).where("__side = 1").select(*kept, *done)


#: Rows of a block of ``sliding``.
BLOCK = 1 << 16


def sliding(
    df: DataFrame, by: Sequence[str], order: Sequence[str], segment: Column, n: int, values: Mapping[str, Callable[[WindowSpec], Column]], index: str = "__i", block: int = BLOCK
) -> DataFrame:
    """``df`` with windows over the last ``n`` rows of each key, for keys of any size, and the row's number from 1 as ``index``.

    Rows are numbered (``running``) and dealt into blocks of ``block`` rows; each block also gets the ``n`` - 1 rows before
    it, wherever in time they are. ``values``: name -> column over the ordered window, which may look back at most
    ``n`` - 1 rows and not ahead."""
    block = max(block, n)
    place = F.col(index) - 1
    mine = F.expr(f"(`{index}` - 1) div {block}")
    halo = F.when(place % block >= block - (n - 1), F.array(mine, mine + 1)).otherwise(F.array(mine))
    dealt = running(df, by, order, segment, {index: ("count", F.lit(1))}).withColumn("__block", F.explode(halo))
    w = Window.partitionBy(*by, "__block").orderBy(index)
    out = dealt.withColumns({name: f(w) for name, f in values.items()})
    return out.where(F.col("__block") == mine).drop("__block")

