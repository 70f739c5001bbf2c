"""Match positions as native expressions, in time linear in the text and its matches.

Spark's regular-expression functions return strings, not places. ``split`` by a pattern gives
the text between its matches and ``regexp_extract_all`` the matches themselves, both leftmost
and non-overlapping; running sums of the lengths in code points of the two are the places.

A running sum over an array has no built-in, and a fold that appends copies its array at each
step. Here sums of ``RADIX`` neighbours are taken level by level, so that every prefix is at most
``RADIX`` terms of each level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
RADIX = 32
LEVELS = 4
CHUNK = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, most: bool = False) -> Column:
    """For each place of an array of ints the sum (or with ``most`` the greatest, 0 at least) of all before it."""
    add = (lambda a, x: F.greatest(a, x)) if most else (lambda a, x: a + x)

    def fold(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), add)

    def up(below: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / RADIX).cast("int"))
        return F.when(F.size(below) > RADIX, F.transform(blocks, lambda j: fold(F.slice(below, j * RADIX + 1, F.lit(RADIX))))).otherwise(F.array().cast("array<int>"))

    def prefixes(levels: list[Column]) -> Column:
        def one(_: Column, i: Column) -> Column:
            total = fold(F.slice(levels[0], i - i % RADIX + 1, i % RADIX))
            for k in range(1, len(levels)):
                j = F.floor(i / RADIX**k).cast("int")
                first = j - j % RADIX if k < len(levels) - 1 else F.lit(0)
                total = F.when(i >= RADIX**k, add(total, fold(F.slice(levels[k], first + 1, j - first)))).otherwise(total)
            return total

        return F.transform(levels[0], one)

    def climb(levels: list[Column]) -> Column:
        if len(levels) > LEVELS:
            return prefixes(levels)
        return bound(up(levels[-1]), lambda x: climb([*levels, x]))

    return bound(values, lambda v: F.when(F.size(v) <= RADIX, F.transform(v, lambda _, i: fold(F.slice(v, 1, i)))).otherwise(climb([v])))


def below(ascending: Column, value: Column) -> Column:
    """How many entries of an ascending array are less than ``value``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ascending) + 1)).cast("int"))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        less = F.get(ascending, middle) < value
        go = at["lo"] < at["hi"]
        return F.struct(F.when(go & less, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(go & ~less, middle).otherwise(at["hi"]).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ascending).alias("hi")), step, lambda at: at["lo"])
    return F.when(F.size(ascending) == 0, 0).otherwise(found)


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points (the last may be shorter), for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (code points from 0, end exclusive), without a walk from the text's begin."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    whole = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    one = F.substring(whole(a), start % CHUNK + 1, end - start)
    many = F.concat(
        F.substring(whole(a), start % CHUNK + 1, F.lit(CHUNK)),
        F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""),
        F.substring(whole(b), F.lit(1), end % CHUNK),
    )
    return F.when(end <= start, F.lit("")).when(a == b, one).otherwise(many)


def matches_all(text: Column, patterns: list[tuple[str, Column | None]]) -> Column:
    """For each pattern the places and texts of its leftmost non-overlapping matches (never empty ones):
    array<array<struct<start, end, text>>>; code points, end exclusive. The second of a pair, if
    not null, is a cheaper test that must hold."""
    raw = "struct<between:array<int>,found:array<string>>"

    def parts(pattern: str, only_if: Column | None) -> Column:
        test = F.rlike(text, F.lit(pattern))
        between = F.transform(F.split(text, pattern, -1), F.length)
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(test if only_if is None else only_if & test, F.struct(between.alias("between"), found.alias("found"))).otherwise(F.lit(None).cast(raw))

    def place(held: Column) -> Column:
        steps = running(F.zip_with(held["between"], held["found"], lambda b, m: b + F.coalesce(F.length(m), F.lit(0))))

        def put(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.get(held["between"], i)
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"))

            return F.transform(held["found"], one)

        return F.when(held.isNull(), F.array().cast(SPAN)).otherwise(bound(steps, put))

    return F.transform(F.array(*(parts(p, t) for p, t in patterns)), place)


def matches(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """array<struct<start, end, text>> of one pattern."""
    return F.get(matches_all(text, [(pattern, only_if)]), F.lit(0))


def labelled(found: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of several kinds as array<struct<start, order, end, kind>>: sorts by place, then order."""
    names = F.array(*map(F.lit, kinds))

    def of(some: Column, k: Column) -> Column:
        return F.transform(some, lambda x: F.struct(x["start"].alias("start"), k.alias("order"), x["end"].alias("end"), F.get(names, k).alias("kind")))

    return F.flatten(F.transform(found, of))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
