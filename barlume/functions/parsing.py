"""Exact parsing of raw bar files: file names, headers, numbers, local times, alignment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barlume.schema import NS, TIMEFRAMES

ALIASES = {"DAILY": "D1", "DAY": "D1"}
DELIMITERS = ("\t", ",", ";", "|")
COLUMNS = ("<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<TICKVOL>", "<VOL>", "<SPREAD>")


def file_name(name: Column) -> dict[str, Column]:
    """symbol, timeframe, start and end (yyyyMMddHHmm) of ``SYMBOL_TF_START_END[(n)].csv``; null where it is none,
    or where start exceeds end."""
    frames = "|".join(sorted([*TIMEFRAMES, *ALIASES], key=len, reverse=True))
    pattern = rf"(?i)^(.+)_({frames})_(\d{{12}})_(\d{{12}})(?:\(\d+\))?\.csv$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    frame = F.upper(part(2))
    for a, b in ALIASES.items():
        frame = F.when(frame == a, F.lit(b)).otherwise(frame)
    ok = (part(3) <= part(4)) & F.try_to_timestamp(part(3), F.lit("yyyyMMddHHmm")).isNotNull() & F.try_to_timestamp(part(4), F.lit("yyyyMMddHHmm")).isNotNull()
    return {k: F.when(ok, v) for k, v in (("symbol", F.upper(part(1))), ("timeframe", frame), ("declared_start", part(3)), ("declared_end", part(4)))}


def delimiter(header: Column) -> Column:
    """The separator that occurs most, the first of equals; null without any."""
    counts = [F.length(header) - F.length(F.replace(header, F.lit(d), F.lit(""))) for d in DELIMITERS]
    top = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for d, n in reversed(list(zip(DELIMITERS, counts, strict=True))):
        out = F.when(n == top, F.lit(d)).otherwise(out)
    return F.when(top > 0, out)


def header_error(header: Column, daily: bool = False) -> Column:
    """missing, duplicate or unknown columns of a header line, as text; null if it is right."""
    sep = delimiter(header)
    names = F.transform(F.split(header, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))), lambda c: F.upper(F.trim(c)))
    needed = F.array(*(F.lit(c) for c in COLUMNS if not (daily and c == "<TIME>")))
    missing, unknown = F.array_sort(F.array_except(needed, names)), F.array_sort(F.array_except(names, F.array(*map(F.lit, COLUMNS))))
    twice = F.array_sort(F.array_distinct(F.filter(names, lambda c: F.size(F.filter(names, lambda d: d == c)) > 1)))
    say = lambda what, a: F.when(F.size(a) > 0, F.concat(F.lit(what + ": "), F.array_join(a, ", ")))
    return F.when(sep.isNull(), F.lit("no delimiter")).otherwise(F.coalesce(say("missing", missing), say("duplicate", twice), say("unknown", unknown)))


def scaled_integer(text: Column, digits: int) -> Column:
    """An exact decimal text times 10^digits as BIGINT; null unless it is a number whose further digits are all zero."""
    t = F.trim(text)
    ok = F.rlike(t, F.lit(rf"^[+-]?[0-9]+(\.(?=[0-9])[0-9]{{0,{digits}}}0*)?$"))  # the one regular expression
    signed = F.startswith(t, F.lit("-")) | F.startswith(t, F.lit("+"))
    plain = F.when(signed, F.substring(t, 2, 1 << 20)).otherwise(t)
    frac = F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise(F.lit(""))
    whole = F.substring_index(plain, ".", 1)
    number = F.concat(whole, F.rpad(F.substring(frac, 1, digits), digits, "0")) if digits else whole
    return F.when(ok, number.try_cast("bigint") * F.when(F.startswith(t, F.lit("-")), -1).otherwise(1))


DAY_MICROS = 86_400_000_000


def whole_number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.rlike(t, F.lit(r"^[+-]?[0-9]+$")), t.try_cast("bigint"))


def local_datetime(date: Column, time: Column) -> Column:
    """The wall clock (as a timestamp under UTC) of ``yyyy.MM.dd`` and ``HH:mm:ss``, widths fixed; null if there is none."""
    d, t = F.trim(date), F.trim(time)
    return F.when((F.length(d) == 10) & (F.length(t) == 8), F.try_to_timestamp(F.concat_ws(" ", d, t), F.lit("yyyy.MM.dd HH:mm:ss")))


def localize_ns(local: Column, zone: str) -> Column:
    """UTC nanoseconds of a wall clock in ``zone``; null for times that the zone skips or repeats.

    The zone's offsets a day before and a day after are tried: around a change they are the two that count,
    whatever its size. A time that both give is repeated, one that neither gives is skipped. The session's zone
    must be UTC."""
    near = F.unix_micros(F.to_utc_timestamp(local, zone))

    def by_offset_of(other: Column) -> Column:
        at = F.timestamp_micros(other)
        return F.unix_micros(local) - (F.unix_micros(F.from_utc_timestamp(at, zone)) - other)

    def holds(micros: Column) -> Column:
        return F.from_utc_timestamp(F.timestamp_micros(micros), zone) == local

    one, two = by_offset_of(near - DAY_MICROS), by_offset_of(near + DAY_MICROS)
    found = F.when(holds(one) & holds(two), F.when(one == two, one)).when(holds(one), one).when(holds(two), two)
    return found * 1000


def close_ns(local: Column, open_ns: Column, timeframe: str, zone: str) -> Column:
    """Intraday: the open and the timeframe's seconds. A day, week or month: the local calendar's next."""
    if timeframe not in ("D1", "W1", "MN1"):
        return open_ns + TIMEFRAMES[timeframe] * NS
    step = {"D1": F.make_interval(days=F.lit(1)), "W1": F.make_interval(weeks=F.lit(1)), "MN1": F.make_interval(months=F.lit(1))}[timeframe]
    return localize_ns(local + step, zone)


def aligned(local: Column, timeframe: str) -> Column:
    """Whether a wall clock starts a bar of the timeframe; weeks and months always do."""
    if timeframe in ("W1", "MN1"):
        return local.isNotNull()
    return F.pmod(F.unix_micros(local), F.lit(TIMEFRAMES[timeframe] * 1_000_000)) == 0


def reject_code(prices: list[Column], tick_points: int, volumes: list[Column], on_time: Column, parsed: Column) -> Column:
    """Why a raw row is rejected, the first reason in this order; null if it is accepted."""
    o, h, low, c = prices
    misaligned = F.lit(False)
    for p in prices:
        misaligned = misaligned | (F.pmod(p, F.lit(tick_points)) != 0)
    negative = F.lit(False)
    for v in volumes:
        negative = negative | (v < 0)
    return (
        F.when(~parsed, "INVALID_ROW")
        .when(misaligned, "PRICE_NOT_TICK_ALIGNED")
        .when(negative, "NEGATIVE_VALUE")
        .when(~on_time, "TIMESTAMP_NOT_ALIGNED")
        .when((h < F.greatest(o, c, low)) | (low > F.least(o, c, h)), "INVALID_OHLC")
    )
