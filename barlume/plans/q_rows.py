"""Row-local expressions and import quality (inventory 2.1, 2.3, 2.4, B16-B19)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barlume.functions import parsing as P, pricing as C, text as T
from barlume.operators import quality as Q
from barlume.plans.adapters import bars, sql, table, ticks, trades
from barlume.plans.registry import query
from barlume.schema import NS

# --- file names and headers -------------------------------------------------------------------------------

_NAMES = """WITH names AS (SELECT o_orderkey AS k, 'sym' || o_orderkey % 7 || '_' || CASE o_orderkey % 5 WHEN 0 THEN 'M15' WHEN 1 THEN 'daily' WHEN 2 THEN 'h4' WHEN 3 THEN 'X9' ELSE 'MN1' END || '_20240'
    || 1 + o_orderkey % 9 || '010000_202406' || lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') || '2359' || CASE WHEN o_orderkey % 3 = 0 THEN '(2)' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.csv' END AS name FROM orders)"""


def _names(spark, sf):
    k = F.col("o_orderkey")
    frame = F.when(k % 5 == 0, "M15").when(k % 5 == 1, "daily").when(k % 5 == 2, "h4").when(k % 5 == 3, "X9").otherwise("MN1")
    name = F.concat(F.lit("sym"), (k % 7).cast("string"), F.lit("_"), frame, F.lit("_20240"), (1 + k % 9).cast("string"), F.lit("010000_202406"), F.lpad((k % 32).cast("string"), 2, "0"), F.lit("2359"), F.when(k % 3 == 0, "(2)").otherwise(""), F.when(k % 11 == 0, ".txt").otherwise(".csv"))
    return table(spark, sf, "orders").select(k.alias("k"), name.alias("name"))


_PARSED = (
    _NAMES
    + """, parts AS (SELECT k, regexp_extract(name, '^(.+)_(M15|daily|h4|MN1)_(\\d{12})_(\\d{12})(\\(\\d+\\))?\\.csv$', ['s', 't', 'a', 'b']) AS p FROM names),
    parsed AS (SELECT k, p.a <> '' AND p.a <= p.b AND try_strptime(p.b, '%Y%m%d%H%M') IS NOT NULL AS ok, p FROM parts),
    files AS (SELECT k, CASE WHEN ok THEN upper(p.s) END AS symbol, CASE WHEN ok THEN CASE WHEN p.t = 'daily' THEN 'D1' ELSE upper(p.t) END END AS timeframe, CASE WHEN ok THEN p.a END AS declared_start, CASE WHEN ok THEN p.b END AS declared_end FROM parsed)"""
)


@query("s1_parse_filename", sql(_PARSED + " SELECT * FROM files"))
def parse_filename(spark, sf):
    return _names(spark, sf).select("k", *(c.alias(n) for n, c in P.file_name(F.col("name")).items()))


@query("s2_discover_duplicates", sql(_PARSED + " SELECT symbol, timeframe, count(*) AS rows FROM files WHERE symbol IS NOT NULL GROUP BY symbol, timeframe HAVING count(*) > 1"))
def discover_duplicates(spark, sf):
    return Q.repeated(parse_filename(spark, sf).where("symbol is not null"), ["symbol", "timeframe"])


@query(
    "s3_header_dialect",
    """WITH h AS (SELECT o_orderkey AS k, replace('<DATE>|<TIME>|<OPEN>|<HIGH>|<LOW>|<CLOSE>|<TICKVOL>|<VOL>|' || CASE o_orderkey % 4 WHEN 0 THEN '<spread> ' WHEN 1 THEN '<VOL>' WHEN 2 THEN '<SPREAD>|<X>' ELSE '<SPREAD>' END, '|',
        CASE o_orderkey % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ',' ELSE ';' END) AS header FROM orders)
    SELECT k, CASE k % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ',' ELSE ';' END AS delimiter, CASE k % 4 WHEN 1 THEN 'missing: <SPREAD>' WHEN 2 THEN 'unknown: <X>' END AS error FROM h""",
)
def header_dialect(spark, sf):
    k = F.col("o_orderkey")
    tail = F.when(k % 4 == 0, "<spread> ").when(k % 4 == 1, "<VOL>").when(k % 4 == 2, "<SPREAD>|<X>").otherwise("<SPREAD>")
    header = F.replace(F.concat(F.lit("<DATE>|<TIME>|<OPEN>|<HIGH>|<LOW>|<CLOSE>|<TICKVOL>|<VOL>|"), tail), F.lit("|"), F.when(k % 3 == 0, "\t").when(k % 3 == 1, ",").otherwise(";"))
    rows = table(spark, sf, "orders").select(k.alias("k"), header.alias("header"))
    return rows.select("k", P.delimiter(F.col("header")).alias("delimiter"), P.header_error(F.col("header")).alias("error"))


# --- numbers and times ------------------------------------------------------------------------------------

_TEXTS = """WITH t AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
    x AS (SELECT k, cents, CASE k % 6 WHEN 0 THEN '-' WHEN 1 THEN '+' WHEN 2 THEN ' ' ELSE '' END || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
        || CASE k % 7 WHEN 0 THEN '00' WHEN 1 THEN '5' WHEN 2 THEN 'x' WHEN 3 THEN '000 ' ELSE '' END AS text FROM t)"""


@query("f1_scaled_integer", _TEXTS + " SELECT k, CASE WHEN k % 7 IN (1, 2) THEN NULL WHEN k % 6 = 0 THEN -cents ELSE cents END AS scaled FROM x")
def scaled_integer(spark, sf):
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    lead = F.when(k % 6 == 0, "-").when(k % 6 == 1, "+").when(k % 6 == 2, " ").otherwise("")
    tail = F.when(k % 7 == 0, "00").when(k % 7 == 1, "5").when(k % 7 == 2, "x").when(k % 7 == 3, "000 ").otherwise("")
    text = F.concat(lead, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), tail)
    return table(spark, sf, "orders").select(k.alias("k"), P.scaled_integer(text, 2).alias("scaled"))


def _stamps(spark, sf):
    """Wall clocks of the events, and some texts that are none."""
    e = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    date = F.when(F.col("event_id") % 17 == 0, F.date_format(at, "yyyy.M.d")).otherwise(F.date_format(at, "yyyy.MM.dd"))
    return e.select("event_id", date.alias("date"), F.when(F.col("event_id") % 19 == 0, "24:00:00").otherwise(F.date_format(at, "HH:mm:ss")).alias("time"))


_STAMPS = """WITH s AS (SELECT event_id, CASE WHEN (event_id % 17 = 0 AND (day(ts) < 10 OR month(ts) < 10)) OR event_id % 19 = 0 THEN NULL ELSE date_trunc('second', ts) END AS l FROM events)"""


@query("f2_f3_local_time", _STAMPS + " SELECT event_id, epoch_us(l) // 1000000 AS local_s, (epoch_us(l) - 7200000000) * 1000 AS utc_ns FROM s")
def local_time(spark, sf):
    rows = _stamps(spark, sf).withColumn("l", P.local_datetime(F.col("date"), F.col("time")))
    return rows.select("event_id", F.unix_seconds("l").alias("local_s"), P.localize_ns(F.col("l"), "Europe/Athens").alias("utc_ns"))


@query(
    "f4_f5_close_and_alignment",
    _STAMPS
    + """ SELECT event_id, (epoch_us(l) - 7200000000) * 1000 + 900000000000 AS m15_close, (epoch_us(l + INTERVAL 1 DAY) - 7200000000) * 1000 AS d1_close, (epoch_us(l + INTERVAL 7 DAY) - 7200000000) * 1000 AS w1_close,
    (epoch_us(l + INTERVAL 1 MONTH) - 7200000000) * 1000 AS mn1_close, epoch_us(l) % 60000000 = 0 AS on_minute FROM s""",
)
def close_and_alignment(spark, sf):
    rows = _stamps(spark, sf).withColumn("l", P.local_datetime(F.col("date"), F.col("time")))
    rows = rows.withColumn("o", P.localize_ns(F.col("l"), "Europe/Athens"))
    close = lambda tf: P.close_ns(F.col("l"), F.col("o"), tf, "Europe/Athens")
    return rows.select("event_id", close("M15").alias("m15_close"), close("D1").alias("d1_close"), close("W1").alias("w1_close"), close("MN1").alias("mn1_close"), P.aligned(F.col("l"), "M1").alias("on_minute"))


# --- raw rows with faults, checked -------------------------------------------------------------------------

_FAULTY = """faulty AS (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY tick_id) + 1 AS BIGINT) AS source_row, time_ns - time_ns % 60000000000 + CASE WHEN tick_id % 53 = 0 THEN 30000000000 ELSE 0 END AS open_time_ns,
        price_ticks * 5 + 1000 + CASE WHEN tick_id % 29 = 0 THEN 1 ELSE 0 END AS o, price_ticks * 5 + 1000 + tick_id % 7 * 5 - CASE WHEN tick_id % 41 = 0 THEN 100 ELSE 0 END AS h, price_ticks * 5 + 1000 - tick_id % 5 * 5 AS l, price_ticks * 5 + 1000 AS c,
        volume - CASE WHEN tick_id % 37 = 0 THEN 1000 ELSE 0 END AS v, tick_id % 67 = 0 AS bad FROM ticks),
    coded AS (SELECT *, CASE WHEN bad THEN 'INVALID_ROW' WHEN o % 5 <> 0 OR h % 5 <> 0 OR l % 5 <> 0 THEN 'PRICE_NOT_TICK_ALIGNED' WHEN v < 0 THEN 'NEGATIVE_VALUE' WHEN open_time_ns % 60000000000 <> 0 THEN 'TIMESTAMP_NOT_ALIGNED'
        WHEN h < greatest(o, c, l) OR l > least(o, c, h) THEN 'INVALID_OHLC' END AS reject_code FROM faulty)"""


def faulty(spark, sf):
    """Raw text rows like a file's, with faults planted by id."""
    t, i = ticks(spark, sf), F.col("tick_id")
    at = F.timestamp_micros(F.expr("(time_ns - pmod(time_ns, 60000000000)) div 1000")) + F.make_interval(secs=F.when(i % 53 == 0, 30).otherwise(0).cast("decimal(18,6)"))
    p = F.col("price_ticks") * 5 + 1000
    text = lambda points: F.concat(F.floor(points / 100).cast("string"), F.lit("."), F.lpad((points % 100).cast("string"), 2, "0"))
    row = F.row_number().over(Window.partitionBy("symbol").orderBy("tick_id")) + 1
    return t.select(
        "symbol",
        row.cast("bigint").alias("source_row"),
        F.date_format(at, "yyyy.MM.dd").alias("date"),
        F.date_format(at, "HH:mm:ss").alias("time"),
        F.when(i % 67 == 0, "n/a").otherwise(text(p + F.when(i % 29 == 0, 1).otherwise(0))).alias("open"),
        text(p + i % 7 * 5 - F.when(i % 41 == 0, 100).otherwise(0)).alias("high"),
        text(p - i % 5 * 5).alias("low"),
        text(p).alias("close"),
        (F.col("volume") - F.when(i % 37 == 0, 1000).otherwise(0)).cast("string").alias("tickvol"),
        F.lit("0").alias("vol"),
        F.lit("2").alias("spread"),
    )


def checked(spark, sf):
    return Q.parse_rows(faulty(spark, sf), "M1", "UTC", 2, 5)


def _with(body: str) -> str:
    return sql("--cte " + _FAULTY + body, "ticks")


@query("f6_reject_codes", _with(" SELECT symbol, source_row, reject_code FROM coded"))
def reject_codes(spark, sf):
    return checked(spark, sf).select("symbol", "source_row", "reject_code")


@query("q1_code_counts", _with(" SELECT symbol, reject_code, count(*) AS rows, array_to_string(list_slice(list(source_row ORDER BY source_row), 1, 5), ',') AS sample_rows FROM coded WHERE reject_code IS NOT NULL GROUP BY symbol, reject_code"))
def code_counts(spark, sf):
    return Q.code_counts(checked(spark, sf), ["symbol"]).withColumn("sample_rows", F.array_join(F.transform("sample_rows", lambda x: x.cast("string")), ","))


@query(
    "q2_gaps_duplicates",
    _with(
        """, d AS (SELECT symbol, open_time_ns, open_time_ns - lag(open_time_ns) OVER (PARTITION BY symbol ORDER BY source_row) AS d FROM coded WHERE reject_code IS NULL)
        SELECT symbol, count(*) AS rows, count(*) FILTER (d = 0) AS duplicates, count(*) FILTER (d < 0) AS out_of_order, min(open_time_ns) AS first_ns, max(open_time_ns) AS last_ns, count(*) FILTER (d > 60000000000) AS gaps,
        CAST(coalesce(sum(d // 60000000000 - 1) FILTER (d > 60000000000), 0) AS BIGINT) AS estimated_missing, coalesce(max(d // 1000000000) FILTER (d > 60000000000), 0) AS longest_gap_seconds FROM d GROUP BY symbol"""
    ),
)
def gaps_duplicates(spark, sf):
    return Q.time_checks(Q.accepted(checked(spark, sf)), ["symbol"], "M1")


_CUT = 1_705_000_000 * NS


@query("q3_f9_sequence", _with(f" SELECT symbol, source_row, CAST(row_number() OVER (PARTITION BY symbol ORDER BY source_row) - 1 AS BIGINT) AS sequence, true AS is_complete FROM coded WHERE reject_code IS NULL AND open_time_ns + 60000000000 <= {_CUT}"))
def sequence(spark, sf):
    return Q.number(Q.complete(Q.accepted(checked(spark, sf)), _CUT, "drop"), ["symbol"]).select("symbol", "source_row", "sequence", "is_complete")


@query("f9_completeness", _with(f" SELECT symbol, count(*) FILTER (open_time_ns + 60000000000 <= {_CUT}) AS complete, count(*) FILTER (open_time_ns + 60000000000 > {_CUT}) AS open_bars FROM coded WHERE reject_code IS NULL GROUP BY symbol"))
def completeness(spark, sf):
    return Q.complete(Q.accepted(checked(spark, sf)), _CUT).groupBy("symbol").agg(F.count_if("is_complete").alias("complete"), F.count_if(~F.col("is_complete")).alias("open_bars"))


@query(
    "s15_preflight",
    _with(
        """ SELECT symbol, count(*) AS rows, min(open_time_ns) AS first_ns, max(open_time_ns) AS last_ns, count(*) FILTER (v <> 0) AS nonzero_volume, CAST(2 AS INTEGER) AS decimals FROM faulty GROUP BY symbol"""
    ),
)
def preflight(spark, sf):
    from barlume.sources.csv_bars import preflight as check

    return check(faulty(spark, sf), ["symbol"])


@query("q9_severity", _with(""", i AS (SELECT symbol, CASE WHEN reject_code = 'INVALID_ROW' THEN 'ERROR' ELSE 'WARNING' END AS s FROM coded WHERE reject_code IS NOT NULL)
    SELECT symbol, count(*) FILTER (s = 'ERROR') AS errors, count(*) FILTER (s = 'WARNING') AS warnings, count(*) FILTER (s = 'ERROR') = 0 AS success FROM i GROUP BY symbol"""))
def severity(spark, sf):
    rows = checked(spark, sf).where("reject_code is not null")
    return Q.severity(rows.select("symbol", F.when(F.col("reject_code") == "INVALID_ROW", "ERROR").otherwise("WARNING").alias("severity")), ["symbol"])


@query("q7_import_success", _with(""", i AS (SELECT DISTINCT symbol, reject_code FROM coded WHERE reject_code IS NOT NULL) SELECT symbol, count(*) AS errors, CAST(0 AS BIGINT) AS warnings, false AS success FROM i GROUP BY symbol
    UNION ALL SELECT 'audit', 0, count(*), false FROM i"""))
def import_success(spark, sf):
    kinds = checked(spark, sf).where("reject_code is not null").select("symbol", "reject_code").distinct()
    issues = kinds.select("symbol", F.lit("ERROR").alias("severity")).unionByName(kinds.select(F.lit("audit").alias("symbol"), F.lit("WARNING").alias("severity")))
    return Q.severity(issues, ["symbol"], fail_on_warnings=True)


# --- series-level quality ----------------------------------------------------------------------------------

_SERIES = """--cte series AS (SELECT symbol, timeframe, 900 AS seconds, max(open_time_ns) AS last_open_ns FROM bars GROUP BY ALL UNION ALL SELECT symbol, timeframe, 3600, max(open_time_ns) FROM hours WHERE symbol <> 'error' GROUP BY ALL)"""


def _series(spark, sf):
    from barlume.schema import timeframes

    both = bars(spark, sf).unionByName(bars(spark, sf, "H1").where("symbol <> 'error'"))
    return both.groupBy("symbol", "timeframe").agg(F.max("open_time_ns").alias("last_open_ns")).join(F.broadcast(timeframes(spark)), "timeframe")  # a dimension of 21 rows


@query("q5_watermark", sql(_SERIES + ", f AS (SELECT symbol, arg_min(last_open_ns, seconds) AS w FROM series GROUP BY symbol) SELECT min(w) AS watermark_ns FROM f", "bars", "bars:H1:hours"))
def watermark(spark, sf):
    return Q.watermark(_series(spark, sf))


@query("q8_audit_base", sql(_SERIES + " SELECT symbol, arg_min(timeframe, seconds) AS base_timeframe FROM series GROUP BY symbol", "bars", "bars:H1:hours"))
def audit_base(spark, sf):
    return Q.audit_base(_series(spark, sf))


_AUDIT = """--cte targets AS (SELECT * REPLACE (CASE WHEN sequence % 50 = 7 THEN close_ticks + 3 ELSE close_ticks END AS close_ticks) FROM hours UNION ALL SELECT * FROM fours),
    cover AS (SELECT symbol, min(open_time_ns) AS lo, max(close_time_ns) AS hi FROM bars GROUP BY symbol),
    made AS (SELECT t.symbol, t.timeframe, t.open_time_ns, arg_min(b.open_ticks, b.open_time_ns) AS o, max(b.high_ticks) AS h, min(b.low_ticks) AS l, arg_max(b.close_ticks, b.open_time_ns) AS c, sum(b.tick_volume) AS v
        FROM targets t JOIN bars b ON b.symbol = t.symbol AND b.open_time_ns >= t.open_time_ns AND b.open_time_ns < t.close_time_ns GROUP BY ALL),
    a AS (SELECT t.symbol, t.timeframe, t.open_time_ns, m.o IS NOT NULL AS found, CASE WHEN m.o IS NOT NULL THEN array_to_string(list_filter([CASE WHEN t.open_ticks <> o THEN 'open_ticks' END, CASE WHEN t.high_ticks <> h THEN 'high_ticks' END,
        CASE WHEN t.low_ticks <> l THEN 'low_ticks' END, CASE WHEN t.close_ticks <> c THEN 'close_ticks' END, CASE WHEN t.tick_volume <> v THEN 'tick_volume' END], lambda x: x IS NOT NULL), ',') END AS different
        FROM targets t JOIN cover USING (symbol) LEFT JOIN made m USING (symbol, timeframe, open_time_ns) WHERE t.open_time_ns >= lo AND t.close_time_ns <= hi)"""
_AUDIT_VIEWS = ("bars", "bars:H1:hours", "bars:H4:fours")


_SHIFT = 2 * 3600 * NS


@query(
    "q6_audit_shifted_zone",
    sql(
        f"""--cte fours AS (SELECT symbol, (open_time_ns + {_SHIFT}) // {4 * 3600 * NS} * {4 * 3600 * NS} - {_SHIFT} AS open_time_ns, arg_min(open_ticks, open_time_ns) AS open_ticks, max(high_ticks) AS high_ticks,
            min(low_ticks) AS low_ticks, arg_max(close_ticks, open_time_ns) AS close_ticks, sum(tick_volume) AS tick_volume FROM hours GROUP BY 1, 2),
        cover AS (SELECT symbol, min(open_time_ns) AS lo, max(close_time_ns) AS hi FROM hours GROUP BY symbol),
        inside AS (SELECT f.*, f.open_time_ns % 7 = 3 AS broken FROM fours f JOIN cover USING (symbol) WHERE f.open_time_ns >= lo AND f.open_time_ns + {4 * 3600 * NS} <= hi)
        SELECT symbol, 'H4' AS timeframe, count(*) AS compared, count(*) FILTER (NOT broken) AS matching, count(*) FILTER (broken) AS mismatching, CAST(0 AS BIGINT) AS source_only, CAST(0 AS BIGINT) AS aggregate_only
        FROM inside GROUP BY symbol""",
        "bars:H1:hours",
    ),
)
def audit_shifted_zone(spark, sf):
    """Four-hour bars of a clock two hours from UTC, some of them with a wrong close, against their hours."""
    hours, length = bars(spark, sf, "H1"), 4 * 3600 * NS
    start = F.col("open_time_ns") + _SHIFT - F.pmod(F.col("open_time_ns") + _SHIFT, F.lit(length)) - _SHIFT
    fours = hours.groupBy("symbol", start.alias("at")).agg(
        F.min_by("open_ticks", "open_time_ns").alias("open_ticks"),
        F.max("high_ticks").alias("high_ticks"),
        F.min("low_ticks").alias("low_ticks"),
        F.max_by("close_ticks", "open_time_ns").alias("close_ticks"),
        F.sum("tick_volume").alias("tick_volume"),
    )
    fours = fours.withColumn("close_ticks", F.when(F.pmod("at", F.lit(7)) == 3, F.col("close_ticks") + 1).otherwise(F.col("close_ticks")))
    fours = fours.select("symbol", F.lit("H4").alias("timeframe"), F.col("at").alias("open_time_ns"), (F.col("at") + length).alias("close_time_ns"), "open_ticks", "high_ticks", "low_ticks", "close_ticks", "tick_volume")
    return Q.audit_summary(Q.cross_audit(hours, fours))


def _audited(spark, sf):
    hours = bars(spark, sf, "H1").withColumn("close_ticks", F.when(F.col("sequence") % 50 == 7, F.col("close_ticks") + 3).otherwise(F.col("close_ticks")))
    return Q.cross_audit(bars(spark, sf), hours.unionByName(bars(spark, sf, "H4")))


@query("q6_audit_crosstf", sql(_AUDIT + " SELECT * FROM a", *_AUDIT_VIEWS))
def audit(spark, sf):
    return _audited(spark, sf).select("symbol", "timeframe", "open_time_ns", "found", F.array_join("different", ",").alias("different"))


@query("q6_audit_summary", sql(_AUDIT + " SELECT symbol, timeframe, count(*) FILTER (found) AS compared, count(*) FILTER (different = '') AS matching, count(*) FILTER (different <> '') AS mismatching, count(*) FILTER (NOT found) AS source_only, CAST(0 AS BIGINT) AS aggregate_only FROM a GROUP BY ALL", *_AUDIT_VIEWS))
def audit_summary(spark, sf):
    return Q.audit_summary(_audited(spark, sf))


_MANIFEST = """--cte n AS (SELECT *, (row_number() OVER w - 1) // 1000 AS blk FROM bars WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY open_time_ns)),
    p AS (SELECT symbol, timeframe, blk, sha256(string_agg(open_time_ns || ',' || close_ticks, chr(10) ORDER BY open_time_ns)) AS d FROM n GROUP BY ALL),
    q AS (SELECT symbol, timeframe, sha256(string_agg(d, chr(10) ORDER BY blk)) AS sha256 FROM p GROUP BY symbol, timeframe),
    actual AS (SELECT symbol, timeframe, q.sha256, CAST(sum(tick_volume) AS BIGINT) AS size_bytes, count(*) AS row_count, min(open_time_ns) AS start_ns, max(open_time_ns) AS end_ns FROM bars JOIN q USING (symbol, timeframe) GROUP BY symbol, timeframe, q.sha256)"""


def _actual(spark, sf):
    from barlume.sources.manifest import build_manifest

    return build_manifest(bars(spark, sf), F.col("tick_volume"), 1000)


@query("s6_s7_manifest", sql(_MANIFEST + " SELECT * FROM actual", "bars"))
def manifest(spark, sf):
    return _actual(spark, sf)


@query(
    "q4_conformance",
    sql(
        _MANIFEST
        + """ SELECT symbol, timeframe, 'SOURCE_ROW_COUNT_MISMATCH' AS code, CAST(row_count + 1 AS VARCHAR) AS expected, CAST(row_count AS VARCHAR) AS actual FROM actual WHERE symbol > 'e'
        UNION ALL SELECT symbol, timeframe, 'SOURCE_HASH_MISMATCH', 'x', sha256 FROM actual WHERE symbol < 'd' UNION ALL SELECT symbol, timeframe, 'DECLARED_END_MISMATCH', CAST(end_ns + 1 AS VARCHAR), CAST(end_ns AS VARCHAR) FROM actual WHERE symbol = 'view'""",
        "bars",
    ),
)
def conformance(spark, sf):
    a = _actual(spark, sf)
    said = a.withColumns(
        {
            "row_count": F.when(F.col("symbol") > "e", F.col("row_count") + 1).otherwise(F.col("row_count")),
            "sha256": F.when(F.col("symbol") < "d", F.lit("x")).when(F.col("symbol") > "p", F.lit(None)).otherwise(F.col("sha256")),
            "end_ns": F.when(F.col("symbol") == "view", F.col("end_ns") + 1).otherwise(F.col("end_ns")),
        }
    )
    return Q.conformance(said, a, ["symbol", "timeframe"])


@query("j9_missing_profiles", "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN ('view', 'click')")
def missing_profiles(spark, sf):
    known = spark.createDataFrame([("view",), ("click",), ("other",)], "symbol string")
    return Q.missing(ticks(spark, sf), known, ["symbol"])


@query("t8_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness(spark, sf):
    return Q.repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "row_violations",
    sql("SELECT trade_id, 'net_identity' AS rule FROM trades WHERE net_pnl % 2 = 0 AND net_pnl + 1 <> gross_pnl - commission - spread_cost - slippage_cost + swap UNION ALL SELECT trade_id, 'risk_positive' FROM trades WHERE NOT initial_risk > 2500", "trades"),
)
def row_violations(spark, sf):
    rules = {"net_identity": "net_pnl % 2 <> 0 or net_pnl + 1 = gross_pnl - commission - spread_cost - slippage_cost + swap", "risk_positive": "initial_risk > 2500", "ordered": "entry_time_ns < exit_time_ns"}
    return Q.violations(trades(spark, sf), rules, ["trade_id"])


@query(
    "u10_tolerance_checks",
    """SELECT p_partkey, abs(p_retailprice - p_size * 30) <= 5 OR CASE WHEN p_size = 0 THEN p_retailprice = 0 ELSE abs(p_retailprice - p_size * 30) / (p_size * 30) * 10000 <= 500 END AS passed FROM part""",
)
def tolerance_checks(spark, sf):
    want = F.col("p_size") * 30.0
    return table(spark, sf, "part").select("p_partkey", Q.tolerance_check(want, F.col("p_retailprice"), F.lit(5), F.lit(500)).alias("passed"))


@query("g15_check_rollup", "SELECT p_brand, count(*) FILTER (p_size < 10) AS passed, count(*) FILTER (p_size BETWEEN 10 AND 19) AS warning, count(*) FILTER (p_size BETWEEN 20 AND 39) AS failed, count(*) FILTER (p_size >= 40) AS skipped FROM part GROUP BY p_brand")
def check_rollup(spark, sf):
    state = F.when(F.col("p_size") < 10, "passed").when(F.col("p_size") < 20, "warning").when(F.col("p_size") < 40, "failed").otherwise("skipped")
    rows = table(spark, sf, "part").select("p_brand", state.alias("state"))
    return rows.groupBy("p_brand").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("passed", "warning", "failed", "skipped")))


# --- prices, costs, sizes ------------------------------------------------------------------------------------

_SPREAD = "CAST(floor((least(greatest(CASE WHEN source_spread_points = 0 THEN 3 ELSE source_spread_points END, 2), 8) + 1) / 2.0) AS BIGINT)"


@query("f10_bid_ask", sql(f"SELECT symbol, open_time_ns, {_SPREAD} AS spread_ticks, open_ticks + {_SPREAD} AS ask_open, low_ticks + {_SPREAD} AS ask_low FROM bars", "bars"))
def bid_ask(spark, sf):
    s = C.spread_ticks(F.col("source_spread_points"), 2, least=2, most=8, fallback=3)
    return bars(spark, sf).select("symbol", "open_time_ns", s.alias("spread_ticks"), C.ask(F.col("open_ticks"), s).alias("ask_open"), C.ask(F.col("low_ticks"), s).alias("ask_low"))


@query("f7_tick_conversion", "SELECT o_orderkey, CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 5 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 5 END AS ticks FROM orders")
def tick_conversion(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, sf, "orders").select("o_orderkey", C.to_ticks(cents, F.lit(5).cast("bigint")).alias("ticks"))


@query("f8_normalize_volume", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 3 THEN CAST(3 + (least(CAST(l_quantity AS BIGINT), 40) - 3) // 4 * 4 AS BIGINT) END AS lots FROM lineitem")
def normalize_volume(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.normalize_volume(q, F.lit(3), F.lit(40), F.lit(4)).cast("bigint").alias("lots"))


@query(
    "b16_b17_costs",
    sql(
        """SELECT trade_id, CAST(CASE WHEN net_pnl > 0 THEN net_pnl * 1.25 ELSE net_pnl * 1.5 END * (1 + trade_id % 4) AS DOUBLE) AS pnl, spread_cost / 2.0 * 1.5 * (1 + trade_id % 4) AS half_spread,
        CAST(slippage_cost * 1.5 * (1 + trade_id % 4) AS DOUBLE) AS slippage,
        CASE trade_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 3.5 WHEN 2 THEN 3.5 * (1 + trade_id % 4) WHEN 3 THEN 3.5 * (1 + trade_id % 4) / 2 ELSE initial_risk * 100.0 * (1 + trade_id % 4) * 3.5 / 10000 END AS commission FROM trades""",
        "trades",
    ),
)
def cost_models(spark, sf):
    k, lots = F.col("trade_id"), 1 + F.col("trade_id") % 4
    mode = F.when(k % 5 == 0, "NONE").when(k % 5 == 1, "PER_ORDER").when(k % 5 == 2, "PER_LOT_SIDE").when(k % 5 == 3, "PER_LOT_ROUND_TURN").otherwise("NOTIONAL_BPS")
    entry, exit_ = F.lit(0.0), F.when(F.col("side") == "LONG", F.col("net_pnl")).otherwise(-F.col("net_pnl")).cast("double")
    f = lambda x: F.lit(float(x))
    return trades(spark, sf).select(
        "trade_id",
        C.price_pnl(F.col("side"), entry, exit_, lots, f(1), f(1.25), f(1.5)).alias("pnl"),
        C.half_spread_cost(F.col("spread_cost"), lots, f(1.5)).alias("half_spread"),
        C.slippage_cost(F.col("slippage_cost"), lots, f(1.5)).alias("slippage"),
        C.commission(mode, f(3.5), lots, F.col("initial_risk").cast("double"), f(100)).alias("commission"),
    )


@query(
    "b18_margin",
    sql("SELECT trade_id, CASE WHEN trade_id % 7 = 0 THEN 50.0 * (1 + trade_id % 4) WHEN trade_id % 3 = 0 THEN initial_risk * 100.0 * (1 + trade_id % 4) / 50 WHEN trade_id % 3 = 1 THEN 100.0 * (1 + trade_id % 4) / 50 END AS margin FROM trades", "trades"),
)
def margin(spark, sf):
    k, lots = F.col("trade_id"), 1 + F.col("trade_id") % 4
    mode = F.when(k % 3 == 0, "CFD").when(k % 3 == 1, "FOREX").otherwise("FUTURES")
    return trades(spark, sf).select("trade_id", C.margin(mode, F.col("initial_risk").cast("double"), F.lit(100.0), lots, F.lit(50.0), F.when(k % 7 == 0, 50.0).otherwise(0.0)).alias("margin"))


@query(
    "b19_sizing",
    sql(
        """--cte s AS (SELECT trade_id, CASE trade_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 7.0 WHEN 2 THEN initial_risk * 100.0 * 1.0 / 100 / nullif(abs(mae - mfe), 0) ELSE 500.0 / nullif(abs(mae - mfe), 0) END AS raw FROM trades)
        SELECT trade_id, CASE WHEN raw >= 0.5 THEN 0.5 + floor((least(raw, 20.0) - 0.5) / 0.25) * 0.25 END AS lots FROM s""",
        "trades",
    ),
)
def sizing(spark, sf):
    k = F.col("trade_id")
    mode = F.when(k % 4 == 0, "FIXED_LOT").when(k % 4 == 1, "STRATEGY_DEFINED").when(k % 4 == 2, "RISK_PERCENT").otherwise("FIXED_CASH")
    amount = F.when(k % 4 == 0, 2.0).when(k % 4 == 2, 1.0).otherwise(500.0)
    f = lambda x: F.lit(float(x))
    return trades(spark, sf).select("trade_id", C.size(mode, F.col("initial_risk") * 100.0, F.col("mae"), F.col("mfe"), amount, f(7), f(1), f(0.5), f(20), f(0.25)).alias("lots"))


# --- text, payloads, ids --------------------------------------------------------------------------------------


@query(
    "f14_exit_kind",
    sql("SELECT trade_id, CASE exit_reason WHEN 'stop_out' THEN 'liquidation' WHEN 'stop_loss' THEN 'stop_loss' WHEN 'take_profit' THEN 'take_profit' WHEN 'end_of_data' THEN 'end_of_data' ELSE 'other' END AS kind FROM trades", "trades"),
)
def exit_kind(spark, sf):
    odd = F.when(F.col("trade_id") % 2 == 0, F.concat(F.lit(" "), F.upper(F.replace("exit_reason", F.lit("_"), F.lit("-"))))).otherwise(F.col("exit_reason"))
    return trades(spark, sf).select("trade_id", T.exit_kind(odd).alias("kind"))


@query("f15_payload_routing", "SELECT event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def payload_routing(spark, sf):
    k = T.payload(F.col("props"), "$.missing.k", "$.k").cast("bigint")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("f16_finite", "SELECT event_type, count(*) AS n FROM events WHERE isfinite(value) AND try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL GROUP BY event_type")
def finite(spark, sf):
    e = table(spark, sf, "events")
    return e.where(~F.isnan("value") & (F.abs("value") < float("inf")) & F.get_json_object("props", "$.k").try_cast("int").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f17_vendor_codes", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'FOREX' WHEN 1 THEN 'FUTURES' WHEN 2 THEN 'CFD' WHEN 3 THEN 'CFD_INDEX' END AS mode, sha256(p_brand || '|' || p_size) AS profile_id FROM part")
def vendor_codes(spark, sf):
    codes = F.create_map(*(F.lit(x) for pair in ((0, "FOREX"), (1, "FUTURES"), (2, "CFD"), (3, "CFD_INDEX")) for x in pair))
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(codes, (F.col("p_size") % 6).cast("int")).alias("mode"), F.sha2(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")), 256).alias("profile_id"))


@query(
    "f19_chain_ids",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_orderkey % 5 WHEN o_orderkey % 3 = 1 AND o_orderkey % 7 < 5 THEN 'c' || o_orderkey % 7 END AS chain FROM orders""",
)
def chain_ids(spark, sf):
    k = F.col("o_orderkey")
    tag = F.when(k % 3 == 0, F.concat(F.lit("c"), (k % 5).cast("string")))
    client = F.when(k % 3 == 1, F.concat(F.lit("run-c"), (k % 7).cast("string"), F.lit("-x"))).otherwise(F.lit("run-c0-c1"))
    chains = spark.createDataFrame([(f"c{i}",) for i in range(5)], "chain string")
    return T.chain_id(table(spark, sf, "orders").select(k.alias("order_id"), tag.alias("tag"), client.alias("client_id")), chains).select("order_id", "chain")


@query(
    "k8_run_digest",
    sql(
        """--cte n AS (SELECT symbol, (row_number() OVER w - 1) // 1000 AS b, row_number() OVER w AS n, trade_id || '|' || net_pnl AS r FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_time_ns, trade_id)),
        p AS (SELECT symbol, b, sha256(string_agg(r, chr(10) ORDER BY n)) AS d, count(*) AS c FROM n GROUP BY symbol, b)
        SELECT symbol, CAST(sum(c) AS BIGINT) AS records, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM p GROUP BY symbol""",
        "trades",
    ),
)
def run_digest(spark, sf):
    return T.run_digest(trades(spark, sf), ["symbol"], ["exit_time_ns", "trade_id"], F.concat_ws("|", F.col("trade_id").cast("string"), F.col("net_pnl").cast("string")), 1000)


@query("canonical_ids", "SELECT o_orderkey, 'ord_' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, '{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderpriority || '\"}' AS record FROM orders")
def canonical_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("b"), F.col("o_orderkey").alias("a"), F.lit(None).cast("string").alias("c"))
    return o.select("o_orderkey", T.short_id("ord", F.col("o_custkey"), F.col("o_orderkey")).alias("id"), T.canonical_json(o, ["c", "b", "a"]).alias("record"))
