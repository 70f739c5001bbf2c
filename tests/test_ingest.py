"""Raw files, time zones, number texts, storage."""

import hashlib
import os
import subprocess
import sys
import threading
from datetime import datetime, timezone
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from barlume.functions import parsing as P
from barlume.operators import quality as Q
from barlume.sources import csv_bars, ingest, manifest, snapshots, staging, store

HEAD = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n"


def m1(n=6, bad=None):
    lines = []
    for i in range(n):
        o = 100 + i * 0.8
        h = o - 5 if i == bad else 101 + i
        lines.append(f"2025.01.01\t00:0{i}:00\t{o:.2f}\t{h:.2f}\t{o - 1:.2f}\t{min(o, 104):.2f}\t{10 + i}\t0\t2")
    return HEAD + "\n".join(lines) + "\n"


def m5():
    return HEAD + "2025.01.01\t00:00:00\t100.00\t105.00\t99.00\t103.20\t60\t0\t2\n2025.01.01\t00:05:00\t104.00\t106.00\t103.00\t104.00\t15\t0\t2\n"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "XAUUSD_M1_202501010000_202501010005.csv").write_text(m1())
    (d / "xauusd_m5_202501010000_202501010005(1).csv").write_text("﻿" + m5(), encoding="utf-8")
    return d


def test_import_and_audit(spark, folder, tmp_path):
    got = ingest.import_folder(spark, str(folder), str(tmp_path / "out"))
    bars = got["bars"]
    assert bars.count() == 8 and bars.where("not is_complete").count() == 2
    audit = got["audit"].first()
    assert (audit.symbol, audit.timeframe, audit.compared, audit.matching, audit.mismatching) == ("XAUUSD", "M5", 1, 1, 0)
    last = bars.where("timeframe = 'M5' and is_complete").first()
    assert last.close_ticks == 10320 and last.sequence == 0 and last.source_row == 2
    assert [r.sequence for r in bars.where("timeframe = 'M1'").orderBy("open_time_ns").collect()] == list(range(6))


def hours(n, first=0):
    """Lines of hourly bars from midnight of 2024-10-26; the price is the number of the bar."""
    lines = []
    for i in range(n):
        day, hour = divmod(first + i, 24)
        lines.append(f"2024.10.{10 + day:02d}\t{hour:02d}:00:00\t{100 + i}.00\t{100 + i}.50\t{99 + i}.00\t{100 + i}.25\t1\t0\t0")
    return HEAD + "\n".join(lines) + "\n"


def test_audit_in_a_zone_off_utc(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "X_H1_202410100000_202410142300.csv").write_text(hours(96))
    four = [f"2024.10.{10 + i // 6:02d}\t{i % 6 * 4:02d}:00:00\t{100 + 4 * i}.00\t{103 + 4 * i}.50\t{99 + 4 * i}.00\t{103 + 4 * i}.25\t4\t0\t0" for i in range(24)]
    (d / "X_H4_202410100000_202410142000.csv").write_text(HEAD + "\n".join(four) + "\n")
    day = [f"2024.10.{10 + i:02d}\t00:00:00\t{100 + 24 * i}.00\t{123 + 24 * i}.50\t{99 + 24 * i}.00\t{123 + 24 * i}.25\t24\t0\t0" for i in range(4)]
    (d / "X_D1_202410100000_202410130000.csv").write_text(HEAD + "\n".join(day) + "\n")
    got = ingest.import_folder(spark, str(d), str(tmp_path / "out"), zone="Europe/Athens")
    assert {(r.timeframe, r.compared, r.matching, r.source_only) for r in got["audit"].collect()} == {("H4", 24, 24, 0), ("D1", 4, 4, 0)}


def test_an_import_is_reused_by_content(spark, folder, tmp_path, monkeypatch):
    parsed, out = [], str(tmp_path / "out")
    plain = Q.parse_rows
    monkeypatch.setattr(Q, "parse_rows", lambda *a: parsed.append(1) or plain(*a))
    run = lambda **more: ingest.import_folder(spark, str(folder), out, **more)["bars"].count()
    assert run() == 8 and len(parsed) == 2
    assert run(mode="read_only") == 8 and len(parsed) == 2
    assert run(mode="refresh") == 8 and len(parsed) == 4
    with pytest.raises(store.Missing):
        run(mode="read_only", digits=3)
    with (folder / "XAUUSD_M1_202501010000_202501010005.csv").open("a") as f:
        f.write("\n")
    with pytest.raises(store.Missing, match=r"\['XAUUSD_M1_202501010000_202501010005.csv'\]"):
        run(mode="read_only")
    assert run() == 8 and len(parsed) == 5  # the other file's rows are read back


def test_many_files_in_one_scan(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for i in range(24):
        head = HEAD.replace("\t", ",") if i % 2 else HEAD
        body = m1().removeprefix(HEAD)
        (d / f"S{i:03d}_M1_202501010000_202501010005.csv").write_text(head + (body.replace("\t", ",") if i % 2 else body))
    got = ingest.import_folder(spark, str(d), str(tmp_path / "out"))
    assert got["bars"].groupBy("symbol").count().where("count = 6").count() == 24
    assert got["bars"].where("source_row <> sequence + 2").count() == 0
    (d / "T_M1_202501010000_202501010005.csv").write_text("<DATE>,<OPEN>\n")
    with pytest.raises(ValueError, match="T_M1.*missing"):
        ingest.import_folder(spark, str(d), str(tmp_path / "out"))


def test_bad_row_fails_after_the_report(spark, folder, tmp_path):
    (folder / "XAUUSD_M1_202501010000_202501010005.csv").write_text(m1(bad=2))
    with pytest.raises(RuntimeError):
        ingest.import_folder(spark, str(folder), str(tmp_path / "out"))
    codes = store.read_table(spark, f"{tmp_path}/out/report", "reject_codes").collect()
    assert [(r.reject_code, r.rows, r.sample_rows) for r in codes] == [("INVALID_OHLC", 1, [4])]


def test_wrong_names_and_headers(spark, folder, tmp_path):
    (folder / "other.csv").write_text("x")
    (folder / "EMPTY_M1_202501010000_202501010005.csv").write_text("")
    with pytest.raises(ValueError, match="EMPTY.*other.csv"):
        ingest.import_folder(spark, str(folder), str(tmp_path / "out"))
    (folder / "h.csv").write_text("<DATE>,<OPEN>\n")
    with pytest.raises(ValueError, match="missing"):
        csv_bars.read(spark, str(folder / "h.csv"), "M1")


def test_daily_without_time_and_drop_policy(spark, tmp_path):
    (tmp_path / "d.csv").write_text(HEAD.replace("<TIME>\t", "") + "2025.01.01\t100.00\t100.00\t100.00\t100.00\t1\t0\t0\n2025.01.02\t101.00\t101.00\t101.00\t101.00\t1\t0\t0\n")
    raw = csv_bars.read(spark, str(tmp_path / "d.csv"), "D1").withColumn("symbol", F.lit("X"))
    rows = Q.complete(Q.parse_rows(raw, "D1", "UTC", 2), 1_735_776_000 * 10**9)
    got = rows.orderBy("source_row").collect()
    assert [r.open_ticks for r in got] == [10000, 10100] and [r.is_complete for r in got] == [True, False]
    assert all(r.close_time_ns - r.open_time_ns == 86_400 * 10**9 for r in got)
    assert Q.complete(Q.parse_rows(raw, "D1", "UTC", 2), 1_735_776_000 * 10**9, "drop").count() == 1


def test_misaligned_price(spark):
    raw = spark.createDataFrame([(2, "2025.01.01", "00:00:00", "100.03", "101.00", "100.00", "100.05", "1", "0", "0", "X")], "source_row long, date string, time string, open string, high string, low string, close string, tickvol string, vol string, spread string, symbol string")
    assert Q.parse_rows(raw, "M1", "UTC", 2, 5).first().reject_code == "PRICE_NOT_TICK_ALIGNED"


def test_local_times_skip_and_repeat(spark):
    texts = [("2025.01.01", "00:00:00"), ("2024.03.31", "03:30:00"), ("2024.10.27", "03:30:00"), ("2024.10.27", "04:00:00"), ("2024.10.27", "02:59:59"), ("2024.07.01", "12:00:00")]
    df = spark.createDataFrame(texts, "d string, t string")
    got = [r[0] for r in df.select(P.localize_ns(P.local_datetime(F.col("d"), F.col("t")), "Europe/Athens")).collect()]
    for (d, t), ns in zip(texts, got, strict=True):
        local = datetime.strptime(f"{d} {t}", "%Y.%m.%d %H:%M:%S")
        both = {local.replace(tzinfo=ZoneInfo("Europe/Athens"), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        both = {x for x in both if x.astimezone(ZoneInfo("Europe/Athens")).replace(tzinfo=None) == local}
        assert ns == (int(both.pop().timestamp()) * 10**9 if len(both) == 1 else None), (d, t)


def test_shifts_of_any_size(spark):
    cases = [("Antarctica/Troll", "2024.10.27", "01:30:00"), ("Antarctica/Troll", "2024.10.27", "00:59:59"), ("Antarctica/Troll", "2024.10.27", "03:00:00"), ("Antarctica/Troll", "2024.03.31", "02:30:00"), ("Australia/Lord_Howe", "2024.04.07", "01:45:00"), ("Pacific/Apia", "2011.12.30", "12:00:00"), ("Asia/Kolkata", "2024.05.01", "00:00:00")]
    for zone, d, t in cases:
        got = spark.createDataFrame([(d, t)], "d string, t string").select(P.localize_ns(P.local_datetime(F.col("d"), F.col("t")), zone)).first()[0]
        local = datetime.strptime(f"{d} {t}", "%Y.%m.%d %H:%M:%S")
        both = {local.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        both = {x for x in both if x.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local}
        assert got == (int(both.pop().timestamp()) * 10**9 if len(both) == 1 else None), (zone, d, t)


def test_number_texts(spark):
    cases = {"1.5": 150, " -2.50 ": -250, "+3": 300, "4.560": 456, "4.561": None, "5.": None, ".5": None, "": None, "x": None, "1e3": None, "--1": None, "0.00": 0, "9" * 30: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert dict(df.select("t", P.scaled_integer(F.col("t"), 2)).collect()) == cases


def test_manifest_cache_and_bundle(spark, folder, tmp_path):
    files = manifest.file_manifest(spark, str(folder)).collect()
    assert len(files) == 2 and all(len(f.sha256) == 64 for f in files)
    made = []
    make = lambda: made.append(1) or spark.range(10)
    key = store.content_key(files[0].sha256, {"digits": 2})
    for mode in ("reuse", "reuse", "read_only", "refresh"):
        assert store.cached(spark, str(tmp_path / "c"), key, make, mode).count() == 10
    assert len(made) == 2
    spark.range(9).write.mode("overwrite").parquet(store.latest(spark, f"{tmp_path}/c/{key}").path("rows"))
    with pytest.raises(store.Missing):
        store.cached(spark, str(tmp_path / "c"), key, make, "read_only")
    store.write_bundle({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path / "runs/r1"), "r1")
    cat = store.run_catalog(spark, str(tmp_path / "runs"))
    assert {(r.table, r.rows) for r in cat.collect()} == {("a", 3), ("b", 4)} and store.verify_bundle(spark, cat, "r1") == []
    spark.range(5).write.mode("overwrite").parquet(store.latest(spark, f"{tmp_path}/runs/r1").path("b"))
    assert store.verify_bundle(spark, cat, "r1") == ["b"]
    store.write_bundle({"a": spark.range(7)}, str(tmp_path / "runs/r1"), "r1")
    (tmp_path / "runs/r2/commits").mkdir(parents=True)
    (tmp_path / "runs/r2/commits/000000000001.json").write_text('{"version": 1, "da')
    assert [(r.run_id, r.table, r.rows) for r in store.run_catalog(spark, str(tmp_path / "runs")).collect()] == [("r1", "a", 7)]


def test_trades_files_and_packages(spark, tmp_path):
    t = spark.createDataFrame([(2, 20, {"k": "v"}), (1, 10, None)], "trade_id long, entry_time_ns long, tags map<string,string>")
    at = Path(store.write_trades(t, str(tmp_path)).path("trades.csv").removeprefix("file:"))
    parts = sorted(p for p in at.glob("part-*.csv") if p.stat().st_size)
    assert all(p.read_bytes()[:3] == b"\xef\xbb\xbf" for p in parts)
    lines = [line.split(",")[0] for p in parts for line in p.read_text(encoding="utf-8-sig").splitlines()]
    assert [x for x in lines if x != "trade_id"] == ["1", "2"] and lines[0] == "trade_id"
    ok, problems = store.packages([{"id": "a", "entry": "m:o"}, {"id": "a", "entry": "m:o"}, {"id": "b", "entry": "m", "path": "x"}, {"id": "c", "entry": "m:o", "path": "../x"}, {"id": "d", "enabled": False}])
    assert [p["id"] for p in ok] == ["a"] and len(problems) == 3


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    """Of many files those are parsed whose content is new, told by the lines that the parser gets."""
    d, out, lines = tmp_path / "in", str(tmp_path / "out"), []
    d.mkdir()
    name = "S{:02d}_M1_202501010000_202501010005.csv"
    for i in range(12):
        (d / name.format(i)).write_text(m1(3 + i % 4))
    plain = csv_bars.read_all
    monkeypatch.setattr(csv_bars, "read_all", lambda *a: (r := plain(*a), lines.append(r.count()))[0])
    got = ingest.import_folder(spark, str(d), out)
    assert lines == [sum(3 + i % 4 for i in range(12))] and got["files"].where("reused").count() == 0
    (d / name.format(3)).write_text(m1(5))
    (d / name.format(12)).write_text(m1(4))
    got = ingest.import_folder(spark, str(d), out)
    assert lines[1:] == [9] and {r.name for r in got["files"].where("not reused").collect()} == {name.format(3), name.format(12)}
    assert {r.symbol: r["count"] for r in got["bars"].groupBy("symbol").count().collect()} == {f"S{i:02d}": {3: 5, 12: 4}.get(i, 3 + i % 4) for i in range(13)}
    # a file that is as it was before is known still, and one that is gone is no longer imported
    (d / name.format(3)).write_text(m1(6))
    (d / name.format(0)).unlink()
    got = ingest.import_folder(spark, str(d), out)
    assert len(lines) == 2 and got["bars"].select("symbol").distinct().count() == 12
    assert staging.vacuum(spark, f"{out}/staged", grace_seconds=3600) == []


def test_rows_that_were_changed_are_parsed_again(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    ingest.import_folder(spark, str(folder), out)
    (some,) = [p for p in Path(f"{out}/staged/rows").rglob("*.parquet") if spark.read.parquet(str(p)).first().timeframe == "M5"]
    rows = spark.read.parquet(str(some)).withColumn("close_ticks", F.lit(1).cast("long")).collect()
    schema = spark.read.parquet(str(some)).schema
    some.unlink()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(some.parent))
    with pytest.raises(store.Missing, match="m5"):
        ingest.import_folder(spark, str(folder), out, mode="read_only")
    got = ingest.import_folder(spark, str(folder), out)
    assert got["bars"].where("timeframe = 'M5'").agg(F.max("close_ticks")).first()[0] > 1
    assert {(r.timeframe, r.reused) for r in got["files"].collect()} == {("M1", True), ("M5", False)}


def test_a_killed_write_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(spark, root, {"a": spark.range(5), "b": spark.range(2)})
    reader = snapshots.current(spark, root)
    fails = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        snapshots.publish(spark, root, {"b": spark.range(50), "a": fails})
    assert len(list((tmp_path / "t/data").iterdir())) == 1  # the abort took its folder along
    # a process that died after writing data, and one that died before its commit file got its name
    spark.range(9).write.parquet(f"{root}/data/dead/a")
    (tmp_path / "t/commits/_half").write_text('{"version": 2')
    now = snapshots.current(spark, root)
    assert now.number == 1 and now.read(spark, "a").count() == 5 and now.changed(spark) == []
    two = snapshots.publish(spark, root, {"a": spark.range(7)})
    assert (two.number, two.read(spark, "a").count(), reader.read(spark, "a").count()) == (2, 7, 5)
    with pytest.raises(RuntimeError, match="no"):
        snapshots.publish(spark, root, {"a": spark.range(8)}, check=lambda told: (_ for _ in ()).throw(RuntimeError(f"no {told['a']['rows']}")))
    assert snapshots.vacuum(spark, root) == []  # nothing is old enough
    gone = snapshots.vacuum(spark, root, keep=1, grace_seconds=-1)
    assert set(gone) == {"commits/_half", "commits/000000000001.json", "data/dead", reader.data}
    assert snapshots.current(spark, root).read(spark, "a").count() == 7


def test_of_two_writers_one_wins(spark, tmp_path):
    root, out = str(tmp_path / "t"), []

    def write(n):
        try:
            out.append(snapshots.publish(spark, root, {"a": spark.range(n)}, expect=0).read(spark, "a").count())
        except snapshots.Conflict:
            out.append("conflict")

    writers = [threading.Thread(target=write, args=(n,)) for n in (3, 4, 5, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    (won,) = [x for x in out if x != "conflict"]
    assert out.count("conflict") == 3 and snapshots.current(spark, root).read(spark, "a").count() == won
    assert len(list((tmp_path / "t/data").iterdir())) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, {"a": spark.range(1)}, expect=0)


def test_versions_keep_folders_formats_and_digests(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 1.5, {"a": 1}), ("y", 2, None, None)], "k string, n long, v double, m map<string,int>")
    tables = {"p": snapshots.Table(df, partition_by=("k",)), "j": snapshots.Table(df, "json"), "e": df.limit(0)}
    v = snapshots.publish(spark, str(tmp_path / "t"), tables, note={"by": "me"})
    back = snapshots.current(spark, str(tmp_path / "t"))
    assert back.note == {"by": "me"} and back.read(spark, "p").columns == ["n", "v", "m", "k"]
    assert sorted(map(str, back.read(spark, "j").collect())) == sorted(map(str, df.collect())) and back.read(spark, "e").count() == 0
    assert v.changed(spark) == []
    spark.range(0).write.mode("overwrite").parquet(v.path("e"))
    df.limit(1).write.mode("overwrite").json(v.path("j"))
    assert back.changed(spark) == ["j"]


def test_files_of_any_size_are_hashed_in_little_memory(spark, tmp_path):
    """A sparse file of 3 GB, in a process of its own whose peak memory is measured; and through Spark."""
    big = tmp_path / "big.csv"
    with big.open("wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    code = "import resource, sys; from barlume.sources.manifest import digest; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; print(digest(sys.argv[1])[1], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    out = subprocess.run([sys.executable, "-c", code, str(big)], capture_output=True, text=True, timeout=300, cwd=Path(__file__).parents[1])
    n, mb = map(int, out.stdout.split())
    assert n == 3 << 30 and mb < 200, out
    for i in range(9):
        (tmp_path / f"s{i}.csv").write_bytes(os.urandom(i * 1000))
    got = {r.name: (r.sha256, r.size_bytes) for r in manifest.file_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 10 and got["big.csv"][1] == 3 << 30
    assert all(got[f"s{i}.csv"] == (hashlib.sha256((tmp_path / f"s{i}.csv").read_bytes()).hexdigest(), i * 1000) for i in range(9))


def test_files_that_only_spark_reads_are_hashed_by_lines(spark, tmp_path):
    texts = {"a.csv": b"x\ny\n", "b.csv": b"x\ny", "c.csv": b"", "d.csv": b"\n", "e.csv": b"\r\n\n\xff\xfe z\r", "f.csv": b"line of text\n" * 50_000, "g.csv": b"one"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.name: r.sha256 for r in manifest.hashed(manifest.list_files(spark, str(tmp_path)), by_lines=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: hashlib.sha256(text).hexdigest() for name, text in texts.items()}
