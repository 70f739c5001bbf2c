"""Every query with SQL of the same meaning against DuckDB; the others must run."""

import datetime
import decimal
import os

import duckdb
import pytest

from barlume.plans import catalogue

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.date) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalogue.ORACLE:
        return
    said = duck.sql(catalogue.ORACLE[name])
    assert sorted(said.columns) == columns
    kinds = dict(zip(said.columns, map(str, said.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    at = [said.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in said.fetchall())


#: run -> (day, profit) of its trades, as many as the third number
RISK = {
    "rises": [(d, n, 1) for d in range(40) for n in (5000 + d, -1000, 900)],
    "no_drawdown": [(d, 1000 + d, 1) for d in range(35)],
    "no_profit": [(d, 0, 1) for d in range(40)],
    "falls": [(d, -700 - d, 1) for d in range(40)],
    "one_gain": [(0, 500, 1)],
    "one_loss": [(0, -500, 1)],
    "one_zero": [(0, 0, 1)],
    "to_zero": [(0, -8000, 1250), *((d, 1000 if d % 2 else -700, 1) for d in range(1, 40))],
    "below_zero": [(0, -8000, 1250), *((d, -100 - d, 1) for d in range(1, 40))],
}


def test_risk_of_runs_without_losing_days(spark, tmp_path):
    """Ratios to nothing are infinite or NaN in the SQL of ``g6_risk``, for one day too; runs that only rise are such at scale."""
    start, hours, rows = datetime.datetime(1995, 1, 1), {}, []
    for run, trades in RISK.items():
        for day, net, times in trades:
            hour = hours[run, day] = hours.get((run, day), -1) + 1
            rows += [((len(rows) + i) * 96 + hour, (net + 9000) / 100, start + datetime.timedelta(day), run) for i in range(times)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalogue.QUERIES["g6_risk"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got, said = {r.symbol: tuple(map(plain, r)) for r in df.collect()}, c.sql(f"select {', '.join(df.columns)} from ({catalogue.ORACLE['g6_risk']})").fetchall()
    assert got == {r[df.columns.index("symbol")]: tuple(map(plain, r)) for r in said} and got.keys() == RISK.keys()
    assert got["rises"][df.columns.index("sortino")] == got["no_drawdown"][df.columns.index("calmar")] == "inf"
