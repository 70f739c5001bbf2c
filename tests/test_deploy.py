"""The package reaches executors of a cluster."""

from __future__ import annotations

import gc
import hashlib
import importlib.util
import os
import shutil
import subprocess
import sys
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__
from barlume.plans import deploy
from barlume.plans.deploy import ship
from tests.test_oracle import SF, plain


def test_zip_is_there_when_executors_fetch_it():
    """Executors fetch an added file when their first task starts, long after ``ship`` has returned."""
    added = []
    sc = SimpleNamespace(master="spark://host:7077", applicationId="app-of-test-deploy", environment={}, addPyFile=added.append)
    ship(SimpleNamespace(sparkContext=sc))
    ship(SimpleNamespace(sparkContext=sc))
    (name,) = added  # once a context
    with zipfile.ZipFile(name) as z:
        held = z.namelist()
    assert "barlume/plans/deploy.py" in held and "barlume/llm/simhash.py" in held


def test_threads_of_one_context_add_the_zip_once():
    """A context refuses a second file of the same name, so queries that start together must not each bring one."""
    added = []

    def add(name):
        time.sleep(0.05)
        added.append(name)

    sc = SimpleNamespace(master="spark://host:7077", applicationId="app-of-test-threads", environment={}, addPyFile=add)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(ship, [SimpleNamespace(sparkContext=sc)] * 8))
    assert len(added) == 1


FAR = """
from concurrent.futures import ThreadPoolExecutor
from pyspark.sql import SparkSession, functions as F
import __spark_entry__ as e

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf | {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
names = ["a1_latest_closed", "a2_last_window", "a4_forming_at", "a19_keep_days"]
with ThreadPoolExecutor(4) as pool:
    rows = list(pool.map(lambda n: e.queries()[n](spark, "/root/testdata/sf0.001").count(), names))

@F.udf
def where(x):
    import barlume
    return barlume.__file__

print("ROWS", *(n > 0 for n in rows), spark.range(2).select(where("id")).first()[0])
spark.stop()
"""


def test_executors_of_a_cluster_run_the_zip():
    """Executors in processes of their own fetch the package and import it from there, whichever query comes first."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", FAR], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    (said,) = [x for x in done.stdout.splitlines() if x.startswith("ROWS")] or [done.stderr[-2000:]]
    assert said.startswith("ROWS True True True True ") and "barlume.zip" in said, said


def test_package_loaded_anew_sends_no_second_zip():
    """A context outlives the module where a driver loads the package anew for a query: it keeps the first zip."""
    added = []
    sc = SimpleNamespace(master="spark://host:7077", applicationId="app-of-test-anew", environment={}, addPyFile=added.append)
    for _ in range(3):
        spec = importlib.util.spec_from_file_location("deploy_anew", deploy.__file__)
        anew = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(anew)
        anew.ship(SimpleNamespace(sparkContext=sc))
        del anew
        gc.collect()
    (name,) = added
    assert zipfile.is_zipfile(name)


def test_package_loaded_from_a_zip_is_sent_whole(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "some.zip").write_bytes(data := deploy._zipped(root))
    assert deploy._zipped(str(tmp_path / "some.zip")) == data == deploy._zipped(root)
    with zipfile.ZipFile(tmp_path / "some.zip") as z:
        assert "barlume/operators/bars.py" in z.namelist()


ANEW = """
import gc, sys
from pyspark.sql import SparkSession
from tests.test_deploy import SF, digest, fixed

conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf | {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
for name in sys.argv[1:]:
    for m in [m for m in sys.modules if m.split(".")[0] in ("barlume", "__spark_entry__", "corpus_pipeline")]:
        del sys.modules[m]
    gc.collect()
    import __spark_entry__ as e

    try:
        df = e.queries()[name](spark, SF)
        kept = fixed(df) if name not in e.oracle_sql() else df.columns
        said = digest(df.select(*sorted(kept)).collect())
    except Exception as x:
        said = repr(x)
    print("SAID", name, said)
spark.stop()
"""
#: Queries that each find the package loaded anew in one context of a cluster, after another query.
LOADED_ANEW: list[str] = [
    "a11_sma_cross",
    "a14_structure_levels",
    "a13_session_extremes",
    "a16_pyramid_view",
    "a16_downsample",
    "a18_viewport_index",
    "a18_stored_viewport",
    "a19_box_on_or_before",
    "a5_forming_bars",
    "a6_boundaries",
    "a7_history",
    "a8_clock_aligned",
    "a9_direction",
    "op7_simhash",
    "op11_whitening",
    "op12_rff_quality",
    "op13_vector_codes",
]


def fixed(df) -> list[str]:
    """Columns that no order of adding changes."""
    return [c for c, t in df.dtypes if t != "double" and c != "predicted"]


def digest(rows) -> str:
    return hashlib.sha256("\n".join(sorted(repr(tuple(map(plain, r))) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def loaded_anew() -> dict[str, str]:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", ANEW, "a17_extent", *LOADED_ANEW], cwd=root, env=env, capture_output=True, text=True, timeout=600)
    return dict(x.split(" ", 2)[1:] for x in done.stdout.splitlines() if x.startswith("SAID "))


@pytest.mark.parametrize("name", LOADED_ANEW)
def test_query_of_a_package_loaded_anew(spark, loaded_anew, name):
    """On a cluster, with the package loaded anew before each query, the results of SQL, or else of local threads."""
    if name in (known := __spark_entry__.oracle_sql()):
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
        said = c.sql(known[name])
        at = [said.columns.index(x) for x in sorted(said.columns)]
        assert loaded_anew[name] == digest([r[i] for i in at] for r in said.fetchall())
    else:
        df = __spark_entry__.queries()[name](spark, SF)
        assert loaded_anew[name] == digest(df.select(*sorted(fixed(df))).collect())


def test_zip_comes_back_where_the_temp_folder_was_cleared():
    """The next query puts the zip where the context serves it from, as executors that start later fetch it there."""
    added = []
    sc = SimpleNamespace(master="spark://host:7077", applicationId="app-of-test-cleared", environment={}, addPyFile=added.append)
    ship(SimpleNamespace(sparkContext=sc))
    with open(added[0], "rb") as f:
        before = f.read()
    shutil.rmtree(os.path.dirname(added[0]))
    ship(SimpleNamespace(sparkContext=sc))
    (name,) = added
    with open(name, "rb") as f:
        assert f.read() == before
    assert os.listdir(os.path.dirname(name)) == [os.path.basename(name)]


CLEARED = """
import glob, os, shutil, sys, tempfile, time
from pyspark.sql import SparkSession
import __spark_entry__ as e
from tests.test_deploy import SF, digest, fixed

conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "700m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf | {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://" + sys.argv[1]}).getOrCreate()
sc = spark.sparkContext._jsc.sc()
ids = lambda: set(sc.getExecutorIds().mkString(" ").split())
for k, name in enumerate(sys.argv[2:]):
    if k:
        for folder in glob.glob(tempfile.gettempdir() + "/barlume-*"):
            shutil.rmtree(folder)
        for x in (old := ids()):
            sc.killAndReplaceExecutor(x)
        until = time.time() + 60
        while (ids() & old or len(ids()) < len(old)) and time.time() < until:
            time.sleep(0.2)
        assert not ids() & old
    try:
        df = e.queries()[name](spark, SF)
        kept = fixed(df) if name not in e.oracle_sql() else df.columns
        said = digest(df.select(*sorted(kept)).collect())
    except Exception as x:
        said = repr(x)
    print("SAID", name, said)
spark.stop()
"""
#: Queries before each of which the temp folder is cleared and all executors are replaced.
AFTER_CLEARING: list[str] = ["op11_whitening", "op12_rff_quality", "a14_structure_levels", "a16_downsample", "a18_viewport_index", "a18_stored_viewport"]


@pytest.fixture(scope="module")
def cleared(tmp_path_factory) -> dict[str, str]:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path_factory.mktemp("own"))}
    shared = str(tmp_path_factory.mktemp("shared"))
    done = subprocess.run([sys.executable, "-c", CLEARED, shared, "a17_extent", *AFTER_CLEARING], cwd=root, env=env, capture_output=True, text=True, timeout=600)
    return dict(x.split(" ", 2)[1:] for x in done.stdout.splitlines() if x.startswith("SAID "))


@pytest.mark.parametrize("name", AFTER_CLEARING)
def test_query_after_the_temp_folder_was_cleared(spark, cleared, name):
    """On executors that started after the driver's temp folder was cleared, the results of SQL, or else of local threads."""
    assert cleared[name] == expected(spark, name)


def expected(spark, name: str) -> str:
    if name not in (known := __spark_entry__.oracle_sql()):
        df = __spark_entry__.queries()[name](spark, SF)
        return digest(df.select(*sorted(fixed(df))).collect())
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    c.execute(known[name])
    at = sorted(range(len(c.description)), key=lambda i: c.description[i][0])
    return digest([r[i] for i in at] for r in c.fetchall())
