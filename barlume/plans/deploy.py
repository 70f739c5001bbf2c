"""Makes this package importable where Python workers run."""

from __future__ import annotations

import hashlib
import io
import os
import sys
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

import barlume

#: Contexts that have this package as it is loaded now.
_sent: set[str] = set()


def _zipped(root: str) -> bytes:
    """The package's sources; the zip itself where the package was loaded from one."""
    if os.path.isfile(root):
        with open(root, "rb") as f:
            return f.read()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(os.path.join(at, f) for at, _, files in os.walk(os.path.join(root, "barlume")) for f in files if f.endswith(".py")):
            z.write(name, os.path.relpath(name, root))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Workers get the package's folder on their path; those of executors in processes of their own the package itself, as a zip, once a context."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(barlume.__file__)))
    path = sc.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = root + (os.pathsep + path if path else "")
    if sc.master == "local" or sc.master.startswith("local["):
        return
    # Kept with the context, which may outlive this module: loaded anew, the package must neither send its zip again, which the
    # context refuses, nor take the first one away, which executors fetch when their first task starts. Queries may start in several threads.
    lock, held = vars(sc).setdefault("_barlume_zips", (threading.Lock(), {}))
    with lock:
        if sc.applicationId not in _sent:
            data = _zipped(root)
            name = hashlib.sha256(data).hexdigest()[:16] + "-barlume.zip"
            if name not in held:
                # one path for every process: TMPDIR may name a process's own folder
                folder = tempfile.TemporaryDirectory(prefix="barlume-", dir=os.path.realpath(tempfile.gettempdir()))
                _put(folder.name, name, data)
                sc.addPyFile(os.path.join(folder.name, name))
                held[name] = folder, data
                # Spark puts its copy on the driver's own path too, and removes the file with the context
                sys.path[:] = [p for p in sys.path if os.path.basename(p) != name]
            _sent.add(sc.applicationId)
        # The temp folder may be cleared while the context lives; executors that start later fetch all its zips, from where they lay.
        for name, (folder, data) in held.items():
            if not os.path.isfile(os.path.join(folder.name, name)):
                _put(folder.name, name, data)


def _put(folder: str, name: str, data: bytes) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{name}"), "wb") as f:
        f.write(data)
    os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
