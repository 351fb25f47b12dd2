"""What driver and executors share: this package, sent to executors that cannot import it by themselves, and a folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Adds the package to the Python path of the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    top = Path(__file__).resolve().parent
    if not top.is_dir():  # imported from an archive that was sent already
        return
    fd, name = tempfile.mkstemp(prefix="textsieve-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    atexit.register(lambda: os.path.exists(name) and os.remove(name))
    spark.sparkContext.addPyFile(name)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="textsieve-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"
