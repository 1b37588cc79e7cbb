"""Sessions, and the shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests, benches and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(PACKAGE.name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once a session; they need not see the folder it was imported from."""
    sc = spark.sparkContext
    name = f"{PACKAGE.name}.zip"
    if name not in sc._python_includes:
        folder = tempfile.mkdtemp()
        with zipfile.ZipFile(os.path.join(folder, name), "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(os.path.join(folder, name))  # served from where it lies, so it stays while the session lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return spark


def shipped(query):
    """The query, run after the workers have got this package."""

    def run(spark, sf_dir):
        return query(ship_package(spark), sf_dir)

    run.__name__, run.__doc__ = getattr(query, "__name__", "query"), query.__doc__
    return run
