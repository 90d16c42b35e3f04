"""Makes the package importable on executors that do not have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources once per application, unless workers inherit a path that has them."""
    inherited = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _done or any(p and Path(p).resolve() == ROOT for p in inherited):
        return
    _done.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-src-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)


def shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
