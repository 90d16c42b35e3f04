"""Folders that the driver and all executors see, and versioned tables in them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}  # application -> folder of a local session


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; a cluster must name one."""
    for value in (spark.conf.get(CHECKPOINT_KEY, ""), spark.sparkContext.getConf().get(CHECKPOINT_KEY, "")):
        if value and value != "<undefined>":
            return value.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def child_names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folders v0, v1, ... whose write has ended."""
    fs, _ = _file_system(spark, folder)
    names = [n for n in child_names(spark, folder) if n[:1] == "v" and n[1:].isdigit()]
    return sorted(int(n[1:]) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def listing_mark(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another mark, another state."""
    fs, root = _file_system(spark, path)
    marks, found = [], fs.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        marks.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(marks))
