"""Shared plumbing: scratch tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete_folder, new_folder

#: Lets Spark delete a query's shuffle files when the query has ended; a written table needs them no more.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The ASCII white space of the text contracts: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


class Scratch:
    """Parquet tables under one new folder of the shared directory.

    ``put`` writes a table and reads it back, which cuts lineage and survives lost executors.
    ``drop`` removes tables that later steps do not read any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self.count = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP_KEY)
        self.spark.conf.set(CLEANUP_KEY, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP_KEY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete_folder(self.spark, df._scratch_path)


def release_memory() -> None:
    """At the end of a Python task: gives freed memory back to the system, as idle workers stay alive beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def strip_ascii_space(text: Column) -> Column:
    """``text`` without any character of ``[\\x20\\x09-\\x0D]``."""
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
