"""What a cluster needs beside the session: this package on the executors, and a folder that all share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: they share no local folder with the driver."""
    context = spark.sparkContext
    if not getattr(context, "_quillspark_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="quillspark-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "quillspark"), "zip", os.path.dirname(package), os.path.basename(package)))
        context._quillspark_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share: that of spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return f"{base.rstrip('/')}/quillspark/{uuid.uuid4().hex}/{name}"


@contextmanager
def transient_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that write a table, which nothing reads but from its files: their shuffle files go with their end."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false"):
        yield


@contextmanager
def setting(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    """A setting of the session while jobs are planned and run in it; it has the default if none is set."""
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
