"""Folders that all executors share, and small sets of files written there by the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``spark.checkpoint.dir``; where that is unset, of this machine if all runs in one process on it, else in the warehouse.

    It goes when the driver's JVM ends.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        root = tempfile.mkdtemp(prefix="lodestone-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone"
        spark.conf.set(CHECKPOINT_DIR, root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_files(spark: SparkSession, folder: str, files: dict[str, str | bytes]) -> str:
    """Write a few small files by their paths below ``folder``, on any file system that Spark writes to."""
    for name, content in files.items():
        fs, at = _file_system(spark, f"{folder}/{name}")
        out = fs.create(at, True)
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
        out.close()
    return folder
