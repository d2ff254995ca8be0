"""Small files and folder names on any storage that Spark reaches, by its own file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    system, where = _system(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(where)) if system.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def stamp(spark: SparkSession, path: str) -> list:
    """Name, length and time of change of a file."""
    system, where = _system(spark, path)
    status = system.getFileStatus(where)
    return [path, status.getLen(), status.getModificationTime()]


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; false, and nothing written, where there is one."""
    system, where = _system(spark, path)
    try:
        out = system.create(where, False)
    except Py4JJavaError:
        if system.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    """A small file."""
    return "\n".join(row[0] for row in spark.read.text(path).collect())


def remove(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)
