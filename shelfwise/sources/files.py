"""Single small files and folders on whatever file system the session uses."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place))


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def wait_for(spark: SparkSession, path: str, seconds: float = 10.0) -> bool:
    """Wait until a file is there; False if it does not come (its writer was lost)."""
    until = time.monotonic() + seconds
    while not exists(spark, path):
        if time.monotonic() > until:
            return False
        time.sleep(0.05)
    return True


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that does not exist yet; False (and nothing written) where it does.

    Of several writers one succeeds, as far as the file system's own exclusive create goes. The
    content is written before the file gets its name, so readers see all of it or nothing.
    """
    files, place = _at(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{place.getParent()}/.{place.getName()}-{jvm.java.util.UUID.randomUUID()}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    lock = jvm.org.apache.hadoop.fs.Path(f"{place.getParent()}/.{place.getName()}.taken")
    try:
        files.create(lock, False).close()
    except Py4JJavaError as problem:
        files.delete(draft, False)
        if "FileAlreadyExists" not in str(problem.java_exception.getClass()):
            raise
        return False
    if not files.rename(draft, place):
        raise OSError(f"cannot write {path}")
    return True


def delete(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
