"""Small files beside the tables: present, listed, published in one step, removed.

Spark's readers and writers do the work on data; these few calls go to the file
system of a path through Hadoop, so they hold on every store that Spark reads.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    system, target = _system(spark, path)
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target))


def remove(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, target = _system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with ``text``: there in full or not at all; False if the name is taken.

    It is written under another name and renamed, and the rename refuses to replace.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    system, draft = _system(spark, f"{parent}/_draft-{name}-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(draft, fs.Path(path), plain)
    except Py4JJavaError as problem:
        system.delete(draft, False)
        if problem.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True
