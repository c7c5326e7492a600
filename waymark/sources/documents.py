"""Small documents of the driver on any file system that Spark reaches: manifests, metrics, reports, configurations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(spark: SparkSession | None = None) -> SparkSession:
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise ValueError("documents are read and written through a Spark session, and none is active")
    return found


def place(path: str, spark: SparkSession | None = None):
    """(file system, path) of a URI; a path without a scheme is one of the session's default file system, as it is for its readers."""
    s = session(spark)
    where = s._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(s._jsparkSession.sessionState().newHadoopConf()), where


def exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, where = place(path, spark)
    return fs.exists(where)


def read(path: str, spark: SparkSession | None = None) -> str:
    """The text of a document in UTF-8; none there is an error."""
    fs, where = place(path, spark)
    stream = fs.open(where)
    try:
        return session(spark)._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Writes a document in UTF-8 beside its place and renames it there, so that readers see the old one or the new one whole."""
    fs, where = place(path, spark)
    parent = where.getParent()
    if parent is not None:
        fs.mkdirs(parent)
    beside = session(spark)._jvm.org.apache.hadoop.fs.Path(parent, f".{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"can't put a document at {path}")
