"""Small files on the driver's side, in any store that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.active()


def _at(path: str):
    spark = _session()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    fs, where = _at(path)
    return fs.exists(where)


def read_bytes(path: str) -> bytes:
    """The file's content; FileNotFoundError if there is none."""
    fs, where = _at(path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(_session()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(path: str, content: bytes) -> None:
    """Put the content in place of the file at once: readers see the old or the new one."""
    spark = _session()
    fs, where = _at(path)
    ready = _at(f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(ready)
    try:
        out.write(content)
    finally:
        out.close()
    gateway, jvm = spark._sc._gateway, spark._jvm
    over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri = fs.makeQualified(where).toUri()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(ready), fs.makeQualified(where), over)


def delete(path: str) -> None:
    fs, where = _at(path)
    fs.delete(where, True)
