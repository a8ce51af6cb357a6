"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs its own tasks, and what is read
again is what was written, not computed anew.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources import files

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only in a local session that names none, below a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="rankweave-core-")
        shared = _own[app]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back."""
    path, schema = folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing still to run reads."""
    for table in tables:
        files.delete(table.written_at)


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt that cost much more than their bytes tell."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
