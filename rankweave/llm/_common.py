"""Shared plumbing: written intermediate tables, session settings, word rules."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .. import reach

#: Bounds the memory of one Arrow batch; texts stay whole, only rows per batch shrink.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
#: Row groups of intermediate tables: a writer holds one in memory.
ROW_GROUP_BYTES = 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}
#: Tables that the run at hand has written, where a run collects them.
_made: ContextVar[list | None] = ContextVar("made", default=None)


def configure(spark: SparkSession) -> None:
    """Set Arrow batch bounds for the session (results do not depend on them)."""
    reach(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in this process alone (local tests) a
    temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rankweave-")
    return _own_dirs[app]


@contextmanager
def _shuffles_removed_after(spark: SparkSession):
    """Shuffle files of the statements inside go as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, so that
    a lost executor costs only its own tasks and later passes see the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with _shuffles_removed_after(spark):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*staged: DataFrame) -> None:
    """Delete intermediate tables that nothing still to run reads."""
    for df in staged:
        _delete(df.sparkSession, df.staged_at)


@contextmanager
def collected(spark: SparkSession, keep: str):
    """Delete, at the end, the intermediate tables written inside, but for those whose label is ``keep``.

    Tables belong to the block that wrote them, so runs side by side don't meet.
    """
    token = _made.set([])
    try:
        yield
        for path in _made.get():
            if not path.rsplit("/", 1)[1].startswith(f"{keep}-"):
                _delete(spark, path)
    finally:
        _made.reset(token)
