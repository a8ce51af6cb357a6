"""Page snapshots as a stream: every micro-batch replaces the papers of its pages.

The sink holds the papers of the pages' revisions, in buckets of pages. A batch adds one
piece to each bucket of its pages, and then a commit that says which pieces a bucket has;
the commit appears by one rename. So a batch writes what it holds, one that stops half-way changes nothing, and
readers see one commit or the next. A bucket of more than ``PIECES`` pieces is folded into
one with the newest revisions alone. Readers take the newest revision of each page, so
an older snapshot can't undo a newer one. Each page has a marker row (node_pos null),
also when it has no paper, and a replayed batch gives the same table.

A stream with a delay is paced first (``pacing``): what is not newer than what its page
has seen is not even parsed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import extract_papers
from .pacing import pace

#: Of a new sink; choose more for a sink of very many pages, since a bucket is folded as a whole.
BUCKETS = 64
#: Pieces of a bucket that readers put together before it is folded.
PIECES = 16


def latest(snapshots: DataFrame, key: str = "page_id", revision: str = "revision") -> DataFrame:
    """Of each key the row with the greatest revision."""
    best = F.max_by(F.struct(*[F.col(c) for c in snapshots.columns]), F.col(revision)).alias("r")
    return snapshots.groupBy(F.col(key).alias("__k")).agg(best).select("r.*")


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _newest(spark: SparkSession, sink: str) -> tuple[int, dict]:
    """Number and content of the newest commit; 0 and an empty one before the first."""
    fs, log = _place(spark, f"{sink}/_log")
    numbers = [int(x.getPath().getName()) for x in fs.listStatus(log) if x.getPath().getName().isdigit()] if fs.exists(log) else []
    if not numbers:
        return 0, {"at": {}, "stale": []}
    stream = fs.open(_place(spark, f"{sink}/_log/{max(numbers)}")[1])
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, sink: str, number: int, content: dict) -> None:
    fs, ready = _place(spark, f"{sink}/_log/.{uuid.uuid4().hex}")
    out = fs.create(ready)
    out.write(json.dumps(content).encode())
    out.close()
    if not fs.rename(ready, _place(spark, f"{sink}/_log/{number}")[1]):
        raise RuntimeError(f"{sink}: commit {number} exists already")


def _pieces(state: dict, sink: str) -> list[str]:
    return [f"{sink}/{piece}" for pieces in state["at"].values() for piece in pieces]


def _newest_rows(rows: DataFrame) -> DataFrame:
    newest = rows.where("node_pos is null").groupBy("page_id").agg(F.max("revision").alias("revision"))
    return rows.join(newest, ["page_id", "revision"]).dropDuplicates(["page_id", "node_pos", "revision"])


def upsert(batch: DataFrame, sink: str, extract: Callable[[DataFrame], DataFrame] = extract_papers, buckets: int = BUCKETS) -> None:
    """Replace the rows of the pages in ``batch`` (page_id, url, html, revision)."""
    spark = batch.sparkSession
    number, state = _newest(spark, sink)
    buckets = state.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")
    version = f"{number + 1:09d}-{uuid.uuid4().hex}"
    put = lambda rows, folder: rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{sink}/{folder}")
    pages = latest(batch).persist()
    try:
        new = extract(pages).join(pages.select("page_id", "revision"), "page_id")
        put(new.unionByName(pages.select("page_id", "revision"), allowMissingColumns=True), version)
    finally:
        pages.unpersist()
    fs, where = _place(spark, f"{sink}/{version}")
    written = [x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName().startswith("bucket=")]
    if not written:
        fs.delete(where, True)
        return
    at = {**state["at"], **{(b := name.split("=")[1]): [*state["at"].get(b, []), f"{version}/{name}"] for name in written}}
    full, stale = [b for b, pieces in at.items() if len(pieces) > PIECES], []
    if full:
        stale = [piece for b in full for piece in at[b]]
        put(_newest_rows(spark.read.option("mergeSchema", "true").parquet(*[f"{sink}/{piece}" for piece in stale])), f"{version}-folded")
        at |= {b: [f"{version}-folded/bucket={b}"] for b in full}
    _commit(spark, sink, number + 1, {"buckets": buckets, "at": at, "stale": stale})
    for path in state["stale"]:  # readers of the commit before may still read what this one has replaced, but nothing older
        fs, where = _place(spark, f"{sink}/{path}")
        fs.delete(where, True)


def history(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of the newest commit: the newest revisions, markers included, and older ones of buckets not folded since."""
    pieces = _pieces(_newest(spark, sink)[1], sink)
    if not pieces:
        raise ValueError(f"{sink} has no commit")
    return spark.read.option("mergeSchema", "true").parquet(*pieces)


def snapshot(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of the latest revisions, markers included."""
    return _newest_rows(history(spark, sink))


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The papers of the latest revisions."""
    return snapshot(spark, sink).where("node_pos is not null")


def stream_pages(snapshots: DataFrame, sink: str, checkpoint: str, interval: str | None = None, extract=extract_papers, delay_ms: int | None = None, leading: bool = False) -> StreamingQuery:
    """Start the stream; without an interval it takes what is there and stops.

    With ``delay_ms`` snapshots are paced: 0 leaves out what is not newer, more lets
    changes wait (``leading``: but the first), which takes an interval.
    """
    if delay_ms and not interval:
        raise ValueError("changes that wait need an interval: the stream must be there when they are due")
    paced = snapshots if delay_ms is None else pace(snapshots, delay_ms, leading).drop("due")
    writer = paced.writeStream.foreachBatch(lambda batch, _: upsert(batch, sink, extract)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def conform_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a watermark; times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
