"""When a changed page is parsed: keyed state of page and revision, with timers.

A page that changes often is parsed once its changes have paused (``trailing``), or at
once and then at most once a delay (``leading``), so that a page that never rests is parsed too.
A snapshot that is not newer than what its page has seen changes nothing and goes no
further. The state of a page is the revision parsed last and at most one snapshot that waits.

Live streams use processing time. A replayed stream uses the time each change bears: the
watermark fires the timers, and the result does not depend on how changes fell into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import reach

#: How long changes wait, in milliseconds.
RESULT_LIST_DELAY, CATALOG_PAGE_DELAY, OTHER_SITE_DELAY = 120, 150, 150

PAGE = "page_id long, url string, html string, revision long"
PARSE = f"{PAGE}, due timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pacer(StatefulProcessor):
    """Per page: (revision seen last) and (due, changed, revision, url, html) of the snapshot that waits."""

    def __init__(self, delay_ms: int, leading: bool, replayed: bool) -> None:
        self.delay, self.leading, self.replayed = delay_ms, leading, replayed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "revision long")
        self.waiting = handle.getValueState("waiting", "due long, changed long, revision long, url string, html string")

    def _parse(self, key: tuple, waits: tuple, due: int) -> Row:
        _, _, revision, url, html = waits
        return Row(page_id=key[0], url=url, html=html, revision=revision, due=due)

    def _changes(self, rows: Iterator[Row], now: int) -> list[tuple]:
        """(changed, revision, url, html) in order; live, where all come at one time, the newest alone."""
        if self.replayed:
            return sorted((r.changed, r.revision, r.url, r.html) for r in rows)
        newest = max(rows, key=lambda r: r.revision, default=None)
        return [] if newest is None else [(now, newest.revision, newest.url, newest.html)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else None
        waits = self.waiting.get() if self.waiting.exists() else None
        armed = waits[0] if waits else None
        newest = waits[2] if waits else seen
        for changed, revision, url, html in self._changes(rows, timerValues.getCurrentProcessingTimeInMs() if self.delay else 0):
            if newest is not None and revision <= newest:
                continue
            newest = revision
            if waits and waits[0] <= changed:
                yield self._parse(key, waits, waits[0])
                seen, waits = waits[2], None
            if not self.delay or self.leading and seen is None and not waits:
                yield self._parse(key, (0, changed, revision, url, html), changed)
                seen = revision
                continue
            due = waits[0] if waits and self.leading else changed + self.delay
            waits = (due, changed, revision, url, html)
        if seen is not None:
            self.seen.update((seen,))
        if waits:
            self.waiting.update(waits)
        elif self.waiting.exists():
            self.waiting.clear()
        if armed != (waits[0] if waits else None):
            if armed is not None:
                self.handle.deleteTimer(armed)
            if waits:
                self.handle.registerTimer(waits[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        waits = self.waiting.get() if self.waiting.exists() else None
        if waits and waits[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.update((waits[2],))
            self.waiting.clear()
            yield self._parse(key, waits, waits[0])

    def close(self) -> None:
        pass


def configure(spark: SparkSession) -> None:
    """Timers need a state store that holds them."""
    reach(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def pace(changes: DataFrame, delay_ms: int, leading: bool = False, replayed: bool = False, late: str = "0 seconds") -> DataFrame:
    """The snapshots to parse, with the time at which they were ``due``, of a stream of changes (page_id, url, html, revision).

    Without a delay a snapshot newer than its page's last is parsed at once.
    ``replayed`` streams also have ``ts``, the time of the change, which is read to the
    millisecond; changes more than ``late`` behind the newest are left out. Changes
    without a page_id or revision are left out.
    """
    configure(changes.sparkSession)
    known = changes.where("page_id is not null and revision is not null")
    columns = [F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("revision").cast("long").alias("revision")]
    if replayed:
        known = known.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", late)
        columns += [F.unix_millis("ts").alias("changed"), "ts"]
    parsed = known.select(*columns).groupBy("page_id").transformWithState(
        Pacer(delay_ms, leading, replayed), f"{PAGE}, due long", "append", "EventTime" if replayed else "ProcessingTime" if delay_ms else "None")
    return parsed.withColumn("due", F.timestamp_millis("due") if delay_ms or replayed else F.current_timestamp())
