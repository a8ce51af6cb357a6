"""Trailing and leading pace of page changes: replayed and live."""

import random
import time
from collections import defaultdict

import pytest

from rankweave.streaming import pacing

CHANGES = "page_id long, url string, html string, revision long, ts timestamp"
EPOCH = 1_700_000_000_000


def _plain(changes, delay, leading):
    """(page, revision, due) of changes (page, revision, ms) that follow their clock."""
    out, pages = set(), defaultdict(list)
    for page, revision, at in changes:
        pages[page].append((at, revision))
    for page, own in pages.items():
        newest, waits, begun = None, None, False
        for at, revision in sorted(own):
            if newest is not None and revision <= newest:
                continue
            newest = revision
            if waits and waits[0] <= at:
                out.add((page, waits[1], waits[0]))
                waits = None
            if leading and not begun:
                out.add((page, revision, at))
            else:
                waits = (waits[0] if waits and leading else at + delay, revision)
            begun = True
        if waits:
            out.add((page, waits[1], waits[0]))
    return out


def _rows(spark, changes):
    from datetime import datetime, timezone

    return spark.createDataFrame([(p, f"u{p}", f"h{r}", r, datetime.fromtimestamp((EPOCH + at) / 1000, timezone.utc)) for p, r, at in changes], CHANGES)


def _replay(spark, folder, batches, delay, leading):
    """The parses of a stream that comes in ``batches``, closed by a change much later."""
    source, sink, cp = f"{folder}/in", f"{folder}/out", f"{folder}/cp"
    for k, batch in enumerate([*batches, [(-1, 1, 10**9)]]):
        _rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = pacing.pace(spark.readStream.schema(CHANGES).parquet(source), delay, leading, replayed=True, late="1 hour")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r.page_id, r.revision, int(r.due.timestamp() * 1000 + 0.5) - EPOCH, r.url, r.html) for r in spark.read.parquet(sink).where("page_id >= 0").collect()]
    assert len(got) == len(set(got)) and all(u == f"u{p}" and h == f"h{r}" for p, r, _, u, h in got)
    return {g[:3] for g in got}


def test_three_changes_within_the_delay_are_one_parse(spark, tmp_path):
    batches = [[(1, 1, 0), (1, 2, 50)], [(1, 3, 110)], [(2, 1, 0)]]
    assert _replay(spark, tmp_path, batches, pacing.RESULT_LIST_DELAY, False) == {(1, 3, 230), (2, 1, 120)}


def test_a_page_that_never_rests_is_parsed_too(spark, tmp_path):
    changes = [(1, k + 1, 60 * k) for k in range(11)]
    got = _replay(spark, tmp_path, [changes[:5], changes[5:]], pacing.OTHER_SITE_DELAY, True)
    assert got == {(1, 1, 0), (1, 4, 210), (1, 7, 390), (1, 10, 570), (1, 11, 750)} == _plain(changes, 150, True)


@pytest.mark.parametrize("leading", [False, True])
def test_replay_does_not_depend_on_batches(spark, tmp_path, leading):
    rng = random.Random(leading)
    changes = [(rng.randrange(6), rng.randrange(400), at) for at in rng.sample(range(6000), 150)]
    by_time = sorted(changes, key=lambda c: c[2])
    want = _plain(changes, 120, leading)
    shuffled = rng.sample(by_time, len(by_time))
    assert _replay(spark, tmp_path / "one", [shuffled], 120, leading) == want
    assert _replay(spark, tmp_path / "three", [by_time[:40], by_time[40:90], by_time[90:]], 120, leading) == want


def test_live_changes_of_one_delay_are_one_parse_and_stale_ones_none(spark, tmp_path):
    source, sink, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put = lambda *rows: _rows(spark, rows).coalesce(1).write.mode("append").parquet(source)
    put((1, 5, 0), (1, 6, 0), (1, 7, 0), (2, 1, 0))
    stream = pacing.pace(spark.readStream.schema(CHANGES).parquet(source), pacing.RESULT_LIST_DELAY)
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", cp).trigger(processingTime="100 milliseconds").start()
    try:
        parsed = lambda: sorted((r.page_id, r.revision, r.html) for r in spark.read.schema(pacing.PARSE).parquet(sink).collect())
        _wait(lambda: len(parsed()) == 2)
        put((1, 7, 0), (1, 2, 0))  # nothing newer
        put((2, 3, 0))
        _wait(lambda: len(parsed()) == 3)
        assert parsed() == [(1, 7, "h7"), (2, 1, "h1"), (2, 3, "h3")]
    finally:
        query.stop()


def _wait(true, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        try:
            if true():
                return
        except Exception:  # noqa: BLE001  nothing written yet
            pass
        time.sleep(0.3)
    raise AssertionError("not in time")
