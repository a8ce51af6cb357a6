from pyspark.sql import functions as F

from rankweave.streaming import pages


def heads(df):
    return df.where("html <> ''").select("page_id", F.lit(0).alias("node_pos"), F.col("html").alias("title"))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string, revision int")


def papers(spark, sink):
    return sorted((r.page_id, r.title, r.revision) for r in pages.current(spark, sink).collect())


def test_upsert_replaces_ignores_stale_and_replays(spark, tmp_path):
    sink = str(tmp_path / "sink")
    first = batch(spark, (1, "u", "a", 1), (2, "u", "b", 5), (1, "u", "a2", 2))
    pages.upsert(first, sink, heads)
    assert papers(spark, sink) == [(1, "a2", 2), (2, "b", 5)]
    pages.upsert(batch(spark, (2, "u", "old", 4), (1, "u", "", 3), (3, "u", "c", 1)), sink, heads)
    assert papers(spark, sink) == [(2, "b", 5), (3, "c", 1)]
    pages.upsert(first, sink, heads)
    assert papers(spark, sink) == [(2, "b", 5), (3, "c", 1)]


def test_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    batch(spark, (1, "u", "x", 1)).write.parquet(source)
    schema = "page_id long, url string, html string, revision int"
    for _ in range(2):
        pages.stream_pages(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "cp"), extract=heads).awaitTermination()
        batch(spark, (1, "u", "y", 2)).write.mode("append").parquet(source)
    assert papers(spark, sink) == [(1, "y", 2)]


def test_latest(spark):
    got = pages.latest(batch(spark, (1, "u", "a", 1), (1, "u", "b", 3), (2, None, None, 0)))
    assert sorted((r.page_id, r.html) for r in got.collect()) == [(1, "b"), (2, None)]


def test_a_batch_that_stops_changes_nothing(spark, tmp_path, monkeypatch):
    sink = str(tmp_path / "sink")
    pages.upsert(batch(spark, *[(k, "u", f"t{k}", 1) for k in range(20)]), sink, heads, buckets=3)
    before = papers(spark, sink)
    assert len(before) == 20

    def stopped(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(pages, "_commit", stopped)
        try:
            pages.upsert(batch(spark, (1, "u", "new", 2)), sink, heads)
        except OSError:
            pass
    assert papers(spark, sink) == before
    pages.upsert(batch(spark, (1, "u", "new", 2)), sink, heads)
    pages.upsert(batch(spark, (1, "u", "newer", 3)), sink, heads)
    assert papers(spark, sink) == sorted([*[x for x in before if x[0] != 1], (1, "newer", 3)])


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    """Many small batches over a wide table: no bucket is rewritten before it has PIECES pieces."""
    sink = str(tmp_path / "sink")
    wide = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("t"), "id").alias("html"), F.lit(1).alias("revision"))
    pages.upsert(wide, sink, heads, buckets=8)
    for k in range(4):
        pages.upsert(batch(spark, *[(10 * k + j, "u", f"new {k}", 2) for j in range(10)]), sink, heads)
    assert pages.history(spark, sink).count() == 2 * (20_000 + 40)  # papers and markers
    assert pages.snapshot(spark, sink).count() == 2 * 20_000
    assert pages.current(spark, sink).where("revision = 2").count() == 40


def test_a_bucket_of_many_pieces_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "PIECES", 3)
    sink = str(tmp_path / "sink")
    for k in range(6):
        pages.upsert(batch(spark, (1, "u", f"a{k}", k), (2, "u", f"b{k}", 10 - k)), sink, heads, buckets=1)
    assert papers(spark, sink) == [(1, "a5", 5), (2, "b0", 10)]
    assert pages.history(spark, sink).count() < 2 * 12
    pages.upsert(batch(spark), sink, heads)  # an empty batch makes no commit
    assert papers(spark, sink) == [(1, "a5", 5), (2, "b0", 10)]


def test_a_guarded_stream_does_not_parse_stale_snapshots(spark, tmp_path):
    source, sink, schema = str(tmp_path / "in"), str(tmp_path / "sink"), "page_id long, url string, html string, revision int"
    for rows in ([(1, "u", "x", 5), (1, "u", "w", 4), (2, "u", "p", 1)], [(1, "u", "old", 3), (2, "u", "q", 2)]):
        batch(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        pages.stream_pages(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "cp"), extract=heads, delay_ms=0).awaitTermination()
    assert sorted((r.page_id, r.title) for r in pages.history(spark, sink).where("node_pos is not null").collect()) == [(1, "x"), (2, "p"), (2, "q")]


def test_papers_and_names_are_dealt_among_tasks(spark, tmp_path):
    """Papers and venues of one partition are labelled by many tasks; what was written for that is deleted."""
    from pathlib import Path

    from rankweave import scratch
    from rankweave.operators.badges import DisplaySettings
    from rankweave.operators.matching import VenueIndex
    from rankweave.streaming import labels

    from .helpers import rank, venue, venues

    held = lambda: set(Path(scratch.folder(spark, "x").removeprefix("file://")).parent.glob("venue-owners-*"))
    base = venues(spark, *[venue(k, f"v{k}", f"Name {k}", ccf=rank("A")) for k in range(200)]).coalesce(1)
    papers = spark.range(200).selectExpr("id as page_id", "0 as node_pos", "concat('Name ', id) as venue_candidate", "false as source_truncated").coalesce(1)
    index, before = VenueIndex(base), held()
    rows = labels.labelled(papers, base, DisplaySettings(), index=index).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_id for r in rows) == list(range(200)) and len({r.task for r in rows}) > 4
    index.drop()
    assert labels.render(papers, base, str(tmp_path / "labels"), DisplaySettings()) and held() == before
    plan = index.keys._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    above, below = plan.split("REPARTITION_BY_NUM", 1)
    assert "lower(" in above and "lower(" not in below  # keys are made after names are dealt


def test_a_swap_labels_only_papers_whose_keys_changed(spark, tmp_path):
    from rankweave.operators.badges import DisplaySettings
    from rankweave.streaming import labels

    from .helpers import rank, venue, venues

    sink, shown = str(tmp_path / "labels"), DisplaySettings()
    papers = spark.createDataFrame([(1, 0, "Alpha", False), (2, 0, "Beta", False), (3, 0, "gm", None), (4, 0, None, False)], "page_id long, node_pos int, venue_candidate string, source_truncated boolean")
    old = venues(spark, venue(0, "a", "Alpha", ccf=rank("A")), venue(1, "b", "Beta", ccf=rank("A")), venue(2, "g", "Gamma", acronyms=["GM"], ccf=rank("C")))
    new = venues(spark, venue(5, "a", "Alpha", ccf=rank("A")), venue(1, "b", "Beta", ccf=rank("B")), venue(2, "g", "Gamma", ccf=rank("C")), venue(3, "d", "Delta"))
    assert labels.render(papers, old, sink, shown)
    keys = {(r.namespace, r.key) for r in labels.changed_keys(old, new).collect()}
    assert keys == {("name", "beta"), ("name", "gamma"), ("acronym", "gm"), ("name", "delta")}  # a place alone is no change
    assert labels.swap(old, new, sink, shown) and not labels.swap(old, new, sink, shown) and not labels.swap(new, new, sink, shown)
    got = {r.page_id: (r.written_by, "|".join(x.text for x in r.labels)) for r in labels.rendered(spark, sink).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 2, 3: 2, 4: 1} and "B" in got[2][1]
