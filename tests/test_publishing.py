import json

import pytest

from rankweave.operators import merging
from rankweave.operators.badges import DisplaySettings
from rankweave.sources import catalog, distribution, files
from rankweave.sources.settings import Settings, load_settings, save_settings, size_text, time_text
from rankweave.streaming import labels

from .helpers import label, rank, venue, venues


def test_settings(spark, tmp_path):
    at = f"{tmp_path}/settings.json"
    assert load_settings(at) == Settings() == Settings(True, False, DisplaySettings())
    save_settings(at, Settings(False, True, DisplaySettings(["ccf"], False, ["X"])))
    assert load_settings(at) == Settings(False, True, DisplaySettings(["ccf"], False, ["X"]))
    files.write_bytes(at, b'{"enabled": null, "labelDisplay": 3}')
    assert load_settings(at) == Settings()
    files.write_bytes(at, b"{")
    assert load_settings(at) == Settings()
    assert [size_text(n) for n in (0, 1023, 1024, 1536, 3 << 20)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "3.0 MB"]
    assert time_text(None) == "—" and time_text("x") == "x" and time_text("2026-01-02T03:04:05") == "2026年1月2日 03:04"


def test_warnings_that_are_told(spark):
    some = spark.range(23).selectExpr("cast(id as int) as pos", "concat('w', id) as warning")
    assert distribution.told_warnings(some) == [*(f"w{k}" for k in range(20)), "另有 3 条警告未显示。"]
    assert distribution.told_warnings(some.limit(0)) == []
    with pytest.raises(ValueError, match="来源存在 23 条解析警告：w0；w1；w2"):
        merging.expect_no_warnings("来源", some)
    merging.expect_no_warnings("来源", some.limit(0))


def test_management_source(spark):
    one = lambda k, r, **more: venue(k, f"m{k}", f"M {k}", labels=[label("cast-tier", f"管理科学 {r}（2025总汇）"), label("note", "x")], **more)
    expected = {"A": 2, "B": 1}
    merging.check_management(venues(spark, one(0, "A"), one(1, "B"), one(2, "A")), expected)
    for rows, error in (
        ([one(0, "A")], "应为 3 条，实际为 1 条"),
        ([one(0, "A"), one(1, "B", kind="conference"), one(2, "A")], "M 1”不是期刊"),
        ([one(0, "A"), one(1, "B"), venue(2, "m2", "M 2")], "M 2”必须只有一个"),
        ([one(0, "A"), one(1, "A"), one(2, "A")], "FMS A 应为 2 条，实际为 3 条"),
    ):
        with pytest.raises(ValueError, match=error):
            merging.check_management(venues(spark, *rows), expected)


def test_core_form(spark, tmp_path):
    v = venues(spark, venue(0, "a", 'A "x"', aliases=["b", "c"], ccf=rank("A", edition="七")), venue(1, "k", "K", "conference", school=rank("B", "S", "2026")))
    told = distribution.publish_core(v, str(tmp_path))
    text = (tmp_path / "public-catalog.csv").read_text()
    assert text.split("\n")[1:] == ['"A ""x""",journal,b|c,,,A,七,,,', "K,conference,,,,,,B,S,2026"]
    assert json.loads((tmp_path / "manifest.json").read_text())["dataUrl"] == "./public-catalog.csv?v=2026-core.1" and told.recordCount == 2


def test_labels_are_written_where_they_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(labels, "PARTS", 1)
    sink, shown = f"file://{tmp_path}/labels", DisplaySettings(["source"])
    papers = spark.createDataFrame([(1, 0, "A", False), (1, 1, "B", False), (2, 0, None, False)], "page_id long, node_pos int, venue_candidate string, source_truncated boolean")
    dim = lambda b: venues(spark, venue(0, "a", "A", ccf=rank("A")), venue(1, "b", "B", ccf=rank(b)))
    with pytest.raises(ValueError, match="no commit"):
        labels.rendered(spark, sink)
    assert labels.render(papers, dim("A"), sink, shown) and not labels.render(papers, dim("A"), sink, shown)
    assert labels.render(papers, dim("C"), sink, shown)  # two parts become one
    got = {(r.page_id, r.node_pos): (r.written_by, [x.text for x in r.labels]) for r in labels.rendered(spark, sink).collect()}
    assert got == {(1, 0): (1, ["CCF-A 类推荐"]), (1, 1): (2, ["CCF-C 类推荐"]), (2, 0): (1, [])}


def test_download_has_a_mark(spark, tmp_path):
    v = venues(spark, venue(0, "a", "A", ccf=rank("A")))
    catalog.write_catalog(v, f"{tmp_path}/x.csv", bom=True)
    catalog.write_catalog(v, f"{tmp_path}/x.csv")
    assert not (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_more_rows_than_a_file_may_have_are_published_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MAX_RECORDS", 4)
    base = venues(spark, *[venue(k, f"b{k}", f"Base {k}", ccf=rank("B")) for k in range(9)])
    with pytest.raises(ValueError, match="最多允许 4 条"):
        distribution.publish_source(spark, "name,ccf\nNew,A", "s.csv", base, "1", "x", f"{tmp_path}/one", "2026-01-01T00:00:00Z")
    made, n, _ = distribution.publish_source_parts(spark, "name,ccf\nNew,A\nbase 3,A", "s.csv", base, "1", "x", f"{tmp_path}/p", "2026-01-01T00:00:00Z")
    assert [m.recordCount for m in made] == [4, 4, 2] and n == 2
    told = distribution.verify_catalog_parts(spark, f"{tmp_path}/p", base)
    assert (told["records"], told["activeRecords"], told["warnings"]) == (10, 10, 0)
    read = distribution.read_published(f"{tmp_path}/p", "https://h.org/c/")
    _, got, _ = distribution.fetch_parts(spark, "https://h.org/c/parts.json", read)
    rows = got.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(10)) and [r.canonical_name for r in rows] == [*(f"Base {k}" for k in range(9)), "New"] and rows[3].aliases == []
    files.write_bytes(f"{tmp_path}/p/part-1/public-catalog.csv", b"x")
    with pytest.raises(ValueError, match="大小不一致"):
        distribution.verify_catalog_parts(spark, f"{tmp_path}/p", base)
