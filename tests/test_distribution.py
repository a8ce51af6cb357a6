import json
from datetime import UTC, datetime, timedelta

import pytest

from rankweave.sources import catalog, distribution

URL = "https://example.org/catalog/manifest.json"


@pytest.fixture
def published(spark, tmp_path):
    venues, _ = catalog.parse_catalog(spark, "name,ccf\nAlpha,A\nBeta,B")
    distribution.publish_catalog(venues, "2026.1", "Test", str(tmp_path), "2026-01-01T00:00:00Z")
    files = {URL: (tmp_path / "manifest.json").read_bytes(), "https://example.org/catalog/catalog.csv": (tmp_path / "catalog.csv").read_bytes()}
    return tmp_path, files


def test_publish_verify_fetch(spark, published):
    folder, files = published
    assert distribution.verify_folder(spark, str(folder)).recordCount == 2
    manifest, venues, warnings = distribution.fetch_catalog(spark, URL, files.__getitem__)
    assert manifest.dataUrl == "https://example.org/catalog/catalog.csv" and venues.count() == 2 and warnings.count() == 0
    assert distribution.fetch_first(spark, ["https://down.example.org/m.json", URL], files.__getitem__)[0] == manifest
    with pytest.raises(KeyError):
        distribution.fetch_first(spark, ["https://a.example.org/", "https://b.example.org/"], files.__getitem__)
    with pytest.raises(ValueError, match="version"):
        distribution.publish_catalog(venues, "bad version", "x", str(folder), "now")


@pytest.mark.parametrize(("change", "error"), [
    ({"schemaVersion": 2}, "格式版本"), ({"label": " "}, "label"), ({"generatedAt": "x"}, "有效日期"), ({"fileName": "a.txt"}, "结尾"), ({"dataUrl": "http://x.org/a.csv"}, "HTTPS"),
    ({"sha256": "zz"}, "64"), ({"byteLength": 0}, "byteLength"), ({"byteLength": 1.5}, "byteLength"), ({"recordCount": 30_001}, "recordCount"),
])
def test_manifest_checks(published, change, error):
    raw = json.loads(published[1][URL]) | change
    with pytest.raises(ValueError, match=error):
        distribution.parse_manifest(json.dumps(raw), URL)


@pytest.mark.parametrize(("change", "error"), [({"byteLength": 5}, "大小不一致"), ({"sha256": "0" * 64}, "SHA256"), ({"recordCount": 3}, "记录数不一致")])
def test_payload_checks(spark, published, change, error):
    files = published[1] | {URL: json.dumps(json.loads(published[1][URL]) | change).encode()}
    with pytest.raises(ValueError, match=error):
        distribution.fetch_catalog(spark, URL, files.__getitem__)
    with pytest.raises(ValueError, match="HTTPS"):
        distribution.fetch_catalog(spark, URL.replace("https", "http"), files.__getitem__)


def test_update_states(spark, published, tmp_path):
    files, now = published[1], datetime(2026, 1, 2, tzinfo=UTC)
    store = distribution.CatalogStore(str(tmp_path / "store"))
    run = lambda at=now, f=files, **more: distribution.update_catalog(spark, store, [URL], f.__getitem__, more.pop("enabled", True), at, **more)
    assert run(enabled=False) == "disabled" and store.load(spark) is None
    assert run() == "updated" and store.load(spark).count() == 2
    assert run(now + timedelta(hours=1)) == "current" and run(now + timedelta(hours=13)) == "current"
    with pytest.raises(KeyError):
        run(now + timedelta(hours=30), {})
    assert store.metadata()["lastError"] and store.load(spark).count() == 2

    def refuse(_):
        raise ValueError("conflict")

    changed = files | {URL: files[URL].replace(b"2026.1", b"2026.2")}
    with pytest.raises(ValueError, match="conflict"):
        run(now + timedelta(hours=60), changed, activate=refuse)
    assert store.metadata()["catalogVersion"] == "2026.1"
    assert run(now + timedelta(hours=90), changed) == "updated" and store.metadata()["catalogVersion"] == "2026.2"
    store.save(store.load(spark), source="manual")
    assert run(now + timedelta(hours=200)) == "protected" and run(now + timedelta(hours=200), changed, force=True) == "current"
    store.clear()
    assert store.load(spark) is None and distribution.elapsed_hours("x", now) == float("inf") and distribution.elapsed_hours((now + timedelta(1)).isoformat(), now) == 0
