"""Catalog distribution: verified download, publishing, and the update state machine."""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merging import activate as activate_catalog
from ..operators.merging import merge_catalogs
from ..schema import MAX_FILE_BYTES, MAX_RECORDS
from ..scratch import written
from . import files
from .catalog import parse_catalog, serialize_catalog, serialize_core, serialize_files, warnings_of

Fetcher = Callable[[str], bytes]
SCHEMA_VERSION = 1
MAX_MANIFEST_BYTES = 100 * 1024
CHECK_HOURS = 12
VERSION = re.compile("[0-9A-Za-z][0-9A-Za-z._-]{0,79}")
WARNINGS_TOLD = 20
# Fixed values of the public and the core catalog.
PUBLIC_NAME = "public-catalog.csv"
PARTS_NAME = "parts.json"
CORE_VERSION, CORE_MADE = "2026-core.1", "2026-09-01T13:30:00.000Z"
CORE_LABEL = "CCF 第七版 + 云南财经大学 2026 公开核心目录"


@dataclass(frozen=True)
class Manifest:
    schemaVersion: int  # noqa: N815  the names of the file
    catalogVersion: str  # noqa: N815
    label: str
    generatedAt: str  # noqa: N815
    dataUrl: str  # noqa: N815
    fileName: str  # noqa: N815
    sha256: str
    byteLength: int  # noqa: N815
    recordCount: int  # noqa: N815


def require_https(value: str, label: str) -> str:
    parts = urlsplit(value)
    if not parts.scheme or not parts.netloc:
        raise ValueError(f"{label}无效。")
    if parts.scheme != "https":
        raise ValueError(f"{label}必须使用 HTTPS。")
    return value


def _when(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    except ValueError:
        return None


def parse_manifest(text: str, url: str) -> Manifest:
    """Checks in order; the first that fails raises."""
    try:
        raw = json.loads(text.removeprefix("﻿"))
    except ValueError:
        raise ValueError("在线目录清单不是有效的 JSON。") from None
    if not isinstance(raw, dict):
        raise ValueError("在线目录清单必须是 JSON 对象。")
    if raw.get("schemaVersion") != SCHEMA_VERSION or isinstance(raw["schemaVersion"], bool):
        raise ValueError(f"不支持的在线目录格式版本：{raw.get('schemaVersion')}。")

    def words(name: str) -> str:
        if not isinstance(v := raw.get(name), str) or not v.strip():
            raise ValueError(f"在线目录清单缺少 {name}。")
        return v.strip()

    def count(name: str, most: int) -> int:
        v = raw.get(name)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or not 1 <= v <= most:
            raise ValueError(f"在线目录清单 {name} 必须是 1–{most} 的整数。")
        return int(v)

    version, label, made = words("catalogVersion"), words("label"), words("generatedAt")
    if _when(made) is None:
        raise ValueError("在线目录清单 generatedAt 必须是有效日期。")
    name = words("fileName")
    if not re.search(r"\.(?:csv|tsv|json)$", name, re.I):
        raise ValueError("在线目录文件名必须以 .csv、.tsv 或 .json 结尾。")
    data = require_https(urljoin(url, words("dataUrl")), "在线目录数据地址")
    digest = words("sha256").lower()
    if not re.fullmatch("[a-f0-9]{64}", digest):
        raise ValueError("在线目录清单 sha256 必须是 64 位十六进制字符串。")
    return Manifest(SCHEMA_VERSION, version, label, made, data, name, digest, count("byteLength", MAX_FILE_BYTES), count("recordCount", MAX_RECORDS))


def verify_payload(spark: SparkSession, manifest: Manifest, content: bytes) -> tuple[DataFrame, DataFrame]:
    """(venues, warnings) if size, digest and record count are those of the manifest."""
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("在线目录超过 15 MB 限制。")
    if len(content) != manifest.byteLength:
        raise ValueError(f"在线目录大小不一致：清单为 {manifest.byteLength} 字节，实际为 {len(content)} 字节。")
    if hashlib.sha256(content).hexdigest() != manifest.sha256:
        raise ValueError("在线目录 SHA256 校验失败，已拒绝更新。")
    venues, warnings = parse_catalog(spark, content.decode("utf-8", "replace"), manifest.fileName)
    if (n := venues.count()) != manifest.recordCount:
        raise ValueError(f"在线目录记录数不一致：清单为 {manifest.recordCount} 条，实际为 {n} 条。")
    return venues, warnings


def fetch_catalog(spark: SparkSession, url: str, fetch: Fetcher) -> tuple[Manifest, DataFrame, DataFrame]:
    """Manifest and verified catalog; ``fetch`` runs on the driver and raises on failure."""
    text = fetch(require_https(url, "在线目录清单地址"))
    if len(text) > MAX_MANIFEST_BYTES:
        raise ValueError("在线目录清单超过 100 KB，已拒绝读取。")
    manifest = parse_manifest(text.decode("utf-8"), url)
    return (manifest, *verify_payload(spark, manifest, fetch(manifest.dataUrl)))


def fetch_parts(spark: SparkSession, url: str, fetch: Fetcher) -> tuple[list[Manifest], DataFrame, DataFrame]:
    """Manifests, venues and warnings of a catalog in parts, each verified as a catalog; ``pos`` goes on from part to part.

    ``url`` names the list of manifests. A part is written before the next is fetched, so
    the driver holds one at a time.
    """
    raw = fetch(require_https(url, "在线目录清单地址"))
    if len(raw) > MAX_MANIFEST_BYTES:
        raise ValueError("在线目录清单超过 100 KB，已拒绝读取。")
    told = json.loads(raw)
    manifests, venues, warnings, before = [], None, None, 0
    for at in told["manifests"]:
        manifest, part, _ = fetch_catalog(spark, urljoin(url, at), fetch)
        if manifest.catalogVersion != told["catalogVersion"]:
            raise ValueError(f"在线目录版本不一致：清单为 {told['catalogVersion']}，实际为 {manifest.catalogVersion}。")
        part = written(part, "catalog-part")
        bare = warnings_of(part)
        part = part.withColumn("pos", F.col("pos") + before)
        venues, warnings = (part, bare) if venues is None else (venues.unionByName(part), warnings.unionByName(bare))
        manifests.append(manifest)
        before += manifest.recordCount
    if venues is None:
        raise ValueError("目录中没有可导入的数据行。")
    return manifests, venues, warnings


def fetch_first(spark: SparkSession, urls: Iterable[str], fetch: Fetcher, read: Callable = fetch_catalog) -> tuple:
    """What ``read`` gives of the first mirror that works; else the last error."""
    last: Exception = ValueError("no mirror")
    for url in urls:
        try:
            return read(spark, url, fetch)
        except Exception as e:  # noqa: BLE001  the next mirror may do
            last = e
    raise last


def _publish(content: str, records: int, version: str, label: str, folder: str, made: str, name: str, url: str) -> Manifest:
    if not VERSION.fullmatch(version):
        raise ValueError("catalog version is not valid")
    raw = content.encode("utf-8")
    manifest = Manifest(SCHEMA_VERSION, version, label, made, url, name, hashlib.sha256(raw).hexdigest(), len(raw), records)
    files.write_bytes(f"{folder}/{name}", raw)
    files.write_bytes(f"{folder}/manifest.json", (json.dumps(asdict(manifest), ensure_ascii=False, indent=2) + "\n").encode())
    return manifest


def publish_catalog(venues: DataFrame, version: str, label: str, folder: str, made: str, name: str = "catalog.csv") -> Manifest:
    """Write the catalog and its manifest."""
    return _publish(serialize_catalog(venues), venues.count(), version, label, folder, made, name, name)


def publish_source(spark: SparkSession, text: str, file_name: str, base: DataFrame, version: str, label: str, folder: str, made: str,
                   name: str = PUBLIC_NAME) -> tuple[Manifest, int, list[str]]:
    """Parse a catalog's text, merge it into ``base``, and publish the outcome.

    Returns the manifest, the number of source records, and the warnings to tell: the
    first ``WARNINGS_TOLD`` and one line about the rest.
    """
    imported, warnings = parse_catalog(spark, text, file_name)
    records = merge_catalogs(imported, base)
    manifest = _publish(serialize_catalog(records), records.count(), version, label, folder, made, name, f"./{name}?v={quote(version, safe='')}")
    return manifest, imported.count(), told_warnings(warnings)


def publish_source_parts(spark: SparkSession, text: str, file_name: str, base: DataFrame, version: str, label: str, folder: str, made: str,
                         name: str = PUBLIC_NAME) -> tuple[list[Manifest], int, list[str]]:
    """``publish_source`` of any number of records: as many files as they need within the format's rules.

    Each is a published folder, ``part-0`` and so on; their list is written last, so
    readers see all of them or none.
    """
    imported, warnings = parse_catalog(spark, text, file_name)
    parts, manifests = [], []
    for content, records in serialize_files(written(merge_catalogs(imported, base), "merged")):
        parts.append(f"part-{len(parts)}")
        manifests.append(_publish(content, records, version, label, f"{folder}/{parts[-1]}", made, name, f"./{name}?v={quote(version, safe='')}"))
    told = {"schemaVersion": SCHEMA_VERSION, "catalogVersion": version, "manifests": [f"./{p}/manifest.json" for p in parts]}
    files.write_bytes(f"{folder}/{PARTS_NAME}", (json.dumps(told, indent=2) + "\n").encode())
    return manifests, imported.count(), told_warnings(warnings)


def told_warnings(warnings: DataFrame) -> list[str]:
    first = [r["warning"] for r in warnings.orderBy("pos").limit(WARNINGS_TOLD).collect()]
    rest = warnings.count() - len(first)
    return [*first, f"另有 {rest} 条警告未显示。"] if rest else first


def publish_core(venues: DataFrame, folder: str, version: str = CORE_VERSION, label: str = CORE_LABEL, made: str = CORE_MADE, name: str = PUBLIC_NAME) -> Manifest:
    """The ten core columns only, of a fixed version and time unless told otherwise."""
    return _publish(serialize_core(venues), venues.count(), version, label, folder, made, name, f"./{name}?v={version}")


def verify_folder(spark: SparkSession, folder: str, base: str = "https://example.invalid/") -> Manifest:
    """Check a published folder: size, digest, count."""
    return _verified(spark, folder, base)[0]


def _verified(spark: SparkSession, folder: str, url: str) -> tuple[Manifest, DataFrame, DataFrame]:
    manifest = parse_manifest(files.read_bytes(f"{folder}/manifest.json").decode("utf-8"), url)
    return (manifest, *verify_payload(spark, manifest, files.read_bytes(f"{folder}/{manifest.fileName}")))


def verify_catalog(spark: SparkSession, folder: str, base: DataFrame, url: str = "https://example.invalid/") -> dict:
    """Check a published folder and activate it on trial over ``base``; nothing is stored."""
    manifest, venues, warnings = _verified(spark, folder, url)
    active = activate_catalog(venues, base)
    return {"catalogVersion": manifest.catalogVersion, "records": manifest.recordCount, "bytes": manifest.byteLength, "sha256": manifest.sha256,
            "warnings": warnings.count(), "activeRecords": active.count()}


def read_published(folder: str, url: str = "https://example.invalid/") -> Fetcher:
    """A fetcher that takes what lies below ``url`` from a published folder."""
    return lambda at: files.read_bytes(f"{folder}/{at.removeprefix(url).split('?')[0]}")


def verify_catalog_parts(spark: SparkSession, folder: str, base: DataFrame, url: str = "https://example.invalid/") -> dict:
    """``verify_catalog`` of a catalog in parts: each is checked, all are activated on trial as one."""
    manifests, venues, warnings = fetch_parts(spark, urljoin(url, PARTS_NAME), read_published(folder, url))
    active = activate_catalog(venues, base)
    return {"catalogVersion": manifests[0].catalogVersion, "records": sum(m.recordCount for m in manifests), "bytes": sum(m.byteLength for m in manifests),
            "sha256": [m.sha256 for m in manifests], "warnings": warnings.count(), "activeRecords": active.count()}


class CatalogStore:
    """A folder with the user catalog as Parquet and its metadata beside it.

    Writing goes to a new version folder; the metadata names the current one, so readers
    see the old or the new catalog, never a mixture. One writer at a time.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.lock = threading.Lock()

    def metadata(self) -> dict | None:
        try:
            return json.loads(files.read_bytes(f"{self.folder}/metadata.json"))
        except FileNotFoundError:
            return None

    def load(self, spark: SparkSession) -> DataFrame | None:
        at = (self.metadata() or {}).get("data")
        return spark.read.parquet(f"{self.folder}/{at}") if at else None

    def save(self, venues: DataFrame | None, **metadata) -> None:
        with self.lock:
            old = self.metadata() or {}
            data = old.get("data")
            if venues is not None:
                data = f"v{int((data or 'v0')[1:]) + 1}"
                venues.write.mode("overwrite").parquet(f"{self.folder}/{data}")
            files.write_bytes(f"{self.folder}/metadata.json", json.dumps(old | metadata | {"data": data}, ensure_ascii=False).encode())

    def clear(self) -> None:
        with self.lock:
            files.delete(f"{self.folder}/metadata.json")


def elapsed_hours(then: str | None, now: datetime) -> float:
    """Hours since; infinite if unknown, never negative."""
    at = _when(then) if then else None
    return float("inf") if at is None else max(0.0, (now - at).total_seconds() / 3600)


_active = threading.Lock()


def update_catalog(
    spark: SparkSession, store: CatalogStore, urls: Iterable[str], fetch: Fetcher, enabled: bool, now: datetime,
    force: bool = False, activate: Callable[[DataFrame], object] | None = None,
) -> str:
    """One refresh: ``disabled``, ``protected``, ``current``, or ``updated``.

    A catalog without metadata of an online one is the user's own and protected unless
    forced. Activation runs before anything is stored; an error keeps the stored data,
    records ``lastError`` and is raised. Refreshes run one at a time.
    """
    with _active:
        if not enabled and not force:
            return "disabled"
        old = store.metadata()
        if old and old.get("data") and old.get("source") != "online" and not force:
            return "protected"
        stamp = now.isoformat()
        if old and not force and elapsed_hours(old.get("lastCheckedAt"), now) < CHECK_HOURS:
            return "current"
        try:
            manifest, venues, _ = fetch_first(spark, urls, fetch)
            if old and (old.get("catalogVersion"), old.get("sha256")) == (manifest.catalogVersion, manifest.sha256):
                store.save(None, lastCheckedAt=stamp, lastError=None)
                return "current"
            if activate is not None:
                activate(venues)
            store.save(venues, source="online", catalogVersion=manifest.catalogVersion, sha256=manifest.sha256, label=manifest.label,
                       recordCount=manifest.recordCount, updatedAt=stamp, lastCheckedAt=stamp, lastError=None)
        except Exception as e:
            store.save(None, lastCheckedAt=stamp, lastError=str(e))
            raise
        return "updated"
