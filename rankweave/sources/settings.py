"""Stored settings with defaults, and how sizes and times are told."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, tzinfo

from ..operators.badges import DisplaySettings
from . import files


@dataclass
class Settings:
    enabled: bool = True
    auto_catalog_updates: bool = False
    label_display: DisplaySettings = field(default_factory=DisplaySettings)

    @classmethod
    def of(cls, value: object) -> Settings:
        """From stored settings; what is absent takes its default."""
        raw = value if isinstance(value, dict) else {}
        given = lambda k, otherwise: otherwise if raw.get(k) is None else raw[k]
        return cls(given("enabled", True), given("autoCatalogUpdates", False), DisplaySettings.of(raw.get("labelDisplay")))

    def stored(self) -> dict:
        shown = self.label_display
        return {"enabled": self.enabled, "autoCatalogUpdates": self.auto_catalog_updates, "labelDisplay": {
            "hiddenKinds": shown.hidden_kinds, "showEdition": shown.show_edition, "hiddenSchools": shown.hidden_schools}}


def load_settings(path: str) -> Settings:
    """Those stored at ``path``; the defaults if there are none or they can't be read as JSON."""
    try:
        return Settings.of(json.loads(files.read_bytes(path)))
    except (FileNotFoundError, ValueError):
        return Settings()


def save_settings(path: str, settings: Settings) -> None:
    files.write_bytes(path, json.dumps(settings.stored(), ensure_ascii=False).encode())


def size_text(n: int) -> str:
    """Bytes, kilobytes or megabytes, the latter two with one decimal."""
    unit = next((u for u in (("MB", 1 << 20), ("KB", 1 << 10)) if n >= u[1]), None)
    return f"{n / unit[1]:.1f} {unit[0]}" if unit else f"{n} B"


def time_text(value: str | None, zone: tzinfo | None = None) -> str:
    """A stored time as year, month, day, hour and minute; a dash for none, and as it is where it is no time."""
    if not value:
        return "—"
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return value
    at = at.astimezone(zone) if at.tzinfo else at
    return f"{at.year}年{at.month}月{at.day}日 {at:%H:%M}"
