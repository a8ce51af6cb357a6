"""The base dimension, assembled from files: two ranked catalogs and the schools' additions.

No table of venues is shipped; the paths are parameters, in any store that Spark reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.merging import RULE_CATALOG, RULE_EDITION, add_school_data, core_venues
from .catalog import read_catalog, table_of
from .files import exists

# Who ranks, and the edition.
FIRST = ("中国计算机学会", "第七版（2026年）", "ccf")
SECOND = (RULE_CATALOG, RULE_EDITION, "school")
FILES = ("ccf.jsonl", "school.jsonl", "additions.json")


@dataclass
class Bundle:
    first: DataFrame
    second: DataFrame
    core: DataFrame
    venues: DataFrame

    def counts(self) -> dict[str, int]:
        """Rows of each table and of the base dimension."""
        return {"first": self.first.count(), "second": self.second.count(), "active": self.venues.count()}


def load_bundle(spark: SparkSession, folder: str) -> Bundle:
    """Both catalogs (``table_of``), merged; then the additions, a JSON catalog, if the folder has them."""
    first, second = (table_of(spark, f"{folder}/{name}", *told) for name, told in zip(FILES, (FIRST, SECOND), strict=False))
    core = core_venues(first, second)
    more = f"{folder}/{FILES[2]}"
    return Bundle(first, second, core, add_school_data(core, read_catalog(spark, more)[0]) if exists(more) else core)
