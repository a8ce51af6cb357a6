"""The venue dimension: nested schema, label kinds, fixed names."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _struct(*names: str, **typed: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _s) for n in names] + [T.StructField(n, t) for n, t in typed.items()])


RANKING = _struct("rank", "edition", "source_url", "catalog")
SCHOOL = _struct("catalog", "rank", "edition", "source_url")
LABEL = _struct("kind", "text", "edition")
IMPACT = T.StructType([T.StructField("value", T.DoubleType()), *[T.StructField(n, _s) for n in ("year", "source_url", "source_label")]])
STRINGS = T.ArrayType(_s)

#: ``pos`` takes the place of list order, which is never relied on.
VENUE = T.StructType([
    T.StructField("id", _s), T.StructField("type", _s), T.StructField("canonical_name", _s),
    T.StructField("aliases", STRINGS), T.StructField("acronyms", STRINGS), T.StructField("issn", STRINGS),
    T.StructField("dblp_key", _s), T.StructField("ccf", RANKING), T.StructField("cas", RANKING),
    T.StructField("impact_factor", IMPACT), T.StructField("school", RANKING),
    T.StructField("schools", T.ArrayType(SCHOOL)), T.StructField("labels", T.ArrayType(LABEL)), T.StructField("pos", T.IntegerType()),
])

# Label kinds in the order of import, each with its field and the field of its edition.
LABEL_FIELDS = (
    ("ccf-chinese", "ccfChineseLabels", "ccfChineseEdition"),
    ("cas-upgraded", "casUpgradedLabels", "casEdition"),
    ("cas-discipline", "casDisciplineLabels", "casEdition"),
    ("jcr-quartile", "jcrQuartileLabels", "impactFactorYear"),
    ("new-rising", "newRisingLabels", "newRisingEdition"),
    ("indexing", "indexingLabels", None),
    ("pku-core", "pkuCoreLabels", None),
    ("cssci", "cssciLabels", None),
    ("cssci-extended", "cssciExtendedLabels", None),
    ("cstpcd", "cstpcdLabels", None),
    ("cscd-core", "cscdCoreLabels", None),
    ("cscd-extended", "cscdExtendedLabels", None),
    ("cast-tier", "castTierLabels", None),
    ("sjr", "sjrLabels", None),
    ("publication-type", "publicationTypeLabels", None),
    ("warning", "warningLabels", None),
    ("note", "noteLabels", None),
)
DEFAULT_SCHOOL = "学校目录"
MAX_RECORDS = 30_000
MAX_FILE_BYTES = 15 * 1024 * 1024
