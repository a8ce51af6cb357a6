"""Catalog files (CSV, TSV, JSON) to the venue dimension, and back.

A file is at most 15 MiB and 30,000 rows by rule, so its text is tokenized once on the
driver; validation and the nested rows are Column expressions. Checks report the first
failing row in file order, whatever the partitioning.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import header_key, nfkc, py_trim, read_string, split_list, trim, venue_name
from ..operators.merging import label_set
from ..schema import DEFAULT_SCHOOL, LABEL, LABEL_FIELDS, MAX_FILE_BYTES, MAX_RECORDS, SCHOOL, STRINGS, VENUE
from . import files

# Fields and the headers that name them.
HEADERS = {
    "name": "name journalname venuename 期刊名称 会议名称 来源名称 名称",
    "type": "type 类型",
    "aliases": "aliases alias 别名 其他名称",
    "acronyms": "acronyms acronym 简称 缩写",
    "issn": "issn issns",
    "casQuartile": "casquartile cas 中科院分区 中科院几区",
    "casEdition": "casedition 中科院版本 中科院年份",
    "ccfRank": "ccfrank ccf ccf级别 ccf推荐级别",
    "ccfEdition": "ccfedition ccf版本 ccf年份",
    "ccfChineseLabels": "ccfchineselabels ccf中文期刊标签 ccf中文推荐标签 ccf中文期刊",
    "ccfChineseEdition": "ccfchineseedition ccf中文期刊版本 ccf中文版本 ccf中文年份",
    "impactFactor": "impactfactor if 影响因子",
    "impactFactorYear": "impactfactoryear ifyear 影响因子年份 if年份",
    "impactFactorSource": "impactfactorsource ifsource 影响因子来源",
    "schools": "schools 多学校等级",
    "schoolRank": "schoolrank 学校等级 学校分区",
    "schoolName": "schoolname 学校名称 学校目录",
    "schoolEdition": "schooledition 学校版本 学校年份",
    "casDisciplineLabels": "casdisciplinelabels 中科院学科标签 中科院标签",
    "casUpgradedLabels": "casupgradedlabels 中科院升级版标签 sci升级版标签 升级版标签",
    "jcrQuartileLabels": "jcrquartilelabels jcr分区标签 jcr学科标签",
    "newRisingLabels": "newrisinglabels 新锐分区标签 新锐标签",
    "newRisingEdition": "newrisingedition 新锐版本 新锐年份",
    "indexingLabels": "indexinglabels 检索标签 数据库标签 收录标签",
    "pkuCoreLabels": "pkucorelabels 北大中文核心标签 北大核心标签 北大中文核心 北大核心",
    "cssciLabels": "csscilabels 南大中文核心标签 南大核心标签 cssci标签 南大中文核心 南大核心 cssci",
    "cssciExtendedLabels": "cssciextendedlabels cssci扩展版标签 cssci扩展标签 南大扩展版标签",
    "cstpcdLabels": "cstpcdlabels 中国科技核心标签 科技核心标签 中国科技核心 科技核心 cstpcd",
    "cscdCoreLabels": "cscdcorelabels cscd核心库标签 cscd核心库 中国科学引文数据库核心库",
    "cscdExtendedLabels": "cscdextendedlabels cscd扩展库标签 cscd扩展库 中国科学引文数据库扩展库",
    "castTierLabels": "casttierlabels 中国科协高质量期刊标签 中国科协标签 科协高质量期刊标签",
    "sjrLabels": "sjrlabels sjr标签 scimago标签 计量指标标签",
    "publicationTypeLabels": "publicationtypelabels 期刊类型标签",
    "warningLabels": "warninglabels 预警标签 预警标记",
    "noteLabels": "notelabels 其他标签 标注标签",
    "sourceUrl": "sourceurl url 来源链接",
}
FIELD_OF = {header_key(h): field for field, names in HEADERS.items() for h in names.split()}
# Vocabulary of the three core labels.
CORE_TEXT = {"pku-core": "北大中文核心", "cssci": "CSSCI", "cstpcd": "CSTPCD"}
CORE_ALIASES = {"pku-core": ("北大中文核心", "北大核心"), "cssci": ("cssci", "南大中文核心", "南大核心"), "cstpcd": ("cstpcd", "中国科技核心", "科技核心")}
YES = ("是", "1", "true", "yes", "y", "√", "收录", "已收录")
NO = ("否", "0", "false", "no", "n", "×", "无", "n/a", "na", "-", "—", "none", "null", "不适用", "未收录", "不收录", "非核心", "不是", "未入选")
NEGATED = "(?i)^(?:非|不是|不属于|未(?:被)?).*(?:核心|cssci|cstpcd|收录)"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


# Reading


_TOKEN = re.compile(r'"|\r\n|[\r\n]|[,\t]|[^",\t\r\n]+')


def csv_rows(text: str) -> Iterator[list[str]]:
    """Rows of cells. Comma and tab part cells; a quote toggles quoting anywhere in a cell."""
    row, cell, quoted, any_row = [], [], False, False
    tokens = [m[0] for m in _TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        t = tokens[i]
        i += 1
        if t == '"':
            if quoted and i < len(tokens) and tokens[i] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif quoted or t[0] not in ",\t\r\n":
            cell.append(t)
        else:
            row.append("".join(cell))
            cell = []
            any_row = t in ",\t"
            if not any_row:
                yield row
                row = []
    if quoted:
        raise ValueError("CSV 存在未闭合的双引号。")
    if row or "".join(cell):
        yield [*row, "".join(cell)]


def csv_records(text: str) -> list[dict[str, str]]:
    matrix = list(csv_rows(text.removeprefix("﻿")))
    if len(matrix) < 2:
        raise ValueError("CSV 至少需要表头和一行数据。")
    headers = [py_trim(h) for h in matrix[0]]
    if not any(headers):
        raise ValueError("CSV 表头不能为空。")
    filled = (cells for cells in matrix[1:] if any(py_trim(c) for c in cells))
    return [{h: (cells[k] if k < len(cells) else "") for k, h in enumerate(headers) if h} for cells in filled]


def _scalar(value: object) -> str | None:
    """As ECMAScript's String()."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, list):
        return ",".join(_scalar(v) or "" for v in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def json_records(text: str) -> list[dict]:
    try:
        rows = json.loads(text.removeprefix("﻿"))
    except ValueError:
        raise ValueError("JSON 文件格式无效。") from None
    if not isinstance(rows, list):
        raise ValueError("JSON 顶层必须是期刊记录数组。")
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("JSON 数组中的每一项都必须是对象。")
    return rows


def parse_schools(value: object) -> list[dict] | None:
    """School ranks of a JSON cell; raises what is wrong with them."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            raise ValueError("多学校等级必须是有效 JSON 数组。") from None
    if not isinstance(value, list) or len(value) > 100:
        raise ValueError("多学校等级必须是最多 100 项的数组。")
    out: list[dict] = []
    for item in value:
        if not isinstance(item, (dict, list)):
            raise ValueError("学校等级条目无效。")
        text = lambda k, item=item: py_trim(v) if isinstance(item, dict) and isinstance(v := item.get(k), str) else ""
        if not text("catalog") or not text("rank"):
            raise ValueError("每个学校等级必须包含学校全称 catalog 和等级 rank。")
        if any(x["catalog"] == text("catalog") for x in out):
            raise ValueError(f"学校等级重复：{text('catalog')}")
        edition = item.get("edition")
        if "edition" in item and not isinstance(edition, str):
            raise ValueError("学校版本必须是文本。")
        out.append({"catalog": text("catalog"), "rank": text("rank"), "edition": edition or None, "source_url": None})
    return out


def raw_rows(spark: SparkSession, text: str, file_name: str = "catalog.csv") -> DataFrame:
    """row_no and one string column a field; schools parsed, with their error."""
    records = json_records(text) if file_name.lower().endswith(".json") else csv_records(text)
    if not records:
        raise ValueError("目录中没有可导入的数据行。")
    if len(records) > MAX_RECORDS:
        raise ValueError(f"目录最多允许 {MAX_RECORDS} 条记录。")
    rows = []
    for k, record in enumerate(records):
        fields = {FIELD_OF[h]: v for raw, v in record.items() if (h := header_key(raw)) in FIELD_OF}
        schools = error = None
        try:
            schools = parse_schools(fields.pop("schools", None))
        except ValueError as e:
            error = str(e)
        rows.append((k + 2, schools, error, *(_scalar(fields.get(f)) for f in HEADERS if f != "schools")))
    names = ", ".join(f"`{f}` string" for f in HEADERS if f != "schools")
    return spark.createDataFrame(rows, f"row_no int, schools array<{SCHOOL.simpleString()}>, schools_error string, {names}")


def core_label(kind: str, text: Column) -> Column:
    """Text of a core label: null where it says no, the canonical text where it says yes."""
    folded = F.lower(trim(nfkc(text)))
    return (
        F.when(folded.isin(*NO) | folded.rlike(NEGATED), F.lit(None))
        .when(folded.isin(*YES, *CORE_ALIASES[kind]), F.lit(CORE_TEXT[kind])).otherwise(text)
    )


def _labels_of(kind: str, field: str, edition: str | None) -> Column:
    when = read_string(edition) if edition else F.lit(None).cast("string")
    text = (lambda t: core_label(kind, t)) if kind in CORE_TEXT else (lambda t: t)
    made = F.transform(split_list(field), lambda t: F.struct(F.lit(kind).alias("kind"), text(t).alias("text"), when.alias("edition")))
    return F.filter(made, lambda x: x["text"].isNotNull())


def _labels() -> Column:
    return label_set(F.concat(*[_labels_of(*x) for x in LABEL_FIELDS]))


def _number(x: Column) -> Column:
    based = F.when(x.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(x, 3, 64), 16, 10)).when(
        x.rlike("^0[oO][0-7]+$"), F.conv(F.substring(x, 3, 64), 8, 10)).when(x.rlike("^0[bB][01]+$"), F.conv(F.substring(x, 3, 64), 2, 10))
    value = F.when(x.rlike(NUMBER), x).otherwise(based).try_cast("double")
    return F.when(value < float("inf"), value)


def venues_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(venues, errors): nested rows, and row_no, error of rows that fail, by the first failing check."""
    kind = F.lower(read_string("type"))
    typed = F.when(kind.isNull() | kind.isin("journal", "期刊"), "journal").when(kind.isin("conference", "会议"), "conference")
    null = F.lit(None).cast("string")
    rows = rows.withColumns({
        "__name": read_string("name"), "__type": typed, "__ccf": F.upper(read_string("ccfRank")), "__factor": read_string("impactFactor"),
        "__cas": F.nullif(F.regexp_replace(read_string("casQuartile"), "区$", ""), F.lit("")), "__year": read_string("impactFactorYear"), "__url": read_string("sourceUrl"),
    }).withColumn("__value", _number(F.col("__factor")))
    ccf, cas, factor, year, url, value = (F.col(c) for c in ("__ccf", "__cas", "__factor", "__year", "__url", "__value"))
    school = read_string("schoolRank")
    ranking = lambda rank, edition, catalog: F.when(rank.isNotNull(), F.struct(
        rank.alias("rank"), read_string(edition).alias("edition"), url.alias("source_url"), catalog.alias("catalog")))
    keyed = rows.withColumn("__key", venue_name("__name"))
    alone = F.when(F.col("__type").isNull() | F.col("__name").isNull(), F.col("row_no"))  # such rows are no duplicates, and no group
    own = Window.partitionBy("__type", "__key", alone).orderBy("row_no")
    keyed = keyed.withColumn("__first", F.when(F.col("__type").isNotNull() & F.col("__name").isNotNull(), F.first("row_no").over(own)))
    line = lambda *x: F.concat(F.lit("第 "), F.col("row_no").cast("string"), *[F.lit(v) if isinstance(v, str) else v for v in x])
    error = F.coalesce(
        F.when(F.col("__name").isNull(), line(" 行缺少“期刊名称/名称”。")),
        F.when(F.col("__type").isNull(), line(" 行“类型”只能是期刊/journal或会议/conference。")),
        F.when(F.col("__first") < F.col("row_no"), line(" 行与第 ", F.col("__first").cast("string"), " 行的同类型名称重复：", F.col("__name"))),
        F.when(~ccf.isin("A", "B", "C"), line(" 行 CCF 级别只能是 A、B 或 C。")),
        F.when(~cas.isin("1", "2", "3", "4"), line(" 行中科院分区只能是 1区、2区、3区或4区。")),
        F.when(factor.isNotNull() & (value.isNull() | (value < 0)), line(" 行影响因子必须是大于等于 0 的数字。")),
        F.when(factor.isNotNull() & (year.isNull() | ~year.rlike(r"^\d{4}$")), line(" 行填写影响因子时必须同时填写四位年份。")),
        F.col("schools_error"),
    )
    optional = lambda c: F.when(F.size(split_list(c)) > 0, split_list(c))
    venues = keyed.select(
        F.concat(F.lit("user:"), F.col("__key")).alias("id"), F.col("__type").alias("type"), F.col("__name").alias("canonical_name"),
        F.filter(split_list("aliases"), lambda a: venue_name(a) != F.col("__key")).cast(STRINGS).alias("aliases"),
        optional("acronyms").alias("acronyms"), optional("issn").alias("issn"), null.alias("dblp_key"),
        ranking(ccf, "ccfEdition", F.lit("CCF")).alias("ccf"), ranking(cas, "casEdition", F.lit("中科院分区")).alias("cas"),
        F.when(factor.isNotNull(), F.struct(value.alias("value"), year.alias("year"), url.alias("source_url"),
                                            read_string("impactFactorSource").alias("source_label"))).alias("impact_factor"),
        ranking(school, "schoolEdition", F.coalesce(read_string("schoolName"), F.lit(DEFAULT_SCHOOL))).alias("school"),
        "schools", _labels().alias("labels"), (F.col("row_no") - 2).alias("pos"),
    )
    return venues, keyed.select("row_no", error.alias("error")).where("error is not null")


def warnings_of(venues: DataFrame) -> DataFrame:
    """Rows that carry no indicator at all."""
    bare = F.col("ccf").isNull() & F.col("cas").isNull() & F.col("impact_factor").isNull() & F.col("school").isNull()
    bare = bare & (F.coalesce(F.size("schools"), F.lit(0)) <= 0) & F.col("labels").isNull()
    text = F.concat(F.lit("第 "), (F.col("pos") + 2).cast("string"), F.lit(" 行“"), F.col("canonical_name"), F.lit("”只有名称，没有等级指标。"))
    return venues.where(bare).select("pos", text.alias("warning"))


def parse_catalog(spark: SparkSession, text: str, file_name: str = "catalog.csv") -> tuple[DataFrame, DataFrame]:
    """(venues, warnings) of a catalog's text; raises the error of the first bad row."""
    venues, errors = venues_of(raw_rows(spark, text, file_name))
    first = errors.orderBy("row_no").limit(1).collect()
    if first:
        raise ValueError(first[0]["error"])
    return venues, warnings_of(venues)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_catalog`` of a file in any store that Spark reads."""
    file = spark.read.format("binaryFile").load(path).select("length", "content").limit(1)
    row = file.where(F.col("length") <= MAX_FILE_BYTES).first()
    if row is None:
        raise ValueError("目录文件不存在或超过 15 MB。")
    return parse_catalog(spark, bytes(row["content"]).decode("utf-8"), path.rsplit("/", 1)[-1])


# Writing

# Headers of the exported file, in order.
EXPORT_HEADERS = (
    "期刊名称", "类型", "别名", "简称", "ISSN", "中科院分区", "中科院版本", "CCF级别", "CCF版本", "CCF中文期刊标签", "CCF中文期刊版本",
    "影响因子", "影响因子年份", "影响因子来源", "学校等级", "学校名称", "学校版本", "中科院学科标签", "中科院升级版标签", "JCR分区标签",
    "新锐分区标签", "新锐版本", "检索标签", "北大中文核心标签", "南大中文核心标签", "CSSCI扩展版标签", "中国科技核心标签", "CSCD核心库标签",
    "CSCD扩展库标签", "中国科协高质量期刊标签", "SJR标签", "期刊类型标签", "预警标签", "其他标签", "来源链接", "多学校等级",
)
TEMPLATE_ROW = ("Example Journal", "期刊", "Example J.", "EJ", "1234-5678", "1区", "2025", "A", "", "", "", "5.2", "2025", "", "A", "示例大学")


def csv_cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if re.search('[",\r\n]', value) else value


def csv_cells(c: Column) -> Column:
    """``csv_cell`` as a Column function."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def template() -> str:
    return "\r\n".join(",".join(map(csv_cell, row)) for row in (EXPORT_HEADERS, (*TEMPLATE_ROW, *[""] * (len(EXPORT_HEADERS) - len(TEMPLATE_ROW)))))


def js_number(c: Column) -> Column:
    """Shortest decimal text, integers without a point."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def export_columns(venues: DataFrame) -> DataFrame:
    """pos and the 36 text columns ``c0`` to ``c35``."""
    labels = F.coalesce("labels", F.array().cast(f"array<{LABEL.simpleString()}>"))
    of = lambda kind: F.filter(labels, lambda x: x["kind"] == kind)
    text = lambda kind: F.array_join(F.transform(of(kind), lambda x: x["text"]), "|")
    edition = lambda kind: F.get(F.filter(F.transform(of(kind), lambda x: x["edition"]), lambda e: e.isNotNull() & (e != "")), F.lit(0))
    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    school = lambda s: F.concat(F.lit('{"catalog":'), _quoted(s["catalog"]), F.lit(',"rank":'), _quoted(s["rank"]),
                                F.when(s["edition"].isNotNull(), F.concat(F.lit(',"edition":'), _quoted(s["edition"]))).otherwise(""), F.lit("}"))
    schools = F.when(F.size("schools") > 0, F.concat(F.lit("["), F.array_join(F.transform("schools", school), ","), F.lit("]"))).otherwise("")
    cells = [
        F.col("canonical_name"), F.when(F.col("type") == "conference", "会议").otherwise("期刊"), joined("aliases"), joined("acronyms"), joined("issn"),
        F.coalesce(F.concat("cas.rank", F.lit("区")), F.lit("")), F.coalesce("cas.edition", edition("cas-upgraded"), edition("cas-discipline"), F.lit("")),
        field("ccf.rank"), field("ccf.edition"), text("ccf-chinese"), F.coalesce(edition("ccf-chinese"), F.lit("")),
        F.coalesce(js_number(F.col("impact_factor.value")), F.lit("")), field("impact_factor.year"), field("impact_factor.source_label"),
        field("school.rank"), field("school.catalog"), field("school.edition"), text("cas-discipline"), text("cas-upgraded"), text("jcr-quartile"),
        text("new-rising"), F.coalesce(edition("new-rising"), F.lit("")), *[text(k) for k in (
            "indexing", "pku-core", "cssci", "cssci-extended", "cstpcd", "cscd-core", "cscd-extended", "cast-tier", "sjr", "publication-type", "warning", "note")],
        F.coalesce("impact_factor.source_url", "cas.source_url", "ccf.source_url", "school.source_url", F.lit("")), schools,
    ]
    return venues.select("pos", *[c.alias(f"c{k}") for k, c in enumerate(cells)])


def _quoted(c: Column) -> Column:
    """JSON text of a string."""
    return F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def _lines(venues: DataFrame) -> DataFrame:
    columns = export_columns(venues)
    return columns.select("pos", F.concat_ws(",", *[csv_cells(F.col(f"c{k}")) for k in range(len(EXPORT_HEADERS))]).alias("line")).orderBy("pos")


def serialize_catalog(venues: DataFrame) -> str:
    """The file's text: LF between lines, none at the end."""
    rows = _lines(venues).limit(MAX_RECORDS + 1).collect()
    if len(rows) > MAX_RECORDS:
        raise ValueError(f"目录最多允许 {MAX_RECORDS} 条记录。")
    return "\n".join([",".join(map(csv_cell, EXPORT_HEADERS)), *(r["line"] for r in rows)])


#: Places of the core columns among the exported ones.
CORE_COLUMNS = (0, 1, 2, 3, 4, 7, 8, 14, 15, 16)


def serialize_core(venues: DataFrame) -> str:
    """The ten core columns; the type as it is stored."""
    cells = [F.col("type") if k == 1 else F.col(f"c{k}") for k in CORE_COLUMNS]
    rows = export_columns(venues).join(venues.select("pos", "type"), "pos").select("pos", F.concat_ws(",", *[csv_cells(c) for c in cells]).alias("line"))
    lines = [r["line"] for r in rows.orderBy("pos").limit(MAX_RECORDS + 1).collect()]
    if len(lines) > MAX_RECORDS:
        raise ValueError(f"目录最多允许 {MAX_RECORDS} 条记录。")
    return "\n".join([",".join(EXPORT_HEADERS[k] for k in CORE_COLUMNS), *lines])


PREVIEW_ROWS, PREVIEW_LABELS = 50, 3


def preview(venues: DataFrame, schools: Column, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as a reader sees them: name, type, the rankings, and a few labels with the number of the rest.

    ``schools`` is the array of the venue's school rankings.
    """
    dash = lambda c: F.coalesce(c, F.lit("—"))
    labels = F.transform(F.coalesce("labels", F.array().cast(f"array<{LABEL.simpleString()}>")), lambda x: x["text"])
    few, more = F.array_join(F.slice(labels, 1, PREVIEW_LABELS), " / "), F.size(labels) - PREVIEW_LABELS
    ranks = F.transform(schools, lambda s: F.concat(F.coalesce(s["catalog"], F.lit("学校")), F.lit(" "), s["rank"]))
    return venues.orderBy("pos").limit(rows).select(
        "pos", F.col("canonical_name").alias("name"), F.when(F.col("type") == "journal", "期刊").otherwise("会议").alias("type"),
        dash(F.concat("cas.rank", F.lit("区"))).alias("cas"), dash(F.col("ccf.rank")).alias("ccf"),
        dash(F.concat(js_number(F.col("impact_factor.value")), F.lit("（"), F.col("impact_factor.year"), F.lit("）"))).alias("impact_factor"),
        F.when(F.size(ranks) > 0, F.array_join(ranks, " / ")).otherwise("—").alias("schools"),
        F.when(F.size(labels) == 0, "—").when(more > 0, F.concat(few, F.lit(" / 另 "), more.cast("string"), F.lit(" 项"))).otherwise(few).alias("labels"))


def serialize_files(venues: DataFrame) -> Iterator[tuple[str, int]]:
    """Text and rows of as many files as the rows need within the format's rules, one at least; a file at a time is in memory."""
    head = ",".join(map(csv_cell, EXPORT_HEADERS))
    lines, size = [head], len(head.encode())
    for r in _lines(venues).toLocalIterator():
        more = len(r["line"].encode()) + 1
        if len(lines) > MAX_RECORDS or (len(lines) > 1 and size + more > MAX_FILE_BYTES):
            yield "\n".join(lines), len(lines) - 1
            lines, size = [head], len(head.encode())
        lines.append(r["line"])
        size += more
    yield "\n".join(lines), len(lines) - 1


def serialize_catalogs(venues: DataFrame) -> Iterator[str]:
    """The texts of ``serialize_files``."""
    return (text for text, _ in serialize_files(venues))


def write_catalog(venues: DataFrame, path: str, bom: bool = False) -> None:
    """One file, for download with a byte-order mark if asked."""
    files.write_bytes(path, serialize_catalog(venues).encode("utf-8-sig" if bom else "utf-8"))


def table_of(spark: SparkSession, path: str, catalog: str, edition: str, kind: str) -> DataFrame:
    """A base catalog kept as a JSON-lines table (id, type, canonical_name, aliases, acronyms, issn, rank).

    kind: the ranking that ``rank`` fills, ``ccf`` or ``school``. The tables are
    parameters; none is shipped.
    """
    rows = spark.read.schema("id string, type string, canonical_name string, aliases array<string>, acronyms array<string>, issn array<string>, rank string, pos int").json(path)
    value = F.struct(F.col("rank"), F.lit(edition).alias("edition"), F.lit(None).cast("string").alias("source_url"), F.lit(catalog).alias("catalog"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in VENUE}
    given = {c: F.col(c) for c in ("id", "type", "canonical_name", "pos")} | {
        "aliases": F.coalesce("aliases", F.array().cast(STRINGS)), "acronyms": F.when(F.size("acronyms") > 0, F.col("acronyms")),
        "issn": F.when(F.size("issn") > 0, F.col("issn")), kind: value}
    return rows.select(*[(given.get(n, empty[n])).alias(n) for n in VENUE.names])
