"""Ranking labels for display: ordered badges, tooltips, visibility and change signatures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edition_text, nfkc, number_text, trim
from ..schema import LABEL
from ..sources.catalog import YES
from .merging import venue_schools

# Order of label badges before and after the numeric indicators, prefixes, core names.
FRONT = ("ccf-chinese", "new-rising", "cas-upgraded", "cas-discipline", "jcr-quartile", "pku-core", "cssci", "cssci-extended", "cstpcd",
         "cscd-core", "cscd-extended", "cast-tier", "indexing")
BACK = ("sjr", "publication-type", "warning", "note")
PREFIX = {"new-rising": "新锐分区 ", "cas-upgraded": "SCI升级版 ", "cas-discipline": "中科院 ", "jcr-quartile": "JCR ", "cast-tier": "中国科协 ", "warning": "预警 "}
CORE = {
    "pku-core": ("北大中文核心", "北大核心"),
    "cssci": ("南大中文核心", "南大核心", "CSSCI"),
    "cssci-extended": ("CSSCI扩展版", "CSSCI扩展"),
    "cstpcd": ("中国科技核心", "科技核心", "CSTPCD"),
    "cscd-core": ("CSCD核心库", "CSCD核心"),
    "cscd-extended": ("CSCD扩展库", "CSCD扩展"),
}
SHORT_SCHOOLS = {"云南财经大学": "云财", "东北财经大学": "东财", "西南财经大学": "西财"}
KINDS = ("source", "ccf", *FRONT, "cas", "impact-factor", "school", *BACK)
BADGE = "struct<kind:string,text:string,edition:string,school_name:string>"


def short_school(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHORT_SCHOOLS.items() for x in kv])[c], c)


def label_text(kind: Column, text: Column) -> Column:
    folded = F.lower(trim(nfkc(text)))
    out = F.when(kind == "ccf-chinese", F.concat(F.lit("CCF 中文 "), text, F.lit(" 推荐")))
    for k, prefix in PREFIX.items():
        out = out.when(kind == k, F.concat(F.lit(prefix), text))
    for k, (name, *aliases) in CORE.items():
        plain = folded.isin(*YES, *(v.lower() for v in (name, *aliases)))
        out = out.when(kind == k, F.when(plain, F.lit(name)).otherwise(F.concat(F.lit(f"{name} "), text)))
    return out.otherwise(text)


def _badge(kind: Column, text: Column, edition: Column, school: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), edition.alias("edition"), school.alias("school_name"))


def badges(matched: Column, source: Column, truncated: Column, brand: str = "Rankweave") -> Column:
    """Ordered badges of a venue struct (schema.VENUE, null where nothing matched)."""
    null = F.lit(None).cast("string")
    none = F.array().cast(f"array<{BADGE}>")
    labels = F.coalesce(matched["labels"], F.array().cast(f"array<{LABEL.simpleString()}>"))
    name = F.coalesce(source, F.get(matched["acronyms"], F.lit(0)), matched["canonical_name"], F.lit("待识别"))
    title = F.concat(F.lit(f"{brand} · 来源："), name, F.when(truncated, "（文字不完整）").otherwise(""))
    def of(kinds: tuple[str, ...]) -> Column:
        ranked = lambda k: F.filter(labels, lambda x: x["kind"] == F.lit(k))
        made = lambda x: _badge(x["kind"], label_text(x["kind"], x["text"]), x["edition"], null)
        return F.transform(F.flatten(F.array(*[ranked(k) for k in kinds])), made)

    one = lambda when, *b: F.when(when, F.array(_badge(*b))).otherwise(none)
    detailed = F.exists(labels, lambda x: x["kind"].isin("cas-upgraded", "cas-discipline"))
    schools = F.transform(venue_schools(matched["school"], matched["schools"]), lambda s: _badge(
        F.lit("school"), F.concat(short_school(F.coalesce(s["catalog"], F.lit("学校"))), F.lit(" "), s["rank"]), s["edition"], F.coalesce(s["catalog"], F.lit("学校"))))
    rest = F.concat(
        one(matched["ccf"].isNotNull(), F.lit("ccf"), F.concat(F.lit("CCF-"), matched["ccf"]["rank"], F.lit(" 类推荐")), matched["ccf"]["edition"], null),
        of(FRONT),
        one(matched["cas"].isNotNull() & ~detailed, F.lit("cas"), F.concat(F.lit("中科院 "), matched["cas"]["rank"], F.lit("区")), matched["cas"]["edition"], null),
        one(matched["impact_factor"].isNotNull(), F.lit("impact-factor"),
            F.concat(F.lit("IF "), number_text(matched["impact_factor"]["value"]), F.lit("（"), matched["impact_factor"]["year"], F.lit("）")), null, null),
        schools, of(BACK),
    )
    return F.concat(F.array(_badge(F.lit("source"), title, null, null)), F.when(matched.isNotNull(), rest).otherwise(none))


def tooltip(site: Column, matched: Column, source: Column) -> Column:
    none = F.array().cast("array<string>")
    line = lambda when, *x: F.when(when, F.array(F.concat(*x))).otherwise(none)
    labels = F.coalesce(matched["labels"], F.array().cast(f"array<{LABEL.simpleString()}>"))
    lines = F.concat(
        F.array(F.concat(site, F.lit("来源："), F.coalesce(source, F.lit("未提供"))), F.concat(F.lit("匹配："), matched["canonical_name"])),
        line(matched["cas"].isNotNull(), F.lit("中科院分区："), matched["cas"]["rank"], F.lit("区"), edition_text(matched["cas"]["edition"])),
        line(matched["ccf"].isNotNull(), F.lit("CCF："), matched["ccf"]["rank"], edition_text(matched["ccf"]["edition"])),
        line(matched["impact_factor"].isNotNull(), F.lit("影响因子："), number_text(matched["impact_factor"]["value"]), F.lit("（"), matched["impact_factor"]["year"], F.lit("）")),
        F.transform(venue_schools(matched["school"], matched["schools"]), lambda s: F.concat(s["catalog"], F.lit("："), s["rank"], edition_text(s["edition"]))),
        F.transform(labels, lambda x: F.concat(label_text(x["kind"], x["text"]), edition_text(x["edition"]))),
    )
    missing = F.when(source.isNotNull() & (source != ""), F.concat(site, F.lit("来源："), source, F.lit("\n当前本地目录尚无精确匹配。"))).otherwise(
        F.concat(site, F.lit("页面暂未提供可识别的期刊或会议来源。")))
    return F.when(matched.isNull(), missing).otherwise(F.array_join(lines, "\n"))


@dataclass
class DisplaySettings:
    hidden_kinds: list[str] = field(default_factory=list)
    show_edition: bool = True
    hidden_schools: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, value: object) -> DisplaySettings:
        """From stored settings; what is invalid falls back to the default."""
        raw = value if isinstance(value, dict) else {}
        texts = lambda k: list(dict.fromkeys(v for v in raw[k] if isinstance(v, str))) if isinstance(raw.get(k), list) else []
        return cls([k for k in texts("hiddenKinds") if k in KINDS], raw.get("showEdition") is not False, texts("hiddenSchools"))


def visible(shown: Column, settings: DisplaySettings) -> Column:
    hidden = lambda b: b["kind"].isin(*settings.hidden_kinds) if settings.hidden_kinds else F.lit(False)
    school = lambda b: F.coalesce(b["school_name"].isin(*settings.hidden_schools), F.lit(False)) if settings.hidden_schools else F.lit(False)
    return F.filter(shown, lambda b: ~hidden(b) & ~school(b))


def display_texts(shown: Column, settings: DisplaySettings) -> Column:
    edition = lambda b: F.when(~F.contains(b["text"], b["edition"]), edition_text(b["edition"])).otherwise("")
    return F.transform(shown, lambda b: F.concat(b["text"], F.coalesce(edition(b), F.lit("")) if settings.show_edition else F.lit("")))


def badge_signature(shown: Column, settings: DisplaySettings) -> Column:
    """Digest of what is shown; equal digests need no new write."""
    return F.sha2(F.concat(F.to_json(shown), F.lit(str(settings.show_edition))), 256)


def annotate(matches: DataFrame, venues: DataFrame, source: str = "candidate", truncated: str | None = None, brand: str = "Rankweave") -> DataFrame:
    """``matches`` (with ``match``) plus the venue's flat facts, badges and tooltip."""
    dimension = venues.select(F.col("id").alias("__id"), F.struct(*venues.columns).alias("venue"))
    j = matches.join(dimension, F.col("match.venue_id") == F.col("__id"), "left").drop("__id")
    v, cut = F.col("venue"), F.coalesce(F.col(truncated), F.lit(False)) if truncated else F.lit(False)
    return (
        j.withColumn("badges", badges(v, F.col(source), cut, brand)).withColumn("ccf_rank", v["ccf"]["rank"]).withColumn("cas_quartile", v["cas"]["rank"])
        .withColumn("impact_factor", v["impact_factor"]["value"]).withColumn("school_rank", v["school"]["rank"])
    )
