from pyspark.sql import functions as F

from rankweave.operators import badges
from rankweave.schema import LABEL_FIELDS

from .helpers import label, rank, school, venue, venues


def shown(spark, v, settings=badges.DisplaySettings(), source="Src", cut=False):  # noqa: B008
    df = venues(spark, v).select(F.struct("*").alias("v"))
    b = badges.visible(badges.badges(F.col("v"), F.lit(source), F.lit(cut), "B"), settings)
    return df.select(badges.display_texts(b, settings).alias("t"), badges.tooltip(F.lit("站"), F.col("v"), F.lit(source)).alias("tip"), badges.badge_signature(b, settings).alias("s")).first()


FULL = {"ccf": rank("A", edition="第七版（2026年）"), "cas": rank("1"), "impact_factor": {"value": 33.1, "year": "2025", "source_url": None, "source_label": None},
        "school": rank("A", "云南财经大学"), "schools": [school("示例大学", "A+")]}


def test_order_of_every_kind(spark):
    labels = [label(kind, "是" if kind == "pku-core" else "t") for kind, *_ in LABEL_FIELDS]
    got = shown(spark, venue(0, "x", "Name", labels=labels, **FULL)).t
    assert got == ["B · 来源：Src", "CCF-A 类推荐（第七版（2026年））", "CCF 中文 t 推荐", "新锐分区 t", "SCI升级版 t", "中科院 t", "JCR t", "北大中文核心", "南大中文核心 t", "CSSCI扩展版 t",
                   "中国科技核心 t", "CSCD核心库 t", "CSCD扩展库 t", "中国科协 t", "t", "IF 33.1（2025）", "云财 A", "示例大学 A+", "t", "t", "预警 t", "t"]


def test_cas_without_detail_and_settings(spark):
    got = shown(spark, venue(0, "x", "Name", **FULL), source=None, cut=True)
    assert got.t == ["B · 来源：Name（文字不完整）", "CCF-A 类推荐（第七版（2026年））", "中科院 1区", "IF 33.1（2025）", "云财 A", "示例大学 A+"]
    settings = badges.DisplaySettings.of({"hiddenKinds": ["ccf", "ccf", "bogus", 1], "showEdition": False, "hiddenSchools": ["示例大学", 2]})
    assert settings == badges.DisplaySettings(["ccf"], False, ["示例大学"])
    again = shown(spark, venue(0, "x", "Name", **FULL), settings)
    assert again.t == ["B · 来源：Src", "中科院 1区", "IF 33.1（2025）", "云财 A"] and again.s != got.s
    assert badges.DisplaySettings.of("x") == badges.DisplaySettings()


def test_tooltip(spark):
    assert shown(spark, venue(0, "x", "Name", **FULL)).tip == "站来源：Src\n匹配：Name\n中科院分区：1区\nCCF：A（第七版（2026年））\n影响因子：33.1（2025）\n云南财经大学：A\n示例大学：A+"
    null = venues(spark, venue(0, "x", "N")).select(F.when(F.lit(False), F.struct("*")).alias("v"))
    got = null.select(badges.tooltip(F.lit("站"), F.col("v"), F.lit("S")).alias("a"), badges.tooltip(F.lit("站"), F.col("v"), F.lit(None).cast("string")).alias("b"), badges.badges(F.col("v"), F.lit(None).cast("string"), F.lit(False), "B").alias("c")).first()
    assert got.a == "站来源：S\n当前本地目录尚无精确匹配。" and got.b == "站页面暂未提供可识别的期刊或会议来源。" and [x.text for x in got.c] == ["B · 来源：待识别"]
