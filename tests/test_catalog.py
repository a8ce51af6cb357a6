import pytest

from rankweave.sources import catalog


def parse(spark, text, name="catalog.csv"):
    venues, warnings = catalog.parse_catalog(spark, text, name)
    return venues.orderBy("pos").collect(), warnings.collect()


def test_tokenizer():
    rows = lambda t: list(catalog.csv_rows(t))
    assert rows('a"b,c"d,e\tf\r\ng,"x""y\nz"\rlast') == [["ab,cd", "e", "f"], ["g", 'x"y\nz'], ["last"]]
    assert rows("") == [] and rows("a,") == [["a", ""]] and rows("\n\n") == [[""], [""]] and rows("a\n") == [["a"]]
    with pytest.raises(ValueError, match="未闭合"):
        rows('a,"b')


@pytest.mark.parametrize(("text", "name", "error"), [
    ("name", "c.csv", "至少需要表头"), (" , \nx", "c.csv", "表头不能为空"), ("name\n \n", "c.csv", "没有可导入"), ("{", "c.JSON", "格式无效"), ("{}", "c.json", "顶层必须"),
    ("[1]", "c.json", "每一项"), ("[]", "c.json", "没有可导入"), ("name,type\n,x", "c.csv", "第 2 行缺少"), ("name,type\na,book", "c.csv", "第 2 行“类型”"),
    ("名称\nＡ\n\nb\na", "c.csv", "第 4 行与第 2 行"), ("name,ccf\na,D", "c.csv", "CCF"), ("name,cas\na,5区", "c.csv", "中科院分区"), ("name,if\na,1d", "c.csv", "影响因子必须"),
    ("name,if\na,-1", "c.csv", "影响因子必须"), ("name,if\na,5", "c.csv", "四位年份"), ('name,schools\na,"[{""catalog"":""x""}]"', "c.csv", "catalog 和等级"),
    ('name,schools\na,"[{""catalog"":""x"",""rank"":""1""},{""catalog"":"" x"",""rank"":""2""}]"', "c.csv", "学校等级重复：x"), ("name,schools\na,x", "c.csv", "有效 JSON"),
    ("name,ccf,type\na,D,\nb,,bad", "c.csv", "第 2 行 CCF"),
])
def test_errors(spark, text, name, error):
    with pytest.raises(ValueError, match=error):
        catalog.parse_catalog(spark, text, name)


def test_all_indicators(spark):
    text = "﻿name,Type,aliases,acronym,ISSN,CAS,CAS edition,CCF_Rank,CCF版本,影响因子,影响因子年份,影响因子来源,学校等级,学校名称,学校版本,来源链接,ignored\n" \
           "Full Journal,Conference,FJ1;full journal|FJ2,F.J.,1234-5678|8765-4321,1区,2025,a,7,0x10,2025,JCR,A+,示例大学,2026,https://x,1\nBare,,,,,,,,,,,,,,,,\n"
    rows, warnings = parse(spark, text)
    r = rows[0]
    assert (r.id, r.type, r.canonical_name, r.aliases, r.acronyms, r.issn) == ("user:full journal", "conference", "Full Journal", ["FJ1", "FJ2"], ["F.J."], ["1234-5678", "8765-4321"])
    assert (r.ccf.rank, r.ccf.catalog, r.ccf.edition, r.cas.rank, r.cas.catalog) == ("A", "CCF", "7", "1", "中科院分区")
    assert (r.impact_factor.value, r.impact_factor.year, r.impact_factor.source_label, r.school.rank, r.school.catalog) == (16.0, "2025", "JCR", "A+", "示例大学")
    assert rows[1].aliases == [] and rows[1].acronyms is None and rows[1].labels is None
    assert [w.warning for w in warnings] == ["第 3 行“Bare”只有名称，没有等级指标。"]


def test_labels_and_core_words(spark):
    text = "name,pku,北大核心,cssci,科技核心,新锐标签,新锐年份,升级版标签,中科院年份,jcr分区标签,if年份\n" \
           "a,ignored,是|北大中文核心|2023版,CSSCI|是,否|无|非中国科技核心|已收录,T,2026,1区,2025,Q1,2024\n"
    rows, _ = parse(spark, text)
    assert [(x.kind, x.text, x.edition) for x in rows[0].labels] == [
        ("cas-upgraded", "1区", "2025"), ("jcr-quartile", "Q1", "2024"), ("new-rising", "T", "2026"), ("pku-core", "北大中文核心", None), ("pku-core", "2023版", None),
        ("cssci", "CSSCI", None), ("cstpcd", "CSTPCD", None)]


def test_json(spark):
    rows, _ = parse(spark, '﻿[{"name":"A","aliases":["x|y"],"casQuartile":2,"impactFactor":5.0,"impactFactorYear":2025,"schools":[{"catalog":"S","rank":"1","edition":""}]}]', "x.JSON")
    r = rows[0]
    assert (r.aliases, r.cas.rank, r.impact_factor.value, r.impact_factor.year) == (["x", "y"], "2", 5.0, "2025")
    assert [(s.catalog, s.rank, s.edition) for s in r.schools] == [("S", "1", None)]


def test_same_name_two_types(spark):
    rows, _ = parse(spark, "name,type\nSpin,journal\nSpin,conference")
    assert [r.id for r in rows] == ["user:spin", "user:spin"] and [r.type for r in rows] == ["journal", "conference"]


def test_round_trip(spark, tmp_path):
    text = 'name,type,aliases,cas,cas edition,if,if year,schools,其他标签\n"Quoted ""x"", y",会议,p|q,1,2025,33.1,2025,"[{""catalog"":""S,1"",""rank"":""A""}]",n1|n2\nSecond,,,,,8,2024,,\n'
    venues, _ = catalog.parse_catalog(spark, text)
    out = catalog.serialize_catalog(venues)
    assert not out.endswith("\n") and out.split("\n")[0] == ",".join(catalog.EXPORT_HEADERS)
    again, _ = catalog.parse_catalog(spark, out)
    drop = lambda df: [r.asDict(recursive=True) for r in df.orderBy("pos").collect()]
    assert drop(again) == drop(venues)
    catalog.write_catalog(venues, str(tmp_path / "out.csv"), bom=True)
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    back, _ = catalog.read_catalog(spark, str(tmp_path / "out.csv"))
    assert drop(back) == drop(venues)
    assert catalog.template().count("\r\n") == 1


def test_base_tables_are_parameters(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id":"x:1","type":"journal","canonical_name":"A","aliases":[],"acronyms":["AA"],"issn":[],"rank":"B","pos":0}\n')
    r = catalog.table_of(spark, str(tmp_path / "t.json"), "C", "2026", "school").first()
    assert (r.school.rank, r.school.edition, r.ccf, r.issn, r.acronyms) == ("B", "2026", None, None, ["AA"])


def test_round_trip_of_more_rows_than_a_catalog_holds(spark, tmp_path):
    from rankweave.plans import registry

    n = 30_005
    spark.range(1, n + 1).selectExpr("id as s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) as s_name", "cast(id % 25 as int) as s_nationkey", "cast(id % 900 as double) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["csv_roundtrip_rows"](spark, str(tmp_path)).select("pos").collect()
    assert sorted(r.pos for r in got) == list(range(1, n + 1))


def test_catalogs_keep_within_the_bytes_of_a_file(spark, monkeypatch):
    from .helpers import venue, venues

    some = venues(spark, *[venue(k, f"v{k}", f"Journal {k}") for k in range(7)])
    head = len(catalog.serialize_catalog(some).split("\n")[0].encode())
    monkeypatch.setattr(catalog, "MAX_FILE_BYTES", head + 150)
    texts = list(catalog.serialize_catalogs(some))
    assert len(texts) > 1 and all(len(x.encode()) <= head + 150 for x in texts)
    assert [line for x in texts for line in x.split("\n")[1:]] == catalog.serialize_catalog(some).split("\n")[1:]
