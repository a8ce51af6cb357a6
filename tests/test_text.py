import unicodedata

import pytest
from pyspark.sql import functions as F

from rankweave.functions import citations, text, urls


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in df.select("k", f("v").alias("o")).orderBy("k").collect()]


def test_nfkc_equals_the_standard(spark):
    values = ["abc", "Ａｂ①", "ﬁ", "é", "㍿", "한", "ｶﾞ", "", None, "x y"]
    assert column(spark, text.nfkc, values) == [None if v is None else unicodedata.normalize("NFKC", v) for v in values]


def test_venue_name(spark):
    cases = {
        "  Ａｌｐｈａ   Conference  ": "alpha conference", "Science & Technology": "science & technology", "Science and Technology": "science and technology",
        "IEEE/ACM": "ieee/acm", "C++": "c++", "中国科学（数学）": "中国科学(数学", "…Foo…": "foo", "A – B’s “x”.": "a - b's \"x", "﻿(x)　": "x", " . ": "", "": "",
    }
    assert dict(zip(cases, column(spark, text.venue_name, list(cases)), strict=True)) == cases
    assert column(spark, text.venue_name, [None]) == [None]


def test_acronyms(spark):
    cases = {"A. C. T.": "act", "Foo Bar": "foo bar", "N. I. P. S.": "nips", "x" * 24: "x" * 24, "x" * 25: None, "a_b": None, "": None, "KDD-19/2#1+": "kdd-19/2#1+", "𝒜" * 12 + "b": "a" * 12 + "b", "A.B c": "ab c"}
    assert dict(zip(cases, column(spark, text.venue_acronym, list(cases)), strict=True)) == cases


def test_lists_numbers_variants(spark):
    assert column(spark, text.split_list, ["a| b ;a；　c||", None, " "]) == [["a", "b", "c"], [], []]
    assert column(spark, text.and_variant, ["A and B", "A & B", "android", None]) == ["A & B", "A and B", None, None]
    assert column(spark, text.number_text, [8.0, 33.1, 1e7, 0.12345, 2.50004, None], "double") == ["8", "33.1", "10000000", "0.1235", "2.5", None]
    assert column(spark, text.issn_key, ["1002-896x", "ＩＳＳＮ １"]) == ["1002896X", "1"]
    assert column(spark, text.compact, ["A-b 1（中）"]) == ["ab1中"]
    assert text.header_key(" CCF（Rank）_-") == "ccfrank"


SCHOLAR = [
    ("A Vaswani, N Shazeer - Advances in Neural Information Processing Systems, 2017 - proceedings.neurips.cc", "Advances in Neural Information Processing Systems", 2017, "proceedings.neurips.cc", False),
    ("A Researcher - 1999 - example.edu", None, 1999, "example.edu", False),
    ("A Writer - repository.example.org", None, None, "repository.example.org", False),
    ("A Writer - …International Conference on Examples, 2021 - ACM", "…International Conference on Examples", 2021, "ACM", True),
    ("A B – X – Y, 2001 — Z", "X - Y", 2001, "Z", False),
    ("", None, None, None, False), (None, None, None, None, False),
    ("A - Venue, 2010", "Venue", 2010, None, False), ("A - Journal - P", "Journal", None, "P", False),
]


def test_scholar_metadata(spark):
    got = column(spark, citations.scholar_metadata, [s[0] for s in SCHOLAR])
    assert [(g.venue_candidate, g.year, g.publisher_text, g.source_truncated) for g in got] == [s[1:] for s in SCHOLAR]
    from rankweave.sources.pages import scholar_fields

    for g, (value, *_) in zip(got, SCHOLAR, strict=True):
        assert g.asDict() == {k: v for k, v in scholar_fields(value).items()}


def test_pubmed_journal(spark):
    cases = {"J Intern Med. 2018 Dec;284(6):603-619. doi: x": "J Intern Med", "J. Med. Sci. 2025;3:1.": "J. Med. Sci", "Nature meth…. 2025.": "Nature meth…",
             "In: A Book. 2025.": None, "Nature. 20255.": None, "2025. PMID: 1": None, "Nature": None, "doi: 10.1/2": None}
    assert dict(zip(cases, column(spark, citations.pubmed_journal, list(cases)), strict=True)) == cases


def test_pmlr_and_acl(spark):
    cases = {"Proceedings of the 36th Conference on Learning Theory": "Annual Conference on Computational Learning Theory",
             "Proceedings of the 34th International Conference on Machine Learning Workshops": "Proceedings of the 34th International Conference on Machine Learning Workshops"}
    assert dict(zip(cases, column(spark, citations.pmlr_venue, list(cases)), strict=True)) == cases
    long = "Proceedings of the 59th Annual Meeting of the Association for Computational Linguistics (Volume 1: Long Papers)"
    df = spark.createDataFrame([("/2021.acl-long.1/", long), ("/2021.acl-short.1/", long), ("/2021.findings-acl.1/", long)], "p string, v string")
    assert [r.o == citations.ACL_VENUE for r in df.select(citations.acl_venue("p", "v").alias("o")).collect()] == [True, False, False]


@pytest.mark.parametrize(("value", "origin", "permission"), [
    ("http://192.0.2.10:3344/kns8/x?q=private", "http://192.0.2.10:3344", "http://192.0.2.10/*"),
    ("HTTPS://Example.ORG:443/a", "https://example.org", "https://example.org/*"),
    ("https://user:pw@example.org/", None, None), ("https://*.example.org/", None, None), ("ftp://example.org/", None, None), ("https://kns.cnki.net/", None, None),
    ("https://scholar.google.com/x", None, None), ("http://scholar.google.com/x", "http://scholar.google.com", "http://scholar.google.com/*"),
    ("https://chrome.google.com/webstore/x", None, None), ("nothing", None, None), (None, None, None),
])
def test_site_targets(spark, value, origin, permission):
    got = column(spark, urls.site_target, [value])[0]
    assert (got and (got.origin, got.permission)) == ((origin, permission) if origin else None)


def test_enabled_sites(spark):
    values = ["https://a.org", "https://a.org", "https://a.org/x", None, *[f"https://s{k}.org" for k in range(110)]]
    got = column(spark, urls.enabled_sites, [values], "array<string>")[0]
    assert len(got) == 100 and got[:2] == ["https://a.org", "https://s0.org"]


def test_edition_text(spark):
    assert column(spark, text.edition_text, ["2025", "", None]) == ["（2025）", "", ""]
    assert spark.range(1).select(text.squeeze(F.lit(" a  b\n"))).first()[0] == "a b"
