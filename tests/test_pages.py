import random
import re

import pytest
from pyspark.sql import functions as F

from rankweave.plans import registry
from rankweave.sources import pages
from rankweave.sources.html import parse_html
from rankweave.sources.pages import cnki_detail, cnki_results, extract_papers, papers_of, scholar_results, select_elements


def venue_of(html, url="https://lib.example.org/"):
    return [(p["adapter"], p["title"], p["venue_candidate"], p["source_truncated"]) for p in papers_of(html, url)]


def test_tree_and_selectors():
    root = parse_html('<table><tr class="r"><td>1<td>2<tr id=b><td>3</table><ul><li>a<li>b</ul><p>x<div>y</div><a href="/p/x.html" Data-K="1">l&amp;m</a>')
    assert [n.text for n in root.select("table tbody tr td")] == ["1", "2", "3"] and [n.text for n in root.select("ul > li")] == ["a", "b"]
    assert root.first("p").text == "x" and root.first('a[href$=".html"][data-k="1"]').text == "l&m" and root.first('#b td').text == "3"
    assert root.select("tr.r, #b")[1].get("id") == "b" and root.first("table > tr") is None and root.first("td").closest("table").tag == "table"
    assert parse_html(None).text == ""


CNKI = """<table class="result-table-list"><tbody>
<tr data-key="k1"><td class="name"><a href="/a1"> Title&nbsp;One </a></td><td class="author">A; B</td><td class="source">来源：计算机学报</td><td class="date">2024-05-01</td><td class="data">期刊</td></tr>
<tr id="i2"><td class="name"><a href="">T2</a></td><td class="source">Long name…</td></tr><tr><td class="name"><a href="/a3">T3</a></td></tr><tr><td>none</td></tr></tbody></table>"""


def test_cnki(spark):
    rows = list(cnki_results(parse_html(CNKI)))
    assert [(r["id"], r["title"], r["venue_candidate"], r["year"], r["source_truncated"]) for r in rows] == [
        ("k1", "Title One", "计算机学报", 2024, False), ("i2", "T2", "Long name…", None, True), ("/a3", "T3", None, None, False)]
    assert len(venue_of(CNKI)) == 2
    page = '<meta name="citation_author" content="A"><meta name="citation_author" content=" B "><div class="wx-tit"><h1>Detail</h1></div><div class="top-tip"><a>刊名: 软件学报</a></div>'
    got = cnki_detail(parse_html(page))
    assert (got["title"], got["venue_candidate"], got["authors_text"], got["id"]) == ("Detail", "软件学报", "A, B", "cnki-detail:Detail")
    assert venue_of(page) == [("知网兼容页面", "Detail", "软件学报", False)] and venue_of("<h1>Bare</h1><div class='top-tip'><a>x</a></div>") == []


def card(title, meta, attrs='data-cid="c"'):
    return f'<div class="gs_r gs_or gs_scl" {attrs}><div class="gs_ri"><h3 class="gs_rt">{title}</h3><div class="gs_a">{meta}</div></div></div>'


def test_scholar():
    html = card('<span class="gs_ctc">[PDF]</span><a href="/x">[HTML] Linked</a>', "A - V, 2020 - p") + card('<span class="gs_ctu">[C]</span> Cited only', "A - W - p", 'id="e"') + card("", "A - V, 2020 - p") + '<div class="gs_r gs_or gs_scl"></div>'
    rows = list(scholar_results(parse_html(html)))
    assert [(r["id"], r["title"], r["venue_candidate"], r["year"], r["url"]) for r in rows] == [("c", "Linked", "V", 2020, "/x"), ("e", "Cited only", "W", None, None)]


def test_scholar_pro_is_bound_to_its_host():
    cell = '<div class="card"><div class="card-body"><div class="card-main-content"><h5 class="card-title">{}<span class="translate-btn">T</span></h5><p class="card-meta">{}</p></div></div></div>'
    html = f'<div class="search-results">{cell.format("<a href=x>[PDF] One</a>", "A - V…, 2025 - N")}{cell.format("Two", "A - 2025 - Nature")}{cell.format("Three", "A - nature.com")}{cell.format("Four", "A - No year - P")}</div>'
    assert venue_of(html, "https://www.googlescholar.pro/s?q=1") == [("GoogleScholar.pro", "One", "V…", True)] and venue_of(html) == []


def test_pubmed_jmlr():
    html = '<article class="full-docsum"><div class="docsum-content"><a class="docsum-title" href="/123/"> T </a><span class="full-journal-citation">J Med. 2025 Jan;1.</span></div></article>' \
           '<article class="full-docsum"><div class="docsum-content"><a class="docsum-title" href="/x/">T</a><span class="short-journal-citation">J. 2025.</span></div></article>'
    assert venue_of(html, "https://pubmed.ncbi.nlm.nih.gov/?term=x") == [("PubMed", "T", "J Med", False)] and venue_of(html) == []
    volume = '<div id="content"><h1>JMLR Volume 3</h1><dl><dt>P</dt><dd><a href="/papers/v3/x.html">abs</a></dd></dl><dl><dt>Q</dt><dd><a href="/papers/v4/x.html">abs</a></dd></dl></div>'
    assert venue_of(volume, "https://jmlr.org/papers/v3/") == [("JMLR", "P", "Journal of Machine Learning Research", False)] and venue_of(volume, "https://jmlr.org/papers/v4/") == []


def titles(html, url):
    return [t for _, t, _, _ in venue_of(html, url)]


def volume_page(number, entries):
    return f'<div id="content"><h1>JMLR Volume {number}</h1>' + "".join(f'<dl><dt>{t}</dt><dd><a href="{h}">text</a></dd></dl>' for t, h in entries) + "</div>"


def test_listing_caps_count_rows_before_they_are_judged():
    entries = [(f"Tidal study {k}", f"/papers/v{7 if k % 2 else 8}/s{k}.html") for k in range(520)]
    assert len(titles(volume_page(7, entries), "https://www.jmlr.org/papers/v7")) == 250


def pmlr_entry(title, source, link):
    return f'<section class="paper"><p class="title">{title}</p><div class="details"><span class="info"><i>{source}</i></span></div><nav class="links"><a href="{link}">abs</a></nav></section>'


@pytest.mark.parametrize(("title", "source", "link", "venue"), [
    ("Rivers", "Proceedings of the 12th International Conference on Machine Learning", "river21a.html", "International Conference on Machine Learning"),
    ("Lakes", "Symposium on Lakes", "/v44/lake21a.html", "Symposium on Lakes"),
    ("Other volume", "Symposium on Lakes", "/v45/lake21a.html", None),
    ("A download", "Symposium on Lakes", "/v44/lake21a.pdf", None),
    ("Other host", "Symposium on Lakes", "https://mirror.example/v44/lake21a.html", None),
    ("No source", " ", "/v44/lake21a.html", None),
    (" ", "Symposium on Lakes", "/v44/lake21a.html", None),
])
def test_pmlr_listing(title, source, link, venue):
    got = venue_of(pmlr_entry(title, source, link), "https://proceedings.mlr.press/v44/")
    assert [(x[0], x[1], x[2]) for x in got] == ([("PMLR", title, venue)] if venue else [])


@pytest.mark.parametrize(("event", "link", "found"), [
    ("WACV2023", "/content/WACV2023/html/Oak_Leaf_paper.html", True), ("WACV2023", "/content_WACV2023/html/Oak_Leaf_paper.html", True),
    ("WACV2023", "/content/WACV2022/html/Oak_Leaf_paper.html", False), ("WACV2023", "/content/WACV2023/html/Oak_Leaf.html", False),
    ("WACV2023_workshops", "/content/WACV2023/html/Oak_Leaf_paper.html", False), ("ECCV2022", "/content/ECCV2022/html/Oak_Leaf_paper.html", False),
])
def test_cvf_listing(event, link, found):
    html = f'<dl><dt class="ptitle"><br><a href="{link}">Leaf shapes</a></dt><dd>authors</dd></dl>'
    assert titles(html, f"https://openaccess.thecvf.com/{event}") == (["Leaf shapes"] if found else [])


@pytest.mark.parametrize(("book", "hash_", "year", "found"), [
    ("Advances in Neural Information Processing Systems 31", "0f" * 16, "2018", True), ("Advances in Neural Information Processing Systems 31", "0f" * 15, "2018", False),
    ("Advances in Neural Information Processing Systems 31", "0f" * 16, "2017", False), ("Workshop papers 31", "0f" * 16, "2018", False),
])
def test_neurips_listing(book, hash_, year, found):
    html = f'<h1 class="book-title">{book}</h1><ul><li><a title="paper title" href="/paper/{year}/hash/{hash_}-Abstract.html">Moss</a><i>x</i></li></ul>'
    assert titles(html, "https://papers.nips.cc/paper/2018") == (["Moss"] if found else [])


@pytest.mark.parametrize(("slug", "media", "found"), [("stone", "pdf", True), ("stone", "slides", False), ("panel-stone", "pdf", False), ("Invited-talk", "pdf", False)])
def test_usenix_listing(slug, media, found):
    html = f'<article class="node-paper"><h2><a href="https://usenix.org/conference/nsdi21/presentation/{slug}">Stone bridges</a></h2><i class="usenix-schedule-media {media}"></i></article>'
    assert titles(html, "https://www.usenix.org/conference/nsdi21/technical-sessions/") == (["Stone bridges"] if found else [])
    assert titles(html, "https://www.usenix.org/conference/nsdi22/technical-sessions/") == []


def dblp_entry(ident, link, source, kind="article", part="Periodical", times=1):
    one = f'<a href="{link}"><span itemprop="isPartOf" itemtype="https://schema.org/{part}"><span itemprop="name">{source}</span></span></a>'
    return f'<ul><li class="entry {kind}" id="{ident}"><cite class="data"><span class="title">Sand dunes</span>{one * times}</cite></li></ul>'


@pytest.mark.parametrize(("entry", "venue"), [
    (dblp_entry("journals/geo/Dune1", "/db/journals/geo/geo9.html", "Geo Lett."), "Geo Lett."),
    (dblp_entry("journals/eswa/Dune2", "/db/journals/eswa/eswa77.html", "Expert Syst. Appl."), "Expert Systems with Applications"),
    (dblp_entry("conf/nips/Dune3", "/db/conf/nips/nips2019.html", "NeurIPS", "inproceedings", "BookSeries"), "NeurIPS"),
    (dblp_entry("conf/nips/Dune4", "/db/conf/nips/sand2019.html", "NIPS", "inproceedings", "BookSeries"), "NIPS"),
    (dblp_entry("conf/geo/Dune5", "/db/journals/geo/geo9.html", "Geo Lett."), None),
    (dblp_entry("journals/geo/Dune6", "/db/journals/geology/geo9.html", "Geo Lett."), None),
    (dblp_entry("journals/geo/Dune7", "https://elsewhere.example/db/journals/geo/geo9.html", "Geo Lett."), None),
    (dblp_entry("journals/geo/Dune8", "/db/journals/geo/geo9.html", "Geo Lett.", times=2), None),
])
def test_dblp_listing(entry, venue):
    got = venue_of(entry, "https://dblp.uni-trier.de/pers/d/Dune.html")
    assert [(t, v) for _, t, v, _ in got] == ([("Sand dunes", venue)] if venue else []) and venue_of(entry) == []


def stated(title, heading, venue=None, **more):
    """Citation metadata of a page, with one heading element."""
    metas = {"citation_title": title, "citation_journal_title": venue} | more
    return "".join(f'<meta name="{n}" content="{v}">' for n, v in metas.items() if v) + heading


ACL = "Proceedings of the 70th Annual Meeting of the Association for Computational Linguistics (Volume {}: {} Papers)"


@pytest.mark.parametrize(("html", "url", "expect"), [
    (stated("Salt", "<h3> Salt </h3>", "Brine Letters"), "https://brine.example/1", ("论文元数据", "Brine Letters")),
    (stated("Salt", "<h3>Pepper</h3>", "Brine Letters"), "https://brine.example/1", None),
    (stated("Salt", "<h3 aria-hidden=true>Salt</h3>", "Brine Letters"), "https://brine.example/1", None),
    (stated("Salt", "<section style='color:red; VISIBILITY: hidden'><h3>Salt</h3></section>", "Brine Letters"), "https://brine.example/1", None),
    (stated("Salt", "<h3>Salt</h3>", "Brine Letters", citation_conference_title="Brine Days"), "https://brine.example/1", None),
    (stated("Salt", "<h3>Salt</h3>", "Brine Days", citation_conference_title="Brine Days"), "https://brine.example/1", ("论文元数据", "Brine Days")),
    (stated("Salt", "<h3>Salt</h3>", "Proceedings of the 3rd Symposium on Salt"), "https://proceedings.mlr.press/v3/salt.html", ("PMLR", "Proceedings of the 3rd Symposium on Salt")),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title=ACL.format(1, "Long")), "https://aclanthology.org/2030.acl-long.8/", ("ACL Anthology", "Annual Meeting of the Association for Computational Linguistics")),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title=ACL.format(1, "Long")), "https://aclanthology.org/2030.acl-short.8/", ("ACL Anthology", ACL.format(1, "Long"))),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title=ACL.format(2, "Long")), "https://aclanthology.org/2030.acl-long.8/", ("ACL Anthology", ACL.format(2, "Long"))),
    (stated("{S}alt", "<h3>Salt</h3>", citation_conference_title="21st USENIX Conference on File and Storage Technologies (FAST 23)"), "https://usenix.org/conference/fast23/presentation/salt", ("USENIX", "USENIX Conference on File and Storage Technologies")),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title="21st USENIX Conference on File and Storage Technologies (FAST 22)"), "https://usenix.org/conference/fast23/presentation/salt", None),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title="Asian Conference on Computer Vision"), "https://openaccess.thecvf.com/content/ACCV2022/html/Salt_paper.html", ("CVF Open Access", "Asian Conference on Computer Vision")),
    (stated("Salt", "<h3>Salt</h3>", citation_conference_title="Asian Conference on Computer Vision"), "https://openaccess.thecvf.com/content/CVPR2022/html/Salt_paper.html", None),
])
def test_paper_pages(html, url, expect):
    assert [(a, v) for a, _, v, _ in venue_of(html, url)] == ([expect] if expect else [])


def test_extract_over_tables(spark):
    pages = spark.createDataFrame([(1, "https://x.org/", CNKI), (2, None, None), (3, "https://x.org/", "<p>nothing</p>"), (4, "bad url", stated("T", "<h2>T</h2>", "V…"))], "page_id long, url string, html string")
    got = extract_papers(pages).orderBy("page_id", "node_pos").collect()
    assert [(r.page_id, r.title, r.source_truncated) for r in got] == [(1, "Title One", False), (1, "T2", True), (4, "T", True)]


def test_references_without_a_semicolon():
    html = '<h1 title="a&amp&amp;b">x &amp;&lt; y&amp z&copy &unknown; &#65; &#65 &&amp;lt;</h1><script>a&amp</script>'
    root = parse_html(html, open_references=False)
    assert root.first("h1").text == "x &< y&amp z&copy &unknown; A &#65 &&lt;" and root.first("h1").get("title") == "a&amp&b" and root.first("script").text == "a&amp"
    assert parse_html(html).first("h1").text == "x &< y& z© &unknown; A A &&lt;"


def test_pages_are_dealt_among_tasks(spark):
    """Pages of one partition are parsed by many tasks, each once."""
    made = spark.range(200).selectExpr("id as page_id", "'https://pubmed.ncbi.nlm.nih.gov/' as url", "concat('<article class=\"full-docsum\"><div class=\"docsum-content\"><a class=\"docsum-title\" href=\"/', id, '/\">T</a><span class=\"full-journal-citation\">J. 2020 May;1.</span></div></article>') as html").coalesce(1)
    for got in (extract_papers(made), select_elements(made, "a.docsum-title")):
        rows = got.withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.page_id for r in rows) == list(range(200)) and len({r.task for r in rows}) > 4


def test_selectors_find_inside_and_in_order():
    root = parse_html('<div class="a b a" id="x"><p>1<b class="a">2</b></p><i id="x">3</i></div><p class="a" id="y">4</p>')
    text = lambda found: [n.text for n in found]
    assert text(root.select(".a")) == ["123", "2", "4"] and text(root.first("#x").select(".a, p, [id]")) == ["12", "2", "3"]
    assert text(root.select("p, .a, #x")) == ["123", "12", "2", "3", "4"] and root.first("i, p").text == "12" and root.first("p").first("p") is None
    assert root.first("div.a.b p b").closest("#x.b").tag == "div" and root.first("i").closest(".a").tag == "div" and root.first("b").first("i") is None


class Visited(list):
    """Counts the elements that are looked at."""

    visits = 0

    def __getitem__(self, k):
        Visited.visits += 1
        return super().__getitem__(k)

    def __iter__(self):
        for node in super().__iter__():
            Visited.visits += 1
            yield node


PRO_CARD = '<div class="card"><div class="card-body"><div class="card-main-content"><h5 class="card-title"><a href="x">T{}</a></h5><p class="card-meta">A - V, 2021 - P</p></div></div></div>'
LONG = {  # a page around its rows, a row, the address
    "scholar_pro_cards": ('<div class="search-results">{}</div>', PRO_CARD, "https://www.googlescholar.pro/s"),
    "jmlr_volumes": ('<div id="content"><h1>JMLR Volume 3</h1>{}</div>', '<dl><dt>T{}</dt><dd><a href="/papers/v3/a.html">abs</a></dd></dl>', "https://jmlr.org/papers/v3/"),
    "cvf_lists": ('<dl>{}</dl>', '<dt class="ptitle"><a href="/content/ICCV2023/html/A_paper.html">T{}</a></dt>', "https://openaccess.thecvf.com/ICCV2023"),
    "usenix_sessions": ("{}", '<div class="node-paper"><h2><a href="/conference/fast23/presentation/p-1">T{}</a></h2><span class="usenix-schedule-media pdf"></span></div>', "https://www.usenix.org/conference/fast23/technical-sessions"),
    "cnki_rows": ('<table class="result-table-list"><tbody>{}</tbody></table>', '<tr><td class="name"><a href="/a">T{}</a></td><td class="source">V</td></tr>', "https://kns.example.org/"),
    "dblp_entries": ('<ul>{}</ul>', '<li class="entry article" id="journals/k/X"><cite class="data"><span class="title">T{}</span><a href="/db/journals/k/v1.html"><span itemprop="isPartOf" itemtype="http://schema.org/Periodical"><span itemprop="name">V</span></span></a></cite></li>', "https://dblp.org/pid/1.html"),
    "pmlr_volumes": ("{}", '<div class="paper"><p class="title">T{}</p><p class="details"><span class="info"><i>V</i></span></p><p class="links"><a href="/v3/a.html">abs</a></p></div>', "https://proceedings.mlr.press/v3/"),
    "page_papers": ("{}", '<div class="gs_r gs_or gs_scl"><div class="gs_ri"><h3 class="gs_rt"><a href="/x">T{}</a></h3><div class="gs_a">A - V, 2001 - P</div></div></div>', "https://scholar.example.org/"),
    "pubmed_rows": ("{}", '<article class="full-docsum"><div class="docsum-content"><a class="docsum-title" href="/1/">T{}</a><span class="full-journal-citation">V. 2020 May;1.</span></div></article>', "https://pubmed.ncbi.nlm.nih.gov/"),
}


@pytest.mark.parametrize("name", LONG)
def test_a_long_page_costs_in_proportion_to_its_rows(monkeypatch, name):
    page, row, url = LONG[name]
    visits = []

    def watched(html):
        root = parse_html(html)
        for mark, nodes in root.index.items():
            root.index[mark] = Visited(nodes)
        return root

    monkeypatch.setattr(pages, "parse_html", watched)
    for n in (50, 400):
        Visited.visits = 0
        assert len(papers_of(page.format("".join(row.format(k) for k in range(n))), url)) == n
        visits.append(Visited.visits)
    assert visits[1] < 16 * visits[0]


@pytest.mark.parametrize("name", ["scholar_pro_cards", "jmlr_volumes", "cvf_lists", "usenix_sessions", "citation_details", "cnki_details", "neurips_lists", "cnki_rows", "cvf_details", "dblp_entries", "pmlr_volumes", "page_papers", "pubmed_rows"])
def test_pages_are_dealt_before_anything_looks_into_them(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Filter" not in plan and "RLIKE" not in plan


def test_plain_tags_are_read_as_the_library_reads_all(monkeypatch):
    def tree(node):
        return node.tag, node.attrs, [c if isinstance(c, str) else tree(c) for c in node.children]

    pieces = ["<A HREF='u'>", '<a b="1" C="&lt;&amp" b="2" d>', "<br/>", '<i k="x"/>', "</a>", "</A >", "t &amp; &", "<script>a<b</script>", "<!-- <i> -->", '<a b="c"d="e">', "<p>", "<li>", "<div>", "</div>", '<b c="', "<"]
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    quick = [tree(parse_html(t, o)) for t in texts for o in (True, False)]
    monkeypatch.setattr("rankweave.sources.html._PLAIN", re.compile("(?!)"))
    assert quick == [tree(parse_html(t, o)) for t in texts for o in (True, False)]
