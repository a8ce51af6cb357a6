"""Every registered query over a small folder with nulls, repeats and clashing extra columns."""

import duckdb
import pytest

from rankweave.llm import queries

from .test_operators import SECRETS, corpus

EXTRA = "n_words long, spans string, score double, held_out string, th string, root long, hub long, base string, payload string, digest string, lang_pred string"
COLUMNS = [c.split()[0] for c in EXTRA.split(", ")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("queries")
    more = (7, "x", 0.5, "h", "t", 1, 2, "b", "p", "d", "zz")
    rows = [(i, t, "en" if (i or 0) % 2 else "de", f"s{(i or 0) % 5}", 1, *more) for i, t in corpus(seed=31, n=25)] + [(3000 + i, t, None, None, None, *more) for i, t in SECRETS]
    pages = [(k, f"http://x/{k % 3}", f"<p>{k % 4}</p>" if k % 5 else None, *more) for k in range(30)]
    for name, few in (("full", False), ("empty", True)):
        spark.createDataFrame([] if few else rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").coalesce(2).write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame([] if few else pages, f"page_id long, url string, html string, {EXTRA}").coalesce(2).write.parquet(f"{at}/{name}/pages.parquet")
        labels = [(i, (i or 0) % 2, None, *more) for i, *_ in rows]
        spark.createDataFrame([] if few else [*labels, labels[0], (None, 1, 0, *more)], f"doc_id long, quality int, toxic int, {EXTRA}").coalesce(1).write.parquet(f"{at}/{name}/labels.parquet")
        spark.createDataFrame([] if few else [(0, rows[5][1], *more), (1, None, *more), (0, "w1 W2, w3", *more)], f"item_id long, text string, {EXTRA}").coalesce(1).write.parquet(f"{at}/{name}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_with_clashing_names_and_empty_tables(spark, folders, name):
    run = queries.queries()[name]
    assert run(spark, f"{folders}/empty").count() == 0
    df = run(spark, f"{folders}/full")
    table = "pages" if "warc" in name else "documents"
    n = spark.read.parquet(f"{folders}/full/{table}.parquet").count()
    if name not in ("op11_errata_trie", "op13_source_divergence"):  # rows of words and of sources
        assert df.count() == n
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.sql(f"create view {t} as select * from '{folders}/full/{t}.parquet/*.parquet'")
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())
