"""The pipeline's stages, each on its own input, against plain re-statements."""

import re

import pytest

import corpus_pipeline
from rankweave.llm import packing

from . import brute
from .test_operators import SECRETS, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, base long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with clashing extra columns, and a benchmark."""
    at = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", f"s{(i or 0) % 4}", len(t) if t else None, "x", 1) for i, t in corpus(seed=21, n=40)]
    rows += [(2000 + i, t, None, None, 1, None, None) for i, t in SECRETS]
    rows += [(None, "a row without an id but with words", "en", None, None, None, None), (3, rows[3][1], "en", "s3", 1, "x", 1), (4000, "12 34", "en", "s", 5, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, rows[5][1] + " w0 w1 w2 w3 w4 w5 w6"), (1, "w9")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and result of every stage, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(f"{folder}/stage{k}.parquet")
        after = spark.read.parquet(f"{folder}/stage{k}.parquet")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_rejects_only_what_has_no_letter(stages):
    before, after = stages[0]
    assert rows(after) == sorted((str(r.doc_id), str(r.text)) for r in before.collect() if re.search(r"[^\W\d_]", r.text or ""))


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    docs = {(r.doc_id if r.doc_id is not None else -1): r.text for r in before.collect()}
    keep = {str(i if i != -1 else None) for i, n, c in brute.components(list(docs.items()), 5, 80) if i == c or not n}
    assert sorted(i for i, _ in rows(after)) == sorted(keep) and len(keep) < len(docs)


def test_passages_are_cut(spark, folder, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    old = {r.doc_id: r for r in before.collect() if r.doc_id is not None}
    hit = {d for d, _, n, *_ in brute.hits([(d, r.text) for d, r in old.items()], items) if n}
    assert hit
    for r in after.collect():
        if r.doc_id in hit:
            words = brute.ITEM_WORD.findall(brute.low(r.text))
            assert "w9" not in words and len(words) < len(brute.ITEM_WORD.findall(brute.low(old[r.doc_id].text))) and r.n_chars == len(r.text)
        elif r.doc_id is not None:
            assert r.text == old[r.doc_id].text
    assert after.count() == before.count()


def test_secrets_are_masked(stages):
    before, after = stages[3]
    old = {r.doc_id: r.text for r in before.collect()}
    masked = 0
    for r in after.collect():
        assert brute.secrets(r.text) == ""
        masked += "[secret]" in r.text
        if not brute.secrets(old[r.doc_id]) and "[secret]" not in r.text:
            assert r.text == old[r.doc_id]
    assert masked >= 3 and after.count() == before.count()


def test_packing_is_whole(stages):
    before, after = stages[4]
    ids = dict(zip((r.doc_id for r in before.collect()), packing.encode([r.text or "" for r in before.collect()], packing.tokenizer_path()), strict=True))
    got: dict = {}
    for r in after.orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, []) + list(r.ids)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) // 4 + 1 for k, v in ids.items()}


def test_run(spark, folder, stages):
    assert corpus_pipeline.run(spark, folder).count() == stages[-1][1].count()


def test_two_runs_do_not_disturb_each_other(spark, folder, stages):
    first, second = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert first.count() == second.count() == stages[-1][1].count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
