"""Training-corpus pipeline: language, near-duplicates, benchmark, secrets, packing.

Every stage works on all that its predecessor kept, and its result is written as
Parquet and read again for the next. All stages but the last return the columns of
``documents``; ``lang`` and ``source`` stay as they came, ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import decontam, langid, ngram_join, packing, secret_scan
from rankweave.llm._common import collected, configure, discard, stage, table


#: Workers that have run other stages have less room for the ids of chunks.
REMEMBERED_CHUNKS = 100_000


def _nested(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all others in ``__row``, where their names can't clash."""
    return docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("__row"))


def _flat(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of the input again, with a new text and its length."""
    count = F.when(F.col(text).isNull(), F.col("__row.n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in columns else None
    put = {"text": F.col(text), "n_chars": count}
    return df.select(*[(put[c] if c in put else F.col(f"__row.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told go on; the rest are rejected: texts
    without a letter, and texts whose two nearest codewords are equally near."""
    configure(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = langid.predict(_nested(docs), model, ["__row"])
    return _flat(told.where((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")), "__text", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group under five-word shingles and similarity 0.8 stays."""
    configure(spark)
    return ngram_join.one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage that a benchmark window covers is cut from its document."""
    configure(spark)
    found = decontam.decontaminate(_nested(docs), table(spark, sf_dir, "benchmark"), ["__row"], clean=True)
    return _flat(found, "clean_text", docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, of the base kinds or owner-specific, is replaced by a mark."""
    configure(spark)
    found = secret_scan.scan(_nested(docs), keep=("__row", "text"))
    return _flat(found.select("__row", secret_scan.redact(F.col("text"), F.col("all_spans")).alias("text")), "text", docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 4096 tokens."""
    configure(spark)
    return packing.pack(docs, packing.tokenizer_path(), keep_ids=True, remember=REMEMBERED_CHUNKS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: Models, graph components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents of ``sf_dir``.

    What a stage has written goes once its result is written; the tables that the last
    result reads stay.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with collected(spark, keep=f"pipeline-{name}"):
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(*before)  # the pieces are written
    return packed
