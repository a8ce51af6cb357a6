"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. For each bit a binary classifier over
hashed byte n-grams (1 to 4) of the lower-cased letters predicts it: a log-ratio
classifier fitted on a bounded sample, ``SAMPLE_PER_LANGUAGE`` documents of each
language. Decoding weighs each bit by its logistic loss and takes the codeword with
the least total; where the second-best is less than ``AMBIGUOUS`` away, the document
is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import configure, table

#: Bound of the training sample, in documents of one language.
SAMPLE_PER_LANGUAGE = 300
DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
SCALE = 6.0
AMBIGUOUS = 0.25
UND = "und"
_PIECE = 1 << 19
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _ngrams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the whole text, some at a time."""
    raw = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    a = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    for at in range(0, len(a), _PIECE):
        own = a[at : at + _PIECE + 3]
        for n in ORDERS:
            m = min(_PIECE, len(own) - n + 1)
            if m <= 0:
                continue
            code = own[:m].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) | own[k : k + m]
            yield ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(17)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, +1/-1
    weights: np.ndarray  # feature x bit

    def decode(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the choice is ambiguous."""
        if not self.languages:
            return UND, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        total, n = np.zeros(self.code.shape[1]), 0
        for f in _ngrams(text):
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        margin = SCALE * total / max(1, n)
        loss = np.logaddexp(0, -self.code * margin).sum(axis=1)
        best, second = np.argsort(loss, kind="stable")[:2]
        p = np.exp(loss.min() - loss)
        return self.languages[best], float(p[best] / p.sum()), bool(loss[second] - loss[best] < AMBIGUOUS)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Exhaustive code up to 6 languages, else a dense random code with distinct rows."""
    if k <= 6:
        columns = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.int8).T.reshape(k, -1)
    rng = np.random.default_rng(seed)
    width, best = 15 * int(np.ceil(np.log2(k))), None
    for _ in range(50):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(k, width))
        code = code[:, np.abs(code.sum(axis=0, dtype=int)) < k]
        near = code.astype(int) @ code.T.astype(int)
        worst = (near - np.diag(np.diag(near))).max()
        if best is None or worst < best[0]:
            best = (worst, code)
    return best[1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.zeros(DIM)
            for f in _ngrams(text):
                c += np.bincount(f, minlength=DIM)
            if c.sum():
                sums[lang] = sums.get(lang, 0) + c * (1000 / c.sum())
    for lang, c in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<f8").tobytes()], type=pa.binary())], names=["lang", "counts"])


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on doc_id, text, lang; rows without text or lang are left out.

    The sample takes the rows of each language with the least hash of their doc_id. A
    hash threshold from the language's count narrows it before the ranking, so no
    language's rows are gathered in one task. Ties and repeated rows are harmless.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit("sample"), "doc_id").alias("h")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return Model([], np.zeros((0, 0)), np.zeros((DIM, 0), dtype=np.float32))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * per_language + 50) / n)))])
    u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = rows.where(u < share[F.col("lang")]).withColumn("k", rank).where(F.col("k") <= per_language)
    got = sample.select("lang", "text").repartition(8).mapInArrow(_count, "lang string, counts binary").collect()
    languages = sorted({r["lang"] for r in got})
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 0), dtype=np.int8)
    freq = np.zeros((len(languages), DIM))
    for r in got:
        freq[languages.index(r["lang"])] += np.frombuffer(r["counts"], dtype="<f8")
    freq /= np.maximum(1e-9, freq.sum(axis=1, keepdims=True))
    floor = 0.5 / DIM
    weights = np.zeros((DIM, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        plus, minus = freq[code[:, b] > 0].mean(axis=0), freq[code[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log((plus + floor) / (minus + floor))
    return Model(languages, code, weights)


PREDICTED = "lang_pred string, score double, ambiguous boolean"


def _predict(batches: Iterator[pa.RecordBatch], model: Model, width: int) -> Iterator[pa.RecordBatch]:
    """Columns kept, then the text, then whether it has a letter."""
    for batch in batches:
        texts, letters = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
        got = [model.decode(t) if ok else (UND, 0.0, True) for t, ok in zip(texts, letters, strict=True)]
        cols = list(zip(*got, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: width + 1], *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))],
            names=[*batch.schema.names[: width + 1], "lang_pred", "score", "ambiguous"],
        )


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, its text as ``__text``, lang_pred, score, ambiguous.

    Null text and text without a letter are ``und`` with score 0. Only the text is an
    input. Repeated rows get equal predictions.
    """
    rows = docs.select(*keep, docs["text"].alias("__text"), F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__letter").schema)
    return rows.mapInArrow(partial(_predict, model=model, width=len(keep)), f"{kept}, {PREDICTED}")


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_language_id(spark, sf_dir):
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are held out of training."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"]).drop("__text")
