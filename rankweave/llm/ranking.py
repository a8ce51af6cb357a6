"""Quality scores by Bradley-Terry pairwise ranking.

A text becomes a vector of plain statistics (shape of its words, marks, case, repeats,
compression). Labelled documents make preference pairs, one of label 1 before one of label
0; the logistic loss on the difference of their vectors is least for the weights of a
Bradley-Terry model, and the weighted sum of a vector is its document's strength. The
threshold is a quantile of the strengths: the share of label 0 among all labelled rows.
A score is the logistic function of strength above threshold.

All labelled documents train. They are dealt by hash into blocks of at most ``PER_BLOCK``
documents of a label, and each is in ``PAIRS_PER_DOCUMENT`` pairs or more with documents of
its block; a block is paired within one task, and each of Newton's steps adds up the slopes
of all blocks. Means, cuts and the threshold are exact over all of them. Texts are measured
once, and only the statistics go on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import tasks
from ._common import configure, discard, stage, table
from .quality import repeat_words

#: Bound of a block of pairs, in documents of one label.
PER_BLOCK = 1000
PAIRS_PER_DOCUMENT = 20
#: A statistic is cut at these quantiles of the labelled documents; each cut is a feature beside the statistic.
CUTS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95)
PENALTY = 1e-3
STEPS = 25
#: In how many rows a task tells its sums of slopes.
_BANDS = 8
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CLASSES = {
    "space": b" \t\n\x0b\x0c\r", "line": b"\n", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "stop": b".?", "comma": b",;:",
    "shout": b"!", "mark": b"#*$%&", "bar": b"|<>", "other": bytes(b for b in range(33, 127) if not (chr(b).isalnum() or chr(b) in ".?,;:!#*$%&|<>")), "control": bytes([*range(9), *range(14, 32), 127]),
}
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", *_CLASSES, "wide", "distinct", "commonest", "stutter", "doubled_lines", "repeated", "ratio", "bare_words", "marked_words", "words_a_line",
)


def statistics(text: str | None, packer: zstandard.ZstdCompressor) -> list[float]:
    """``STATISTICS`` of a whole text; those of an empty one are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(raw), len(words)
    tally = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = [float(tally[np.frombuffer(c, dtype=np.uint8)].sum()) / size for c in _CLASSES.values()]
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = marked = 0
    for word, k in counts.items():
        bare += k * (not any(b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in word[:64]))
        marked += k * (word[-1] in b"#*$%&|<>!")
    return [
        float(np.log1p(n)), float(np.log1p(size)), min(50.0, (size - tally[list(_CLASSES["space"])].sum()) / n), *share, float(tally[128:].sum()) / size,
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines),
        repeat_words(words) / n, len(packer.compress(raw)) / size, bare / n, marked / n, float(np.log1p(n / len(lines))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray  # statistic x cut
    weights: np.ndarray
    threshold: float

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Features: each statistic in units of its spread, and whether it is above each of its cuts."""
        plain = np.clip((rows - self.mean) / self.spread, -4, 4)
        return np.concatenate([plain, (rows[:, :, None] > self.cuts[None]).reshape(len(rows), -1)], axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), self.threshold)
        return 1 / (1 + np.exp(np.clip(self.threshold - self.vectors(rows) @ self.weights, -500, 500)))


def pairs(n_good: int, n_poor: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the preferred and of the other document: each document in ``PAIRS_PER_DOCUMENT`` pairs or more."""
    rng, n = np.random.default_rng(seed), PAIRS_PER_DOCUMENT * max(n_good, n_poor)
    deal = lambda k: np.concatenate([rng.permutation(k) for _ in range(-(-n // k))])[:n]
    return deal(n_good), deal(n_poor)


def _slopes(difference: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over pairs: the bend of the logistic loss, then a row of its slope, then a row that starts with the number of pairs."""
    p = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))
    count = np.zeros(len(w))
    count[0] = len(p)
    return np.vstack([(difference * (p * (1 - p))[:, None]).T @ difference, p @ difference, count])


def _least(width: int, slopes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights of the least mean logistic loss with its penalty, by Newton's steps."""
    w = np.zeros(width)
    for _ in range(STEPS):
        total = slopes(w)
        n = total[-1, 0]
        step = np.linalg.solve(total[:-2] / n + PENALTY * np.eye(width), PENALTY * w - total[-2] / n)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(good: np.ndarray, poor: np.ndarray, share_poor: float) -> Model:
    """A model of the statistics of preferred and other documents in memory, one of each at least: what ``learn`` makes of one block."""
    rows = np.concatenate([good, poor])
    spread = rows.std(axis=0)
    model = Model(rows.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), np.quantile(rows, CUTS, axis=0).T, np.zeros(0), 0.0)
    x, y = model.vectors(good), model.vectors(poor)
    a, b = pairs(len(good), len(poor))
    difference = x[a] - y[b]
    w = model.weights = _least(difference.shape[1], partial(_slopes, difference))
    strength = np.concatenate([x @ w, y @ w])
    weight = np.concatenate([np.full(len(x), (1 - share_poor) / len(x)), np.full(len(y), share_poor / len(y))])
    order = np.argsort(strength, kind="stable")
    below = min(int(np.searchsorted(np.cumsum(weight[order]), share_poor - 1e-9)), len(order) - 2)
    model.threshold = float((strength[order[below]] + strength[order[below + 1]]) / 2)
    return model


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _digits(batches: Iterator[pa.RecordBatch], shift: int, wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the 16 bits at ``shift`` of each place's values, of those whose higher bits are wanted; bits are made to sort as the values do."""
    for batch in batches:
        bits = np.ascontiguousarray(_matrix(batch.column(0), len(wanted)) + 0.0).view(np.int64)
        codes = bits.view(np.uint64) ^ ((bits >> 63).view(np.uint64) | np.uint64(1 << 63))
        for place, higher in enumerate(wanted):
            code = codes[:, place] >> np.uint64(shift)
            head = (code >> np.uint64(16)).astype(np.int64) if shift < 48 else np.zeros(len(code), dtype=np.int64)
            keep = np.isin(head, higher)
            pair, n = np.unique(np.stack([head[keep], (code[keep] & np.uint64(0xFFFF)).astype(np.int64)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), place, dtype=np.int32)), pa.array(pair[0]), pa.array(pair[1]), pa.array(n.astype(np.int64))],
                                             names=["place", "head", "digit", "n"])


def order_statistics(rows: DataFrame, column: str, width: int, ranks: list[int]) -> np.ndarray:
    """The values at ``ranks`` (from 0) of each place of an array column of ``width`` doubles, exact: place x rank.

    Four passes, each of which finds 16 more bits of every value asked for from counts of
    at most 65,536 rows a value; nothing is sorted as a whole.
    """
    spark = rows.sparkSession
    asked = [(place, k, 0, rank) for place in range(width) for k, rank in enumerate(ranks)]
    for shift in (48, 32, 16, 0):
        wanted = [np.unique([head for at, _, head, _ in asked if at == place]) for place in range(width)]
        counts = rows.select(column).mapInArrow(partial(_digits, shift=shift, wanted=wanted), "place int, head long, digit long, n long")
        upto = F.sum("n").over(Window.partitionBy("place", "head").orderBy("digit"))
        running = counts.groupBy("place", "head", "digit").agg(F.sum("n").alias("n")).withColumn("upto", upto)
        ask = F.broadcast(spark.createDataFrame(asked, "place int, k int, head long, rank long"))  # width x ranks rows
        found = running.join(ask, ["place", "head"]).where("upto - n <= rank and rank < upto")
        asked = [tuple(r) for r in found.select("place", "k", F.shiftleft("head", 16).bitwiseOR(F.col("digit")).alias("head"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()]
    out = np.zeros((width, len(ranks)))
    for place, k, code, _ in asked:
        bits = np.int64(code).view(np.uint64)
        out[place, k] = (bits ^ (np.uint64(1 << 63) if bits >> np.uint64(63) else ~np.uint64(0))).view(np.float64)
    return out


def _in_blocks(known: DataFrame, n: dict[int, int], per_label: int) -> DataFrame:
    """A row a block: its (label, number, statistics). Documents are numbered by hash, each label for itself; the rarer label stands in several blocks where it has fewer documents than there are blocks."""
    spark = known.sparkSession
    count = -(-max(n.values()) // per_label)
    hashed = known.withColumn("h", F.xxhash64(F.lit("pairwise"), "doc_id"))
    dealt = hashed.withColumn("bucket", F.pmod("h", F.lit(-(-sum(n.values()) // 4096))))
    at = F.row_number().over(Window.partitionBy("q", "bucket").orderBy("h", "doc_id"))
    earlier = Window.partitionBy("q").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("q", "bucket").agg(F.count("*").alias("c")).select("q", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    number = dealt.withColumn("at", at).join(before, ["q", "bucket"]).withColumn("number", F.col("before") + F.col("at") - 1)
    place = lambda q: F.array(F.col("number") % count) if n[q] >= count else F.sequence("number", F.lit(count - 1).cast("long"), F.lit(n[q]).cast("long"))
    rows = number.select("q", "number", "statistics", F.explode(F.when(F.col("q") == 0, place(0)).otherwise(place(1))).alias("block"))
    whole = F.sort_array(F.collect_list(F.struct("q", "number", "statistics"))).alias("members")
    return rows.repartition(min(count, tasks(spark)), "block").groupBy("block").agg(whole)


def _block_slopes(batches: Iterator[pa.RecordBatch], model: Model, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_slopes`` of a task's blocks, in bands of rows."""
    total = np.zeros((len(w) + 2, len(w)))
    for batch in batches:
        for block, members in zip(batch.column("block").to_pylist(), batch.column("members"), strict=True):
            own = members.values
            good, x = own.field("q").to_numpy(zero_copy_only=False) == 1, model.vectors(_matrix(own.field("statistics"), len(STATISTICS)))
            a, b = pairs(int(good.sum()), int((~good).sum()), 12 + block)
            total += _slopes(x[good][a] - x[~good][b], w)
    bands = np.array_split(total, _BANDS)
    yield pa.RecordBatch.from_arrays([pa.array(range(_BANDS), type=pa.int32()), pa.array([b.ravel() for b in bands], type=pa.list_(pa.float64()))], names=["band", "sums"])


def _added(table: pa.Table) -> pa.Table:
    sums = np.sum([x.values.to_numpy() for x in table.column("sums")], axis=0)
    return pa.table({"band": table.column("band")[:1], "sums": pa.array([sums], type=pa.list_(pa.float64()))})


MEASURED = "statistics array<double>"


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Columns kept, then the text, instead of which its statistics go on."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        rows = [statistics(x, packer) for x in batch.column(width).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows, type=pa.list_(pa.float64()))], names=[*batch.schema.names[:width], "statistics"])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the ``statistics`` of each row's text."""
    rows = docs.select(*keep, docs["text"].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return rows.mapInArrow(partial(_measure, width=len(keep)), f"{kept}, {MEASURED}")


def _told(labels: DataFrame) -> DataFrame:
    """(doc_id, q) of the documents that have one label, 0 or 1."""
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("other"))
    return told.where("q = other").select("doc_id", F.col("q").cast("int").alias("q"))


def learn(rows: DataFrame, labels: DataFrame, per_label: int = PER_BLOCK) -> Model:
    """Fit on all rows (doc_id, statistics) that ``labels`` (doc_id, quality 0 or 1) has, in blocks of ``per_label`` documents of a label.

    A doc_id with both labels, a null one and other labels are left out. Of several rows
    of a doc_id one is taken. With one label only, the score is that label for every text;
    with none it is 0.5.
    """
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "statistics").join(_told(labels), "doc_id")
    known = stage(own.groupBy("doc_id", "q").agg(F.min("statistics").alias("statistics")), "ranking-known")
    n = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(n) < 2:
        discard(known)
        return Model(*[np.zeros(0)] * 4, threshold=float(next(iter(n), 0.5)))
    width, total = len(STATISTICS), n[0] + n[1]
    each = [F.col("statistics")[k] for k in range(width)]
    moments = np.array(known.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first(), dtype=float)
    spread = moments[width:]
    at = np.array(CUTS) * (total - 1)
    low = np.floor(at).astype(int)
    found = order_statistics(known, "statistics", width, [*low.tolist(), *np.minimum(low + 1, total - 1).tolist()])
    a, b = found[:, : len(CUTS)], found[:, len(CUTS) :]
    model = Model(moments[:width], np.where(spread > 1e-9, spread, 1.0), a + (b - a) * (at - low), np.zeros(0), 0.0)
    blocks = stage(_in_blocks(known, n, per_label), "ranking-blocks")

    def slopes(w: np.ndarray) -> np.ndarray:
        parts = blocks.mapInArrow(partial(_block_slopes, model=model, w=w), "band int, sums array<double>")
        got = parts.groupBy("band").applyInArrow(_added, "band int, sums array<double>").orderBy("band").collect()  # one matrix
        return np.concatenate([np.array(r["sums"]) for r in got]).reshape(-1, len(w))

    model.weights = _least(width * (1 + len(CUTS)), slopes)
    strengths = stage(known.select("statistics").mapInArrow(partial(_strength, model=model), "strength array<double>"), "ranking-strengths")
    model.threshold = float(order_statistics(strengths, "strength", 1, [n[0] - 1, n[0]]).mean())
    discard(known, blocks, strengths)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_BLOCK) -> Model:
    """``learn`` from the text of documents (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_told(labels).select("doc_id"), "doc_id", "left_semi")
    return learn(measured(own, ["doc_id"]), labels, per_label)


def _strength(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = model.vectors(_matrix(batch.column(0), len(STATISTICS))) @ model.weights
        yield pa.RecordBatch.from_arrays([pa.array(x[:, None].tolist(), type=pa.list_(pa.float64()))], names=["strength"])


def _score(batches: Iterator[pa.RecordBatch], model: Model, width: int) -> Iterator[pa.RecordBatch]:
    """Columns kept, then the statistics, which do not go on."""
    for batch in batches:
        score = model.scores(_matrix(batch.column(width), len(STATISTICS)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:width], pa.array(score, type=pa.float64()), pa.array((score >= 0.5).astype(np.int32), type=pa.int32())],
            names=[*batch.schema.names[:width], "score", "predicted"])


def rated(rows: DataFrame, model: Model) -> DataFrame:
    """``measured`` rows with score and predicted instead of their statistics."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(partial(_score, model=model, width=len(rows.columns) - 1), f"{kept}, score double, predicted int")


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, score and predicted, of each row; only the text is an input.

    Null and empty texts have one score, that of zero statistics; equal texts have equal scores.
    """
    return rated(measured(docs, keep), model)


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op12_bradley_terry(spark, sf_dir):
    """Quality score of every document; labels of rows with crc32(doc_id) mod 3 = 1 are held out of training.

    Null and empty texts are scored as texts without words; a null doc_id is scored and
    never trains; repeated rows are scored one by one.
    """
    configure(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    rows = stage(measured(docs, ["doc_id", "held_out"]), "ranking-measured")
    return rated(rows, learn(rows.where("not held_out"), table(spark, sf_dir, "labels")))
