"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in groups: sections of input partitions, dealt to as many groups as the
rows need. The number of rows that each group sends to each shard is drawn exactly:
the groups are halved again and again, and of every half the counts are a multivariate
hypergeometric draw from what the whole holds, so row and column sums hold exactly.
Every group permutes its rows locally and deals them out by its row of the matrix, and
every shard permutes what it got. The outcome is a uniform random permutation with
exact shard sizes; no global sort is made.

A shard is permuted in blocks: a second hash deals its rows to blocks, the blocks are
counted, and each is ordered by a third hash behind those before it. Groups and
blocks grow in number with the rows, not in size, so no task grows. The matrix
has ``num_shards`` entries a group, which holds about ``PART_ROWS`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import configure, stage, table

#: Rows that a group or block holds on average, where there are rows for many of them.
PART_ROWS = 1 << 19
#: Few rows are spread over up to ``SPREAD`` parts of at least ``LEAST_ROWS`` on average, to keep cores busy.
SPREAD, LEAST_ROWS = 256, 1 << 12
#: Rows of an input partition that go to a group together.
SECTION = 1 << 12
#: numpy draws from populations below this size only.
_NUMPY_LIMIT = 1_000_000_000


def _parts(rows: int, spread: int = SPREAD) -> int:
    return max(1, -(-rows // PART_ROWS), min(spread, -(-rows // LEAST_ROWS)))


def _chances(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """First count and the probabilities of it and those after it. Counts more than 12 standard
    deviations from the mode have less probability together than a double tells from 0."""
    total = good + bad
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    a, b = max(lo, int(mode - 12 * sd) - 12), min(hi, int(mode + 12 * sd) + 12)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log((good - k) / (k + 1) * ((n - k) / (bad - n + k + 1)))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    return a, p / p.sum()


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Successes among n draws without replacement; any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    first, p = _chances(good, bad, n)
    return first + min(int(np.searchsorted(np.cumsum(p), rng.random())), len(p) - 1)


def _draw(rng: np.random.Generator, held: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n rows drawn from ``held``."""
    out, rest = np.zeros_like(held), int(held.sum())
    for b, here in enumerate(held.tolist()):
        if n == 0:
            break
        rest -= here
        out[b] = _hypergeometric(rng, here, rest, n)
        n -= int(out[b])
    return out


def communication_matrix(group_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Exact counts group x shard; row sums are group_rows, column sums shard_rows."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(group_rows), len(shard_rows)), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(np.array(group_rows, dtype=np.int64))])
    todo = [(0, len(group_rows), np.array(shard_rows, dtype=np.int64))] if group_rows else []
    while todo:
        at, end, held = todo.pop()
        if end - at == 1:
            out[at] = held
            continue
        mid = (at + end) // 2
        own = _draw(rng, held, int(before[mid] - before[at]))
        todo += [(at, mid, own), (mid, end, held - own)]
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_shards(rows: DataFrame, num_shards: int = 24, seed: int = 20240229) -> DataFrame:
    """All columns of ``rows`` nested in ``row``, plus ``shard`` int and ``slot`` long.

    Shard sizes differ by one at most; slots of a shard are 0..size-1 without gaps.
    Nulls, repeated rows and equal texts are rows like any other (each gets its own
    slot); an empty table gives an empty result; names in ``rows`` can't clash, since
    they are nested.
    """
    spark = rows.sparkSession
    tagged = stage(
        rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("rid")), "shard-rows"
    )
    total = tagged.count()
    shard_rows = _even(total, num_shards)
    # the id is the number of the partition, then 33 bits that count its rows: sections don't cross partitions
    group = F.pmod(F.xxhash64(F.lit(seed), F.floor(F.col("rid") / SECTION)), F.lit(_parts(total))).cast("int")
    tagged = tagged.withColumn("grp", group)
    counts = {r["grp"]: r["n"] for r in tagged.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for PART_ROWS rows
    groups = sorted(counts)
    matrix = communication_matrix([counts[g] for g in groups], shard_rows, seed)
    plan = [(g, np.cumsum(line).tolist()) for g, line in zip(groups, matrix, strict=True)]
    ends = spark.createDataFrame(plan, "grp int, ends array<long>")
    local = Window.partitionBy("grp").orderBy(F.xxhash64(F.lit(seed + 1), "rid"), "rid")
    dealt = stage(
        tagged.withColumn("pos", F.row_number().over(local).cast("long") - 1)
        .join(ends, "grp")
        .select(
            "row", "rid", F.size(F.filter("ends", lambda e: e <= F.col("pos"))).alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed + 2), "rid"), F.lit(_parts(shard_rows[0], 16))).cast("int").alias("block"),
        ),
        "shard-dealt",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    again = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 3), "rid"), "rid")
    return (
        dealt.withColumn("at", F.row_number().over(again).cast("long") - 1)
        .join(starts, ["shard", "block"])
        .select("row", "shard", (F.col("start") + F.col("at")).alias("slot"))
    )


def op4_hypergeometric_shards(spark, sf_dir):
    """All documents in 24 shards by the law ``rows``; grown_shard is null."""
    configure(spark)
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle_shards(docs, 24).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
