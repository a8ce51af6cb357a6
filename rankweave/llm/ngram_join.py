"""N-gram Jaccard self-join with signature trees.

A document's set holds the hashes of its distinct word shingles. Equal sets are joined
by their digest first; one row per distinct set goes on.

Routing is exact: two sets of Jaccard similarity ``t`` or more share ``l`` shingles among
the ``n - ceil(t n) + l`` first of each in any one order of all shingles (prefix filter).
The order is rarest first: by the document frequency that a sketch of fixed size counted
over all documents, then by hash. So shingles of boilerplate come last and make no
blocks. Sets that share a prefix shingle meet in the block of the least set that has it.
A set that shares but few shingles with a block, as long texts do by chance, may leave
it as long as it gives up no more than ``SLACK`` of its shingles in all; ``l`` is so
large that two similar sets still meet in some block. Blocks above ``CELL_BYTES`` are cut
into size bands (a pair's sizes differ by the factor ``t`` at most, so neighbours
overlap by one band) and, where a band is still too large, into a grid of cells that
together hold every pair of it. No set is left out.

In a cell a signature tree is built: leaves are sets, a node holds the OR of the token
bitmaps below it, the range of their sizes and the most tokens that bit collisions can
hide. Two nodes are traversed together only if the most overlap they could have reaches
what their sizes need; pairs of leaves that stay are verified on the sets, except those
already in one component. The cells return a forest of links, not all pairs; connected
components follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import configure, discard, stage, table
from ._graph import components
from ._words import ASCII_LOWER, window_hashes, word_hashes

#: Memory of the sets of one side of a cell, by ``_WEIGHT``; a longer single set is a side of its own.
CELL_BYTES = 4 << 20
FAN_OUT = 4
#: Document frequencies are counted by the first bits of the shingle hash.
SKETCH_BITS = 18
_SLICES = 64
#: Percent of its shingles that a set may give up by leaving blocks.
SLACK = 3
#: Memory of the bitmaps of one chunk of node pairs.
CHUNK_BYTES = 8 << 20


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than ``size`` words are one shingle."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))))


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(t n) + l with l = 1 + 2 floor(SLACK n), n at most.

    The first l common shingles of two similar sets, l of the smaller, are in both
    prefixes. Of these a set of m gives up floor(SLACK t m) at most, which is no more
    than floor(SLACK n) for either, n being the smaller size and t m <= n; so one is
    left that both have kept.
    """
    return min(n, n - -(-percent * n // 100) + 1 + 2 * (SLACK * n // 100))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for batch in batches:
        sets = [_bucket(shingle_set(t, size)) for t in batch.column(0).to_pylist()]
        if sets:
            counts += np.bincount(np.concatenate(sets), minlength=len(counts))
    yield _slices(dict(enumerate(counts.reshape(_SLICES, -1))))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, dtype="<i8")
    yield _slices(sums)


def _slices(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts), type=pa.int32()), pa.array([x.astype("<i8").tobytes() for x in parts.values()], type=pa.binary())], names=["slice", "counts"])


def frequency_order(texts: DataFrame, size: int) -> np.ndarray:
    """A byte for each bucket of shingles: the higher, the more documents have one of them.

    Every task sends ``_SLICES`` rows, which are summed as they come; the driver gets the
    sums, 2 MB whatever the input.
    """
    schema = "slice int, counts binary"
    sums = texts.select("text").mapInArrow(partial(_count, size=size), schema).repartition(_SLICES, "slice").mapInArrow(_add, schema).collect()
    counts = np.zeros((_SLICES, (1 << SKETCH_BITS) // _SLICES), dtype=np.int64)
    for r in sums:
        counts[r["slice"]] = np.frombuffer(r["counts"], dtype="<i8")
    return np.minimum(255, np.round(6 * np.log2(counts.ravel() + 1.0))).astype(np.uint8)


def _sets(batches: Iterator[pa.RecordBatch], size: int, percent: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, prefix = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, size)
            n.append(len(s))
            key.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            first = np.argsort(order[_bucket(s)], kind="stable")[: prefix_length(len(s), percent)]
            prefix.append(s[first].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(n, type=pa.int64()), pa.array(key, type=pa.binary()), pa.array(prefix, type=pa.list_(pa.int64()))],
            names=["doc_id", "th", "n", "key", "prefix"],
        )


def _fetch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, packed = [], []
        for nid, key, text in zip(*(batch.column(c).to_pylist() for c in ("nid", "key", "text")), strict=True):
            s = shingle_set(text, size)
            if blake2b(s.tobytes(), digest_size=16).digest() == key:
                node.append(nid)
                packed.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.int64()), pa.array(packed, type=pa.binary())], names=["nid", "packed"])


class SignatureTree:
    """Levels of nodes over sets; level 0 is the sets, in order of size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets], dtype=np.int64)
        bits = 1 << min(17, max(10, int(32 * size.max() - 1).bit_length()))
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            b = (s >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        hidden = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, hidden)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            cut = np.arange(0, len(low), FAN_OUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut),
                np.maximum.reduceat(high, cut), np.maximum.reduceat(hidden, cut),
            ))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a pair of sets with 100 |x n y| >= percent |x u y|."""
        maps, low, high, hidden = self.levels[level]
        small, large = np.minimum(high[a], high[b]), np.maximum(low[a], low[b])
        ok = 100 * small >= percent * large
        if not ok.any():
            return ok
        i, j = a[ok], b[ok]
        shared = np.bitwise_count(maps[i] & maps[j]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[i], high[j]), shared + np.minimum(hidden[i], hidden[j]))
        ok[ok] = (100 + percent) * most >= percent * (low[i] + low[j])
        return ok

    def candidates(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal from the root with itself; pairs of sets i < j, in chunks."""
        top = len(self.levels) - 1
        zero = np.zeros(1, dtype=np.int64)
        todo = [(top, zero, zero)]
        room = max(1, CHUNK_BYTES // (self.levels[0][0].shape[1] * 8))
        while todo:
            level, a, b = todo.pop()
            if len(a) > room:
                for k in reversed(range(0, len(a), room)):
                    todo.append((level, a[k : k + room], b[k : k + room]))
                continue
            ok = self._possible(level, a, b, percent)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            kids, n = np.arange(FAN_OUT), len(self.levels[level - 1][1])
            x = (a[:, None, None] * FAN_OUT + kids[None, :, None] + np.zeros((1, 1, FAN_OUT), dtype=np.int64)).ravel()
            y = (b[:, None, None] * FAN_OUT + kids[None, None, :] + np.zeros((1, FAN_OUT, 1), dtype=np.int64)).ravel()
            keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
            todo.append((level - 1, x[keep], y[keep]))


def links_in(sets: list[np.ndarray], percent: int, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of links that connects all sets that links connect, by place in ``sets``.

    apart: side numbers; if given, only pairs of different sides are looked at.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    own = [sets[i] for i in order]
    side = None if apart is None else np.asarray(apart)[order]
    root = list(range(len(own)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found: list[tuple[int, int]] = []
    for a, b in SignatureTree(own).candidates(percent):
        if side is not None:
            ok = side[a] != side[b]
            a, b = a[ok], b[ok]
        while len(a):
            label = np.fromiter(map(find, range(len(own))), dtype=np.int64, count=len(own))
            ok = label[a] != label[b]
            a, b = a[ok], b[ok]
            for i, j in zip(a[:64].tolist(), b[:64].tolist(), strict=True):
                ri, rj = find(i), find(j)
                if ri == rj:
                    continue
                both = np.concatenate([own[i], own[j]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    root[max(ri, rj)] = min(ri, rj)
                    found.append((int(order[i]), int(order[j])))
            a, b = a[64:], b[64:]
    return found


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of a cell lie together; only one cell is held at a time."""
    cell, members = None, {}

    def solve() -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        ids = list(members)
        sets = [np.frombuffer(members[i][0], dtype=np.uint64) for i in ids]
        sides = [members[i][1] for i in ids]
        return [(ids[i], ids[j]) for i, j in links_in(sets, percent, sides if len(set(sides)) > 1 else None)]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        cols = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["a", "b"])

    for batch in batches:
        pairs: list[tuple[int, int]] = []
        at = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "band", "i", "j")), strict=True))
        for where, nid, sub, packed in zip(at, *(batch.column(c).to_pylist() for c in ("nid", "sub", "packed")), strict=True):
            if where != cell:
                pairs += solve()
                cell, members = where, {}
            members[nid] = (packed, sub)
        yield out(pairs)
    yield out(solve())


#: Bytes that a set of n takes in a cell: hashes, bitmaps, and what holds them.
_WEIGHT = "12 * n + 512"


def _layout(members: DataFrame, percent: int, cell_bytes: int) -> DataFrame:
    """members (hub, nid, n) -> (hub, band, i, j, sub, nid): the cells that hold each set.

    The counts are written first, so that a join meets them through an exchange of its
    own and adaptive execution can split a hub with very many sets.
    """
    width = math.log(100 / percent) * (1 + 1e-7)  # a little wide, so that rounding can't part a pair by two bands
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    sizes = stage(members.groupBy("hub").agg(F.count("*").alias("m"), F.sum(F.expr(_WEIGHT)).alias("w")).where("m > 1").drop("m"), "join-sizes")
    cut = members.join(sizes, "hub").withColumn("band", F.explode(F.when(F.col("w") > cell_bytes, F.array(band, band - 1)).otherwise(F.array(F.lit(-9)))))
    bands = stage(cut.groupBy("hub", "band").agg(F.sum(F.expr(_WEIGHT)).alias("k")), "join-bands")
    grid = F.ceil(F.col("k") / cell_bytes).cast("int")
    dealt = cut.join(bands, ["hub", "band"]).withColumn("g", grid).withColumn("sub", F.pmod(F.xxhash64("nid"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.select("hub", "band", F.least("sub", "o").alias("i"), F.greatest("sub", "o").alias("j"), "sub", "nid")


def similarity_components(docs: DataFrame, size: int, percent: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text), with the
    hash th of its text and the number root of its component (null for an empty set).

    Null and empty texts have empty sets, which link with nothing. Repeated rows and
    equal texts share a component; rows of one doc_id with different texts are linked
    only if their sets are. A null doc_id takes its component's least id (null if none).
    Further columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = frequency_order(own, size)
    sets = stage(own.withColumn("th", F.xxhash64("text")).mapInArrow(
        partial(_sets, size=size, percent=percent, order=order), "doc_id long, th long, n long, key binary, prefix array<long>"), "join-sets")
    nodes = stage(
        sets.where("key is not null").groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.min_by("th", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("th"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .withColumn("nid", F.monotonically_increasing_id()),
        "join-nodes",
    )
    rows = stage(sets.drop("prefix"), "join-rows")
    discard(sets)
    tokens = nodes.select("nid", "n", F.explode("prefix").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.min("nid").alias("hub"), F.max("nid").alias("other")).where("hub < other").select("token", "hub"), "join-shared")
    least = Window.partitionBy("nid").orderBy("c", "hub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = stage(
        tokens.join(shared, "token").groupBy("nid", "hub").agg(F.count("*").alias("c"), F.first("n").alias("n"))
        .withColumn("given_up", F.sum("c").over(least))
        .where(F.col("given_up") * 10_000 > F.col("n") * (SLACK * percent)).select("hub", "nid", "n"),
        "join-members",
    )
    discard(shared)
    cells = stage(_layout(members, percent, cell_bytes), "join-cells")
    discard(members)
    wanted = cells.select("nid").distinct().join(nodes, "nid").select("nid", "key", F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    texts = own.where("text is not null").join(wanted, same).select("nid", "key", "text")
    packed = stage(texts.mapInArrow(partial(_fetch, size=size), "nid long, packed binary"), "join-packed")
    dealt = cells.join(packed, "nid").repartition("hub", "band", "i", "j").sortWithinPartitions("hub", "band", "i", "j")
    links = dealt.select("hub", "band", "i", "j", "sub", "nid", "packed").mapInArrow(partial(_cells, percent=percent), "a long, b long")
    roots = components(links)
    discard(cells, packed)
    named = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = stage(named.join(least, "root").select("key", "root", "component_id"), "join-keys")
    discard(nodes, roots)
    out = rows.select("doc_id", "th", "n", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "th", "root")
    out.reads = (rows, by_key)
    return out


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one row of each group of near-duplicates, and of rows without words.

    The row with the group's least doc_id stays; where several rows have it, one of them.
    """
    groups = similarity_components(docs, size, percent)
    winners = groups.where("n_shingles > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("th").alias("th"))
    no_id = F.lit(-(1 << 63))
    keys = stage(winners.select(F.coalesce("doc_id", no_id).alias("__id"), F.col("th").alias("__th")).distinct(), "join-winners")
    discard(*groups.reads)
    worded = F.coalesce(docs["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__row"), worded.alias("__worded"),
        F.coalesce(docs["doc_id"].cast("long"), no_id).alias("__id"), F.xxhash64(docs["text"]).alias("__th"),
    )
    kept = rows.where("__worded").join(keys, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return kept.select("__row.*").unionByName(rows.where("not __worded").select("__row.*"))


def op5_signature_tree_join(spark, sf_dir):
    """Components of all documents under 4-word shingles and similarity 0.85.

    Null texts and texts without words are empty and stand alone; shorter texts are one
    shingle. Equal sets and repeated rows fall into one component.
    """
    configure(spark)
    return similarity_components(table(spark, sf_dir, "documents"), size=4, percent=85).drop("th", "root")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM w JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY w.doc_id
"""
