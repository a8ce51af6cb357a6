"""Source divergence audit over an integer dictionary of terms.

The documents are counted once, to one row per language, source and term, with its
occurrences and documents. The rows are then dealt by ranges of (language, term) in
UTF-8 order, so that a task holds a slice of the sorted dictionary. There the terms of
enough documents make a sorted array, ``searchsorted`` turns terms into integer ids, and
``bincount`` turns ids into one dense vector a source: a chunk. Ids grow with the UTF-8
order of the terms, also across chunks, so ties are broken by them.

Chunks are bounded in rows, terms and bytes, dense vectors in cells (sources x terms at
once), whatever the number of terms or of sources. What a chunk needs from all others is
a total for each source of its language; it comes by a join on the language.

All arithmetic is on integers, exact up to about 10^13 occurrences of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import configure, discard, stage, table

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Rows of (source, term) that a worker sums up before it passes them on.
REMEMBERED = 300_000
#: Bounds of a chunk: rows (fewer than 2^20, for the ids), and bytes of its terms; and cells of its dense vectors at once.
CHUNK_ROWS = 1 << 18
CHUNK_BYTES = 4 << 20
CELLS = 1 << 20
_PIECE = 1 << 20
#: Terms are runs of ASCII letters and of bytes from 0x80 on; all else parts them.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def term_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 bytes in order, some at a time; only a longer term makes a longer piece."""
    raw, at = raw.translate(_TERMS), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE) if len(raw) > at + _PIECE else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _rows(known: dict, docs: dict) -> pa.RecordBatch:
    terms = [x for group in known.values() for x in group]
    sizes = [(lang, source, len(group)) for (lang, source), group in known.items()]
    label = lambda k: pa.array(np.repeat(np.array([x[k] for x in sizes], dtype=object), [x[2] for x in sizes]), type=pa.string())
    n = pa.array([x for group in known.values() for x in group.values()], type=pa.int64())
    d = pa.array([docs[g][x] for g, group in known.items() for x in group], type=pa.int64())
    return pa.RecordBatch.from_arrays([label(0), label(1), pa.array(terms, type=pa.binary()).cast(pa.string()), n, d], names=["lang", "source", "term", "n", "d"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0
    for batch in batches:
        for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, seen = known.setdefault((lang, source), Counter()), set()
            before = len(own)
            for terms in term_pieces(raw):
                own.update(terms)
                seen.update(terms)
            docs.setdefault((lang, source), Counter()).update(seen)
            held += len(own) - before
            if held > REMEMBERED:
                yield _rows(known, docs)
                known, docs, held = {}, {}, 0
    if held:
        yield _rows(known, docs)


CHUNK = "lang string, chunk long, terms array<string>, sources array<string>, sums array<long>, who binary, ids binary, counts binary"


def _chunk(lang: str, number: int, terms: list[str], sources: list[str], n: list[int], d: list[int], min_docs: int) -> tuple | None:
    """A chunk of one language; ``terms`` are in UTF-8 order. None if no term is kept."""
    every = np.array(sorted(set(terms)), dtype=object)  # code points order as UTF-8 does
    code = np.searchsorted(every, np.array(terms, dtype=object))
    enough = np.bincount(code, weights=d, minlength=len(every)) >= min_docs
    kept = every[enough]
    if not len(kept):
        return None
    stays = enough[code]
    ids = np.searchsorted(kept, every[code[stays]])
    named, who = np.unique(np.array(sources, dtype=object)[stays], return_inverse=True)
    counts = np.array(n, dtype=np.int64)[stays]
    sums = np.bincount(who, weights=counts, minlength=len(named)).astype(np.int64)
    return lang, number, kept.tolist(), named.tolist(), sums.tolist(), who.astype("<i4").tobytes(), ids.astype("<i4").tobytes(), counts.astype("<i8").tobytes()


def _encode(batches: Iterator[pa.RecordBatch], min_docs: int, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language and term to chunks; no term is in two."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in CHUNK.split(", ")]
    held: list[list] = [[], [], [], []]
    lang = last = None
    size = number = 0

    def cut() -> Iterator[pa.RecordBatch]:
        row = _chunk(lang, number, *held, min_docs) if held[0] else None
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        for part, own, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "term", "source", "n", "d")), strict=True):
            if own != lang or row[0] != last:
                if own != lang or len(held[0]) >= chunk_rows or size >= CHUNK_BYTES:
                    yield from cut()
                    held, size, number = [[], [], [], []], 0, (part << 20) + (number & 0xFFFFF) + 1
                lang, last = own, row[0]
                size += len(last)
            for column, value in zip(held, row, strict=True):
                column.append(value)
    yield from cut()


def _p(counts: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + v)), in two steps that stay within 64 bits."""
    high, rest = np.divmod((counts + 1) * 100_000, total + v)
    return 1 + high * (SCALE // 100_000) + rest * (SCALE // 100_000) // (total + v)


COMPARED = "lang string, part string, source string, item string, id long, value long"


def _compare(batches: Iterator[pa.RecordBatch], top: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Chunks, each with the totals of its language, to values of terms and sums of values of pairs."""
    names = [x.split()[0] for x in COMPARED.split(", ")]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    sums: dict[str, tuple[list, np.ndarray]] = {}
    tops: dict[tuple, list] = {}

    def pairs(lang: str, sources: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = len(sources)
        for at in range(0, k, max(1, cells // k)):  # a block of groups at a time
            own = total[at : at + max(1, cells // k)]
            i, j = np.nonzero(np.arange(at, at + len(own))[:, None] != np.arange(k)[None, :])
            name = np.array(sources, dtype=object)
            columns = [[lang] * len(i), ["pair"] * len(i), name[i + at], name[j], [None] * len(i), own[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def terms_of() -> Iterator[pa.RecordBatch]:
        rows = [(lang, "term", source, term, at, -less) for (lang, source), best in tops.items() for less, at, term in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "chunk", "terms", "sources", "who", "ids", "counts", "groups", "v")]
        for lang, chunk, terms, present, who, ids, counts, groups, v in zip(*columns, strict=True):
            sources, totals = [g["source"] for g in groups], np.array([g["n"] for g in groups], dtype=np.int64)[:, None]
            place = {s: k for k, s in enumerate(sources)}
            who = np.array([place[s] for s in present], dtype=np.int64)[np.frombuffer(who, dtype="<i4")]
            ids, counts = np.frombuffer(ids, dtype="<i4").astype(np.int64), np.frombuffer(counts, dtype="<i8")
            divergence = np.zeros((len(sources), len(sources)), dtype=np.int64)
            width = max(1, cells // len(sources))
            for at in range(0, len(terms), width):
                w = min(width, len(terms) - at)
                own = (ids >= at) & (ids < at + w)
                dense = np.bincount(who[own] * w + ids[own] - at, weights=counts[own], minlength=len(sources) * w).astype(np.int64).reshape(-1, w)
                p, q = _p(dense, totals, v), _p(dense.sum(axis=0), int(totals.sum()), v)
                for k in range(len(sources)):
                    found = np.flatnonzero((dense[k] > 0) & (p[k] > q))
                    value = (p[k, found] - q[found]) ** 2 // q[found]
                    best = np.argsort(-value, kind="stable")[:top]  # equal values stay in order of their ids
                    rows = [(-f, (chunk << 20) + at + t, terms[at + t]) for t, f in zip(found[best].tolist(), value[best].tolist(), strict=True)]
                    if rows:
                        tops[lang, sources[k]] = sorted(tops.get((lang, sources[k]), []) + rows)[:top]
                    apart = p - p[k]
                    divergence[:, k] += (apart * apart // p[k]).sum(axis=1)
                if len(tops) * top > REMEMBERED:
                    yield from terms_of()
                    tops.clear()
            if divergence.size > cells:
                yield from pairs(lang, sources, divergence)
            elif lang in sums:
                sums[lang][1][:] += divergence
            else:
                sums[lang] = (sources, divergence)
                if sum(x[1].size for x in sums.values()) > cells:
                    for name, x in sums.items():
                        yield from pairs(name, *x)
                    sums = {}
    yield from terms_of()
    for name, x in sums.items():
        yield from pairs(name, *x)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, cells: int = CELLS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from others of its language, and by which terms.

    Null text, lang and source count as ''. A row is a document, repeated or not; its
    doc_id and further columns are not read. A source without terms has a row a pair, a
    language without kept terms has pairs of value 0, an empty table gives no row. Equal
    values are ranked by their item in UTF-8 order.
    """
    known = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    counted = known.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    counts = stage(counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "divergence-counts")
    slices = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select(
        F.spark_partition_id().cast("long").alias("part"), "lang", "term", "source", "n", "d")
    chunks = stage(slices.mapInArrow(partial(_encode, min_docs=min_docs, chunk_rows=chunk_rows), CHUNK), "divergence-chunks")
    discard(counts)
    own = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n"))
    groups = known.select("lang", "source").distinct().join(own, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    totals = groups.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("groups")).join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    totals = stage(totals, "divergence-totals")
    none, nothing = F.array().cast("array<string>"), F.lit(b"")
    empty = totals.select("lang", F.lit(0).cast("long").alias("chunk"), none.alias("terms"), none.alias("sources"), nothing.alias("who"), nothing.alias("ids"), nothing.alias("counts"))
    rows = chunks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0)).alias("n")).first()["n"] // 4
    joined = chunks.drop("sums").unionByName(empty).join(totals, "lang").coalesce(1 + rows // chunk_rows)  # as many tasks as there are full chunks
    compared = joined.mapInArrow(partial(_compare, top=top, cells=cells), COMPARED)
    compared = stage(compared, "divergence-compared")
    discard(chunks, totals)
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *by)).alias("rank")
    pairs = compared.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = compared.where("part = 'term'").select("lang", "source", "part", "item", "value", rank("id")).where(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", rank("item")).unionByName(terms)


def op13_source_divergence(spark, sf_dir):
    """Divergence of every source of ``documents`` from the others of its language, and its 200 most telling terms.

    Null text, lang and source count as ''; every row is a document, repeated or not; ties
    go by UTF-8 order; an empty table gives no row.
    """
    configure(spark)
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM cells WINDOW s AS (PARTITION BY lang, source)),
lt AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS q FROM lt WINDOW s AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
