"""Benchmark decontamination with an FM-index per training shard.

A shard is one bounded batch of documents. Its words become symbols of the benchmark's
vocabulary; a run of known words shorter than the shortest window can't hold an
occurrence and is left out of the index, which is exact. Over the remaining symbols
the shard gets a suffix order, its Burrows-Wheeler transform as a wavelet matrix with
rank sums, and every ``SAMPLE``-th suffix position. All benchmark windows are searched
backwards at once through wavelet ranks; occurrences are located by walking to a
sampled position, and their spans are merged.

The benchmark's windows are counted first. They are taken in blocks of about
``BLOCK_WINDOWS``, one pass over the documents each, so that what is built on the driver
and sent to the executors is bounded however large the benchmark or one of its items is:
long items are cut into parts that share the words of a window less one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import configure, discard, stage, table

WINDOW = 10
#: Windows of one block (about 100 bytes each on a worker) and of one part of an item.
BLOCK_WINDOWS = 100_000
PART_WINDOWS = 10_000
#: Symbols of one index (about 200 bytes each while it is built); longer runs are cut with overlap.
SHARD_WORDS = 1 << 18
SAMPLE = 16
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Phrases:
    """Distinct windows of a block of items, as rows of symbols."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray  # window x WINDOW, right-aligned, 0 before short ones
    lengths: np.ndarray
    items: list[str]  # distinct ids
    first: np.ndarray  # of each window, its place in owner
    owner: np.ndarray  # numbers of items

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows, owners = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            n = min(window, len(ids))
            if n:
                own = np.zeros((len(ids) - n + 1, window), dtype=np.int32)
                own[:, window - n :] = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows.append(own)
                owners.append(np.full(len(own), -1 if item is None else names.setdefault(str(item), len(names)), dtype=np.int64))
        symbols, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        return cls(vocabulary, symbols, (symbols > 0).sum(axis=1), list(names), np.searchsorted(pairs[0], np.arange(len(symbols) + 1)), pairs[1].astype(np.int32))

    def owners(self, window: int) -> list[str]:
        return [self.items[k] for k in self.owner[self.first[window] : self.first[window + 1]].tolist()]


class FMIndex:
    """Full-text index of a symbol sequence (symbols from 0)."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate([seq.astype(np.int64) + 1, [0]])
        n = len(text)
        rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (n + 2) + after
            suffix = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[suffix] = np.concatenate([[0], np.cumsum(key[suffix][1:] != key[suffix][:-1])])
            rank, k = new, 2 * k
            if rank.max() == n - 1 or k >= n:
                break
        self.bwt = text[suffix - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = max(1, int(text.max()).bit_length())
        self.ones, self.zeros = [], []
        level = self.bwt
        for b in reversed(range(self.levels)):
            bits = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bits == 0], level[bits == 1]])
        marked = suffix % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.marked, self.samples, self.n = marked, suffix[marked], n

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position i of the transform."""
        lo = np.zeros_like(i)
        for b, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            up = (symbol >> b) & 1 == 1
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            i = np.where(up, zeros + ones[i], i - ones[i])
        return i - lo

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of symbols that occur, with their suffix intervals."""
        alive = np.arange(len(symbols))
        lo, hi = np.zeros(len(symbols), dtype=np.int64), np.full(len(symbols), self.n, dtype=np.int64)
        for step in range(symbols.shape[1]):
            going = lengths[alive] > step
            c = symbols[alive, symbols.shape[1] - 1 - step] + 1
            known = going & (c < len(self.first) - 1)
            cc = np.where(known, c, 0)
            base = self.first[cc]
            lo2, hi2 = base + self.rank(cc, lo), base + self.rank(cc, hi)
            lo, hi = np.where(going, lo2, lo), np.where(going, hi2, hi)
            keep = np.where(going, known & (lo < hi), True)
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, out, steps = rows.copy(), np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.marked[at[todo]]
            done = todo[here]
            out[done] = self.samples[self.marks[at[done]]] + steps[done]
            todo = todo[~here]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def _runs(docs: list[list[bytes]], phrases: Phrases, least: int, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, first word, symbols) of runs of known words, long ones cut with the overlap that windows need."""
    get = phrases.vocabulary.get
    for d, words in enumerate(docs):
        if len(words) < least:
            continue
        ids = np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words))
        turn = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            for at in range(a, max(a + 1, b - most + 1), SHARD_WORDS):
                if b - at >= least:
                    yield d, at, ids[at : min(b, at + SHARD_WORDS + most - 1)]


def occurrences(docs: list[list[bytes]], phrases: Phrases) -> list[tuple[list, set]]:
    """For each document: merged spans of hit words, and the items."""
    spans: list[list] = [[] for _ in docs]
    found: list[set] = [set() for _ in docs]
    if len(phrases.lengths):
        least, most = int(phrases.lengths.min()), int(phrases.lengths.max())
        shard, size = [], 0
        for run in _runs(docs, phrases, least, most):
            shard.append(run)
            size += len(run[2])
            if size >= SHARD_WORDS:
                _search(shard, phrases, spans, found)
                shard, size = [], 0
        if shard:
            _search(shard, phrases, spans, found)
    return [(_union(s), f) for s, f in zip(spans, found, strict=True)]


def _search(shard: list[tuple[int, int, np.ndarray]], phrases: Phrases, spans: list[list], found: list[set]) -> None:
    """Search all windows in the index of a shard's runs; adds to spans and items."""
    seq = np.concatenate([np.append(ids, 0) for _, _, ids in shard])
    count = np.array([len(ids) + 1 for _, _, ids in shard])
    owner = np.repeat([d for d, _, _ in shard], count)
    place = np.concatenate([np.arange(at, at + len(ids) + 1) for _, at, ids in shard])
    index = FMIndex(seq)
    which, lo, hi = index.search(phrases.symbols, phrases.lengths)
    if not len(which):
        return
    count = hi - lo
    window = np.repeat(which, count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    at = index.locate(rows)
    step = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + phrases.lengths[window], -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step)[: len(seq)] > 0).astype(np.int8), [0]])))
    for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
        spans[owner[a]].append((int(place[a]), int(place[a]) + b - a))
    for d, w in np.unique(np.stack([owner[at], window]), axis=1).T.tolist():
        found[d].update(phrases.owners(w))


def _union(a: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for s, e in sorted(a):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e))
        else:
            merged.append((s, e))
    return merged


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def _scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, keep: int, text_at: int, first: bool, clean: bool) -> Iterator[pa.RecordBatch]:
    pairs = pa.list_(pa.list_(pa.int64()))
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        n_words, spans, items, cleaned = [], [], [], []
        old = [[] for _ in texts] if first else batch.column(keep + 1).to_pylist()
        was = [[] for _ in texts] if first else batch.column(keep + 2).to_pylist()
        docs = [words_of(t) for t in texts]
        for k, (got, found) in enumerate(occurrences(docs, phrases)):
            n_words.append(len(docs[k]))
            spans.append(_union([*map(tuple, old[k]), *got]) if old[k] else got)
            items.append(sorted({*was[k], *found}))
        arrays = [*batch.columns[:keep], pa.array(n_words, type=pa.int64()), pa.array([[list(s) for s in x] for x in spans], type=pairs), pa.array(items, type=pa.list_(pa.string()))]
        names = [*batch.schema.names[:keep], "n_words", "spans", "items"]
        if clean:
            cleaned = [None if t is None else remove_words(t, s) for t, s in zip(texts, spans, strict=True)]
            arrays, names = [*arrays, pa.array(cleaned, type=pa.string())], [*names, "clean_text"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _parts(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items as parts of at most ``most`` windows; neighbours share window - 1 words."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            for k, at in enumerate(range(0, max(1, len(words) - window + 1), most) if words else ()):
                own = words[at : at + most + window - 1]
                rows.append((item, k, max(1, len(own) - window + 1), b" ".join(own).decode("utf-8", "surrogatepass")))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["item", "part", "windows", "text"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], clean: bool = True, block_windows: int = BLOCK_WINDOWS, part_windows: int = PART_WINDOWS
) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus n_words, spans (of word numbers), items and,
    if ``clean``, clean_text without the spans.

    Null texts have no words and stay null. A null item_id counts for spans but names
    no item; repeated items count once. An empty benchmark leaves all as it is. Columns
    not in ``keep`` are dropped, so their names can't clash.
    """
    parts = stage(benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").mapInArrow(
        partial(_parts, window=WINDOW, most=part_windows), "item string, part int, windows long, text string"), "decontam-parts")
    size = parts.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_windows))
    fields = docs.select(*keep).schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = "n_words long, spans array<array<long>>, items array<string>"
    at_text, at_keep = len(keep), len(keep) + 1
    now, before = docs.select(*keep, F.col("text").alias("__text")), []
    for b in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item", "part", "text"), F.lit(blocks)) == b)
        phrases = Phrases.of([(r["item"], r["text"]) for r in own.select("item", "text").distinct().collect()])  # about block_windows
        last = b == blocks - 1
        schema = f"{kept}, __text string, {found}" + (", clean_text string" if clean and last else "")
        now = now.mapInArrow(partial(_scan, phrases=phrases, keep=at_keep, text_at=at_text, first=b == 0, clean=clean and last), schema)
        if not last:
            now = stage(now, "decontam-block")
            discard(*before)
            before = [now]
    discard(parts)
    return now.drop("__text")


def op9_fm_index(spark, sf_dir):
    """Hits of all benchmark windows in all documents.

    Null and empty texts have no words; an item without words is no window; items of one id
    count once; a null doc_id stays null, repeated rows are searched one by one. Without
    items no document is hit.
    """
    configure(spark)
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], clean=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return got.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH RECURSIVE up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, up),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, up),
bn AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS its FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(its), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(its, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
