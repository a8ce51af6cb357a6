"""Substring deduplication by suffix automata over shared passages.

A window of ``WINDOW`` words goes when the same words start in a document with a
smaller id. Sending automata of the whole corpus to every document would cost the
square of the corpus, so documents are streamed only through automata that can hold
their matches:

1. Every window has an anchor, the least hash among its ``ANCHOR``-word runs. Equal
   windows have equal anchors. One aggregation finds the anchors of two documents or
   more; its least document is the anchor's hub.
2. The passages around shared anchors go to the shard of the hub's section that the
   anchor lies in, so no shard has more than ``SECTION`` anchors. An anchor of more than
   ``SHARD_ROWS`` rows has as many sub-shards as that takes, and its windows are dealt
   among them by their next anchors, the second least hash among their runs and so on:
   neighbours mostly share them and stay one passage, and equal windows meet.
3. In every shard equal passages are one, with their least document: an aggregation with
   map-side combining, so a passage that very many documents share is not gathered. The
   passages are streamed, by least document, through the shard's suffix automaton;
   matching statistics of ``WINDOW`` words or more mark their windows as seen, and then
   the unseen parts are added. Other documents with the same passage lose all of it.

Hashes only route; passages and windows are compared by their words. Spans are then
merged and removed from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import configure, discard, stage, table
from ._words import mix, runs, window_hashes, word_hashes

WINDOW = 13
ANCHOR = 5
#: Anchors of one shard, and rows of one anchor there; together they bound a shard's automaton.
SECTION = 128
SHARD_ROWS = 300
#: A run of windows with one anchor is first window * _RUN + windows, in one number.
_RUN = 64


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of windows with one anchor."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    grams = window_hashes(words, anchor)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, window - anchor + 1):
        other = grams[k : k + n]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(k, k + n), at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return best[first].view(np.int64), first, np.diff(np.append(first, n))


def _emit(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, th, texts = (batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))
        got = [anchors(word_hashes(_raw(t)), window, anchor) for t in texts]
        count = [len(g[0]) for g in got]
        key, first, n = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, dtype=np.int64) for k in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, type=pa.int64()), pa.array(np.repeat(np.array(ids, dtype=np.int64), count)), pa.array(np.repeat(np.array(th, dtype=np.int64), count)),
             pa.array(first * _RUN + n)],
            names=["key", "doc_id", "th", "place"],
        )


def next_anchors(grams: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each run of ``size`` grams one hash of its second least to its ``count``-th next least."""
    least = np.sort(np.lib.stride_tricks.sliding_window_view(grams, size), axis=1)[:, 1 : 1 + count]
    out = np.zeros(len(least), dtype=np.uint64)
    for k in range(least.shape[1]):
        out = mix(out ^ least[:, k])
    return out


SHARD = ("hub", "section", "sub")
PASSAGES = "hub long, section int, sub int, doc_id long, th long, first int, n int, words binary"


def _passages(batches: Iterator[pa.RecordBatch], window: int, anchor: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """Passages for shards: the words of windows in a row that go to one."""
    names = [x.split()[0] for x in PASSAGES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        rows: list[tuple] = []
        for doc, th, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "places")), strict=True):
            raw = _raw(text)
            words, grams = raw.split(), None
            nexts: dict[int, list[int]] = {}
            shards: dict[tuple, list] = {}  # windows in a row, from and to
            for p in places:
                first, n = divmod(p["place"], _RUN)
                subs = p["subs"]
                if subs <= 1:
                    shards.setdefault((p["hub"], p["section"], 0), []).append((first, first + n))
                    continue
                more = 1
                while more < window - anchor and max(2, shard_rows) ** more < subs:  # so many hashes as part that many rows
                    more += 1
                if more not in nexts:
                    grams = window_hashes(word_hashes(raw), anchor) if grams is None else grams
                    nexts[more] = next_anchors(grams, window - anchor + 1, more).tolist()
                own = nexts[more]
                for k in range(first, first + n):
                    shards.setdefault((p["hub"], p["section"], 1 + own[k] % subs), []).append((k, k + 1))
            for at, own in shards.items():
                own.sort()
                reach = 0 if at[2] else window - 1  # of no sub-shard: passages that overlap are one
                spans = [list(own[0])]
                for a, b in own[1:]:
                    if a <= spans[-1][1] + reach:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                rows += [(*at, doc, th, a, b + window - 1 - a, b" ".join(words[a : b + window - 1])) for a, b in spans]
            del shards
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)


class SuffixAutomaton:
    """Suffix automaton of several word sequences (every word sequence inside one of them)."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
                continue
            cur, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
            last = cur

    def statistics(self, words) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        state, run, out = 0, 0, []
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(w)
            if to is None:
                run = 0
            else:
                state, run = to, run + 1
            out.append(run)
        return out


def _stream(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Distinct passages sorted by shard and least document; gives the spans of their words to remove."""
    shard = doc = None
    automaton, waiting = SuffixAutomaton(), []
    for batch in batches:
        out: list[tuple] = []
        for *at, d, wid, packed in zip(*(batch.column(c).to_pylist() for c in (*SHARD, "least", "wid", "words")), strict=True):
            if at != shard:
                shard, doc, automaton, waiting = at, d, SuffixAutomaton(), []
            elif d != doc:
                for w in waiting:
                    automaton.add(w)
                doc, waiting = d, []
            words = packed.split()
            seen = np.array(automaton.statistics(words)) >= window
            out += [(wid, int(a) - window + 1, int(b)) for a, b in zip(*runs(seen), strict=True)]
            fresh = ~seen
            fresh[: window - 1] = False
            for a, b in zip(*runs(fresh), strict=True):
                waiting.append(words[a - window + 1 : b])
        cols = list(zip(*out, strict=True)) or [()] * 3
        kinds = (pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["wid", "start", "stop"])


def _remove(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            words = _raw(text).split()
            kept = words
            if spans:
                gone = np.zeros(len(words), dtype=bool)
                for s in spans:
                    gone[s["start"] : s["stop"]] = True
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *((joined.decode("utf-8", "surrogatepass"),) if keep_text else ())))
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=False)], names=names)


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_rows: int = SHARD_ROWS, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row of ``docs``.

    Null texts have no words. Rows without a doc_id lose nothing and are no reference.
    Rows of one doc_id, repeated or not, are no reference for each other. Further
    columns are ignored.
    """
    if not anchor <= window < anchor + _RUN - 1:
        raise ValueError("the anchor must fit into the window, and their difference into a place")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    rows = stage(own.where("doc_id is not null and text is not null").mapInArrow(
        partial(_emit, window=window, anchor=anchor), "key long, doc_id long, th long, place long"), "substring-anchors")
    shared = rows.groupBy("key").agg(
        F.min("doc_id").alias("hub"), F.max("doc_id").alias("other"), F.min_by("place", "doc_id").alias("at"), F.count("*").alias("m")).where("hub < other")
    section, subs = F.floor(F.col("at") / (_RUN * SECTION)).cast("int"), F.ceil(F.col("m") / shard_rows).cast("int")
    shared = stage(shared.select("key", "hub", section.alias("section"), subs.alias("subs")), "substring-shared")
    places = stage(rows.join(shared, "key").groupBy("doc_id", "th").agg(F.collect_set(F.struct("hub", "section", "subs", "place")).alias("places")), "substring-places")
    discard(rows, shared)
    found = stage(own.join(places, ["doc_id", "th"]).select("doc_id", "th", "text", "places").mapInArrow(partial(_passages, window=window, anchor=anchor, shard_rows=shard_rows), PASSAGES), "substring-passages")
    discard(places)
    distinct = stage(found.groupBy(*SHARD, "words").agg(F.min("doc_id").alias("least")).withColumn("wid", F.monotonically_increasing_id()), "substring-distinct")
    streamed = (
        distinct.repartition(*SHARD).sortWithinPartitions(*SHARD, "least")
        .mapInArrow(partial(_stream, window=window), "wid long, start int, stop int")
        .groupBy("wid").agg(F.collect_list(F.struct("start", "stop")).alias("seen"))
    )
    whose = stage(found.join(distinct, [*SHARD, "words"]).select("doc_id", "th", "first", "n", "least", "wid"), "substring-whose")
    discard(found)
    later = F.col("doc_id") > F.col("least")
    whole = F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop")))
    part = F.transform("seen", lambda s: F.struct((F.col("first") + s["start"]).alias("start"), (F.col("first") + s["stop"]).alias("stop")))
    gone = whose.where(later).select("doc_id", "th", whole.alias("gone")).unionByName(whose.where(~later).join(streamed, "wid").select("doc_id", "th", part.alias("gone")))
    spans = stage(gone.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("gone")).alias("spans")), "substring-spans")
    discard(distinct, whose)
    kept = own.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return kept.mapInArrow(partial(_remove, keep_text=keep_text), schema)


def op3_suffix_automata(spark, sf_dir):
    """Words of all documents without those of windows that a document of a smaller id has too.

    Null texts have no words; a null doc_id loses nothing; ties and repeated rows of one
    id are no reference for each other.
    """
    configure(spark)
    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least USING (k) WHERE first_id < doc_id),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(g), 0) AS r,
  CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(g, p[2])), lambda p: p[1]) END AS ks
  FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""
