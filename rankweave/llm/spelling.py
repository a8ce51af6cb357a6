"""Spelling variants by errata tries.

Words that are one edit apart are found in tries. At every node the heaviest child
subtree stays as it is; the light ones are merged into one with their first character
replaced by any, and laid over the heavy one: terminals that coincide are one replaced
character apart. Each light subtree, one character skipped, is laid over the children of
its node, and the heavy one over the light ones: terminals that coincide are one skipped
character apart. A merge or overlay walks what the smaller side shares with the larger
(small to large), and a merge shares all else with the tries it came from, so a word is walked once a light edge above it.

A trie of all words would be one task. Words are instead dealt to tries by what an edit
leaves alone: where an edit lies in a window of positions, all before the window and all
after it is equal in both words. Two windows cover a word. A trie that would be larger
than ``TRIE_CHARS`` has its window halved, again and again down to single positions,
where a trie holds one character or two a word; so no trie grows with the corpus, and no
pair is lost. An edit's position is that of the last of a run of equal characters, and a
trie gives only edits inside its window, so every pair is found exactly once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import configure, discard, stage, table

MIN_LENGTH = 7
MIN_COUNT = 2
#: A word's form is so many times as frequent.
RATIO = 10
#: One occurrence in so many is garbled, by its checksum.
GARBLED = 31
#: Characters of a trie, over which its window is halved.
TRIE_CHARS = 1 << 17
#: Words that a worker counts before it passes them on.
REMEMBERED = 300_000
_PIECE = 1 << 20
#: Latin-1 letters: A-Z to lower case, all else but a-z and from 0xC0 on to spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The runs of letters in order, in Latin-1, some at a time."""
    raw, at = text.encode("latin-1", "replace").translate(_LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE) if len(raw) > at + _PIECE else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def garbled(start: int, run: bytes) -> bytes:
    """The run, or without one character where its checksum says so; ``start`` is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run if h % GARBLED else run[: h % len(run)] + run[h % len(run) + 1 :]


def _rows(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") for w in words], type=pa.string()), pa.array(words.values(), type=pa.int64())], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch], min_length: int) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start, own = zlib.crc32(f"{doc_id}:".encode()), Counter()
            for runs in runs_of(text):
                own.update([r for r in runs if len(r) >= min_length])
            for run, n in own.items():
                word = garbled(start, run)
                if len(word) >= min_length:
                    words[word] += n
            if len(words) > REMEMBERED:
                yield _rows(words)
                words = Counter()
    if words:
        yield _rows(words)


# A node is [children by character, terminals, words below and at it].


def build(words: list[str]) -> list:
    root = [{}, (), 0]
    for i, word in enumerate(words):
        node = root
        node[2] += 1
        for c in word:
            kids = node[0]
            node = kids.get(c)
            if node is None:
                node = kids[c] = [{}, (), 0]
            node[2] += 1
        node[1] = (i,)
    return root


def overlay(a: list, b: list) -> Iterator[tuple[tuple, tuple]]:
    """Terminals of the two tries that coincide."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a[1] and b[1]:
            yield a[1], b[1]
        small, large = a[0], b[0]
        if len(small) <= len(large):
            stack += [(small[c], large[c]) for c in small if c in large]
        else:
            stack += [(small[c], large[c]) for c in large if c in small]


def merge(a: list, b: list, met: list) -> list:
    """The trie of both, which shares what only one has; terminals that coincide go to ``met``."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    out = [dict(a[0]), a[1] + b[1], a[2] + b[2]]
    if a[1] and b[1]:
        met.append((a[1], b[1]))
    stack = [(out, b)]
    while stack:
        into, small = stack.pop()
        for c, kid in small[0].items():
            own = into[0].get(c)
            if own is None:
                into[0][c] = kid
                continue
            if len(own[0]) < len(kid[0]):
                own, kid = kid, own
            if own[1] and kid[1]:
                met.append((own[1], kid[1]))
            into[0][c] = new = [dict(own[0]), own[1] + kid[1], own[2] + kid[2]]
            stack.append((new, kid))
    return out


def one_edit_pairs(words: list[str], window: int) -> Iterator[tuple[tuple, tuple, bool]]:
    """Groups of numbers of ``words`` (distinct) one edit apart at a position below ``window``, and whether it is a replacement.

    An edit that skips one of several equal characters in a row is one at the last of
    them. Every pair is in one group pair, once.
    """
    stack = [(build(words), 0)]
    while stack:
        node, depth = stack.pop()
        kids = node[0]
        if depth >= window or node[2] < 2:
            continue
        stack += [(kid, depth + 1) for kid in kids.values()]
        if node[1]:
            for kid in kids.values():
                if kid[1]:
                    yield kid[1], node[1], False
        if len(kids) < 2:
            continue
        top = max(kids, key=lambda c: kids[c][2])
        heavy, light, met = kids[top], None, []
        for c, kid in kids.items():
            if c == top:
                continue
            light = kid if light is None else merge(light, kid, met)
            for r, below in kid[0].items():  # c is skipped
                if r != c and r in kids:
                    for a, b in overlay(below, kids[r]):
                        yield a, b, False
            if c in heavy[0]:  # the heavy character is skipped
                for a, b in overlay(heavy[0][c], kid):
                    yield a, b, False
        for a, b in met:
            yield a, b, True
        for a, b in overlay(light, heavy):
            yield a, b, True


NEAR = "word string, n_near long, near_n long, near string"


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per trie and word with near words there: how many, and the most frequent (least in code points among equals)."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in NEAR.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        lists = batch.column(4)
        words, counts = lists.flatten().field("word").to_pylist(), lists.flatten().field("n").to_pylist()
        at = 0
        for m, lo, hi, size in zip(*(batch.column(c).to_pylist() for c in range(3)), (len(x) for x in lists), strict=True):
            own, n = words[at : at + size], counts[at : at + size]
            at += size
            end = max(0, m - hi)
            found: dict[int, list] = {}
            for left, right, replaced in one_edit_pairs([w[lo : len(w) - end] for w in own], hi - lo):
                for i in left:
                    for j in right:
                        if replaced and (len(own[i]) > m or len(own[j]) > m):
                            continue  # of a longer class
                        for x, y in ((i, j), (j, i)):
                            best = found.setdefault(x, [0, 0, ""])
                            best[0] += 1
                            if n[y] > best[1] or n[y] == best[1] and own[y] < best[2]:
                                best[1], best[2] = n[y], own[y]
            rows += [(own[x], *best) for x, best in found.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _windows(words: DataFrame, min_length: int) -> DataFrame:
    """(word, n, m, lo, hi): two windows a class; class m has the words of m characters and of one more."""
    length = F.length("word")
    classes = F.array_distinct(F.array(F.greatest(length - 1, F.lit(min_length)), length))
    each = words.select("word", "n", F.explode(classes).alias("m"))
    return _halved(each.withColumn("lo", F.lit(0)).withColumn("hi", F.col("m") + 1))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return rows.select("word", "n", "m", F.explode(parts).alias("w")).select("word", "n", "m", "w.lo", "w.hi")


def _fixed() -> Column:
    """What stands before and after the window."""
    end = F.greatest(F.lit(0), F.col("m") - F.col("hi"))
    return F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", F.length("word") - end + 1, end))


TRIE = ("m", "lo", "hi", "fixed")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """(word, n_near, near_n, near) of each word (word, n; distinct) that has near words, written."""
    found, rows = None, _windows(words, min_length)
    waiting = None
    while True:
        keyed = rows.withColumn("fixed", _fixed())
        inside = F.length("word") - F.length("fixed") + 1
        large = stage(keyed.groupBy(*TRIE).agg(F.sum(inside).alias("chars")).where((F.col("chars") > trie_chars) & (F.col("hi") - F.col("lo") > 1)).select(*TRIE), "spelling-large")
        last = large.isEmpty()
        small = keyed if last else keyed.join(large, list(TRIE), "left_anti")
        tries = small.groupBy(*TRIE).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        part = stage(tries.select("m", "lo", "hi", "fixed", "words").mapInArrow(_tries, NEAR), "spelling-near")
        found = [*(found or []), part]
        rest = None if last else stage(_halved(keyed.join(large, list(TRIE), "left_semi")), "spelling-rows")
        discard(*([waiting] if waiting is not None else []), large)
        if last:
            break
        rows = waiting = rest
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    out = stage(every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near"), "spelling-best")
    discard(*found)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word that has a form, by doubling: every step is twice as far as the one before.

    A form is ``RATIO`` times as frequent as its word, so a path has fewer steps than
    counts have digits.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        there = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = there.select("word", "root")
        now.staged_at = there.staged_at
        if there.where("moved").isEmpty():
            return now


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the garbled runs of letters of all texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    known = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), text.alias("text"))
    counted = known.mapInArrow(partial(_count, min_length=min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def group_spellings(words: DataFrame, min_length: int = MIN_LENGTH, ratio: int = RATIO, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of ``words`` (word, n; distinct, of ``min_length`` characters or more).

    Among near words of equal frequency the least in code points is the form. Words may
    be of any characters but spaces.
    """
    near = near_words(words, min_length, trie_chars)
    told = near.join(words, "word").where(F.col("near_n") >= F.col("n") * ratio).select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n"))
    told = stage(told, "spelling-forms")
    rows = words.join(near.select("word", "n_near"), "word", "left").join(told, "word", "left").join(_roots(told), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_errata_trie(spark, sf_dir):
    """Spelling variants among the words of all documents, some of which are garbled by their checksum.

    Null and empty texts have no words; a null doc_id counts as '' in the checksum;
    repeated rows count again. Ties go to the least word in code points.
    """
    configure(spark)
    return group_spellings(stage(count_words(table(spark, sf_dir, "documents")), "spelling-words"))


OP11_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents),
low AS (SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM runs WHERE length(r) >= 7 GROUP BY 1, 2),
bytes AS (SELECT r, n, flatten(list_transform(string_split(d || ':' || r, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM low),
sums AS (SELECT r, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min({'near': near, 'n': n}, {'a': -n, 'b': near}) AS b FROM pairs GROUP BY word),
told AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * words.n THEN b.near END AS form, CASE WHEN b.n >= 10 * words.n THEN b.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, form AS next FROM told UNION ALL SELECT path.word, path.next, told.form FROM path JOIN told ON told.word = path.next)
SELECT told.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM told JOIN path ON path.word = told.word AND path.next IS NULL
"""
