"""Best-fit packing planned over a length histogram.

Documents are cut into pieces of at most ``max_len`` tokens. Best-fit decreasing then
runs over the *counts* per length, not over documents: open sequences with equal room
are one group, and a length fills whole groups at a time, so the plan's size depends
on ``max_len`` alone. The plan lists segments: "pieces of length L with ranks from a
on, k to a sequence, go to sequences from s on at offset o". Every piece learns its
rank among the pieces of its length and takes its planned slot.

Ranks come in two steps so that a length that a third of all pieces share is never
gathered: a running number within (input partition, length), plus the count of that
length in earlier partitions.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import configure, stage, table

MAX_LEN = 4096
EOS = 1
#: Chunks between white space whose ids a worker remembers, in each of two generations:
#: a full one replaces the older, from which chunks in use come back. Longer chunks than
#: ``CACHE_CHARS`` are encoded each time, so the memory is bounded in bytes too.
CACHE_CHUNKS = 500_000
CACHE_CHARS = 40
#: Texts are looked up together until they have so many characters.
GROUP_CHARS = 1 << 20
#: Chunks that are encoded in one call.
ASK_CHUNKS = 50_000
_SHIFT = 44
_cache: dict[str, bytes] = {}
_older: dict[str, bytes] = {}
#: By path: the tokenizer, and whether chunks may be encoded apart.
_tokenizers: dict = {}
#: White space to str.split() but not to the tokenizers; such texts are encoded whole.
_MARKS = ".,;:!?"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _tokenizers[path] = tok, _parts_at_space(tok)
        _cache.clear()
        _older.clear()
    return _tokenizers[path]


def _parts_at_space(tok) -> bool:
    """Whether the tokenizer parts text at white space and drops it, folds Latin-1
    capitals, and parts letters from marks; probed on every Latin-1 character."""
    ids = lambda x: tok.encode(x, add_special_tokens=False).ids
    seen = [chr(c) for c in range(0x21, 0x100) if chr(c) not in _ODD and not chr(c).isspace()]
    probes = [f"{c}a \t{c}\n\nB{c}  {c}{c} d" for c in seen] + [" a", "a ", "\n", "a  b"]
    chunks = all(ids(p) == [i for c in p.lower().split() for i in ids(c)] for p in probes)
    return chunks and all(ids(f"word{m}{n}") == ids("word") + ids(m + n) for m in _MARKS for n in ["", *_MARKS])


def _le(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _learn(chunks: set[str], tok, remember: int) -> dict[str, bytes]:
    """Ids of chunks that are not in the memory, which keeps as many as it holds.

    Letters with marks after them are two pre-tokens, so the ids of the letters come
    from the memory too.
    """
    if len(_cache) + len(chunks) > remember:
        _older.clear()
        _older.update(_cache)
        _cache.clear()
    ids = {c: i for c in chunks if (i := _older.get(c)) is not None}
    ask, parts = [], []
    for c in chunks.difference(ids) if ids else chunks:
        base = c.rstrip(_MARKS)
        if len(base) < len(c) and base.isalpha() and c.isascii():
            parts.append((c, base, c[len(base) :]))
        else:
            ask.append(c)
    bases = {x for _, base, marks in parts for x in (base, marks)}.difference(ids, ask)
    for x in bases:
        i = _cache.get(x) or _older.get(x)
        if i is None:
            ask.append(x)
        else:
            ids[x] = i
    for at in range(0, len(ask), ASK_CHUNKS):
        own = ask[at : at + ASK_CHUNKS]
        for c, e in zip(own, tok.encode_batch_fast(own, add_special_tokens=False), strict=True):
            ids[c] = _le(e.ids)
    for c, base, marks in parts:
        ids[c] = ids[base] + ids[marks]
    short = (x for x in ids.items() if len(x[0]) <= CACHE_CHARS)
    _cache.update(islice(short, max(0, remember - len(_cache))))
    return ids


def _chunks(text: str) -> list[str]:
    """White-space-delimited chunks; Latin-1 texts are lower-cased, as the tokenizer does."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.split()


def encode(texts: list[str], path: str, remember: int | None = None) -> list[bytes]:
    """Little-endian 32-bit ids of each text.

    Where the tokenizer never joins text across white space, the ids of a text are
    those of its white-space-delimited chunks in order; each distinct chunk is encoded
    once per worker, as long as it is remembered. Other tokenizers get whole texts.
    """
    tok, apart = _tokenizer(path)
    out: list[bytes] = []
    group: list[list[str]] = []
    size = 0
    for text in texts:
        odd = not apart or any(c in text for c in _ODD)
        if not odd:
            group.append(_chunks(text))
            size += len(text)
        if odd or size >= GROUP_CHARS:
            out += _joined(group, tok, remember or CACHE_CHUNKS)
            group, size = [], 0
        if odd:
            out.append(_le(tok.encode(text, add_special_tokens=False).ids))
    return out + _joined(group, tok, remember or CACHE_CHUNKS)


def _joined(group: list[list[str]], tok, remember: int) -> list[bytes]:
    """Ids of each text of a group, whose chunks are looked up, and learned, once for all."""
    new = {c for chunks in group for c in chunks if c not in _cache}
    learned = _learn(new, tok, remember) if new else {}
    out = []
    for chunks in group:
        try:
            out.append(b"".join(map(_cache.__getitem__, chunks)))
        except KeyError:  # the memory holds no long chunks; and what it held before the group may be the older part now
            out.append(b"".join(learned[c] if c in learned else _cache[c] if c in _cache else _older[c] for c in chunks))
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, max_len: int, eos: int, keep_ids: bool, remember: int | None) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    seen = np.zeros(max_len + 1, dtype=np.int64).tolist()
    tail, width = _le([eos]), 4 * max_len
    for batch in batches:
        ids = encode([x or "" for x in batch.column(1).to_pylist()], path, remember)
        cols: list[list] = [[] for _ in range(8)]
        for doc, raw in zip(batch.column(0).to_pylist(), ids, strict=True):
            raw += tail
            for k, at in enumerate(range(0, len(raw), width)):
                own = raw[at : at + width]
                n = len(own) // 4
                for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(own), part, seen[n], own), strict=True):
                    c.append(v)
                seen[n] += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=False)]
        names = [x.split()[0] for x in PIECES.split(", ")]
        if keep_ids:
            arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in cols[7]], type=pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def plan(counts: dict[int, int], max_len: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns segments (length, first rank, per sequence, first sequence, offset) and the
    number of sequences. A sequence takes as many pieces of a length as fit, since
    after each it is still the tightest.
    """
    segments: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []
    made = 0

    def put(r: int, start: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                insort(open_rooms, r)
            room[r].append((start, n))

    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(open_rooms, length)
            if i < len(open_rooms):
                r = open_rooms[i]
                start, n = room[r].pop()
                if not room[r]:
                    del room[r], open_rooms[i]
            else:
                r = max_len
                start, n = made, -(-left // (max_len // length))
                made += n
            k = r // length
            full = min(n, left // k)
            rest = min(left - full * k, k) if full < n else 0
            if full:
                segments.append((length, rank, k, start, max_len - r))
                put(r - k * length, start, full)
            if rest:
                segments.append((length, rank + full * k, rest, start + full, max_len - r))
                put(r - rest * length, start + full, 1)
            put(r, start + full + bool(rest), n - full - bool(rest))
            rank += full * k + rest
            left -= full * k + rest
    return segments, made


def _slots(batches: Iterator[pa.RecordBatch], keys: np.ndarray, per: np.ndarray, first: np.ndarray, offset: np.ndarray):
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << _SHIFT) + rank, side="right") - 1
        i = rank - (keys[at] & ((1 << _SHIFT) - 1)) if len(at) else rank
        more = [first[at] + i // per[at], offset[at] + (i % per[at]) * length] if len(at) else [rank, rank]
        names = [x for x in batch.schema.names if x != "rank"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(x) for x in names] + [pa.array(x, type=pa.int64()) for x in more], names=[*names, "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, eos: int = EOS, keep_ids: bool = True, remember: int | None = None
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; further columns are ignored) with their places.

    remember: chunks whose ids a worker keeps (twice at most); the result does not depend on it.

    Null text is empty text, which still has the closing id. Repeated rows are packed
    each for itself; an empty table gives an empty result.
    """
    kept = ", ids array<int>" if keep_ids else ""
    pieces = stage(
        docs.select("doc_id", "text").mapInArrow(
            partial(_pieces, path=tokenizer_path, max_len=max_len, eos=eos, keep_ids=keep_ids, remember=remember), PIECES + kept
        ),
        "pack-pieces",
    )
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= max_len rows
    segments = sorted(plan(counts, max_len)[0])
    cols = np.array(segments or [(0, 0, 1, 0, 0)], dtype=np.int64).T
    place = partial(_slots, keys=(cols[0] << _SHIFT) + cols[1], per=cols[2], first=cols[3], offset=cols[4])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = pieces.join(before.drop("n"), ["length", "part"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))
    schema = PIECES.split(", part")[0] + kept + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens.

    A null or empty text is its end token alone; every row, repeated ones too, has pieces of
    its own; among pieces of one length any may take any of the planned places.
    """
    configure(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)
