"""Quality rules with compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that
compresses too well repeats itself, text that hardly compresses is noise. The limits
depend on length, since short texts compress less: they are stated per length band in
``WHOLE_BANDS`` and, for full chunks, in ``CHUNK_BAND``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from ._common import configure, table

LEVEL = 3
CHUNK = 4096
#: (bytes from, least and most compressed/original ratio allowed). The upper limits lie just above the
#: densest real text measured at the band's start (prose, source code, Chinese) and, from 400 bytes on, below base64.
WHOLE_BANDS = (
    (0, 0.0, 9.0), (200, 0.20, 0.89), (300, 0.20, 0.85), (400, 0.20, 0.825), (500, 0.20, 0.795), (600, 0.20, 0.775), (700, 0.20, 0.74),
    (1000, 0.18, 0.735), (1100, 0.18, 0.728), (1250, 0.18, 0.722), (1500, 0.18, 0.715), (2000, 0.18, 0.68), (3000, 0.18, 0.61), (4096, 0.18, 0.58),
    (5000, 0.16, 0.56), (10_000, 0.16, 0.52), (50_000, 0.12, 0.50),
)
#: The same for full chunks; the rest after them is held to the band of its length. A text
#: fails if more than this share of its bytes is in failing chunks.
CHUNK_BAND = (0.15, 0.58)
CHUNK_SHARE = 0.25
_SPACE = b" \t\n\x0b\x0c\r"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, bad_chunks long, n_chunks long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    v = len(ids)
    pair = w[:-1] * v + w[1:]
    if v < 2_000_000:
        tri = pair[:-1] * v + w[2:]
    else:
        tri = np.unique(pair, return_inverse=True)[1][:-1] * v + w[2:]
    order = np.argsort(tri, kind="stable")
    s = tri[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(n, dtype=bool)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def _band(size: int) -> tuple[float, float]:
    return next((lo, hi) for at, lo, hi in reversed(WHOLE_BANDS) if size >= at)


def compression(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """Verdict, whole-text ratio, failing chunks, chunks; of a text longer than a chunk the rest counts too."""
    if not raw:
        return True, 0.0, 0, 0
    ratio = len(packer.compress(raw)) / len(raw)
    low, high = _band(len(raw))
    bad = bad_bytes = 0
    chunks = range(0, len(raw), CHUNK) if len(raw) >= CHUNK else ()
    for at in chunks:
        own = raw[at : at + CHUNK]
        lo, hi = CHUNK_BAND if len(own) == CHUNK else _band(len(own))
        if not lo <= len(packer.compress(own)) / len(own) <= hi:
            bad += 1
            bad_bytes += len(own)
    return low <= ratio <= high and bad_bytes <= CHUNK_SHARE * len(raw), ratio, bad, len(chunks)


def score_text(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = repeat_words(words)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    ok, ratio, bad, chunks = compression(raw, packer)
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, failed, ok and not failed, ratio, bad, chunks


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    for batch in batches:
        rows = [score_text(x, packer) for x in batch.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [()] * 10
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(cols, kinds[1:], strict=True))], names=names
        )


def quality(docs):
    """One row per row of ``docs`` (doc_id, text; further columns are ignored).

    Null and empty texts have no words and fail the base rule. Repeated rows are
    scored one by one; a null doc_id stays null.
    """
    return docs.select("doc_id", "text").mapInArrow(_map, SCHEMA)


def op10_compression_bands(spark, sf_dir):
    """Words, repeats and compression of all documents, with the base rule and the verdict.

    Null and empty texts have no words and fail the base rule; a null doc_id stays null;
    repeated rows are scored one by one. A ratio on a limit is inside the band.
    """
    configure(spark)
    return quality(table(spark, sf_dir, "documents"))
