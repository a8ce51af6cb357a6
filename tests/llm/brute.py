"""Plain re-statements of the contracts, to hold the operators against."""

import hashlib
import math
import re

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def dedup(docs, window=13):
    words = {i: WORD.findall(t or "") for i, t in docs}
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            k = w[i : i + window]
            if any(o < d and any(v[j : j + window] == k for j in range(len(v) - window + 1)) for o, v in words.items()):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out)


def shingles(text, size):
    w = WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(docs, size, percent):
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def hits(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, found = ITEM_WORD.findall(low(t)), set(), set()
        for item, text in items:
            v = ITEM_WORD.findall(low(text))
            n = min(window, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


def secrets(text):
    text = text or ""
    assign = re.compile(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def features(text):
    """Hashed byte n-grams, one by one."""
    letters = bytes(b if b >= 0x80 or chr(b).isalpha() else 32 for b in text.lower().encode())
    a = b" " + b" ".join(letters.split()) + b" "
    return [((int.from_bytes(a[i : i + n]) + n) * 2654435761 % 2**32) >> 17 for n in (1, 2, 3, 4) for i in range(len(a) - n + 1)]


class Languages:
    """Every split of the languages is a bit; each has log-ratios of features; the nearest codeword wins."""

    def __init__(self, rows, dim):
        self.names = sorted({lang for lang, _ in rows})
        share = {n: dict.fromkeys(range(dim), 0.0) for n in self.names}
        for lang, text in rows:
            f = features(text)
            for x in f:
                share[lang][x] += 1 / len(f)
        for n in self.names:
            total = sum(share[n].values())
            share[n] = {x: v / total for x, v in share[n].items()}
        first, *others = self.names
        self.splits = [{first, *(o for k, o in enumerate(others) if m >> k & 1)} for m in range(2 ** len(others) - 1)]
        mean = lambda names, x: sum(share[n][x] for n in names) / len(names)
        self.weights = [
            [math.log((mean(s, x) + 0.5 / dim) / (mean(set(self.names) - s, x) + 0.5 / dim)) for x in range(dim)] for s in self.splits
        ]

    def losses(self, text, scale):
        f = features(text)
        margins = [scale * sum(w[x] for x in f) / len(f) for w in self.weights]
        return [sum(math.log1p(math.exp(-m if n in s else m)) for m, s in zip(margins, self.splits, strict=True)) for n in self.names]


def compresses(text, level, bands, chunk, chunk_band, share):
    """Whether the whole and enough of the chunks lie within their bands."""
    raw = (text or "").encode()
    if not raw:
        return True
    inside = lambda part, band: band[0] <= len(zstandard.compress(part, level)) / len(part) <= band[1]
    of = lambda part: [b[1:] for b in bands if b[0] <= len(part)][-1]
    parts = [raw[k : k + chunk] for k in range(0, len(raw), chunk)] if len(raw) >= chunk else []
    bad = sum(len(x) for x in parts if not inside(x, chunk_band if len(x) == chunk else of(x)))
    return inside(raw, of(raw)) and bad <= share * len(raw)


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {t for t in tri if tri.count(t) > 1}
    covered = {i + k for i, t in enumerate(tri) if t in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)
