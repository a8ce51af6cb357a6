"""Spelling variants, pairwise ranking and source divergence against plain statements."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from rankweave.llm import divergence, ranking, spelling
from rankweave.llm._common import stage

DOCS = "doc_id long, text string, lang string, source string, n long, word string, value double"


def frame(spark, rows):
    """Rows of doc_id, text, lang, source, with columns whose names clash."""
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], DOCS)


# 11 spelling variants


def _one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def _grouped(counts, ratio=10):
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        if own:
            best = min(own, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_tries_give_every_pair_once():
    rng = random.Random(3)
    for _ in range(400):
        letters = "abcé"[: rng.choice([1, 2, 4])]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 30))})
        got = [tuple(sorted((i, j))) for a, b, _ in spelling.one_edit_pairs(words, 99) for i in a for j in b]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if _one_edit(words[i], words[j])}


def test_a_merge_leaves_both_tries_as_they_were():
    a, b, met = spelling.build(["ab", "ac", "b"]), spelling.build(["ab", "ad"]), []
    before = repr((a, b))
    both = spelling.merge(a, b, met)
    assert repr((a, b)) == before and met == [((0,), (0,))] and both[2] == 5


@pytest.mark.parametrize("trie_chars", [1 << 17, 40, 1])
def test_spellings_against_brute_force(spark, trie_chars):
    rng = random.Random(trie_chars)
    counts = {}
    for stem in ("aaaaaaa", "bananaban", "éclairage", "internationalisation", "prefixed"):
        counts[stem] = rng.choice([100, 2000])
        for _ in range(25):
            w = list(stem)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice("abé")], [w[k], rng.choice("abé")]])
            if len(w) >= 7:
                counts["".join(w)] = rng.choice([2, 3, 15, 150])
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_spellings(stage(words, "words"), trie_chars=trie_chars).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == _grouped(counts)


def test_forms_are_followed_to_the_last(spark):
    counts = {"aaaaaaa" + "b" * k: 2 * 10**k for k in range(9)}
    got = {r["word"]: r["root"] for r in spelling.group_spellings(stage(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")).collect()}
    assert set(got.values()) == {"aaaaaaa" + "b" * 8}


def test_words_of_one_prefix_are_dealt_to_many_tries(spark):
    """A third of all words in one trie is more than a trie may hold; the windows are halved without loss."""
    rng = random.Random(1)
    counts = {"pneumono" + "".join(rng.choice("abcd") for _ in range(6)): 2 + k for k in range(900)}
    words = stage(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    assert {tuple(r) for r in spelling.group_spellings(words, trie_chars=300).collect()} == _grouped(counts)


def test_very_long_words(spark):
    long = "ab" * 20_000
    counts = {long: 5, long[:-1]: 50, long[:7_001] + "c" + long[7_002:]: 3, "x" + long: 2}
    words = stage(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    got = {r["word"]: (r["n_near"], r["form_n"]) for r in spelling.group_spellings(words).collect()}
    assert got == {long: (3, 50), long[:-1]: (1, None), long[:7_001] + "c" + long[7_002:]: (1, None), "x" + long: (1, None)}


def _words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] += len(word) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_are_garbled_by_their_checksum(spark):
    rng = random.Random(8)
    stems = ["Vocabulary", "ÉCLAIRAGE", "straßenbahn", "seventh", "short", "×÷×÷×÷×", "naïveté"]
    rows = [(k, " ".join(rng.choice(stems) + rng.choice([" ", "1", "ł", "", ".\n"]) for _ in range(60)), "en", "s") for k in range(80)]
    rows += [(None, "Vocabulary " * 5, None, None), (3, None, "en", "s"), (4, "", "en", "s"), rows[0], rows[0], (99, "onceonly", "en", "s")]
    got = {r["word"]: r["n"] for r in spelling.count_words(frame(spark, rows)).collect()}
    assert got == _words([r[:2] for r in rows])
    assert any(len(w) == 9 and w not in ("éclairage",) for w in got)  # some are garbled


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 5)
    assert [r for part in spelling.runs_of("abc defghijklm, Nop" * 3) for r in part] == (b"abc defghijklm nopabc defghijklm nopabc defghijklm nop").split()
    monkeypatch.setattr(divergence, "_PIECE", 5)
    assert [r for part in divergence.term_pieces("Ab É-cd".encode() * 2) for r in part] == ["ab".encode(), "É".encode(), b"cdab", "É".encode(), b"cd"]


def test_no_words(spark):
    words = spelling.count_words(frame(spark, [(1, None, "en", "s"), (2, "", None, None), (3, "a b c", "en", "s")]))
    assert spelling.group_spellings(stage(words, "words")).collect() == []


# 12 pairwise ranking


def _graded(seed, n):
    """Prose of label 1, and of label 0 text with marks, repeats or shouting."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        good = rng.random() < 0.7
        if not good:
            way = rng.randrange(3)
            words = [w + rng.choice(["$$$", "&&&", "***"]) for w in words] if way == 0 else words[:1] * len(words) if way == 1 else [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy_and_threshold(spark):
    rows = _graded(2, 900)
    docs = frame(spark, [(k, t, "en", "s") for k, t, _ in rows])
    labels = spark.createDataFrame([(k, q, "y", 1.0) for k, _, q in rows], "doc_id long, quality int, text string, score double")
    model = ranking.train(docs.where(~ranking.held_out()), labels)
    got = ranking.score(docs.withColumn("held_out", ranking.held_out()), model, ["doc_id", "held_out"]).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == rows[r["doc_id"]][2] for r in got if r["held_out"]]
    assert len(right) > 200 and sum(right) / len(right) > 0.97


def test_fit_is_the_least_logistic_loss_of_pairs():
    rng = np.random.default_rng(4)
    n = len(ranking.STATISTICS)
    good, poor = rng.normal(0.4, 1, (80, n)), rng.normal(0, 1, (50, n))
    model = ranking.fit(good, poor, 0.3)
    a, b = ranking.pairs(80, 50)
    assert min(np.bincount(a, minlength=80)) >= ranking.PAIRS_PER_DOCUMENT and min(np.bincount(b, minlength=50)) >= ranking.PAIRS_PER_DOCUMENT
    difference = model.vectors(good)[a] - model.vectors(poor)[b]
    loss = lambda w: np.logaddexp(0, -difference @ w).mean() + ranking.PENALTY / 2 * (w @ w)
    least = loss(model.weights)
    for _ in range(50):
        assert loss(model.weights + rng.normal(0, 0.05, len(model.weights))) > least
    below = 0.7 * (model.scores(good) < 0.5).mean() + 0.3 * (model.scores(poor) < 0.5).mean()
    assert abs(below - 0.3) <= 1 / 50  # the threshold is the quantile of the share of label 0


def test_ranking_edges(spark):
    rows = [(k, t, "en", "s") for k, t, _ in _graded(5, 60)] + [(None, "a b", None, None), (100, None, "en", "s"), (101, "", "en", "s"), (102, " \n", "en", "s"), (103, "é" * 2_000_000, "en", "s")]
    docs = frame(spark, [*rows, rows[0], rows[0]])
    mark = "doc_id long, quality int"
    only = lambda labels: {r["score"] for r in ranking.score(docs, ranking.train(docs, spark.createDataFrame(labels, mark)), ["doc_id"]).collect()}
    assert only([]) == {0.5} and only([(1, 1), (2, 1), (None, 0), (3, None), (4, 7)]) == {1.0} and only([(1, 0)]) == {0.0}
    assert only([(1, 0), (1, 1), (2, 1), (999, 0)]) == {1.0}  # both labels, and a document that is not there
    model = ranking.train(docs, spark.createDataFrame([(k, q) for k, _, q in _graded(5, 60)] * 2, mark))
    got = ranking.score(docs, model, ["doc_id", "n", "value"]).collect()
    assert len(got) == docs.count() and len({r["score"] for r in got if r["doc_id"] in (100, 101, 102)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_sample_is_bounded(spark):
    rows = _graded(6, 300)
    docs, labels = frame(spark, [(k, t, "en", "s") for k, t, _ in rows]), spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    few = ranking.train(docs, labels, per_label=20)
    assert few.weights.any() and np.isfinite(few.threshold)


def test_every_labelled_document_trains(spark):
    """The strange documents are few; a sample of 20 a label may miss them, and its threshold, means and cuts are not those of all."""
    graded = _graded(8, 260)
    docs = frame(spark, [(k, t, "en", "s") for k, t, _ in graded])
    labels = spark.createDataFrame([(k, q) for k, _, q in graded], "doc_id long, quality int")
    packer = zstandard.ZstdCompressor(level=3)
    rows = np.array([ranking.statistics(t, packer) for _, t, _ in graded])
    order = [r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64('pairwise', doc_id) as h").orderBy("h").collect()]
    side = lambda q: np.array([rows[k] for k in order if graded[k][2] == q])
    poor = len(side(0))
    one, many = ranking.train(docs, labels, per_label=1000), ranking.train(docs, labels, per_label=20)
    whole = ranking.fit(side(1), side(0), poor / 260)
    assert np.allclose(one.weights, whole.weights, atol=1e-5) and abs(one.threshold - whole.threshold) < 1e-4
    for model in (one, many):
        assert np.allclose(model.mean, rows.mean(axis=0)) and np.allclose(model.spread, whole.spread) and np.allclose(model.cuts, np.quantile(rows, ranking.CUTS, axis=0).T)
        assert (model.scores(rows) < 0.5).sum() == poor  # the quantile over all documents


def test_a_rare_label_is_in_every_block(spark):
    rows = [(k, int(k >= 3), [float(k % 7)] * len(ranking.STATISTICS)) for k in range(50)]
    known = spark.createDataFrame(rows, "doc_id long, q int, statistics array<double>")
    blocks = ranking._in_blocks(known, {0: 3, 1: 47}, 5).collect()
    assert len(blocks) == 10 and all({m["q"] for m in r["members"]} == {0, 1} and len(r["members"]) == 1 + sum(m["q"] for m in r["members"]) for r in blocks)
    assert sorted(m["number"] for r in blocks for m in r["members"] if m["q"]) == list(range(47))


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(1)
    values = np.stack([rng.normal(0, 1e3, 400), rng.integers(-2, 3, 400) * 0.1, np.zeros(400) * -1.0], axis=1)
    df = spark.createDataFrame([(v.tolist(),) for v in values], "x array<double>").repartition(3)
    ranks = [0, 17, 18, 200, 399]
    assert (ranking.order_statistics(df, "x", 3, ranks) == np.sort(values, axis=0)[ranks].T).all()


def test_statistics_of_a_text():
    got = dict(zip(ranking.STATISTICS, ranking.statistics("Ab ab! ab!\n\nx1 é", zstandard.ZstdCompressor()), strict=True))
    assert got["distinct"] == 4 / 5 and got["commonest"] == 2 / 5 and got["stutter"] == 1 / 5 and got["marked_words"] == 2 / 5 and got["bare_words"] == 0
    assert got["upper"] == 1 / 17 and got["shout"] == 2 / 17 and got["wide"] == 2 / 17


# 13 source divergence


def _audit(rows):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in d[2]).items() if n >= 3)
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if t in set(kept)})
        every = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, own_p = p(every), {s: p(c) for s, c in counts.items()}
        for s, mine in own_p.items():
            pairs = sorted((-sum((mine[t] - other[t]) ** 2 // other[t] for t in kept), o.encode()) for o, other in own_p.items() if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted((-((mine[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] > 0 and mine[t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:200])}
    return out


@pytest.mark.parametrize(("cells", "chunk_rows"), [(1 << 20, 1 << 18), (7, 5), (40, 1)])
def test_divergence_against_brute_force(spark, cells, chunk_rows):
    rng = random.Random(cells)
    terms = [f"{a}{b}" for a in ("word", "Éa", "ß", "名", "𝔸", "z") for b in "abcdefgh"]
    rows = [(k, " ".join(rng.choice(terms[rng.randrange(40) :]) + rng.choice([" ", "1", "-"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), f"s{rng.randrange(6)}") for k in range(60)]
    rows += [(70, None, "en", "s1"), (71, "alone", "fr", "s1"), (72, "", "fr", "s2"), (73, "worda worda", None, None), (74, "worda", None, ""), (75, "worda", "", "x"), rows[0], rows[0], (None, "worda", "en", None)]
    got = divergence.audit(frame(spark, rows), cells=cells, chunk_rows=chunk_rows).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == _audit([r[1:] for r in rows])


def test_ties_go_by_utf8_order_and_end_at_the_top(spark):
    terms = [f"t{chr(0x4E00 + k)}" for k in range(300)] + ["té", "tz", "t𝔸"]
    rows = [(k, " ".join(terms), "en", "a") for k in range(3)] + [(9 + k, "other " * 50, "en", "b") for k in range(3)]
    got = divergence.audit(frame(spark, rows), chunk_rows=37).where("part = 'term' and source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(terms, key=str.encode)[:200] and [r["rank"] for r in got] == list(range(1, 201))


def test_p_is_exact_for_large_counts():
    counts, total = np.array([0, 1, 999_999_999_989, 3 * 10**12]), 7 * 10**12 + 3
    assert divergence._p(counts, total, 11).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 11) for c in counts]


def test_a_worker_passes_on_what_it_cannot_hold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "REMEMBERED", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["s", "t", "s", "s"]), pa.array([b"a b c", b"a", b"a a d e", b"a"])], names=["lang", "source", "text"])
    sums = Counter()
    parts = list(divergence._count(iter([batch])))
    for part in parts:
        for lang, source, term, n, d in zip(*(c.to_pylist() for c in part.columns), strict=True):
            sums[source, term] += 1j * d + n
    assert len(parts) > 1 and sums["s", "a"] == 4 + 3j and sums["t", "a"] == 1 + 1j and sums["s", "e"] == 1 + 1j
