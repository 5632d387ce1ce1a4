"""Collocations against counting by hand; the quality classifier against plain formulas."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ecolake.llm import collocations, quality

# --- collocations -----------------------------------------------------------------------


def by_hand(rows, least, top):
    grams = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                grams[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in grams.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = defaultdict(int)
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        within[p[i:j]] = max(within[p[i:j]], a)
        ranked = []
        for p, a in found.items():
            if 100 * within[p] >= 100 * a:
                continue
            score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def mined(spark, rows, least, top, budget=collocations.BUDGET):
    df = spark.createDataFrame([(k, t, lang, 1, 2) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, f long")
    return sorted(map(tuple, collocations.collocations(df.repartition(4), least, top, budget).collect()))


def prose(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "sea", "über", "x", "y", "z", "rare" * 3]
    texts = []
    for _ in range(n):
        made = [rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!\n"]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            made[5:5] = "all rights are kept by me".split()
        texts.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "\t"]).join(made)))
    return texts


@pytest.mark.parametrize("budget", [1, 7, 1 << 18])
def test_phrases_are_those_counted_by_hand(spark, budget):
    rows = prose(3, 120)
    got = mined(spark, rows, 6, 40, budget)
    assert got == by_hand(rows, 6, 40) and len(got) > 80


def test_a_prefix_held_by_most_rows_is_extended(spark):
    rows = [("en", " ".join(["a a a a b", f"a a a a c{k % 3}", "a a a"]) + ". a a a") for k in range(40)]
    for budget in (1, 2, 1000):
        assert mined(spark, rows, 10, 100, budget) == by_hand(rows, 10, 100)


def test_runs_are_cut_between_pieces_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 3)
    rows = prose(8, 30)
    ids = np.array([5, 6, 0, 5, 6, 7, 0], np.uint64)
    table = np.full(1 << 10, ~np.uint64(0))
    assert [c.tolist() for c in collocations._counted_suffixes(ids, table)] == [[5], [6], [7], [0], [0], [1]]
    assert mined(spark, rows, 3, 50) == by_hand(rows, 3, 50)


def test_odd_texts_and_ties(spark):
    rows = [(None, None), ("und", ""), (None, "b c. B C"), ("und", "e d,e d"), ("xx", "\x0bq\x1fw r\x00s\x0cq\x1fw r\x00s"), ("xx", " . , "), ("long", "w v " * 30_000)]
    assert mined(spark, rows, 2, 1) == by_hand(rows, 2, 1)
    assert mined(spark, rows, 2, 9) == by_hand(rows, 2, 9)
    assert mined(spark, [], 2, 9) == []


def test_equal_numbers_of_two_words_are_seen(spark, monkeypatch):
    plain = collocations._Numbers.__init__

    def same(self, lang, seed):
        plain(self, lang, seed)
        if seed == 7:
            self.update({b"the": 9, b"of": 9})

    rows = prose(5, 60)
    monkeypatch.setattr(collocations._Numbers, "__init__", same)
    assert mined(spark, rows, 5, 30) == by_hand(rows, 5, 30)


def test_scores_are_exact_beyond_64_bits():
    a, n = 10**13, 10**18
    assert list(collocations._scored([(a, n, [(1, a, a), (2, a + 1, a)])])) == [(a + 1, a, 1000 * a * n // (a * (a + 1)))]


# --- quality ----------------------------------------------------------------------------


def test_grams_are_the_hashed_n_grams_of_the_whole_text(monkeypatch):
    texts = ["", "one", "One two THREE one two!!\n\n%%% 4 _ x", "a b " * 50]
    whole = [quality.grams(t, quality._Hashes()) for t in texts]
    monkeypatch.setattr(quality, "STRETCH", 3)
    for text, (at, x) in zip(texts, whole):
        parts = quality.grams(text, quality._Hashes())
        assert np.array_equal(at, parts[0]) and np.allclose(x, parts[1])
        assert (np.diff(at) > 0).all() and (not len(x) or abs((x * x).sum() - 1) < 1e-12)
        tokens = quality._TOKEN.findall(text)
        expect = Counter()
        for names, most in (([("w" + t.lower()) for t in tokens], 2), ([("s" + quality.shape(t)) for t in tokens], 3)):
            hashed = [np.array([quality.xxhash.xxh64_intdigest(n)], np.uint64) for n in names]
            for n in range(1, most + 1):
                for i in range(len(hashed) - n + 1):
                    h = np.zeros(1, np.uint64)
                    for k in range(n):
                        h = quality.mixed(h ^ hashed[i + k])
                    expect[int(h[0] >> np.uint64(64 - quality.BITS))] += 1
        assert sorted(expect) == at.tolist()
        assert np.allclose(x**2 * sum(expect.values()), [expect[k] for k in at.tolist()])


def test_forgotten_tokens_are_hashed_alike():
    hashes = quality._Hashes()
    many = " ".join(f"w{k}" for k in range(100_001))
    before = quality.grams("w5 w7 other", quality._Hashes())
    quality.grams(many, hashes)
    after = quality.grams("w5 w7 other", hashes)
    assert np.array_equal(before[0], after[0]) and len(hashes) < 10


def test_updates_follow_the_regularised_leader():
    """The weights minimise the adjusted gradients' sum plus the regularisers, coordinate by coordinate."""
    rng = np.random.default_rng(1)
    leader = quality.Leader(alpha=0.5, beta=1.0, l1=0.05, l2=0.1)
    at = np.array([3, 8, 11])
    z, n, w = np.zeros(3), np.zeros(3), np.zeros(3)
    for _ in range(40):
        x, y = rng.random(3), float(rng.integers(2))
        p = 1 / (1 + np.exp(-(w @ x)))
        g = (p - y) * x
        sigma = (np.sqrt(n + g**2) - np.sqrt(n)) / 0.5
        z, n = z + g - sigma * w, n + g**2
        grid = np.linspace(-3, 3, 60_001)
        cost = z[:, None] * grid + 0.05 * np.abs(grid) + 0.5 * (((1 + np.sqrt(n)) / 0.5 + 0.1)[:, None]) * grid**2
        w = grid[cost.argmin(axis=1)]
        leader.update(at, x, y)
        assert np.allclose(leader.weights(at), w, atol=2e-3)


def test_held_out_rows_are_told_apart_and_never_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(scored[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in scored)
    assert np.mean([scored[d].predicted == truth[d] for d in held]) > 0.95
    turned = labels.replace({0: 1, 1: 0}, subset="quality").filter("crc32(cast(doc_id as string)) % 5 = 0").union(labels.filter("crc32(cast(doc_id as string)) % 5 != 0"))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert all(again[d] == scored[d].score for d in scored)


def test_quality_of_odd_rows(spark):
    rows = [(k, f"fine words here {k}" if k % 2 else f"%%% junk$$$ {k}", 7.0) for k in range(60)]
    rows += [(1, "another text", 7.0), (None, "fine words", 7.0), (None, None, 7.0), (70, "", 7.0), (71, None, 7.0), (72, "fine words here " * 40_000, 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(1, 0, 0), (3, None, 0), (5, 9, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.score)
    assert by_id[70] == by_id[71] and by_id[72][0] > 0.5 > min(by_id[0])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, quality.quality_scores(docs.repartition(5), labels).collect()), key=str)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
