"""Collocations and their filters against plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import collocations
from lexloom.llm.quotient import WORD_BITS, QuotientFilter, packed, permuted, unpacked

DOCS = "doc_id long, text string, lang string, a int"


@pytest.mark.parametrize("words", [2, 3, 4, 5])
def test_filters_keep_every_gram_and_count(words):
    rnd = np.random.default_rng(words)
    grams = rnd.integers(1, 40, (20_000, words))
    grams[:50] = (1 << WORD_BITS) - 1 - grams[:50]
    left, right = packed([grams[:, k] for k in range(words)])
    assert (unpacked(left, right, words) == grams).all()
    x, y = permuted(left, right, words)
    assert all((a == b).all() for a, b in zip(permuted(x, y, words, back=True), (left, right), strict=True))
    shards = [QuotientFilter.counted(words, x[i::3], y[i::3]) for i in range(3)]
    for bits in (0, 3):
        parts = {}
        for s in shards:
            for p, f in s.split(bits):
                parts.setdefault(p, []).append(QuotientFilter.from_bytes(f.to_bytes(bits)))
        got = Counter()
        for p, filters in parts.items():
            whole = QuotientFilter.merged(filters)
            assert (np.diff(whole.left.astype(np.float64)) >= 0).all() and p < 1 << bits
            for g, n in zip(whole.grams().tolist(), whole.counts.tolist(), strict=True):
                got[tuple(g)] += n
        assert got == Counter(map(tuple, grams.tolist()))
    many = QuotientFilter.counted(words, x[:3], y[:3], np.array([254, 255, 10**12]))
    again = QuotientFilter.from_bytes(many.to_bytes())
    assert sorted(again.counts.tolist()) == [254, 255, 10**12] and (again.grams() == many.grams()).all()
    assert len(QuotientFilter.from_bytes(QuotientFilter.counted(words, x[:0], y[:0]).to_bytes()).left) == 0


def plain(docs, at_least, longest=5, most=2000):
    f, n = {}, Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang or "und", tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= at_least}
    gone = {(lang, p[i : i + m]) for (lang, p), a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= cand.get((lang, p[i : i + m]), 1e99)}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r, n[lang], score))
    return sorted((lang, i + 1, x[2].decode(), -x[1], *x[3:]) for lang, rows in out.items() for i, x in enumerate(sorted(rows)[:most]))


def table():
    rnd = random.Random(2)
    some = ["New", "york", "the", "of", "é", "日本", "a\x0b", "b-c", "\x00", "stock", "Exchange"]
    docs = [(" ".join(rnd.choice(some) for _ in range(rnd.randrange(40))) + rnd.choice(["", ".", "! ", "\t"]) + "new York Stock exchange, the the the", rnd.choice(["en", "en", None, "und", "fr"])) for _ in range(200)]
    return docs + [(None, "en"), ("", None), (" \t ", "fr"), ("the " * 5000, "en"), ("rare word", "zz")]


@pytest.mark.parametrize("limit", [collocations.BROADCAST_WORDS, 0])
def test_phrases_equal_plain_counts(spark, limit):
    docs = table()
    df = spark.createDataFrame([(i % 7, t, lang, i) for i, (t, lang) in enumerate(docs)], DOCS).repartition(3)
    got = sorted(tuple(r) for r in collocations.top_phrases(df, at_least=20, broadcast_words=limit).collect())
    assert got == plain(docs, 20) and len(got) > 25 and max(len(r[2].split(" ")) for r in got) == 5


def test_small_lots_parts_and_limits_change_nothing(spark, monkeypatch):
    docs = table()
    df = spark.createDataFrame([(1, t, lang, 0) for t, lang in docs], DOCS).repartition(2)
    monkeypatch.setattr(collocations, "PART", 50)
    monkeypatch.setattr(collocations, "_BLOCK", 3000)
    monkeypatch.setattr(collocations, "CHUNK", 700)
    monkeypatch.setattr(collocations, "BITS", (6, 7))  # a bitmap so full that it tells little
    got = sorted(tuple(r) for r in collocations.top_phrases(df, at_least=30, most=15).collect())
    assert got == plain(docs, 30, most=15)


def test_scores_past_64_bits_are_exact(spark):
    a, l, r, n = 10**12 + 7, 10**12 + 9, 10**12 + 11, 10**14 + 3
    found = spark.createDataFrame([("en", [1, 2], a), ("en", [1], l), ("en", [2], r)], "lang string, ids array<int>, a long")
    rows = collocations.scored(spark.createDataFrame([("en", n)], "lang string, n long"), found).collect()
    assert [tuple(x) for x in rows] == [("en", [1, 2], a, l, r, n, 1000 * a * n // (l * r))]


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, "a b", "en", 0)], DOCS)
    assert collocations.top_phrases(df).count() == 0 and collocations.top_phrases(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.top_phrases(df, longest=6)
