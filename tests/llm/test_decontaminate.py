"""Decontamination and its FM-index against plain searches."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexloom.llm import decontaminate
from lexloom.llm.fmindex import FmIndex, suffix_order

DOCS, ITEMS = "doc_id long, text string, n_words string, items string", "item_id long, text string, spans int"


def test_suffix_order_and_search_equal_plain_ones():
    rnd = random.Random(3)
    for _ in range(200):
        text = [rnd.randrange(3) for _ in range(rnd.randrange(1, 70))]
        s = np.array([*text, 3])
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        index = FmIndex(s, 4)
        for n in (1, 2, 3, 5):
            phrase = [rnd.randrange(-1 if n == 5 else 0, 3) for _ in range(n)]
            low, high = index.search(np.array([phrase[::-1]]), np.array([n]))
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [i for i in range(len(text)) if text[i : i + n] == phrase]
    one = np.zeros(5000, np.int64)  # one word over and over
    assert suffix_order(np.append(one, 1)).tolist() == [*range(5001)]
    with pytest.raises(ValueError):
        FmIndex(np.zeros(1 << 21, np.int64), 1)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain(docs, items, window=10):
    """By comparing every place of every text with every window."""
    asked = {}
    for i, t in items:
        w = [x for x, _, _ in words(t)]
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            asked.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        own = words(t)
        w, hit, found = [x for x, _, _ in own], set(), set()
        for n in {len(x) for x in asked}:
            for k in range(len(w) - n + 1):
                ids = asked.get(tuple(w[k : k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        left, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                left += t[at : own[k][1]]
            if k + 1 not in hit:
                at = own[k][2]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), None if t is None else left + t[at:]))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(8)
    some = ["Alpha", "beta", "ÉTÉ", "gamma9", "🙂", "the", "of", "x-y", "日本"]
    text = lambda n: " ".join(rnd.choice(some) for _ in range(n))
    items = [(i, text(rnd.choice((3, 9, 10, 11, 14)))) for i in range(30)] + [(3, "again the same id"), (None, "no id beta"), (40, None), (41, "--"), (42, "solo"), (43, items_twin := text(12)), (44, items_twin)]
    docs = [(1, None), (2, ""), (3, " ;-) "), (4, "solo"), (5, "SOLO solo. sole"), (6, items_twin + "!"), (6, items_twin + "!"), (None, "x " + items_twin)]
    docs += [(10 + k, text(rnd.randrange(60)) + " ;; " + items[rnd.randrange(30)][1].upper().replace(" ", "\n", 2) + "," + text(5)) for k in range(60)]
    docs.append((99, text(4000) + " " + items_twin + " " + text(4000)))
    return docs, items


def found(df):
    rows = df.collect()
    out = []
    for r in rows:
        n = sum(s["last"] - s["first"] for s in r.spans)
        out.append((r.doc_id, r.n_words, n, len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), n > 0, r.text))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_contamination_equals_a_plain_search(spark, block, monkeypatch):
    docs, items = tables()
    df = spark.createDataFrame([(i, t, "n", "m") for i, t in docs], DOCS).repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    assert found(decontaminate.contaminated(df, it, cut=True, block=block)) == plain(docs, items)
    digests = sorted((tuple(r) for r in decontaminate.contamination_digests(df, it).collect()), key=str)
    assert digests == [r[:6] for r in plain(docs, items)] or sorted(digests, key=str) == sorted([r[:6] for r in plain(docs, items)], key=str)


def test_long_texts_are_cut_into_pieces_that_overlap():
    first, count = np.array([0, 0, 10]), np.array([0, 10, 3])
    assert decontaminate.pieces_of(first, count, 6, 2) == [(1, 0, 6), (1, 4, 10), (2, 10, 13)]
    rnd = random.Random(5)
    for _ in range(200):
        n, size = rnd.randrange(1, 40), rnd.randrange(4, 9)
        got = decontaminate.pieces_of(np.array([5]), np.array([n]), size, 3)
        for k in range(5, 5 + n):  # every run of four words, or the whole, is inside a piece
            assert any(a <= k and min(k + 4, 5 + n) <= b for _, a, b in got)
        assert all(b - a <= size for _, a, b in got)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", "")], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in decontaminate.contaminated(docs, items.limit(0)).collect()] == [(1, 2, [], [])]
