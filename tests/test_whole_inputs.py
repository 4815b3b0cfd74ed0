"""Registered queries take whole tables: brute force in Python."""

import math
import random
from collections import Counter, defaultdict

from lexloom.plans import report_queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, items=()):
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in docs], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "labels", "conversations"):
        spark.range(1).write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def bm25(docs, items, k):
    """{item: [article, ...]} of lists in order; docs: {(corpus, article): tokens}."""
    size, n, df = defaultdict(int), Counter(), Counter()
    for (c, _), t in docs.items():
        size[c] += len(t)
        n[c] += 1
        df.update((c, w) for w in set(t))
    out = {}
    for q, words in items.items():
        scored = []
        for (c, a), t in docs.items():
            tf = Counter(t)
            s = sum(math.log(1 + (n[c] - df[c, w] + 0.5) / (df[c, w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / (size[c] / n[c]))) for w in words if tf[w])
            if s > 0:
                scored.append((-round(s, 9), c, a))
        out[q] = [(c, a) for _, c, a in sorted(scored)[:k]]
    return out


def test_every_item_and_document_is_diagnosed(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: f"word{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(12))) for i in range(50)]
    docs = []
    for i in range(300):
        held = [items[rnd.choice((3, 41, 45, 49))][1]] if i % 4 == 0 else []
        docs.append((i, " ".join([word() for _ in range(rnd.randrange(5, 60))] + held + [word() for _ in range(rnd.randrange(40))]), "en" if i % 3 else "de"))
    write(spark, tmp_path, docs, items)
    tokens = {(lang, f"L{i}-{i % 3}"): t.split() for i, t, lang in docs}
    ranks = bm25(tokens, {i: t.split() for i, t in items}, 50)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = set()
    for q, passage in items:
        for i, t, lang in docs:
            key = (lang, f"L{i}-{i % 3}")
            if passage in t and key not in ranks[q][:10]:
                rival = max(jaccard(passage.split(), tokens[r]) for r in ranks[q][:5])
                want.add((q, *key, round(jaccard(passage.split(), tokens[key]), 6), round(rival, 6), ranks[q].index(key) + 1 if key in ranks[q] else None))
    assert {q for q, *_ in want} == {3, 41, 45, 49}
    got = [tuple(r[c] for c in ("question_id", "corpus_id", "article_number", "gold_jaccard", "rival_jaccard", "bm25_rank")) for r in report_queries.i13(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_topic_bundles_have_every_corpus(spark, tmp_path):
    write(spark, tmp_path, [(i, "a license", lang) for i, lang in enumerate(["de", "en", "fr", "es"])], [(0, "x")])
    got = {(r.corpus_a, r.corpus_b) for r in report_queries.j8(spark, str(tmp_path)).collect()}
    assert got == {("de", "en"), ("de", "es"), ("de", "fr"), ("en", "es"), ("en", "fr"), ("es", "fr")}


def test_questions_are_whole_texts(spark, tmp_path):
    rnd = random.Random(8)
    opening = " ".join(f"open{i}" for i in range(40))  # over 160 characters
    say = lambda k: [f"word{rnd.randrange(900)}" for _ in range(k)]
    bodies = [say(80) for _ in range(12)]
    docs = [(i, f"{opening} {' '.join(b)}") for i, b in enumerate(bodies)]
    docs += [(20 + i, f"{opening} {' '.join(b[:-1])} changed{i}") for i, b in enumerate(bodies[:6])]  # near copies
    docs += [(40 + i, f"other{i} words at the start {' '.join(b * 2)}") for i, b in enumerate(bodies[6:9])]
    docs += [(60, docs[3][1]), (61, docs[3][1].upper())]
    write(spark, tmp_path, [(i, t, "en") for i, t in docs])
    text = {i: t.lower() for i, t in docs}
    first = {t: min(i for i in text if text[i] == t) for t in text.values()}
    want = {(first[t], i, 1.0) for i, t in text.items() if i != first[t]}
    one = {}
    for i, t in text.items():
        one[t, i % 3] = min(i, one.get((t, i % 3), i))
    sets = {i: ({w for w in t.split() if len(w) > 2}, g, t) for (t, g), i in one.items()}
    for a, (x, g, t) in sets.items():
        for b, (y, h, u) in sets.items():
            s = len(x & y) / len(x | y)
            if a < b and t != u and (s >= 0.92 or s >= 0.75 and g == h):
                want.add((a, b, round(s, 6)))
    got = [(r.a, r.b, r.similarity) for r in report_queries.j1(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 8
    root = {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    sizes = Counter(find(i) for i in text)
    assert {(r.component, r.members) for r in report_queries.j2(spark, str(tmp_path)).collect()} == {(c, n) for c, n in sizes.items() if n > 1}
    assert {r.question_id for r in report_queries.j3(spark, str(tmp_path)).collect()} == set(first.values())
