"""BM25 over bounded blocks against scores of every chunk."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25, context, retrieval

CHUNKS, ASKED = "corpus_id string, chunk_id string, tokens array<string>", "question_id long, tokens array<string>, corpora array<string>"


def tables(seed=1, chunks=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: [words[min(int(rnd.expovariate(0.08)), 59)] for _ in range(n)]
    rows = [(rnd.choice("aab"), f"{i}", pick(rnd.choice((0, 3, 20, 90)))) for i in range(chunks)]
    rows += [("a", f"t{i}", ["w1", "w50", "w1"]) for i in range(40)]  # equal scores
    rows += [("c", "bare", []), ("c", "one", ["w1"])]
    asked = [(q, pick(rnd.randrange(1, 9)) + ["nowhere"], rnd.choice([None, ["a"], ["b", "c"], ["a", "b"]])) for q in range(25)] + [(90, [], None), (91, ["nowhere"], None), (92, ["w1", "w50"], None)]
    return rows, asked


def plain(rows, asked, k, by_corpus=False):
    docs, size, df = Counter(c for c, _, _ in rows), Counter(), Counter()
    for c, _, t in rows:
        size[c] += len(t)
        df.update((c, x) for x in set(t))
    out = []
    for q, terms, only in asked:
        found = []
        for c, i, t in rows:
            if only is not None and c not in only:
                continue
            tf, s = Counter(t), 0.0
            for x, n in Counter(terms).items():
                if tf[x]:
                    idf = math.log(1 + (docs[c] - df[c, x] + 0.5) / (df[c, x] + 0.5))
                    s += n * idf * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(t) / (size[c] / docs[c])))
            if s > 0:
                found.append((-round(s, 9), c, i))
        if by_corpus:
            n = len(only) if only else 0
            kept = [x for c in only or () for x in sorted(f for f in found if f[1] == c)[: -(-k // n)]]
            found = kept
        out += [(q, r + 1, c, i) for r, (_, c, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, broadcast", [(2048, bm25.BROADCAST), (60, bm25.BROADCAST), (60, 40)])
def test_topk_equals_scores_of_every_chunk(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(bm25, "BLOCK", block)
    monkeypatch.setattr(bm25, "BROADCAST", broadcast)
    rows, asked = tables()
    chunks, queries = spark.createDataFrame(rows, CHUNKS).repartition(3), spark.createDataFrame(asked, ASKED)
    blocks = bm25.bm25_blocks(chunks, bm25.question_terms(queries))
    key = ["question_id", "rank", "corpus_id", "chunk_id"]
    for k in (1, 7, 30):
        assert sorted(tuple(r) for r in retrieval.bm25_topk(blocks, queries, k).select(key).collect()) == plain(rows, asked, k)
    assert sorted(tuple(r) for r in retrieval.bm25_quota(blocks, queries, 7).select(key).collect()) == plain(rows, [a for a in asked if a[2]], 7, by_corpus=True)
    whole = bm25.bm25_blocks(chunks)
    assert sorted(tuple(r) for r in retrieval.bm25_topk(whole, queries, 7).select(key).collect()) == plain(rows, asked, 7)


def test_sizes_and_postings_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 60)
    rows, _ = tables()
    chunks = spark.createDataFrame(rows, CHUNKS)
    blocks = bm25.bm25_blocks(chunks)
    stats, df = bm25.bm25_sizes(blocks)
    _, plain_df, plain_stats = retrieval.bm25_index(chunks)
    order = lambda x: sorted((r.corpus_id, r.docs, round(r.avg_len, 9)) for r in x.collect())
    assert order(stats) == order(plain_stats)
    assert sorted(map(tuple, df.select("corpus_id", "term", "df").collect())) == sorted(map(tuple, plain_df.select("corpus_id", "term", "df").collect()))
    assert sorted(map(tuple, bm25.bm25_postings(blocks).collect())) == sorted({(c, i, x) for c, i, t in rows for x in t})


def test_bounds_leave_postings_unread(spark, monkeypatch):
    """Chunks of a common word beside a few that hold the rare ones asked for: most ranges can't reach the k-th score."""
    monkeypatch.setattr(bm25, "BLOCK", 500)
    rows = [("a", f"{i}", ["common"] * (1 + i % 3) + ["x"] * (i % 40)) for i in range(3000)] + [("a", f"r{i}", ["rare", "common", "odd"]) for i in range(12)]
    queries = spark.createDataFrame([(1, ["rare", "odd", "common"], None), (2, ["common"], None)], ASKED)
    blocks = bm25.bm25_blocks(spark.createDataFrame(rows, CHUNKS).coalesce(1), bm25.question_terms(queries)).coalesce(1)
    read = {r.question_id: r.read / r.total for r in bm25.postings_read(blocks, queries, 10).collect()}
    assert read[1] < 0.1 and read[2] < 0.5
    got = {(r.question_id, r.chunk_id[0] == "r") for r in retrieval.bm25_topk(blocks, queries, 10).where("question_id = 1").collect()}
    assert got == {(1, True)}


def test_hybrid_searches_words_of_routed_questions_alone(spark):
    chunks = spark.createDataFrame([(c, f"{c}{i:02}", f"{c}{i}", 0, "y", [1.0, float(i + (c == "b"))]) for c in "ab" for i in range(80)], "corpus_id string, chunk_id string, article_number string, chunk_index int, content string, vector array<double>")
    asked = spark.createDataFrame([(1, ["a", "b"], None), (2, ["a"], []), (3, [], None), (4, ["a"], ["b"])], "question_id long, predicted array<string>, explicit array<string>").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))).withColumn("tokens", F.array(F.lit("y")))
    seen = []

    def scores(found):
        seen.append(found.groupBy("question_id", "corpus_id").count().collect())
        return found.select("question_id", "corpus_id", "chunk_id", F.lit(0.5).alias("rerank_score"))

    blocks = bm25.bm25_blocks(chunks.withColumn("tokens", F.array("content")))
    got = context.answer_contexts(asked, chunks, scores, strategy="hybrid", blocks=blocks)
    assert {r.question_id: r.decision for r in got.collect()} == {1: "routed", 2: "global", 3: "abstain", 4: "routed"}
    found = {(r.question_id, r.corpus_id): r["count"] for r in seen[0]}
    # equal scores by words: the first 25 of each corpus, as the nearest ones are; a question of one corpus has 50
    assert found == {(1, "a"): 25, (1, "b"): 25, (2, "a"): 26, (2, "b"): 24, (4, "b"): 50}
