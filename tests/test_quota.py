"""Quotas of small corpora beside crowded ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bm25, context, retrieval

CHUNK = "corpus_id string, chunk_id string, article_number string, chunk_index int, content string, vector array<double>"


def crowded(spark):
    """One question; 300 chunks of corpus a lie nearer than any of the 12 of corpus b."""
    a = [("a", f"a{i:03}", f"a{i}", 0, "x", [1.0, i / 1000]) for i in range(300)]
    b = [("b", f"b{i:02}", f"b{i}", 0, "y", [0.0, 1.0 + i]) for i in range(12)]
    return spark.createDataFrame([(1, [1.0, 0.0], ["a", "b"])], "question_id long, vector array<double>, predicted array<string>"), spark.createDataFrame(a + b, CHUNK)


def test_a_small_corpus_keeps_its_quota_in_the_context(spark):
    asked, chunks = crowded(spark)
    scores = chunks.select(F.lit(1).cast("long").alias("question_id"), "corpus_id", "chunk_id", F.when(F.col("corpus_id") == "b", 1.0).otherwise(0.1).alias("rerank_score"))
    got = context.answer_contexts(asked, chunks, scores).first()
    assert [s.corpus_id for s in got.sources] == ["b"] * 5


def test_k_nearest_of_each_corpus(spark, monkeypatch):
    asked, chunks = crowded(spark)
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    got = retrieval.vector_topk(asked, chunks, 10, by_corpus=True)
    assert sorted((r.corpus_id, r.rank, r.chunk_id) for r in got.collect()) == [("a", i + 1, f"a{i:03}") for i in range(10)] + [("b", i + 1, f"b{i:02}") for i in range(10)]
    found = retrieval.quota_topk(got, asked.select("question_id", F.col("predicted").alias("corpora")), 20)
    assert [r["count"] for r in found.groupBy("corpus_id").count().orderBy("corpus_id").collect()] == [10, 10]


def test_registered_depths_hold_beyond_ten_thousand_vectors(spark, tmp_path):
    from lexloom.plans import retrieval_queries

    # the vectors of corpora c1 to c3 point another way than the 10 300 of corpus c0
    rows = [(i, 0, [1.0, i / 1e6]) for i in range(10_300)] + [(10_300 + i, 1 + i % 3, [0.0, 1.0 + i]) for i in range(90)]
    rnd = np.random.default_rng(1).permutation(len(rows)).tolist()
    table = [(v, rows[j][1], rows[j][2]) for v, j in enumerate(rnd)]
    keep = {v: c for v, c, _ in table}
    few = {v for v in keep if v % 20 == 0 and v < 80}
    spark.createDataFrame([(v if v in few or v % 20 else v + 10**6 + 1, c, x) for v, c, x in table], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval_queries.g2(spark, str(tmp_path)).where("question_id IN (0, 20, 40, 60)").groupBy("question_id", "corpus_id").count().collect()
    routes = {0: ("c0", "c2"), 20: ("c0", "c1", "c3"), 40: ("c0", "c2"), 60: ("c0", "c1", "c3")}
    assert {(r.question_id, r.corpus_id) for r in got} == {(q, c) for q, cs in routes.items() for c in cs}


def test_explicit_corpora_overrule_and_none_searches_all(spark):
    asked, chunks = crowded(spark)
    asked = asked.drop("predicted").selectExpr("explode(array(1L, 2L, 3L, 4L)) AS question_id", "vector").selectExpr("question_id", "vector", "IF(question_id = 4, array(), array('a')) AS predicted", "CASE question_id WHEN 2 THEN array() WHEN 3 THEN array('b') END AS explicit")
    asked = asked.withColumn("predicted", F.col("predicted").cast("array<string>")).withColumn("explicit", F.col("explicit").cast("array<string>"))
    equal = lambda found: found.select("question_id", "corpus_id", "chunk_id", F.when(F.col("corpus_id") == "b", 1.0).otherwise(0.9).alias("rerank_score"))
    got = {r.question_id: (r.decision, {s.corpus_id for s in r.sources or []}) for r in context.answer_contexts(asked, chunks, equal).collect()}
    assert got == {1: ("routed", {"a"}), 2: ("global", {"a"}), 3: ("routed", {"b"}), 4: ("abstain", set())}


def test_hybrid_depths_are_fifty_and_fifty(spark):
    asked, chunks = crowded(spark)
    seen = []

    def scores(found):
        seen.append(found.groupBy("corpus_id").count().collect())
        return found.select("question_id", "corpus_id", "chunk_id", F.lit(0.5).alias("rerank_score"))

    blocks = bm25.bm25_blocks(chunks.withColumn("tokens", F.array("content")))
    asked = asked.withColumn("tokens", F.array(F.lit("y"))).withColumn("predicted", F.array(F.lit("a"), F.lit("b")))
    context.answer_contexts(asked, chunks, scores, strategy="hybrid", blocks=blocks)
    assert {r.corpus_id: r["count"] for r in seen[0]} == {"a": 25, "b": 12}
    # a global question has no hits by words, which corpus b alone could give
    context.answer_contexts(asked.withColumn("explicit", F.array().cast("array<string>")), chunks, scores, strategy="hybrid", blocks=blocks)
    assert {r.corpus_id: r["count"] for r in seen[1]} == {"a": 50}


def test_tiles_of_long_vectors_are_small(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    chunks = spark.createDataFrame([("a", f"{i:04}", rnd.normal(size=3072).tolist()) for i in range(300)], "corpus_id string, chunk_id string, vector array<double>").cache()
    asked = spark.createDataFrame([(i, rnd.normal(size=3072).tolist()) for i in range(40)], "question_id long, vector array<double>").cache()
    want = sorted(map(tuple, retrieval.vector_topk(asked, chunks, 3).select("question_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(retrieval, "TILE_BYTES", 1_000_000)
    assert retrieval._tiles(chunks) == 8 and retrieval._tiles(asked) == 1
    seen = spark.sparkContext.accumulator(0)
    plain = retrieval.matrix

    def matrix(vectors):
        rows = plain(vectors)
        if rows.nbytes > 3_000_000:  # hashes deal unevenly
            seen.add(1)
        return rows

    monkeypatch.setattr(retrieval, "matrix", matrix)
    assert sorted(map(tuple, retrieval.vector_topk(asked, chunks, 3).select("question_id", "rank", "chunk_id").collect())) == want
    assert seen.value == 0


@pytest.mark.parametrize("by_corpus", [False, True])
def test_a_task_keeps_k_rows_a_question(spark, monkeypatch, by_corpus):
    """Every pair of blocks handed on k rows a question and corpus, all of them held as Python rows first; a task keeps k over its whole lot."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(-2, 3, size=(60, 6)).astype(float)
    vectors = [base[i % 60].tolist() if i % 41 else [0.0] * 6 for i in range(640)]
    rows = [("ab"[i % 3 == 0], f"{i:04}", v) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "corpus_id string, chunk_id string, vector array<double>").repartition(3).cache()
    questions = [(i, vectors[i * 7], ["a"] if i % 2 else None, f"{i * 7:04}") for i in range(40)]
    asked = spark.createDataFrame(questions, "question_id long, vector array<double>, corpora array<string>, self string").cache()
    for name, value in (("BLOCK", 20), ("PIECE", 16), ("ASKED", 7), ("EMITTED", 11)):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    seen, plain = [], retrieval._ranked

    def ranked(df, by, *order):
        seen.append(df.count())
        return plain(df, by, *order)

    monkeypatch.setattr(retrieval, "_ranked", ranked)
    found = retrieval.vector_topk(asked, chunks, 5, corpora="corpora", exclude=("self", "chunk_id"), by_corpus=by_corpus).collect()
    want = []
    for q, v, only, own in questions:
        near = []
        for c, i, x in rows:
            if i != own and (only is None or c in only) and np.any(x) and np.any(v):
                near.append((round(1 - np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x)), 9), c, i))
        for some in ([[n for n in near if n[1] == c] for c in "ab"] if by_corpus else [near]):
            want += [(q, rank, c, i, d) for rank, (d, c, i) in enumerate(sorted(some)[:5], 1)]
    assert len(found) == len(want)
    assert sorted((r.question_id, r.corpus_id if by_corpus else "", r["rank"], round(r.distance, 9)) for r in found) == sorted((q, c if by_corpus else "", rank, d) for q, rank, c, _, d in want)
    by_id = {}
    for r in sorted(found, key=lambda r: (r.question_id, r.corpus_id, r["rank"])):  # copies of a vector come in order of their ids
        last = by_id.get((r.question_id, r.corpus_id, int(r.chunk_id) % 60))
        assert last is None or last < r.chunk_id
        by_id[r.question_id, r.corpus_id, int(r.chunk_id) % 60] = r.chunk_id
    assert seen[0] <= 2 * 40 * 5 * 8, seen


def test_contexts_search_once(spark, monkeypatch):
    """Scores, candidates and global questions each repeated the searches by vectors and by words."""
    asked, chunks = crowded(spark)
    blocks = bm25.bm25_blocks(chunks.withColumn("tokens", F.array("content")))
    asked = asked.withColumn("tokens", F.array(F.lit("y"))).cache()
    products, searches = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    matrix, block = retrieval.matrix, bm25._search_block

    def counted(vectors):
        products.add(1)
        return matrix(vectors)

    def searched(*args):
        searches.add(1)
        yield from block(*args)

    monkeypatch.setattr(retrieval, "matrix", counted)
    monkeypatch.setattr(bm25, "_search_block", searched)

    def scores(found):
        return found.select("question_id", "corpus_id", "chunk_id", F.lit(0.5).alias("rerank_score"))

    assert context.answer_contexts(asked, chunks, scores, strategy="hybrid", blocks=blocks).select("context").collect()[0][0]
    assert products.value <= 3 and searches.value == 1, (products.value, searches.value)
