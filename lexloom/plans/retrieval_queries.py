"""Queries over retrieval, context and metric operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, lexical_tokens, parse_context
from ..operators import bm25, context, metrics, retrieval
from ..operators.similarity_join import among
from ..sources.shared import stored
from .bindings import prefix, spread, sql, table, view

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: Lexical tokens in the SQL of the oracle.
TOKENS = rf"[x FOR x IN regexp_extract_all(lower(strip_accents(coalesce(@, ''))), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*') IF length(x) > 1 AND NOT list_contains([{_STOP}], x)]"


def tokens_sql(column: str) -> str:
    return TOKENS.replace("@", column)


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    chunks = e.select(F.concat(F.lit("c"), (F.col("label") % 4).cast("string")).alias("corpus_id"), F.col("vec_id").cast("string").alias("chunk_id"), "vector", "label")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "vector", F.when(F.col("vec_id") % 40 == 0, F.array(F.lit("c0"), F.lit("c2"))).alias("corpora"), F.col("vec_id").cast("string").alias("self"))
    return asked, chunks


def g1(spark, d):
    asked, chunks = _vectors(spark, d)
    return retrieval.vector_topk(asked, chunks, 10, corpora="corpora", exclude=("self", "chunk_id")).withColumn("distance", F.round("distance", 6))


_DIST = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, concat('c', CAST(label % 4 AS VARCHAR)) AS corpus_id FROM embeddings),
 s AS (SELECT q.vec_id AS question_id, c.corpus_id, CAST(c.vec_id AS VARCHAR) AS chunk_id, 1 - list_cosine_similarity(q.v, c.v) AS d FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND (q.vec_id % 40 = 20 OR c.corpus_id IN ('c0', 'c2')))"""
G1 = _DIST + " SELECT question_id, rank, corpus_id, chunk_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, corpus_id, chunk_id) AS rank FROM s) WHERE rank <= 10"


def _routed(asked: DataFrame) -> DataFrame:
    return asked.select("question_id", F.coalesce("corpora", F.array(F.lit("c1"), F.lit("c3"), F.lit("c0"))).alias("corpora"))


def g2(spark, d):
    asked, chunks = _vectors(spark, d)
    deep = retrieval.vector_topk(asked.drop("corpora"), chunks, 20, exclude=("self", "chunk_id"), by_corpus=True)
    return retrieval.quota_topk(deep, _routed(asked), 20).select("question_id", "rank", "corpus_id", "chunk_id")


_ALL = _DIST.replace(" AND (q.vec_id % 40 = 20 OR c.corpus_id IN ('c0', 'c2'))", "") + ", r AS (SELECT *, CASE WHEN question_id % 40 = 0 THEN 2 ELSE 3 END AS parts FROM s WHERE CASE WHEN question_id % 40 = 0 THEN corpus_id IN ('c0', 'c2') ELSE corpus_id IN ('c0', 'c1', 'c3') END)"
G2 = _ALL + """, i AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY d, chunk_id) AS n FROM r)
 SELECT question_id, rank, corpus_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, corpus_id, chunk_id) AS rank FROM i WHERE n <= ceil(20.0 / parts)) WHERE rank <= 20"""


def g3(spark, d):
    asked, chunks = _vectors(spark, d)
    deep = retrieval.vector_topk(asked.drop("corpora"), chunks, 50, exclude=("self", "chunk_id"), by_corpus=True)
    return retrieval.replay_depths(deep, _routed(asked)).groupBy("strategy", "k", "corpus_id").agg(F.count("*").alias("rows"), F.sum("rank").alias("ranks"))


G3 = _ALL + """, ks AS (SELECT unnest([20, 30, 40, 50]) AS k), g AS (SELECT 'global' AS strategy, k, corpus_id, row_number() OVER (PARTITION BY question_id, k ORDER BY d, corpus_id, chunk_id) AS rank FROM s, ks),
 i AS (SELECT r.*, k, row_number() OVER (PARTITION BY question_id, k, corpus_id ORDER BY d, chunk_id) AS n FROM r, ks),
 q AS (SELECT 'quota' AS strategy, k, corpus_id, row_number() OVER (PARTITION BY question_id, k ORDER BY d, corpus_id, chunk_id) AS rank FROM i WHERE n <= ceil(k * 1.0 / parts))
 SELECT strategy, k, corpus_id, count(*) AS rows, sum(rank) AS ranks FROM (SELECT * FROM g UNION ALL SELECT * FROM q) WHERE rank <= k GROUP BY ALL"""


def _lexical(spark, d):
    chunks = spread(view(spark, d, "chunks")).withColumn("tokens", lexical_tokens("content"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), lexical_tokens("text").alias("tokens"))
    return chunks, asked


def g4(spark, d):
    postings, df, stats = retrieval.bm25_index(_lexical(spark, d)[0])
    terms = df.groupBy("corpus_id").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return stats.join(terms, "corpus_id").select("corpus_id", "docs", F.round("avg_len", 6).alias("avg_len"), "terms", "postings")


_BM25 = f"""WITH c AS (SELECT lang AS corpus_id, concat(CAST(doc_id AS VARCHAR), '#0') AS chunk_id, {tokens_sql('text')} AS t FROM documents),
 p AS (SELECT corpus_id, chunk_id, len(t) AS len, unnest(t) AS term FROM c), tf AS (SELECT corpus_id, chunk_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
 df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT corpus_id, count(*) AS docs, avg(len(t)) AS avg_len FROM c GROUP BY ALL),"""
G4 = _BM25.rstrip(",") + " SELECT st.corpus_id, docs, round(avg_len, 6) AS avg_len, terms, postings FROM st JOIN (SELECT corpus_id, count(*) AS terms, sum(df) AS postings FROM df GROUP BY ALL) x ON x.corpus_id = st.corpus_id"
_SCORED = (
    _BM25
    + f""" q AS (SELECT item_id AS question_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT question_id, tf.corpus_id, chunk_id, sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s
  FROM q JOIN tf USING (term) JOIN df ON df.term = tf.term AND df.corpus_id = tf.corpus_id JOIN st ON st.corpus_id = tf.corpus_id GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY -round(s, 9), corpus_id, chunk_id) AS rank FROM sc WHERE s > 0)"""
)


def g5(spark, d):
    chunks, asked = _lexical(spark, d)
    return retrieval.bm25_topk(bm25.bm25_blocks(chunks, bm25.question_terms(asked)), asked, 20).withColumn("distance", F.round("distance", 6))


G5 = _SCORED + " SELECT question_id, rank, corpus_id, chunk_id, round(-round(s, 9), 6) AS distance FROM b WHERE rank <= 20"


def _lists(spark, d):
    r = view(spark, d, "rankings")
    return [r.where(F.col("variant") == v).drop("variant") for v in ("vector", "bm25")]


def g6(spark, d):
    return retrieval.hybrid_union(*_lists(spark, d)).select("question_id", "rank", "corpus_id", "chunk_id", "source")


G6 = sql("""SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY source DESC, old, corpus_id, chunk_id) AS rank, corpus_id, chunk_id, source FROM
 (SELECT question_id, variant AS source, rank AS old, corpus_id, chunk_id, row_number() OVER (PARTITION BY question_id, corpus_id, chunk_id ORDER BY variant DESC, rank) AS first FROM rankings) WHERE first = 1""", "rankings")


def g7(spark, d):
    return retrieval.rrf(view(spark, d, "rankings"), top=5).withColumn("rrf", F.round("rrf", 6))


G7 = sql("""SELECT question_id, corpus_id, chunk_id, round(s, 6) AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 12) DESC, corpus_id, chunk_id) AS rank FROM
 (SELECT question_id, corpus_id, chunk_id, sum(1.0 / (60 + rank)) AS s FROM rankings GROUP BY ALL)) WHERE rank <= 5""", "rankings")


def g8(spark, d):
    rows = view(spark, d, "rankings").where("variant = 'bm25'").withColumn("rank", F.when(F.col("rank") < 4, F.col("rank")))
    return retrieval.rank_chunks(rows).select("question_id", "rank", "corpus_id", "chunk_id")


G8 = sql("""SELECT question_id, coalesce(CASE WHEN rank < 4 THEN rank END, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN rank < 4 THEN rank END NULLS LAST, distance, corpus_id, chunk_id)) AS rank, corpus_id, chunk_id FROM rankings WHERE variant = 'bm25'""", "rankings")


def _rerank_inputs(spark, d):
    rows = view(spark, d, "reranked")
    scores = rows.where("question_id % 6 <> 0 AND rank <> 3").select("question_id", "corpus_id", "chunk_id", F.col("rerank_score").cast("double").alias("rerank_score"))
    return rows.select("question_id", "rank", "corpus_id", "chunk_id"), scores.groupBy("question_id", "corpus_id", "chunk_id").agg(F.max("rerank_score").alias("rerank_score"))


def g9(spark, d):
    return retrieval.apply_rerank(*_rerank_inputs(spark, d)).withColumn("rerank_score", F.round("rerank_score", 6))


_G9 = """, sc AS (SELECT question_id, corpus_id, chunk_id, max(rerank_score) AS s FROM reranked WHERE question_id % 6 <> 0 AND rank <> 3 GROUP BY ALL),
 j AS (SELECT r.question_id, r.rank AS old, r.corpus_id, r.chunk_id, CAST(s AS DOUBLE) AS s, count(s) OVER (PARTITION BY r.question_id) AS scored, count(*) OVER (PARTITION BY r.question_id) AS n FROM reranked r LEFT JOIN sc USING (question_id, corpus_id, chunk_id)),
 f AS (SELECT *, CASE WHEN scored = 0 OR n < 5 THEN 'fallback' ELSE 'reranked' END AS status FROM j),
 g AS (SELECT question_id, old, corpus_id, chunk_id, status, CASE WHEN status = 'reranked' THEN s END AS s FROM f WHERE status = 'fallback' OR s IS NOT NULL),
 top AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC NULLS LAST, old, corpus_id, chunk_id) AS rank, corpus_id, chunk_id, s AS rerank_score, status FROM g)"""
G9 = prefix("reranked") + _G9 + " SELECT question_id, rank, corpus_id, chunk_id, round(rerank_score, 6) AS rerank_score, status FROM top WHERE rank <= 5"


def _filter_input(spark, d):
    routed = view(spark, d, "gold").groupBy("question_id").agg(F.sort_array(F.collect_set("corpus_id")).alias("routed"))
    return view(spark, d, "reranked").withColumn("rerank_score", F.col("rerank_score").cast("double")).join(routed, "question_id", "left")


_AUDIT = prefix("reranked", "gold") + """, ro AS (SELECT question_id, list(DISTINCT corpus_id) AS routed FROM gold GROUP BY ALL),
 a AS (SELECT r.question_id, rank, corpus_id, chunk_id, article_number, CAST(rerank_score AS DOUBLE) AS score, routed, max(CASE WHEN rank = 1 THEN CAST(rerank_score AS DOUBLE) END) OVER (PARTITION BY r.question_id) AS best FROM reranked r LEFT JOIN ro USING (question_id) WHERE rank <= 5),
 k AS (SELECT *, CASE WHEN best <= 0 THEN CASE WHEN score = best THEN 1.0 ELSE 0.0 END ELSE score / best END AS relative FROM a),
 l AS (SELECT *, rank = 1 OR (best > 0 AND relative >= 0.4) AS keep FROM k),
 m AS (SELECT *, bool_or(keep) OVER (PARTITION BY question_id, corpus_id) AS has, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY score DESC, rank) AS place FROM l),
 n AS (SELECT *, keep OR coalesce(len(routed) > 1 AND list_contains(routed, corpus_id) AND NOT has AND place = 1, false) AS kept FROM m)"""


def g10(spark, d):
    return context.context_filter(_filter_input(spark, d)).select("question_id", "rank", "corpus_id", "chunk_id")


G10 = _AUDIT + " SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, corpus_id, chunk_id FROM n WHERE kept"


def g11(spark, d):
    return context.filter_audit(_filter_input(spark, d)).select("question_id", "rank", "chunk_id", F.round("relative", 6).alias("relative"), "kept")


G11 = _AUDIT + " SELECT question_id, rank, chunk_id, round(relative, 6) AS relative, kept FROM n"


def g12(spark, d):
    kept = context.context_filter(_filter_input(spark, d)).withColumn("chunk_index", F.length("chunk_id").cast("int")).withColumn("content", F.concat(F.lit("text of "), F.col("chunk_id")))
    built = context.build_context(kept)
    return built.select("question_id", F.md5("context").alias("context_md5"), F.size("sources").alias("sources"))


G12 = _AUDIT + """, o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS source_id FROM n WHERE kept)
 SELECT question_id, md5(string_agg(concat('[Source ', source_id, ' — ', corpus_id, ' — Article ', article_number, ' — chunk ', length(chunk_id), ']', chr(10), 'text of ', chunk_id), concat(chr(10), chr(10)) ORDER BY source_id)) AS context_md5, count(*) AS sources FROM o GROUP BY question_id"""


def b18(spark, d):
    """Contexts are built and read back."""
    kept = context.context_filter(_filter_input(spark, d)).withColumn("chunk_index", F.length("chunk_id").cast("int")).withColumn("content", F.concat(F.lit("text of "), F.col("chunk_id"), F.lit("\nand a second line")))
    return parse_context(context.build_context(kept), "context", ("question_id",))


B18 = _AUDIT + """, o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS source_id FROM n WHERE kept)
 SELECT question_id, CAST(source_id AS INTEGER) AS source_id, corpus_id AS code_name, article_number, CAST(length(chunk_id) AS INTEGER) AS chunk_index, concat('text of ', chunk_id, chr(10), 'and a second line') AS content FROM o"""


def g13(spark, d):
    asked, chunks = _vectors(spark, d)
    n = F.floor(F.col("question_id") / 20)
    none = F.array().cast("array<string>")
    asked = asked.select("question_id", "vector", F.when(n % 3 == 0, none).otherwise(F.coalesce("corpora", F.array(F.lit("c1")))).alias("predicted"), F.when(n % 7 == 0, none).when(n % 7 == 1, F.array(F.lit("c3"), F.lit("c1"))).alias("explicit"))
    texts = chunks.select("corpus_id", "chunk_id", F.col("chunk_id").alias("article_number"), F.lit(0).alias("chunk_index"), F.concat(F.lit("vector "), F.col("chunk_id")).alias("content"), "vector")

    def scores(found: DataFrame) -> DataFrame:
        some = found.where("(question_id div 20 + cast(chunk_id AS bigint)) % 5 <> 0")
        return some.select("question_id", "corpus_id", "chunk_id", (F.pmod(F.col("question_id") * 31 + F.col("chunk_id").cast("long") * 17, F.lit(100)) / 100.0).alias("rerank_score"))

    out = context.answer_contexts(asked, texts, scores)
    return out.select("question_id", "decision", F.md5("context").alias("context_md5"), F.size("sources").alias("sources"), "answer")


G13 = f"""WITH e AS (SELECT vec_id, vec_id // 20 AS t, CAST(embedding AS DOUBLE[]) AS v, concat('c', CAST(label % 4 AS VARCHAR)) AS corpus_id FROM embeddings),
 q AS (SELECT vec_id AS question_id, t, v, CASE WHEN t % 7 = 0 THEN 'global' WHEN t % 7 = 1 THEN 'routed' WHEN t % 3 = 0 THEN 'abstain' ELSE 'routed' END AS decision,
  CASE WHEN t % 7 = 0 THEN NULL WHEN t % 7 = 1 THEN ['c3', 'c1'] WHEN t % 3 = 0 THEN NULL WHEN t % 2 = 0 THEN ['c0', 'c2'] ELSE ['c1'] END AS corpora FROM e WHERE vec_id % 20 = 0),
 s AS (SELECT q.*, e.corpus_id, e.vec_id, CAST(e.vec_id AS VARCHAR) AS chunk_id, 1 - list_cosine_similarity(q.v, e.v) AS d FROM q JOIN e ON q.decision = 'global' OR list_contains(q.corpora, e.corpus_id)),
 i AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY d, chunk_id) AS n FROM s),
 f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, corpus_id, chunk_id) AS old FROM i WHERE n <= ceil(20.0 / coalesce(len(corpora), 1))),
 c AS (SELECT *, CASE WHEN (t + vec_id) % 5 <> 0 THEN (question_id * 31 + vec_id * 17) % 100 / 100.0 END AS x FROM f WHERE old <= 20),
 w AS (SELECT *, count(x) OVER (PARTITION BY question_id) = 0 OR count(*) OVER (PARTITION BY question_id) < 5 AS plain FROM c),
 r AS (SELECT question_id, corpora, corpus_id, chunk_id, CASE WHEN NOT plain THEN x END AS x, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN NOT plain THEN x END DESC NULLS LAST, old, corpus_id, chunk_id) AS rank FROM w WHERE plain OR x IS NOT NULL),
 a AS (SELECT *, coalesce(x, 0) AS score, max(CASE WHEN rank = 1 THEN coalesce(x, 0) END) OVER (PARTITION BY question_id) AS best FROM r WHERE rank <= 5),
 k AS (SELECT *, rank = 1 OR best > 0 AND score / best >= 0.4 AS kept FROM a),
 m AS (SELECT *, max(kept) OVER (PARTITION BY question_id, corpus_id) AS any_kept, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY score DESC, rank) AS place FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS source_id FROM m WHERE kept OR len(corpora) > 1 AND NOT any_kept AND place = 1),
 b AS (SELECT question_id, md5(string_agg(concat('[Source ', source_id, ' — ', corpus_id, ' — Article ', chunk_id, ' — chunk 0]', chr(10), 'vector ', chunk_id), concat(chr(10), chr(10)) ORDER BY source_id)) AS context_md5, CAST(count(*) AS INTEGER) AS sources FROM o GROUP BY question_id)
 SELECT q.question_id, q.decision, b.context_md5, b.sources, CASE WHEN q.decision = 'abstain' THEN '{context.ABSTAINED}' END AS answer FROM q LEFT JOIN b USING (question_id)"""


def g13h(spark, d):
    """Vectors beside the documents of the same number, asked with the first twelve words of a document."""
    asked, chunks = _vectors(spark, d)
    # only documents that a vector goes with are cut into tokens, once
    docs = among(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), "chunk_id", chunks.select("chunk_id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    docs, chunks = docs.repartition(parts, "chunk_id"), chunks.repartition(parts, "chunk_id")  # as many tasks however few the bytes
    both = stored(chunks.join(docs, "chunk_id").withColumn("tokens", lexical_tokens("text")).drop("text"))
    n = F.floor(F.col("question_id") / 20)
    none = F.array().cast("array<string>")
    asked = asked.join(both.select(F.col("chunk_id").alias("self"), F.slice("tokens", 1, 12).alias("tokens")).where("self % 20 = 0"), "self")
    asked = stored(asked.select("question_id", "vector", "tokens", F.when(n % 3 == 0, none).otherwise(F.coalesce("corpora", F.array(F.lit("c1")))).alias("predicted"), F.when(n % 7 == 0, none).when(n % 7 == 1, F.array(F.lit("c3"), F.lit("c1"))).alias("explicit")))
    texts = both.select("corpus_id", "chunk_id", F.col("chunk_id").alias("article_number"), F.lit(0).alias("chunk_index"), F.concat(F.lit("vector "), F.col("chunk_id")).alias("content"), "vector")

    def scores(found: DataFrame) -> DataFrame:
        some = found.where("(question_id div 20 + cast(chunk_id AS bigint)) % 5 <> 0")
        return some.select("question_id", "corpus_id", "chunk_id", (F.pmod(F.col("question_id") * 31 + F.col("chunk_id").cast("long") * 17, F.lit(100)) / 100.0).alias("rerank_score"))

    blocks = bm25.bm25_blocks(both, bm25.question_terms(asked))
    out = context.answer_contexts(asked, texts, scores, strategy="hybrid", blocks=blocks)
    return out.select("question_id", "decision", F.md5("context").alias("context_md5"), F.size("sources").alias("sources"), "answer")


_G13_END = G13[G13.index(" c AS (SELECT *, CASE") :]
G13H = f"""WITH e AS (SELECT vec_id, vec_id // 20 AS t, CAST(embedding AS DOUBLE[]) AS v, concat('c', CAST(label % 4 AS VARCHAR)) AS corpus_id, {tokens_sql('text')} AS tk FROM embeddings JOIN documents ON doc_id = vec_id),
 q AS (SELECT vec_id AS question_id, t, v, tk[1:12] AS tk, CASE WHEN t % 7 = 0 THEN 'global' WHEN t % 7 = 1 THEN 'routed' WHEN t % 3 = 0 THEN 'abstain' ELSE 'routed' END AS decision,
  CASE WHEN t % 7 = 0 THEN NULL WHEN t % 7 = 1 THEN ['c3', 'c1'] WHEN t % 3 = 0 THEN NULL WHEN t % 2 = 0 THEN ['c0', 'c2'] ELSE ['c1'] END AS corpora FROM e WHERE vec_id % 20 = 0),
 s AS (SELECT q.question_id, q.t, q.corpora, e.corpus_id, e.vec_id, CAST(e.vec_id AS VARCHAR) AS chunk_id, 1 - list_cosine_similarity(q.v, e.v) AS d FROM q JOIN e ON q.decision = 'global' OR list_contains(q.corpora, e.corpus_id)),
 i AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY d, chunk_id) AS n FROM s),
 ve AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, corpus_id, chunk_id) AS k FROM i WHERE n <= ceil(50.0 / coalesce(len(corpora), 1))),
 tf AS (SELECT vec_id, corpus_id, len, term, count(*) AS tf FROM (SELECT vec_id, corpus_id, len(tk) AS len, unnest(tk) AS term FROM e) GROUP BY ALL), df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT corpus_id, count(*) AS docs, avg(len(tk)) AS mean FROM e GROUP BY ALL),
 qt AS (SELECT question_id, t, corpora, term, count(*) AS qtf FROM (SELECT question_id, t, corpora, unnest(tk) AS term FROM q WHERE decision = 'routed') GROUP BY ALL),
 sc AS (SELECT question_id, t, corpora, tf.corpus_id, vec_id, CAST(vec_id AS VARCHAR) AS chunk_id, -round(sum(qtf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS d
  FROM qt JOIN tf USING (term) JOIN df ON df.term = tf.term AND df.corpus_id = tf.corpus_id JOIN st ON st.corpus_id = tf.corpus_id WHERE list_contains(corpora, tf.corpus_id) GROUP BY ALL),
 bi AS (SELECT *, row_number() OVER (PARTITION BY question_id, corpus_id ORDER BY d, chunk_id) AS n FROM sc), bm AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, corpus_id, chunk_id) AS k FROM bi WHERE n <= ceil(50.0 / len(corpora))),
 un AS (SELECT 0 AS z, question_id, t, corpora, corpus_id, vec_id, chunk_id, k FROM ve WHERE k <= 50 UNION ALL SELECT 1, question_id, t, corpora, corpus_id, vec_id, chunk_id, k FROM bm WHERE k <= 50),
 fi AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY z) AS y FROM un), f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY z, k, corpus_id, chunk_id) AS old FROM fi WHERE y = 1),
{_G13_END.replace("FROM f WHERE old <= 20)", "FROM f)")}"""


def _first(spark, d):
    return metrics.first_gold_rank(view(spark, d, "rankings"), view(spark, d, "gold"))


_FIRST = prefix("rankings", "gold") + """, v AS (SELECT DISTINCT variant FROM rankings),
 fr AS (SELECT g.question_id, v.variant, g.corpus_id, g.article_number, min(r.rank) AS first_rank FROM gold g CROSS JOIN v LEFT JOIN rankings r ON r.question_id = g.question_id AND r.variant = v.variant AND r.corpus_id = g.corpus_id AND r.article_number = g.article_number GROUP BY ALL)"""


def g14(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector'")
    return retrieval.neighbor_window(r, _first(spark, d).where("variant = 'vector'"), 2, 2).select("question_id", "corpus_id", "gold_article", "chunk_id", "rank", "offset")


G14 = _FIRST + " SELECT f.question_id, f.corpus_id, f.article_number AS gold_article, r.chunk_id, r.rank, r.rank - f.first_rank AS \"offset\" FROM fr f JOIN rankings r ON r.variant = f.variant AND r.question_id = f.question_id AND r.corpus_id = f.corpus_id AND r.rank BETWEEN f.first_rank - 2 AND f.first_rank + 2 WHERE f.variant = 'vector'"


def h1(spark, d):
    return metrics.dedupe_articles(view(spark, d, "rankings"))


_H1 = "(SELECT question_id, variant, corpus_id, article_number, row_number() OVER (PARTITION BY question_id, variant ORDER BY first, corpus_id, article_number) AS rank FROM (SELECT question_id, variant, corpus_id, article_number, min(rank) AS first FROM rankings GROUP BY ALL))"
H1 = sql(f"SELECT * FROM {_H1}", "rankings")
H2 = _FIRST + " SELECT * FROM fr"


def h3(spark, d):
    return metrics.recall_summary(metrics.recall_any(view(spark, d, "rankings"), view(spark, d, "questions"), view(spark, d, "gold"), (1, 3)), "vector").select("variant", "questions", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "mrr", "delta_recall_3", "delta_mrr")])


H3 = sql(f"""SELECT variant, count(*) AS questions, round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(m), 6) AS mrr, round(100 * (avg(r3) - (SELECT avg(r3) FROM pq WHERE variant = 'vector')), 6) AS delta_recall_3, round(100 * (avg(m) - (SELECT avg(m) FROM pq WHERE variant = 'vector')), 6) AS delta_mrr FROM pq GROUP BY variant""", "rankings", "gold", "questions").replace(" SELECT variant, count(*) AS questions", f""", dd AS (SELECT * FROM {_H1}), v AS (SELECT DISTINCT variant FROM rankings),
 fq AS (SELECT q.question_id, v.variant, min(CASE WHEN g.question_id IS NOT NULL THEN dd.rank END) AS r FROM questions q CROSS JOIN v LEFT JOIN dd ON dd.question_id = q.question_id AND dd.variant = v.variant LEFT JOIN gold g ON g.question_id = dd.question_id AND g.corpus_id = dd.corpus_id AND g.article_number = dd.article_number GROUP BY ALL),
 pq AS (SELECT question_id, variant, CASE WHEN r <= 1 THEN 1 ELSE 0 END AS r1, CASE WHEN r <= 3 THEN 1 ELSE 0 END AS r3, coalesce(1.0 / r, 0) AS m FROM fq) SELECT variant, count(*) AS questions""", 1)


def h4(spark, d):
    means = metrics.mean_snapshot(metrics.retrieval_snapshot(view(spark, d, "rankings"), view(spark, d, "gold"), (1, 3, 5)))
    return means.select("variant", "questions", *[F.round(c, 6).alias(c) for c in means.columns[2:]])


H4 = _FIRST + """, s AS (SELECT question_id, variant, avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0 END) AS c, coalesce(1.0 / min(first_rank), 0) AS m FROM fr GROUP BY ALL)
 SELECT variant, count(*) AS questions, round(avg(a), 6) AS macro_recall_1, round(avg(b), 6) AS macro_recall_3, round(avg(c), 6) AS macro_recall_5, round(avg(m), 6) AS macro_mrr FROM s GROUP BY variant"""


def h5(spark, d):
    return metrics.coverage_at(view(spark, d, "rankings"), view(spark, d, "gold"), 3).withColumn("corpus_coverage", F.round("corpus_coverage", 6))


H5 = _FIRST + " SELECT question_id, variant, bool_and(coalesce(first_rank <= 3, false)) AS full_coverage, round(count(DISTINCT CASE WHEN first_rank <= 3 THEN corpus_id END) * 1.0 / count(DISTINCT corpus_id), 6) AS corpus_coverage FROM fr GROUP BY ALL"
KS = (1, 2, 4, 6)


def h6(spark, d):
    curve = metrics.depth_curve(_first(spark, d), KS)
    return curve.select("variant", "k", *[F.round(c, 6).alias(c) for c in ("micro_recall", "full_coverage", "corpus_coverage")], "absent")


_CURVE = _FIRST + """, ks AS (SELECT unnest([1, 2, 4, 6]) AS k), dq AS (SELECT variant, k, question_id, count(*) AS gold, count(*) FILTER (first_rank <= k) AS hits, count(DISTINCT corpus_id) AS co, count(DISTINCT CASE WHEN first_rank <= k THEN corpus_id END) AS hc FROM fr, ks GROUP BY ALL),
 cu AS (SELECT variant, k, sum(hits) / sum(gold) AS micro_recall, avg(CASE WHEN hits = gold THEN 1.0 ELSE 0 END) AS full_coverage, avg(CASE WHEN hc = co THEN 1.0 ELSE 0 END) AS corpus_coverage, sum(gold) - sum(hits) AS absent FROM dq GROUP BY ALL)"""
H6 = _CURVE + " SELECT variant, k, round(micro_recall, 6) AS micro_recall, round(full_coverage, 6) AS full_coverage, round(corpus_coverage, 6) AS corpus_coverage, absent FROM cu"


def h6b(spark, d):
    return metrics.marginal_gains(metrics.depth_curve(_first(spark, d), KS)).withColumn("gain", F.round("gain", 6))


H6B = _CURVE + " SELECT * FROM (SELECT variant, k, lag(k) OVER w AS from_k, round(micro_recall - lag(micro_recall) OVER w, 6) AS gain, lag(absent) OVER w - absent AS recovered FROM cu WINDOW w AS (PARTITION BY variant ORDER BY k)) WHERE from_k IS NOT NULL"


def h7(spark, d):
    return metrics.depth_summary(metrics.gold_depth(_first(spark, d), KS), KS).withColumn("share", F.round("share", 6))


H7 = _FIRST + """, b AS (SELECT variant, CASE WHEN first_rank IS NULL OR first_rank > 6 THEN 'absent' WHEN first_rank <= 1 THEN '01-01' WHEN first_rank <= 2 THEN '02-02' WHEN first_rank <= 4 THEN '03-04' ELSE '05-06' END AS band FROM fr),
 e AS (SELECT variant, count(*) AS n, unnest(['01-01', '02-02', '03-04', '05-06', 'absent']) AS band FROM b GROUP BY variant)
 SELECT e.variant, e.band, count(b.band) AS gold, round(count(b.band) * 1.0 / any_value(n), 6) AS share FROM e LEFT JOIN b ON b.variant = e.variant AND b.band = e.band GROUP BY ALL"""


def h8(spark, d):
    return metrics.gold_contribution(*_lists(spark, d), view(spark, d, "gold"), depth=3).groupBy("found_by").agg(F.count("*").alias("gold"))


H8 = _FIRST + " SELECT found_by, count(*) AS gold FROM (SELECT CASE WHEN v AND b THEN 'both' WHEN v THEN 'vector' WHEN b THEN 'bm25' ELSE 'none' END AS found_by FROM (SELECT question_id, corpus_id, article_number, coalesce(bool_or(variant = 'vector' AND first_rank <= 3), false) AS v, coalesce(bool_or(variant = 'bm25' AND first_rank <= 3), false) AS b FROM fr GROUP BY ALL)) GROUP BY ALL"


def h9(spark, d):
    s = metrics.variant_summary(_first(spark, d), 4)
    return s.join(metrics.candidate_counts(view(spark, d, "rankings")), "variant").select("variant", "questions", "gold", *[F.round(c, 6).alias(c) for c in ("micro_recall", "full_coverage", "multi_corpus_coverage", "mean")], "min", "max", F.col("median").cast("double").alias("median"))


H9 = _FIRST + """, q AS (SELECT variant, question_id, count(*) AS gold, count(*) FILTER (first_rank <= 4) AS hits, count(DISTINCT corpus_id) AS co, count(DISTINCT CASE WHEN first_rank <= 4 THEN corpus_id END) AS hc FROM fr GROUP BY ALL),
 s AS (SELECT variant, count(*) AS questions, sum(gold) AS gold, round(sum(hits) / sum(gold), 6) AS micro_recall, round(avg(CASE WHEN hits = gold THEN 1.0 ELSE 0 END), 6) AS full_coverage, round(avg(CASE WHEN co > 1 THEN CASE WHEN hc = co THEN 1.0 ELSE 0 END END), 6) AS multi_corpus_coverage FROM q GROUP BY ALL),
 n AS (SELECT variant, question_id, count(*) AS n FROM rankings GROUP BY ALL) SELECT s.*, x.mean, x.min, x.max, x.median FROM s JOIN (SELECT variant, round(avg(n), 6) AS mean, min(n) AS min, max(n) AS max, quantile_cont(n, 0.5) AS median FROM n GROUP BY ALL) x USING (variant)"""


def _stages(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector'")
    return r.withColumn("stage", F.explode(F.when(F.col("rank") <= 2, F.array(F.lit("retrieval"), F.lit("rerank"), F.lit("filter"))).when(F.col("rank") <= 4, F.array(F.lit("retrieval"), F.lit("rerank"))).otherwise(F.array(F.lit("retrieval")))))


_STAGES = prefix("rankings", "gold") + ", st AS (SELECT r.*, stage FROM rankings r, (VALUES ('retrieval', 99), ('rerank', 4), ('filter', 2)) x(stage, most) WHERE variant = 'vector' AND rank <= most)"


def h10(spark, d):
    f = metrics.stage_funnel(_stages(spark, d), view(spark, d, "gold"))
    return f.select("variant", "stage", *[F.round(c, 6).alias(c) for c in f.columns[2:]])


H10 = _STAGES + """, fr AS (SELECT g.question_id, s.stage, g.corpus_id, g.article_number, min(st.rank) AS r FROM gold g CROSS JOIN (SELECT DISTINCT stage FROM st) s LEFT JOIN st ON st.stage = s.stage AND st.question_id = g.question_id AND st.corpus_id = g.corpus_id AND st.article_number = g.article_number GROUP BY ALL),
 q AS (SELECT stage, question_id, count(*) AS gold, count(r) AS hits, count(DISTINCT corpus_id) AS co, count(DISTINCT CASE WHEN r IS NOT NULL THEN corpus_id END) AS hc FROM fr GROUP BY ALL)
 SELECT 'vector' AS variant, stage, round(sum(hits) / sum(gold), 6) AS micro_recall, round(avg(CASE WHEN hits = gold THEN 1.0 ELSE 0 END), 6) AS full_coverage, round(avg(CASE WHEN hc = co THEN 1.0 ELSE 0 END), 6) AS corpus_coverage FROM q GROUP BY ALL"""


def h11(spark, d):
    s = metrics.retrieval_snapshot(view(spark, d, "rankings"), view(spark, d, "gold"), (3,))
    parts = [s.where(F.col("variant") == v) for v in ("vector", "bm25")]
    return metrics.rerank_effect(*parts, recall="recall_3").groupBy("effect").agg(F.count("*").alias("questions"))


H11 = _FIRST + """, s AS (SELECT question_id, variant, avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0 END) AS r, coalesce(1.0 / min(first_rank), 0) AS m FROM fr GROUP BY ALL)
 SELECT CASE WHEN b.r > a.r OR b.m > a.m THEN 'improved' WHEN b.r < a.r OR b.m < a.m THEN 'degraded' ELSE 'unchanged' END AS effect, count(*) AS questions FROM s a JOIN s b ON a.question_id = b.question_id AND a.variant = 'vector' AND b.variant = 'bm25' GROUP BY ALL"""


def h12(spark, d):
    routed = view(spark, d, "gold").groupBy("question_id").agg(F.collect_set("corpus_id").alias("corpora"))
    b = metrics.strategy_balance(view(spark, d, "rankings"), routed, view(spark, d, "gold"))
    return b.select("variant", "questions", *[F.round(c, 6).alias(c) for c in ("mean_corpora", "monopoly_rate", "all_corpora_rate")], "min_gold_rank", "median_gold_rank", "p90_gold_rank")


H12 = _FIRST + """, sz AS (SELECT variant, question_id, count(DISTINCT corpus_id) AS corpora FROM rankings GROUP BY ALL), ro AS (SELECT question_id, count(DISTINCT corpus_id) AS asked FROM gold GROUP BY ALL),
 l AS (SELECT variant, count(*) AS questions, round(avg(corpora), 6) AS mean_corpora, round(avg(CASE WHEN corpora = 1 THEN 1.0 ELSE 0 END), 6) AS monopoly_rate, round(avg(CASE WHEN corpora >= asked THEN 1.0 ELSE 0 END), 6) AS all_corpora_rate FROM sz JOIN ro USING (question_id) WHERE asked > 1 GROUP BY ALL)
 SELECT l.*, min_gold_rank, median_gold_rank, p90_gold_rank FROM l LEFT JOIN (SELECT variant, min(first_rank) AS min_gold_rank, quantile_disc(first_rank, 0.5) AS median_gold_rank, quantile_disc(first_rank, 0.9) AS p90_gold_rank FROM fr WHERE first_rank IS NOT NULL GROUP BY ALL) x USING (variant)"""


def h13(spark, d):
    return metrics.threshold_grid(_filter_input(spark, d), view(spark, d, "gold"), (0.2, 0.4, 0.6))


_GRID = _AUDIT.replace("l AS (SELECT *, rank = 1 OR (best > 0 AND relative >= 0.4) AS keep FROM k)", "l AS (SELECT k.*, threshold, rank = 1 OR (best > 0 AND relative >= threshold) AS keep FROM k, (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS threshold))").replace("PARTITION BY question_id, corpus_id", "PARTITION BY threshold, question_id, corpus_id")
H13 = _GRID + """, z AS (SELECT 'standard' AS strategy, * FROM n WHERE keep UNION ALL SELECT 'min-one', * FROM n WHERE kept)
 SELECT strategy, threshold, count(*) AS chunks, count(DISTINCT z.question_id) AS questions, count(DISTINCT CASE WHEN g.question_id IS NOT NULL THEN concat_ws('/', z.question_id, z.corpus_id, z.article_number) END) AS gold_kept, count(DISTINCT concat_ws('/', z.question_id, z.corpus_id)) AS corpora_kept
 FROM z LEFT JOIN gold g ON g.question_id = z.question_id AND g.corpus_id = z.corpus_id AND g.article_number = z.article_number GROUP BY ALL"""


def h14(spark, d):
    return metrics.corpus_loss_class(_stages(spark, d).select("question_id", "stage", "corpus_id"), view(spark, d, "gold")).groupBy("loss_class").agg(F.count("*").alias("questions"))


H14 = _STAGES + """, two AS (SELECT question_id FROM gold GROUP BY question_id HAVING count(DISTINCT corpus_id) = 2),
 h AS (SELECT two.question_id, count(DISTINCT CASE WHEN stage = 'retrieval' THEN g.corpus_id END) AS a, count(DISTINCT CASE WHEN stage = 'rerank' THEN g.corpus_id END) AS b, count(DISTINCT CASE WHEN stage = 'filter' THEN g.corpus_id END) AS c FROM two LEFT JOIN (SELECT DISTINCT question_id, corpus_id FROM gold) g ON g.question_id = two.question_id LEFT JOIN st ON st.question_id = g.question_id AND st.corpus_id = g.corpus_id GROUP BY ALL)
 SELECT CASE WHEN c = 2 THEN 'A' WHEN a < 2 THEN 'D' WHEN b < 2 THEN 'B' ELSE 'C' END AS loss_class, count(*) AS questions FROM h GROUP BY ALL"""


def _by_score(spark, d):
    r = view(spark, d, "reranked").withColumn("rerank_score", (F.col("rerank_score") + 0.06).cast("double")).withColumnRenamed("rank", "old")
    return retrieval._ranked(r, ["question_id"], F.desc("rerank_score"), "old")


_SORTED = prefix("reranked", "gold") + """, so AS (SELECT question_id, corpus_id, article_number, CAST(rerank_score + 0.06 AS DOUBLE) AS s, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS rank FROM reranked),
 sg AS (SELECT so.*, g.question_id IS NOT NULL AS is_gold, lag(s) OVER w - s AS gap, first_value(s) OVER w AS best FROM so LEFT JOIN gold g USING (question_id, corpus_id, article_number) WINDOW w AS (PARTITION BY so.question_id ORDER BY rank))"""


def h15(spark, d):
    return metrics.score_gaps(_by_score(spark, d), view(spark, d, "gold")).select("question_id", F.round("largest_gap", 6).alias("largest_gap"), F.round("mean_gap", 6).alias("mean_gap"), F.round("lowest_relative", 6).alias("lowest_relative"), "last_gold_rank")


H15 = _SORTED + " SELECT question_id, round(max(gap), 6) AS largest_gap, round(avg(gap), 6) AS mean_gap, round(min(CASE WHEN best > 0 THEN s / best END), 6) AS lowest_relative, max(CASE WHEN is_gold THEN rank END) AS last_gold_rank FROM sg GROUP BY question_id"


def h16(spark, d):
    s = metrics.threshold_sensitivity(_by_score(spark, d), view(spark, d, "gold"), (0.1, 0.3, 0.5, 0.7))
    return s.withColumn("mean_docs", F.round("mean_docs", 6))


H16 = _SORTED + """, q AS (SELECT threshold, question_id, count(*) FILTER (s / best >= threshold) AS docs, count(*) FILTER (s / best >= threshold AND is_gold) AS kept, count(*) FILTER (NOT s / best >= threshold AND is_gold) AS lost FROM sg, (SELECT unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold) GROUP BY ALL)
 SELECT threshold, round(avg(docs), 6) AS mean_docs, min(docs) AS min_docs, max(docs) AS max_docs, sum(kept) AS gold_kept, sum(lost) AS gold_lost, count(*) FILTER (lost > 0) AS questions_losing FROM q GROUP BY threshold"""


def h17(spark, d):
    runs = view(spark, d, "answers").withColumn("context_chars", (F.col("question_id") * 37 % 5000).cast("long"))
    return metrics.variant_report(runs).withColumn("p95_context_chars", F.round("p95_context_chars", 6))


H17 = sql("""SELECT variant, count(*) AS answers, round(avg(correctness), 6) AS mean_correctness, round(avg(completeness), 6) AS mean_completeness, round(avg(groundedness), 6) AS mean_groundedness, round(avg(question_id * 37 % 5000), 6) AS mean_context_chars, round(quantile_cont(question_id * 37 % 5000, 0.95), 6) AS p95_context_chars, count(*) FILTER (correctness >= 3 AND groundedness >= 3) AS passing FROM answers GROUP BY variant""", "answers")

QUERIES = {
    "b18_parse_context": (b18, B18), "g1_vector_topk": (g1, G1), "g2_quota_topk": (g2, G2), "g3_replay_depths": (g3, G3), "g4_bm25_index": (g4, G4), "g5_bm25_topk": (g5, G5), "g6_hybrid_union": (g6, G6), "g7_rrf": (g7, G7), "g8_rank_chunks": (g8, G8),
    "g9_apply_rerank": (g9, G9), "g10_context_filter": (g10, G10), "g11_filter_audit": (g11, G11), "g12_build_context": (g12, G12), "g13_answer_contexts": (g13, G13), "g13_hybrid_contexts": (g13h, G13H), "g14_neighbor_window": (g14, G14),
    "h1_dedupe_articles": (h1, H1), "h2_first_gold_rank": (_first, H2), "h3_recall_any": (h3, H3), "h4_retrieval_snapshot": (h4, H4), "h5_coverage": (h5, H5), "h6_depth_curve": (h6, H6), "h6_marginal_gains": (h6b, H6B), "h7_gold_depth": (h7, H7),
    "h8_gold_contribution": (h8, H8), "h9_variant_summary": (h9, H9), "h10_stage_funnel": (h10, H10), "h11_rerank_effect": (h11, H11), "h12_strategy_balance": (h12, H12), "h13_threshold_grid": (h13, H13), "h14_corpus_loss_class": (h14, H14),
    "h15_score_gaps": (h15, H15), "h16_threshold_sensitivity": (h16, H16), "h17_variant_report": (h17, H17),
}
__all__ = ["QUERIES", "tokens_sql"]
