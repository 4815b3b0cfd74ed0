"""Operator inputs made from the driver's tables, as SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # documents as articles; every one is one chunk
    "articles": "SELECT lang AS corpus_id, CAST(doc_id AS VARCHAR(20)) AS article_number, text AS content, source AS section, doc_id FROM documents",
    "chunks": "SELECT lang AS corpus_id, concat(CAST(doc_id AS VARCHAR(20)), '#0') AS chunk_id, CAST(doc_id AS VARCHAR(20)) AS article_number, text AS content, CAST(length(text) AS INT) AS char_count, doc_id FROM documents",
    # order lines as ranked lists, orders as questions
    "ranked": """SELECT l_orderkey AS question_id, concat('c', CAST(l_suppkey % 3 AS VARCHAR(3))) AS corpus_id,
        concat('a', CAST(l_partkey % 7 AS VARCHAR(3))) AS article_number,
        concat('a', CAST(l_partkey % 7 AS VARCHAR(3)), '#', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20))) AS chunk_id,
        l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n,
        count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem""",
    "rankings": """SELECT question_id, 'vector' AS variant, n AS rank, corpus_id, chunk_id, article_number, n / 100.0 AS distance FROM ranked
        UNION ALL SELECT question_id, 'bm25', m - n + 1, corpus_id, chunk_id, article_number, (m - n + 1) / 50.0 FROM ranked WHERE n % 4 <> 0 OR m - n < 2""",
    "gold": """SELECT o_orderkey AS question_id, concat('c', CAST(o_custkey % 3 AS VARCHAR(3))) AS corpus_id, concat('a', CAST(o_custkey % 7 AS VARCHAR(3))) AS article_number FROM orders WHERE o_orderkey % 5 <> 4
        UNION SELECT o_orderkey, concat('c', CAST((o_custkey + 1) % 3 AS VARCHAR(3))), concat('a', CAST((o_custkey * 3 + 1) % 7 AS VARCHAR(3))) FROM orders WHERE o_orderkey % 5 IN (1, 3)""",
    "questions": """SELECT o_orderkey AS question_id, CASE o_orderkey % 5 WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ambiguous' ELSE 'out-of-scope' END WHEN 0 THEN 'single-corpus' WHEN 2 THEN 'single-corpus' ELSE 'multi-corpus' END AS question_type,
        CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, o_custkey, o_totalprice FROM orders""",
    "reranked": """SELECT question_id, corpus_id, chunk_id, article_number, n AS rank, ((question_id * 31 + l_partkey * 17) % 100 - 5) / 100.0 AS rerank_score FROM ranked WHERE n <= 8""",
    # events as answers with judge scores and latencies
    "answers": """SELECT event_id AS question_id, event_type AS variant, CAST(event_id % 5 AS INT) AS correctness, CAST((event_id * 3 + user_id) % 5 AS INT) AS completeness, CAST(user_id % 5 AS INT) AS groundedness,
        event_id % 11 = 0 AS expected_abstention, event_id % 3 <> 0 AS abstention_correct, value AS latency_ms, user_id FROM events""",
}
#: Views that a view is made of.
NEEDS = {"rankings": ("ranked",), "reranked": ("ranked",)}


def sql(body: str, *views: str) -> str:
    """A query over the views, each spelled out before it."""
    order: list[str] = []
    for v in views:
        for x in (*NEEDS.get(v, ()), v):
            if x not in order:
                order.append(x)
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " if order else "") + body


def prefix(*views: str) -> str:
    """The views spelled out, for a query with more of its own."""
    return sql("", *views).rstrip()


def tables(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(sql(f"SELECT * FROM {name}", name).replace("VARCHAR(20)", "STRING").replace("VARCHAR(3)", "STRING"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out before work on their texts where a table is of fewer splits than there are cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
