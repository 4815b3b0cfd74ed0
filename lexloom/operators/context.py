"""From reranked lists to answer contexts: relative-score filter, audit, assembly, whole batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import relative_score, routing_decision
from ..sources.shared import stored
from .retrieval import KEY, apply_rerank, bm25_quota, hybrid_union, quota_topk, vector_topk

#: What a question without a corpus is answered.
ABSTAINED = "Je ne peux pas répondre à cette question à partir des documents disponibles."


def filter_audit(reranked: DataFrame, threshold: float = 0.4, min_one: bool = True, cap: int = 5, by: tuple[str, ...] = ("question_id",), threshold_column: str | None = None) -> DataFrame:
    """Every candidate among the first `cap`, with best, relative and kept.

    reranked: question_id, rank, corpus_id, chunk_id, rerank_score and, for min_one, routed (array of
    corpora). The score at rank 1, not the greatest, is the yardstick; missing scores are 0; if it isn't
    positive only rank 1 stays. With several routed corpora each that the first `cap` hold keeps its best."""
    w = Window.partitionBy(*by)
    capped = reranked.where(F.col("rank") <= cap).withColumn("score", F.coalesce("rerank_score", F.lit(0.0)))
    capped = capped.withColumn("best", F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w)).withColumn("relative", relative_score("score", "best"))
    limit = F.col(threshold_column) if threshold_column else F.lit(threshold)
    kept = (F.col("rank") == 1) | ((F.col("best") > 0) & (F.col("relative") >= limit))
    capped = capped.withColumn("kept", kept)
    if min_one:
        of_corpus = Window.partitionBy(*by, "corpus_id")
        place = F.row_number().over(of_corpus.orderBy(F.desc("score"), "rank"))
        rescue = (F.size("routed") > 1) & F.array_contains("routed", F.col("corpus_id")) & ~F.max("kept").over(of_corpus) & (F.col("place") == 1)
        capped = capped.withColumn("place", place).withColumn("kept", F.col("kept") | F.coalesce(rescue, F.lit(False))).drop("place")
    return capped


def context_filter(reranked: DataFrame, threshold: float = 0.4, min_one: bool = True, cap: int = 5) -> DataFrame:
    """The rows that filter_audit keeps, ranked anew in their order."""
    kept = filter_audit(reranked, threshold, min_one, cap).where("kept")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def build_context(kept: DataFrame) -> DataFrame:
    """(question_id, context, sources): numbered blocks in order, joined by blank lines.

    kept: question_id, rank, corpus_id, chunk_id, article_number, chunk_index, content and optionally
    code_name. A question has at most a handful of rows, so that its list is small."""
    name = F.coalesce(F.when(F.trim("code_name") != "", F.trim("code_name")), F.col("corpus_id")) if "code_name" in kept.columns else F.col("corpus_id")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    numbered = kept.withColumn("source_id", place).withColumn("name", name)
    block = F.format_string("[Source %d — %s — Article %s — chunk %d]\n%s", "source_id", "name", "article_number", "chunk_index", "content")
    rows = F.sort_array(F.collect_list(F.struct("source_id", *KEY, "article_number", block.alias("block"))))
    out = numbered.groupBy("question_id").agg(rows.alias("rows"))
    return out.select("question_id", F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n").alias("context"), F.transform("rows", lambda r: F.struct(r["source_id"].alias("source_id"), *[r[c].alias(c) for c in (*KEY, "article_number")])).alias("sources"))


def answer_contexts(
    questions: DataFrame, chunks: DataFrame, scores: DataFrame | Callable[[DataFrame], DataFrame], strategy: str = "vector", k: int = 20, n: int = 5, threshold: float = 0.4, blocks: DataFrame | None = None, depth: int = 50
) -> DataFrame:
    """(question_id, decision, context, sources, answer) of every question.

    questions: question_id, vector, predicted (corpora), optionally explicit (corpora that overrule the predicted
    ones; an empty list searches all) and, for the hybrid strategy, tokens; chunks: corpus_id, chunk_id,
    article_number, chunk_index, content, vector. scores: (question_id, corpus_id, chunk_id, rerank_score), or a
    function that makes them of the candidates.

    Routed questions search each of their corpora to its own quota of k (hybrid: of `depth`, beside as many hits by
    words from `blocks`, bm25_blocks() of the chunks, with the same quotas), global ones all corpora together, by vectors alone. Only ids, ranks and scores go through the plan; texts join
    last. What the searches find is stored, so that each goes on once. Questions without a corpus abstain and aren't searched."""
    explicit = "explicit" if "explicit" in questions.columns else None
    decided = questions.withColumn("d", routing_decision("predicted", explicit)).select("*", F.col("d.decision").alias("decision"), F.col("d.corpora").alias("corpora")).drop("d")
    asked = decided.where("decision <> 'abstain'").withColumn("corpora", F.when(F.col("decision") == "routed", F.col("corpora")))
    far = depth if strategy == "hybrid" else k
    deep = stored(vector_topk(asked, chunks, far, corpora="corpora", by_corpus=True))
    routed = asked.where("decision = 'routed'").select("question_id", "corpora")
    everywhere = deep.join(asked.where("decision = 'global'").select("question_id"), "question_id", "left_semi")
    everywhere = everywhere.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("distance", *KEY))).where(F.col("rank") <= far)
    found = quota_topk(deep, routed, far).unionByName(everywhere)
    if strategy == "hybrid":
        lexical = bm25_quota(blocks, asked.where("decision = 'routed'").select("question_id", "tokens", "corpora"), far)
        found = stored(hybrid_union(found, lexical, depth=far, routed=routed).drop("source"))
    if callable(scores):
        scores = scores(found)
    reranked = apply_rerank(found, scores, n).join(asked.select("question_id", F.col("corpora").alias("routed")), "question_id")
    kept = context_filter(reranked, threshold)
    texts = kept.join(chunks.select(*KEY, "article_number", "chunk_index", "content"), list(KEY))
    built = build_context(texts)
    answered = asked.select("question_id", "decision").join(built, "question_id", "left").withColumn("answer", F.lit(None).cast("string"))
    return answered.unionByName(decided.where("decision = 'abstain'").select("question_id", "decision", F.lit(ABSTAINED).alias("answer")), allowMissingColumns=True)
