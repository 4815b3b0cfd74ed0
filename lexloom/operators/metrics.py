"""Retrieval metrics over rankings and gold articles.

rankings: question_id, variant, rank, corpus_id, chunk_id, article_number; gold: question_id, corpus_id,
article_number. Most metrics start from first_gold_rank, computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import filter_audit

ARTICLE = ("corpus_id", "article_number")


def dedupe_articles(rankings: DataFrame) -> DataFrame:
    """Articles in the order of their first chunk, ranked anew."""
    first = rankings.groupBy("question_id", "variant", *ARTICLE).agg(F.min("rank").alias("first"))
    w = Window.partitionBy("question_id", "variant").orderBy("first", *ARTICLE)
    return first.withColumn("rank", F.row_number().over(w)).drop("first")


def first_gold_rank(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, variant, corpus_id, article_number, first_rank): null where a variant lacks the article."""
    variants = rankings.select("variant").distinct()
    every = gold.select("question_id", *ARTICLE).distinct().crossJoin(F.broadcast(variants))  # variants are a handful of names
    ranks = rankings.join(gold.select("question_id", *ARTICLE).distinct(), ["question_id", *ARTICLE], "left_semi").groupBy("question_id", "variant", *ARTICLE).agg(F.min("rank").alias("first_rank"))
    return every.join(ranks, ["question_id", "variant", *ARTICLE], "left")


def recall_any(rankings: DataFrame, questions: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Per question and variant: whether the first k articles hold any gold, and 1 / rank of the first that does.

    Ranks count articles, not chunks. Questions without gold score 0."""
    first = first_gold_rank(dedupe_articles(rankings), gold).groupBy("question_id", "variant").agg(F.min("first_rank").alias("r"))
    every = questions.select("question_id").crossJoin(F.broadcast(rankings.select("variant").distinct()))
    out = every.join(first, ["question_id", "variant"], "left")
    return out.select("question_id", "variant", *[F.coalesce((F.col("r") <= k).cast("int"), F.lit(0)).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("mrr"))


def recall_summary(per_question: DataFrame, base: str | None = None) -> DataFrame:
    """Means over questions by variant and, against a base variant, their differences in points."""
    names = [c for c in per_question.columns if c not in ("question_id", "variant")]
    means = per_question.groupBy("variant").agg(F.count("*").alias("questions"), *[F.avg(c).alias(c) for c in names])
    if base is None:
        return means
    was = means.where(F.col("variant") == base).select(*[F.col(c).alias(f"base_{c}") for c in names])
    return means.crossJoin(F.broadcast(was)).select("variant", "questions", *names, *[(100 * (F.col(c) - F.col(f"base_{c}"))).alias(f"delta_{c}") for c in names])


def retrieval_snapshot(rankings: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per question and variant: the share of gold within the first k, and 1 / rank of the first gold."""
    first = first_gold_rank(rankings, gold)
    return first.groupBy("question_id", "variant").agg(*[F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.min("first_rank"), F.lit(0.0)).alias("mrr"))


def mean_snapshot(snapshots: DataFrame) -> DataFrame:
    """Macro means over questions."""
    names = [c for c in snapshots.columns if c not in ("question_id", "variant")]
    return snapshots.groupBy("variant").agg(F.count("*").alias("questions"), *[F.avg(c).alias(f"macro_{c}") for c in names])


def _within(k: int | Column) -> Column:
    return F.coalesce(F.col("first_rank") <= k, F.lit(False))


def coverage_at(rankings: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per question and variant: whether all gold, and which share of gold corpora, is within the first k."""
    first = first_gold_rank(rankings, gold)
    return first.groupBy("question_id", "variant").agg(F.bool_and(_within(k)).alias("full_coverage"), (F.countDistinct(F.when(_within(k), F.col("corpus_id"))) / F.countDistinct("corpus_id")).alias("corpus_coverage"))


def depth_curve(first_ranks: DataFrame, ks: Sequence[int] = (10, 20, 30, 40, 50)) -> DataFrame:
    """Per variant and k: micro recall, shares of questions with all gold and all gold corpora, gold still absent."""
    depths = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    at = first_ranks.select("*", depths)
    q = at.groupBy("variant", "k", "question_id").agg(F.count("*").alias("gold"), F.count_if(_within(F.col("k"))).alias("hits"), F.countDistinct("corpus_id").alias("corpora"), F.countDistinct(F.when(_within(F.col("k")), F.col("corpus_id"))).alias("hit_corpora"))
    return q.groupBy("variant", "k").agg((F.sum("hits") / F.sum("gold")).alias("micro_recall"), F.avg((F.col("hits") == F.col("gold")).cast("double")).alias("full_coverage"), F.avg((F.col("hit_corpora") == F.col("corpora")).cast("double")).alias("corpus_coverage"), (F.sum("gold") - F.sum("hits")).alias("absent"))


def marginal_gains(curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("variant").orderBy("k")
    return curve.select("variant", "k", F.lag("k").over(w).alias("from_k"), (F.col("micro_recall") - F.lag("micro_recall").over(w)).alias("gain"), (F.lag("absent").over(w) - F.col("absent")).alias("recovered")).where("from_k IS NOT NULL")


def bands(ks: Sequence[int] = (10, 20, 30, 40, 50)) -> list[str]:
    return [f"{a + 1:02d}-{b:02d}" for a, b in zip((0, *ks), ks, strict=False)] + ["absent"]


def gold_depth(first_ranks: DataFrame, ks: Sequence[int] = (10, 20, 30, 40, 50)) -> DataFrame:
    """first_ranks with the band of ranks that each gold is first seen in."""
    names = bands(ks)
    out = F.when(F.col("first_rank").isNull() | (F.col("first_rank") > ks[-1]), names[-1])
    for name, k in zip(names, ks, strict=False):
        out = out.when(F.col("first_rank") <= k, name)
    return first_ranks.withColumn("band", out)


def depth_summary(depths: DataFrame, ks: Sequence[int] = (10, 20, 30, 40, 50)) -> DataFrame:
    """(variant, band, gold, share) with bands of none."""
    counts = depths.groupBy("variant", "band").agg(F.count("*").alias("gold"))
    every = depths.groupBy("variant").agg(F.count("*").alias("of")).select("variant", "of", F.explode(F.array(*[F.lit(b) for b in bands(ks)])).alias("band"))
    return every.join(counts, ["variant", "band"], "left").select("variant", "band", F.coalesce("gold", F.lit(0)).alias("gold"), (F.coalesce("gold", F.lit(0)) / F.col("of")).alias("share"))


def gold_contribution(vector: DataFrame, bm25: DataFrame, gold: DataFrame, depth: int = 50) -> DataFrame:
    """(question_id, corpus_id, article_number, found_by): vector, bm25, both or none."""
    keys = ["question_id", *ARTICLE]
    has = lambda r, n: r.where(F.col("rank") <= depth).select(*keys, F.lit(True).alias(n)).distinct()
    both = gold.select(*keys).distinct().join(has(vector, "v"), keys, "left").join(has(bm25, "b"), keys, "left")
    v, b = F.col("v").isNotNull(), F.col("b").isNotNull()
    return both.select(*keys, F.when(v & b, "both").when(v, "vector").when(b, "bm25").otherwise("none").alias("found_by"))


def variant_summary(first_ranks: DataFrame, k: int = 50) -> DataFrame:
    """Per variant at depth k: micro recall, questions with all gold, and of those with several gold corpora the ones with all."""
    q = first_ranks.groupBy("variant", "question_id").agg(F.count("*").alias("gold"), F.count_if(_within(k)).alias("hits"), F.countDistinct("corpus_id").alias("corpora"), F.countDistinct(F.when(_within(k), F.col("corpus_id"))).alias("hit_corpora"))
    several = F.col("corpora") > 1
    return q.groupBy("variant").agg(F.count("*").alias("questions"), F.sum("gold").alias("gold"), (F.sum("hits") / F.sum("gold")).alias("micro_recall"), F.avg((F.col("hits") == F.col("gold")).cast("double")).alias("full_coverage"), F.avg(F.when(several, (F.col("hit_corpora") == F.col("corpora")).cast("double"))).alias("multi_corpus_coverage"))


def candidate_counts(rankings: DataFrame) -> DataFrame:
    """Per variant: mean, least, greatest and midpoint median of candidates a question."""
    n = rankings.groupBy("variant", "question_id").agg(F.count("*").alias("n"))
    return n.groupBy("variant").agg(F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.percentile("n", 0.5).alias("median"))


def stage_funnel(stages: DataFrame, gold: DataFrame) -> DataFrame:
    """Per variant and stage: gold recall, full and corpus coverage. stages: rankings with a stage column."""
    named = stages.withColumn("variant", F.to_json(F.struct("variant", "stage")))
    q = first_gold_rank(named, gold).groupBy("variant", "question_id").agg(F.count("*").alias("gold"), F.count("first_rank").alias("hits"), F.countDistinct("corpus_id").alias("corpora"), F.countDistinct(F.when(F.col("first_rank").isNotNull(), F.col("corpus_id"))).alias("hit_corpora"))
    out = q.groupBy("variant").agg((F.sum("hits") / F.sum("gold")).alias("micro_recall"), F.avg((F.col("hits") == F.col("gold")).cast("double")).alias("full_coverage"), F.avg((F.col("hit_corpora") == F.col("corpora")).cast("double")).alias("corpus_coverage"))
    return out.select(F.get_json_object("variant", "$.variant").alias("variant"), F.get_json_object("variant", "$.stage").alias("stage"), "micro_recall", "full_coverage", "corpus_coverage")


def rerank_effect(before: DataFrame, after: DataFrame, recall: str = "recall_5") -> DataFrame:
    """Per question: improved if recall or MRR rose, else degraded if one fell, else unchanged."""
    a, b = (s.select("question_id", F.col(recall).alias(f"r{n}"), F.col("mrr").alias(f"m{n}")) for s, n in ((before, 0), (after, 1)))
    effect = F.when((F.col("r1") > F.col("r0")) | (F.col("m1") > F.col("m0")), "improved").when((F.col("r1") < F.col("r0")) | (F.col("m1") < F.col("m0")), "degraded").otherwise("unchanged")
    return a.join(b, "question_id").select("question_id", effect.alias("effect"))


def strategy_balance(rankings: DataFrame, routed: DataFrame, gold: DataFrame) -> DataFrame:
    """Per variant: corpora that a question's list holds, lists of one corpus, quantiles of gold ranks."""
    size = rankings.groupBy("variant", "question_id", "corpus_id").agg(F.count("*").alias("n"))
    q = size.groupBy("variant", "question_id").agg(F.count("*").alias("corpora"), (F.max("n") / F.sum("n")).alias("top_share"))
    q = q.join(routed.select("question_id", F.size("corpora").alias("asked")), "question_id").where("asked > 1")
    lists = q.groupBy("variant").agg(F.count("*").alias("questions"), F.avg("corpora").alias("mean_corpora"), F.avg((F.col("corpora") == 1).cast("double")).alias("monopoly_rate"), F.avg((F.col("corpora") >= F.col("asked")).cast("double")).alias("all_corpora_rate"))
    ranks = first_gold_rank(rankings, gold).where("first_rank IS NOT NULL").groupBy("variant").agg(F.min("first_rank").alias("min_gold_rank"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY first_rank)").alias("median_gold_rank"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY first_rank)").alias("p90_gold_rank"))
    return lists.join(ranks, "variant", "left")


def threshold_grid(reranked: DataFrame, gold: DataFrame, thresholds: Sequence[float] = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), cap: int = 5) -> DataFrame:
    """Per threshold and strategy (standard, min-one): chunks kept, gold articles kept, corpora kept.

    reranked: as for filter_audit, with article_number."""
    grid = reranked.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    keys = ["question_id", *ARTICLE]
    wanted = gold.select(*keys).distinct().withColumn("is_gold", F.lit(True))
    out = None
    for name, one in (("standard", False), ("min-one", True)):
        kept = filter_audit(grid, min_one=one, cap=cap, by=("threshold", "question_id"), threshold_column="threshold").where("kept")
        kept = kept.join(wanted, keys, "left").withColumn("strategy", F.lit(name))
        out = kept if out is None else out.unionByName(kept)
    return out.groupBy("strategy", "threshold").agg(F.count("*").alias("chunks"), F.countDistinct("question_id").alias("questions"), F.countDistinct(F.when(F.col("is_gold"), F.struct(*keys))).alias("gold_kept"), F.countDistinct(F.struct("question_id", "corpus_id")).alias("corpora_kept"))


def corpus_loss_class(stages: DataFrame, gold: DataFrame) -> DataFrame:
    """For questions of two gold corpora: A both kept to the end, B one lost at the rerank, C at the filter, D before.

    stages: question_id, stage (retrieval, rerank, filter), corpus_id."""
    two = gold.groupBy("question_id").agg(F.collect_set("corpus_id").alias("wanted")).where(F.size("wanted") == 2)
    has = stages.join(gold.select("question_id", "corpus_id").distinct(), ["question_id", "corpus_id"], "left_semi").groupBy("question_id").agg(*[F.countDistinct(F.when(F.col("stage") == s, F.col("corpus_id"))).alias(s) for s in ("retrieval", "rerank", "filter")])
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return two.join(has, "question_id", "left").select("question_id", F.when(n("filter") == 2, "A").when(n("retrieval") < 2, "D").when(n("rerank") < 2, "B").otherwise("C").alias("loss_class"))


def score_gaps(reranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question: the largest gap of neighbouring scores (the first if equal) and its place, last gold rank, and the scores' relation to the best."""
    w = Window.partitionBy("question_id").orderBy("rank")
    rows = reranked.withColumn("gap", F.lag("rerank_score").over(w) - F.col("rerank_score")).withColumn("best", F.first("rerank_score").over(w))
    rows = rows.join(gold.select("question_id", *ARTICLE).distinct().withColumn("is_gold", F.lit(True)), ["question_id", *ARTICLE], "left")
    top = F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("rank")).alias("r"))))
    return rows.groupBy("question_id").agg(F.round(top["gap"], 9).alias("largest_gap"), (-top["r"] - 1).alias("gap_after_rank"), F.round(F.avg("gap"), 9).alias("mean_gap"), F.round(F.min(F.when(F.col("best") > 0, F.col("rerank_score") / F.col("best"))), 9).alias("lowest_relative"), F.max(F.when(F.col("is_gold"), F.col("rank"))).alias("last_gold_rank"))


def threshold_sensitivity(reranked: DataFrame, gold: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per relative threshold: documents kept a question, gold kept and lost, questions that lose gold."""
    w = Window.partitionBy("question_id").orderBy("rank")
    rows = reranked.withColumn("best", F.first("rerank_score").over(w)).withColumn("relative", F.col("rerank_score") / F.col("best"))
    rows = rows.join(gold.select("question_id", *ARTICLE).distinct().withColumn("is_gold", F.lit(True)), ["question_id", *ARTICLE], "left")
    grid = rows.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    keep = F.col("relative") >= F.col("threshold")
    q = grid.groupBy("threshold", "question_id").agg(F.count_if(keep).alias("docs"), F.count_if(keep & F.col("is_gold")).alias("kept"), F.count_if(~keep & F.col("is_gold")).alias("lost"))
    return q.groupBy("threshold").agg(F.avg("docs").alias("mean_docs"), F.min("docs").alias("min_docs"), F.max("docs").alias("max_docs"), F.sum("kept").alias("gold_kept"), F.sum("lost").alias("gold_lost"), F.count_if(F.col("lost") > 0).alias("questions_losing"))


def safe_thresholds(sensitivity: DataFrame) -> DataFrame:
    """One row: lowest and highest threshold that loses no gold, and the next one that does."""
    safe = F.col("gold_lost") == 0
    return sensitivity.agg(F.min(F.when(safe, F.col("threshold"))).alias("lowest_safe"), F.max(F.when(safe, F.col("threshold"))).alias("highest_safe"), F.min(F.when(~safe, F.col("threshold"))).alias("next_failing"))


def variant_report(runs: DataFrame) -> DataFrame:
    """Per variant: means of judge scores, size of the context and its p95, answers that pass."""
    return runs.groupBy("variant").agg(F.count("*").alias("answers"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("correctness", "completeness", "groundedness")], F.round(F.avg("context_chars"), 6).alias("mean_context_chars"), F.percentile("context_chars", 0.95).alias("p95_context_chars"), F.count_if((F.col("correctness") >= 3) & (F.col("groundedness") >= 3)).alias("passing"))
