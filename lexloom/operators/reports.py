"""Evaluation reports: routing, breakdowns, latency, judges, failures, losses, regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import are_neighbors, article_prefix, jaccard, overlap_count
from .metrics import ARTICLE, first_gold_rank

#: A judge score that passes.
PASS = 3
ANSWERABLE = ("single-corpus", "multi-corpus")


def routing_scores(df: DataFrame) -> DataFrame:
    """precision, recall, f1, exact of predicted_corpus_ids against gold_corpus_ids, as sets; two empty sets agree."""
    g, p = F.array_distinct("gold_corpus_ids"), F.array_distinct("predicted_corpus_ids")
    out = df.withColumn("__g", F.size(g)).withColumn("__p", F.size(p)).withColumn("__h", F.size(F.array_intersect(g, p)))
    both_empty, one_empty = (F.col("__g") == 0) & (F.col("__p") == 0), (F.col("__g") == 0) | (F.col("__p") == 0)

    def rule(value: Column) -> Column:
        return F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(value)

    out = out.withColumn("precision", rule(F.col("__h") / F.col("__p"))).withColumn("recall", rule(F.col("__h") / F.col("__g")))
    out = out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    return out.withColumn("exact", (F.col("__h") == F.col("__g")) & (F.col("__h") == F.col("__p"))).drop("__g", "__p", "__h")


def routing_summary(scores: DataFrame) -> DataFrame:
    """One row: means over answerable questions, and how often nothing is predicted for the others."""
    ok = F.col("question_type").isin(*ANSWERABLE)
    means = [F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0)).alias(f"mean_{c}") for c in ("precision", "recall", "f1", "exact")]
    empty = [F.coalesce(F.avg(F.when(F.col("question_type") == t, (F.size("predicted_corpus_ids") == 0).cast("double"))), F.lit(0.0)).alias(n) for t, n in (("ambiguous", "empty_rate_ambiguous"), ("out-of-scope", "empty_rate_out_of_scope"))]
    return scores.agg(F.count("*").alias("questions"), F.count_if(ok).alias("answerable"), *means, *empty)


def breakdown(questions: DataFrame, results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(dimension, value, count, means): by type, difficulty and gold corpus.

    count is questions, means are over those with a result; a question counts in each of its corpora."""
    both = questions.join(results.select("question_id", *metrics), "question_id", "left")
    aggs = [F.count("*").alias("count"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics]]
    parts = [both.groupBy(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")).agg(*aggs) for d, c in (("type", "question_type"), ("difficulty", "difficulty"))]
    parts.append(both.withColumn("value", F.explode(F.array_distinct("gold_corpus_ids"))).groupBy(F.lit("corpus").alias("dimension"), "value").agg(*aggs))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latency_stats(timings: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Mean and nearest-rank p50 and p95 of ms, by stage."""
    return timings.groupBy(*by).agg(F.count("ms").alias("n"), F.avg("ms").alias("mean_ms"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").alias("p50_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"))


def unpivot_timings(wide: DataFrame, stages: Sequence[str], key: str = "question_id") -> DataFrame:
    return wide.unpivot([key], list(stages), "stage", "ms").where("ms IS NOT NULL")


JUDGED = ("correctness", "completeness", "groundedness")


def e2e_summary(results: DataFrame) -> DataFrame:
    """Per variant: means of judge scores, a missing judge as 0, and rerank fallbacks."""
    return results.groupBy("variant").agg(F.count("*").alias("answers"), *[F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(f"mean_{c}") for c in JUDGED], F.count_if(F.col("rerank_status") == "fallback").alias("fallbacks"))


def quality_report(results: DataFrame) -> DataFrame:
    """By expected abstention: averages (2 places), pass rate, histogram of correctness, abstention accuracy, latency."""
    aggs = [F.count("*").alias("answers"), *[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in JUDGED]]
    passed = (F.col("correctness") >= PASS) & (F.col("completeness") >= PASS) & (F.col("groundedness") >= PASS)
    aggs += [F.round(100 * F.avg(passed.cast("double")), 2).alias("pass_rate"), *[F.count_if(F.col("correctness") == i).alias(f"score_{i}") for i in range(5)]]
    aggs += [F.round(100 * F.avg(F.col("abstention_correct").cast("double")), 2).alias("abstention_accuracy"), F.round(F.avg("latency_ms"), 2).alias("mean_latency")]
    return results.groupBy("expected_abstention").agg(*aggs)


def problem_questions(results: DataFrame) -> DataFrame:
    """Questions that fail: answers below the pass score, abstentions judged wrong."""
    low = F.least(*JUDGED) < PASS
    reason = F.when(F.col("expected_abstention") & ~F.coalesce("abstention_correct", F.lit(False)), "abstention").when(~F.col("expected_abstention") & low, "quality")
    return results.select("question_id", reason.alias("reason"), *JUDGED).where("reason IS NOT NULL")


def source_report(results: DataFrame, below: int = 2) -> DataFrame:
    """One row: averages and pass rates of source scores, and the ids of low ones."""
    low = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.least("source_relevance", "source_coverage") < below, F.col("question_id")))), lambda x: x.cast("string")), ",")
    return results.agg(F.count("*").alias("answers"), *[x for c in ("source_relevance", "source_coverage") for x in (F.round(F.avg(c), 2).alias(f"mean_{c}"), F.round(100 * F.avg((F.col(c) >= PASS).cast("double")), 2).alias(f"pass_{c}"))], low.alias("low_ids"))


STAGES = ("abstention", "routing", "retrieval", "reranking", "generation", "none")


def failure_stage(questions: DataFrame, routing: DataFrame, retrieval: DataFrame, reranking: DataFrame, e2e: DataFrame) -> DataFrame:
    """(question_id, failure_stage): the first stage, in this order, that failed. A stage without a result didn't.

    routing: predicted_corpus_ids; retrieval: recall_20; reranking: effect; e2e: expected_abstention,
    abstention_correct and judge scores, which may be null."""
    j = questions.select("question_id", "question_type", "gold_corpus_ids")
    for df, cols in ((routing, ["predicted_corpus_ids"]), (retrieval, ["recall_20"]), (reranking, ["effect"]), (e2e, ["expected_abstention", "abstention_correct", *JUDGED])):
        j = j.join(df.select("question_id", *cols), "question_id", "left")
    open_ = F.col("question_type").isin("ambiguous", "out-of-scope")
    wrong = F.sort_array(F.array_distinct("gold_corpus_ids")) != F.sort_array(F.array_distinct("predicted_corpus_ids"))
    stage = (
        F.when(F.col("expected_abstention") & ~F.col("abstention_correct"), "abstention")
        .when(F.col("predicted_corpus_ids").isNotNull() & F.when(open_, F.size("predicted_corpus_ids") > 0).otherwise(wrong), "routing")
        .when(~open_ & (F.col("recall_20") == 0), "retrieval")
        .when(~open_ & (F.col("effect") == "degraded"), "reranking")
        .when(~F.col("expected_abstention") & (F.least(*JUDGED) < PASS), "generation")
        .otherwise("none")
    )
    return j.select("question_id", stage.alias("failure_stage"))


def failure_counts(stages: DataFrame) -> DataFrame:
    """(failure_stage, n) with stages of none."""
    every = stages.sparkSession.createDataFrame([(s,) for s in STAGES], "failure_stage string")
    counts = stages.groupBy("failure_stage").agg(F.count("*").alias("n"))
    return every.join(counts, "failure_stage", "left").na.fill({"n": 0})


LOSSES = ("R0", "R1", "R2", "R3", "R4")


def _loss(s: Sequence[Column]) -> Column:
    return F.when(s[3] & s[2] & s[1] & s[0], F.lit(None)).when(s[3], "R4").when(~s[0], "R0").when(~s[1], "R1").when(~s[2], "R2").otherwise("R3")


def gold_loss(gold: DataFrame, retrieval: DataFrame, rerank: DataFrame, filtered: DataFrame, final: DataFrame) -> DataFrame:
    """gold with loss: R0 not retrieved, R1 lost at the rerank, R2 at the filter, R3 in the final sources, R4 in
    the final ones but not before them, null if never lost. Stages are lists of their own."""
    keys = ["question_id", *ARTICLE]
    lists = [df.select(*keys, F.lit(i).alias("stage")) for i, df in enumerate((retrieval, rerank, filtered, final))]
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return gold_loss_of(gold, every, *[F.col("stage") == i for i in range(4)])


def gold_loss_of(gold: DataFrame, lists: DataFrame, retrieved: Column, reranked: Column, filtered: Column, final: Column) -> DataFrame:
    """gold_loss() of stages that are parts of one table, each told by a condition on its rows: the table is read and shuffled
    once, to a row for each of its articles that says which stages hold it."""
    keys = ["question_id", *ARTICLE]
    flags = lists.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"s{i}") for i, c in enumerate((retrieved, reranked, filtered, final))])
    out = gold.select(*keys).distinct().join(flags, keys, "left")
    return out.select(*keys, _loss([F.coalesce(f"s{i}", F.lit(False)) for i in range(4)]).alias("loss"))


def primary_loss(losses: DataFrame) -> DataFrame:
    """Per question: its earliest kind of loss and how many gold articles it lost."""
    return losses.where("loss IS NOT NULL").groupBy("question_id").agg(F.min("loss").alias("primary"), F.count("*").alias("lost"))


def loss_totals(losses: DataFrame, questions: DataFrame) -> DataFrame:
    """(loss, question_type, questions, gold) with totals over either (null): a cube."""
    typed = losses.where("loss IS NOT NULL").join(questions.select("question_id", "question_type"), "question_id")
    return typed.cube("loss", "question_type").agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("gold"))


def loss_metrics(losses: DataFrame) -> DataFrame:
    """One row: gold recall after each stage and the share of gold corpora in the end."""
    l = F.col("loss")  # noqa: E741
    per = losses.groupBy("question_id", "corpus_id").agg(F.count("*").alias("gold"), *[F.count_if(l.isNull() | ~l.isin(*LOSSES[: i + 1])).alias(f"k{i}") for i in range(4)])
    return per.agg(F.sum("gold").alias("gold"), *[(F.sum(f"k{i}") / F.sum("gold")).alias(n) for i, n in enumerate(("after_retrieval", "after_rerank", "after_filter", "final"))], F.avg((F.col("k3") > 0).cast("double")).alias("corpora_kept"))


def competitors(missed: DataFrame, retrieval: DataFrame, k: int = 20) -> DataFrame:
    """Per missed gold article: slots of its corpus and of others in the list, the dominant corpus, other articles
    of its corpus, and the pattern: A corpus absent, B corpus present without it, D another corpus has most slots."""
    top = retrieval.where(F.col("rank") <= k).select("question_id", F.col("corpus_id").alias("c"), F.col("article_number").alias("a"), "rank")
    size = top.groupBy("question_id", "c").agg(F.count("*").alias("n"))
    lead = size.groupBy("question_id").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("slots"))
    own = top.groupBy("question_id", F.col("c").alias("corpus_id")).agg(F.count("*").alias("corpus_slots"), F.countDistinct("a").alias("same_corpus_articles"), F.min("rank").alias("best_rank"))
    j = missed.join(lead, "question_id", "left").join(own, ["question_id", "corpus_id"], "left")
    n = F.coalesce("corpus_slots", F.lit(0))
    pattern = F.when(n == 0, "A").when((F.col("m.c") != F.col("corpus_id")) & (F.col("m.n") * 2 > F.col("slots")), "D").otherwise("B")
    return j.select("question_id", *ARTICLE, n.alias("corpus_slots"), F.coalesce("same_corpus_articles", F.lit(0)).alias("same_corpus_articles"), F.col("m.c").alias("dominant_corpus"), F.coalesce("slots", F.lit(0)).alias("slots"), pattern.alias("pattern"))


def gold_chunk_stats(gold: DataFrame, chunks: DataFrame, max_size: int = 2000, short: int = 120) -> DataFrame:
    """Per gold article: chunks, sizes, and signals (multi-chunk, at-max, very-short, split)."""
    wanted = chunks.join(gold.select(*ARTICLE).distinct(), list(ARTICLE), "left_semi")
    shape = wanted.groupBy(*ARTICLE).agg(F.count("*").alias("chunks"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"), F.count("split_level").alias("split"))
    signals = F.array_compact(F.array(F.when(F.col("chunks") > 1, "multi-chunk"), F.when(F.col("max_chars") >= 0.95 * max_size, "at-max"), F.when(F.col("min_chars") < short, "very-short"), F.when(F.col("split") > 0, "split")))
    return gold.join(shape, list(ARTICLE), "left").withColumn("signals", F.when(F.col("chunks").isNull(), F.array(F.lit("no-chunk"))).otherwise(signals))


def loss_cause(losses: DataFrame, shapes: DataFrame) -> DataFrame:
    """(loss, signal, n): how losses meet the signals of their article's chunks."""
    j = losses.where("loss IS NOT NULL").join(shapes.select("question_id", *ARTICLE, "signals"), ["question_id", *ARTICLE], "left")
    return j.select("loss", F.explode_outer(F.when(F.size("signals") > 0, F.col("signals")).otherwise(F.array(F.lit("plain")))).alias("signal")).groupBy("loss", "signal").agg(F.count("*").alias("n"))


def lexical_diagnosis(absent: DataFrame, rankings: DataFrame, question_tokens: DataFrame, article_tokens: DataFrame, bm25: DataFrame, top: int = 5, depth: int = 10) -> DataFrame:
    """Per absent gold article: Jaccard with the question, the best of its competitors, neighbours in the list, the
    BM25 rank, and the cause by priority: lexical_gap, neighbor_confusion, competitor_overlap, recoverable, other."""
    base = absent.select("question_id", *ARTICLE).join(question_tokens, "question_id").join(article_tokens, list(ARTICLE))
    base = base.select("question_id", *ARTICLE, F.col("q_tokens"), jaccard("q_tokens", "a_tokens").alias("gold_jaccard"), overlap_count("q_tokens", "a_tokens").alias("shared"))
    rivals = rankings.where(F.col("rank") <= depth).select("question_id", "rank", F.col("corpus_id").alias("rc"), F.col("article_number").alias("ra"))
    texts = article_tokens.select(F.col("corpus_id").alias("rc"), F.col("article_number").alias("ra"), F.col("a_tokens").alias("r_tokens"))
    met = base.select("question_id", *ARTICLE, "q_tokens").join(rivals, "question_id").join(texts, ["rc", "ra"], "left")
    near = are_neighbors("article_number", "ra", F.col("corpus_id") == F.col("rc"))
    per = met.groupBy("question_id", *ARTICLE).agg(F.max(F.when(F.col("rank") <= top, jaccard("q_tokens", "r_tokens"))).alias("rival_jaccard"), F.count_if(near).alias("neighbors"))
    lexical = bm25.groupBy("question_id", *ARTICLE).agg(F.min("rank").alias("bm25_rank"))
    j = base.drop("q_tokens").join(per, ["question_id", *ARTICLE], "left").join(lexical, ["question_id", *ARTICLE], "left")
    rival, n = F.coalesce("rival_jaccard", F.lit(0.0)), F.coalesce("neighbors", F.lit(0))
    cause = F.when(F.col("shared") == 0, "lexical_gap").when(n > 0, "neighbor_confusion").when(rival > F.col("gold_jaccard"), "competitor_overlap").when(F.col("bm25_rank").isNotNull(), "recoverable").otherwise("other")
    return j.select("question_id", *ARTICLE, F.round("gold_jaccard", 6).alias("gold_jaccard"), F.round(rival, 6).alias("rival_jaccard"), n.alias("neighbors"), "bm25_rank", cause.alias("cause"))


def answer_forensic(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per answer: gold coverage (none, partial, full), corpora that are missing, flags of the text, and category:
    A sources lack gold, B gold there but the answer is vague or refuses, C gold there and answered."""
    want = gold.groupBy("question_id").agg(F.collect_set(F.struct(*ARTICLE)).alias("gold"), F.collect_set("corpus_id").alias("corpora"))
    j = results.join(want, "question_id")
    has = F.size(F.filter("gold", lambda g: F.array_contains("sources", g)))
    seen = F.transform("sources", lambda s: s["corpus_id"])
    refuses = F.lower("answer").rlike("ne (permet|permettent|peux|contient|contiennent) pas|pas d'information|cannot answer")
    hedges = F.lower("answer").rlike("probablement|semble|il est possible|might|perhaps")
    coverage = F.when(has == 0, "none").when(has < F.size("gold"), "partial").otherwise("full")
    category = F.when(has == 0, "A").when(refuses | hedges, "B").otherwise("C")
    return j.select("question_id", coverage.alias("coverage"), F.size(F.array_except("corpora", seen)).alias("missing_corpora"), refuses.alias("refuses"), hedges.alias("hedges"), category.alias("category"))


def compare_runs(a: DataFrame, b: DataFrame, margin: float = 0.5) -> DataFrame:
    """Per question: score difference and whether run b is improved, degraded or equivalent, gold added, same answer.

    Runs: question_id, score, answer, sources (array of structs)."""
    side = lambda df, p: df.select("question_id", *[F.col(c).alias(f"{p}_{c}") for c in ("score", "answer", "sources")])
    j = side(a, "a").join(side(b, "b"), "question_id")
    d = F.col("b_score") - F.col("a_score")
    return j.select("question_id", d.alias("delta"), F.when(d > margin, "improved").when(d < -margin, "degraded").otherwise("equivalent").alias("verdict"), F.size(F.array_except("b_sources", "a_sources")).alias("added"), F.col("a_answer").eqNullSafe(F.col("b_answer")).alias("same_answer"))


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("questions"), F.avg("delta").alias("mean_delta"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("improved", "degraded", "equivalent")], F.sum("added").alias("added"), F.count_if("same_answer").alias("same_answers"))


def regressions(run: DataFrame, baseline: DataFrame, drop: int = 1) -> DataFrame:
    """(question_id, finding, before, after): one row for each rule that a question breaks against the baseline."""
    cols = ("correctness", "groundedness", "coverage", "abstention_correct")
    side = lambda df, p: df.select("question_id", *[F.col(c).cast("double").alias(f"{p}_{c}") for c in cols])
    j = side(baseline, "a").join(side(run, "b"), "question_id")

    def rule(name: str, c: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("finding"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")))

    fell = lambda c, n: F.col(f"a_{c}") - F.col(f"b_{c}") >= n
    rules = [rule("correctness_drop", "correctness", fell("correctness", drop)), rule("groundedness_drop", "groundedness", fell("groundedness", drop)), rule("coverage_drop", "coverage", F.col("b_coverage") < F.col("a_coverage")), rule("abstention_lost", "abstention_correct", (F.col("a_abstention_correct") == 1) & (F.col("b_abstention_correct") == 0))]
    return j.select("question_id", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("question_id", "f.finding", "f.before", "f.after")


def depth_gain(rankings: DataFrame, gold: DataFrame, rerank: DataFrame, final: DataFrame, after: int = 20, upto: int = 30) -> DataFrame:
    """Gold first seen at ranks after+1..upto, and whether it reached the reranked list and the final context."""
    keys = ["question_id", *ARTICLE]
    new = first_gold_rank(rankings, gold).where((F.col("first_rank") > after) & (F.col("first_rank") <= upto))
    for name, df in (("in_rerank", rerank), ("in_final", final)):
        new = new.join(df.select(*keys, F.lit(True).alias(name)).distinct(), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return new


def pending(questions: DataFrame, cache: DataFrame, key: str = "cache_key", complete: Column | None = None) -> DataFrame:
    """Questions whose key has no complete result yet."""
    done = cache if complete is None else cache.where(complete)
    return questions.join(done.select(key), key, "left_anti")


def first_failing(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, null if none."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])


__all__ = [n for n in dir() if not n.startswith("_")] + ["Window", "article_prefix"]
