"""Queries over report and curation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bm25, curate, metrics, reports, retrieval
from .bindings import prefix, spread, sql, table, view
from .corpus_queries import NORMALIZED

_KEYS = ["question_id", "corpus_id", "article_number"]


def _routing(spark, d):
    q = view(spark, d, "questions")
    gold = view(spark, d, "gold").groupBy("question_id").agg(F.sort_array(F.collect_set("corpus_id")).alias("gold_corpus_ids"))
    none = F.array().cast("array<string>")
    said = F.when(F.col("o_custkey") % 6 == 0, none).otherwise(F.array(F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")), F.concat(F.lit("c"), ((F.col("o_custkey") + F.col("question_id") % 2) % 3).cast("string"))))
    return q.join(gold, "question_id", "left").withColumn("gold_corpus_ids", F.coalesce("gold_corpus_ids", none)).withColumn("predicted_corpus_ids", said)


_ROUTING = prefix("gold", "questions") + """, gc AS (SELECT question_id, list_sort(list(DISTINCT corpus_id)) AS g FROM gold GROUP BY question_id),
 ro AS (SELECT q.*, coalesce(g, []) AS g, list_sort(list_distinct(CASE WHEN o_custkey % 6 = 0 THEN [] ELSE [concat('c', o_custkey % 3), concat('c', (o_custkey + q.question_id % 2) % 3)] END)) AS p FROM questions q LEFT JOIN gc ON gc.question_id = q.question_id),
 rs AS (SELECT *, CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN len(g) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(g, p)) * 1.0 / len(p) END AS pr, CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN len(g) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(g, p)) * 1.0 / len(g) END AS re, g = p AS exact FROM ro),
 sc AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM rs)"""


def i1(spark, d):
    s = reports.routing_scores(_routing(spark, d))
    return s.select("question_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "exact")


I1 = _ROUTING + " SELECT question_id, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, exact FROM sc"


def i2(spark, d):
    s = reports.routing_summary(reports.routing_scores(_routing(spark, d)))
    return s.select("questions", "answerable", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


I2 = _ROUTING + """, k AS (SELECT *, question_type IN ('single-corpus', 'multi-corpus') AS ok FROM sc) SELECT count(*) AS questions, count(*) FILTER (ok) AS answerable, round(avg(CASE WHEN ok THEN pr END), 6) AS mean_precision, round(avg(CASE WHEN ok THEN re END), 6) AS mean_recall, round(avg(CASE WHEN ok THEN f1 END), 6) AS mean_f1, round(avg(CASE WHEN ok THEN CASE WHEN exact THEN 1.0 ELSE 0 END END), 6) AS mean_exact,
 round(avg(CASE WHEN question_type = 'ambiguous' THEN CASE WHEN len(p) = 0 THEN 1.0 ELSE 0 END END), 6) AS empty_rate_ambiguous, round(avg(CASE WHEN question_type = 'out-of-scope' THEN CASE WHEN len(p) = 0 THEN 1.0 ELSE 0 END END), 6) AS empty_rate_out_of_scope FROM k"""


def i3(spark, d):
    r = reports.routing_scores(_routing(spark, d))
    b = reports.breakdown(r.drop("precision", "recall"), r.where("question_id % 7 <> 0"), ["precision", "recall"])
    return b.select("dimension", "value", "count", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


I3 = _ROUTING + """, x AS (SELECT question_id, question_type, difficulty, g, CASE WHEN question_id % 7 <> 0 THEN pr END AS a, CASE WHEN question_id % 7 <> 0 THEN re END AS b FROM sc)
 SELECT dimension, value, count(*) AS count, round(avg(a), 6) AS precision, round(avg(b), 6) AS recall FROM (SELECT 'type' AS dimension, question_type AS value, a, b FROM x UNION ALL SELECT 'difficulty', difficulty, a, b FROM x UNION ALL SELECT 'corpus', unnest(g), a, b FROM x) GROUP BY ALL"""


def i4(spark, d):
    wide = table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("value").alias("retrieval"), (F.col("value") * 2).alias("rerank"), F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).alias("generation"))
    s = reports.latency_stats(reports.unpivot_timings(wide, ["retrieval", "rerank", "generation"]))
    return s.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")])


I4 = """WITH t AS (SELECT 'retrieval' AS stage, value AS ms FROM events UNION ALL SELECT 'rerank', value * 2 FROM events UNION ALL SELECT 'generation', value + 1 FROM events WHERE event_id % 3 = 0)
 SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean_ms, round(quantile_disc(ms, 0.5), 6) AS p50_ms, round(quantile_disc(ms, 0.95), 6) AS p95_ms FROM t GROUP BY stage"""


def i5(spark, d):
    a = view(spark, d, "answers").withColumn("correctness", F.when(F.col("question_id") % 10 != 0, F.col("correctness"))).withColumn("rerank_status", F.when(F.col("user_id") % 4 == 0, "fallback").otherwise("reranked"))
    s = reports.e2e_summary(a)
    return s.select("variant", "answers", *[F.round(c, 6).alias(c) for c in s.columns[2:5]], "fallbacks")


I5 = sql("SELECT variant, count(*) AS answers, round(avg(CASE WHEN question_id % 10 <> 0 THEN correctness ELSE 0 END), 6) AS mean_correctness, round(avg(completeness), 6) AS mean_completeness, round(avg(groundedness), 6) AS mean_groundedness, count(*) FILTER (user_id % 4 = 0) AS fallbacks FROM answers GROUP BY variant", "answers")


def i6(spark, d):
    return reports.quality_report(view(spark, d, "answers"))


I6 = sql("""SELECT expected_abstention, count(*) AS answers, round(avg(correctness), 2) AS mean_correctness, round(avg(completeness), 2) AS mean_completeness, round(avg(groundedness), 2) AS mean_groundedness, round(100 * avg(CASE WHEN correctness >= 3 AND completeness >= 3 AND groundedness >= 3 THEN 1.0 ELSE 0 END), 2) AS pass_rate,
 count(*) FILTER (correctness = 0) AS score_0, count(*) FILTER (correctness = 1) AS score_1, count(*) FILTER (correctness = 2) AS score_2, count(*) FILTER (correctness = 3) AS score_3, count(*) FILTER (correctness = 4) AS score_4, round(100 * avg(CASE WHEN abstention_correct THEN 1.0 ELSE 0 END), 2) AS abstention_accuracy, round(avg(latency_ms), 2) AS mean_latency FROM answers GROUP BY expected_abstention""", "answers")


def i6b(spark, d):
    return reports.problem_questions(view(spark, d, "answers"))


I6B = sql("SELECT * FROM (SELECT question_id, CASE WHEN expected_abstention AND NOT abstention_correct THEN 'abstention' WHEN NOT expected_abstention AND least(correctness, completeness, groundedness) < 3 THEN 'quality' END AS reason, correctness, completeness, groundedness FROM answers) WHERE reason IS NOT NULL", "answers")


def i7(spark, d):
    return reports.source_report(view(spark, d, "answers").select("question_id", F.col("completeness").alias("source_relevance"), F.col("groundedness").alias("source_coverage")), below=1)


I7 = sql("SELECT count(*) AS answers, round(avg(completeness), 2) AS mean_source_relevance, round(100 * avg(CASE WHEN completeness >= 3 THEN 1.0 ELSE 0 END), 2) AS pass_source_relevance, round(avg(groundedness), 2) AS mean_source_coverage, round(100 * avg(CASE WHEN groundedness >= 3 THEN 1.0 ELSE 0 END), 2) AS pass_source_coverage, string_agg(CASE WHEN least(completeness, groundedness) < 1 THEN question_id END, ',' ORDER BY question_id) AS low_ids FROM answers", "answers")


def _stage_results(spark, d):
    r = _routing(spark, d)
    snap = metrics.retrieval_snapshot(view(spark, d, "rankings").where("variant = 'vector'"), view(spark, d, "gold"), (20,))
    both = metrics.retrieval_snapshot(view(spark, d, "rankings"), view(spark, d, "gold"), (3,))
    effect = metrics.rerank_effect(*[both.where(F.col("variant") == v) for v in ("vector", "bm25")], recall="recall_3")
    e2e = view(spark, d, "answers").where("question_id % 3 <> 1")
    return r, r.where("question_id % 2 = 0"), snap, effect, e2e


def i8(spark, d):
    return reports.failure_counts(reports.failure_stage(*_stage_results(spark, d)))


I8 = _ROUTING + prefix("rankings", "answers").replace("WITH ", ", ", 1) + """, v AS (SELECT DISTINCT variant FROM rankings),
 fr AS (SELECT gg.question_id, v.variant, gg.corpus_id, gg.article_number, min(r.rank) AS fr FROM gold gg CROSS JOIN v LEFT JOIN rankings r ON r.question_id = gg.question_id AND r.variant = v.variant AND r.corpus_id = gg.corpus_id AND r.article_number = gg.article_number GROUP BY ALL),
 s AS (SELECT question_id, variant, avg(CASE WHEN fr <= 20 THEN 1.0 ELSE 0 END) AS r20, avg(CASE WHEN fr <= 3 THEN 1.0 ELSE 0 END) AS r3, coalesce(1.0 / min(fr), 0) AS m FROM fr GROUP BY ALL),
 j AS (SELECT sc.question_id, question_type IN ('ambiguous', 'out-of-scope') AS op, CASE WHEN sc.question_id % 2 = 0 THEN CASE WHEN question_type IN ('ambiguous', 'out-of-scope') THEN len(p) > 0 ELSE g <> p END ELSE false END AS bad_routing, a.r20 = 0 AS bad_retrieval, NOT (b.r3 > a.r3 OR b.m > a.m) AND (b.r3 < a.r3 OR b.m < a.m) AS worse, expected_abstention AS ea, abstention_correct AS ac, least(correctness, completeness, groundedness) AS low
   FROM sc LEFT JOIN s a ON a.question_id = sc.question_id AND a.variant = 'vector' LEFT JOIN s b ON b.question_id = sc.question_id AND b.variant = 'bm25' LEFT JOIN answers e ON e.question_id = sc.question_id AND e.question_id % 3 <> 1),
 k AS (SELECT CASE WHEN ea AND NOT ac THEN 'abstention' WHEN bad_routing THEN 'routing' WHEN NOT op AND bad_retrieval THEN 'retrieval' WHEN NOT op AND worse THEN 'reranking' WHEN NOT ea AND low < 3 THEN 'generation' ELSE 'none' END AS failure_stage FROM j)
 SELECT x.failure_stage, count(k.failure_stage) AS n FROM (SELECT unnest(['abstention', 'routing', 'retrieval', 'reranking', 'generation', 'none']) AS failure_stage) x LEFT JOIN k USING (failure_stage) GROUP BY ALL"""


def _losses(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector'")
    final = F.expr("rank <= 2 AND question_id % 4 <> 0 OR rank = 5 AND question_id % 6 = 1")
    return reports.gold_loss_of(view(spark, d, "gold"), r, F.lit(True), F.col("rank") <= 4, F.col("rank") <= 2, final)


_LOSS = prefix("rankings", "gold", "questions") + """, f AS (SELECT g.question_id, g.corpus_id, g.article_number, coalesce(bool_or(true) FILTER (r.rank IS NOT NULL), false) AS a, coalesce(bool_or(r.rank <= 4), false) AS b, coalesce(bool_or(r.rank <= 2), false) AS c, coalesce(bool_or((r.rank <= 2 AND g.question_id % 4 <> 0) OR (r.rank = 5 AND g.question_id % 6 = 1)), false) AS e
 FROM gold g LEFT JOIN (SELECT * FROM rankings WHERE variant = 'vector') r ON r.question_id = g.question_id AND r.corpus_id = g.corpus_id AND r.article_number = g.article_number GROUP BY ALL),
 lo AS (SELECT question_id, corpus_id, article_number, CASE WHEN e AND c AND b AND a THEN NULL WHEN e THEN 'R4' WHEN NOT a THEN 'R0' WHEN NOT b THEN 'R1' WHEN NOT c THEN 'R2' ELSE 'R3' END AS loss FROM f)"""


def i9(spark, d):
    return reports.loss_totals(_losses(spark, d), view(spark, d, "questions"))


I9 = _LOSS + " SELECT loss, question_type, count(DISTINCT question_id) AS questions, count(*) AS gold FROM lo JOIN questions USING (question_id) WHERE loss IS NOT NULL GROUP BY CUBE (loss, question_type)"


def i9b(spark, d):
    return reports.primary_loss(_losses(spark, d))


I9B = _LOSS + " SELECT question_id, min(loss) AS \"primary\", count(*) AS lost FROM lo WHERE loss IS NOT NULL GROUP BY question_id"


def i10(spark, d):
    m = reports.loss_metrics(_losses(spark, d))
    return m.select("gold", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


I10 = _LOSS + """, p AS (SELECT question_id, corpus_id, count(*) AS gold, count(*) FILTER (loss IS NULL OR loss NOT IN ('R0')) AS k0, count(*) FILTER (loss IS NULL OR loss NOT IN ('R0', 'R1')) AS k1, count(*) FILTER (loss IS NULL OR loss NOT IN ('R0', 'R1', 'R2')) AS k2, count(*) FILTER (loss IS NULL OR loss NOT IN ('R0', 'R1', 'R2', 'R3')) AS k3 FROM lo GROUP BY ALL)
 SELECT sum(gold) AS gold, round(sum(k0) / sum(gold), 6) AS after_retrieval, round(sum(k1) / sum(gold), 6) AS after_rerank, round(sum(k2) / sum(gold), 6) AS after_filter, round(sum(k3) / sum(gold), 6) AS final, round(avg(CASE WHEN k3 > 0 THEN 1.0 ELSE 0 END), 6) AS corpora_kept FROM p"""


def i11(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector'")
    missed = metrics.first_gold_rank(r, view(spark, d, "gold")).where("first_rank IS NULL").select(*_KEYS)
    return reports.competitors(missed, r)


I11 = prefix("rankings", "gold") + """, r AS (SELECT * FROM rankings WHERE variant = 'vector' AND rank <= 20), miss AS (SELECT g.* FROM gold g ANTI JOIN rankings x ON x.variant = 'vector' AND x.question_id = g.question_id AND x.corpus_id = g.corpus_id AND x.article_number = g.article_number),
 sz AS (SELECT question_id, corpus_id, count(*) AS n FROM r GROUP BY ALL), ld AS (SELECT question_id, arg_max(corpus_id, n * 10 + CAST(substr(corpus_id, 2) AS INT)) AS c, max(n) AS n, sum(n) AS slots FROM sz GROUP BY ALL),
 ow AS (SELECT question_id, corpus_id, count(*) AS cs, count(DISTINCT article_number) AS ca FROM r GROUP BY ALL)
 SELECT m.question_id, m.corpus_id, m.article_number, coalesce(cs, 0) AS corpus_slots, coalesce(ca, 0) AS same_corpus_articles, ld.c AS dominant_corpus, coalesce(slots, 0) AS slots, CASE WHEN coalesce(cs, 0) = 0 THEN 'A' WHEN ld.c <> m.corpus_id AND ld.n * 2 > slots THEN 'D' ELSE 'B' END AS pattern
 FROM miss m LEFT JOIN ld USING (question_id) LEFT JOIN ow ON ow.question_id = m.question_id AND ow.corpus_id = m.corpus_id"""


def _shapes(spark, d):
    c = view(spark, d, "ranked").select("corpus_id", "article_number", (F.col("l_quantity") * 40).cast("int").alias("char_count"), F.when(F.col("l_partkey") % 50 == 0, "hard").alias("split_level"))
    return reports.gold_chunk_stats(view(spark, d, "gold"), c.where("char_count % 3 = 0"))


def i12(spark, d):
    return reports.loss_cause(_losses(spark, d), _shapes(spark, d))


I12 = _LOSS + """, ch AS (SELECT corpus_id, article_number, CAST(l_quantity * 40 AS INT) AS n, CASE WHEN l_partkey % 50 = 0 THEN 1 END AS s FROM ranked WHERE CAST(l_quantity * 40 AS INT) % 3 = 0),
 sh AS (SELECT corpus_id, article_number, [x FOR x IN [CASE WHEN count(*) > 1 THEN 'multi-chunk' END, CASE WHEN max(n) >= 1900 THEN 'at-max' END, CASE WHEN min(n) < 120 THEN 'very-short' END, CASE WHEN count(s) > 0 THEN 'split' END] IF x IS NOT NULL] AS sg FROM ch GROUP BY ALL),
 z AS (SELECT loss, CASE WHEN sh.corpus_id IS NULL THEN ['no-chunk'] WHEN len(sg) = 0 THEN ['plain'] ELSE sg END AS sg FROM lo LEFT JOIN sh USING (corpus_id, article_number) WHERE loss IS NOT NULL)
 SELECT loss, signal, count(*) AS n FROM (SELECT loss, unnest(sg) AS signal FROM z) GROUP BY ALL"""


def _holders(items, blocks, articles):
    """(question_id, corpus_id, chunk_id): articles whose text holds an item's text, met through the item's rarest inner term."""
    n = F.size("tokens")
    inner = F.when(n > 2, F.slice("tokens", F.lit(2), n - 2)).otherwise(F.col("tokens"))  # marks beside the passage may change its first and last term
    total = bm25.bm25_sizes(blocks)[1].groupBy("term").agg(F.sum("df").alias("df"))
    rarest = items.select("question_id", F.explode(inner).alias("term")).join(total, "term").groupBy("question_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    met = rarest.join(bm25.bm25_postings(blocks), "term").join(items.select("question_id", "text"), "question_id").join(articles.select(*retrieval.KEY, "content"), list(retrieval.KEY))
    return met.where(F.contains("content", "text")).select("question_id", *retrieval.KEY).distinct()


def i13(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", "lang", F.col("text").alias("content"), text.lexical_tokens("text").alias("tokens"))
    articles = docs.select(F.col("lang").alias("corpus_id"), F.concat(F.lit("L"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("doc_id") % 3).cast("string")).alias("chunk_id"), "content", "tokens")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text", text.lexical_tokens("text").alias("tokens"))
    blocks = bm25.bm25_blocks(articles, bm25.question_terms(items))
    ranks = retrieval.bm25_topk(blocks, items.select("question_id", "tokens"), 50).withColumnRenamed("chunk_id", "article_number")
    top = ranks.where("rank <= 10")
    gold = _holders(items, blocks, articles).withColumnRenamed("chunk_id", "article_number")
    absent = gold.join(top, _KEYS, "left_anti")
    return reports.lexical_diagnosis(absent, top, items.select("question_id", F.col("tokens").alias("q_tokens")), articles.select("corpus_id", F.col("chunk_id").alias("article_number"), F.col("tokens").alias("a_tokens")), ranks)


def i14(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector' AND rank <= 2")
    sources = r.groupBy("question_id").agg(F.collect_set(F.struct("corpus_id", "article_number")).alias("sources"))
    said = sources.withColumn("answer", F.when(F.col("question_id") % 5 == 0, "Le texte ne permet pas de répondre.").when(F.col("question_id") % 5 == 1, "Il est possible que oui.").otherwise("Oui."))
    return reports.answer_forensic(said, view(spark, d, "gold"))


I14 = prefix("rankings", "gold") + """, s AS (SELECT question_id, list(DISTINCT concat(corpus_id, '/', article_number)) AS so, list(DISTINCT corpus_id) AS sc FROM rankings WHERE variant = 'vector' AND rank <= 2 GROUP BY ALL), w AS (SELECT question_id, list(DISTINCT concat(corpus_id, '/', article_number)) AS g, list(DISTINCT corpus_id) AS co FROM gold GROUP BY ALL),
 j AS (SELECT question_id, len(list_intersect(g, so)) AS h, len(g) AS n, len([x FOR x IN co IF NOT list_contains(sc, x)]) AS missing_corpora, question_id % 5 = 0 AS refuses, question_id % 5 = 1 AS hedges FROM s JOIN w USING (question_id))
 SELECT question_id, CASE WHEN h = 0 THEN 'none' WHEN h < n THEN 'partial' ELSE 'full' END AS coverage, missing_corpora, refuses, hedges, CASE WHEN h = 0 THEN 'A' WHEN refuses OR hedges THEN 'B' ELSE 'C' END AS category FROM j"""


def _runs(spark, d):
    e = table(spark, d, "events")
    run = lambda shift: e.select(F.col("event_id").alias("question_id"), ((F.col("event_id") * 7 + F.col("user_id") * shift) % 5).cast("double").alias("score"), F.when(F.col("event_id") % 3 == 0, "same").otherwise(F.concat(F.lit("run "), F.lit(str(shift)))).alias("answer"), F.array((F.col("user_id") % 4).cast("string"), (F.col("user_id") % 4 + F.lit(shift)).cast("string")).alias("sources"))
    return run(1), run(2)


def i15(spark, d):
    return reports.compare_summary(reports.compare_runs(*_runs(spark, d))).withColumn("mean_delta", F.round("mean_delta", 6))


I15 = """WITH r AS (SELECT (event_id * 7 + user_id * 2) % 5 - (event_id * 7 + user_id) % 5 AS x, event_id % 3 = 0 AS same FROM events)
 SELECT count(*) AS questions, round(avg(x), 6) AS mean_delta, count(*) FILTER (x > 0.5) AS improved, count(*) FILTER (x < -0.5) AS degraded, count(*) FILTER (x BETWEEN -0.5 AND 0.5) AS equivalent, count(*) AS added, count(*) FILTER (same) AS same_answers FROM r"""


def i16(spark, d):
    e = table(spark, d, "events")
    run = lambda s: e.select(F.col("event_id").alias("question_id"), ((F.col("event_id") + F.col("user_id") * s) % 5).alias("correctness"), ((F.col("event_id") * s) % 4).alias("groundedness"), ((F.col("user_id") * s) % 3).alias("coverage"), ((F.col("event_id") % (s + 1)) == 0).cast("int").alias("abstention_correct"))
    return reports.regressions(run(2), run(1)).groupBy("finding").agg(F.count("*").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after"))


I16 = """WITH r AS (SELECT (event_id + user_id) % 5 AS c1, (event_id + user_id * 2) % 5 AS c2, event_id % 4 AS g1, event_id * 2 % 4 AS g2, user_id % 3 AS v1, user_id * 2 % 3 AS v2, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS a1, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS a2 FROM events)
 SELECT finding, count(*) AS n, CAST(sum(b) AS DOUBLE) AS before, CAST(sum(a) AS DOUBLE) AS after FROM (SELECT 'correctness_drop' AS finding, c1 AS b, c2 AS a FROM r WHERE c1 - c2 >= 1 UNION ALL SELECT 'groundedness_drop', g1, g2 FROM r WHERE g1 - g2 >= 1 UNION ALL SELECT 'coverage_drop', v1, v2 FROM r WHERE v2 < v1 UNION ALL SELECT 'abstention_lost', a1, a2 FROM r WHERE a1 = 1 AND a2 = 0) GROUP BY finding"""


def i17(spark, d):
    r = view(spark, d, "rankings").where("variant = 'vector'")
    return reports.depth_gain(r, view(spark, d, "gold"), r.where("rank <= 4"), r.where("rank <= 3"), after=2, upto=5)


I17 = prefix("rankings", "gold") + """, fr AS (SELECT g.question_id, g.corpus_id, g.article_number, min(r.rank) AS first_rank FROM gold g JOIN rankings r ON r.variant = 'vector' AND r.question_id = g.question_id AND r.corpus_id = g.corpus_id AND r.article_number = g.article_number GROUP BY ALL)
 SELECT question_id, 'vector' AS variant, corpus_id, article_number, first_rank, first_rank <= 4 AS in_rerank, first_rank <= 3 AS in_final FROM fr WHERE first_rank BETWEEN 3 AND 5"""


def i18(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("/hybrid")).alias("cache_key"))
    cache = o.where("o_orderkey % 3 <> 0").withColumn("done", F.col("o_orderkey") % 2 == 0)
    return reports.pending(o, cache, complete=F.col("done"))


I18 = "SELECT o_orderkey, concat(o_orderkey, '/hybrid') AS cache_key FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 <> 0"

# --- curation: documents as questions


def _questions(spark, d):
    q = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 3).cast("string")).alias("gold_key"))
    return q.withColumn("normalized", text.normalize_question("question"))


def j1(spark, d):
    return curate.duplicate_pairs(_questions(spark, d)).withColumn("similarity", F.round("similarity", 6))


_J1 = f"""WITH q AS (SELECT doc_id AS id, concat(lang, '/', doc_id % 3) AS gk, {NORMALIZED} AS nt FROM documents),
 fi AS (SELECT *, min(id) OVER (PARTITION BY nt) AS f FROM q), one AS (SELECT nt, gk, min(id) AS id, list_distinct([x FOR x IN string_split(nt, ' ') IF length(x) > 2]) AS t FROM q GROUP BY nt, gk),
 le AS (SELECT a.id AS a, b.id AS b, a.gk = b.gk AS sg, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS n FROM one a JOIN one b ON a.id < b.id AND a.nt <> b.nt AND least(len(a.t), len(b.t)) >= 0.75 * greatest(len(a.t), len(b.t)) WHERE len(a.t) > 0 AND len(b.t) > 0),
 pr AS (SELECT a, b, sg, i * 1.0 / (n - i) AS s FROM le),
 em AS (SELECT id, min(id) OVER () AS f FROM one WHERE len(t) = 0),
 du AS (SELECT f AS a, id AS b, 'identical normalized question text' AS reason, 1.0 AS similarity FROM fi WHERE id <> f UNION ALL SELECT a, b, CASE WHEN s >= 0.92 THEN 'high lexical similarity' ELSE 'same gold articles with similar wording' END, round(s, 6) FROM pr WHERE s >= 0.92 OR (s >= 0.75 AND sg) UNION ALL SELECT f, id, 'high lexical similarity', 1.0 FROM em WHERE id <> f)"""
J1 = _J1 + " SELECT * FROM du"


def j2(spark, d):
    g = curate.duplicate_groups(curate.duplicate_pairs(_questions(spark, d)))
    return g.select("component", F.size("members").alias("members"), F.round("max_similarity", 6).alias("max_similarity"))


J2 = _J1.replace("WITH q", "WITH RECURSIVE q", 1).replace(" du AS (", " du AS MATERIALIZED (") + """, ed AS MATERIALIZED (SELECT a, b FROM du UNION SELECT b, a FROM du), re AS (SELECT a AS n, a AS m FROM ed UNION SELECT ed.b, re.m FROM re JOIN ed ON ed.a = re.n WHERE re.m < ed.b),
 cp AS (SELECT n, min(m) AS c FROM re GROUP BY n) SELECT c AS component, count(*) AS members, any_value(s) AS max_similarity FROM cp JOIN (SELECT c AS c2, round(max(similarity), 6) AS s FROM du JOIN cp ON cp.n = du.a GROUP BY c) x ON x.c2 = cp.c GROUP BY c"""


def j3(spark, d):
    return curate.dedupe_questions(_questions(spark, d)).select("question_id", F.md5("normalized").alias("normalized_md5"))


J3 = f"SELECT min(doc_id) AS question_id, md5(n) AS normalized_md5 FROM (SELECT doc_id, {NORMALIZED} AS n FROM documents) GROUP BY n"


def _candidates(spark, d):
    gold = view(spark, d, "gold").groupBy("question_id").agg(F.collect_list(F.struct("corpus_id", "article_number")).alias("gold_articles"), F.collect_set("corpus_id").alias("gold_corpus_ids"))
    q = view(spark, d, "questions").join(gold, "question_id")
    return q.withColumn("question", F.when(F.col("question_id") % 8 == 0, " ").otherwise("why")).withColumn("reference_answer", F.lit("so")).withColumn("source_articles", F.when(F.col("question_id") % 3 != 0, F.array(F.struct(F.lit("c0").alias("corpus_id"), F.lit("a0").alias("article_number")))))


def j4(spark, d):
    registry = view(spark, d, "ranked").where("l_partkey % 5 < 2 AND article_number <> 'a3'").select("corpus_id", "article_number").distinct()
    return curate.valid_candidates(_candidates(spark, d), registry).select("question_id", "question_type")


J4 = prefix("gold", "questions", "ranked") + """, rg AS (SELECT DISTINCT corpus_id, article_number FROM ranked WHERE l_partkey % 5 < 2 AND article_number <> 'a3'), bad AS (SELECT DISTINCT question_id FROM gold g ANTI JOIN rg ON rg.corpus_id = g.corpus_id AND rg.article_number = g.article_number)
 SELECT q.question_id, question_type FROM questions q SEMI JOIN gold g ON g.question_id = q.question_id ANTI JOIN bad b ON b.question_id = q.question_id WHERE q.question_id % 8 <> 0"""


def j5(spark, d):
    return curate.sanitize(_candidates(spark, d)).select("question_id", F.size("gold_articles").alias("gold"), F.size("source_articles").alias("sources"))


J5 = prefix("gold") + " SELECT question_id, count(*) AS gold, CASE WHEN question_id % 3 <> 0 THEN count(*) + CASE WHEN bool_or(corpus_id = 'c0' AND article_number = 'a0') THEN 0 ELSE 1 END END AS sources FROM gold GROUP BY question_id"


def j6(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id"), (F.col("s_nationkey") % 7).alias("score"))
    n = q.count()
    easy = n // 4
    return curate.assign_difficulty(q, {"easy": easy, "medium": n // 2, "hard": n - easy - n // 2}).select("question_id", "score", "difficulty")


J6 = """WITH q AS (SELECT s_suppkey AS question_id, s_nationkey % 7 AS score, count(*) OVER () AS n FROM supplier),
 p AS (SELECT *, n // 4 AS qe, n // 2 AS qm, n - n // 4 - n // 2 AS qh, CASE WHEN score <= 1 THEN 'easy' WHEN score >= 4 THEN 'hard' ELSE 'rest' END AS pool FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score, question_id) AS place FROM p),
 f AS (SELECT *, CASE WHEN pool = 'easy' AND place <= qe THEN 'easy' WHEN pool = 'hard' AND place <= qh THEN 'hard' END AS first FROM r),
 u AS (SELECT *, qe - count(*) FILTER (first = 'easy') OVER () AS el, qh - count(*) FILTER (first = 'hard') OVER () AS hl, count(*) FILTER (first IS NULL AND score < 4) OVER () AS nl,
   row_number() OVER (PARTITION BY first IS NULL, score < 4 ORDER BY score, question_id) AS k FROM f),
 v AS (SELECT *, least(nl, qm) AS lm, least(nl - least(nl, qm), hl) AS lh FROM u)
 SELECT question_id, score, CASE WHEN first IS NOT NULL THEN first WHEN score < 4 THEN CASE WHEN k <= lm THEN 'medium' WHEN k <= lm + lh THEN 'hard' ELSE 'easy' END
  WHEN k <= hl - lh THEN 'hard' WHEN k <= hl - lh + qm - lm THEN 'medium' ELSE 'easy' END AS difficulty FROM v"""


def j7(spark, d):
    return curate.sample_diverse(view(spark, d, "articles"), 60).select("corpus_id", "section", "article_number", "turn")


J7 = "SELECT lang AS corpus_id, source AS section, CAST(doc_id AS VARCHAR) AS article_number, turn FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY CAST(doc_id AS VARCHAR)) AS turn FROM documents WHERE length(text) BETWEEN 80 AND 6000) ORDER BY turn, lang, source, article_number LIMIT 60"


def j8(spark, d):
    return curate.topic_bundles(view(spark, d, "articles"), {"license": ["license", "copyright"], "mail": ["@"]}, 40)


J8 = """WITH h AS (SELECT topic, lang AS c, CAST(doc_id AS VARCHAR) AS a FROM documents, (VALUES ('license', ['license', 'copyright']), ('mail', ['@'])) t(topic, ks) WHERE len([k FOR k IN ks IF contains(lower(text), k)]) > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY topic, c ORDER BY a) AS i FROM h) SELECT x.topic, x.c AS corpus_a, x.a AS article_a, y.c AS corpus_b, y.a AS article_b FROM r x JOIN r y ON x.topic = y.topic AND x.i = y.i AND x.c < y.c WHERE x.i <= 30 ORDER BY x.i, x.topic, corpus_a, corpus_b LIMIT 40"""


def j9(spark, d):
    r = curate.dataset_report(_candidates(spark, d))
    return r.withColumn("mean_gold", F.round("mean_gold", 6))


J9 = prefix("gold", "questions") + """, c AS (SELECT q.question_id, question_type, difficulty, n, g FROM questions q JOIN (SELECT question_id, count(*) AS n, list_sort(list(DISTINCT corpus_id)) AS g FROM gold GROUP BY question_id) x USING (question_id))
 SELECT dimension, value, count(*) AS questions, sum(n) AS gold, round(avg(n), 6) AS mean_gold FROM (SELECT 'type' AS dimension, question_type AS value, n FROM c UNION ALL SELECT 'difficulty', difficulty, n FROM c UNION ALL SELECT 'combination', array_to_string(g, '+'), n FROM c UNION ALL SELECT 'corpus', unnest(g), n FROM c) GROUP BY ALL"""


def j10(spark, d):
    legacy = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("see a"), (F.col("o_custkey") % 7).cast("string"), F.lit(" of code c"), (F.col("o_custkey") % 3).cast("string")).alias("text"), F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("c0"))).otherwise(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))).alias("allowed"), F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")).alias("article_number"))
    registry = view(spark, d, "ranked").where("NOT (corpus_id = 'c0' AND article_number IN ('a1', 'a5'))").select("corpus_id", "article_number").distinct()
    words = spark.createDataFrame([("c0", ["code c0"]), ("c1", ["code c1"]), ("c2", ["codes c2"])], "corpus_id string, keywords array<string>")
    return curate.reconcile_gold(legacy, registry, words)


J10 = prefix("ranked") + """, rg AS (SELECT DISTINCT corpus_id, article_number FROM ranked WHERE NOT (corpus_id = 'c0' AND article_number IN ('a1', 'a5'))),
 o AS (SELECT o_orderkey AS question_id, concat('a', o_custkey % 7) AS article_number, o_custkey % 3 AS c, o_orderkey % 4 = 0 AS only0 FROM orders),
 j AS (SELECT o.question_id, o.article_number, count(corpus_id) FILTER (NOT only0 OR corpus_id = 'c0') AS n, max(CASE WHEN NOT only0 OR corpus_id = 'c0' THEN corpus_id END) AS one, count(*) FILTER ((NOT only0 OR corpus_id = 'c0') AND c < 2 AND corpus_id = concat('c', c)) AS m, any_value(c) AS c FROM o LEFT JOIN rg USING (article_number) GROUP BY o.question_id, o.article_number)
 SELECT question_id, article_number, CASE WHEN n = 1 THEN one WHEN n > 1 AND m = 1 THEN concat('c', c) END AS corpus_id, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'unique' WHEN m = 1 THEN 'keyword' ELSE 'ambiguous' END AS how FROM j"""


def j11(spark, d):
    r = view(spark, d, "questions").select("question_id", F.col("question_type").alias("class"))
    return curate.select_cohort(r, ["multi-corpus", "ambiguous", "single-corpus"], {"multi-corpus": 20, "ambiguous": 10, "single-corpus": 15}, 50)


J11 = prefix("questions") + """, r AS (SELECT question_id, question_type AS class, CASE question_type WHEN 'multi-corpus' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'single-corpus' THEN 3 ELSE 4 END AS o, CASE question_type WHEN 'multi-corpus' THEN 20 WHEN 'ambiguous' THEN 10 WHEN 'single-corpus' THEN 15 ELSE 0 END AS cap, row_number() OVER (PARTITION BY question_type ORDER BY question_id) AS n FROM questions)
 SELECT question_id, class FROM r ORDER BY n > cap, o, question_id LIMIT 50"""


def j12(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", "text")
    h = curate.conversation_history(m, "Be brief.")
    return h.select("conversation_id", F.size("messages").alias("messages"), F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["text"])), "|")).alias("history_md5"))


J12 = "SELECT conv_id AS conversation_id, count(*) + 1 AS messages, md5(concat('system:Be brief.|', string_agg(concat_ws(':', role, text), '|' ORDER BY turn, role, text))) AS history_md5 FROM conversations GROUP BY conv_id"

QUERIES = {
    "i1_routing_scores": (i1, I1), "i2_routing_summary": (i2, I2), "i3_breakdown": (i3, I3), "i4_latency_stats": (i4, I4), "i5_e2e_summary": (i5, I5), "i6_quality_report": (i6, I6), "i6_problem_questions": (i6b, I6B), "i7_source_report": (i7, I7), "i8_failure_stage": (i8, I8),
    "i9_loss_totals": (i9, I9), "i9_primary_loss": (i9b, I9B), "i10_loss_metrics": (i10, I10), "i11_competitors": (i11, I11), "i12_loss_cause": (i12, I12), "i13_lexical_diagnosis": (i13, None), "i14_answer_forensic": (i14, I14), "i15_compare_runs": (i15, I15), "i16_regressions": (i16, I16),
    "i17_depth_gain": (i17, I17), "i18_pending": (i18, I18), "j1_duplicate_pairs": (j1, J1), "j2_duplicate_groups": (j2, J2), "j3_dedupe_questions": (j3, J3), "j4_valid_candidates": (j4, J4), "j5_sanitize": (j5, J5), "j6_assign_difficulty": (j6, J6), "j7_sample_diverse": (j7, J7),
    "j8_topic_bundles": (j8, J8), "j9_dataset_report": (j9, J9), "j10_reconcile_gold": (j10, J10), "j11_select_cohort": (j11, J11), "j12_conversation_history": (j12, J12),
}
