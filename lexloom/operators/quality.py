"""Data-quality checks. Each returns violations: (check, corpus_id, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("corpus_id", "chunk_id")


class CheckFailed(ValueError):
    """Raised by fail_on_violations."""


def _violations(df: DataFrame, check: str, key: Column | str, detail: Column | str, corpus: Column | str = "corpus_id") -> DataFrame:
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(F.lit(check).alias("check"), c(corpus).alias("corpus_id"), c(key).alias("key"), c(detail).alias("detail"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fail_on_violations(violations: DataFrame, show: int = 5) -> None:
    """Raise with the first few violations, if there are any."""
    some = violations.limit(show).collect()
    if some:
        raise CheckFailed("; ".join(f"{r.check} {r.corpus_id}/{r.key}: {r.detail}" for r in some))


def duplicate_keys(df: DataFrame, keys: Sequence[str], check: str = "duplicate_key") -> DataFrame:
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    corpus = F.col("corpus_id") if "corpus_id" in keys else F.lit(None)
    return _violations(found, check, F.concat_ws("/", *[F.col(k).cast("string") for k in keys if k != "corpus_id"]), "n", corpus)


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Ids there and unique, content not blank, char_count that of the content."""
    blank_id = chunks.where(F.col("chunk_id").isNull() | (F.trim("chunk_id") == ""))
    blank = chunks.where(F.col("content").isNull() | F.col("content").rlike(r"^\s*$"))
    count = chunks.where(~F.col("char_count").eqNullSafe(F.length("content")))
    return _union([_violations(blank_id, "missing_id", "chunk_id", F.lit("blank")), duplicate_keys(chunks, KEY, "duplicate_chunk"), _violations(blank, "blank_content", "chunk_id", F.lit("blank")), _violations(count, "char_count", "chunk_id", "char_count")])


def check_records(chunks: DataFrame, records: DataFrame, fields: Sequence[str] = ("content", "char_count", "article_number")) -> DataFrame:
    """Records against their source chunks: missing, unknown, repeated, and fields that differ."""
    keys = list(KEY)
    missing = chunks.join(records.select(*keys), keys, "left_anti")
    unknown = records.join(chunks.select(*keys), keys, "left_anti")
    both = chunks.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields]).join(records.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields]), keys)
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]))
    wrong = both.select(*keys, F.explode(differs).alias("field"))
    return _union([_violations(missing, "missing_record", "chunk_id", F.lit("no record")), _violations(unknown, "unknown_record", "chunk_id", F.lit("no chunk")), duplicate_keys(records, KEY, "duplicate_record"), _violations(wrong, "field_mismatch", "chunk_id", "field")])


def vector_problem(col: str, dims: int) -> Column:
    v = F.col(col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return F.when(v.isNull(), "missing").when(F.size(v) != dims, "dimension").when(odd, "not_finite").when(zero, "zero_norm")


def check_vectors(df: DataFrame, col: str, dims: int, key: str = "chunk_id") -> DataFrame:
    """Vectors that are missing, of another dimension, not finite, or of no length."""
    found = df.withColumn("__problem", vector_problem(col, dims)).where("__problem IS NOT NULL")
    corpus = F.col("corpus_id") if "corpus_id" in df.columns else F.lit(None)
    return _violations(found, "vector", key, "__problem", corpus)


def align_batch(results: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of complete batches joined by index, violations). Both: batch, index; a batch must have 0..n-1 once each."""
    got = results.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    want = expected.groupBy("batch").agg(F.count("*").alias("want"))
    both = want.join(got, "batch", "left")
    problem = F.when(F.col("n").isNull(), "no_results").when(F.col("d") < F.col("n"), "duplicate_index").when((F.col("lo") < 0) | (F.col("hi") >= F.col("want")), "index_out_of_range").when(F.col("n") < F.col("want"), "missing_index")
    both = both.withColumn("problem", problem)
    good = both.where("problem IS NULL").select("batch")
    return expected.join(good, "batch", "left_semi").join(results, ["batch", "index"]), _violations(both.where("problem IS NOT NULL"), "batch", "batch", "problem", F.lit(None))


_AUDIT = ("rows", "distinct_ids", "duplicates", "missing_content", "missing_embeddings", "present_embeddings", "wrong_dimension", "models")


def _audit_aggs(dims: int, key: Column) -> list[Column]:
    v = F.col("embedding")
    return [
        F.count("*").alias("rows"),
        F.countDistinct(key).alias("distinct_ids"),
        (F.count("*") - F.countDistinct(key)).alias("duplicates"),
        F.count_if(F.col("content").isNull() | (F.trim("content") == "")).alias("missing_content"),
        F.count_if(v.isNull()).alias("missing_embeddings"),
        F.count_if(v.isNotNull()).alias("present_embeddings"),
        F.count_if(v.isNotNull() & (F.size(v) != dims)).alias("wrong_dimension"),
        F.array_join(F.sort_array(F.collect_set("embedding_model")), ",").alias("models"),
    ]


def store_audit(store: DataFrame, dims: int) -> DataFrame:
    """One row for each corpus."""
    return store.groupBy("corpus_id").agg(*_audit_aggs(dims, F.col("chunk_id")))


def store_audit_global(store: DataFrame, dims: int) -> DataFrame:
    """One row for each corpus and one (null) over all: a rollup."""
    return store.rollup("corpus_id").agg(*_audit_aggs(dims, F.struct(*KEY)))


QUESTION_TYPES = ("single-corpus", "multi-corpus", "ambiguous", "out-of-scope")


def check_questions(questions: DataFrame, known_corpora: Sequence[str], id_pattern: str = r"^q\d{3}$", normalized: str = "normalized") -> DataFrame:
    """Ids, repeated texts, blank fields, types against gold, unknown corpora, corpora other than those of articles."""
    known = F.array(*[F.lit(c) for c in known_corpora])
    of_articles = F.sort_array(F.array_distinct(F.transform("gold_articles", lambda a: a["corpus_id"])))
    n, t = F.size("gold_corpus_ids"), F.col("question_type")
    rules = {
        "bad_id": ~F.col("question_id").rlike(id_pattern),
        "blank_question": F.trim(F.coalesce("question", F.lit(""))) == "",
        "blank_answer": F.trim(F.coalesce("reference_answer", F.lit(""))) == "",
        "type_vs_gold": F.when(t == "single-corpus", n != 1).when(t == "multi-corpus", n < 2).otherwise((n != 0) & (t == "out-of-scope")),
        "unknown_type": ~t.isin(*QUESTION_TYPES),
        "unknown_corpus": F.exists("gold_corpus_ids", lambda c: ~F.array_contains(known, c)),
        "corpora_vs_articles": (F.size("gold_articles") > 0) & (of_articles != F.sort_array(F.array_distinct("gold_corpus_ids"))),
    }
    broken = questions.select("question_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    one = F.lit(None)
    again = questions.groupBy(normalized).agg(F.count("*").alias("n"), F.min("question_id").alias("first")).where("n > 1")
    return _union([_violations(broken, "question", "question_id", "rule", one), duplicate_keys(questions, ["question_id"], "duplicate_question"), _violations(again, "repeated_text", "first", "n", one)])


def check_gold(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """Gold and source articles that the registry lacks, and gold that the sources leave out."""
    out = []
    for field in ("gold_articles", "source_articles"):
        if field in questions.columns:
            each = questions.select("question_id", F.explode(field).alias("a")).select("question_id", "a.corpus_id", "a.article_number")
            out.append(_violations(each.join(registry, ["corpus_id", "article_number"], "left_anti"), f"missing_{field}", F.concat_ws("/", "question_id", "article_number"), F.lit("not in registry")))
    if "source_articles" in questions.columns:
        left = questions.where(F.col("source_articles").isNotNull()).select("question_id", F.explode(F.array_except("gold_articles", "source_articles")).alias("a"))
        out.append(_violations(left, "gold_not_in_sources", "question_id", F.col("a.article_number"), F.col("a.corpus_id")))
    return _union(out)


def check_distribution(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """(dimension, value, n) against (dimension, value, quota): every difference, either side missing included."""
    both = counts.join(quotas, ["dimension", "value"], "full").where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("quota", F.lit(0))))
    return _violations(both, "distribution", F.concat_ws("/", "dimension", "value"), F.concat(F.coalesce(F.col("n").cast("string"), F.lit("0")), F.lit(" of "), F.coalesce(F.col("quota").cast("string"), F.lit("0"))), F.lit(None))


def check_report(stored: DataFrame, recomputed: DataFrame, tol: float = 0.01, key: Sequence[str] = ()) -> DataFrame:
    """One-row-per-key reports of equal numeric columns: every metric that differs by more than `tol`."""
    metrics = [c for c in stored.columns if c not in key]
    turn = lambda df, to: df.unpivot(list(key), metrics, "metric", to) if key else df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", to))
    both = turn(stored, "a").join(turn(recomputed, "b"), [*key, "metric"], "full")
    off = both.where(F.coalesce(F.abs(F.col("a") - F.col("b")) > tol, ~F.col("a").eqNullSafe(F.col("b"))))
    return _violations(off, "report", F.concat_ws("/", *[F.col(k).cast("string") for k in key], "metric"), F.concat_ws(" vs ", F.col("a").cast("string"), F.col("b").cast("string")), F.lit(None))


def check_results(results: DataFrame, expected: DataFrame, required: Sequence[str] = ("answer",)) -> DataFrame:
    """Results of questions: missing, unasked, repeated, incomplete, and abstentions that made calls."""
    missing = expected.join(results, "question_id", "left_anti")
    unasked = results.join(expected, "question_id", "left_anti")
    empty = results.select("question_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]))).alias("field"))
    out = [_violations(missing, "missing_result", "question_id", F.lit("none"), F.lit(None)), _violations(unasked, "unasked_result", "question_id", F.lit("none"), F.lit(None)), duplicate_keys(results, ["question_id"], "duplicate_result"), _violations(empty, "empty_field", "question_id", "field", F.lit(None))]
    if {"status", "calls"} <= set(results.columns):
        out.append(_violations(results.where("status = 'abstained' AND calls > 0"), "abstained_with_calls", "question_id", "calls", F.lit(None)))
    return _union(out)
