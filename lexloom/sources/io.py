"""Reading and writing the tables that the operators work on, always with given schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .published import current, publish, read_published

PAGES = "corpus_id STRING, page_no INT, text STRING"
CHUNKS = "corpus_id STRING, chunk_id STRING, article_number STRING, content STRING, char_count INT"
RECORDS = CHUNKS + ", embedding ARRAY<FLOAT>, embedding_model STRING, embedded_at TIMESTAMP"
ARTICLE = "STRUCT<corpus_id: STRING, article_number: STRING>"
QUESTIONS = f"question_id STRING, question STRING, gold_corpus_ids ARRAY<STRING>, gold_articles ARRAY<{ARTICLE}>, reference_answer STRING, difficulty STRING, question_type STRING, source_articles ARRAY<{ARTICLE}>"
DIFFICULTIES = ("easy", "medium", "hard")
TYPES = ("single-corpus", "multi-corpus", "ambiguous", "out-of-scope")


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Parquet or JSON lines, by what the path ends in; Parquet is the default."""
    reader = spark.read.schema(schema).options(**options)
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl", ".ndjson", ".json.gz")) else reader.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PAGES)


def read_result(spark: SparkSession, path: str, array_field: str, schema: str) -> DataFrame:
    """Rows of the array in one large JSON document. `schema`: that of its items."""
    item = T.StructType.fromDDL(schema)
    whole = spark.read.schema(T.StructType([T.StructField(array_field, T.ArrayType(item))])).option("multiLine", True).json(path)
    return whole.select(F.inline(array_field))


def read_embeddings(spark: SparkSession, path: str, array_field: str | None = None) -> DataFrame:
    """Embedding records from Parquet or JSON lines, which are read in splits; or from one document."""
    return read_result(spark, path, array_field, RECORDS) if array_field else _read(spark, path, RECORDS)


def write_table(df: DataFrame, path: str, partition_by: str | None = "corpus_id", report: DataFrame | None = None) -> None:
    """Replace a table and its report in one step; read it by read_table(). Until then, and if the write fails, readers
    see the old rows."""
    publish(df, path, partition_by, report=report)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """What write_table() or a synchronised stream has published."""
    return read_published(spark, path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The report of the published table, if it has one."""
    name = (current(spark, path) or {}).get("report")
    return spark.read.json(f"{path.rstrip('/')}/{name}") if name else None


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, rejects): rejects hold the raw row and why it isn't taken.

    Lines are read as text and parsed by the schema, so that a broken one is a row and not an error."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw").where(F.trim("raw") != "")
    q = F.from_json("raw", QUESTIONS)
    parsed = raw.withColumn("q", q)
    reason = (
        F.when(F.get_json_object("raw", "$").isNull() | F.col("q").isNull(), "invalid_json")
        .when(F.col("q.question_id").isNull() | F.col("q.question").isNull(), "missing_field")
        .when(F.col("q.gold_corpus_ids").isNull() | F.col("q.gold_articles").isNull(), "missing_gold")
        .when(~F.col("q.difficulty").isin(*DIFFICULTIES) | F.col("q.difficulty").isNull(), "bad_difficulty")
        .when(~F.col("q.question_type").isin(*TYPES) | F.col("q.question_type").isNull(), "bad_type")
        .when(F.exists("q.gold_articles", lambda a: a["corpus_id"].isNull() | a["article_number"].isNull()), "bad_gold")
    )
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("q.*"), judged.where("reason IS NOT NULL").select("raw", "reason")


def read_vector_cache(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, vector) from one JSON object of vectors by id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "MAP<STRING, ARRAY<FLOAT>>")).alias("question_id", "vector"))


def article_registry(articles: DataFrame) -> DataFrame:
    return articles.select("corpus_id", "article_number").distinct()


def read_result_cache(spark: SparkSession, root: str, mode: str, schema: str) -> DataFrame:
    """Results of one file each under root/run/mode/, with run_id and question_id from the path."""
    path = F.input_file_name()
    found = spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/*/{mode}/*.json")
    return found.select(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+\.json$", 1).alias("run_id"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("file_id"), "*")


def compact(results: DataFrame, table: str, key: str = "file_id", file_bytes: int = 128_000_000, buckets: int | None = None) -> int:
    """Write many small files' rows as a table of the catalog, bucketed and sorted by `key`; its number of buckets.

    One for each `file_bytes` of the sources, as the plan estimates them, which it can of files. Rows of one key are found in one bucket, and joins
    by it don't move the table."""
    if buckets is None:
        size = int(str(results._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > 2**60:
            raise ValueError("the plan doesn't know the size of its sources; give the number of buckets")
        buckets = max(1, -(-size // file_bytes))
    dealt = results.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return buckets
