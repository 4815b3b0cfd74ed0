"""From page text to articles: lines, headings, articles, ids, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADINGS, article_format, fold_text, has_footer_pollution, heading_level, is_blank_page, match_article_line, normalize_article_id
from ..sources.shared import stored

LEVELS = tuple(HEADINGS)


def page_lines(pages: DataFrame) -> DataFrame:
    """(corpus_id, page_no, pos, line) of every line of every page."""
    return pages.select("corpus_id", "page_no", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def parse_articles(lines: DataFrame, strict: bool = True, key: str = "corpus_id") -> DataFrame:
    """Articles of a table of lines, dropped ones with the reason in `dropped`.

    A heading or article line closes the article before it; lines after a heading belong to none until
    the next article line. Each level's last heading is inherited; a new one clears no other level.
    `key` names what the order of lines holds within. Lines are dealt to ranges of that order, and each range
    takes the headings and counts that hold at its start from the ranges before it, so no key is one task's work."""
    t = F.regexp_replace("line", r"^\s+|\s+$", "")
    marked = lines.withColumn("t", t).withColumn("level", heading_level("t"))
    marked = marked.withColumn("match", F.when(F.col("level").isNull(), match_article_line("t", strict)))
    marked = marked.select(key, "page_no", "pos", "t", "level", "match", (F.col("level").isNotNull() | F.col("match").isNotNull()).alias("edge"))
    ranges = stored(marked.repartitionByRange(key, "page_no", "pos").withColumn("range", F.spark_partition_id()))
    # what a line leaves to those behind it: headings by level, and whether an article is open
    left = {level: F.when(F.col("level") == level, F.col("t")) for level in LEVELS} | {"open": F.when(F.col("edge"), F.col("match").isNotNull())}
    at = F.struct("page_no", "pos")
    ends = ranges.groupBy("range", key).agg(F.count_if("edge").alias("edges"), *[F.max_by(v, F.when(v.isNotNull(), at)).alias(k) for k, v in left.items()])
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("range").alias("of_range"), F.col(key).alias("of_key"), F.coalesce(F.sum("edges").over(earlier), F.lit(0)).alias("edges_before"), *[F.last(k, ignorenulls=True).over(earlier).alias(f"{k}_before") for k in left])
    order = Window.partitionBy("range", key).orderBy("page_no", "pos")
    known = ranges.join(carried, (F.col("range") == F.col("of_range")) & F.col(key).eqNullSafe(F.col("of_key")))
    marked = known.withColumn("island", F.col("edges_before") + F.sum(F.col("edge").cast("int")).over(order))
    for k, v in left.items():
        marked = marked.withColumn(k, F.coalesce(F.last(v, ignorenulls=True).over(order), F.col(f"{k}_before")))
    marked = marked.where("open")
    opener = F.col("match").isNotNull()
    kept = [F.first(F.when(opener, F.col(level)), ignorenulls=True).alias(level) for level in LEVELS]
    articles = marked.groupBy(key, "island").agg(
        F.first(F.when(opener, F.col("match")), ignorenulls=True).alias("m"),
        F.min(F.when(opener, F.struct("page_no", "pos"))).alias("at"),
        F.min("page_no").alias("page_start"),
        F.max("page_no").alias("page_end"),
        F.sort_array(F.collect_list(F.when(~opener, F.struct("page_no", "pos", "t")))).alias("body"),
        *kept,
    )
    content = F.regexp_replace(F.array_join(F.transform("body", lambda b: b["t"]), "\n"), r"^\s+|\s+$", "")
    number = F.col("m.raw_number") if strict else normalize_article_id("m.raw_number", "m.kind")
    articles = articles.select(key, F.col("at.page_no").alias("page_no"), F.col("at.pos").alias("pos"), number.alias("base_number"), F.col("m.raw_number").alias("raw_article_number"), F.col("m.kind").alias("article_kind"), content.alias("content"), "page_start", "page_end", *LEVELS)
    section_only = F.col("content").rlike(r"^Section \d+ :") & (F.length("content") < 120) & ~F.col("content").contains("\n\n")
    articles = articles.withColumn("dropped", F.when(F.col("content") == "", "empty").when(section_only, "section-only"))
    return resolve_duplicate_ids(articles, key)


def resolve_duplicate_ids(articles: DataFrame, key: str = "corpus_id") -> DataFrame:
    """article_number: later articles of one number get their page, and their count if the page repeats it.

    Counted before articles are dropped."""
    by_id = Window.partitionBy(key, "base_number").orderBy("page_no", "pos")
    by_page = Window.partitionBy(key, "base_number", "page_no").orderBy("pos")
    n, on_page = F.row_number().over(by_id), F.row_number().over(by_page)
    counted = articles.withColumn("occurrence", n).withColumn("on_page", on_page)
    paged = F.concat("base_number", F.lit("@p"), F.col("page_no").cast("string"))
    number = F.when(F.col("occurrence") == 1, F.col("base_number")).when(F.col("on_page") == 1, paged).otherwise(F.concat(paged, F.lit("@o"), F.col("occurrence").cast("string")))
    return counted.withColumn("article_number", number).drop("on_page")


def kept_articles(articles: DataFrame) -> DataFrame:
    return articles.where("dropped IS NULL").drop("dropped")


def annotate_oversized(articles: DataFrame, threshold: int = 10_000) -> DataFrame:
    return articles.withColumn("content_length", F.length("content")).withColumn("is_oversized", F.length("content") >= threshold)


def content_stats(articles: DataFrame) -> DataFrame:
    """Per corpus: articles, least, greatest, mean and upper median length, and how many are over 1500 and 2000."""
    sized = articles.select("corpus_id", F.length("content").alias("n"))
    w = Window.partitionBy("corpus_id")
    # the upper median of n lengths is the one at n div 2 + 1 of their order: found from counts of equal lengths
    counts = sized.groupBy("corpus_id", "n").agg(F.count("*").alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("total", F.sum("c").over(w))
    median = placed.where("upto >= floor(total / 2) + 1").groupBy("corpus_id").agg(F.min("n").alias("median_length"))
    stats = sized.groupBy("corpus_id").agg(
        F.count("*").alias("articles"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.round(F.avg("n"), 1).alias("mean_length"), F.count_if(F.col("n") > 1500).alias("over_1500"), F.count_if(F.col("n") > 2000).alias("over_2000")
    )
    return stats.join(median, "corpus_id")


def ingestion_report(pages: DataFrame, articles: DataFrame, threshold: int = 10_000) -> DataFrame:
    """Per corpus: pages, blank pages, articles, distinct ids, renamed, empty, section-only, oversized, polluted."""
    of_pages = pages.groupBy("corpus_id").agg(F.count("*").alias("pages"), F.count_if(is_blank_page("text")).alias("blank_pages"))
    kept = F.col("dropped").isNull()
    of_articles = annotate_oversized(articles, threshold).groupBy("corpus_id").agg(
        F.count_if(kept).alias("articles"),
        F.countDistinct(F.when(kept, F.col("article_number"))).alias("unique_ids"),
        F.count_if(F.col("occurrence") > 1).alias("renamed"),
        F.count_if(F.col("dropped") == "empty").alias("dropped_empty"),
        F.count_if(F.col("dropped") == "section-only").alias("dropped_section_only"),
        F.count_if(kept & F.col("is_oversized")).alias("oversized"),
        F.count_if(kept & has_footer_pollution("content")).alias("polluted"),
    )
    zero = {c: 0 for c in of_articles.columns if c != "corpus_id"}
    return of_pages.join(of_articles, "corpus_id", "left").na.fill(zero)


def audit_corpus(lines: DataFrame, articles: DataFrame, top: int = 5) -> DataFrame:
    """(corpus_id, measure, name, n): formats, line patterns, longest and shortest articles, anomalies."""
    formats = articles.groupBy("corpus_id", article_format("base_number").alias("name")).agg(F.count("*").alias("n")).select("corpus_id", F.lit("format").alias("measure"), "name", "n")
    t = F.trim("line")
    kind = F.coalesce(heading_level(t), F.when(match_article_line(t, False).isNotNull(), F.lit("article")), F.when(t.startswith("Article "), F.lit("article-like")), F.lit("text"))
    patterns = lines.groupBy("corpus_id", kind.alias("name")).agg(F.count("*").alias("n")).select("corpus_id", F.lit("line").alias("measure"), "name", "n")
    sized = articles.select("corpus_id", "article_number", F.length("content").alias("n"))
    out = formats.unionByName(patterns)
    for measure, order in (("longest", F.desc("n")), ("shortest", F.asc("n"))):
        w = Window.partitionBy("corpus_id").orderBy(order, "article_number")
        out = out.unionByName(sized.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select("corpus_id", F.lit(measure).alias("measure"), F.col("article_number").alias("name"), F.col("n").cast("long").alias("n")))
    flags = {"abrogated": F.lower("content").contains("abrogé"), "many-pages": F.col("page_end") - F.col("page_start") > 3, "bis-ter": F.col("base_number").rlike(r"(?i)\b(bis|ter)\b")}
    odd = articles.groupBy("corpus_id").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    odd = odd.select("corpus_id", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in flags]), F.array(*[F.col(f"`{k}`") for k in flags]))).alias("name", "n"))
    return out.unionByName(odd.select("corpus_id", F.lit("anomaly").alias("measure"), "name", "n"))


def diff_articles(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("corpus_id", "article_number")) -> DataFrame:
    """(keys, status): missing, added, changed or identical content of two builds, by the SHA-256 of contents."""
    digest = F.sha2("content", 256)
    a = old.select(*keys, digest.alias("before"), F.lit(True).alias("was"))
    b = new.select(*keys, digest.alias("after"), F.lit(True).alias("is"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("before").eqNullSafe(F.col("after")), "identical").otherwise("changed")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["fold_text"]
