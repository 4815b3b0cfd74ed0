"""Importance resampling: texts are weighted by the ratio of two hashed n-gram models, that of the
target and that of all raw text, and drawn without replacement by the Gumbel top-k trick."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, id_key, joined, mix, prefix_hash, range_hash, use_checkpoints, utf8, words_of

BUCKETS = 10_000
_BLOCK = 300_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngram_buckets(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, text number, bucket) of the hashed words and word pairs of blocks of texts.

    Words are cut at ASCII white space, with A-Z as a-z."""
    for a, b in batches([len(t) for t in texts], _BLOCK):
        data, ends = joined(texts[a:b])
        data = _LOWER[data]
        start, end, doc = words_of(data, ends)
        word = range_hash(prefix_hash(data), start, end)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = mix(word[pair] * np.uint64(0x9E3779B97F4A7C15) + word[pair + 1])
        yield a, b, np.concatenate([doc, doc[pair]]), (np.concatenate([word, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) over a table with text and is_target; each task counts before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in it:
            wanted = np.array(batch.column(1).to_pylist(), bool)
            for a, b, doc, bucket in ngram_buckets(batch.column(0).to_pylist(), buckets):
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[a:b][doc]], minlength=buckets)
        on = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(target[on])], names=["bucket", "raw", "target"])

    counts = docs.select(utf8().alias("text"), F.coalesce("is_target", F.lit(False)).alias("is_target")).mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list, buckets: int = BUCKETS) -> np.ndarray:
    """log(target share / raw share) of each bucket, with one added to every count."""
    raw, target = np.ones(buckets), np.ones(buckets)
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_grams, log_weight, draw) of every row: draw is the log weight with Gumbel noise."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            weight, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, b, doc, bucket in ngram_buckets(texts, len(ratios)):
                weight[a:b] = np.bincount(doc, ratios[bucket], minlength=b - a)
                n[a:b] = np.bincount(doc, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight)], names=["doc_id", "n_grams", "log_weight"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_key(), "log_weight"), 12) + F.lit(0.5)) / F.lit(float(2**52))
    return scored.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform)))


def highest(rows: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """Mark in `selected` the k rows of highest value, ties to the smaller `tie`, without a global sort.

    The k-th highest value is found 16 bits at a time: each round counts the values that share the
    bits so far by their next ones, which are 65536 counts at most."""
    bits = F.expr(f"reflect('java.lang.Double', 'doubleToRawLongBits', `{value}`)").cast("long")
    # as a number that sorts like the double, without sign: the halves are compared by their order
    flipped = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63) + 1) - 1))
    keyed = rows.withColumn("__order", flipped)
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    left, prefix = k, 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("__order", shift).bitwiseAND(0xFFFF)
        among = keyed if shift == 48 else keyed.where(F.shiftrightunsigned("__order", shift + 16) == F.lit(prefix))
        counts = sorted(((r.d, r.n) for r in among.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if left <= n:
                prefix = (prefix << 16) | d
                break
            left -= n
        else:
            return rows.withColumn("selected", F.lit(True))
    edge = prefix - (1 << 64) if prefix >> 63 else prefix
    top = F.col("__order").bitwiseXOR(F.lit(-(2**63) + 1) - 1)  # back to signed order
    edge_signed = F.lit(edge).bitwiseXOR(F.lit(-(2**63) + 1) - 1)
    ties = keyed.where(F.col("__order") == F.lit(edge)).select(tie).orderBy(F.col(tie).asc_nulls_last()).limit(left)
    last = ties.agg(F.max(F.coalesce(tie, F.lit(2**63 - 1))).alias("m"), F.count("*").alias("n")).first()
    at_edge = (F.col("__order") == F.lit(edge)) & (F.coalesce(F.col(tie), F.lit(2**63 - 1)) <= F.lit(last.m))
    return keyed.withColumn("selected", (top > edge_signed) | at_edge).drop("__order")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, draw, selected) of every document.

    Target text: documents that `labels` marks with quality 1; raw text: all of them. `share` of the
    documents are selected, rounded up; by default the share of target text among the labelled ones.
    The noise of a draw depends on seed, id and weight only, so that a rerun selects the same rows.
    Both models count every row. Null and empty texts have weight 0; repeated rows draw alike, and
    ties at the edge go to smaller ids (rows with one id stand or fall together); rows without an id
    take part under null. Texts meet labels by a sort-merge join whatever their sizes. Without labels nothing tells target from raw text: all weights are those of
    the smoothing, and all rows are selected. An empty table gives an empty result."""
    use_checkpoints(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.max("quality") == 1).alias("is_target"))
    if share is None:
        share = marked.agg(F.avg(F.col("is_target").cast("double")).alias("s")).first().s
        share = 1.0 if share is None else share
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = bucket_counts(texts.join(marked.hint("merge"), texts["doc_id"] == marked["__id"], "left"), buckets).collect()
    drawn = weights(texts, log_ratios(counts, buckets), seed).checkpoint()
    return highest(drawn, "draw", "doc_id", int(np.ceil(share * drawn.count())))


