"""Incremental synchronisation of a chunk store from arriving files of embedding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import KEY, upsert
from ..sources.io import RECORDS
from ..sources.published import current, publish, read_published
from ..sources.shared import stored


def latest(batch: DataFrame, order: str = "embedded_at") -> DataFrame:
    """The last record of each key in a batch."""
    w = Window.partitionBy(*KEY).orderBy(F.col(order).desc_nulls_last(), F.xxhash64("content"))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_batch(spark: SparkSession, batch: DataFrame, store_path: str, number: int | None = None, stream: str = "") -> bool:
    """Upsert a batch into a published table; whether it wasn't part of it before.

    Only the partitions of the batch's corpora are written, beside the old ones; one record then makes all of them the table's, and
    names the batch, so that readers see a whole batch or none, and a batch that comes again after a failure, whenever
    that was, is taken once. Without a number a batch is taken each time, which leaves the same rows. Deletes need a whole corpus and
    aren't done here."""
    record = current(spark, store_path)
    if record and number is not None and record["batches"].get(stream, -1) >= number:
        return False
    new = stored(latest(batch))
    merged = new
    if record:
        corpora = new.select("corpus_id").distinct()
        old = read_published(spark, store_path, record)
        merged = upsert(old.join(F.broadcast(corpora), "corpus_id", "left_semi"), new)
    publish(merged, store_path, "corpus_id", base=record, batch=(stream, number) if number is not None else None)
    return True


def stream_sync(spark: SparkSession, source: str, store_path: str, checkpoint: str, schema: str = RECORDS, once: bool = True) -> StreamingQuery:
    """Start a stream that upserts the Parquet files arriving in `source`; once: what is there, then stop. The store is read
    by read_table(). The checkpoint's path names the stream in the store's records."""
    arriving = spark.readStream.schema(schema).parquet(source)
    writer = arriving.writeStream.foreachBatch(lambda df, n: merge_batch(df.sparkSession, df, store_path, n, checkpoint) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
