"""Synchronising a chunk store with what a corpus build brings in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("corpus_id", "chunk_id")


def upsert(store: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The store with the incoming rows in place of those of the same keys."""
    return store.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def obsolete(store: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY, corpus: str = "corpus_id") -> DataFrame:
    """Stored keys that the incoming corpora no longer hold. Other corpora, and an empty input, lose nothing."""
    return store.select(*keys).join(incoming.select(corpus).distinct(), corpus, "left_semi").join(incoming.select(*keys), list(keys), "left_anti")


def change_log(store: DataFrame, incoming: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY, corpus: str = "corpus_id") -> DataFrame:
    """(keys, op): insert, update, keep, or delete of every row of the incoming corpora, which are named by people, and few.

    Rows are compared by a hash of their fields, so that wide columns stay out of the join."""
    side = lambda df, name: df.select(*keys, F.xxhash64(*[F.col(f) for f in fields]).alias(name))
    # the corpora that arrive are told by a broadcast, so that a bucketed store stays where it is
    mine = side(store.join(F.broadcast(incoming.select(corpus).distinct()), corpus, "left_semi"), "old")
    both = mine.join(side(incoming, "new"), list(keys), "full")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "keep").otherwise("update")
    return both.select(*keys, op.alias("op"))


def sync_corpus(store: DataFrame, incoming: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY, corpus: str = "corpus_id") -> tuple[DataFrame, DataFrame]:
    """(new store, change log). Doing it twice changes nothing more; other corpora stay as they are."""
    log = change_log(store, incoming, fields, keys, corpus)
    others = store.join(F.broadcast(incoming.select(corpus).distinct()), corpus, "left_anti")
    return others.unionByName(incoming, allowMissingColumns=True), log


def save_store(store: DataFrame, table: str, buckets: int, keys: Sequence[str] = KEY) -> None:
    """Write a store as a table of the catalog, bucketed and sorted by its keys: change_log() and upsert() against it then move
    what arrives, and never what is stored. Take about as many buckets as a shuffle has partitions."""
    store.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_touched(new_rows: DataFrame, path: str, corpus: str = "corpus_id") -> None:
    """Overwrite only the partitions of the corpora in `new_rows`, which must not be read from `path`."""
    new_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(corpus).parquet(path)
