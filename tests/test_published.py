"""Tables that change in one step, also when writers fail or meet."""

import pytest
from pyspark.sql import functions as F

from lexloom.sources import io, published
from lexloom.streaming import sync

ROWS = "corpus_id string, chunk_id string, content string"


def seen(spark, path):
    return sorted(map(tuple, io.read_table(spark, path).select("corpus_id", "chunk_id", "content").collect()))


def fails(df):
    return df.withColumn("content", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))


def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], ROWS)
    io.write_table(old, path, report=spark.createDataFrame([(2,)], "n int"))
    with pytest.raises(Exception, match="lost"):
        io.write_table(fails(old), path)
    assert seen(spark, path) == [("a", "1", "x"), ("b", "1", "y")] and io.read_report(spark, path).first().n == 2
    io.write_table(io.read_table(spark, path).where("corpus_id = 'b'"), path)  # from the table itself
    assert seen(spark, path) == [("b", "1", "y")] and io.read_report(spark, path) is None
    io.write_table(old.limit(0), path)
    assert seen(spark, path) == []
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "none"))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    first = published.publish(spark.createDataFrame([("a", "1", "x")], ROWS), path, "corpus_id")
    published.publish(spark.createDataFrame([("b", "1", "y")], ROWS), path, "corpus_id", base=first)
    with pytest.raises(published.Conflict):
        published.publish(spark.createDataFrame([("c", "1", "z")], ROWS), path, "corpus_id", base=first)
    with pytest.raises(published.Conflict):  # the number is taken between look and rename
        published._Folder(spark, path).put(f"commits/{2:020}.json", "{}")
    assert seen(spark, path) == [("a", "1", "x"), ("b", "1", "y")]


def test_a_batch_is_whole_or_absent_and_taken_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame([(c, i, "1", t, len(t), [1.0], "m", None) for c, i, t in rows], io.RECORDS)
    assert sync.merge_batch(spark, batch(("a", "1", "x"), ("b", "1", "y")), path, 0, "s")
    new = batch(("a", "1", "new"), ("b", "2", "z"), ("c", "1", "w"))
    # the files are there, the record isn't
    monkeypatch.setattr(published._Folder, "put", lambda self, name, text: (_ for _ in ()).throw(OSError("driver lost")))
    with pytest.raises(OSError, match="driver lost"):
        sync.merge_batch(spark, new, path, 1, "s")
    assert seen(spark, path) == [("a", "1", "x"), ("b", "1", "y")]
    monkeypatch.undo()
    assert sync.merge_batch(spark, new, path, 1, "s")  # replayed
    want = [("a", "1", "new"), ("b", "1", "y"), ("b", "2", "z"), ("c", "1", "w")]
    assert seen(spark, path) == want
    # replayed after its record, when later rows have come
    assert sync.merge_batch(spark, batch(("a", "1", "later")), path, 2, "s")
    assert not sync.merge_batch(spark, new, path, 1, "s") and not sync.merge_batch(spark, new, path, 2, "s")
    assert seen(spark, path) == [("a", "1", "later"), *want[1:]]
    assert sync.merge_batch(spark, batch(("a", "9", "other stream")), path, 0, "t")
    assert published.clean_up(spark, path, keep=1) >= 2 and len(seen(spark, path)) == 5


def test_results_are_compacted_by_size_and_found_without_a_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i}", i) for i in range(400)], "file_id string, score int")
    df.write.parquet(str(tmp_path / "results"))
    small = spark.read.parquet(str(tmp_path / "results"))
    assert 1 < io.compact(small, "compacted_a", file_bytes=3000) < 9
    assert io.compact(df, "compacted_b", buckets=8) == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("q7",), ("q9",)], "file_id string")
        joined = spark.table("compacted_b").join(asked, "file_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and sorted(r.score for r in joined.collect()) == [7, 9]
        assert spark.table("compacted_b").where("file_id = 'q7'").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE compacted_a")
        spark.sql("DROP TABLE compacted_b")
