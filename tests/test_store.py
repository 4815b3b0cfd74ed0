"""Synchronising with a bucketed store moves what arrives alone."""

import re

from lexloom.operators import store

ROWS = "corpus_id string, chunk_id string, content string"


def exchanges_over(plan, table):
    """How many hash exchanges lie between the scan of a table and the root of a plan."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if table in x and "Scan" in x)
    depth, n = len(re.match(r"[\s:|+*()\d-]*", lines[at]).group()), 0
    for x in reversed(lines[:at]):
        d = len(re.match(r"[\s:|+*()\d-]*", x).group())
        if d < depth:
            depth = d
            n += "Exchange hashpartitioning" in x
    return n


def test_a_sync_does_not_move_the_store(spark):
    old = spark.createDataFrame([(c, str(i), f"text {i}") for c in "ab" for i in range(200)], ROWS)
    new = spark.createDataFrame([("a", str(i), f"text {i if i % 7 else -i}") for i in range(20, 230)], ROWS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.save_store(old, "kept_store", 4)
        kept = spark.table("kept_store")
        log = store.change_log(kept, new, ["content"])
        plan = log._jdf.queryExecution().executedPlan().toString()
        assert exchanges_over(plan, "kept_store") == 0 and "Exchange hashpartitioning" in plan
        merged = store.upsert(kept, new)
        assert exchanges_over(merged._jdf.queryExecution().executedPlan().toString(), "kept_store") == 0
        count = {r.op: r["count"] for r in log.groupBy("op").count().collect()}
        plain = {r.op: r["count"] for r in store.change_log(old, new, ["content"]).groupBy("op").count().collect()}
        assert count == plain == {"delete": 20, "insert": 30, "update": 26, "keep": 154}
        assert merged.count() == 430
        assert store.sync_corpus(kept, new, ["content"])[0].count() == 200 + 210
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS kept_store")
