"""Small fixtures for operators whose inputs aren't in the driver's tables, and properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import chunking, context, curate, metrics, model_calls, quality, reports, retrieval, store, structure
from lexloom.operators.components import connected_components
from lexloom.sources import io
from lexloom.streaming import sync


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# --- text


def test_cleaning(spark):
    page = "Titre\f a  \nCode pénal - Dernière modification le 1 mai 2024 - Document généré le 3 juin 2024\nsui-\nvant  é\n"
    df = spark.createDataFrame([(page, "Code pénal")], "text string, name string")
    got = df.select(text.clean_page_text("text", text.footer_regex("name")).alias("t")).first().t
    assert got == "Titre\n a\nsuivant  é\n"
    assert df.select(text.has_footer_pollution("text").alias("p")).first().p


def test_article_ids(spark):
    cases = [("Article 111-1", "111-1"), ("Article R*12-3", "R*12-3"), ("Article 224-1 A", "224-1-A"), ("Article liminaire", "liminaire"), ("Article Annexe à l'article R. 12-3", "annexe-R12-3"), ("Article Annexe IV", "Annexe IV"), ("Article L. 410-1 l'ordonnance n° 1", None), ("Livre II", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "line string")
    m = df.withColumn("m", text.match_article_line("line", strict=False)).select("line", text.normalize_article_id("m.raw_number", "m.kind").alias("id"))
    assert {r.line: r.id for r in m.collect()} == {a: b for a, b in cases}


def test_routing_and_scores(spark):
    df = spark.createDataFrame([(["a", "b"], None), ([], None), (["a"], []), (["a"], ["z", "z"])], "p array<string>, e array<string>")
    got = [r.r for r in df.select(text.routing_decision("p", "e").alias("r")).collect()]
    assert [(r.decision, r.corpora) for r in got] == [("routed", ["a", "b"]), ("abstain", []), ("global", []), ("routed", ["z"])]
    s = spark.createDataFrame([(0.4, 1.0), (-1.0, -1.0), (-2.0, -1.0)], "s double, b double").select(text.relative_score("s", "b").alias("r"))
    assert [r.r for r in s.collect()] == [0.4, 1.0, 0.0]


# --- structure


def test_parse_articles(spark):
    page1 = "Livre I\nArticle 1-1\nfirst\n\nmore\nTitre II\nlost\nArticle 1-1\nagain"
    page2 = "Article 1-1\nthird\nArticle 1-1\nfourth\nArticle 2-1\n\nArticle 3-1\nSection 4 x\nLivre II\nArticle 4-1\nlast"
    pages = spark.createDataFrame([("c", 1, page1), ("c", 2, page2)], io.PAGES)
    a = structure.parse_articles(structure.page_lines(pages))
    got = {r.article_number: r for r in a.collect()}
    assert set(got) == {"1-1", "1-1@p1@o2", "1-1@p2", "1-1@p2@o4", "2-1", "3-1", "4-1"}
    assert got["1-1"].content == "first\n\nmore" and got["1-1"].livre == "Livre I" and got["1-1"].titre is None
    assert got["4-1"].livre == "Livre II" and got["4-1"].titre == "Titre II" and got["4-1"].section == "Section 4 x"
    assert got["2-1"].dropped == got["3-1"].dropped == "empty"


# --- chunks

_pieces = st.lists(st.sampled_from(["Un mot. ", "fin;\n", "\n\n", "a) point ", "1° item\n", "mot " * 30, "x" * 90, "Et. Puis! "]), max_size=25)


@settings(max_examples=150, deadline=None)
@given(_pieces, st.sampled_from([40, 120, 500]))
def test_chunks_keep_the_text_within_bounds(pieces, most):
    content = "".join(pieces)
    chunks = chunking.chunks_of(content, most)
    if len(content) <= most:
        assert chunks[0][0] == content and len(chunks) == 1
    else:
        assert all(0 < len(c[0]) <= most for c in chunks)
        assert "".join("".join(c[0] for c in chunks).split()) == "".join(content.split())


def test_units():
    assert chunking.units_of("Fin.\nSuite\nde ligne\n1° un\na) b\n\nIV.- c") == ["Fin.", "Suite de ligne", "1° un", "a) b", "IV.- c"]
    assert chunking.parts_of("Aa bb. Cc dd. Ee", 8) == (["Aa bb.", "Cc dd.", "Ee"], "sentence")
    assert chunking.parts_of("aaaa bbbb cccc", 9) == (["aaaa bbbb", "cccc"], "hard")
    assert chunking.parts_of("Aa bb. Cc IV.- dd.", 8)[0] == ["Aa bb.", "- dd."]  # a mark inside a word ends no sentence


# --- retrieval

RANK = "question_id long, rank int, corpus_id string, chunk_id string, distance double"


def test_union_fusion_and_collisions(spark):
    v = spark.createDataFrame([(1, 1, "a", "x", 0.1), (1, 2, "a", "y", 0.2)], RANK)
    b = spark.createDataFrame([(1, 1, "b", "x", -3.0), (1, 2, "a", "y", -2.0), (1, 3, "a", "z", -1.0)], RANK)
    assert rows(retrieval.hybrid_union(v, b), "rank", "corpus_id", "chunk_id") == [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "a", "z")]
    assert rows(retrieval.hybrid_union(v, b, dedup_key=("chunk_id",)), "rank", "chunk_id") == [(1, "x"), (2, "y"), (3, "z")]
    f = retrieval.rrf(v.unionByName(b), dedup_key=("chunk_id",)).collect()
    assert {r.chunk_id: round(r.rrf, 9) for r in f} == {"x": round(2 / 61, 9), "y": round(2 / 62, 9), "z": round(1 / 63, 9)}


def test_quota(spark):
    c = spark.createDataFrame([(1, 0, k, f"{k}{i}", i / 10 + (k == "b")) for k in "ab" for i in range(12)], RANK)
    got = retrieval.quota_topk(c, spark.createDataFrame([(1, ["a", "b", "zz"])], "question_id long, corpora array<string>"), 20)
    assert len(got.collect()) == 14 and got.where("corpus_id = 'a'").count() == 7


def test_rerank_fallback_collapses_context(spark):
    c = spark.createDataFrame([(1, i, "a", f"x{i}", 0.1) for i in range(1, 7)] + [(2, 1, "a", "x", 0.1)] + [(3, i, "ab"[i % 2], f"x{i}", 0.1) for i in range(1, 7)], RANK)
    s = spark.createDataFrame([(3, "ab"[i % 2], f"x{i}", [0, 1.0, 0.1, 0.5, 0.2, 0.9, 0.0][i]) for i in range(1, 7)] + [(2, "a", "x", 1.0)], "question_id long, corpus_id string, chunk_id string, rerank_score double")
    r = retrieval.apply_rerank(c, s)
    assert {(x.question_id, x.status) for x in r.collect()} == {(1, "fallback"), (2, "fallback"), (3, "reranked")}
    routed = r.withColumn("routed", F.array(F.lit("a"), F.lit("b")))
    kept = context.context_filter(routed)
    assert rows(kept.where("question_id <> 3"), "question_id", "chunk_id") == [(1, "x1"), (2, "x")]
    # best 1.0 (b), 0.9 and 0.5 stay; corpus a, whose best is 0.2, gets its one
    assert rows(kept.where("question_id = 3"), "rank", "chunk_id") == [(1, "x1"), (2, "x5"), (3, "x3"), (4, "x4")]
    assert retrieval.unknown_scores(c, s).count() == 0


def test_filter_at_threshold_and_no_positive_score(spark):
    schema = "question_id long, rank int, corpus_id string, chunk_id string, rerank_score double"
    r = spark.createDataFrame([(1, 1, "a", "x", 1.0), (1, 2, "a", "y", 0.4), (1, 3, "a", "z", 0.39), (2, 1, "a", "x", 0.0), (2, 2, "a", "y", 0.0), (3, 1, "a", "x", None), (3, 2, "a", "y", 0.7)], schema)
    assert rows(context.context_filter(r, min_one=False), "question_id", "chunk_id") == [(1, "x"), (1, "y"), (2, "x"), (3, "x")]


def test_context_reads_back(spark):
    kept = spark.createDataFrame([(1, 1, "a", "1#0", "1", 0, "one\n\ntwo"), (1, 2, "b", "2#1", "2", 1, "three")], "question_id long, rank int, corpus_id string, chunk_id string, article_number string, chunk_index int, content string")
    got = text.parse_context(context.build_context(kept), "context", ("question_id",))
    assert rows(got, "source_id", "code_name", "article_number", "chunk_index", "content") == [(1, "a", "1", 0, "one\n\ntwo"), (2, "b", "2", 1, "three")]


# --- metrics and reports


def test_two_recalls_and_two_mrrs(spark):
    r = spark.createDataFrame([(1, "v", i + 1, "c", f"{a}#{i}", a) for i, a in enumerate(["x", "x", "g", "h"])], "question_id long, variant string, rank int, corpus_id string, chunk_id string, article_number string")
    gold = spark.createDataFrame([(1, "c", "g"), (1, "c", "nope")], "question_id long, corpus_id string, article_number string")
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    a = {x.question_id: x for x in metrics.recall_any(r, q, gold, (1, 2)).collect()}
    assert (a[1].recall_1, a[1].recall_2, a[1].mrr, a[2].recall_2, a[2].mrr) == (0, 1, 0.5, 0, 0.0)
    s = metrics.retrieval_snapshot(r, gold, (2, 3)).first()
    assert (s.recall_2, s.recall_3, round(s.mrr, 6)) == (0.0, 0.5, 0.333333)


def test_routing_scores(spark):
    df = spark.createDataFrame([(["code-penal"], []), ([], []), (["a", "b"], ["b", "a"]), (["a", "b"], ["a", "c"])], "gold_corpus_ids array<string>, predicted_corpus_ids array<string>")
    got = [(r.exact, r.precision, r.recall, r.f1) for r in reports.routing_scores(df).collect()]
    assert got == [(False, 0, 0, 0), (True, 1, 1, 1), (True, 1, 1, 1), (False, 0.5, 0.5, 0.5)]


def test_percentiles(spark):
    df = spark.createDataFrame([("c", str(i), i) for i in (1, 2, 3, 4)], "corpus_id string, chunk_id string, tokens int")
    one = chunking.token_distribution(df).where("corpus_id = 'c'").first()
    assert (one.p50, one.p95) == (2.5, 3.85)
    ms = df.select(F.lit("s").alias("stage"), F.col("tokens").cast("double").alias("ms"))
    assert reports.latency_stats(ms).first().p50_ms == 2


# --- quality and store


def test_checks(spark):
    c = spark.createDataFrame([("a", "1#0", "1", "x", 1), ("a", "1#0", "1", " ", 2), ("b", "1#0", "1", "yy", 2)], io.CHUNKS)
    v = quality.check_chunks(c)
    assert rows(v, "check") == [("blank_content",), ("char_count",), ("duplicate_chunk",)]
    with pytest.raises(quality.CheckFailed):
        quality.fail_on_violations(v)
    quality.fail_on_violations(v.limit(0))
    q = spark.createDataFrame([("q001", "w", ["a"], [("a", "1")], "r", "easy", "single-corpus", [("a", "2")], "w"), ("x", "", ["a", "z"], [("a", "1")], "", "easy", "single-corpus", None, "")], io.QUESTIONS + ", normalized string")
    assert {r.detail for r in quality.check_questions(q, ["a"]).where("check = 'question'").collect()} == {"bad_id", "blank_question", "blank_answer", "type_vs_gold", "unknown_corpus", "corpora_vs_articles"}
    found = quality.check_gold(q, spark.createDataFrame([("a", "1")], "corpus_id string, article_number string"))
    assert rows(found, "check") == [("gold_not_in_sources",), ("missing_source_articles",)]
    n = spark.createDataFrame([("type", "x", 3)], "dimension string, value string, n long")
    want = spark.createDataFrame([("type", "x", 4), ("type", "y", 1)], "dimension string, value string, quota long")
    assert rows(quality.check_distribution(n, want), "key", "detail") == [("type/x", "3 of 4"), ("type/y", "0 of 1")]
    res = spark.createDataFrame([("q1", "a", "ok", 0), ("q1", " ", "abstained", 2)], "question_id string, answer string, status string, calls int")
    exp = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    assert rows(quality.check_results(res, exp), "check") == [("abstained_with_calls",), ("duplicate_result",), ("empty_field",), ("missing_result",)]


def test_sync_twice_is_sync_once(spark):
    s = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")], "corpus_id string, chunk_id string, content string")
    new = spark.createDataFrame([("a", "1", "x"), ("a", "3", "w")], "corpus_id string, chunk_id string, content string")
    once, log = store.sync_corpus(s, new, ["content"])
    assert rows(log, "chunk_id", "op") == [("1", "keep"), ("2", "delete"), ("3", "insert")]
    twice, log = store.sync_corpus(once, new, ["content"])
    assert rows(twice, "corpus_id", "chunk_id") == rows(once, "corpus_id", "chunk_id") == [("a", "1"), ("a", "3"), ("b", "1")]
    assert {r.op for r in log.collect()} == {"keep"} and store.obsolete(s, new.limit(0)).count() == 0


def test_stream_sync(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    rec = lambda c, i, t: (c, i, "1", t, len(t), [1.0], "m", None)
    spark.createDataFrame([rec("a", "1", "x"), rec("b", "1", "y")], io.RECORDS).write.mode("append").parquet(src)
    sync.stream_sync(spark, src, out, ck).awaitTermination()
    spark.createDataFrame([rec("a", "1", "new"), rec("a", "2", "z")], io.RECORDS).write.mode("append").parquet(src)
    sync.stream_sync(spark, src, out, ck).awaitTermination()
    want = [("a", "1", "new"), ("a", "2", "z"), ("b", "1", "y")]
    assert rows(io.read_table(spark, out), "corpus_id", "chunk_id", "content") == want
    sync.merge_batch(spark, spark.read.schema(io.RECORDS).parquet(src).where("content <> 'x'"), out)
    assert rows(io.read_table(spark, out), "corpus_id", "chunk_id", "content") == want


# --- sources


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"n": 1, "chunks": [{"corpus_id": "a", "chunk_id": "1#0", "content": "x"}]}, indent=1))
    assert rows(io.read_result(spark, str(tmp_path / "r.json"), "chunks", io.CHUNKS), "chunk_id", "content") == [("1#0", "x")]
    (tmp_path / "v.json").write_text(json.dumps({"q1": [1, 2], "q2": [3, 4]}))
    assert rows(io.read_vector_cache(spark, str(tmp_path / "v.json")), "question_id") == [("q1",), ("q2",)]
    good = {"question_id": "q1", "question": "w", "gold_corpus_ids": ["a"], "gold_articles": [{"corpus_id": "a", "article_number": "1"}], "reference_answer": "r", "difficulty": "easy", "question_type": "single-corpus"}
    (tmp_path / "q.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"difficulty": "no"}), json.dumps(good | {"gold_articles": [{"corpus_id": "a"}]})]))
    ok, bad = io.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert rows(ok, "question_id") == [("q1",)] and rows(bad, "reason") == [("bad_difficulty",), ("bad_gold",), ("invalid_json",)]
    d = tmp_path / "cache/run1/routing"
    d.mkdir(parents=True)
    (d / "q7.json").write_text('{"score": 3}')
    got = io.read_result_cache(spark, str(tmp_path / "cache"), "routing", "score int")
    assert rows(got, "run_id", "file_id", "score") == [("run1", "q7", 3)]
    io.write_table(spark.createDataFrame([("a", 1, "t")], io.PAGES), str(tmp_path / "t"), report=spark.range(1))
    assert io.read_table(spark, str(tmp_path / "t")).count() == 1 and io.read_report(spark, str(tmp_path / "t")).count() == 1


# --- curation


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (None, 1)], "a long, b long")
    got = dict(rows(connected_components(e), "node", "component"))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_difficulty_fills_quotas(spark):
    q = spark.createDataFrame([(i, s) for i, s in enumerate([0, 1, 1, 2, 3, 3, 4, 5, 5, 5])], "question_id long, score int")
    got = curate.assign_difficulty(q, {"easy": 2, "medium": 5, "hard": 3})
    assert {r.difficulty: r["count"] for r in got.groupBy("difficulty").count().collect()} == {"easy": 2, "medium": 5, "hard": 3}
    assert rows(got.where("difficulty = 'easy'"), "question_id") == [(0,), (1,)]


def difficulty_by_loop(questions, easy, medium, hard):
    """The rule, one question after another."""
    out, order = {}, sorted(questions, key=lambda q: (q[1], q[0]))
    for i, s in order:
        if s <= 1 and easy > 0:
            out[i], easy = "easy", easy - 1
        elif s >= 4 and hard > 0:
            out[i], hard = "hard", hard - 1
    left = {"easy": easy, "medium": medium, "hard": hard}
    for low in (True, False):
        for i, s in order:
            if i not in out and (s < 4) == low:
                out[i] = next((k for k in (("medium", "hard", "easy") if low else ("hard", "medium", "easy")) if left[k] > 0), "easy")
                left[out[i]] -= 1
    return out


@pytest.mark.parametrize("quotas", [(30, 60, 30), (5, 100, 15), (80, 20, 20), (0, 0, 120)])
def test_difficulty_as_a_loop_over_many_ties(spark, quotas):
    q = [(i, (i * 7) % 11 % 6) for i in range(120)]
    got = curate.assign_difficulty(spark.createDataFrame(q, "question_id long, score int"), dict(zip(("easy", "medium", "hard"), quotas, strict=True)))
    assert dict(rows(got, "question_id", "difficulty")) == difficulty_by_loop(q, *quotas)


def test_cohort_is_filled_up(spark):
    r = [(i, "abcx"[i % 4] if i % 9 else None) for i in range(80)]
    for caps, n in (({"a": 3, "b": 50}, 20), ({"a": 1, "b": 1, "c": 1}, 60), ({}, 200)):
        seen, want = {}, []
        for i, k in r:
            seen[k] = seen.get(k, 0) + 1
            rank = "abc".index(k) if k in list("abc") else 3
            want.append((seen[k] > (caps.get(k, n) if rank < 3 else 0), rank, i))
        got = curate.select_cohort(spark.createDataFrame(r, "question_id long, class string"), list("abc"), caps, n)
        assert [x.question_id for x in got.collect()] == [i for _, _, i in sorted(want)[:n]]


def test_chunking_stats(spark):
    of = [("a", "1", 50, None), ("a", "2", 100, "sentence"), ("a", "2", 121, "hard"), ("a", "3", 9, None), ("b", "1", 100, None)]
    got = chunking.chunking_stats(spark.createDataFrame(of, "corpus_id string, article_number string, char_count int, split_level string"), 100)
    assert rows(got, *got.columns) == [("a", 2, 1, 4, 121, 70.0, 1, 1, 1), ("b", 1, 0, 1, 100, 100.0, 0, 0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n.", min_size=1, max_size=80), st.integers(2, 12))
def test_hard_cuts(content, most):
    parts = chunking._hard(content, most)
    assert "".join("".join(parts).split()) == "".join(content.split())
    assert all(0 < len(p) <= most and p == p.strip() for p in parts)


def test_articles_across_ranges(spark):
    lines = [("c", p, i, f"Article {p}-{i}" if (p * 5 + i) % 7 == 2 else f"Titre {p}" if p % 20 == 3 and i == 0 else f"t {p} {i}") for p in range(60) for i in range(5)]
    lines += [(None, 0, 0, "lost"), (None, 0, 1, "Article 9-9"), (None, 0, 2, "kept")]
    want, titre, current = [], None, None
    for c, _, _, x in lines:
        if c is None and x == "lost":
            titre = current = None
        elif x.startswith("Article"):
            current = [c, x[8:], titre, []]
            want.append(current)
        elif x.startswith("Titre"):
            titre, current = x, None
        elif current:
            current[3].append(x)
    got = structure.parse_articles(spark.createDataFrame(lines, "corpus_id string, page_no int, pos int, line string").repartition(7))
    assert {(r.corpus_id, r.article_number, r.titre, r.content) for r in got.collect()} == {(c, n, h, "\n".join(b)) for c, n, h, b in want}


def test_models(spark):
    c = spark.createDataFrame([(i, f"word{i} word") for i in range(10)], "i int, content string")
    got = model_calls.embed_chunks(c, model_calls.hash_embedder(4), batch=3)
    assert {r.i: list(r.embedding) for r in got.collect()} == {i: v for i, v in enumerate(model_calls.hash_embedder(4)([f"word{i} word" for i in range(10)]))}
    scored = model_calls.score_pairs(c.withColumn("question", F.lit("word")), lambda pairs: [float(len(b)) for _, b in pairs])
    assert {r.rerank_score for r in scored.collect()} == {10.0}
