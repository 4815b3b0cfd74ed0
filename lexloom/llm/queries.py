"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, lines, packing, resampling, sentencepiece, simhash, suffixes, topk, toxicity, trie, weighted

try:
    import public_tokenizers

    _TOKENIZERS = os.path.dirname(public_tokenizers.path("x"))
except ImportError:
    _TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = os.environ.get("BYTE_BPE_FILE", os.path.join(_TOKENIZERS, "byte_bpe_50k.json"))
PIECES = os.environ.get("PIECE_MODEL_FILE", os.path.join(_TOKENIZERS, "piece_bpe_32k.model"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.conversation_digests(chat.format_turns(rows.unionByName(more), BYTE_BPE), BYTE_BPE).drop("n_tokens")


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(_table(spark, sf_dir, "documents"), PIECES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_report(trie.grafted(trie.sequences(_table(spark, sf_dir, "conversations"))))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_importance_resampling, op2_toxicity, op3_chat_format, op4_weighted_fingerprints, op5_topk_search, op6_sentencepiece, op7_line_dedup, op8_suffix_dedup, op9_simhash, op10_packing,
            op11_prefix_trie, op12_decontamination, op13_collocations,
        )
    }


OP3 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 sum(14 + length(role) + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) AS formatted_chars FROM c GROUP BY conv_id"""
OP5 = """WITH e AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
 SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s) WHERE rank <= 5"""
OP7 = """WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 m AS (SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS k, line FROM l WHERE trim(translate(line, concat(chr(9), chr(11), chr(12), chr(13)), '    ')) <> ''),
 d AS (SELECT doc_id, n, line, string_split(line, ' ') AS w FROM m WHERE k = 1 AND len(string_split(line, ' ')) >= 5), v AS (SELECT doc_id, n, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY md5(concat(len(w), '/', i, '/', array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' '))) ORDER BY doc_id, n) AS r FROM v),
 c AS (SELECT doc_id, n, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS line FROM v WHERE len(w) > 5), p AS (SELECT c.doc_id AS a, c.n AS b, d.doc_id AS x, d.n AS y FROM c JOIN d ON d.line = c.line),
 near AS (SELECT doc_id, n FROM o WHERE r > 1 UNION SELECT a, b FROM p WHERE (x, y) < (a, b) UNION SELECT x, y FROM p WHERE (a, b) < (x, y)),
 f AS (SELECT l.doc_id, l.n, l.line, coalesce(m.k > 1, false) AS ex, near.doc_id IS NOT NULL AS ne FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.n = l.n LEFT JOIN near ON near.doc_id = l.doc_id AND near.n = l.n)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (ex) AS n_exact, count(*) FILTER (ne) AS n_near, sha256(coalesce(string_agg(CASE WHEN NOT ex AND NOT ne THEN line END, chr(10) ORDER BY n), '')) AS kept_sha256 FROM f GROUP BY doc_id"""

OP11 = r"""WITH RECURSIVE z AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM z WHERE k < 8),
 crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS at_, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, s, at_ + 1, xor(z.v, crc.v // 256) FROM crc JOIN z ON z.k = 8 AND z.i = xor(crc.v, CAST(ord(s[at_ + 1]) AS BIGINT)) & 255 WHERE at_ < length(s)),
 h AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE at_ = length(s)),
 c AS (SELECT conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations),
 r AS (SELECT h.conv_id, 0 AS own, p, x, w FROM h JOIN c ON c.conv_id = h.conv_id - h.conv_id % 20 AND p <= h UNION ALL SELECT h.conv_id, 1, p, x, w FROM h JOIN c ON c.conv_id = h.conv_id AND p > h),
 t AS (SELECT conv_id, row_number() OVER o AS d, md5(string_agg(x, '') OVER o) AS key, w FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY own, p)),
 m AS (SELECT conv_id, d, key, w FROM t UNION ALL SELECT conv_id, 0, '', 0 FROM h), e AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id), q AS (SELECT m.*, u.key AS up FROM m LEFT JOIN m u ON u.conv_id = m.conv_id AND u.d = m.d - 1),
 n AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM q GROUP BY d, key), k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
 v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key), s AS (SELECT m.d, m.key, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.w) AS BIGINT) AS saved_tokens FROM v JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY ALL),
 f AS (SELECT m.d, m.key, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN e ON e.conv_id = m.conv_id AND e.d = m.d GROUP BY ALL)
 SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
 FROM v JOIN s ON s.d = v.d AND s.key = v.key LEFT JOIN f ON f.d = v.d AND f.key = v.key LEFT JOIN n u ON u.d = v.d - 1 AND u.key = v.up"""
OP12 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0), k AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, md5(array_to_string(w[i:i + 9], ' ')) AS key FROM s),
 p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k)), o AS (SELECT doc_id, i, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS key FROM p),
 f AS (SELECT doc_id, i, o.n, item_id FROM o JOIN k ON k.key = o.key AND k.n = o.n), h AS (SELECT doc_id, count(DISTINCT u) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS u FROM f) GROUP BY doc_id),
 g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
 SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""

OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)), f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1), d AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
 e AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN d ON d.lang = c.lang AND d.phrase = c.phrase WHERE longer IS NULL OR longer < a),
 s AS (SELECT e.lang, e.phrase, e.a, cut, x.a AS l, y.a AS r, n, CAST((1000 * CAST(e.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
 FROM e JOIN n ON n.lang = e.lang JOIN f x ON x.lang = e.lang AND x.phrase = array_to_string(e.w[1:cut], ' ') JOIN f y ON y.lang = e.lang AND y.phrase = array_to_string(e.w[cut + 1:], ' ')),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS t FROM s), t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b WHERE t = 1)
 SELECT * FROM t WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3, "op5_topk_search": OP5, "op7_line_dedup": OP7, "op11_prefix_trie": OP11, "op12_decontamination": OP12, "op13_collocations": OP13}
