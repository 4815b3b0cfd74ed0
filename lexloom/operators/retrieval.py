"""Ranking chunks for many questions: exact cosine, BM25, quotas, unions, rank fusion, rerank scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .bm25 import best_chunks

KEY = ("corpus_id", "chunk_id")
#: Rows of a block of vectors at most, bytes of it, and such blocks that a lot of chunks has at most.
BLOCK, TILE_BYTES, TILES = 16_384, 16_000_000, 64
#: Questions and chunks of one product, and rows that are handed on at once.
ASKED, PIECE, EMITTED = 1024, 2048, 50_000


def _ranked(df: DataFrame, by: Sequence[str], *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine of two arrays, in double precision; null for a zero vector. The plain form of vector_topk."""
    zero = F.lit(0.0)
    x, y = (F.transform(v, lambda t: t.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, t: s + t)
    norms = [F.sqrt(F.aggregate(F.transform(v, lambda t: t * t), zero, lambda s, t: s + t)) for v in (x, y)]
    return F.when((norms[0] > 0) & (norms[1] > 0), 1 - dot / (norms[0] * norms[1]))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows, without a Python object for each number."""
    flat = pc.list_flatten(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors)
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def _tiles(vectors: DataFrame) -> int:
    """Blocks that a table of vectors is dealt to."""
    rows, longest = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    return max(1, -(-rows // max(1, min(BLOCK, TILE_BYTES // (8 * max(longest or 1, 1))))))


def _best(state: tuple[np.ndarray, np.ndarray], rows: np.ndarray, d: np.ndarray, first: int) -> None:
    """Puts the columns of d, numbered from `first`, into the k nearest so far (distances, numbers) of `rows`. Earlier columns go first
    among equals; NaN is no distance."""
    far, which = state
    k = far.shape[1]
    edge = far[rows, -1]
    if np.isinf(edge).any():  # not k yet: of these columns none beyond their own k-th
        own = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(rows), np.inf)
        here = (d < edge[:, None]) & ~(d > own[:, None])
    else:
        here = d < edge[:, None]
    at, column = np.nonzero(here)
    if not len(at):
        return
    met, at = np.unique(at, return_inverse=True)
    mine = rows[met]
    of = np.concatenate([np.repeat(np.arange(len(met)), k), at])
    dist = np.concatenate([far[mine].ravel(), d[met[at], column]])
    number = np.concatenate([which[mine].ravel(), first + column])
    order = np.lexsort((dist, of))
    start = np.searchsorted(of[order], np.arange(len(met)))
    kept = order[start[:, None] + np.arange(k)]
    far[mine], which[mine] = dist[kept], number[kept]


class _Search:
    """The questions of one unit of work and the k nearest of the chunks that came so far."""

    def __init__(self, asked: pa.Table, k: int, by_corpus: bool):
        self.ids = asked.column("question_id").to_numpy()
        self.q = matrix(asked.column("vector"))
        self.norm = np.linalg.norm(self.q, axis=1)
        self.only = asked.column("corpora").to_pylist()
        own = asked.column("own").combine_chunks()
        self.owns = own.drop_null().unique()
        codes = pc.index_in(own, value_set=self.owns).fill_null(-1).to_numpy().astype(np.int64)
        self.by_own = np.argsort(codes, kind="stable")
        self.own_ends = np.searchsorted(codes[self.by_own], np.arange(len(self.owns) + 1))
        self.by_corpus = by_corpus
        self.state = np.full((len(self.ids), k), np.inf), np.zeros((len(self.ids), k), np.int64)
        self.names: list[pa.RecordBatch] = []
        self.seen = 0
        self.corpus: tuple = ()

    def take(self, chunks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunks of one corpus, in order of their ids; the results of the corpus before, if they are by corpus."""
        corpus = chunks.column("corpus_id")[0].as_py()
        if self.corpus != (corpus,):
            if self.by_corpus:
                yield from self.results()
            self.corpus = (corpus,)
            self.rows = np.array([i for i, c in enumerate(self.only) if (c is None or corpus in c) and self.norm[i] > 0], np.int64)
        if not len(self.rows):
            return
        x = matrix(chunks.column("vector"))
        size = np.linalg.norm(x, axis=1)
        x = np.concatenate([x, np.zeros((-len(x) % 64, x.shape[1]))])  # equal vectors get equal products wherever they stand
        own = pc.index_in(chunks.column("own"), value_set=self.owns)
        banned = [(j, self.by_own[self.own_ends[c] : self.own_ends[c + 1]]) for j, c in enumerate(own.to_pylist()) if c is not None]
        with np.errstate(invalid="ignore", divide="ignore"):
            for a in range(0, len(self.rows), ASKED):
                rows = self.rows[a : a + ASKED]
                q = np.concatenate([self.q[rows], np.zeros((-len(rows) % 64, self.q.shape[1]))])
                d = (q @ x.T)[: len(rows), : len(size)]
                d = 1 - d / (self.norm[rows][:, None] * size[None, :])
                for j, of in banned:
                    d[np.isin(rows, of), j] = np.nan
                _best(self.state, rows, d, self.seen)
        self.seen += len(size)
        self.names.append(chunks.select([*KEY]))

    def results(self) -> Iterator[pa.RecordBatch]:
        far, which = self.state
        if self.names:
            names = pa.Table.from_batches(self.names)
            step = max(1, EMITTED // far.shape[1])
            for a in range(0, len(far), step):
                row, place = np.nonzero(np.isfinite(far[a : a + step]))
                got = names.take(pa.array(which[a + row, place])).combine_chunks()
                found = [pa.array(self.ids[a + row]), *[got.column(c).combine_chunks() for c in KEY], pa.array(far[a + row, place])]
                yield pa.RecordBatch.from_arrays(found, names=["question_id", *KEY, "distance"])
        far[:] = np.inf
        self.names, self.seen = [], 0


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int, corpora: str | None = None, exclude: tuple[str, str] | None = None, by_corpus: bool = False) -> DataFrame:
    """(question_id, rank, corpus_id, chunk_id, distance): the k nearest chunks of each question; with
    `by_corpus` the k nearest of each corpus for each question, ranked within it.

    questions: question_id, vector and, if `corpora` names it, an array of the corpora to search (null:
    all). Ties go to smaller ids. Zero vectors have no distance and don't rank. `exclude`: columns of
    questions and chunks whose equal values don't pair.

    Questions are dealt to blocks of about TILE_BYTES of vectors, whatever their dimensions, and BLOCK rows, chunks to lots of up to TILES such
    blocks. A block of questions and a lot are one unit of work, a task of its own: the lot streams by in order of its ids, and the task keeps k rows a
    question (of one corpus at a time with `by_corpus`). Nothing is broadcast."""
    n_tiles, q_blocks = _tiles(chunks), _tiles(questions)
    cores = questions.sparkSession.sparkContext.defaultParallelism
    lots = max(-(-n_tiles // TILES), min(n_tiles, -(-2 * cores // q_blocks)))
    deal = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    far = F.lit(None).cast("string")
    kind = "array<float>" if dict(questions.dtypes)["vector"] == dict(chunks.dtypes)["vector"] == "array<float>" else "array<double>"
    rows = chunks.select(
        deal(KEY, lots).alias("lot"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("block"), F.lit(None).cast("long").alias("question_id"), "corpus_id", "chunk_id", F.col("vector").cast(kind).alias("vector"), F.lit(None).cast("array<string>").alias("corpora"), (F.col(exclude[1]).cast("string") if exclude else far).alias("own"), F.lit(1).alias("kind")
    )
    asked = questions.where("question_id IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), deal(["question_id"], q_blocks).alias("block"), F.col("question_id").cast("long").alias("question_id"), far.alias("corpus_id"), far.alias("chunk_id"), F.col("vector").cast(kind).alias("vector"), (F.col(corpora) if corpora else F.lit(None).cast("array<string>")).alias("corpora"), (F.col(exclude[0]).cast("string") if exclude else far).alias("own"), F.lit(0).alias("kind")
    )

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[pa.RecordBatch] = []
        search = None
        for batch in it:
            is_q = batch.column("kind").to_numpy() == 0
            n_q = int(is_q.sum())  # questions come first
            if n_q:
                ahead.append(batch.slice(0, n_q))
            chunks = batch.slice(n_q)
            if not chunks.num_rows or not ahead:
                continue
            search = search or _Search(pa.Table.from_batches(ahead), k, by_corpus)
            corpus = chunks.column("corpus_id").dictionary_encode().indices.fill_null(-1).to_numpy()
            most = max(1, min(PIECE, TILE_BYTES // (8 * max(1, search.q.shape[1]))))
            ends = [0, *(np.flatnonzero(corpus[1:] != corpus[:-1]) + 1), len(corpus)]
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                for first in range(a, z, most):
                    yield from search.take(chunks.slice(first, min(most, z - first)))
        if search:
            yield from search.results()

    units = rows.unionByName(asked).repartitionById(lots * q_blocks, F.col("lot") * q_blocks + F.col("block"))
    found = units.sortWithinPartitions("kind", *KEY).mapInArrow(nearest, "question_id long, corpus_id string, chunk_id string, distance double")
    return _ranked(found, ["question_id", "corpus_id"] if by_corpus else ["question_id"], "distance", *KEY).where(F.col("rank") <= k).select("question_id", "rank", *KEY, "distance")


def quota_topk(candidates: DataFrame, routed: DataFrame, k: int, dedup_key: Sequence[str] = KEY) -> DataFrame:
    """Per question ceil(k / corpora) candidates of each routed corpus, merged, deduped, cut to k by distance.

    candidates: question_id, corpus_id, chunk_id, distance, the k nearest or more of each corpus
    (vector_topk with by_corpus); routed: question_id, corpora in order. With
    dedup_key chunk_id alone, the corpus that comes first in the routing wins over the nearer one."""
    one = routed.select("question_id", F.size("corpora").alias("n"), F.posexplode("corpora").alias("place", "corpus_id"))
    found = _ranked(candidates.join(one, ["question_id", "corpus_id"]), ["question_id", "corpus_id"], "distance", "chunk_id").where(F.col("rank") <= F.ceil(F.lit(k) / F.col("n")))
    first = _ranked(found, ["question_id", *dedup_key], "place", "distance").where("rank = 1")
    return _ranked(first, ["question_id"], "distance", *KEY).where(F.col("rank") <= k).select("question_id", "rank", *KEY, "distance")


def replay_depths(deep: DataFrame, routed: DataFrame, ks: Sequence[int] = (20, 30, 40, 50)) -> DataFrame:
    """(question_id, strategy, k, rank, corpus_id, chunk_id, distance): both strategies at every depth.

    deep: a ranking by distance of each question within each corpus, at least as deep as the largest k. Places among all, and
    within a corpus, are the same at every depth, so that rows are given out by depth only where a place is within it."""
    deep = stored(deep)
    depths = deep.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    most = max(int(k) for k in ks)
    one = routed.select("question_id", F.size("corpora").alias("n"), F.explode("corpora").alias("corpus_id"))
    by = ["question_id", "k"]
    whole = _ranked(deep, ["question_id"], "distance", *KEY).where(F.col("rank") <= most)
    whole = whole.crossJoin(F.broadcast(depths)).where("rank <= k").withColumn("strategy", F.lit("global"))  # the depths are a parameter
    inside = _ranked(deep.join(one, ["question_id", "corpus_id"]), ["question_id", "corpus_id"], "distance", "chunk_id").where(F.col("rank") <= F.ceil(F.lit(most) / F.col("n")))
    inside = inside.crossJoin(F.broadcast(depths)).where("rank <= ceil(k / n)")
    quota = _ranked(inside, by, "distance", *KEY).where("rank <= k").withColumn("strategy", F.lit("quota"))
    columns = ["question_id", "strategy", "k", "rank", *KEY, "distance"]
    return whole.select(columns).unionByName(quota.select(columns))


# --- BM25


def bm25_index(chunks: DataFrame, tokens: str = "tokens") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, df, stats): term counts and lengths, document counts of terms, sizes of corpora.

    Texts are cut into tokens once, for the postings, which are stored; all else comes from them. A chunk without
    tokens counts as one of its corpus."""
    sized = chunks.select("corpus_id", "chunk_id", F.size(tokens).alias("len"), tokens)
    postings = stored(sized.select(*KEY, "len", F.explode(tokens).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    df = postings.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    length = postings.groupBy("corpus_id").agg(F.sum("tf").alias("length"))
    stats = chunks.groupBy("corpus_id").agg(F.count("*").alias("docs")).join(length, "corpus_id", "left")
    return postings, df, stats.select("corpus_id", "docs", (F.coalesce("length", F.lit(0)) / F.col("docs")).alias("avg_len"))


def bm25_topk(blocks: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """The k best chunks of each question; distance is the negated score, rounded; ties go to smaller ids.

    blocks: from bm25_blocks(); queries: question_id, tokens and, optionally, corpora to search (null: all)."""
    return _ranked(best_chunks(blocks, queries, k, **options), ["question_id"], "distance", *KEY).where(F.col("rank") <= k).select("question_id", "rank", *KEY, "distance")


def bm25_quota(blocks: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Per question the best ceil(k / corpora) chunks of each of its corpora by words, merged and cut to k; questions without
    corpora have none. queries: question_id, tokens, corpora."""
    asked = queries.where("size(corpora) > 0")
    return quota_topk(best_chunks(blocks, asked, k, by_corpus=True, **options), asked.select("question_id", "corpora"), k)


# --- combining lists


def hybrid_union(vector: DataFrame, bm25: DataFrame, depth: int = 50, dedup_key: Sequence[str] = KEY, routed: DataFrame | None = None) -> DataFrame:
    """Vector hits in their order, then the BM25 hits that they don't have; BM25 only for routed questions."""
    if routed is not None:
        bm25 = bm25.join(routed.where(F.size("corpora") > 0).select("question_id"), "question_id", "left_semi")
    both = vector.where(F.col("rank") <= depth).withColumn("source", F.lit(0)).unionByName(bm25.where(F.col("rank") <= depth).withColumn("source", F.lit(1)))
    both = both.withColumnRenamed("rank", "old")
    first = _ranked(both, ["question_id", *dedup_key], "source", "old").where("rank = 1").drop("rank")
    return _ranked(first, ["question_id"], "source", "old", *KEY).select("question_id", "rank", *KEY, "distance", F.when(F.col("source") == 0, "vector").otherwise("bm25").alias("source"))


def rrf(rankings: DataFrame, k: int = 60, top: int | None = None, dedup_key: Sequence[str] = KEY) -> DataFrame:
    """Reciprocal rank fusion of all lists of a question: the sum of 1 / (k + rank); ties to smaller ids."""
    fused = rankings.groupBy("question_id", *dedup_key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))
    out = _ranked(fused, ["question_id"], F.desc(F.round("rrf", 12)), *dedup_key)
    return out if top is None else out.where(F.col("rank") <= top)


def rank_chunks(rows: DataFrame) -> DataFrame:
    """Stored ranks first, then rows without one by distance; stored ranks stay."""
    new = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("rank").asc_nulls_last(), "distance", *KEY))
    return rows.withColumn("position", new).withColumn("rank", F.coalesce("rank", "position")).drop("position")


def apply_rerank(candidates: DataFrame, scores: DataFrame, n: int = 5, strict: bool = True) -> DataFrame:
    """The n best candidates of each question by rerank score, with status `reranked`; the first n in their
    order, without scores, with status `fallback` if a question has no scores or (strict) fewer than n candidates."""
    w = Window.partitionBy("question_id")
    both = candidates.join(scores.select("question_id", *KEY, "rerank_score"), ["question_id", *KEY], "left")
    both = both.withColumn("scored", F.count("rerank_score").over(w)).withColumn("of", F.count(F.lit(1)).over(w))
    fallback = (F.col("scored") == 0) | ((F.col("of") < n) if strict else F.lit(False))
    both = both.withColumn("status", F.when(fallback, "fallback").otherwise("reranked")).withColumn("rerank_score", F.when(~fallback, F.col("rerank_score")))
    both = both.where((F.col("status") == "fallback") | F.col("rerank_score").isNotNull()).withColumnRenamed("rank", "old")
    return _ranked(both, ["question_id"], F.col("rerank_score").desc_nulls_last(), "old", *KEY).where(F.col("rank") <= n).select("question_id", "rank", *KEY, "rerank_score", "status")


def unknown_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores for chunks that no candidate list holds."""
    return scores.join(candidates, ["question_id", *KEY], "left_anti")


def neighbor_window(rankings: DataFrame, gold_ranks: DataFrame, before: int = 5, after: int = 5) -> DataFrame:
    """Rows of a corpus' list at most `before` above and `after` below the rank of a gold article in it.

    A range join on an equal key; the side of gold ranks is exploded to the ranks that it wants, so that
    the join is by equality alone."""
    wanted = gold_ranks.where("first_rank IS NOT NULL").select("question_id", "corpus_id", F.col("article_number").alias("gold_article"), "first_rank", F.explode(F.sequence(F.greatest(F.col("first_rank") - before, F.lit(1)), F.col("first_rank") + after)).alias("rank"))
    return rankings.join(wanted, ["question_id", "corpus_id", "rank"]).withColumn("offset", F.col("rank") - F.col("first_rank"))
