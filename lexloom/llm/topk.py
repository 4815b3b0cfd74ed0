"""Exact top-k inner products through a pivot-distance index.

Vectors are kept by their nearest pivot and the distance to it. For a query q at distance D from a
pivot, a vector at distance r from it is at least |D - r| from q, so that its inner product is at
most (|q|^2 + |v|^2 - (D - r)^2) / 2. Annuli, ranges of r, whose bound is below the k-th best score
that a query has already seen hold nothing for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import use_checkpoints

#: Rows that one unit of work holds at most, about; queries that are scored together.
CHUNK, QUERIES = 8192, 1024
#: Queries that a unit of work gets at most, about; beyond, rows are copied to several units.
BLOCK = 32_768


def integers(vectors: list, scale: float = 256.0) -> np.ndarray:
    """floor(scale * component) of equally long vectors."""
    return np.floor(np.asarray(vectors, np.float64) * scale)


def usable(column: str) -> F.Column:
    """Whether a vector is there and has finite components only."""
    return F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Far-apart rows of the sample: each next one is the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    cell = squares.argmin(1)
    return cell, np.sqrt(np.maximum(squares[np.arange(len(x)), cell], 0))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; floating-point ones are exact while sums stay below 2**53."""
    top = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if top < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query, the places of its k best rows: high scores first, ties to smaller ids. `ids` ascend."""
    for i in range(len(scores)):
        row = scores[i]
        on = np.flatnonzero(ids != own[i])
        if len(on) > k:
            edge = np.partition(row[on], len(on) - k)[len(on) - k]
            on = on[row[on] >= edge]
        yield i, on[np.lexsort((ids[on], -row[on]))[:k]]


def index(vectors: DataFrame, id_column: str, vector_column: str, pivots: int = 16, annuli: int = 16, sample: int = 4096):
    """(cell, annulus, chunk, id, x) of every usable row, and the statistics of the annuli.

    Pivots and annulus borders come from at most `sample` rows, those of smallest hash. Statistics
    are at most pivots * annuli rows: (cell, annulus, least r, greatest r, greatest norm, chunks)."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    some = integers([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()] or np.empty((0, 1)))
    centres = choose_pivots(some, pivots)
    borders = {}
    if len(some):
        cell, r = _nearest(some, centres)
        borders = {c: np.quantile(r[cell == c], np.arange(1, annuli) / annuli) if (cell == c).any() else np.empty(0) for c in range(len(centres))}

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows or not len(centres):
                continue
            x = integers(batch.column(1).to_pylist())
            cell, r = _nearest(x, centres)
            ring = np.array([np.searchsorted(borders[c], d) for c, d in zip(cell, r, strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(r), pa.array((x**2).sum(1)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "cell", "annulus", "r", "norm2", "x"]
            )

    use_checkpoints(spark)
    placed = rows.mapInArrow(place, "id long, cell int, annulus int, r double, norm2 double, x array<double>").checkpoint()
    stats = placed.groupBy("cell", "annulus").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm2").alias("norm2"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).collect()
    return placed, stats, centres


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = 16, annuli: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with rows of other ids.

    Ties go to the smaller id; a query with fewer rows gets them all. Rows and queries whose vector or
    id is null, or whose vector holds null or non-finite components, take no part; vectors must be of
    one length. Repeated rows are candidates each for itself. Empty tables give an empty result.

    Annuli are cut into chunks of bounded size by a hash of the id, so that a crowded cell becomes many
    units of work. A first round scores each query against one chunk of its own annulus, and its k-th
    best score there is the bound of the second round, which reaches every chunk that can beat it."""
    placed, stats, centres = index(vectors, id_column, vector_column, pivots, annuli)
    schema = "query_id long, vec_id long, score long"
    rings = {(s.cell, s.annulus): s.chunks for s in stats}
    chunks = F.create_map(*[F.lit(v) for (c, a), n in rings.items() for v in (c * annuli + a, n)]) if rings else F.lit(None).cast("map<int,int>")
    ring = F.col("cell") * F.lit(annuli) + F.col("annulus")
    dealt = placed.select(ring.alias("ring"), F.pmod(F.xxhash64("id"), F.element_at(chunks, ring)).cast("int").alias("chunk"), F.lit(None).cast("long").alias("query_id"), "id", "x", F.lit(None).cast("long").alias("floor"))
    asked = queries.where(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).cast("array<double>").alias("v")).distinct()

    blocks = max(1, -(-asked.count() // BLOCK))

    keys = sorted(rings)
    low, high, norm2 = (np.array([s[n] for s in sorted(stats, key=lambda s: (s.cell, s.annulus))]) for n in ("low", "high", "norm2"))
    cells = np.array([c for c, _ in keys], int)

    def bound(x: np.ndarray) -> np.ndarray:
        """The highest inner product that each annulus can hold for each query."""
        far = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))[:, cells]
        gap = np.maximum(np.maximum(low - far, far - high) - 1e-6, 0)
        return ((x**2).sum(1)[:, None] + norm2 - gap**2) / 2 + 1e-3

    def send(first: bool):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if not batch.num_rows or not keys:
                    continue
                ids, x = batch.column(0).to_numpy(), integers(batch.column(1).to_pylist())
                limit = bound(x)
                if first:
                    own = limit.argmax(1)
                    pairs = [(i, own[i], 0) for i in range(len(ids))]
                else:
                    floor = np.array([-(2**63) if f is None else f for f in batch.column(2).to_pylist()], np.float64)
                    pairs = [(i, j, c) for i, j in zip(*np.nonzero(limit >= floor[:, None]), strict=True) for c in range(rings[keys[j]])]
                for a in range(0, len(pairs), 4096):
                    part = pairs[a : a + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([keys[j][0] * annuli + keys[j][1] for _, j, _ in part], pa.int32()),
                            pa.array([c for _, _, c in part], pa.int32()),
                            pa.array([ids[i] for i, _, _ in part], pa.int64()),
                            pa.array([None] * len(part), pa.int64()),
                            pa.array([x[i] for i, _, _ in part], pa.list_(pa.float64())),
                            pa.array([None if first or floor[i] <= -(2.0**62) else int(floor[i]) for i, _, _ in part], pa.int64()),
                        ],
                        names=["ring", "chunk", "query_id", "id", "x", "floor"],
                    )

        return run

    def score(table: pa.Table) -> pa.Table:
        is_query = table.column("query_id").is_valid()
        rows, asking = table.filter(pc.invert(is_query)), table.filter(is_query)
        out: list[tuple] = []
        if rows.num_rows and asking.num_rows:
            rows = rows.sort_by("id")
            ids, x = rows.column("id").to_numpy(), np.array(rows.column("x").to_pylist())
            for a in range(0, asking.num_rows, QUERIES):
                part = asking.slice(a, QUERIES)
                own, q = part.column("query_id").to_numpy(), np.array(part.column("x").to_pylist())
                floor = part.column("floor").to_pylist()
                s = _scores(q, x)
                out += [(own[i], ids[j], s[i, j]) for i, places in _best(s, ids, own, k) for j in places if floor[i] is None or s[i, j] >= floor[i]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    sent = "ring int, chunk int, query_id long, id long, x array<double>, floor long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scored(to: DataFrame) -> DataFrame:
        blocked = to.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        copied = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = copied.unionByName(blocked).groupBy("ring", "chunk", "block").applyInArrow(score, schema)
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    seen = scored(asked.select("query_id", "v").mapInArrow(send(True), sent))
    floors = seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    again = asked.join(floors, "query_id", "left").select("query_id", "v", "floor")
    return scored(again.mapInArrow(send(False), sent)).select("query_id", "rank", "vec_id", "score")
