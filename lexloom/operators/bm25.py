"""BM25 search over blocks of postings, with score bounds and a rising k-th score.

A block holds some hundred chunks with the postings of the terms that are asked for, its chunks ordered by length and cut into
short ranges. The highest weight of each term in each range bounds the score of every chunk there. A question reads ranges
from the highest bound on, and stops where no bound reaches its k-th best score so far, which goes on from block to block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

KEY = ("corpus_id", "chunk_id")
#: Chunks of a block, about, and of a range of it.
BLOCK, RANGE = 2048, 16
#: Rows of document counts, and question terms, that are broadcast at once; more questions are asked in several goes.
BROADCAST = 300_000

_BLOCK = (
    "corpora array<string>, docs array<long>, tokens array<long>, chunk_ids array<string>, chunk_corpus array<int>, lengths array<int>, terms array<string>, term_corpus array<int>, ends array<int>, chunk array<int>, tf array<int>"
)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each row's place among them."""
    kept = column.combine_chunks().dictionary_encode()
    names = np.array(kept.dictionary.to_pylist(), object)
    order = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return names[order], place[kept.indices.to_numpy(zero_copy_only=False)]


def _block(table: pa.Table) -> pa.Table:
    """One block of rows (corpus_id, chunk_id, len, term, tf); a null term stands for the chunk itself."""
    corpora, corpus = _coded(table.column("corpus_id"))
    own = table.column("term").is_null().to_numpy(zero_copy_only=False)
    ids, chunk = _coded(table.column("chunk_id"))
    length, tf = (table.column(c).to_numpy().astype(np.int64) for c in ("len", "tf"))
    # chunks of the block, shortest first
    key = corpus * len(ids) + chunk
    known, at, of = np.unique(key, return_index=True, return_inverse=True)
    by = np.lexsort((known, length[at]))
    place = np.empty(len(known), np.int64)
    place[by] = np.arange(len(known))
    on = np.flatnonzero(~own)
    terms, term = _coded(table.column("term").take(pa.array(on))) if len(on) else (np.empty(0, object), on)
    pair = term * len(corpora) + corpus[on]
    order = np.lexsort((place[of[on]], pair))
    pairs, first = np.unique(pair[order], return_index=True)
    ends = np.append(first[1:], len(on)) if len(pairs) else first
    count, total = (np.bincount(corpus[own], weights=w[own], minlength=len(corpora)).astype(np.int64) for w in (tf, tf * length))
    row = {
        "corpora": corpora.tolist(), "docs": count.tolist(), "tokens": total.tolist(),
        "chunk_ids": ids[known[by] % len(ids)].tolist(), "chunk_corpus": (known[by] // len(ids)).tolist(), "lengths": length[at][by].tolist(),
        "terms": terms[pairs // len(corpora)].tolist(), "term_corpus": (pairs % len(corpora)).tolist(), "ends": ends.tolist(),
        "chunk": place[of[on]][order], "tf": tf[on][order],
    }
    kinds = {"docs": pa.int64(), "tokens": pa.int64(), "corpora": pa.string(), "chunk_ids": pa.string(), "terms": pa.string()}
    return pa.table({n: pa.array([v], pa.list_(kinds.get(n, pa.int32()))) for n, v in row.items()})


def bm25_blocks(chunks: DataFrame, terms: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """A table of blocks of (corpus_id, chunk_id, tokens). terms: those (term) that will be asked for; none given: all.

    Texts are cut into tokens once: every chunk gives a row for itself, which corpora are sized by, and its postings. The terms
    asked for cut the tokens before anything moves; chunks are dealt to blocks by hash, so that neither a frequent term
    nor a large corpus is one task. Rows that repeat a chunk count as documents each, and have their terms together."""
    n = max(1, -(-chunks.count() // BLOCK))
    own = F.array(F.lit(None).cast("string"))
    each = chunks.select(F.pmod(F.xxhash64(*KEY), F.lit(n)).alias("block"), *KEY, F.size(tokens).alias("len"), F.explode(F.concat(own, tokens)).alias("term"))
    if terms is not None:
        each = _asked_for(each, stored(terms.select("term").distinct()))
    counted = each.repartition("block").groupBy("block", *KEY, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    return stored(counted.groupBy("block").applyInArrow(_block, _BLOCK))


def _asked_for(each: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the terms asked for, and those that stand for chunks: in one pass over the tokens, or, with more terms than
    are broadcast, by a join that moves the tokens."""
    known = asked.withColumn("__asked", F.lit(True))
    if asked.count() <= BROADCAST:
        return each.join(F.broadcast(known), "term", "left").where("term IS NULL OR __asked").drop("__asked")
    return each.where("term IS NOT NULL").join(asked, "term", "left_semi").unionByName(each.where("term IS NULL"))


def bm25_sizes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, df) of blocks: (corpus_id, docs, avg_len), and (corpus_id, term, df) of their terms."""
    of = blocks.select(F.explode(F.arrays_zip("corpora", "docs", "tokens")).alias("c")).select(F.col("c.corpora").alias("corpus_id"), "c.docs", "c.tokens")
    stats = of.groupBy("corpus_id").agg(F.sum("docs").alias("docs"), (F.sum("tokens") / F.sum("docs")).alias("avg_len"))
    counts = F.zip_with("ends", F.concat(F.array(F.lit(0)), "ends"), lambda a, b: a - b)
    terms = blocks.select("corpora", F.explode(F.arrays_zip("terms", "term_corpus", counts.alias("n"))).alias("t"))
    df = terms.select(F.get("corpora", F.col("t.term_corpus")).alias("corpus_id"), F.col("t.terms").alias("term"), F.col("t.n").alias("n")).where("term IS NOT NULL").groupBy("corpus_id", "term").agg(F.sum("n").alias("df"))
    return stats, df


def bm25_postings(blocks: DataFrame) -> DataFrame:
    """(corpus_id, chunk_id, term) of all postings in blocks."""
    starts = F.concat(F.array(F.lit(0)), "ends")
    terms = blocks.select("corpora", "chunk_ids", "chunk", F.explode(F.arrays_zip("terms", "term_corpus", starts.alias("a"), "ends")).alias("t")).where("t.terms IS NOT NULL")
    each = terms.select("corpora", "chunk_ids", "t.terms", "t.term_corpus", F.explode(F.slice("chunk", F.col("t.a") + 1, F.col("t.ends") - F.col("t.a"))).alias("c"))
    return each.select(F.get("corpora", F.col("term_corpus")).alias("corpus_id"), F.get("chunk_ids", F.col("c")).alias("chunk_id"), F.col("terms").alias("term"))


class _Asked:
    """Questions of one go: their terms, numbered, with how often each comes, and corpora they are confined to; with
    `each`, one for each corpus of a question."""

    def __init__(self, rows: pa.Table, only: dict[int, list[str]], df: pa.Table, stats: dict, each: bool):
        names, term = _coded(rows.column("term"))
        self.number = {t: i for i, t in enumerate(names.tolist())}
        q = rows.column("question_id").to_numpy()
        ids, of = np.unique(q, return_inverse=True)
        order = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[order], np.arange(len(ids) + 1))
        qtf = rows.column("qtf").to_numpy().astype(np.float64)
        #: (question, terms, how often each comes, corpora)
        self.questions: list[tuple] = []
        for i, a, b in zip(ids.tolist(), edge[:-1], edge[1:], strict=True):
            mine = (i, term[order[a:b]], qtf[order[a:b]])
            corpora = only.get(i)
            self.questions += [(*mine, [c]) for c in (stats if corpora is None else dict.fromkeys(corpora))] if each else [(*mine, corpora)]
        self.stats = stats
        self.df = dict(zip(zip(df.column("corpus_id").to_pylist(), df.column("term").to_pylist(), strict=True), df.column("df").to_pylist(), strict=True))


def _search_block(row: dict, asked: _Asked, k: int, k1: float, b: float, best: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(question, chunks, scores, postings read, postings of its terms) for each question that has terms here; `best`: each
    question's k highest scores so far, which is kept up."""
    corpora, lengths, chunk = row["corpora"], row["lengths"], row["chunk"]
    number = np.array([asked.number.get(t, -1) for t in row["terms"]], np.int64)
    start = np.concatenate([[0], row["ends"][:-1]]) if len(number) else number
    pair = np.repeat(np.arange(len(number)), row["ends"] - start)
    here = number >= 0
    idf = np.zeros(len(number))
    mean = np.array([asked.stats[c][1] or 1.0 for c in corpora])
    for p in np.flatnonzero(here):
        docs, df = asked.stats[corpora[row["term_corpus"][p]]][0], asked.df[corpora[row["term_corpus"][p]], row["terms"][p]]
        idf[p] = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    norm = k1 * (1 - b + b * lengths / mean[row["chunk_corpus"]])
    weight = idf[pair] * row["tf"] * (k1 + 1) / (row["tf"] + norm[chunk])
    n_ranges = -(-len(lengths) // RANGE)
    cell = pair * n_ranges + chunk // RANGE
    at = np.searchsorted(cell, np.arange(len(number) * n_ranges + 1))
    edge = np.flatnonzero(at[1:] > at[:-1])
    bound = np.zeros(len(number) * n_ranges)
    if len(edge):
        bound[edge] = np.maximum.reduceat(weight, at[edge])
    bound = bound.reshape(len(number), n_ranges)
    first, last = at[:-1].reshape(bound.shape), at[1:].reshape(bound.shape)
    by_number = np.argsort(number, kind="stable")
    sorted_numbers = number[by_number]
    for q, (_, terms, qtf, only) in enumerate(asked.questions):
        a, z = np.searchsorted(sorted_numbers, terms), np.searchsorted(sorted_numbers, terms, side="right")
        pairs = by_number[np.repeat(a - np.concatenate([[0], np.cumsum(z - a)[:-1]]), z - a) + np.arange(int((z - a).sum()))]
        times = np.repeat(qtf, z - a)
        if only is not None:
            ok = np.isin(np.array(corpora, object), only)[row["term_corpus"][pairs]]
            pairs, times = pairs[ok], times[ok]
        if not len(pairs):
            continue
        top = times @ bound[pairs]
        todo = np.argsort(-top, kind="stable")
        todo = todo[top[todo] > 0]
        read, step, done = 0, max(1, -(-k // RANGE)), 0
        scores = np.zeros(len(lengths))
        while done < len(todo):
            now = todo[done : done + step]
            least = best[q][0] if len(best[q]) == k else 0.0
            now = now[top[now] >= least - 1e-8]  # scores are rounded to nine digits
            if not len(now):
                break
            x, y = first[np.ix_(pairs, now)].ravel(), last[np.ix_(pairs, now)].ravel()
            n = y - x
            rows = np.repeat(x - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            scores += np.bincount(chunk[rows], weight[rows] * np.repeat(np.repeat(times, len(now)), n), minlength=len(lengths))
            inside = (now[:, None] * RANGE + np.arange(RANGE)).ravel()
            got = np.round(scores[inside[inside < len(lengths)]], 9)
            best[q] = np.sort(np.concatenate([best[q], got[got > 0]]))[-k:]
            read, done, step = read + len(rows), done + step, 2 * step
        least = best[q][0] if len(best[q]) == k else 0.0
        rounded = np.round(scores, 9)
        found = np.flatnonzero((rounded > 0) & (rounded >= least))
        if len(found) > k:  # equal scores: the smaller ids, which are ordered within the block
            ids = row["rank"]
            found = found[np.lexsort((ids[found], -rounded[found]))[:k]]
        yield q, found, rounded[found], read, int((row["ends"] - start)[pairs].sum())


def _searched(blocks: DataFrame, asked: DataFrame, only: DataFrame | None, k: int, k1: float, b: float, counts: bool, each: bool = False) -> DataFrame:
    """All blocks' best chunks, for questions in one go, or in halves while they need too much to be broadcast."""
    stats, df = bm25_sizes(blocks)
    stats, df = stored(stats), stored(df)

    def go(part: DataFrame, of: int, which: int) -> list[DataFrame]:
        mine = part.where(F.pmod(F.xxhash64("question_id"), F.lit(of)) == which) if of > 1 else part
        known = df.join(mine.select("term").distinct(), "term", "left_semi")
        if max(mine.count(), known.count()) > BROADCAST and mine.select("question_id").distinct().count() > 1:
            return go(part, 2 * of, which) + go(part, 2 * of, which + of)
        limits = {}
        if only is not None:
            ids = mine.select("question_id").distinct()
            limits = {r[0]: r[1] for r in only.join(ids, "question_id", "left_semi").select("question_id", "corpora").toArrow().to_pandas().itertuples(index=False) if r[1] is not None}
        sizes = {r["corpus_id"]: (r["docs"], r["avg_len"]) for r in stats.toArrow().to_pylist()}
        sent = blocks.sparkSession.sparkContext.broadcast((mine.toArrow(), {int(q): list(c) for q, c in limits.items()}, known.toArrow(), sizes))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = _Asked(*sent.value, each)
            best = [np.empty(0)] * len(asked.questions)
            for batch in it:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].values for n in batch.schema.names}
                    row = {n: v.to_pylist() if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False).astype(np.int64) for n, v in row.items()}
                    names, of_chunk = row["chunk_ids"], row["chunk_corpus"]
                    row["rank"] = np.empty(len(names), np.int64)
                    row["rank"][sorted(range(len(names)), key=lambda j: (of_chunk[j], names[j]))] = np.arange(len(names))
                    out: list[tuple] = []
                    for q, found, scores, read, total in _search_block(row, asked, k, k1, b, best):
                        if counts:
                            out.append((asked.questions[q][0], "", "", float(read), total))
                        else:
                            out += [(asked.questions[q][0], row["corpora"][of_chunk[j]], names[j], -s, 0) for j, s in zip(found.tolist(), scores.tolist(), strict=True)]
                    if out:
                        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=["question_id", *KEY, "distance", "total"])

        return [blocks.mapInArrow(run, "question_id long, corpus_id string, chunk_id string, distance double, total long")]

    parts = go(asked, 1, 0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _terms(queries: DataFrame) -> DataFrame:
    return stored(queries.select(F.col("question_id").cast("long").alias("question_id"), F.explode("tokens").alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf")))


def question_terms(queries: DataFrame) -> DataFrame:
    """(term): what bm25_blocks() needs to keep for these questions."""
    return queries.select(F.explode("tokens").alias("term")).distinct()


def best_chunks(blocks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, by_corpus: bool = False) -> DataFrame:
    """(question_id, corpus_id, chunk_id, distance): the k best chunks of each question (by_corpus: and corpus), and some that
    further blocks had to offer; distance is the negated score, rounded to nine digits.

    queries: question_id, tokens (a repeated one counts each time) and, optionally, corpora to search (null: all)."""
    only = queries.select(F.col("question_id").cast("long").alias("question_id"), "corpora").where("corpora IS NOT NULL") if "corpora" in queries.columns else None
    return _searched(blocks, _terms(queries), only, k, k1, b, False, by_corpus).drop("total")


def postings_read(blocks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question_id, read, total): postings of its terms that best_chunks() reads for a question, and all there are."""
    only = queries.select(F.col("question_id").cast("long").alias("question_id"), "corpora").where("corpora IS NOT NULL") if "corpora" in queries.columns else None
    rows = _searched(blocks, _terms(queries), only, k, k1, b, True)
    return rows.groupBy("question_id").agg(F.sum("distance").cast("long").alias("read"), F.sum("total").alias("total"))
