"""Benchmark decontamination: windows of benchmark words looked up in FM-indexes of the training text.

Every task cuts its documents into shards of SHARD_BYTES, numbers the words of a shard, and builds an FM-index over
them, a separator of its own behind each document. All windows are searched backwards at once, their
occurrences located by sampled suffix positions, and what they cover is merged to spans. Nothing is shuffled. The
benchmark goes to the tasks in blocks of at most BLOCK windows, one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .common import batches
from .fmindex import MOST, FmIndex
from .simhash import xxh64

WINDOW = 10
#: Bytes of text of a shard. Longer documents are cut into pieces that overlap.
SHARD_BYTES = 1_500_000
#: Windows, each with an item, that a block of the benchmark holds at most on average.
BLOCK = 200_000

#: What a word is made of, in lower-cased UTF-8.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SCHEMA = "doc_id long, text string, n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def hashed_words(text: str) -> Column:
    words = F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of each item, as hashes of their words. Items without an id go as ''."""
    of = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), hashed_words("text").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return of.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words")).distinct()


class Windows:
    """A block of windows: its distinct words and windows, and the items of each window, by their place in order."""

    def __init__(self, rows: pa.Table):
        words = rows.column("words").combine_chunks()
        length = np.diff(words.offsets.to_numpy()).astype(np.int64)
        width = int(length.max(initial=1))
        self.known, code = np.unique(words.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        ends = np.cumsum(length)
        back = np.full((len(length), width), -1, np.int64)  # the last word first
        for k in range(width):
            on = length > k
            back[on, k] = code[ends[on] - 1 - k]
        self.phrases, of = np.unique(back, axis=0, return_inverse=True)
        self.lengths = (self.phrases >= 0).sum(1)
        self.ids = sorted(set(rows.column("item_id").to_pylist()))
        place = {x: i for i, x in enumerate(self.ids)}
        item = np.array([place[x] for x in rows.column("item_id").to_pylist()], np.int64)
        by = np.lexsort((item, of.ravel()))
        self.items, self.edges = item[by], np.searchsorted(of.ravel()[by], np.arange(len(self.phrases) + 1))

    def occurrences(self, hashes: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all occurrences in a shard: words, with separators where `sep` says so."""
        symbols, vocabulary = np.empty(len(hashes), np.int64), np.unique(hashes[~sep])
        symbols[~sep] = np.searchsorted(vocabulary, hashes[~sep])
        symbols[sep] = len(vocabulary) + np.arange(int(sep.sum()))
        at = np.minimum(np.searchsorted(vocabulary, self.known), max(len(vocabulary) - 1, 0))
        here = np.where(vocabulary[at] == self.known, at, -1) if len(vocabulary) else np.full(len(self.known), -1)
        index = FmIndex(symbols, len(vocabulary) + int(sep.sum()))
        phrases = np.where(self.phrases >= 0, here[self.phrases], -1)
        low, high = index.search(phrases, self.lengths)
        count = high - low
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(np.arange(len(count)), count), index.locate(rows)


def word_ranges(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words of lower-cased texts, each with a blank behind it, and the text that each is in."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[data], [False]]).view(np.int8)))
    return edge[0::2], edge[1::2], np.searchsorted(ends, edge[0::2], side="right")


def pieces_of(first: np.ndarray, count: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(text, first, last) of runs of at most `size` words; runs of one text overlap by `overlap` words."""
    out = []
    for d, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        at = a
        while n and (at == a or at + overlap < a + n):
            out.append((d, at, min(at + size, a + n)))
            at += size - overlap
    return out


def search_block(texts: list[bytes], windows: Windows, hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text: where its words start and end in it, its words, which are hit (besides `hits`), the items found."""
    data = np.frombuffer(b" ".join([*[t.lower() for t in texts], b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, end, doc = word_ranges(data, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    hit = np.zeros(len(start) + 1, np.int64)
    found: list[np.ndarray] = []
    if len(windows.phrases) and len(start):
        h = xxh64(data, start, end - start).view(np.int64)
        overlap = int(windows.lengths.max()) - 1
        pieces = pieces_of(first, count, max(MOST // 4, 4 * overlap + 4), overlap)
        for a, b in batches([y - x + 1 for _, x, y in pieces], MOST // 2):
            place = np.concatenate([np.r_[x:y, -1] for _, x, y in pieces[a:b]])
            window, at = windows.occurrences(np.where(place < 0, 0, h[place]), place < 0)
            at = place[at]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + windows.lengths[window], -1)
            pairs = np.unique(doc[at] * len(windows.phrases) + window)
            of, window = np.divmod(pairs, len(windows.phrases))
            n = windows.edges[window + 1] - windows.edges[window]
            item = windows.items[np.repeat(windows.edges[window] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            found.append(np.unique(np.repeat(of, n) * len(windows.ids) + item))
    is_hit = np.cumsum(hit[:-1]) > 0
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    of, item = np.divmod(pairs, max(len(windows.ids), 1))
    offset = ends - np.array([len(t) + 1 for t in texts], np.int64)
    cut = np.cumsum(count)[:-1]
    mine = np.split(is_hit, cut)
    for d, spans in enumerate(hits):
        for a, b in spans:
            mine[d][a:b] = True
    return start - offset[doc], end - offset[doc], first, mine, np.split(item, np.searchsorted(of, np.arange(1, len(texts))))


def spans_of(hit: np.ndarray) -> np.ndarray:
    """[first, last) of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)


def _searched(docs: DataFrame, rows: pa.Table, cut: bool) -> DataFrame:
    """docs (as _SCHEMA) with the spans and items of one more block of windows, and its spans cut out if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(sent.value)
        for batch in it:
            column = batch.column("text").cast(pa.binary())
            n_words, spans, items, texts = [], [], [], []
            for a, b in batches(pc.fill_null(pc.binary_length(column), 0).to_pylist(), SHARD_BYTES):
                part = [t or b"" for t in column.slice(a, b - a).to_pylist()]
                known = [[(s["first"], s["last"]) for s in x] for x in batch.column("spans").slice(a, b - a).to_pylist()]
                start, end, first, hit, item = search_block(part, windows, known)
                for k, (t, h, i, old) in enumerate(zip(part, hit, item, batch.column("items").slice(a, b - a).to_pylist(), strict=True)):
                    runs = spans_of(h)
                    n_words.append(len(h))
                    spans.append([{"first": x, "last": y} for x, y in runs.tolist()])
                    items.append(sorted({*old, *(windows.ids[x] for x in i.tolist())}))
                    if cut and len(runs):
                        edges = [0, *np.stack([start[first[k] + runs[:, 0]], end[first[k] + runs[:, 1] - 1]], axis=1).ravel().tolist(), len(t)]
                        t = b"".join(t[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                    texts.append(t)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            text = pc.if_else(pc.is_valid(batch.column("text")), text, pa.scalar(None, pa.string())) if cut else batch.column("text")
            made = [batch.column("doc_id"), text, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, _SCHEMA)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, cut: bool = False, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document, and its text without the spans if `cut`.

    A window is `window` consecutive words of an item's text; an item of fewer words is one. Words are those of WORD,
    after lower-casing A-Z. spans: [first, last) of the runs of words inside occurrences of windows, by number. items: the
    ids, as strings, of the items that have one, in order. Null texts have no words and stay null; rows that
    repeat an id are documents of their own; items that repeat an id are one; items without an id go as ''. A text is
    cut from where a span's first word starts to where its last one ends. An empty benchmark hits nothing, an empty
    table gives an empty one; further columns are left out. Words are told by 64-bit hashes."""
    asked = stored(windows_of(items, window))
    blocks = max(1, -(-asked.count() // block))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first: long, last: long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).toArrow()
        out = _searched(out, rows, cut and b == blocks - 1)
    return out if cut else out.drop("text")


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contaminated() as counts and a digest of the items."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    found = contaminated(docs, items)
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
