"""Phrases whose words come together more often than by chance, counted in counting quotient filters.

Words that come often enough get numbers; texts become sequences of numbers, cut at every rarer word. Phrases are
counted length by length: a phrase can only be frequent if its first and its last part, one word shorter, are. Every
chunk of numbers makes one filter a part of the permuted numbers; the filters of a part are merged in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .common import batches, mix, shuffle_partitions
from .lines import looked_up
from .quotient import MOST_WORDS, WORD_BITS, QuotientFilter, packed, permuted
from .simhash import xxh64

#: Numbered words, of all languages, that are broadcast; with more, texts are numbered by a join.
BROADCAST_WORDS = 4_000_000
#: Bytes of text and numbers that are worked on together, and distinct phrases that a part may have.
_BLOCK, CHUNK, PART = 2_000_000, 1_000_000, 2_000_000
#: Bits of the bitmap that says which shorter phrases are frequent: 16 a phrase, between these powers of two.
BITS = (16, 27)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\v\f\r"]] = True
_IN_WORD = ~_BREAK
_IN_WORD[[9, 32]] = False


def tokens(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased joined texts, starts and ends of their words, and whether a break is before each."""
    low = b"\n".join([*[t.lower() for t in texts], b""])
    data = np.frombuffer(low, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[data], [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    piece = np.cumsum(_BREAK[data])[start] if len(start) else start
    return low, start, end, np.concatenate([[True], piece[1:] != piece[:-1]])[: len(start)]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language together, _BLOCK bytes at a time."""
    lang = batch.column(0).to_pylist()
    rows: dict[str, list[int]] = {}
    for i, x in enumerate(lang):
        rows.setdefault(x, []).append(i)
    size = pc.binary_length(batch.column(1)).to_numpy()
    for x, of in rows.items():
        for a, b in batches(size[of].tolist(), _BLOCK):
            yield x, batch.column(1).take(pa.array(of[a:b])).to_pylist()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, a) of every word of every language. In a block of text, words are told by 64-bit hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang, texts in _by_lang(batch):
                low, start, end, _ = tokens(texts)
                h = xxh64(np.frombuffer(low, np.uint8), start, end - start)
                _, first, count = np.unique(h, return_index=True, return_counts=True)
                words = [low[x:y].decode() for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(count, pa.int64())], names=["lang", "word", "a"])

    return _texts(docs).mapInArrow(run, "lang string, word string, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def numbered(words: DataFrame) -> DataFrame:
    """(lang, word, a, id): each word's number, from 1, below 2 ** WORD_BITS. Numbers come from places within buckets
    of some thousand words, so that no language is ordered in one task."""
    buckets = words.count() // 4000 + 1
    place = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("word"))
    out = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    return out.withColumn("id", (place * F.lit(buckets) + F.col("bucket")).cast("long")).drop("bucket")


def sequences(docs: DataFrame, words: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(lang, ids): the texts as numbers of their words (little-endian, 32 bits), 0 at breaks and for other words."""
    n = words.count()
    if n > limit:
        return _sequences_by_join(docs, words)
    sent = docs.sparkSession.sparkContext.broadcast(words.select("lang", F.xxhash64("word").alias("h"), "id").toArrow())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = sent.value, {}
        for batch in it:
            for lang, texts in _by_lang(batch):
                if lang not in known:
                    own = table.filter(pc.equal(table["lang"], lang))
                    h = own["h"].to_numpy().view(np.uint64)
                    order = np.argsort(h)
                    known[lang] = h[order], own["id"].to_numpy()[order]
                hashes, ids = known[lang]
                low, start, end, new = tokens(texts)
                h = xxh64(np.frombuffer(low, np.uint8), start, end - start)
                out = np.zeros(len(h) + int(new.sum()), "<u4")
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    out[np.arange(len(h)) + np.cumsum(new)] = np.where(hashes[at] == h, ids[at], 0)
                out = out[(out > 0) | np.concatenate([[True], out[:-1] > 0])]  # one 0 between runs
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([out.tobytes()], pa.binary())], names=["lang", "ids"])

    return _texts(docs).mapInArrow(run, "lang string, ids binary")


def _sequences_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    """sequences() where the words are too many for a broadcast: each place of a text meets its word by a join, common words
    apart, and the places of a block of text come together again."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in it:
            part = batch.column(2)[0].as_py() << 33 if batch.num_rows else 0
            for lang, texts in _by_lang(batch):
                low, start, end, new = tokens(texts)
                h = xxh64(np.frombuffer(low, np.uint8), start, end - start)
                at = np.arange(len(h)) + np.cumsum(new)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), part + n)), pa.array(at), pa.array(h.view(np.int64))], names=["lang", "block", "place", "h"])
                n += 1

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, block, place, ids = "", np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

        def rows(block, place, ids, langs):
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist() if len(block) else []
            for x, y in zip(edge, [*edge[1:], len(block)], strict=True) if edge else ():
                gap = np.concatenate([[0], np.cumsum(place[x + 1 : y] != place[x : y - 1] + 1)])
                out = np.zeros(y - x + int(gap[-1]), "<u4")
                out[np.arange(y - x) + gap] = ids[x:y]
                yield pa.RecordBatch.from_arrays([pa.array([langs[x]]), pa.array([out.tobytes()], pa.binary())], names=["lang", "ids"])

        langs = np.empty(0, object)
        for batch in it:
            langs = np.concatenate([langs, np.array(batch.column(0).to_pylist(), object)])
            block, place, ids = (np.concatenate([old, batch.column(i + 1).to_numpy()]) for i, old in enumerate((block, place, ids)))
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0
            yield from rows(block[:last], place[:last], ids[:last], langs[:last])
            langs, block, place, ids = langs[last:], block[last:], place[last:], ids[last:]
        yield from rows(block, place, ids, langs)

    # the partition as its own scan numbers it: the two sides of a union, which both read this, give tasks other numbers
    places = _texts(docs).withColumn("part", F.spark_partition_id()).mapInArrow(cut, "lang string, block long, place long, h long")
    found = words.select("lang", F.xxhash64("word").alias("h"), "id", "a")
    met = looked_up(places, found, ["lang", "h"], "a", words.agg(F.sum("a")).first()[0])
    return met.select("lang", "block", "place", "id").repartition("block").sortWithinPartitions("block", "place").mapInArrow(put, "lang string, ids binary")


def _spots(left: np.ndarray, right: np.ndarray, lang: str) -> np.ndarray:
    """Places of permuted phrases of a language in bitmaps, before they are cut to the bitmap's size."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0x9E3779B97F4A7C15) ^ right ^ xxh64(np.frombuffer(lang.encode() + b" ", np.uint8), np.array([0]), np.array([len(lang.encode())])))


def _counted(seqs: DataFrame, words: int, shorter: tuple[int, np.ndarray] | None, part_bits: int) -> DataFrame:
    """(lang, part, filter) of the phrases of so many words whose shorter parts are in the bitmap."""
    sent = seqs.sparkSession.sparkContext.broadcast(shorter) if shorter is not None else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x for a in held.pop(lang) for x in (a, np.zeros(1, "<u4"))])
            n = len(ids) - words + 1
            if n <= 0:
                return
            whole = np.ones(n, bool)
            for k in range(words):
                whole &= ids[k : k + n] > 0
            if sent is not None:
                bits, bitmap = sent.value
                on = np.flatnonzero(whole)
                for k in (0, 1):
                    spot = _spots(*permuted(*packed([ids[on + k + j] for j in range(words - 1)]), words - 1), lang) & np.uint64((1 << bits) - 1)
                    on = on[(bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)]
            else:
                on = np.flatnonzero(whole)
            made = QuotientFilter.counted(words, *permuted(*packed([ids[on + k] for k in range(words)]), words)).split(part_bits)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(made)), pa.array([p for p, _ in made], pa.int64()), pa.array([f.to_bytes(part_bits) for _, f in made], pa.binary())], names=["lang", "part", "filter"])

        for batch in it:
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, [])
                own.append(np.frombuffer(ids, "<u4"))
                if sum(map(len, own)) >= CHUNK:
                    yield from send(lang)
        for lang in list(held):
            yield from send(lang)

    return seqs.mapInArrow(run, "lang string, part long, filter binary")


def _frequent(filters: DataFrame, at_least: int) -> DataFrame:
    """(lang, ids, a, spot) of the phrases that merged filters count so often: a part's filters are merged whenever
    they hold more than PART numbers together, so that a task holds one part at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = QuotientFilter.merged(held)
                on = whole.counts >= at_least
                own = QuotientFilter(whole.words, whole.left[on], whole.right[on], whole.counts[on])
                grams = own.grams()
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, grams.size + 1, own.words, dtype=np.int32)), pa.array(grams.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(grams), pa.string()), ids, pa.array(own.counts), pa.array(_spots(own.left, own.right, key[0]).view(np.int64))], names=["lang", "ids", "a", "spot"])

        for batch in it:
            for lang, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, part) != key:
                    yield from done()
                    key, held, size = (lang, part), [], 0
                held.append(QuotientFilter.from_bytes(data))
                size += len(held[-1].left)
                if size > 2 * PART and len(held) > 1:
                    held = [QuotientFilter.merged(held)]
                    size = len(held[0].left) // 2
        yield from done()

    dealt = filters.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(run, "lang string, ids array<int>, a long, spot long")


def _bitmap(found: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits at the spots of the phrases: at most 2 ** BITS[1] of them, whatever their number; a spot that several share lets
    more phrases be counted, none fewer."""
    bits = min(max(BITS[0], (16 * n - 1).bit_length()), BITS[1])
    cell = found.select(F.col("spot").bitwiseAND(F.lit((1 << bits) - 1)).alias("s")).select(F.shiftright("s", 6).alias("cell"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    rows = cell.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["cell"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return bits, out


def frequent_phrases(docs: DataFrame, longest: int = MOST_WORDS, at_least: int = 100, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (lang, n), the words of each language; (lang, word, a, id), its frequent words; (lang, ids, a), its
    frequent phrases of 1 to `longest` words, by the words' numbers, and how often they come."""
    if not 1 <= longest <= MOST_WORDS:
        raise ValueError(f"phrases have 1 to {MOST_WORDS} words")
    counts = stored(word_counts(docs))
    langs = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")))
    words = stored(numbered(counts.where(F.col("a") >= at_least)))
    if (words.agg(F.max("id")).first()[0] or 0) >= 1 << WORD_BITS:
        raise ValueError(f"a language has over 2 ** {WORD_BITS} words that come {at_least} times; raise at_least")
    seqs = stored(sequences(docs, words, broadcast_words))
    total = seqs.agg(F.sum(F.octet_length("ids")) / 4).first()[0] or 0
    part_bits = max(4, (int(total) // PART).bit_length())
    levels, shorter = [words.select("lang", F.array(F.col("id").cast("int")).alias("ids"), "a")], None
    for k in range(2, longest + 1):
        found = stored(_frequent(_counted(seqs, k, shorter, part_bits), at_least))
        n = found.count()
        if not n:
            break
        levels.append(found.drop("spot"))
        if k < longest:
            shorter = _bitmap(found, n)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return langs, words, out


def scored(langs: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of the phrases of two words or more that no longer one explains.

    The score is floor(1000 * a * n / (l * r)) at the lowest-scoring cut into l and r, the first of equal ones. A
    phrase goes if one that holds it comes as often. Products are decimals of 38 digits; more is an error."""
    long = found.where("size(ids) > 1")
    within = long.where("size(ids) > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.size("ids") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("k") + 1)))
    within = within.select("lang", F.expr("slice(ids, i, k)").alias("ids"), "a").groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    kept = long.join(within, ["lang", "ids"], "left").where("longer IS NULL OR longer < a").select("lang", "ids", "a")
    cuts = stored(kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1))).select("lang", "ids", "a", "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail")))
    total = cuts.count()
    for part, name in (("head", "l"), ("tail", "r")):
        keys = cuts.groupBy("lang", part).agg(F.count("*").alias("rows")).join(found.select("lang", F.col("ids").alias(part), F.col("a").alias(name)), ["lang", part])
        cuts = stored(looked_up(cuts, keys, ["lang", part], "rows", total).drop("rows", part))
    of = langs.join(cuts.groupBy("lang").agg(F.count("*").alias("rows")), "lang")
    cuts = looked_up(cuts, of, ["lang"], "rows", total)
    wide = "CAST({} AS DECIMAL(19, 0)) * CAST({} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide.format('1000 * a', 'n')}) DIV ({wide.format('l', 'r')})"))
    best = cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("m"))
    return best.select("lang", "ids", "m.a", "m.l", "m.r", "m.n", "m.score")


def top_phrases(docs: DataFrame, longest: int = MOST_WORDS, at_least: int = 100, most: int = 2000, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language by score, a and phrase.

    Texts are lower-cased (A-Z), cut to pieces at [.,;:!?\\n-\\r] and to words at blanks and tabs; phrases of up to `longest`
    words lie within pieces and come `at_least` times, overlaps included. n: all words of the language. Null languages go as
    'und', null texts as empty; rows that repeat an id count each; further columns are left out. An empty
    table, or one without frequent phrases, gives none. Words are told by 64-bit hashes, phrases by their words' numbers."""
    langs, words, found = frequent_phrases(docs, longest, at_least, broadcast_words)
    best = stored(scored(langs, found))
    # the first of each of several lots of a language, ties included, so that no language is ordered in one task
    lot = F.pmod(F.xxhash64("ids"), F.lit(shuffle_partitions(docs.sparkSession)))
    order = (F.desc("score"), F.desc("a"))
    first = best.withColumn("lot", lot).withColumn("at", F.rank().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("at") <= most)
    each = first.select("lang", "ids", F.posexplode("ids").alias("k", "id")).join(words.select("lang", F.col("id").cast("int").alias("id"), "word"), ["lang", "id"])
    texts = each.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = first.join(texts, ["lang", "ids"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return out.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
