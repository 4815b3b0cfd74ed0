"""Document fingerprints by consistent weighted sampling of word counts.

For each of `samples` hash functions a weighted term draws a gamma-distributed sample that depends on
its weight only through a random grid, and a text keeps its least one. Two texts keep the same one
with a probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batches, id_key, mix, shuffle_partitions

#: Hash functions of a fingerprint.
SAMPLES = 64
#: Words of texts that are sampled together.
_BLOCK = 60_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def draws(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row for each (term hash, weight): the samples, as 64-bit numbers that sort like them.

    The high half is the sample's place, the low half names the term and its grid point."""
    out = np.empty((len(terms), samples), np.uint64)
    salt = (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :]
    scale, low = np.float32(2**-32), np.uint64(0xFFFFFFFF)
    for a in range(0, len(terms), 2048):
        term = terms[a : a + 2048, None]
        u = []
        for j in range(3):
            z = mix((term + np.uint64((j + 1) * int(_GOLDEN) % 2**64)) ^ salt)
            u += [((z >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale, ((z & low).astype(np.float32) + np.float32(0.5)) * scale]
        r = np.maximum(-np.log(u[0] * u[1]), np.float32(1e-6))  # gamma(2, 1)
        c = -np.log(u[2] * u[3])
        t = np.floor(np.log(weights[a : a + 2048, None].astype(np.float32)) / r + u[4])
        place = np.log(np.maximum(c, np.float32(1e-6))) - r * (t - u[4]) - r
        raw = place.view(np.uint32)
        order = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(1 << 31)).astype(np.uint64)
        name = mix(term + t.astype(np.int64).astype(np.uint64) * _GOLDEN) >> np.uint64(32)
        out[a : a + 2048] = order << np.uint64(32) | name
    return out


def signatures(bags: Sequence[dict[str, int]], samples: int = SAMPLES) -> np.ndarray:
    """A row of 32-bit numbers for each bag of words, zeros for an empty one."""
    out = np.zeros((len(bags), samples), np.uint32)
    for a, b in batches([len(x) for x in bags], _BLOCK):
        places: dict[tuple[str, int], int] = {}
        rows = [places.setdefault(x, len(places)) for bag in bags[a:b] for x in bag.items()]
        if not rows:
            continue
        terms = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in places), np.uint64, len(places))
        table = draws(terms, np.fromiter((n for _, n in places), np.int64, len(places)), samples)
        count = np.array([len(x) for x in bags[a:b]])
        some = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[some]
        rows = np.array(rows)
        for i, (x, n) in enumerate(zip(first, count[some], strict=True)):
            out[a + some[i]] = table[rows[x : x + n]].min(axis=0)
    return out


def bag(text: str) -> Counter:
    return Counter(text.split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; two empty texts are alike, an empty and another one are not."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters of the following one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(column: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are at or below the column, by halving."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(column < F.lit(bounds[m]), between(a, m)).otherwise(between(m + 1, b))

    return between(0, len(bounds))


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the one after it in descending doc_id, for the last one the first; of rows
    that repeat an id the smaller text comes first, and rows without an id come last. Null texts are
    empty. A lone document is its own next one; an empty table gives an empty result. Further columns
    are left out.

    The table is dealt once into ranges of ids that hold about equal numbers of rows; the first row
    of each range also goes to the range before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), id_key().alias("key"))
    parts = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts).alias("c")).first().c if parts > 1 else []
    bounds = sorted(set(cuts or []))
    dealt = rows.withColumn("range", ranges(F.col("key"), bounds))
    # the highest id of each range is what the range above it goes on with
    heads = {r["range"]: r.key for r in dealt.select("range", "key").groupBy("range").agg(F.max("key").alias("key")).collect()}
    order = sorted(heads)
    extra = F.array().cast("array<int>")
    if order:
        above = {n: order[(i + 1) % len(order)] for i, n in enumerate(order)}
        is_head = F.create_map(*[F.lit(x) for n in order for x in (n, heads[n])])
        goes_to = F.create_map(*[F.lit(x) for n in order for x in (n, above[n])])
        extra = F.when(F.col("key") == F.element_at(is_head, F.col("range")), F.array(F.element_at(goes_to, F.col("range")))).otherwise(extra)
    sent = dealt.select(
        "doc_id", "key", "text", F.explode(F.concat(F.array(F.struct(F.col("range").alias("to"), F.lit(False).alias("lent"))), F.transform(extra, lambda x: F.struct(x.alias("to"), F.lit(True).alias("lent"))))).alias("where")
    ).select("doc_id", "key", "text", "where.to", "where.lent")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range in descending order, then the lent ones; a range may take several batches."""
        held: list[tuple] = []
        for batch in it:
            to, lent, doc_id, text = (batch.column(i).to_pylist() for i in range(4))
            for row in zip(to, lent, doc_id, text, strict=True):
                if held and (held[-1][0] != row[0] or held[-1][1]):
                    if held[-1][0] == row[0]:
                        continue  # only the first lent row counts
                    yield from closed(held)
                    held = []
                held.append(row)
            if len(held) > 1 and not held[-1][1]:
                yield from closed(held)
                held = held[-1:]
        yield from closed(held)

    def closed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """All rows but the last have their next one behind them."""
        for a, b in batches([len(r[3]) for r in rows[:-1]], 1_000_000):
            texts = [r[3] for r in rows[a : b + 1]]
            changed = [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
            n = b - a
            # a text beside its edited one, as they share words that are drawn once for both
            both = signatures([bag(t) for pair in zip(texts, [*changed, ""], strict=True) for t in pair], samples)
            own = np.concatenate((both[0::2], both[1::2][:n]))
            hexes = [x.astype(">u4").tobytes().hex() for x in own]
            columns = [
                [r[2] for r in rows[a:b]],
                [len(t) for t in texts[:n]],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                hexes[:n],
                hexes[n + 1 :],
                [likeness(own[i], own[n + 1 + i]) for i in range(n)],
                [likeness(own[i], own[i + 1]) for i in range(n)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ordered = sent.repartition(parts, "to").sortWithinPartitions("to", "lent", F.desc("key"), "text")
    return ordered.select("to", "lent", "doc_id", "text").mapInArrow(run, schema)


__all__ = ["NO_ID", "draws", "edited", "fingerprint_pairs", "likeness", "signatures"]
