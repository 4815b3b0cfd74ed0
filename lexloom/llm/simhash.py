"""SimHash near-duplicates: fingerprints of word shingles, linked through one-wildcard segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import batches, id_key, joined, shuffle_partitions, use_checkpoints, utf8, words_of

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes of text that are hashed together.
_BLOCK = 400_000
#: Fingerprints under one key that are compared as one group; larger groups are cut into blocks of this size.
GROUP = 2048


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many ranges of bytes at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    u32 = np.ndarray(len(data) + 1, "<u4", padded.data, strides=(1,))
    s, at = np.uint64(seed), start.copy()
    h = np.full(len(start), s + _P5, np.uint64)
    with np.errstate(over="ignore"):
        if len(long := np.flatnonzero(length >= 32)):
            acc = [np.full(len(long), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes = length[long] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                p = start[long[on]] + 32 * k
                for i in range(4):
                    acc[i][on] = _round(acc[i][on], u64[p + 8 * i])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[long] = x
            at[long] += 32 * stripes
        h += length.astype(np.uint64)
        rest = length % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(on):
                break
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), u64[at[on]]), 27) * _P1 + _P4
            at[on] += 8
        on = np.flatnonzero(rest & 4)
        h[on] = _rotl(h[on] ^ u32[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[on] += 4
        for k in range(3):
            on = np.flatnonzero(rest & 3 > k)
            h[on] = _rotl(h[on] ^ data[at[on]].astype(np.uint64) * _P5, 11) * _P1
            at[on] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def fingerprints_of(texts: list[bytes], words: int = 3) -> np.ndarray:
    """SimHash of each text: bit i is set if over half of its shingles' hashes set it."""
    out = np.zeros(len(texts), np.uint64)
    plain = [b" ".join(t.lower().split()) for t in texts]
    for a, b in batches([len(t) for t in plain], _BLOCK):
        data, ends = joined(plain[a:b])
        start, end, doc = words_of(data, ends)
        if not len(start):
            continue
        count = np.bincount(doc, minlength=b - a)
        first = np.cumsum(count) - count
        shingles = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
        of = np.repeat(np.arange(b - a), shingles)
        word = first[of] + np.arange(len(of)) - (np.cumsum(shingles) - shingles)[of]
        last = np.minimum(word + words, (first + count)[of]) - 1
        h = xxh64(data, start[word], end[last] - start[word])
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(shingles)
        ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int32)
        major = np.packbits(2 * ones > shingles[some, None], axis=1, bitorder="little")
        out[a + some] = np.ascontiguousarray(major).view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; null and blank texts have fingerprint 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist(), words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): each half of a fingerprint with one of its bits left open.

    Of two fingerprints that differ in at most three bits, one half differs in at most one, so that
    they share the variant that leaves this bit open."""
    slot = F.explode(F.sequence(F.lit(0), F.lit(63)))
    half = F.shiftrightunsigned("fp", 32) * (F.col("slot") >= 32).cast("long") + F.col("fp").bitwiseAND(0xFFFFFFFF) * (F.col("slot") < 32).cast("long")
    masked = F.expr("half & ~shiftleft(1L, slot % 32)")
    return distinct.select("fp", slot.alias("slot")).withColumn("half", half).select((F.col("slot") * F.lit(1 << 32) + masked).alias("key"), "fp")


def _forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links a-b (places in fp) as keep the same rows connected: each row to its root."""
    root = np.arange(len(fp))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    on = np.flatnonzero(root != np.arange(len(fp)))
    return fp[on], fp[root[on]]


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def links_in_groups(keys: np.ndarray, fp: np.ndarray, bits: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by key, as a forest: row i against row i + s of its group, for every s."""
    found_a, found_b = [], []
    left = np.arange(len(fp))
    for s in range(1, int(size.max(initial=1))):
        left = left[left + s < len(fp)]
        left = left[keys[left] == keys[left + s]]
        if not len(left):
            break
        on = left[_near(fp[left], fp[left + s], bits)]
        found_a.append(on)
        found_b.append(on + s)
    if not found_a:
        return fp[:0], fp[:0]
    return _forest(fp, np.concatenate(found_a), np.concatenate(found_b))


_LINK = "kind int, key long, a long, b long"


def _link_batch(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), key, a.view(np.int64), b.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "a", "b"])


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) of distinct fingerprints at `bits` or fewer differing bits, as forests of the
    groups that share a variant, so that a group of n gives fewer than n rows.

    Groups over GROUP fingerprints pass through: they are cut into blocks, and every two blocks of a
    group are compared by a task of their own."""
    parts = shuffle_partitions(distinct.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        big = None  # the key of a group that passes through

        def compare(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((first, [len(key)])))
            own = np.repeat(size, size)
            on = (own > 1) & (own <= GROUP)
            if on.any():
                a, b = links_in_groups(key[on], fp[on], bits, size[size <= GROUP])
                if len(a):
                    a, b = np.unique(np.stack([a, b]), axis=1)
                    yield _link_batch(0, np.zeros(len(a), np.int64), a, b)
            if (over := own > GROUP).any():
                yield _link_batch(1, key[over], fp[over], fp[over])

        for batch in it:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if big is not None:
                still = int(np.searchsorted(key, big, side="right"))
                yield _link_batch(1, key[:still], fp[:still], fp[:still])
                key, fp = key[still:], fp[still:]
            if not len(key):
                continue
            big, cut = None, int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            yield from compare(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if len(key) > GROUP:
                big = key[0]
                yield _link_batch(1, key, fp, fp)
                key, fp = key[:0], fp[:0]
        yield from compare(key, fp)

    keyed = variants(distinct).repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = keyed.mapInArrow(run, _LINK).checkpoint()
    return found.where("kind = 0").select("a", "b").unionByName(_links_in_blocks(found.where("kind = 1").select("key", F.col("a").alias("fp")), bits, parts))


def _links_in_blocks(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """Links within large groups. A group of n has n / GROUP blocks; block pairs are the units of work."""
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    dealt = rows.join(size, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("key", "fp", "block", other.alias("other")).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(fp) - 1):
            on = np.flatnonzero(_near(fp[i], fp[i + 1 :], bits)) + i + 1
            found_a.append(np.full(len(on), i))
            found_b.append(on)
        a, b = _forest(fp, np.concatenate(found_a), np.concatenate(found_b))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Documents whose fingerprints are linked by a chain of `bits` or fewer differing bits have the
    same component_id, their smallest doc_id. Null and empty texts have fingerprint zero, linked as
    any other. Equal fingerprints are one node, so that copies cost nothing further. Rows that repeat
    an id keep their rows; null ids count as smallest and stay null; an empty table gives none."""
    use_checkpoints(docs.sparkSession)
    fps = fingerprints(docs, words).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min(id_key()).alias("least"))
    labels = connected_components(links(nodes.select("fp"), bits))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "component").select("fp", "component_id")
    out = fps.join(by_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.expr(f"nullif(component_id, {-(2**63) + 1} - 1)").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their component, with all their columns.

    Every row that holds this id stays. Documents without an id are one component's smallest if any
    is in it."""
    found = near_components(docs, words, bits)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
