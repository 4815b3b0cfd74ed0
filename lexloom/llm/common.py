"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Documents without an id are ordered and joined under this one.
NO_ID = -(2**63)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    shared_folder(spark)


def among(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows that may hold one of the keys: those whose key's hash begins like that of one of them.

    At most 2 ** 20 beginnings are broadcast, however many keys there are; what passes by chance is left to the join
    that follows, which then shuffles little where few rows hold a key."""
    begins = F.shiftrightunsigned(F.xxhash64(*columns), 44)
    known = keys.select(begins.alias("begins")).distinct()
    return rows.withColumn("begins", begins).join(F.broadcast(known), "begins", "left_semi").drop("begins")


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def utf8(column: str = "text") -> Column:
    """A text as its UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def batches(lengths: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths add up to `limit`, or single longer items."""
    first = total = 0
    for i, n in enumerate(lengths):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def arrow_rows(it: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def record_batch(columns: dict[str, Sequence], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest so far is kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0], m = 1, 1
        while m < len(out):
            k = min(m, len(out) - m)
            out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
            m += k
        _powers[base] = have = out
    return have[:n]


def give_back() -> None:
    """Let go of what earlier work in this Python process has kept or freed: Spark's workers go from stage to stage and would add
    one stage's peak to the next one's."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray, odd: int = _ODD) -> np.ndarray:
    """Prefix sums of (byte + 1) * odd**i modulo 2**64, one more than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(odd, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, odd: int = _ODD) -> np.ndarray:
    """Hash of the bytes [start, end), whatever their place in the data."""
    return mix((prefix[end] - prefix[start]) * powers(pow(odd, -1, 1 << 64), len(prefix))[start])


#: ASCII white space: what bytes.split() cuts at.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined texts, and the text that each is in.

    `ends`: where each text ends in `data`; each text must be followed by a blank inside `data`."""
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(ends, start, side="right")


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank after each, and where each ends with its blank."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts])
