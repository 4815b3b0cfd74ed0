"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, and
a sequence is one piece, so that no sequence crosses documents and none needs padding."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import batches, give_back

#: The split pattern of byte-level BPE, as in the tokenizer's own description.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000
_FIELDS = ["doc_id long", "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", "bucket int", "ids array<int>"]
_NAMES = [x.split()[0] for x in _FIELDS]
#: Bytes of text whose pieces are held and returned together.
TOGETHER = 1_000_000
#: Where a cut before a blank changes tokens: a blank after white space and before another or the end.
_RUN = re.compile(r"\s (?: |$)")


class WordIds(dict):
    """Ids, as little-endian 32-bit bytes, of a blank and a word; bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids = array("I", self.encode(" " + word)).tobytes()
        return ids


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file.

    Tokens with a blank have it in front, so a text is cut before its blanks and each word's ids are
    kept. Texts with runs of white space and texts with special tokens are encoded whole."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        model = json.loads(self.whole.to_str())["model"]
        self.words = WordIds(self._by_ranks(model) or (lambda w: self.whole.encode(w, add_special_tokens=False).ids))

    def _by_ranks(self, model: dict):
        """Merges in the order of ids are what a rank table says, and that is faster for single words."""
        code = {c: b for b, c in _byte_letters().items()}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        if [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            return None
        ranks = {bytes(code[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if _RUN.search(text) or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.words.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.words.__getitem__, rest))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as powers of two, the largest first, none above `longest` (itself a power of two)."""
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, with `end_id` behind them, into power-of-two pieces.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (the
    binary logarithm of its length, by which loaders batch) and, if asked for, ids. A null or empty
    text has the end id alone. Repeated rows are packed each for itself; null ids stay null; further
    columns are left out. An empty table gives an empty one. Narrow: no shuffle; a sequence id holds
    its partition and the piece's number there."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = ", ".join(_FIELDS if with_ids else _FIELDS[:-1])
    end = array("I", [end_id]).tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe, number = byte_bpe(tokenizer), TaskContext.get().partitionId() << 33
        for batch in it:
            for part in bounded(batch):
                rows, ids = _pieces(part, bpe, end, longest, number)
                number += len(rows)
                yield _record_batch(rows, ids if with_ids else None)
        bpe.words.clear()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, limit: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of ids and texts that hold `limit` bytes of text or a single longer one, as a batch may hold very many."""
    for first, last in batches(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), limit):
        yield batch.slice(first, last - first)


def _pieces(docs: pa.RecordBatch, bpe: ByteBpe, end: bytes, longest: int, number: int) -> tuple[list[tuple], list[bytes]]:
    """Rows of all pieces, numbered from `number` on, and each document's ids."""
    rows, texts = [], []
    for doc_id, text in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True):
        ids = bpe.ids(text or "") + end
        total, start, view = len(ids) // 4, 0, memoryview(ids)
        for length in binary_lengths(total, longest):
            rows.append((doc_id, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total, number, 0, length.bit_length() - 1))
            start += length
            number += 1
        texts.append(ids)
    return rows, texts


def _record_batch(rows: list[tuple], ids: list[bytes] | None) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    columns[7] = columns[7].cast(pa.int32())
    if ids is not None:
        values = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
        columns.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(r[2] for r in rows)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES[: len(columns)])
