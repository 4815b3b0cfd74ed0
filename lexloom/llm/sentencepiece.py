"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces finds those that
end at each character, and one Viterbi pass relaxes the best way to reach it.

For unigram models a way's score is the sum of its pieces' scores. For BPE models the best way is the
one that merging would take: a piece may follow another only if merging their joined text gives just
these two, and at each place exactly one piece may stand last, so that the pass scores allowed steps
as zero and all others as impossible."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import inf

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000
#: Characters of the longest word that is kept.
KEPT_LENGTH = 100
#: Kinds of pieces and of models in a model file (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What a unigram model pays for a character that no piece holds, below the least score.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Model:
    """Pieces, scores and kinds of a model file, and its encoder and decoder."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model, self.prefix, self.squeeze, self.byte_fallback, charsmap = UNIGRAM, True, True, False, b""
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif field == 2:
                spec = dict(_fields(value))
                self.model, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or self.model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalisation are read")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.ids)  # no piece goes on past a word
        runs = [p for p in self.ids if not p.strip(BLANK)]
        self.longest_run = max(map(len, runs), default=1)
        others = [self.scores[i] for p, i in self.ids.items() if len(p) > 1 and p.strip(BLANK)]
        self.runs_last = BLANK in self.ids and not any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in self.ids) and max((self.scores[self.ids[p]] for p in runs if len(p) > 1), default=-inf) < min(others, default=inf)
        n = self.longest_run
        self.regular_runs = BLANK in self.ids and all(self._merged(BLANK * (k + n)) == [BLANK * n, *self._merged(BLANK * k)] for k in range(2 * n, 4 * n))
        self.edges: dict[str, tuple[list, list]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.model == UNIGRAM or self._merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _merged(self, text: str) -> list[str]:
        """Plain merging: again and again the neighbours whose joined piece scores best, the first if equal.

        Candidate merges wait in a heap, so that time grows with n log n."""
        n = len(text)
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (x := self.ids.get(text[i : j + size[j]])) is not None:
                heap.append((-self.scores[x], i, size[i] + size[j])) if not ready else heapq.heappush(heap, (-self.scores[x], i, size[i] + size[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != whole:
                continue  # one of the two has been merged since
            size[i], size[j], after[i] = whole, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(text[i : i + size[i]])
            i = after[i]
        return out

    def _blanks(self, k: int) -> list[int]:
        """Ids of a run of blanks: from some length on, each longest piece more is that piece more in front."""
        more = max(0, (k - 3 * self.longest_run) // self.longest_run) if self.regular_runs else 0
        return [self.ids[BLANK * self.longest_run]] * more + [self.ids[p] for p in self._merged(BLANK * (k - more * self.longest_run))]

    def _after_blanks(self, word: str) -> list[int]:
        """Ids of a word behind two blanks or more. Where pieces of blanks alone are the last to be merged, the
        word takes what it can with one blank, and the rest is a run of blanks."""
        rest = word.lstrip(BLANK)
        k = len(word) - len(rest)
        if not self.runs_last or not rest:
            if not rest and BLANK in self.ids:
                return self._blanks(k)
            return list(chain.from_iterable([self.ids[p]] if p in self.ids else self._outside(p) for p in self._merged(word)))
        ids = self.viterbi(BLANK + rest)
        return self._blanks(k) + ids[1:] if ids[0] == self.ids[BLANK] else self._blanks(k - 1) + ids

    def _edges(self, piece: str) -> tuple[list, list]:
        """How merging builds up a piece's first and last part: (part, when), from one character to the
        piece. A merge of low score comes late; a part is there once both of its own parts are."""
        if (known := self.edges.get(piece)) is None:
            parts = [(c, 0.0, [(c, 0.0)], [(c, 0.0)]) for c in piece]
            while len(parts) > 1:
                _, i = max((self.scores[self.ids[x]], -i) for i in range(len(parts) - 1) if (x := parts[i][0] + parts[i + 1][0]) in self.ids)
                (a, at, left, _), (b, bt, _, right) = parts[-i : 2 - i]
                when = min(at, bt, self.scores[self.ids[a + b]])
                parts[-i : 2 - i] = [(a + b, when, [*left, (a + b, when)], [*right, (a + b, when)])]
            known = self.edges[piece] = (parts[0][2], parts[0][3])
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces leaves them as they are: no merge across the
        seam may come before both sides have grown past it."""
        if (known := self.follows.get((a, b))) is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            left, right = self._edges(self.pieces[a])[1], self._edges(self.pieces[b])[0]
            i = j = 0
            known = True
            while True:
                grow_left = left[i + 1][1] if i + 1 < len(left) else None
                grow_right = right[j + 1][1] if j + 1 < len(right) else None
                across = self.ids.get(left[i][0] + right[j][0])
                if across is not None:
                    score = self.scores[across]
                    if (grow_left is None or score > grow_left) and (grow_right is None or score >= grow_right):
                        known = False
                        break
                if grow_left is None and grow_right is None:
                    break
                if grow_right is None or (grow_left is not None and grow_left >= grow_right):
                    i += 1
                else:
                    j += 1
            self.follows[a, b] = known
        return known

    def _outside(self, c: str) -> list[int]:
        """Ids of a character that no piece holds: its bytes, or the unknown id."""
        return [self.byte_ids[b] for b in c.encode()] if self.byte_fallback else [self.unknown]

    def _allowed(self, text: str) -> list[int]:
        """The pass for a BPE model and a text without outside characters: the first piece that may end
        at a place is the only one, so that the others there are not tried."""
        n, follows = len(text), self.follows
        last: list[int] = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end > length:
                previous = last[end - length]
                if previous < 0:
                    continue
                known = follows.get((previous, piece))
                if not (self._may_follow(previous, piece) if known is None else known):
                    continue
            last[end], size[end] = piece, length
        out: list[int] = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return out

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best way through a text."""
        if self.model == BPE and self.letters.issuperset(text):
            return self._allowed(text)
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        last: list[int] = [-1] * (n + 1)  # id of the piece that ends here, -1 for a character outside
        size = [1] * (n + 1)
        matches = self.automaton.iter(text)
        end, (piece, length) = next(matches, (n, (0, 0)))
        unigram, scores, letters = self.model == UNIGRAM, self.scores, self.letters
        for at in range(n):
            while end == at:
                before = best[at + 1 - length]
                if before is not None:
                    if unigram:
                        score = before + scores[piece]
                    else:
                        previous = last[at + 1 - length]
                        score = 0.0 if previous < 0 or self._may_follow(previous, piece) else None
                    if score is not None and (best[at + 1] is None or score > best[at + 1]):
                        best[at + 1], last[at + 1], size[at + 1] = score, piece, length
                end, (piece, length) = next(matches, (n, (0, 0)))
            if text[at] not in letters and best[at] is not None and (best[at + 1] is None or unigram and best[at] + self.least > best[at + 1]):
                best[at + 1], last[at + 1], size[at + 1] = best[at] + (self.least if unigram else 0.0), -1, 1
        out: list[int] = []
        at = n
        while at:
            out += reversed(self._outside(text[at - 1]) if last[at] < 0 else [last[at]])
            at -= size[at]
        out.reverse()
        if not self.byte_fallback:  # neighbouring characters outside are one unknown
            out = [x for i, x in enumerate(out) if not (i and x == self.unknown == out[i - 1])]
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        if (ids := self.words.get(word)) is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            # runs of blanks have equal scores: places decide
            ids = tuple(self._after_blanks(word) if self.model == BPE and word.startswith(BLANK * 2) else self.viterbi(word))
            if len(word) <= KEPT_LENGTH:
                self.words[word] = ids
        return ids

    _words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Words, with their blanks in front, are found once each if no piece joins two."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if not self.cuts:
            return self.viterbi(text)
        head, *rest = text.split(BLANK)
        if "" in rest or (head and not rest):
            words = self._words.findall(text)
        else:
            words = ([head] if head else []) + [BLANK + w for w in rest]
        known = self.words
        return list(chain.from_iterable([known.get(w) or self._word(w) for w in words]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have no ids. Narrow."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in it:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in it:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode the ids, and sum both up.

    Returns doc_id, n_ids, ids_sha256 (little-endian unsigned 32-bit ids), n_outside (ids of bytes and
    unknowns), decoded_chars, decoded_sha256 and same (whether the decoded text is the text). Null and
    empty texts have no ids and decode to an empty text. Texts that hold the blank sign of the model
    itself decode with blanks in its place. Repeated rows and null ids stay; further columns are left
    out; an empty table gives an empty one."""
    schema = "doc_id long, n_ids long, ids_sha256 string, n_outside long, decoded_chars long, decoded_sha256 string, same boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        first = max([own.unknown, *own.byte_ids.values()]) + 1
        outside = {own.unknown, *own.byte_ids.values()}
        dense = outside <= set(range(first))
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                ids = own.encode(text)
                data = array("I", ids)
                back = own.decode(ids)
                n = sum(x in outside for x in ids) if not dense or (ids and min(ids) < first) else 0
                rows.append((doc_id, len(ids), hashlib.sha256(data.tobytes()).hexdigest(), n, len(back), hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
