"""Chat formatting at the level of tokens: segments are encoded separately, reserved ids mark the
turns, and the loss mask comes from prefix sums of segment lengths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Strings that the reserved ids stand for: the start of a turn, the end of its role, its end.
CONTROLS = ("### ", ": ", "</turn>\n")
_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPED_IN_ROLE = re.compile(r"\\|###|</turn>|: ")
_UNESCAPED = re.compile(r"\\(\\|###|</turn>|: )")


def escape(text: str, role: bool = False) -> str:
    r"""Put a backslash before each backslash and each control string, so that a text can't hold one.

    Only in a role does the colon that ends roles count."""
    return (_ESCAPED_IN_ROLE if role else _ESCAPED).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


class ChatTokens:
    """Encoder and decoder; the reserved ids follow those of the tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        first = self.tokenizer.get_vocab_size()
        self.start, self.colon, self.end = range(first, first + 3)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def turn(self, role: list[int], text: list[int], learned: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn. The mask is the running sum of +1 and -1 at segment ends."""
        parts = [[self.start], role, [self.colon], text, [self.end]]
        ends = np.cumsum([len(p) for p in parts])
        step = np.zeros(ends[-1] + 1, np.int8)
        if learned:
            np.add.at(step, ends[2:4], (1, -1))
        return np.concatenate([np.asarray(p, np.int32) for p in parts]), np.cumsum(step[:-1], dtype=np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
        """Role, text, learned text and formatted text of one turn's output."""
        marks = np.flatnonzero(ids >= self.start)
        if [int(x) for x in ids[marks]] != [self.start, self.colon, self.end]:
            raise ValueError("a turn must hold each reserved id once, in order")
        role, text = (self.decode(ids[a + 1 : b].tolist()) for a, b in zip(marks, marks[1:], strict=False))
        learned = text if mask[marks[1] + 1 : marks[2]].all() and mask.any() else self.decode(ids[mask.astype(bool)].tolist())
        return unescape(role), unescape(text), unescape(learned), CONTROLS[0] + role + CONTROLS[1] + text + CONTROLS[2]


@lru_cache(maxsize=2)
def chat_tokens(path: str) -> ChatTokens:
    return ChatTokens(path)


def read_text(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, from its string alone."""
    plain = r"((?:\\.|(?!%s)[^\\])*)"
    turn = re.compile("### " + plain % ": " + ": " + plain % "</turn>" + "</turn>\n", re.S)
    out, at = [], 0
    while at < len(formatted):
        if not (m := turn.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_turns(conversations: DataFrame, tokenizer: str, learned_role: str = "assistant") -> DataFrame:
    """One row for each row of `conversations`: conv_id, turn, role, text, ids, loss_mask.

    Null roles and texts count as empty. Encoding is narrow, so a conversation of any length is
    encoded by many tasks. Further columns are left out; repeated rows stay repeated."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chat_tokens(tokenizer)
        for batch in it:
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            segments = tokens.encode([escape(x, role=True) for x in roles] + [escape(x) for x in texts])
            turns = [tokens.turn(segments[i], segments[len(roles) + i], roles[i] == learned_role) for i in range(len(roles))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t[0] for t in turns], pa.list_(pa.int32())), pa.array([t[1] for t in turns], pa.list_(pa.int8()))],
                names=["conv_id", "turn", "role", "text", "ids", "loss_mask"],
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss_mask array<tinyint>")


def conversation_digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Read formatted turns back, in order of turn (ties by role and text), and sum each conversation up.

    Rows of a conversation stream through a sorted partition, so that memory doesn't grow with the
    number of its turns. Null conversation ids are one conversation; an empty table gives none."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, current, state, done = chat_tokens(tokenizer), object(), None, []
        for batch in it:
            for conv, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    if state:
                        done.append(_closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text, learned, formatted = tokens.read(np.asarray(ids), np.asarray(mask))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(formatted)
                state[5] += len(ids)
            if len(done) >= 1000:
                yield _rows(done, names)
                done = []
        if state:
            done.append(_closed(current, state))
        yield _rows(done, names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, schema)


def _closed(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
