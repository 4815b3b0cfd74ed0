"""The prefix trie against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from lexloom.llm import trie

ROWS = "conv_id long, turn long, role string, text string, d string, n string, kids int"


def plain(paths):
    """paths: conv_id -> [(role, text)]. Rows as trie_report() gives them."""
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        childless = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall("[^ \t-\r]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        children = sum(len(k) == len(key) + 1 for k in below)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def paths_of(rows, graft=False):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    if not graft:
        return own
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + path[h:]
    return out


def rows_of(kind):
    rnd = random.Random(kind)
    said = ["hello", "", None, "a b  c", "é 日本\tx", "y\x0bz"]
    rows = []
    for c in rnd.sample(range(400), 150):
        turns = rnd.randrange(1, 7)
        if kind == 2:  # a long common beginning, then many ways on
            text = [("system", f"few shot {i}") for i in range(12)] + [(rnd.choice("ua"), rnd.choice(said)) for _ in range(turns)]
        elif kind == 3 and c % 3:  # copies of one conversation, and one of its beginnings
            text = [("user", "copy"), ("assistant", "of one"), ("user", "end")][: 3 if c % 2 else 2]
        else:
            text = [(rnd.choice(["user", "assistant", None]), rnd.choice(said)) for _ in range(turns)]
        first = rnd.choice([0, 5, -2])
        rows += [(c, None if i == 0 and rnd.random() < 0.3 else first + i, r, t) for i, (r, t) in enumerate(text)]
    rnd.shuffle(rows)
    return rows + [(None, 0, "user", "no conversation")]


@pytest.mark.parametrize("kind, limit", [(1, trie.UNIT_TURNS), (1, 1), (1, 40), (2, 30), (2, 200), (3, 5), (3, 60)])
def test_nodes_equal_plain_ones(spark, kind, limit):
    rows = rows_of(kind)
    df = spark.createDataFrame([(*r, "", "", 1) for r in rows], ROWS).repartition(3)
    assert sorted((tuple(r) for r in trie.trie_report(trie.sequences(df), limit).collect()), key=str) == plain(paths_of(rows))


def test_grafted_conversations_equal_plain_ones(spark):
    rows = [(c, i, "user", f"{c if c % 7 else 'same'} {i}") for c in [*range(0, 70), 85, 203] for i in range(c % 5 + (c % 3 == 0))]
    rows += [(1000 + 5, 0, "user", "short"), (1000 + 7, None, None, None)]
    paths = paths_of(rows, graft=True)
    assert [] in paths.values()  # a conversation that is left without turns
    df = spark.createDataFrame([(*r, "", "", 1) for r in rows], ROWS)
    assert sorted((tuple(r) for r in trie.trie_report(trie.grafted(trie.sequences(df)), 20).collect()), key=str) == plain(paths)


def test_digests_go_on_over_blocks_and_turns_come_back(spark, monkeypatch):
    rows = [(c, 0, "user", "one and the same") for c in range(300)] + [(c, 1, "assistant", "more") for c in range(10)]
    df = spark.createDataFrame([(*r, "", "", 1) for r in rows], ROWS).repartition(4)
    monkeypatch.setattr(trie, "IDS", 7)
    assert sorted((tuple(r) for r in trie.trie_report(trie.sequences(df)).collect()), key=str) == plain(paths_of(rows))
    nodes, _ = trie.prefix_trie(trie.sequences(df))
    assert sorted((r.d, r.role, r.text) for r in trie.with_last_turn(nodes, df).collect()) == [(0, None, None), (1, "user", "one and the same"), (2, "assistant", "more")]


def test_empty_table_and_long_conversation(spark):
    empty = spark.createDataFrame([], ROWS)
    assert trie.trie_report(trie.grafted(trie.sequences(empty))).count() == 0
    rows = [(c, i, "user", str(i)) for c in (1, 2) for i in range(600 - c)]
    df = spark.createDataFrame([(*r, "", "", 1) for r in rows], ROWS)
    got = trie.trie_report(trie.sequences(df), 500).collect()
    assert len(got) == 600 and {(r.depth, r.n_convs, r.n_leaves) for r in got if r.depth in (0, 598, 599)} == {(0, 2, 1), (598, 2, 1), (599, 1, 1)}
