"""The trie of conversation prefixes by truncation peeling.

Conversations are sequences of hashed turns; a node is a distinct prefix, known by its depth and a 128-bit hash. Peeling goes from
the deepest level to the root: what has come up from below and the conversations that end there are merged to nodes, the last turn
is stripped, and what is left is grouped again one level higher, with all figures of a node gathered on the way.

Pieces (ended conversations, nodes that came up) below a prefix that has few of them are peeled together in one task, all levels at
once; below a crowded prefix, each uncrowded one does so by itself and hands up one piece. The pieces at crowded
nodes are added up by a grouping, and the next round peels what is then left. A hot first turn, or a long common
beginning of many conversations, so takes one more round and not a task of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .common import among, mix, shuffle_partitions
from .lines import looked_up

#: Turns, over all pieces, that are peeled in one group; a single conversation may be longer.
UNIT_TURNS = 200_000
#: Ids whose digits are joined before they are hashed.
IDS = 4096

_WORDS = "[^\\x20\\x09-\\x0D]+"
_PIECE = "d int, a long, b long, conv long, n long, kids long, leaves long, saved long, pa array<long>, pb array<long>, w array<int>"
_NODE = f"is_node boolean, {_PIECE}, parent long, up_a long, up_b long"


def _turn() -> list[Column]:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return [F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(11), text, role).alias("b"), F.regexp_count(text, F.lit(_WORDS)).alias("w")]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): hashes and words of each conversation's turns in order: null turns first, equal ones by hash.
    Rows without a conv_id belong to no conversation."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), *_turn())
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "w"))).alias("turns"))


def grafted(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % every and goes on with its own after its
    first h, h being the unsigned crc32 of its decimal id modulo `most`."""
    heads = seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chains(seqs: DataFrame) -> DataFrame:
    """(conv_id, d, a, b, pa, pb, w): each conversation's hash, and those of all its prefixes with their last turns' words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            turns = batch.column(1)
            size = np.diff(turns.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(size) - size
            flat = turns.flatten()
            place = (np.arange(len(flat)) - np.repeat(start, size)).astype(np.uint64)
            edges = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            prefix, whole = [], []
            for name, odd in (("a", 0x9E3779B97F4A7C15), ("b", 0xC2B2AE3D27D4EB4F)):
                x = flat.field(name).to_numpy(zero_copy_only=False).view(np.uint64)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x ^ mix((place + np.uint64(1)) * np.uint64(odd))), dtype=np.uint64)])
                sums = (total[1:] - np.repeat(total[start], size)).view(np.int64)
                prefix.append(pa.ListArray.from_arrays(edges, pa.array(sums)))
                last = np.where(size > 0, np.concatenate([sums, [0]])[start + size - 1], 0)
                whole.append(pa.array(last))
            words = pa.ListArray.from_arrays(edges, flat.field("w"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), *whole, *prefix, words], names=["conv_id", "d", "a", "b", "pa", "pb", "w"])

    return seqs.select("conv_id", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w"))).alias("turns")).mapInArrow(run, "conv_id long, d int, a long, b long, pa array<long>, pb array<long>, w array<int>")


class _Lists:
    """A column of lists: flat values and where each list starts."""

    def __init__(self, column: pa.Array):
        self.size = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = column.flatten().to_numpy(zero_copy_only=False)

    def cut(self, which: np.ndarray, length: np.ndarray) -> pa.Array:
        """The first values of some lists."""
        edges = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[which] - edges[:-1], length) + np.arange(edges[-1])
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(self.flat[at]))


def peel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The nodes of whole units, and a piece for the parent of each unit's top. batch: `top`, the depth of the piece's unit, and _PIECE."""
    top, d, conv, n, kids, leaves, saved = (batch.column(c).to_numpy().astype(np.int64) for c in ("top", "d", "conv", "n", "kids", "leaves", "saved"))
    a, b, w = (_Lists(batch.column(c)) for c in ("pa", "pb", "w"))
    names = ("d", "a", "b", "conv", "n", "kids", "leaves", "saved", "parent", "up_a", "up_b")
    out: dict[str, list[np.ndarray]] = {c: [] for c in names}
    tops: list[tuple[np.ndarray, ...]] = []
    by_depth = np.argsort(-d, kind="stable")
    begin, count, depth = 0, 0, int(d.max())
    # of what came up: its piece, least id, figures, and which node it is
    up = [np.empty(0, np.int64)] * 7
    while True:
        end = int(np.searchsorted(-d[by_depth], -depth, side="right"))
        new = by_depth[begin:end]
        begin = end
        rep, least, many, below, leaf, save, node = (np.concatenate(x) for x in zip(up, (new, conv[new], n[new], kids[new], leaves[new], saved[new], np.full(len(new), -1)), strict=True))
        if depth:
            x, y = a.flat[a.start[rep] + depth - 1], b.flat[b.start[rep] + depth - 1]
        else:
            x = y = np.zeros(len(rep), np.int64)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        edge = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        who = rep[order][edge]
        least, many, below, leaf, save = (f.reduceat(v[order], edge) for f, v in ((np.minimum, least), (np.add, many), (np.add, below), (np.add, leaf), (np.add, save)))
        if depth:
            save = save + (many - 1) * w.flat[w.start[who] + depth - 1]
        leaf = np.where(below == 0, 1, leaf)
        group = np.empty(len(rep), np.int64)
        group[order] = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(rep)]])))
        for_node = node >= 0
        if for_node.any():
            out["parent"][-1][node[for_node]] = least[group[for_node]]
        more = depth > 1
        up_a, up_b = (v.flat[v.start[who] + depth - 2] if more else np.zeros(len(who), np.int64) for v in (a, b))
        for c, v in zip(names, (np.full(len(who), depth), x[edge], y[edge], least, many, below, leaf, save, np.full(len(who), -1), up_a, up_b), strict=True):
            out[c].append(v)
        inner = depth > top[who]
        is_top = ~inner
        tops.append((who[is_top], np.full(int(is_top.sum()), depth), least[is_top], many[is_top], leaf[is_top], save[is_top]))
        out.setdefault("outer", []).append(is_top)
        up = [who[inner], least[inner], many[inner], np.ones(int(inner.sum()), np.int64), leaf[inner], save[inner], np.flatnonzero(inner)]
        if inner.any():
            depth -= 1
        elif begin < len(by_depth):
            depth = int(d[by_depth[begin]])
        else:
            break
    flat = {c: np.concatenate(v) for c, v in out.items()}
    count = len(flat["d"])
    outer = flat["outer"]
    nulls, no_list = lambda t: pa.nulls(count, t), pa.nulls(count, pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(count, bool)), pa.array(flat["d"].astype(np.int32)), *(pa.array(flat[c]) for c in ("a", "b", "conv", "n", "kids", "leaves", "saved")), no_list, no_list, nulls(pa.list_(pa.int32())),
         pa.array(flat["parent"], mask=outer), pa.array(flat["up_a"], mask=~outer), pa.array(flat["up_b"], mask=~outer)], names=[x.split()[0] for x in _NODE.split(", ")])
    who, depth, least, many, leaf, save = (np.concatenate(x) for x in zip(*tops, strict=True))
    on = depth > 0
    who, depth, least, many, leaf, save = (v[on] for v in (who, depth - 1, least, many, leaf, save))
    if len(who):
        key = [np.where(depth > 0, v.flat[v.start[who] + np.maximum(depth, 1) - 1], 0) for v in (a, b)]
        none = pa.nulls(len(who), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(who), bool)), pa.array(depth.astype(np.int32)), *map(pa.array, key), pa.array(least), pa.array(many), pa.array(np.ones(len(who), np.int64)), pa.array(leaf), pa.array(save), a.cut(who, depth), b.cut(who, depth), w.cut(who, depth),
             none, none, none], names=[x.split()[0] for x in _NODE.split(", ")])


def _peeled(ready: DataFrame) -> DataFrame:
    """_NODE rows of pieces with the depth of their unit, whose prefix there is the unit's name."""
    inside = F.col("top") > 0
    unit = [F.when(inside, F.get(F.col(p), F.col("top") - 1)).otherwise(0).alias(u) for p, u in (("pa", "unit_a"), ("pb", "unit_b"))]
    dealt = ready.select("top", *unit, *[x.split()[0] for x in _PIECE.split(", ")])
    keys = ["top", "unit_a", "unit_b"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = np.stack([whole.column(k).to_numpy() for k in range(3)])
            change = np.flatnonzero((x[:, 1:] != x[:, :-1]).any(0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from peel(pa.RecordBatch.from_struct_array(whole.slice(0, cut).to_struct_array()))
            held = [whole.slice(cut)]
        if held:
            yield from peel(held[0])

    return dealt.repartition(shuffle_partitions(ready.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, _NODE)


def _units(pieces: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The pieces with `top`, the depth of the shortest prefix that isn't crowded (over their own where all are), and whether
    the root is crowded. A prefix is crowded if several pieces with over `limit` turns together begin with it."""
    count, turns = pieces.agg(F.count("*"), F.sum("d")).first()
    if count < 2 or turns <= limit:
        return pieces.withColumn("top", F.lit(0)), False
    prefixes = pieces.select("d", "a", "b", F.posexplode(F.arrays_zip("pa", "pb")).alias("k", "p")).select("d", "a", "b", "k", F.col("p.pa").alias("x"), F.col("p.pb").alias("y"))
    crowded = prefixes.groupBy("k", "x", "y").agg(F.count("*").alias("rows"), F.sum("d").alias("turns")).where((F.col("rows") > 1) & (F.col("turns") > limit)).select("k", "x", "y", "rows")
    crowded = stored(crowded)
    met = looked_up(among(prefixes, crowded, "k", "x", "y"), crowded, ["k", "x", "y"], "rows", turns)
    deepest = met.groupBy("d", "a", "b").agg(F.max("k").alias("k"))
    return pieces.join(deepest, ["d", "a", "b"], "left").withColumn("top", F.coalesce(F.col("k") + 2, F.lit(1))).drop("k"), True


def prefix_trie(seqs: DataFrame, limit: int = UNIT_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of (conv_id, turns), which sequences() or grafted() give.

    Nodes: d, a, b (depth and hash, the key), conv (least member), parent (the parent's), n (members), kids (children), leaves
    (childless nodes at and below), saved (at and below, (n - 1) x words of the last turn). Ends: d, a, b, conv_id
    of the node at which each conversation ends. A conversation without turns is a member of the root alone; an empty
    table has no root. Turns are told by 128-bit hashes. One conversation's turns must fit into a task."""
    chains = stored(_chains(seqs))
    arrays = F.first(F.struct("pa", "pb", "w"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    pieces = chains.groupBy("d", "a", "b").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), arrays.alias("of")).select("d", "a", "b", "conv", "n", *zero, "of.pa", "of.pb", "of.w")
    rounds: list[DataFrame] = []
    crowded = True
    while crowded:
        pieces, crowded = _units(stored(pieces), limit)
        pieces = stored(pieces) if crowded else pieces
        made = stored(_peeled(pieces.where("top <= d")))
        rounds.append(made.where("is_node"))
        left = pieces.where("top > d").drop("top").unionByName(made.where("NOT is_node").select(*[x.split()[0] for x in _PIECE.split(", ")]))
        sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
        pieces = left.groupBy("d", "a", "b").agg(F.min("conv").alias("conv"), *sums, arrays.alias("of")).select("d", "a", "b", "conv", "n", "kids", "leaves", "saved", "of.pa", "of.pb", "of.w")
    keep = ["d", "a", "b", "conv", "parent", "n", "kids", "leaves", "saved"]
    nodes = rounds[0]
    for x in rounds[1:]:
        nodes = nodes.unionByName(x)
    if len(rounds) > 1:
        # parents of the tops of units were crowded nodes, which later rounds have made
        later = rounds[1]
        for x in rounds[2:]:
            later = later.unionByName(x)
        tops = nodes.where("up_a IS NOT NULL AND d > 0").drop("parent")
        found = later.select((F.col("d") + 1).alias("d"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("parent"), "kids")
        met = looked_up(tops.withColumnRenamed("kids", "own"), found, ["d", "up_a", "up_b"], "kids", tops.count())
        nodes = nodes.where("up_a IS NULL OR d = 0").select(keep).unionByName(met.drop("kids").withColumnRenamed("own", "kids").select(keep))
    return nodes.select(keep), chains.select("d", "a", "b", "conv_id")


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256): SHA-256 of the decimal ids, ascending and joined by commas, of the conversations that end at a node.

    Ids are dealt by ranges and joined to blocks of up to IDS; the blocks of a node then pass through its digest one after the
    other, so that no list of a node's ids is held."""
    keys = ["d", "a", "b"]

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            d, a, b, conv = (c.to_numpy() for c in batch.columns)
            if not len(d):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            edge = np.unique(np.concatenate([edge, *(np.arange(x, y, IDS) for x, y in zip(edge, [*edge[1:], len(d)], strict=True) if y - x > IDS)]))
            ends = [*edge[1:].tolist(), len(d)]
            texts = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(edge.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v[edge]) for v in (d, a, b, conv)] + [pa.array(texts)], names=[*keys, "first", "ids"])

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in it:
            rows = []
            for d, a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, a, b) != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(rows)
        if key is not None:
            yield made([(*key, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        d, a, b, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], names=[*keys, "ends_sha256"])

    parts = shuffle_partitions(ends.sparkSession)
    blocks = ends.repartitionByRange(parts, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(join, "d int, a long, b long, first long, ids string")
    return blocks.repartition(parts, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "d int, a long, b long, ends_sha256 string")


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """nodes of ungrafted sequences() with role and text of their last turn, null at the root."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), *_turn(), "role", "text").withColumn("d", place)
    return nodes.join(rows.select(F.col("conv_id").alias("conv"), "d", "role", "text"), ["conv", "d"], "left")


def trie_report(seqs: DataFrame, limit: int = UNIT_TURNS) -> DataFrame:
    """The nodes of prefix_trie() with the digests of their ends."""
    nodes, ends = prefix_trie(seqs, limit)
    out = nodes.join(end_digests(ends), ["d", "a", "b"], "left")
    long = {"conv_id": "conv", "depth": "d", "parent_conv_id": "parent", "n_convs": "n", "n_children": "kids", "n_leaves": "leaves", "saved_tokens": "saved"}
    return out.select(*[F.col(v).cast("long").alias(k) for k, v in long.items()], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
