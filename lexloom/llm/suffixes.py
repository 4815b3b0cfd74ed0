"""Removal of byte strings that earlier documents hold, by sorted suffixes.

Only suffixes that may share WIDTH bytes are sorted. Every string of WIDTH bytes has an anchor: of the
GRAM-byte strings in it the one whose hash is least. Equal strings have equal anchors at equal places,
so that a string can only repeat among the occurrences of its anchor. The strings of one occurrence
lie in its context, the bytes that they cover. Occurrences of equal contexts form a class; all but the
earliest document of a class repeat everything in it, and the earliest documents of the classes of one
anchor are told apart by a sort of the suffixes that start in their contexts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from .common import batches, give_back, id_key, mix, powers, shuffle_partitions, utf8

WIDTH, GRAM = 50, 18
#: Anchors with more classes than this have their strings sent one by one, under their own hashes.
CROWDED = 4096
#: Bytes of text that are worked on together, and anchors that a task holds before it sends them.
_BLOCK, HELD = 200_000, 500_000
#: Bytes of text that one group of documents, and one part of the anchors, stands for.
GROUP_BYTES, PART_BYTES = 4_000_000, 8_000_000
_ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LOW40 = np.uint64((1 << 40) - 1)


class Block:
    """Joined texts with their prefix hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.length)
        self.hash = prefix_hashes(self.data, _ODD)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.hash[end] - self.hash[start]) * powers(pow(_ODD, -1, 1 << 64), len(self.hash))[start])

    def second_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = prefix_hashes(self.data, _ODD2)
        return mix((h[end] - h[start]) * powers(pow(_ODD2, -1, 1 << 64), len(h))[start])

    def anchors(self) -> dict[str, np.ndarray]:
        """Occurrences of anchors: text, first and last string start, place, hashes of anchor and context.

        Least hashes are small numbers, so that they are mixed again before parts are told by them."""
        n = len(self.data) - WIDTH + 1
        names = ("doc", "first", "last", "at", "code", "context")
        if n <= 0:
            return {k: np.empty(0, np.uint64 if k in ("code", "context") else np.int64) for k in names}
        k = len(self.data) - GRAM + 1
        gram = mix((self.hash[GRAM:] - self.hash[:-GRAM]) * powers(pow(_ODD, -1, 1 << 64), k))
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(k, dtype=np.uint64)
        span, width = 1, WIDTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: n], least[width - span : width - span + n])
        doc = np.repeat(np.arange(len(self.length)), self.length)[:n]
        start = np.flatnonzero(np.arange(n) + WIDTH <= self.end[doc])
        at, doc = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), doc[start]
        edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else np.empty(0, np.int64)
        first, last = start[edge], start[np.concatenate((edge[1:], [len(at)])) - 1] if len(at) else start
        at, doc = at[edge], doc[edge]
        context = mix(self.hashes(first, last + WIDTH) + (at - first).astype(np.uint64) * np.uint64(_ODD2))
        return {"doc": doc, "first": first, "last": last, "at": at, "code": mix(gram[at] ^ np.uint64(_ODD2)), "context": context & _LOW40}


def prefix_hashes(data: np.ndarray, odd: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(odd, len(data)), out=out[1:])
    return out


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    return ((code >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


# Columns of numbers travel as bytes: 40-bit numbers as four bytes and one, ids as differences from the least one.


def put40(x: np.ndarray) -> list[bytes]:
    return [x.astype("<u4").tobytes(), (x >> np.uint64(32)).astype(np.uint8).tobytes()]


def get40(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)


def put_ids(x: np.ndarray) -> bytes:
    base = int(x.min()) if len(x) else 0
    wide = len(x) and int(x.max()) - base >= 1 << 32
    return np.int64(base).tobytes() + (x.astype("<i8") if wide else (x - base).astype("<u4")).tobytes()


def get_ids(b: bytes, n: int) -> np.ndarray:
    if len(b) - 8 == 8 * n and n:
        return np.frombuffer(b, "<i8", offset=8).copy()
    return np.frombuffer(b, "<u4", offset=8).astype(np.int64) + np.frombuffer(b, "<i8", 1)[0]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


_SEEN = "p int, q int, low binary, high binary, clow binary, chigh binary, ids binary"
_CLASSES = "q int, low binary, high binary, top binary, clow binary, chigh binary, ids binary, flag binary"
_SENT = "p int, q int, kind int, code binary, context binary, ids binary, at binary, run binary, data binary"
_MASKS = "q int, kind int, code binary, context binary, mask binary"
_KEPT = ", kept binary"
_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted rows differ from the row before, the first included."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _seen(q: np.ndarray, ids: np.ndarray, texts: list[bytes], parts: int):
    """For every group q and part p: the anchors' classes, each with its smallest and its greatest id.

    A class may come in several rows; rows go out each time that HELD anchors have come together."""
    found: list[dict[str, np.ndarray]] = []
    for a, b in batches([len(t) for t in texts], _BLOCK):
        x = Block(texts[a:b]).anchors()
        found.append({"q": q[a:b][x["doc"]], "id": ids[a:b][x["doc"]], "code": x["code"], "context": x["context"]})
        if sum(len(f["q"]) for f in found) >= HELD:
            yield _seen_rows(found, parts)
            found = []
    yield _seen_rows(found, parts)


def _seen_rows(found: list[dict[str, np.ndarray]], parts: int) -> list[tuple]:
    if not sum(len(f["q"]) for f in found):
        return []
    q, ids, code, context = (np.concatenate([f[k] for f in found]) for k in ("q", "id", "code", "context"))
    order = np.lexsort((ids, context, code, q))
    q, ids, code, context = q[order], ids[order], code[order], context[order]
    first = _first_of_equal(q, code, context)
    last = np.append(first[1:], len(q)) - 1
    on = np.unique(np.concatenate((first, last[ids[last] != ids[first]])))
    q, ids, code, context = q[on], ids[on], code[on], context[on]
    p = part_of(code, parts)
    edge = np.append(_first_of_equal(q, p), len(q))
    return [(int(p[a]), int(q[a]), *put40(code[a:b] & _LOW40), *put40(context[a:b]), put_ids(ids[a:b])) for a, b in zip(edge, edge[1:], strict=False)]


def _classes(table: pa.Table, crowded: int) -> pa.Table:
    """Classes of one part that matter to some group: those of several documents, and those whose anchor has others."""
    rows = table.to_pylist()
    part = [get40(r["low"], r["high"]) for r in rows]
    code = np.concatenate(part)
    context = np.concatenate([get40(r["clow"], r["chigh"]) for r in rows])
    ids = np.concatenate([get_ids(r["ids"], len(x)) for r, x in zip(rows, part, strict=True)])
    q = np.repeat([r["q"] for r in rows], [len(x) for x in part])
    p = rows[0]["p"]
    order = np.lexsort((ids, context, code))
    code, context, ids, q = code[order], context[order], ids[order], q[order]
    anchor = _first_of_equal(code)
    of_anchor = np.repeat(np.arange(len(anchor)), np.diff(np.append(anchor, len(code))))
    first = _first_of_equal(code, context)
    of_class = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
    classes = np.bincount(of_anchor[first], minlength=len(anchor))
    several = np.maximum.reduceat(ids, anchor) != np.minimum.reduceat(ids, anchor)
    flag = np.where(classes[of_anchor] == 1, 0, np.where(classes[of_anchor] <= crowded, 1, 2)).astype(np.uint8)
    least = ids[first][of_class]
    on = several[of_anchor]
    out = []
    code, context, least, flag, q = code[on], context[on], least[on], flag[on], q[on]
    order = np.lexsort((context, code, q))
    order = order[_first_of_equal(q[order], code[order], context[order])]
    code, context, least, flag, q = (x[order] for x in (code, context, least, flag, q))
    edge = np.append(_first_of_equal(q), len(q)) if len(q) else [0]
    for a, b in zip(edge, edge[1:], strict=False):
        out.append((int(q[a]), *put40(code[a:b]), np.int32(p).tobytes(), *put40(context[a:b]), put_ids(least[a:b]), flag[a:b].tobytes()))
    return _rows(out, _schema(_CLASSES))


class Known:
    """What a group has heard about its classes, sorted by a hash of their names."""

    def __init__(self, rows: list[dict]):
        sizes = [len(r["flag"]) for r in rows]
        empty = np.empty(0, np.uint64)
        code = np.concatenate([empty, *[get40(r["low"], r["high"]) for r in rows]])
        part = np.repeat(np.array([np.frombuffer(r["top"], np.int32)[0] for r in rows], np.uint64), sizes) if rows else empty
        context = np.concatenate([empty, *[get40(r["clow"], r["chigh"]) for r in rows]])
        self.key = _class_key(part, code, context)
        order = np.argsort(self.key)
        self.key, self.part, self.code, self.context = self.key[order], part[order], code[order], context[order]
        self.least = np.concatenate([np.empty(0, np.int64), *[get_ids(r["ids"], n) for r, n in zip(rows, sizes, strict=True)]])[order]
        self.flag = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(r["flag"], np.uint8) for r in rows]])[order]

    def find(self, code: np.ndarray, context: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that are known, and their places here."""
        part, low = part_of(code, parts).astype(np.uint64), code & _LOW40
        key = _class_key(part, low, context)
        at = np.searchsorted(self.key, key)
        on = np.flatnonzero(at < len(self.key))
        on = on[(self.code[at[on]] == low[on]) & (self.context[at[on]] == context[on]) & (self.part[at[on]] == part[on])]
        return on, at[on]


def _class_key(part: np.ndarray, code: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One number for a class to be sorted and looked up by; what it is made of is compared then."""
    return mix(mix(code * np.uint64(_ODD) + part) ^ context * np.uint64(_ODD2))


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return data[:0]
    return data[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)]


def _send(table: pa.Table, known: pa.Table, parts: int) -> pa.Table:
    """Contexts of this group's documents that are the earliest of a class beside other classes."""
    if not table.num_rows or not known.num_rows:
        return _rows([], _schema(_SENT))
    heard, q = Known(known.to_pylist()), table.column("q")[0].as_py()
    ids, texts = table.column("id").to_numpy(), table.column("data").to_pylist()
    out: list[tuple] = []
    gathered: dict[str, list] = {k: [] for k in ("code", "context", "id", "at", "run", "data")}
    single: list[tuple] = []
    for a, b in batches([len(t) for t in texts], _BLOCK):
        block = Block(texts[a:b])
        x = block.anchors()
        on, at = heard.find(x["code"], x["context"], parts)
        mine = ids[a:b][x["doc"][on]] == heard.least[at]
        on, at = on[mine], at[mine]
        _, once = np.unique(at, return_index=True)  # a class of a document once
        on, flag = on[once], heard.flag[at[once]]
        plain = on[flag == 1]
        gathered["code"].append(x["code"][plain])
        gathered["context"].append(x["context"][plain])
        gathered["id"].append(ids[a:b][x["doc"][plain]])
        gathered["at"].append((x["at"] - x["first"])[plain].astype(np.uint8))
        gathered["run"].append((x["last"] - x["first"] + 1)[plain].astype(np.uint8))
        gathered["data"].append(_gather(block.data, x["first"][plain], (x["last"] - x["first"])[plain] + WIDTH))
        crowded = on[flag == 2]
        if len(crowded):
            start, owner = _starts(x["first"][crowded], x["last"][crowded])
            single.append((block.hashes(start, start + WIDTH), block.second_hashes(start, start + WIDTH), ids[a:b][x["doc"][crowded]][owner]))
    code, context, own, at, run, data = (np.concatenate(gathered[k]) for k in ("code", "context", "id", "at", "run", "data"))
    size = run.astype(np.int64) + WIDTH - 1
    begin = np.cumsum(size) - size
    p = part_of(code, parts)
    order = np.argsort(p, kind="stable")
    edge = np.append(_first_of_equal(p[order]), len(order)) if len(order) else [0]
    for a, b in zip(edge, edge[1:], strict=False):
        on = order[a:b]
        out.append((int(p[on[0]]), q, 0, code[on].tobytes(), context[on].tobytes(), own[on].tobytes(), at[on].tobytes(), run[on].tobytes(), _gather(data, begin[on], size[on]).tobytes()))
    if single:
        one, two, own = (np.concatenate(c) for c in zip(*single, strict=True))
        p = part_of(one, parts)
        order = np.lexsort((own, two, one, p))
        order = order[_first_of_equal(p[order], one[order], two[order], own[order])]
        edge = np.append(_first_of_equal(p[order]), len(order))
        out += [(int(p[order[a]]), q, 1, one[order[a:b]].tobytes(), two[order[a:b]].tobytes(), own[order[a:b]].tobytes(), b"", b"", b"") for a, b in zip(edge, edge[1:], strict=False)]
    return _rows(out, _schema(_SENT))


def _starts(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All string starts from first to last, and whose they are."""
    n = last - first + 1
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + first[owner], owner


class Suffixes:
    """Suffixes of joined bytes, compared by their first WIDTH bytes.

    How far two agree is found by binary search over prefix hashes, so that a comparison takes a number
    of steps that grows with the logarithm of the width; the next byte decides."""

    def __init__(self, data: np.ndarray, start: np.ndarray, hashes: np.ndarray | None = None):
        self.data, self.start = data, start
        self.hash = prefix_hashes(data, _ODD) if hashes is None else hashes
        self.back = powers(pow(_ODD, -1, 1 << 64), len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of common beginnings of suffixes x and y, up to WIDTH."""
        a, b = self.start[x], self.start[y]
        ha, hb, pa_, pb = self.hash[a], self.hash[b], self.back[a], self.back[b]
        low, step = np.zeros(len(a), np.int64), 1 << (WIDTH.bit_length() - 1)
        while step:
            longer = low + step
            fits = longer <= WIDTH
            longer = np.where(fits, longer, low)
            same = (self.hash[a + longer] - ha) * pa_ == (self.hash[b + longer] - hb) * pb
            low = np.where(same & fits, longer, low)
            step >>= 1
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x is below, equal to or above suffix y in their first WIDTH bytes."""
        n = self.common(x, y)
        at = np.minimum(n, WIDTH - 1)
        a, b = self.data[self.start[x] + at].astype(np.int16), self.data[self.start[y] + at].astype(np.int16)
        return np.where(n >= WIDTH, 0, np.sign(a - b)).astype(np.int8)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Places of the suffixes, sorted within runs of equal `group`, by merging ever longer runs.

        In each round every suffix finds its rank in the run beside its own by binary search."""
        n = len(group)
        order = np.arange(n)
        first = _first_of_equal(group)
        size = np.diff(np.append(first, n))
        origin, count = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(n) - origin  # the place in the group, of what stands at each index
        run = 1
        while run < size.max(initial=0):
            active = np.flatnonzero(count > run)
            inside, base = place[active], origin[active]
            block = inside // run
            other = block ^ 1
            low = np.minimum(other * run, count[active])
            high = np.minimum(low + run, count[active])
            left, right = low.copy(), high.copy()
            is_left = block < other
            while True:
                open_ = np.flatnonzero(left < right)
                if not len(open_):
                    break
                mid = (left[open_] + right[open_]) // 2
                c = self.compare(order[base[open_] + mid], order[active[open_]])
                below = np.where(is_left[open_], c < 0, c <= 0)  # equal ones of the left run stay in front
                left[open_] = np.where(below, mid + 1, left[open_])
                right[open_] = np.where(below, right[open_], mid)
            target = base + np.minimum(block, other) * run + inside % run + (left - low)
            moved = order.copy()
            moved[target] = order[active]
            order = moved
            run *= 2
        return order

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the first WIDTH bytes are the same, by the bytes."""
        same = np.ones(len(x), bool)
        words = np.ndarray(len(self.data) - 7, "<u8", np.ascontiguousarray(self.data).data, strides=(1,))
        for at in [*range(0, WIDTH - 7, 8), WIDTH - 8]:
            same &= words[self.start[x] + at] == words[self.start[y] + at]
        return same


def _masks(code: np.ndarray, ids: np.ndarray, at: np.ndarray, run: np.ndarray, contexts: Suffixes) -> np.ndarray:
    """For each context: which of its strings one of an earlier document among them holds, as bits."""
    mask = np.zeros(len(run), np.uint64)
    start, owner = _starts(np.zeros(len(run), np.int64), run.astype(np.int64) - 1)
    # equal strings lie equally far before their anchor
    _, anchor = np.unique(code, return_inverse=True)
    group = anchor[owner] * 64 + at[owner].astype(np.int64) - start
    order = np.argsort(group, kind="stable")
    group, owner, start = group[order], owner[order], start[order]
    more = np.diff(np.append(_first_of_equal(group), len(group)))
    on = np.repeat(more > 1, more)
    group, owner, start = group[on], owner[on], start[on]
    if not len(group):
        return mask
    suffixes = Suffixes(contexts.data, contexts.start[owner] + start, contexts.hash)
    order = suffixes.sort(group)
    x, y = order[:-1], order[1:]
    same = (group[:-1] == group[1:]).copy()  # sorting stays within groups
    same[same] = suffixes.common(x[same], y[same]) >= WIDTH
    same[same] = suffixes.equal_bytes(x[same], y[same])
    run_id = np.concatenate(([0], np.cumsum(~same)))
    own = ids[owner[order]]
    least = np.full(run_id[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run_id, own)
    later = own > least[run_id]
    np.bitwise_or.at(mask, owner[order][later], np.uint64(1) << start[order][later].astype(np.uint64))
    return mask


def _sorted_masks(table: pa.Table) -> pa.Table:
    """For each context of a part: which of its strings an earlier document's context holds, as bits."""
    give_back()
    rows = table.to_pylist()
    out = []
    contexts = [r for r in rows if r["kind"] == 0]
    if contexts:
        u64 = lambda k, kind="<u8": [np.frombuffer(r[k], kind) for r in contexts]
        code, context, ids, at, run = (np.concatenate(x) for x in (u64("code"), u64("context"), u64("ids", "<i8"), u64("at", np.uint8), u64("run", np.uint8)))
        data = np.concatenate(u64("data", np.uint8))
        source = np.repeat(np.arange(len(contexts)), [len(r["run"]) for r in contexts])
        size = run.astype(np.int64) + WIDTH - 1
        begin = np.cumsum(size) - size
        start, owner = _starts(np.zeros(len(run), np.int64), run.astype(np.int64) - 1)
        # anchors by the few, so that memory doesn't grow with the part
        mask = np.zeros(len(run), np.uint64)
        by_anchor = np.argsort(code, kind="stable")
        first = np.append(_first_of_equal(code[by_anchor]), len(code))
        hashes = prefix_hashes(data, _ODD)
        for x, y in batches(np.diff(first).tolist(), HELD // 50):
            on = by_anchor[first[x] : first[y]]
            mask[on] = _masks(code[on], ids[on], at[on], run[on], Suffixes(data, begin[on], hashes))
        for i, r in enumerate(contexts):
            on = np.flatnonzero((source == i) & (mask != 0)) if len(contexts) < 64 else np.flatnonzero(mask[(lo := np.searchsorted(source, i)) : np.searchsorted(source, i + 1)]) + lo
            if len(on):
                out.append((r["q"], 0, code[on].tobytes(), context[on].tobytes(), mask[on].tobytes()))
    singles = [r for r in rows if r["kind"] == 1]
    if singles:
        one, two, ids = (np.concatenate([np.frombuffer(r[k], kind) for r in singles]) for k, kind in (("code", "<u8"), ("context", "<u8"), ("ids", "<i8")))
        q = np.repeat([r["q"] for r in singles], [len(r["ids"]) // 8 for r in singles])
        order = np.lexsort((ids, two, one))
        one, two, ids, q = one[order], two[order], ids[order], q[order]
        first = _first_of_equal(one, two)
        least = np.repeat(ids[first], np.diff(np.append(first, len(one))))
        later = np.flatnonzero(ids > least)
        later = later[np.argsort(q[later], kind="stable")]
        edge = np.append(_first_of_equal(q[later]), len(later)) if len(later) else [0]
        out += [(int(q[later[a]]), 1, one[later[a:b]].tobytes(), two[later[a:b]].tobytes(), ids[later[a:b]].tobytes()) for a, b in zip(edge, edge[1:], strict=False)]
    return _rows(out, _schema(_MASKS))


def _removed(table: pa.Table, known: pa.Table, parts: int):
    """For blocks of a group's texts: the block, its row numbers, and which bytes go."""
    rows = known.to_pylist()
    heard = Known([r for r in rows if r["flag"] is not None])
    plain = [r for r in rows if r["flag"] is None and r["kind"] == 0]
    u8 = lambda part, k, kind="<u8": np.concatenate([np.empty(0, np.dtype(kind)), *[np.frombuffer(r[k], kind) for r in part]])
    code, context, mask = (u8(plain, k) for k in ("code", "context", "mask"))
    name = code ^ mix(context.copy())
    order = np.argsort(name)
    name, code, context, mask = name[order], code[order], context[order], mask[order]
    single = [r for r in rows if r["flag"] is None and r["kind"] == 1]
    one, two, whose = (u8(single, k) for k in ("code", "context", "mask"))
    strings = mix(one.copy()) ^ two ^ mix(whose.copy())
    order = np.argsort(strings)
    strings, one, two, whose = strings[order], one[order], two[order], whose[order]
    ids, texts = table.column("id").to_numpy(), table.column("data").to_pylist()
    for a, b in batches([len(t) for t in texts], _BLOCK):
        block = Block(texts[a:b])
        change = np.zeros(len(block.data) + 1, np.int32)
        x = block.anchors()
        on, at = heard.find(x["code"], x["context"], parts)
        own = ids[a:b][x["doc"][on]]
        full = own > heard.least[at]
        for sign, where in ((1, x["first"][on[full]]), (-1, x["last"][on[full]] + WIDTH)):
            np.add.at(change, where, sign)
        part = ~full & (heard.flag[at] == 1)
        some = on[part]
        if len(some) and len(name):
            wanted = x["code"][some] ^ mix(x["context"][some].copy())
            found = np.minimum(np.searchsorted(name, wanted), len(name) - 1)
            hit = (code[found] == x["code"][some]) & (context[found] == x["context"][some])
            start, owner = _starts(x["first"][some[hit]], x["last"][some[hit]])
            bits = mask[found[hit]][owner] >> (start - x["first"][some[hit]][owner]).astype(np.uint64) & np.uint64(1)
            start = start[bits == 1]
            np.add.at(change, start, 1)
            np.add.at(change, start + WIDTH, -1)
        some = on[~full & (heard.flag[at] == 2)]
        if len(some) and len(strings):
            start, owner = _starts(x["first"][some], x["last"][some])
            own = block.hashes(start, start + WIDTH), block.second_hashes(start, start + WIDTH), ids[a:b][x["doc"][some]][owner].astype(np.uint64)
            wanted = mix(own[0].copy()) ^ own[1] ^ mix(own[2].copy())
            found = np.minimum(np.searchsorted(strings, wanted), len(strings) - 1)
            start = start[(one[found] == own[0]) & (two[found] == own[1]) & (whose[found] == own[2])]
            np.add.at(change, start, 1)
            np.add.at(change, start + WIDTH, -1)
        yield block, a, b, np.cumsum(change[:-1]) > 0


def _finish(table: pa.Table, known: pa.Table, parts: int, with_rows: bool) -> pa.Table:
    give_back()
    ids, data, out = table.column("id").to_pylist(), table.column("data").to_pylist(), []
    for block, a, b, gone in _removed(table, known, parts):
        begin = block.end - block.length
        rises = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
        for i in range(b - a):
            own = slice(begin[i], block.end[i])
            cut, n = gone[own], int(block.length[i])
            spans = int(rises[own].sum()) + int(n > 0 and cut[0] and not rises[begin[i]])
            kept = block.data[own][~cut].tobytes() if spans else data[a + i]
            row = (ids[a + i], n, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest())
            # characters that were cut in part go
            out.append((*row, kept.decode(errors="ignore").encode() if spans else kept) if with_rows else row)
    done = _rows(out, _schema(_RESULT + _KEPT * with_rows))
    return done.append_column("rest", table.column("rest")) if with_rows else done


def _grouped(docs: DataFrame, groups: int, tasks: int, *rest: Column) -> DataFrame:
    rows = docs.select(id_key().alias("id"), utf8().alias("data"), *rest)
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("q"), *rows.columns).repartition(tasks, "q")


def with_kept_text(docs: DataFrame) -> DataFrame:
    """`docs` with their kept texts, and n_chars as the new length where there is such a column.

    Other columns, of any names, travel with the texts. Null texts stay null."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("none"), *fields)
    out = _results(docs, CROWDED, rest.alias("rest"))
    kept = F.when(~F.col("rest.none"), F.col("kept").cast("string"))
    columns = []
    for i, c in enumerate(docs.columns):
        if c == "text":
            columns.append(kept.alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_removed") == 0, F.col(f"rest.c{i}")).otherwise(F.length(kept)).cast("long").alias(c))
        else:
            columns.append(F.col(f"rest.c{i}").alias(c))
    return out.select(*columns)


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Texts are UTF-8 bytes. A byte goes if one of the WIDTH-byte strings over it also starts in a
    document of smaller doc_id, judged on the input; repeats inside a document, or among rows of one
    id, stay. Null and empty texts have no bytes; rows without an id count as smallest and keep a null
    id. Further columns are left out; an empty table gives an empty one.

    Documents are dealt once, by a hash of the id, into groups of about GROUP_BYTES (a longer document is a group of
    its own size); anchors are dealt into parts. How many there are follows from the size of the texts, not from
    the number of partitions: what a group has for a part is packed into one row, and there are never more packs than
    anchors. The passes share the shuffle of the texts. The first sends each group's classes, 12 bytes or so for every
    17 of text, the second only the contexts of classes beside others.

    Equal contexts are told by 80 hashed bits (40 of the context, 40 of its anchor) beside the part, and their bytes
    aren't compared, as that would move most of the text twice: at 100 TB, with some 10 ** 6 classes in each of 10 ** 7
    parts, one false pair is expected with a probability of about 10 ** -5. Strings of different contexts are told
    by sorted suffixes and then their bytes. Anchors with over `crowded` classes, as the ends of a line that very
    many documents hold, have their strings told by 128 hashed bits and the id instead and dealt by them, so that no
    task gets them all."""
    out = _results(docs, crowded).withColumnRenamed("id", "doc_id")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {-(2**63) + 1} - 1)"))


def _results(docs: DataFrame, crowded: int, *rest: Column) -> DataFrame:
    """A row for each text; given a column `rest`, also the kept bytes and that column."""
    tasks, with_rows = shuffle_partitions(docs.sparkSession), bool(rest)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, parts = size // GROUP_BYTES + 1, size // PART_BYTES + 1
    texts = _grouped(docs, groups, tasks, *rest)

    def seen(it):
        give_back()
        for batch in it:
            for rows in _seen(batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_pylist(), parts):
                yield from _rows(rows, _schema(_SEEN)).to_batches()

    classes = texts.mapInArrow(seen, _SEEN).groupBy("p").applyInArrow(lambda table: _classes(table, crowded), _CLASSES)
    heard = classes.groupBy("q")
    sent = texts.groupBy("q").cogroup(heard).applyInArrow(lambda left, right: _send(left, right, parts), _SENT)
    masks = sent.groupBy("p").applyInArrow(_sorted_masks, _MASKS)
    both = classes.select("*", F.lit(None).cast("int").alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("code", "context", "mask")])
    both = both.unionByName(masks, allowMissingColumns=True)
    schema = types.StructType.fromDDL(_RESULT + _KEPT * with_rows)
    if with_rows:
        schema.add(texts.schema["rest"])
    return texts.groupBy("q").cogroup(both.groupBy("q")).applyInArrow(lambda left, right: _finish(left, right, parts, with_rows), schema)
