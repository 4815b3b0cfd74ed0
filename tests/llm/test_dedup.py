"""SimHash, line and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lexloom.llm import lines, simhash, suffixes
from lexloom.operators.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def texts(seed, n=60):
    """Texts that share passages, with copies, near copies, empty, null and long ones."""
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(k))
    shared = [say(12) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [say(rnd.randrange(1, 25)) for _ in range(rnd.randrange(1, 5))] + rnd.sample(shared, rnd.randrange(0, 3))
        rnd.shuffle(parts)
        out.append((i, rnd.choice([" ", "\n"]).join(parts)))
    out += [(n + i, out[3 * i][1]) for i in range(8)]
    out += [(n + 20 + i, out[i][1].replace("1", "7", 1)) for i in range(12)]
    out += [(n + 40, ""), (n + 41, None), (n + 42, "  \n "), (n + 43, "é" * 400), (n + 44, "é" * 300), (n + 45, shared[0] * 200), (n + 46, "ab" * 30)]
    out += [(None, shared[1]), (n + 47, "x"), (n + 47, "x"), (n + 48, shared[2]), (n + 48, shared[2] + " z")]
    rnd.shuffle(out)
    return out


# --- SimHash


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_hashes_are_xxh64():
    rnd = np.random.default_rng(3)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    start = rnd.integers(0, 4700, 500)
    length = rnd.integers(0, 300, 500)
    got = simhash.xxh64(data, start, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(start, length, strict=True)]


def test_fingerprints_and_components(spark):
    rows = texts(1)
    got = simhash.near_components(table(spark, rows)).collect()
    fps = [fingerprint(t) for _, t in rows]
    root = roots(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, 1 << 62), -(1 << 63) if i is None else i)
    want = sorted((str(i), f"{f:016x}", least[r] if least[r] > -(1 << 62) else None) for (i, _), f, r in zip(rows, fps, root, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_chains_and_crowded_keys(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    close = {base}
    for _ in range(3000):  # far over one group's size under the same keys
        close.add(base ^ sum(1 << b for b in rnd.sample(range(40, 64), rnd.randrange(1, 4))))
    chain = [rnd.getrandbits(64)]
    for _ in range(12):
        chain.append(chain[-1] ^ sum(1 << b for b in rnd.sample(range(64), 3)))
    alone = [rnd.getrandbits(64) for _ in range(50)]
    every = [*close, *chain, *alone]
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    found = simhash.links(table(spark, [(x,) for x in signed], "fp long"))
    labels = {r.node: r.component for r in connected_components(found).collect()}
    of = [labels.get(x, x) for x in signed]
    assert len(set(of[: len(close)])) == 1 and len(set(of[len(close) : len(close) + 13])) == 1
    assert len(set(of)) == 2 + len(alone)


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(5, "a b c d e", "x"), (3, "a b c d e", "y"), (9, "q r s t", "z"), (None, "m n o", "w")], "doc_id long, text string, component_id string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


def test_empty_tables(spark):
    docs = table(spark, [])
    assert simhash.near_components(docs).count() == lines.dedup_lines(docs).count() == suffixes.remove_repeats(docs).count() == 0


# --- lines


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def deduped(rows):
    """(id, text, lines, exact, near) by comparing every line with every earlier one."""
    seen = sorted((-(1 << 63) if i is None else i, k, n, line) for k, (i, t) in enumerate(rows) if t is not None for n, line in enumerate(t.split("\n")) if line.strip(" \t\r\f\v"))
    gone = {}
    for at, (i, k, n, line) in enumerate(seen):
        words = line.split(" ")
        for j, k2, n2, other in seen[:at]:
            if (j, rows[k2][1]) == (i, rows[k][1]) and n2 >= n:
                continue
            more = other.split(" ")
            if other == line:
                gone[k, n] = "exact"
                break
            if len(words) >= 5 and len(more) >= 5 and one_edit(words, more):
                gone[k, n] = "near"
    out = []
    for k, (i, t) in enumerate(rows):
        own = [] if t is None else t.split("\n")
        kept = None if t is None else "\n".join(x for n, x in enumerate(own) if (k, n) not in gone)
        kinds = [gone.get((k, n)) for n in range(len(own))]
        out.append((str(i), kept, len(own), kinds.count("exact"), kinds.count("near")))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (4, 5, 5, 7, 8, 9, 15, 16, 17, 31, 33)]

    def edited(line):
        w = line.split(" ")
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            w[at : at + (kind != 0)] = [] if kind == 1 else [rnd.choice(WORDS)]
        return " ".join(w)

    rows = [(i, "\n".join(edited(rnd.choice(base)) for _ in range(rnd.randrange(1, 7)))) for i in range(50)]
    rows += [(60, ""), (61, None), (62, "\n \n\n"), (None, base[4]), (63, base[4] + "\n" + base[4]), (64, base[6] + " " * 3), (65, (base[10] + "\n") * 50)]
    got = lines.dedup_lines(table(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_exact, r.n_near) for r in got), key=str) == deduped(rows)


def test_lines_keep_columns_and_copies_of_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nz", 11, "k"), (1, "a b c d e\nz", 11, "k"), (2, "a b c d e\ny", 11, "l")], "doc_id long, text string, n_chars long, w string")
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_exact", "n_near"]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, "a b c d e\nz", 11), (1, "a b c d e\nz", 11), (2, "y", 1)]


# --- substrings


def stripped(rows, width=50):
    data = [((-(1 << 63) if i is None else i), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(None if i == -(1 << 63) else i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowded", [4096, 1])
def test_substrings_against_brute_force(spark, crowded):
    rows = texts(7)
    got = suffixes.remove_repeats(table(spark, rows), crowded=crowded).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == stripped(rows)


def test_suffix_sort_is_a_sort():
    rnd = np.random.default_rng(8)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1400] = data[2000:2400]
    start = rnd.integers(0, 3900, 3000)
    group = np.sort(rnd.integers(0, 40, 3000))
    sorter = suffixes.Suffixes(data, start)
    order = sorter.sort(group)
    got = [(group[i], data[start[i] : start[i] + 50].tobytes()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(3000)) and (group[order] == group).all()


def test_kept_text(spark):
    docs = table(spark, [(1, "é" * 60), (2, "a" + "é" * 60 + "b"), (3, None), (None, "c")])
    got = {r.doc_id: r.text for r in suffixes.with_kept_text(docs).collect()}
    assert got == {1: "é" * 60, 2: "ab", 3: None, None: "c"}


def test_clashing_names_stay(spark):
    text = "an earlier passage of well over fifty bytes that comes again in a later document"
    names = ["n_lines", "n_near", "__d", "__h", "__key", "__hash", "kept", "id", "q", "data", "rest", "lines", "h", "line"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, None if t is None else len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate([text, "x " + text + " y", None, "", "x " + text + " y"])]
    df = spark.createDataFrame(rows, schema)
    for got in (lines.dedup_lines(df, counts=False), suffixes.with_kept_text(df)):
        assert got.columns == df.columns
        assert sorted(tuple(r[n] for n in ("doc_id", *names)) for r in got.collect()) == sorted((r[0], *r[3:]) for r in rows)
        assert got.where("text IS NULL").count() == 1 and got.where("n_chars <> length(text)").count() == 0
    counted = lines.dedup_lines(df)
    assert counted.columns == [c for c in df.columns if c not in ("n_lines", "n_near")] + ["n_lines", "n_exact", "n_near"]
    assert {r.doc_id: (r.n_lines, r.n_exact) for r in counted.collect()} == {0: (1, 0), 1: (1, 0), 2: (0, 0), 3: (1, 0), 4: (1, 1)}


def test_substrings_over_many_partitions(spark):
    """Rows that are sent follow from the texts, not from the number of partitions."""
    rnd = random.Random(7)
    passage = " ".join(f"w{rnd.randrange(99)}" for _ in range(40))
    rows = [(i, " ".join(f"v{rnd.randrange(999)}" for _ in range(30)) + (passage if i % 3 == 0 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        got = {str(r.doc_id): r.n_removed for r in suffixes.remove_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: gone for i, _, gone, _, _ in stripped(rows)}
