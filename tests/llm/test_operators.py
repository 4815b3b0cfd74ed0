"""Scoring, formatting, fingerprint, search, token and packing operators against plain versions."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import chat, common, packing, resampling, sentencepiece, topk, toxicity, weighted
from lexloom.llm.queries import BYTE_BPE, PIECES

TEXTS = [None, "", " ", "a", "Hello world", "  two  blanks ", "line\nbreak\n\n", "tab\t end \n", "é ü 日本 ☃ 🙂", "x" * 5000, "word " * 3000, "it's 12 o'clock", "trailing \n  ", " nbsp", "<|endoftext|> a", "▁a ▁▁ b"]


def docs(spark, texts=TEXTS, first=0):
    rows = [(first + i, t, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


# --- packing


def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE_BPE)
    want = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    rows = packing.pack(docs(spark), BYTE_BPE, with_ids=True).collect()
    for i, ids in want.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) for r in own)
        assert [r.length for r in own] == sorted((r.length for r in own), reverse=True)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_words_cut_at_blanks_give_the_same_ids():
    bpe, rnd = packing.ByteBpe(BYTE_BPE), random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice("ab é\n\t  1.'s☃ ") for _ in range(rnd.randrange(15)))
        assert list(struct.unpack(f"<{len(bpe.ids(text)) // 4}I", bpe.ids(text))) == bpe.whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_large_batch_is_packed_in_bounded_parts(monkeypatch):
    texts = [*TEXTS, *(f"text {i} " + "word " * 400 for i in range(2000)), None, "z" * 1_500_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    frame, task = type("Frame", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: run})(), type("Task", (), {"partitionId": lambda self: 2})()
    monkeypatch.setattr(packing.TaskContext, "get", classmethod(lambda cls: task))
    out = list(packing.pack(frame, BYTE_BPE, with_ids=True)(iter([batch])))
    held = [sum(len(texts[i] or "") for i in set(x.column(0).to_pylist())) for x in out]
    assert len(out) >= 5 and max(held[:-1]) <= 1_000_000
    rows = [r for x in out for r in x.to_pylist()]
    assert [r["sequence_id"] for r in rows] == [(2 << 33) + i for i in range(len(rows))] and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    got, bpe = {}, packing.ByteBpe(BYTE_BPE)
    for r in rows:
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: [*struct.unpack(f"<{len(b := bpe.ids(t or '')) // 4}I", b), 1] for i, t in enumerate(texts)}


def test_workers_give_back_what_they_kept():
    common.powers(3, 3 << 20)
    common.give_back()
    assert not common._powers and list(common.powers(3, 4)) == [1, 3, 9, 27]


def test_binary_lengths():
    assert packing.binary_lengths(4096 + 13, 2048) == [2048, 2048, 8, 4, 1]
    with pytest.raises(ValueError):
        packing.pack(None, "", longest=3)


# --- chat


def test_chat_reads_back(spark):
    said = ["\\### Assistant: </turn> ok", None, "", "ends with \\", "### user: x</turn>\n", "a: b", "é🙂\n", "<|endoftext|>", "\\\\"]
    rows = [(i, j, r, t) for i in range(3) for j, (t, r) in enumerate((t, r) for t in said for r in ("user", "assistant", None, "odd: role"))] + [(9, 0, "assistant", "x"), (9, 0, "assistant", "x"), (None, None, None, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    turns = chat.format_turns(df, BYTE_BPE)
    got = {r.conv_id: r for r in chat.conversation_digests(turns, BYTE_BPE).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learned = "".join(t for _, role, t in own if role == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(own), len(learned))
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    formatted = "".join("### " + chat.escape(r, role=True) + ": " + chat.escape(t) + "</turn>\n" for r, t in [("u: x", a or "") for a in said])
    assert chat.read_text(formatted) == [("u: x", a or "") for a in said]
    assert chat.conversation_digests(chat.format_turns(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0


# --- fingerprints


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def test_likeness_estimates_generalised_jaccard():
    rnd = random.Random(2)
    for _ in range(12):
        a = [rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(60)]
        b = a[: rnd.randrange(10, 60)] + [rnd.choice("klmnop") for _ in range(rnd.randrange(40))]
        s = weighted.signatures([weighted.bag(" ".join(a)), weighted.bag(" ".join(b))], 2048)
        assert abs(weighted.likeness(*s) - jaccard(" ".join(a), " ".join(b))) < 0.05


def test_likenesses_of_pairs_are_near_exact_ones(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randrange(1, 3) for _ in range(rnd.randrange(20, 90))) for _ in range(40)]
    got = {r.doc_id: r for r in weighted.fingerprint_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples=1024).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]
        assert abs(got[i].near_next - jaccard(t, after)) < 0.08
        assert abs(got[i].near_edited - jaccard(t, weighted.edited(t, after))) < 0.08


def test_fingerprint_pairs(spark):
    rows = [(i, t) for i, t in zip([5, 3, 9, 1, 7, 2, None, 4, 4], ["a b c d", "a b c d", "x y", "", None, "q " * 500, "n o", "t u", "r s"], strict=True)]
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in weighted.fingerprint_pairs(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, near_next int")).collect()}
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    assert len(got) == len(rows)
    prints = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[(None if i == -(1 << 63) else i, len(t), hashlib.sha256(new.encode()).hexdigest())]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
        assert new != t or r.near_edited == 1
    lone = weighted.fingerprint_pairs(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert lone.near_next == 1
    assert weighted.fingerprint_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- search


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_search_is_exact(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (4 if kind == "few" else 400, 8)).round(3)
    if kind == "copies":
        x[50:300] = x[50]
    rows = [(int(i), [float(c) for c in v], "w") for i, v in enumerate(x)] + [(900, None, ""), (901, [float("nan")] + [0.0] * 7, ""), (902, [None] + [0.0] * 7, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5, pivots=4, annuli=4).collect()
    q = np.floor(x * 256).astype(int)
    s = q @ q.T
    want = []
    for i in range(0, len(x), 20):
        best = sorted((-s[i, j], j) for j in range(len(x)) if j != i)[:5]
        want += [(i, n + 1, j, -v) for n, (v, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# --- sentencepiece


def test_pieces_as_the_library_has_them(spark):
    import sentencepiece as lib

    plain = lib.SentencePieceProcessor(model_file=PIECES)
    own, rnd = sentencepiece.model(PIECES), random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice("ab é\n  ▁日☃x.9\tÀ") for _ in range(rnd.randrange(16))) for _ in range(3000)]
    for t in texts:
        ids = plain.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == plain.decode(ids), repr(t)
    rows = sentencepiece.round_trip(docs(spark), PIECES).collect()
    assert all(r.same or "▁" in TEXTS[r.doc_id] for r in rows if TEXTS[r.doc_id] is not None) and len(rows) == len(TEXTS)
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(docs(spark), PIECES), PIECES).collect()}
    assert back[4] == "Hello world" and back[0] == ""


def test_runs_of_blanks_as_the_library_has_them(spark):
    import sentencepiece as lib

    plain, own = lib.SentencePieceProcessor(model_file=PIECES), sentencepiece.model(PIECES)
    for n in [*range(70), 127, 500, 3001]:
        for t in (" " * n, " " * n + "the", "x" + " " * n + "日x", " " * n + "9  . ", "a" + " " * n + "\n"):
            assert own.encode(t) == plain.encode(t), repr(t)
    long = "a" + " " * 200_000 + "word" + " " * 200_000
    began = time.time()
    ids = own.encode(long)
    assert time.time() - began < 10 and own.decode(ids) == long
    assert sentencepiece.round_trip(docs(spark, ["", None, long]), PIECES).where("same").count() == 3
    assert sentencepiece.round_trip(docs(spark).limit(0), PIECES).count() == 0


def unigram_model(pieces):
    """A unigram model file of a few pieces, in the public format."""

    def field(n, kind, value):
        return bytes([n << 3 | kind]) + value

    def packed(b):
        return bytes([len(b)]) + b

    out = b""
    for p, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in pieces]:
        out += field(1, 2, packed(field(1, 2, packed(p.encode())) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))))
    normalizer = field(1, 2, packed(b"identity")) + field(3, 0, b"\1") + field(4, 0, b"\0") + field(5, 0, b"\1")
    return out + field(2, 2, packed(field(3, 0, b"\1"))) + field(3, 2, packed(normalizer))


def test_unigram_viterbi_as_the_library_has_it():
    import sentencepiece as lib

    rnd = random.Random(5)
    pieces = {"▁", "a", "b", "c"} | {"".join(rnd.choice("▁abc") for _ in range(rnd.randrange(2, 5))) for _ in range(40)}
    data = unigram_model([(p, -rnd.uniform(1, 9)) for p in sorted(pieces)])
    own, plain = sentencepiece.Model(data), lib.SentencePieceProcessor(model_proto=data)
    for _ in range(2000):
        t = "".join(rnd.choice("abc  x☃") for _ in range(rnd.randrange(12)))
        assert own.encode(t) == plain.encode(t), repr(t)


# --- resampling

M64 = (1 << 64) - 1


def spread_bits(x):
    """The published mixing of common.mix, one number at a time."""
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 32


def plain_buckets(text, buckets):
    """Words cut at ASCII blanks in lower case, their polynomial hashes, and those of neighbours joined, by integers alone."""
    odd, words = 0x9E3779B97F4A7C15, []
    for w in re.findall(rb"[^ \t-\r]+", (text or "").encode()):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        words.append(spread_bits(sum((c + 1) * pow(odd, k, 1 << 64) for k, c in enumerate(low)) & M64))
    pairs = [spread_bits((a * odd + b) & M64) for a, b in zip(words, words[1:], strict=False)]
    return [x % buckets for x in words + pairs]


def test_resampling(spark):
    good, bad = "the cat sat on the mat ", "ZZZ!! buy QQQ!! "
    texts = [(i, (good if i % 3 else bad) * (i % 7 + 1), "q") for i in range(90)] + [(90, None, ""), (91, "", ""), (None, good, ""), (1, good, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    df = spark.createDataFrame(texts, "doc_id long, text string, draw string")
    got = resampling.resample(df, labels, buckets=200).collect()
    assert len(got) == len(texts)
    kept = {r.doc_id for r in got if r.selected}
    assert sum(r.selected for r in got) == int(np.ceil(len(texts) * 40 / 60))
    assert sum(i in kept for i in range(90) if i % 3) > 50 and all(i in kept for i in range(90) if i % 3 and i % 7 > 2)
    # both models by hand
    raw, target = Counter(), Counter()
    for i, t, _ in texts:
        raw.update(plain_buckets(t, 200))
        if i is not None and i < 60 and i % 3:
            target.update(plain_buckets(t, 200))
    n, m = sum(raw.values()) + 200, sum(target.values()) + 200
    want = sum(np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n) for b in plain_buckets(texts[7][1], 200))
    assert abs(next(r.log_weight for r in got if r.doc_id == 7) - want) < 1e-6
    assert resampling.resample(df.limit(0), labels).count() == 0
    assert all(r.selected for r in resampling.resample(df, labels.limit(0)).collect())


def test_highest_needs_no_global_sort(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([rnd.uniform(-9, 9), 0.0, -1.5, 2.5, float(rnd.randrange(3))])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double")
    for k in (0, 1, 17, 250, 499, 500, 900):
        got = {r.id for r in resampling.highest(df, "v", "id", k).where("selected").collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}


# --- toxicity


def brute_kernel(s, t, order=3, decay=0.6):
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_and_machine_agree_with_subsequences():
    for s, t in (("idiot", "idxiot"), ("abcabc", "cabca"), ("ab", "abc"), ("moron", "morons")):
        assert np.isclose(toxicity.kernel(toxicity.codes([s]), toxicity.codes([t]))[0], brute_kernel(s, t))
    words, marks = ["idiot", "table", "iddiot", "ab"], ["idiot", "stable"]
    want = [[brute_kernel(w, m) / max(np.sqrt(brute_kernel(w, w) * brute_kernel(m, m)), 1e-6) for m in marks] for w in words]
    assert np.allclose(toxicity.features(words, marks), want)


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    syllables = ["tion", "er", "ha", "es", "on", "re", "th", "an", "or", "li", "mu", "ve"]
    out = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(10, 60))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["zbuffoon", "kwretch", "pjackass"]))
        out.append((i, " ".join(words) + ".", toxic))
    return out


def test_held_out_texts_and_gapped_insults(spark):
    rows = toxic_rows(900, 1)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "a zbuffoon", ""), (5000, None, ""), (5001, "", ""), (5002, "clean words " * 4000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, machine).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.97
    assert got[None].predicted == 1 and got[5000].predicted == got[5001].predicted == got[5002].predicted == 0
    spelled = machine.score(["you z b u f f o o n here", "a z-buffoon", "zbuffxoon"], {})
    assert (spelled > 0.7).all()
    kept = toxicity.keep_clean(df, machine)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_families_of_insults_in_few_texts():
    """Insults that share a stem, each in a handful of labelled texts, and clean texts with the stem alone."""
    rnd = random.Random(3)
    syllables = ["tion", "er", "ha", "es", "on", "re", "th", "an", "or", "li", "mu", "ve"]
    rows = []
    for i in range(1200):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
        toxic = int(rnd.random() < 0.12)
        if toxic:
            words[10:10] = ["zbog" + rnd.choice(syllables) for _ in range(4)]
        elif rnd.random() < 0.1:
            words.append("zbog")
        rows.append((" ".join(words), toxic))
    machine = toxicity.train([t for t, _ in rows[:700]], [y for _, y in rows[:700]])
    said = machine.score([t for t, _ in rows[700:]], {}) >= 0.7
    truth = np.array([y for _, y in rows[700:]], bool)
    assert (said & truth).sum() >= 0.9 * truth.sum() and (said & truth).sum() >= 0.95 * said.sum()


def test_scores_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "zbuffoon you", 1), (1, "zbuffoon you", 2), (2, None, 3), (2, None, 3), (3, "x " * 200_000, 4)], "doc_id long, text string, predicted int")
    machine = toxicity.train([t for _, t, _ in toxic_rows(300, 2)], [y for _, _, y in toxic_rows(300, 2)])
    got = sorted((r.doc_id, r.score) for r in toxicity.score(df, machine).collect())
    assert len(got) == 5 and got[0] == got[1] and got[2] == got[3]
    assert toxicity.score(df.limit(0), machine).count() == 0 and toxicity.keep_clean(df.limit(0), machine).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    rows = toxic_rows(400, 6)
    machine = toxicity.train([t for _, t, _ in rows[:300]], [y for _, _, y in rows[:300]])
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    one, many = (sorted((r.doc_id, r.score) for r in toxicity.score(df.repartition(n), machine).collect()) for n in (1, 13))
    assert one == many


def test_insults_with_two_characters_too_many():
    rows = toxic_rows(600, 2)
    machine = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    rnd = random.Random(7)
    said = []
    for word in ("zbuffoon", "kwretch", "pjackass"):
        for _ in range(30):
            w = word
            for _ in range(2):
                at = rnd.randrange(1, len(w))
                w = w[:at] + rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") + w[at:]
            said.append(f"a {w} here")
    assert (machine.score(said, {}) >= 0.7).all()
    # no word is left uncompared, whatever runs of characters it shares
    assert (toxicity.features(["zbxufxfxoxon", "kwxrexch", "pjxacxkaxss"], ["zbuffoon", "kwretch", "pjackass"]).diagonal() > 0.2).all()


def test_labels_of_one_class_only(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    machine = toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(df, machine).collect())
