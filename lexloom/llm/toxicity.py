"""Toxicity scores from a string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of characters, gaps weighing less the longer they are, so that
gapped spellings and inserted characters stay near the plain word. Texts are seen as sets of
units (words, and letters spelled out with blanks between them); a text scores by its few most
suspicious units, as one member of a family of insults may be chance and three are not. Training picks,
in each labelled sentence, the unit that the label rests on, and fits a machine that is linear in a power
of the kernels with landmark units."""

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, give_back

#: Length of the subsequences, and what each character of their span costs.
ORDER, DECAY = 3, 0.6
#: What each unit begins with.
START = "\x02"
#: Longer units are cut into windows of this length, half overlapping.
LONGEST = 24
#: Characters of landmarks that are told apart.
LETTERS = 127
#: Units that families of insults are built around at most, and how like a seed a member is.
SEEDS, FAMILY = 240, 0.6
#: How far a unit of toxic texts must stand out to be a seed; decisions above which a clean text's unit is suspicious.
STANDING, SUSPICIOUS = 5.5, -0.5
#: Clean texts that the sizes of families are taken from at most.
COMPARED = 1500
#: The kernel is raised to this power, which keeps it one and makes it more local.
POWER = 3
#: Units of a toxic text that training starts from; units of a text that its score rests on.
WITNESSES, TOP = 4, 3
#: Units whose scores a Python worker keeps.
KEPT_UNITS = 400_000
#: Characters of texts whose units are scored together.
TOGETHER = 1_000_000
#: Subsequences of words that are held at a time.
HELD = 1 << 19
#: Weight of an insult with characters put in, as a share of the plain one's, and what is put in.
SPREAD = 0.2
_EXTRA = "abcdefghijklmnopqrstuvwxyz0123456789"
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .\-_*]{1,2}\w){2,}(?!\S)")


def units(text: str) -> set[str]:
    """The distinct units of a text: the letters and digits of its words, and spelled-out words joined, each
    behind a START, so that beginnings count for more."""
    text = text.lower()
    found = {w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in set(text.split())}
    found.update(re.sub(r"[ .\-_*]", "", m) for m in _SPELLED.findall(text))
    found.discard("")
    out = {START + w for w in found if len(w) <= LONGEST}
    for w in found:
        if len(w) > LONGEST:
            out.update((START if not i else "") + w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+(?=\s|$)|\n", text) if s.strip()]


def codes(words: Sequence[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return raw.reshape(len(words), -1).astype(np.int32)


def kernel(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of paired rows: x (n, a) against y (n, b)."""
    n, a = x.shape
    b = y.shape[1]
    inner = np.ones((a + 1, b + 1, n))
    total = np.zeros(n)
    for level in range(order):
        above = np.zeros((a + 1, b + 1, n))
        for i in range(1, a + 1):
            run = np.zeros(n)
            for j in range(1, b + 1):
                same = x[:, i - 1] == y[:, j - 1]
                hit = same * (decay * decay * inner[i - 1, j - 1])
                if level == order - 1:
                    total += hit
                run = decay * run + hit
                above[i, j] = decay * above[i - 1, j] + run
        inner = above
    return total


def by_length(words: Sequence[str], most: int = 2048) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Places and words of one length, at most `most` at a time, and fewer long ones, which have more subsequences."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        on = np.flatnonzero(lengths == n)
        step = max(1, min(most, HELD // max(1, comb(int(n), ORDER))))
        for a in range(0, len(on), step):
            yield on[a : a + step], [words[i] for i in on[a : a + step]]


def self_kernels(words: Sequence[str]) -> np.ndarray:
    out = np.zeros(len(words))
    for on, same in by_length(words):
        x = codes(same)
        out[on] = kernel(x, x)
    return out


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of three of n characters, and their weights."""
    i, j, k = (np.array(c, int) for c in zip(*combinations(range(n), ORDER), strict=True)) if n >= ORDER else (np.empty(0, int),) * 3
    return i, j, k, DECAY ** (k - i + 1.0)


class Landmarks:
    """Landmark units, and which of them hold a subsequence.

    Only their own characters are numbered: any other is in none of their subsequences. There is room for LETTERS
    characters, the most frequent ones of the landmarks."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        seen = Counter("".join(words))
        kept = sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]
        self.base = len(kept) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in kept]] = np.arange(1, self.base)
        self.norm = np.sqrt(np.maximum(self_kernels(words), 1e-12))
        theirs = [self.subsequences(codes([m])) for m in words]
        t = np.concatenate([np.empty(0, int), *[x[0] for x, _ in theirs]])
        mark = np.repeat(np.arange(len(words)), [x.shape[1] for x, _ in theirs])
        weight = np.concatenate([np.empty(0), *[w for _, w in theirs]])
        pair, inverse = np.unique(t * len(words) + mark, return_inverse=True)
        total = np.bincount(inverse, weight, minlength=len(pair))
        pair, total = pair[pair >= len(words)], total[pair >= len(words)]  # 0: a character without a number
        known, size = np.unique(pair // max(len(words), 1), return_counts=True)
        self.mark, self.weight = pair % max(len(words), 1), total / self.norm[pair % max(len(words), 1)]
        self.end = np.cumsum(size)
        self.first = self.end - size
        self.place = np.full(self.base**3, -1, np.int32)
        self.place[known] = np.arange(len(known))

    def subsequences(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all subsequences of three of rows of characters, 0 for those no landmark can hold, and their weights."""
        x = self.number[raw]
        i, j, k, weight = triples(x.shape[1])
        known = (x[:, i] > 0) & (x[:, j] > 0) & (x[:, k] > 0)
        return np.where(known, (x[:, i] * self.base + x[:, j]) * self.base + x[:, k], 0), weight

    def kernels(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the words, some at a time, and their normalised kernels with all landmarks. Nothing is left out: what
        doesn't hold a subsequence of a landmark has a kernel of zero."""
        m = len(self.words)
        for on, same in by_length(words, 2048):
            if not m:
                yield on, np.zeros((len(on), 0))
                continue
            raw = codes(same)
            out = np.zeros(len(on) * m)
            t, w = self.subsequences(raw)
            row, column = np.nonzero(self.place[t] >= 0)
            if len(row):
                hit = self.place[t[row, column]]
                n = self.end[hit] - self.first[hit]
                at = np.arange(n.sum()) + np.repeat(self.first[hit] - (np.cumsum(n) - n), n)
                out = np.bincount(np.repeat(row * m, n) + self.mark[at], np.repeat(w[column], n) * self.weight[at], minlength=len(out))
                out = out.reshape(-1, m) / np.sqrt(np.maximum(kernel(raw, raw), 1e-12))[:, None]
            yield on, out.reshape(-1, m)


def features(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """Normalised kernels of words (rows) with landmarks (columns).

    The kernel is the inner product of weighted counts of subsequences; only those of landmarks matter."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for on, k in Landmarks(landmarks).kernels(words):
        out[on] = k
    return out


def _power(k: np.ndarray) -> np.ndarray:
    out = k
    for _ in range(POWER - 1):
        out = out * k
    return out


@dataclass
class Machine:
    """The decision function of units, a weighted sum of powers of their kernels with landmarks, and the logistic
    function that makes probabilities of the decisions on a text's most suspicious units."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float
    logistic: np.ndarray  # weights of the TOP highest decisions, of the logarithm of the number of units, and 1

    def decide(self, words: Sequence[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for on, k in self.landmarks.kernels(words):
            # summed row by row, in one order: a matrix product rounds by a row's place among the others
            out[on] += (_power(k) * self.beta).sum(axis=1)
        return out

    def evidence(self, bags: Sequence[Sequence[float]]) -> np.ndarray:
        """A row for each text: its TOP highest decisions, the bias where there are fewer, and how many units it has."""
        out = np.full((len(bags), TOP + 2), self.bias)
        for i, b in enumerate(bags):
            high = np.sort(np.partition(b, len(b) - TOP)[len(b) - TOP :] if len(b) > TOP else b)[::-1]
            out[i, : len(high)] = high
            out[i, TOP] = np.log1p(len(b))
        out[:, :TOP] = np.clip(out[:, :TOP], -1.2, 1.2)
        out[:, -1] = 1
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((evidence * self.logistic).sum(axis=1), -40, 40)))

    def score(self, texts: Sequence[str | None], known: dict[str, float]) -> np.ndarray:
        """Probabilities of texts, worked on together. `known` keeps the decisions on units for the next call."""
        bags = [units(t) if t else set() for t in texts]
        together = set().union(*bags)
        new = [u for u in together if u not in known]
        if len(known) + len(new) > KEPT_UNITS:
            known.clear()
            new = list(together)
        known.update(zip(new, self.decide(new).tolist(), strict=True))
        return self.probability(self.evidence([np.fromiter(map(known.__getitem__, b), float, len(b)) for b in bags]))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a squared-hinge linear machine; the last column of x is 1 and its weight isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-9
    for _ in range(50):
        margin = 1 - y * (x @ w)
        on = margin > 0
        inside = x[on]
        grad = shrink * w - inside.T @ (weight[on] * y[on] * margin[on])
        step = np.linalg.solve(inside.T @ (inside * weight[on, None]) + np.diag(shrink), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of a logistic fit with smoothed targets; the last column of x is 1."""
    p, n = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    w = np.zeros(x.shape[1])
    shrink = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        v = q * (1 - q) + 1e-9
        step = np.clip(np.linalg.solve(x.T @ (x * v[:, None]) + np.diag(shrink), x.T @ (q - target) + shrink * w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _unlike(words: list[str], marks: list[str], most: int, alike: float = 0.85) -> list[str]:
    """The landmarks with up to `most` of the words more, in their order, none much like another."""
    words = [w for w in words if len(w) >= ORDER]
    if not words:
        return marks
    like, kept = features(words, [*words, *marks]), list(range(len(words), len(words) + len(marks)))
    chosen = []
    for i in range(len(words)):
        if len(chosen) < most and (not kept or like[i, kept].max() < alike):
            kept.append(i)
            chosen.append(words[i])
    return marks + chosen


def _lift(toxic: np.ndarray, clean: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """How much likelier toxic texts are to hold something than clean ones, as a logarithm, times its standing."""
    return (np.log((toxic + 0.5) / (sizes[1] + 1)) - np.log((clean + 0.5) / (sizes[0] + 1))) * np.sqrt(toxic)


def _strengths(words: list[str], bags: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """How much each unit speaks for toxic texts, and the seeds of families, strongest first.

    A family is what lies near a seed by the kernel. A unit counts by the texts that hold it and by those that
    hold a member of its family, as rare members of a family of insults are hardly seen one by one."""
    sizes = (int((y == 0).sum()), int((y == 1).sum()))
    held = [np.bincount(np.concatenate([b for b, c in zip(bags, y, strict=True) if c == k]), minlength=len(words)) for k in (0, 1)]
    usable = np.array([len(w) > ORDER for w in words])
    own = np.where(usable, _lift(held[1], held[0], sizes), 0.0)
    order = np.lexsort((words, -own))
    seeds = _unlike([words[i] for i in order[:SEEDS] if own[i] > STANDING], [], SEEDS)
    compared = [i for k, most in ((0, COMPARED), (1, len(y))) for i in np.flatnonzero(y == k)[:most]]
    asked = np.unique(np.concatenate([bags[i] for i in compared]))
    slot, members = np.zeros(len(words), np.int32), [np.zeros((1, len(seeds)), bool)]  # row 0: of no family
    for a in range(0, len(asked), 8192):
        near = features([words[i] for i in asked[a : a + 8192]], seeds) >= FAMILY
        some = np.flatnonzero(near.any(axis=1))
        slot[asked[a : a + 8192][some]] = np.arange(len(some)) + sum(map(len, members))
        members.append(near[some])
    member = np.concatenate(members)
    families = np.zeros((2, len(seeds)))
    for i in compared:
        families[y[i]] += member[np.unique(slot[bags[i]])].any(axis=0)
    shared = np.maximum(_lift(families[1], families[0], (min(sizes[0], COMPARED), sizes[1])), 0)
    strength = np.where(own > 0, own + (member * shared).max(axis=1, initial=0)[slot], np.minimum(own, 0))
    place = {w: i for i, w in enumerate(words)}
    return strength, sorted(seeds, key=lambda u: (-strength[place[u]], u))


def _stretched(unit: str, inserted: int, rng: np.random.Generator) -> str:
    """A unit with characters put in behind some of its own, or behind each."""
    own = len(unit) - 1
    at = set(rng.permutation(own)[:inserted].tolist())
    return unit[0] + "".join(c + _EXTRA[rng.integers(len(_EXTRA))] * (k in at) for k, c in enumerate(unit[1:]))


def train(texts: Sequence[str], toxic: Sequence[int], landmarks: int = 240, rounds: int = 3, ridge: float = 1e-5, seed: int = 5) -> Machine:
    """Fit a machine on labelled texts.

    Landmarks: units that speak for toxic texts, by themselves and with their families, and, after each round, the clean texts' most suspicious ones, no two of them alike. Each round trains on the witness
    units of toxic sentences against units of clean texts, then picks witnesses, and the clean texts' most
    suspicious units, by the new machine."""
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        return Machine(Landmarks([]), np.zeros(0), -1.0, np.append(np.zeros(TOP + 1), -1.0 if not len(y) or not y.max() else 1.0))
    number: dict[str, int] = {}

    def numbered(found: set[str]) -> np.ndarray:
        return np.fromiter((number.setdefault(u, len(number)) for u in sorted(found)), np.int32, len(found))

    bags = [numbered(units(t)) for t in texts]
    bad, good = np.flatnonzero(y == 1), [b for b, c in zip(bags, y, strict=True) if c == 0 and len(b)]
    spoken = [b for i in bad for s in sentences(texts[i]) if len(b := numbered(units(s)))]
    words = list(number)
    strength, seeds = _strengths(words, bags, y)
    marks = _unlike(seeds, [], 5 * landmarks // 8)

    rng = np.random.default_rng(seed)
    positive = np.zeros(len(words))
    for i in bad:
        b = bags[i]
        best = b[np.argsort(-strength[b], kind="stable")[:WITNESSES]]
        positive[best[strength[best] > 0]] += 1
    negative = np.zeros(len(words))
    for b in good:
        negative[b[rng.integers(0, len(b), 8)]] += 0.125
        negative[b[np.argsort(-strength[b], kind="stable")[:2]]] += 1
    high = np.argsort(-strength, kind="stable")[:50]
    plain_words = [i for i in high if strength[i] > 0.5 * strength.max()]
    for turn in range(rounds):
        values, vectors = np.linalg.eigh(features(marks, marks).astype(float) ** POWER)
        on = values > 1e-6
        root = vectors[:, on] / np.sqrt(values[on])
        extra: Counter = Counter()
        for i in plain_words:  # the same units with one or two characters too many, or one behind each
            for inserted in (1, 1, 2, 2, 2, len(words[i])):
                extra[_stretched(words[i], inserted, rng)] += SPREAD * max(positive[i], 1)
        x, label, count = [], [], []
        for sign, chosen, n in ((1.0, [*(words[i] for i in np.flatnonzero(positive)), *extra], np.array([*positive[positive > 0], *extra.values()])), (-1.0, [words[i] for i in np.flatnonzero(negative)], negative[negative > 0])):
            x.append(np.c_[features(chosen, marks) ** POWER @ root, np.ones(len(chosen))])
            label.append(np.full(len(chosen), sign))
            count.append(n / len(y))
        x = np.concatenate(x)  # the parts go
        w = _newton(x, np.concatenate(label), np.concatenate(count), ridge)
        del x
        machine = Machine(Landmarks(marks), root @ w[:-1], float(w[-1]), np.zeros(TOP + 2))
        score = machine.decide(words)
        if turn < rounds - 1:
            wanted = np.where(strength > 0, score, -9)
            witness = np.zeros(len(words))
            for b in spoken:
                best = b[np.argmax(wanted[b])]
                witness[best] += wanted[best] > 0
            positive = witness + (positive > 0) if witness.any() else positive
            for b in good:
                most = b[np.argsort(-score[b], kind="stable")[:2]]
                negative[most[score[most] > SUSPICIOUS]] += 1
            wrong = sorted({int(i) for b in good if score[i := b[np.argmax(score[b])]] > SUSPICIOUS}, key=lambda i: (-score[i], words[i]))
            marks = _unlike([words[i] for i in wrong[:300]], marks, 3 * landmarks // 8 // (rounds - 1))
    machine.logistic = _logistic(machine.evidence([score[b] for b in bags]), y)
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, held_out, most: tuple[int, int]) -> DataFrame:
    """(text, toxic) of at most most[c] labelled documents of class c outside the held-out fold, those whose
    ids hash lowest. Only ids and labels are ordered; texts join the chosen ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    pick = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(most[c])
        pick = part if pick is None else pick.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(pick), texts["__doc"] == pick["__id"]).select("__doc", "text", "toxic")


def text_batches(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose units are scored together."""
    return batches([len(t or "") + 1 for t in texts], TOGETHER)


def held_out() -> F.Column:
    """The fold that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (3600, 1200)) -> Machine:
    """Train on at most most[0] clean and most[1] toxic labelled documents. Of an id's several texts, the one of the least hash is
    taken, so that the machine doesn't depend on how rows are dealt."""
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    rows = training_rows(docs, labels, held_out(), most).groupBy("__doc").agg(least, F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["__doc"])
    give_back()
    machine = train([r.text for r in rows], [r.toxic for r in rows])
    give_back()
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    A text without units scores as the machine's bias. Null ids are not held out. Repeated rows get
    equal scores; further columns are left out; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, known = sent.value, {}
        for batch in it:
            texts = batch.column(1).to_pylist()
            scores = np.concatenate([own.score(texts[a:b], known) for a, b in text_batches(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` below the threshold, with all their columns. Each row is judged by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        own, known = sent.value, {}
        for batch in texts:
            listed = batch.tolist()
            yield pd.Series(np.concatenate([own.score(listed[a:b], known) for a, b in text_batches(listed)] or [np.empty(0)]), dtype=float)
        known.clear()
        give_back()

    judge = F.pandas_udf(run, "double")
    return docs.where(judge(F.col("text")) < threshold)

