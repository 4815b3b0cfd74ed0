"""Batched calls of models that a user brings as plain callables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Score = Callable[[Sequence[tuple[str, str]]], Sequence[float]]


def hash_embedder(dims: int = 16) -> Embed:
    """A deterministic stand-in for a model: signed counts of hashed words."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return embed


def embed_chunks(chunks: DataFrame, embed: Embed, batch: int = 128, text: str = "content") -> DataFrame:
    """chunks with embedding (array<float>): texts go to `embed` in batches, in order; counts must agree."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vectors: list = []
            texts = pdf[text].fillna("").tolist()
            for a in range(0, len(texts), batch):
                got = list(embed(texts[a : a + batch]))
                if len(got) != len(texts[a : a + batch]):
                    raise ValueError(f"{len(got)} vectors for {len(texts[a : a + batch])} texts")
                vectors += [list(map(float, v)) for v in got]
            yield pdf.assign(embedding=vectors)

    return chunks.mapInPandas(run, schema)


def shared_words(pairs: list[tuple[str, str]]) -> list[float]:
    """A scorer without a model: the shared share of the distinct lower-case words of two texts, for a batch of them."""
    sets = [tuple(set(re.findall("[^ \t-\r]+", t.lower())) for t in p) for p in pairs]
    return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


def score_pairs(pairs: DataFrame, score: Score | None = None, batch: int = 128, question: str = "question", content: str = "content") -> DataFrame:
    """pairs with rerank_score: by the callable, or by the shared share of distinct lower-case words."""
    if score is None:
        words = lambda c: F.array_distinct(F.split(F.lower(F.trim(F.col(c))), r"\s+"))
        return pairs.withColumn("rerank_score", jaccard(words(question), words(content)))

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        both = list(zip(q.fillna(""), c.fillna(""), strict=True))
        out: list[float] = []
        for a in range(0, len(both), batch):
            out += [float(x) for x in score(both[a : a + batch])]
        return pd.Series(out)

    return pairs.withColumn("rerank_score", run(F.col(question), F.col(content)))
