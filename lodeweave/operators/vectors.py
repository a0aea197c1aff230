"""Vector search by brute force, and the pluggable embedder and summariser."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2", vector: str = "embedding", order: str = "id", where: str | None = None) -> DataFrame:
    """The ``k`` nearest rows with ``score``: squared L2 distance ascending, or cosine descending; ties by ``order``."""
    rows = vectors.where(where) if where else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "cosine":
        return rows.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), order).limit(k)
    return rows.withColumn("score", squared_l2(F.col(vector), q)).orderBy("score", order).limit(k)


def hashing_embedder(dim: int = 64) -> Callable:
    """A deterministic embedder for tests: signed counts of hashed words, of length 1."""
    import hashlib

    import numpy as np

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in (text or " ").lower().split():
                h = hashlib.md5(word.encode(), usedforsecurity=False).digest()
                v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] >> 7 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def summariser(join: str = " | ", head: int = 40) -> Callable:
    """A grouped-aggregate function from turns to one text; stands where a model would."""

    @F.pandas_udf("string")
    def summarise(ids: pd.Series, contents: pd.Series) -> str:
        return join.join(str(c)[:head].replace("\n", " ") for _, c in sorted(zip(ids, contents, strict=True)))

    return summarise
