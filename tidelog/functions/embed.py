"""Text embedders. An embedder gives a column of float arrays for a column of texts."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import scalar


class Embedder(ABC):
    """What the store needs of an embedding model; dims is the length of its vectors."""

    dims: int

    @abstractmethod
    def column(self, text: Column) -> Column:
        """The embedding of each text, an array of floats."""

    def vector(self, spark, text: str) -> list[float]:
        """The embedding of one text, such as a query."""
        return list(spark.range(1).select(self.column(F.lit(text)).alias("v")).first()["v"])


class ByteHistogramEmbedder(Embedder):
    """Counts of the UTF-8 bytes modulo 8; deterministic, not normalised."""

    dims = 8

    def column(self, text: Column) -> Column:
        return scalar.byte_histogram(text, self.dims)


class HashingEmbedder(Embedder):
    """Words hashed into signed buckets, as a unit vector: a deterministic stand-in for a language model."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def column(self, text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(self.dims)))
        sign = F.transform(words, lambda w: F.when(F.xxhash64(w, F.lit(1)) >= 0, 1.0).otherwise(-1.0))
        pairs = F.zip_with(at, sign, lambda a, s: F.struct(a.alias("a"), s.alias("s")))
        dense = F.element_at(
            F.transform(
                F.array(pairs),
                lambda ps: F.transform(
                    F.sequence(F.lit(0).cast("long"), F.lit(self.dims - 1).cast("long")),
                    lambda d: F.aggregate(ps, F.lit(0.0), lambda t, p: t + F.when(p["a"] == d, p["s"]).otherwise(0.0)),
                ),
            ),
            1,
        )
        return F.transform(scalar.normalised(dense), lambda x: x.cast("float"))


class NormalisedEmbedder(Embedder):
    """Another native embedder's vectors, scaled to unit length, so that inner products are cosines."""

    def __init__(self, inner: Embedder):
        self.inner, self.dims = inner, inner.dims

    def column(self, text: Column) -> Column:
        return F.transform(scalar.normalised(self.inner.column(text)), lambda x: x.cast("float"))


class ModelEmbedder(Embedder):
    """A user's model: load() runs once for each task and returns a function from texts to vectors.

    Vectors are batched through Arrow. `normalise` scales them to unit length, as the usual sentence models want.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dims: int, normalise: bool = True):
        self.load, self.dims, self.normalise = load, dims, normalise

    def column(self, text: Column) -> Column:
        load, normalise = self.load, self.normalise

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                vectors = [np.asarray(v, np.float64) for v in model(texts.fillna("").tolist())]
                if normalise:
                    vectors = [v / np.sqrt(v @ v) if v @ v > scalar.FLOAT_EPSILON else v for v in vectors]
                yield pd.Series([v.astype(np.float32) for v in vectors])

        return embed(text)
