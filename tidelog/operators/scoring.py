"""Similarity of embeddings to query vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import scalar
from tidelog.operators.filters import has_embedding, similar

#: Query vectors that one pass broadcasts; more go in several passes.
MOST_QUERIES = 10_000


def score(vector: list[float], embedding: str = "embedding", strict: bool = True) -> Column:
    """The inner product with a vector, null for an empty embedding; another length raises an error if strict, else gives null."""
    product = scalar.inner_product(F.col(embedding), scalar.query_vector(vector))
    if not strict:
        return product
    message = F.concat(F.lit(f"embedding has another length than {len(vector)}: "), F.size(embedding).cast("string"))
    # the case for empty ones is here too, as filters may be evaluated in any order
    return F.when(F.size(embedding) == len(vector), product).when(F.size(embedding) > 0, F.raise_error(message).cast("double"))


def matching(records: DataFrame, vector: list[float], threshold: float, strict: bool = True) -> DataFrame:
    """Records that have an embedding and score at least the threshold; all of them, unranked, repeats included."""
    return records.where(has_embedding()).where(similar(score(vector, strict=strict), threshold))


def matching_many(records: DataFrame, vectors: Iterable[tuple[str, list[float]]], threshold: float) -> DataFrame:
    """records with query_id, once for each query that they match, without a shuffle.

    The vectors are broadcast in blocks of MOST_QUERIES, with one pass over the records for each block.
    Scores are matrix products in double over Arrow batches.
    """
    blocks = [_matching_block(records, list(block), threshold) for block in batched(vectors, MOST_QUERIES)]
    return reduce(DataFrame.unionAll, blocks or [_matching_block(records, [], threshold)])


def _matching_block(records: DataFrame, vectors: list[tuple[str, list[float]]], threshold: float) -> DataFrame:
    ids = [v[0] for v in vectors]
    matrix = np.array([v[1] for v in vectors], np.float64)
    shared = records.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("embedding")
                lengths = np.asarray(lists.value_lengths().fill_null(0))
                rows = np.flatnonzero(lengths)
                if not len(ids) or not len(rows):
                    continue
                if (lengths[rows] != matrix.shape[1]).any():
                    raise ValueError(f"embedding has another length than {matrix.shape[1]}")
                flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = flat.reshape(len(rows), -1) @ matrix.T
                r, q = np.nonzero(scores >= threshold)  # false for NaN
                out = batch.take(pa.array(rows[r]))
                columns = {"query_id": pa.array([ids[i] for i in q], pa.string())} | dict(zip(out.schema.names, out.columns, strict=True))
                yield pa.RecordBatch.from_pydict(columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields]
    return records.mapInArrow(run, ", ".join(["query_id string", *fields]))
