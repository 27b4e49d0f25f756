"""Exact top-k search: tiles of queries times tiles of candidates, merged as a tree.

Vectors become tiles of at most TILE rows where they lie, without a shuffle. Candidate tiles are
dealt to groups, every query tile visits every group, and each visit is one matrix product with a
partial selection. A query's lists are merged while a task walks the tiles of a group, and then
over the groups in two levels of grouped aggregation. No task ever holds more than a tile
of each kind and the short lists of one query tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import lean

CANDIDATE_TILE, QUERY_TILE = 4096, 256
PAIR_SCHEMA = "query_id long, vec_id long, score long, part int"
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), x as double."""
    return np.floor(256.0 * vectors.astype(np.float64))


def _tiles(batches: Iterator[pa.RecordBatch], size: int, every: int, side: str) -> Iterator[pa.RecordBatch]:
    """Tiles of valid vectors; `every` keeps the ids that it divides. Ids ascend within a tile."""
    pending: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def tile(dim: int) -> pa.RecordBatch:
        ids = np.concatenate([x[0] for x in pending[dim]])
        values = np.concatenate([x[1] for x in pending[dim]])
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_pydict(
            {
                f"{side}_dim": pa.array([dim], pa.int32()),
                f"{side}_ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
                f"{side}_values": pa.array([np.ascontiguousarray(values[order]).tobytes()], pa.binary()),
                f"{side}_n": pa.array([len(ids)], pa.int32()),
            }
        )

    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        ok = np.asarray(pc.and_(ids.is_valid(), lists.is_valid()))
        lengths = np.nan_to_num(np.asarray(pc.list_value_length(lists).fill_null(-1))).astype(np.int64)
        numbers = np.asarray(ids.fill_null(0))
        ok &= (numbers % every == 0) & (lengths > 0)
        for dim in np.unique(lengths[ok]):
            rows = np.flatnonzero(ok & (lengths == dim))
            flat = lists.take(pa.array(rows)).flatten()
            x = quantised(np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64).reshape(len(rows), int(dim)))
            good = np.isfinite(x).all(axis=1)
            kept = pending.setdefault(int(dim), [])
            for at in range(0, len(rows), size):
                part = slice(at, at + size)
                kept.append((numbers[rows[part]][good[part]], x[part][good[part]]))
                if sum(len(i) for i, _ in kept) >= size:
                    yield tile(int(dim))
                    kept.clear()
    for dim, kept in pending.items():
        if sum(len(i) for i, _ in kept):
            yield tile(dim)


def tiles(vectors: DataFrame, size: int, every: int, side: str) -> DataFrame:
    schema = f"{side}_dim int, {side}_ids binary, {side}_values binary, {side}_n int"
    return vectors.mapInArrow(lean(lambda it: _tiles(it, size, every, side)), schema)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those that no long can hold become the nearest long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(q).dot(whole(c).T)
    return np.array([[min(max(x, LONG_MIN), LONG_MAX) for x in row] for row in exact], np.int64).reshape(exact.shape)


def best(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each query's k best by (score descending, id ascending), its own id left out."""
    rows, cols = [], []
    wanted = min(k + 1, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - wanted, axis=1)[:, scores.shape[1] - wanted]
    for r in range(len(q_ids)):
        near = np.flatnonzero(scores[r] >= cut[r])
        near = near[c_ids[near] != q_ids[r]]
        if len(near) < k and scores.shape[1] > wanted:  # the query's id took more than one place
            near = np.flatnonzero(c_ids != q_ids[r])
        near = near[np.lexsort((c_ids[near], -scores[r][near].astype(np.float64), ~scores[r][near]))][:k] if len(near) else near
        rows.append(np.full(len(near), r))
        cols.append(near)
    r, c = np.concatenate(rows), np.concatenate(cols)
    return r, c_ids[c], scores[r, c]


def _merge(ids: np.ndarray, scores: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best; ~score orders all longs downwards without overflow."""
    order = np.lexsort((ids, ~scores, of))
    first = np.searchsorted(of[order], of[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows are pairs of tiles, sorted by query tile; yields each query tile's lists once its run ends."""
    tile_key, held = None, None

    def out(part: int):
        of, ids, scores = held
        return pa.RecordBatch.from_pydict(
            {"query_id": pa.array(of, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()), "part": pa.array(np.full(len(of), part), pa.int32())}
        )

    part = 0
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            shape = lambda side: (row[f"{side}_n"], row[f"{side}_dim"])
            q = np.frombuffer(row["q_values"], np.float64).reshape(shape("q"))
            c = np.frombuffer(row["c_values"], np.float64).reshape(shape("c"))
            key = (row["part"], row["q_ids"])
            if key != tile_key and held is not None:
                yield out(part)
                held = None
            tile_key, part = key, row["part"]
            r, ids, scores = best(q_ids, c_ids, products(q, c), k)
            of = q_ids[r]
            if held is not None:
                of, ids, scores = (np.concatenate(x) for x in zip(held, (of, ids, scores), strict=True))
            keep = _merge(ids, scores, of, k)
            held = of[keep], ids[keep], scores[keep]
    if held is not None:
        yield out(part)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, groups: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each vec_id that `every` divides.

    Score: the integer inner product of floor(256 * component) vectors; ties go to the smaller
    vec_id; a candidate never has the query's vec_id. Vectors of another dimension than the
    query's are no candidates. Null, empty or non-finite vectors and null ids take no part. Rows
    equal in id and vector count once; different vectors under one id are candidates each, and as
    queries they share one list. With fewer than k candidates the list is shorter, with none it is
    absent. Extra columns of vectors are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding").distinct()
    groups = groups or max(2, spark.sparkContext.defaultParallelism)
    c = tiles(vectors, CANDIDATE_TILE, 1, "c").withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(groups)).cast("int"))
    q = tiles(vectors, QUERY_TILE, every, "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = q.join(c, "part").where(F.col("q_dim") == F.col("c_dim"))
    lists = pairs.sortWithinPartitions("part", "q_ids").mapInArrow(lean(lambda it: _search(it, k)), PAIR_SCHEMA)
    # tree: first sqrt(groups) nodes for each query, then one
    width = max(1, round(groups**0.5))
    for keys in (["query_id", F.pmod(F.col("part"), F.lit(width)).alias("node")], ["query_id"]):
        # the best first: descending score is ascending in its complement
        entry = F.struct((-1 - F.col("score")).alias("down"), F.col("vec_id"))
        merged = lists.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
        lists = merged.select(
            "query_id",
            F.posexplode("top").alias("place", "entry"),
            F.col("node").alias("part") if len(keys) > 1 else F.lit(0).alias("part"),
        ).select("query_id", F.col("entry.vec_id").alias("vec_id"), (-1 - F.col("entry.down")).alias("score"), "part", "place")
    return lists.select("query_id", (F.col("place") + 1).alias("rank"), "vec_id", "score")
