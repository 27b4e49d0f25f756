import math

import numpy as np

from tidelog.llm import topk
from tidelog.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in {(r[0], tuple(r[1])): r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])}]
    out = set()
    for q, v in ok:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q and len(w) == len(v)))[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)}
    return out


def got(df, **k):
    return {tuple(r) for r in exact_top_k(df, **k).collect()}


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(df) == brute(rows)


def test_small_tiles_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_TILE", 7)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-1, 2, 3).astype(float).tolist(), 0) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0], 0) for i in range(300, 420)] + rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, every=10, groups=4) == brute(rows, every=10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [1.0, None], 1), (150, [float("nan"), 1.0], 1), (200, [], 1), (None, [1.0, 1.0], 1),
            (1, [3.0, 1.0], None), (2, [float("inf"), 0.0], 1), (3, [1.0, 2.0, 3.0], 1), (250, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows) == {(0, 1, 1, 256 * 256 * 5), (250, 1, 3, 256 * 256 * 14)}
    assert got(df.limit(0)) == set()


def test_exact_beyond_float_precision(spark):
    big = float(2**31)
    rows = [(0, [big, 1.0]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [-big, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    want = {(q, r, c, max(-(2**63), min(2**63 - 1, s))) for q, r, c, s in brute(rows)}
    assert {x[2:] for x in got(df)} == {x[2:] for x in want}
