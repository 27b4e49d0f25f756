import os

import numpy as np
import pandas as pd
import random

import pytest

from tidelog.llm import jaccard
from tidelog.llm.jaccard import _passes, Similarity, jaccard_groups


def brute(rows, sim):
    """(n_shingles, component, links) of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + sim.k]) for i in range(max(1, len(w) - sim.k + 1))) if w else frozenset())
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and sim.den * both >= sim.num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    ids = {}
    for a in range(n):
        ids.setdefault(find(a), []).append(rows[a][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((rows[a][0], len(sets[a]), least[find(a)], links[a]) for a in range(n)), key=str)


def got(df, sim):
    return sorted((tuple(r) for r in jaccard_groups(df, sim).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


def near_copies(seed, n, words=120, change=0.03, vocabulary=5000):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    return [" ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("sim", [Similarity(3, 9, 10), Similarity(5, 8, 10)])
def test_documents(spark, documents, sim):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents, sim) == brute(rows, sim)


@pytest.mark.parametrize(("short", "tile"), [(32, 512), (3, 8)])
def test_groups_of_near_copies_in_short_and_long_lists(spark, monkeypatch, short, tile):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = near_copies(1, 60, change=0.01) + near_copies(2, 30, words=40) + near_copies(3, 25, words=300, change=0.02) + [t[: len(t) // 2] for t in near_copies(1, 10)]
    rows = list(enumerate(texts)) + [(500 + i, texts[0]) for i in range(20)]
    sim = Similarity(3, 8, 10)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sim) == brute(rows, sim)


def test_exactly_at_the_threshold(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:19])), (2, " ".join(words[:20])), (3, " ".join(words[:18])), (4, " ".join(words[:10])), (5, " ".join(words[:9]))]
    for sim in (Similarity(1, 9, 10), Similarity(1, 19, 20), Similarity(3, 17, 18)):
        assert got(spark.createDataFrame(rows, "doc_id long, text string"), sim) == brute(rows, sim)


def test_odd_rows(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(odd_documents, Similarity(3, 9, 10)) == brute(rows, Similarity(3, 9, 10))
    assert got(odd_documents.limit(0), Similarity()) == []
    short = spark.createDataFrame([(None, "A b"), (9, "a  B"), (8, "a b c"), (None, "x"), (None, "x")], "doc_id long, text string")
    assert got(short, Similarity(3, 9, 10)) == brute([tuple(r) for r in short.collect()], Similarity(3, 9, 10))


def test_tokens_that_coincide_lose_no_link():
    """Two sets of 100 with an overlap of 95; two of the tokens that their prefixes share are narrowed to one value."""
    sim = Similarity(k=3, num=9, den=10)
    size = sim.prefix(100)
    shared, own = np.arange(6), [np.arange(100, 100 + size - 6), np.arange(200, 200 + size - 6)]
    for narrowed in (shared, np.where(shared == 5, 4, shared)):
        sides = [pd.DataFrame({"sid": [i], "n": [100]} | {f"p{k}": [np.concatenate([narrowed, own[i]]).astype(np.int32)] for k in range(3)}) for i in (0, 1)]
        assert _passes(*sides, sim).all()


def test_prefixes_and_postings_do_not_stay(spark, monkeypatch):
    tables = {}
    keep = jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: tables.setdefault(name, keep(df, name)))
    rows = [(i, t) for i, t in enumerate(near_copies(5, 6, change=0.01))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), Similarity(3, 8, 10)) == brute(rows, Similarity(3, 8, 10))
    there = {n for n, t in tables.items() if any(os.path.exists(f.removeprefix("file:")) for f in t.inputFiles())}
    assert not there & {"prefixes", "postings"} and {"rows", "listed"} <= there


def test_sketch_sums_counters_of_all_partitions(spark):
    texts = [f"a b c d{i % 7} e f" for i in range(900)] + ["x y z"]
    counts = np.zeros(1 << jaccard.SKETCH_BITS)
    for t in texts:
        np.add.at(counts, (jaccard.shingles(t, 3) >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64), 1)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.floor(32 * np.log2(1 + counts)).astype(np.uint64) << np.uint64(48)
    assert (jaccard.token_levels(df, 3) == want).all()
