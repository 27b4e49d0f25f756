import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import anchors as anchoring
from tidelog.llm import suffix
from tidelog.llm.anchors import owned_starts
from tidelog.llm.common import filter_bits, may_hold, staged
from tidelog.llm.suffix import remove_repeats, repeated_windows


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def got(df, length, **k):
    return Counter(tuple(r) for r in remove_repeats(df, length, full=False, **k).collect())


def rows():
    rng = random.Random(5)
    words = ["ab", "c", "dée", "xyz", "q", "aaaa"]
    base = ["".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    out = [(i, "".join(rng.choice(base)[rng.randrange(20) :] for _ in range(rng.randrange(5))) + "".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 100), (None, "abc" * 40), (None, "zabc" * 30), (104, out[3][1]), (104, out[3][1])]
    return out + [(105, "ab" * 90 + "c" + "ab" * 90)]


@pytest.mark.parametrize(("length", "more"), [(20, {}), (20, {"most_contexts": 3}), (20, {"most_contexts": 1, "gram": 7}), (33, {"gram": 30}), (1, {})])
def test_against_all_windows(spark, length, more):
    data = rows()
    want = Counter((r[0], *w) for r, w in zip(data, brute([r[1] for r in data], length)))
    assert got(spark.createDataFrame(data, "doc_id long, text string"), length, **more) == want


def covered_words(texts, short):
    """The most whole words of a run that repeated strings of `short` bytes cover, for each text."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + short] for b in raw for i in range(len(b) - short + 1))
    out = []
    for b in raw:
        on = bytearray(len(b))
        for i in range(len(b) - short + 1):
            if counts[b[i : i + short]] > 1:
                on[i : i + short] = b"\1" * short
        places = [m.span() for m in re.finditer(rb"\S+", b)]
        runs = [m.span() for m in re.finditer(b"\1+", bytes(on))]
        out.append(max((sum(a <= x and y <= z for x, y in places) for a, z in runs), default=0))
    return out


@pytest.mark.parametrize("most", [2048, 3, 1])
def test_both_lengths_in_one_run(spark, most):
    """Spans of 33 bytes stay what they are, and the shorter strings tell the passages."""
    rng = random.Random(8)
    part = lambda n: " ".join(rng.choice(["a", "bc", "déf", "ghij"]) for _ in range(n))
    shared = [part(60), part(52), part(30)]
    data = [(i, f"{part(rng.randrange(40))} {rng.choice(shared)} {part(rng.randrange(30))}") for i in range(40)]
    data += [(50, shared[0]), (51, None), (52, "a b " * 70), (53, part(300))]
    want = [(r[0], *w, n > 50) for r, w, n in zip(data, brute([r[1] for r in data], 33), covered_words([r[1] for r in data], 20))]
    assert got(spark.createDataFrame(data, "doc_id long, text string"), 33, short=20, most_contexts=most) == Counter(want)


def test_documents(spark, documents):
    data = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = Counter((r[0], *w) for r, w in zip(data, brute([r[1] for r in data], 400)))
    assert got(documents, 400) == want


def test_odd_rows_and_full_output(spark, odd_documents):
    data = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = Counter((r[0], *w) for r, w in zip(data, brute([r[1] for r in data], 30)))
    assert got(odd_documents, 30) == want
    assert got(odd_documents.limit(0), 30) == Counter()
    for r in remove_repeats(odd_documents, 30).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] == r["n_bytes"] - len(r["kept"])


def test_sorter_against_counts():
    rng = random.Random(1)
    for _ in range(500):
        length = rng.randrange(1, 6)
        contexts = [bytes(rng.choice(b"abc\x00\xff"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 5))]
        counts = Counter(x[i : i + length] for x in contexts for i in range(len(x) - length + 1))
        for x, ranges in zip(contexts, repeated_windows(contexts, length)):
            assert {i for a, b in ranges for i in range(a, b + 1)} == {i for i in range(len(x) - length + 1) if counts[x[i : i + length]] > 1}


def test_anchors_own_every_window_once():
    rng = random.Random(1)
    for _ in range(500):
        n, w = rng.randrange(1, 60), rng.randrange(1, 12)
        if n >= w:
            h = np.array([rng.randrange(rng.choice([2, 5, 50])) for _ in range(n)], np.uint64)
            found = {}
            for place, first, last in zip(*(x.tolist() for x in owned_starts(h, w))):
                for i in range(first, last + 1):
                    assert i not in found
                    found[i] = place
            assert found == {i: i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)}


def test_anchors_of_texts_together_are_those_of_each_alone(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 5, 19, 20, 33, 40, 300, 2000]))) for _ in range(60)]

    def found(texts):
        return {x for a in anchoring.anchors(texts, (33, 20), 4) for x in zip(*(column.tolist() for column in a))}

    def windows(rows):
        return {(o, h, place, i) for o, h, _, place, first, last in rows for i in range(first, last + 1)}

    alone = {(i, *x) for i, t in enumerate(texts) for _, *x in found([t])}
    assert found(texts) == alone
    assert sorted((o, h & 1, i) for o, h, _, i in windows(alone)) == sorted((o, k, i) for o, t in enumerate(texts) for k, n in enumerate((33, 20)) for i in range(len(t) - n + 1))
    monkeypatch.setattr(anchoring, "PIECE", 100)
    monkeypatch.setattr(anchoring, "TOGETHER", 50)
    assert windows(found(texts)) == windows(alone)


def test_only_windows_that_may_repeat_are_sorted(monkeypatch):
    rng = random.Random(2)
    contexts = [bytes(rng.randrange(256) for _ in range(200)) for _ in range(3)]
    contexts[2] = contexts[2][:80] + contexts[0][50:90] + contexts[2][80:]
    asked = []
    sort = suffix.sorted_suffixes
    monkeypatch.setattr(suffix, "sorted_suffixes", lambda text, limit, wanted, depth: asked.extend(wanted.tolist()) or sort(text, limit, wanted, depth))
    assert repeated_windows(contexts, 30) == [[(50, 60)], [], [(80, 90)]]
    assert len(asked) == 22


def test_staging_leaves_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: files.getAllFiles().mkString(" ").count("/shuffle_")
    before = count()
    assert len(staged(spark.range(1000).groupBy("id").count(), "test").collect()) == 1000
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(0.1)
    assert count() <= before


@pytest.mark.parametrize("lower", [False, True])
def test_filter_bits_of_lists(spark, lower):
    rng = random.Random(4)
    lists = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(5))] for _ in range(200)]
    lists += [lists[i] for i in range(0, 100, 3)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<long>").repartition(5)
    n = Counter(v for x in lists for v in x)
    at = lambda v: np.array([v << 44 & (1 << 64) - 1 if lower else v & (1 << 64) - 1], np.uint64).view(np.int64)
    for least in (1, 2):
        bits = filter_bits(df, "x", 20, least=least, lower=lower)
        assert all(may_hold(bits, at(v))[0] for v in n if n[v] >= least)
        assert np.unpackbits(bits).sum() <= sum(n[v] >= least for v in n) + (least - 1) * 2
