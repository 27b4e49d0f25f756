from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tidelog.llm.langid import (
    BUCKETS,
    DOMAIN_WEIGHT,
    HOST_WEIGHT,
    LANGUAGES,
    MILLION,
    REST,
    TextModel,
    address_columns,
    declared_in,
    fit,
    fused,
    host_priors,
    identify_documents,
    identify_pages,
    normal,
    trigrams,
    visible,
)


def judge(model, text, *rest):
    log_p, n = model.evidence(text)
    return fused(model.languages, log_p, n, *rest)


def test_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    model = fit(train.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared")))
    rows = test.collect()
    right = sum(judge(model, r["text"], None, None, None)[0] == r["lang"] for r in rows)
    assert right >= 0.97 * len(rows)


def test_documents_keep_clean_ones(spark, documents):
    got = identify_documents(documents).collect()
    assert len(got) == documents.count() and np.mean([r["kept"] for r in got]) > 0.99
    assert np.mean([r["detected"] == r["lang"] for r in got]) > 0.98


def test_whole_result_against_brute_force(spark, documents):
    """Every row again, by dictionaries and sums in one place."""
    rows = documents.collect()
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], Counter()).update(trigrams(r["text"]).tolist())
    languages = sorted(counts)
    rates = {x: (lambda c, total: lambda g: np.log(np.float32((c[g] + 0.5) / total)))(c, sum(c.values()) + 0.5 * BUCKETS) for x, c in counts.items()}
    evidence, votes = [], {}
    for r in rows:
        found = Counter(trigrams(r["text"]).tolist())
        n = sum(found.values())
        e = np.array([sum(k * float(rates[x](g)) for g, k in found.items()) / n * min(n, 60) if n else 0.0 for x in languages])
        evidence.append((e, n))
        p = np.exp(e - e.max())
        votes.setdefault(r["source"], np.zeros(len(languages)))
        votes[r["source"]] += np.rint(p / p.sum() * MILLION) if n else 0
    total = sum(votes.values())
    corpus = (total + MILLION) / (total.sum() + len(languages) * MILLION)
    got = {r["doc_id"]: r for r in identify_documents(documents, keep_text=False).collect()}
    assert len(got) == len(rows) and "text" not in next(iter(got.values())).asDict()
    for r, (e, n) in zip(rows, evidence):
        mine = votes[r["source"]] / MILLION
        domain = (mine + DOMAIN_WEIGHT * corpus) / (mine.sum() + DOMAIN_WEIGHT)  # a source is its own domain
        e = e + np.log((mine + HOST_WEIGHT * domain) / (mine.sum() + HOST_WEIGHT))
        e = e + np.log([0.9 if x == r["lang"] else 0.1 / (len(languages) - 1) for x in languages])
        p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        found, best = got[r["doc_id"]], int(p.argmax())
        assert (found["detected"], found["n_trigrams"], found["kept"]) == ((languages[best], n, bool(p[best] >= 0.6)) if n else (None, 0, False))
        assert not n or abs(found["confidence"] - p[best]) < 1e-4


def test_texts_are_scored_once(spark, documents):
    plan = identify_documents(documents, keep_text=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "text" not in plan.replace("__evidence", "")


def test_rare_languages_share_one(spark):
    rows = spark.range(600).select(F.col("id"), F.concat(F.lit("words of "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("declared"))
    model = fit(rows)
    assert len(model.languages) == LANGUAGES + 1 and REST in model.languages


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = identify_pages(pages).collect()
    assert len(got) == pages.count() and np.mean([r["detected"] == r["declared"] for r in got]) > 0.95


def test_evidence_is_fused_by_bayes():
    model = TextModel(["de", "en"], np.log(np.full((2, 1 << 14), 1 / (1 << 14))).astype(np.float32))
    assert judge(model, "same for both", None, None, None)[:2] == ("de", 0.5)  # a tie goes to the first
    assert abs(judge(model, "x y z", "en", None, None)[1] - 0.9) < 1e-9
    assert abs(judge(model, "x y z", "en", "de", None)[1] - 0.9 * 0.2 / (0.9 * 0.2 + 0.1 * 0.8)) < 1e-9
    assert abs(judge(model, "x y z", None, None, [np.log(0.3), np.log(0.7)])[1] - 0.7) < 1e-9
    assert judge(model, "123 !!", "en", "de", None)[0] is None and judge(model, None, None, None, None)[1] == 0.0


def test_host_priors_are_smoothed_twice(spark):
    model = TextModel(["de", "en"], np.log(np.random.default_rng(0).random((2, 1 << 14))).astype(np.float32))
    rows = spark.createDataFrame([("a.x.com", "alpha beta"), ("a.x.com", "gamma"), ("b.x.com", "delta words"), ("y.org", "other text"), (None, "no host")], "host string, text string")
    votes = [(r["host"], np.rint(normal(model.evidence(r["text"])[0]) * MILLION)) for r in rows.collect()]
    table = spark.createDataFrame([(h, [int(x) for x in v]) for h, v in votes], "host string, votes array<long>")
    got = {r["p_host"]: r["prior"] for r in host_priors(table, 2).collect()}
    total = sum(v for _, v in votes)
    corpus = (total + MILLION) / (total.sum() + 2 * MILLION)
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:])
    for host, prior in got.items():
        mine = sum((v for h, v in votes if h == host), np.zeros(2)) / MILLION
        wider = sum((v for h, v in votes if domain(h) == domain(host)), np.zeros(2)) / MILLION
        up = (wider + DOMAIN_WEIGHT * corpus) / (wider.sum() + DOMAIN_WEIGHT)
        assert np.allclose(np.exp(prior), (mine + HOST_WEIGHT * up) / (mine.sum() + HOST_WEIGHT))


def test_addresses_and_markup(spark):
    rows = [("https://u@Blog.Example.DE:8080/x?y", "<!DOCTYPE html><HTML class=a LANG='de-AT'>"), ("nonsense", "<html>"), (None, None), ("http://localhost/", '<html xml:lang="fr">')]
    host, suffix = address_columns(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "u string, h string").select(host, suffix, declared_in(F.col("h"))).collect()]
    assert got == [("blog.example.de", "de", "de"), (None, None, None), (None, None, None), ("localhost", None, None)]
    assert visible("<p>a&amp;b<script>x</script><!-- c --> d").split() == ["a&b", "d"] and visible(None) == ""


def test_odd_rows(spark, odd_documents):
    got = identify_documents(odd_documents).collect()
    assert len(got) == 9 and all(not r["kept"] for r in got if not (r["text"] or "").strip())
    assert identify_documents(odd_documents.limit(0)).count() == 0
    unlabelled = identify_documents(odd_documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["detected"] is None and not r["kept"] for r in unlabelled)
