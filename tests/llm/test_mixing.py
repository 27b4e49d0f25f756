import numpy as np
from pyspark.sql import functions as F

from tidelog.llm.mixing import DOMAINS, MILLION, REST, TOLERANCE, fit_domains, fit_rates, mixed_documents, mixing, rate_column
from tidelog.llm.queries import SHARES, domain_labels


def tables(spark, sf="0.01"):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf{sf}/{n}.parquet")
    return read("documents"), domain_labels(read("labels"))


def test_classifier_held_out(spark):
    docs, labels = tables(spark, "0.1")
    model = fit_domains(docs, labels.where("doc_id % 4 <> 0"))
    test = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = [model.domains[int(model.posterior(r["text"]).argmax())] == r["domain"] for r in test]
    assert len(test) > 800 and np.mean(right) > 0.95


def test_rates_meet_the_targets(spark):
    docs, labels = tables(spark, "0.1")
    rows, domains, _ = mixing(docs, labels, SHARES)
    got = rows.collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    p = np.array([r["membership"] for r in got]) / MILLION
    rate = np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and domains == sorted(SHARES)
    shares = (rate * tokens) @ p / (tokens @ p).sum()
    assert np.allclose(shares, [SHARES[d] for d in domains], atol=2e-3)
    copies = np.array([r["copies"] for r in got])
    assert (np.abs(copies - rate) < 1).all()


def test_targets_out_of_reach_are_approached(spark):
    """With few labels every document is a little of everything; the fixed number of iterations closes most of the gap."""
    docs, labels = tables(spark)
    rows, domains, _ = mixing(docs, labels, SHARES)
    got = rows.collect()
    tokens = np.array([r["n_tokens"] for r in got], float)
    p = np.array([r["membership"] for r in got]) / MILLION
    target = np.array([SHARES[d] for d in domains]) * (tokens @ p).sum()
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-9)
    cost = lambda rate: ((rate * tokens) @ p - target) @ inverse @ ((rate * tokens) @ p - target)
    assert cost(np.array([r["rate"] for r in got])) <= 0.1 * cost(np.ones(len(got)))


def test_against_a_local_solver(spark):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(0, 500, 400), rng.dirichlet([0.3, 0.3, 0.3], 400)
    p = np.rint(p * MILLION).astype(int)
    rows = spark.createDataFrame([(i, int(t), [int(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "id long, n_tokens long, membership array<long>").cache()
    steps = fit_rates(rows, ["a", "b", "c"], {"a": 0.8, "b": 0.15, "c": 0.05})
    q, rate, want = p / MILLION, np.ones(400), np.array([0.8, 0.15, 0.05]) * (tokens @ (p / MILLION)).sum()
    for step in steps:  # the same fold, all in one place
        rate = np.maximum(0, rate - q @ step)
    got = np.array([r["r"] for r in rows.orderBy("id").select(rate_column(steps).alias("r")).collect()])
    assert np.allclose(got, rate, atol=1e-5) and np.abs((got * tokens) @ q - want).max() <= 2 * TOLERANCE * tokens.sum()
    # plain projected gradient with a small step ends at the same totals
    slow, pace = np.ones(400), 1 / np.linalg.eigvalsh((q * tokens[:, None]).T @ q)[-1]
    for _ in range(20_000):
        slow = np.maximum(0, slow - pace * q @ ((slow * tokens) @ q - want))
    assert np.abs((slow * tokens) @ q - (got * tokens) @ q).max() <= 3 * TOLERANCE * tokens.sum()


def test_odd_tables(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows, domains, steps = mixing(odd_documents, none, {"good": 1.0})
    assert domains == ["all"] and {r["rate"] for r in rows.collect()} == {1.0} and rows.count() == 9
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (None, "x"), (3, None), (99, "x")], "doc_id long, domain string")
    assert mixing(odd_documents, labels, {"x": 0.5})[0].count() == 9
    assert mixing(odd_documents.limit(0), labels, {"x": 0.5})[0].count() == 0
    assert mixed_documents(odd_documents, none, {}).columns == odd_documents.columns


def test_repeated_ids_do_not_lengthen_the_sample(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("idiot words "), F.col("id") % 3).alias("text"))
    docs = docs.unionAll(spark.range(2, 60).select(F.col("id"), F.concat(F.lit("plain words "), F.col("id") % 5)))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, "bad").otherwise("good").alias("domain"))
    model = fit_domains(docs, labels.unionAll(labels))
    assert model.domains == ["bad", "good"]


def test_documents_are_repeated_as_often_as_their_copies(spark):
    docs, labels = tables(spark, "0.001")
    rows, _, _ = mixing(docs, labels, SHARES)
    want = {r["doc_id"]: r["copies"] for r in rows.where("copies > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixed_documents(docs, labels, SHARES).groupBy("doc_id").count().collect()}
    assert got == want


def test_rare_domains_share_one(spark):
    """No label is dropped: beyond DOMAINS domains the rest are told apart from the others, not from each other."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 40, F.lit(" text")).alias("text"))
    labels = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 40).alias("domain"))
    model = fit_domains(docs, labels)
    assert len(model.domains) == DOMAINS + 1 and REST in model.domains


def test_residual_of_targets_out_of_reach(spark):
    rows = spark.createDataFrame([(10, [MILLION, 0]), (20, [MILLION, 0])], "n_tokens long, membership array<long>")
    steps = fit_rates(rows, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert abs(steps.residual - 0.5) < 0.01
