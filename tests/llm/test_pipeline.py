"""Each stage against a brute-force version of it, on its own input; and the queries against their oracle SQL."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import mixing, queries
from tidelog.llm.langid import identify_documents
from tidelog.llm.secrets import find_secrets, redacted

from .test_jaccard import brute as jaccard_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and every stage's result, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"file://{folder}/{i}")
        out.append(spark.read.parquet(f"file://{folder}/{i}"))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_stage(stages):
    want = {r["doc_id"] for r in identify_documents(stages[0]).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == want and len(want) > 0.98 * stages[0].count()


def test_near_duplicate_stage(stages):
    from tidelog.llm.jaccard import Similarity

    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {c for _, _, c, _ in jaccard_brute(rows, Similarity(5, 8, 10))}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(want)


def test_stages_with_odd_rows_and_clashing_columns(spark, odd_documents):
    marks = lambda df: {r["kept"] for r in df.collect()} | {r["shard"] for r in df.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_documents, SF)
        assert got.dtypes == odd_documents.dtypes and marks(got) <= {True, 8}
        assert stage(spark, odd_documents.limit(0), SF).count() == 0
        kept[name] = got.collect()
    near = kept["n-gram Jaccard join"]
    assert len([r for r in near if r["doc_id"] == 1]) == 1 and {2, 3, 4} <= {r["doc_id"] for r in near}
    assert len(kept["secret scans"]) == 9
    tokens = corpus_pipeline.tokenise(spark, odd_documents, SF)
    assert tokens.count() == 9 and tokens.columns.count("n_tokens") == 1


def test_secret_stage(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        spans = find_secrets(r["text"])[1]
        assert after[i]["text"] == redacted(r["text"], spans)
        assert after[i]["n_chars"] == (len(after[i]["text"]) if spans else r["n_chars"])


def test_mixing_stage(spark, stages):
    labels = queries.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    rows, _, _ = mixing.mixing(stages[3], labels, queries.SHARES)
    want = {r["doc_id"]: r["copies"] for r in rows.where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == want


def test_token_stage(stages):
    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_run_applies_all_stages(spark, stages):
    pick = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.select("doc_id", "ids_sha256").collect())
    assert pick(corpus_pipeline.run(spark, SF)) == pick(stages[-1])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from read_parquet('{SF}/{file}')")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), list(want.columns))


def test_queries_cover_the_ten_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")} == set(range(1, 11))
    assert F  # the functions module is what the operators are built from
