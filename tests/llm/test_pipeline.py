"""The pipeline's stages, one after the other, and the registered queries."""
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from graphssl.llm import queries
from graphssl.llm.dart_minhash import near_duplicates
from graphssl.llm.mixing import mix_report
from graphssl.llm.toxicity import score
from graphssl.session import write_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = write_table(stage(spark, docs, SF), name)
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != "tokens":
            assert out.columns == columns
        if name == "toxicity":
            assert set(ids) == {r["doc_id"] for r in score(docs, labels).collect() if r["score"] < 0.5}
        if name == "exact_dedup":
            assert out.select("text").distinct().count() == out.count()
        if name == "near_dedup":
            assert set(ids) == {r["class_id"] for r in near_duplicates(docs).collect()}
        if name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mix_report(docs).collect()}
            assert set(ids) == {i for i, n in taken.items() if n}
        if name == "tokens":
            assert ids == before
        seen[name] = ids
        docs = out
    assert list(seen) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "tokens"]


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 3) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert (Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
            == Counter(tuple(map(plain, r)) for r in want.fetchall()))
