"""The Merkle manifest against a plain tree."""
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphssl.llm import merkle, scan

SF = "/root/testdata/sf0.001"


def sha(s):
    return sha256(s.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, pos):
    out = []
    for row in tree[:-1]:
        out.append((row[pos ^ 1] if pos ^ 1 < len(row) else None, pos & 1))
        pos >>= 1
    return out


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        told = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
            told = (*r[:3], r[3] + 1, r[4])
        trees[r[2]].append(((r[0] is not None, r[0] or 0), leaf(r), r[0], leaf(told)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {x: levels([r[1] for r in sorted(trees[x])]) for x in langs}
    top = levels([grown[x][-1][0] for x in langs])
    out = Counter()
    for k, x in enumerate(langs):
        for pos, (_, own, doc_id, told) in enumerate(sorted(trees[x])):
            proof = siblings(grown[x], pos) + siblings(top, k)
            h = told
            for other, left in proof:
                h = sha(h if other is None else other + h if left else h + other)
            out[(doc_id, own, grown[x][-1][0], top[-1][0], sha("".join(o for o, _ in proof if o)), h, h == top[-1][0])] += 1
    return out


def fields(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.fixture(scope="module")
def tangled(spark, odd):
    """Null and empty langs, null doc_ids, repeated rows."""
    more = odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "zz"))
    return odd.withColumn("n_chars", F.when(F.col("doc_id") != 4, F.col("n_chars"))).unionByName(more).unionByName(more.limit(3))


@pytest.mark.parametrize("which", ["tangled", "none", "some"])
@pytest.mark.parametrize("bits", [2, merkle.BITS])
def test_proofs(spark, which, bits, request):
    df = spark.read.parquet(f"{SF}/documents.parquet") if which == "some" else request.getfixturevalue(which)
    tree = merkle.manifest(merkle.tampered_leaves(df), bits)
    got = Counter(tuple(r) for r in merkle.prove(tree, bits=bits).collect())
    assert got == expected(fields(df))


@pytest.mark.parametrize("bits", [2, 4])
def test_proofs_of_some_leaves(spark, bits):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    tree = merkle.manifest(merkle.tampered_leaves(df), bits)
    some = tree.leaves.where(F.col("doc_id") % 11 < 2)
    want = Counter({k: n for k, n in expected(fields(df)).items() if k[0] % 11 < 2})
    assert Counter(tuple(r) for r in merkle.prove(tree, some, bits).collect()) == want


def test_one_row(make):
    df = make([(7, "x", None)])
    assert Counter(tuple(r) for r in merkle.prove(merkle.manifest(merkle.tampered_leaves(df))).collect()) == expected(fields(df))


def test_missing_is_enough_and_least():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        have = rng.sample(range(n), rng.randint(1, n))
        need = set()
        for p in have:                                   # every sibling that some proof needs ...
            m, i = n, p
            for level in range(merkle.height(n)):
                if i ^ 1 < m:
                    need.add((level, i ^ 1))
                i, m = i >> 1, (m + 1) // 2
        given = {(level, p >> level) for p in have for level in range(40)}
        assert set(merkle.missing(np.array(have), n)) == need - given    # ... and no leaf gives


@pytest.mark.parametrize("parts", [1, 5])
def test_scan(spark, parts):
    rows = [(None, i, i % 4) for i in range(30)] + [("a", i, 2) for i in range(500)] + [(f"k{i}", 0, i) for i in range(20)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(parts)
    got = scan.segmented_scan(df, "k", ["o"], ["v"], [0], lambda a, b: [a[0] + b[0]], "test").collect()
    keys = sorted({k for k, _, _ in rows}, key=lambda k: (k is not None, k or ""))
    want = Counter()
    for rank, k in enumerate(keys):
        s = 0
        for _, o, v in sorted(r for r in rows if r[0] == k) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            s += v
            want[(k, o, s, rank)] += 1
    assert Counter(tuple(r) for r in got) == want
