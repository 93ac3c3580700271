"""The semi-Markov field: rules against the contract's patterns, the lattice against all segmentations."""
import random
import re
import time
from hashlib import sha256

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphssl.llm import semi_crf as S

SF = "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and S.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]
            if good():
                out.append((kind, *m.span()))
    return out


def test_rules_random():
    rng = random.Random(4)
    for alphabet in ("a1@.- ", "+1234() .-", "0123456789 -.", "ab@.x%é_", "1.25+ (-)@a\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert S.base_spans(text) == slow_spans(text), text


def test_rules_documents():
    for text in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        assert S.base_spans(text or "") == slow_spans(text or "")


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1 " * 50_000, "+1" + " " * 200_000, "a@b." * 30_000, "1.2." * 40_000,
                                  "9" * 6000 + ".1.1.1"])
def test_long_texts_take_linear_time(text):
    begin = time.time()
    S.base_spans(text)
    S.islands(text)
    assert time.time() - begin < 10


def test_luhn():
    assert S.luhn("4539148803436467") and not S.luhn("4539148803436468")


def all_segmentations(n, table):
    """(score, entities) of every segmentation."""
    def go(i):
        if i == n:
            yield 0.0, ()
            return
        for s, e in go(i + 1):
            yield s, e
        for length in range(1, min(S.MOST_TOKENS, n - i) + 1):
            for k in range(len(S.KINDS)):
                if np.isfinite(table[i + length, length, k]):
                    for s, e in go(i + length):
                        yield s + table[i + length, length, k], ((i, i + length, k), *e)
    return list(go(0))


@pytest.mark.parametrize("text", ["a 12 b", "x@1.y", "+1 2", "no digit", "1(at)b"])
def test_lattice_against_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    lattice = S.Lattice(text, 0, len(text))
    table = lattice.table(lattice.scores(rng.normal(size=(S._FIRST[-1], len(S.KINDS)))))
    every = all_segmentations(lattice.n, table)
    top = max(every, key=lambda x: x[0])
    assert tuple(S.best(table)) == top[1]
    wide = np.full((2, lattice.n + 4, *table.shape[1:]), -np.inf)      # filled up with tokens outside
    wide[:, :lattice.n + 1] = table
    total, p = S.marginals(wide)
    z = sum(np.exp(s) for s, _ in every)
    assert np.allclose(total, np.log(z))
    for i in range(lattice.n):
        for j in range(i + 1, min(lattice.n, i + S.MOST_TOKENS) + 1):
            for k in range(len(S.KINDS)):
                want = sum(np.exp(s) for s, e in every if (i, j, k) in e) / z
                assert np.isclose(p[1, j, j - i, k], want)


def test_candidates_are_whole_span_facts():
    text = "pay 4539 1488 0343 6467 or 1.2.3.400"
    lattice = S.Lattice(text, 0, len(text))
    for i, n, bins in zip(lattice.first, lattice.length, lattice.bins):
        span = text[lattice.edge[i]:lattice.edge[i + n]]
        digits = re.sub("[^0-9]", "", span)
        groups = re.findall("[0-9]+", span)
        assert bins[1] == min(len(digits), 20) and bins[5] == min(span.count("."), 6) and bins[6] == min(span.count(" "), 6)
        assert bins[15] == min(len(groups), 6)
        assert bins[16] == (1 + all(int(g) <= 255 for g in groups) if len(groups) == 4 else 0)
        assert bins[17] == (1 + S.luhn(digits) if 12 <= len(digits) <= 19 else 0)
        assert len(span) <= S.MOST_CHARS and digits and not span.startswith(" ")


def test_gradient():
    rng = np.random.default_rng(2)
    examples = [x for s in ("mail a.b@c1.org now", "call +1 (222) 555-1234 ok", "in 1999") for x in S._examples(s)]
    weights = rng.normal(size=(S._FIRST[-1], len(S.KINDS))) * 0.1
    batch = S.Batch(examples)
    _, grad = batch.loss(weights)
    for at in [tuple(x) for x in np.argwhere(grad != 0)[::97]]:
        step = np.zeros_like(weights)
        step[at] = 1e-5
        slope = (batch.loss(weights + step)[0] - batch.loss(weights - step)[0]) / 2e-5
        assert np.isclose(slope, grad[at], rtol=1e-3, atol=1e-5)


@pytest.mark.parametrize("step", [1, 7, 20, 5000])
def test_pieces_lose_nothing(step):
    rng, text = random.Random(step), ""
    for _ in range(70):
        text += rng.choice(["12", "a", "@", " ", ".", "-", "4539148803436467", "\n"])
    weights = np.random.default_rng(9).normal(size=(S._FIRST[-1], len(S.KINDS))) * 0.4
    taken = [(20, 24), (40, 41)]
    lattice = S.Lattice(text, 0, len(text), taken)
    table = lattice.table(lattice.scores(weights))
    found, p = S.best(table), S.marginals(table[None])[1][0]
    got = S.decode(text, 0, len(text), taken, weights, step)
    assert found and [x[:3] for x in got] == [(int(lattice.edge[i]), int(lattice.edge[j]), k) for i, j, k in found]
    assert np.allclose([x[3] for x in got], [p[j, j - i, k] for i, j, k in found])


def test_long_stretch_of_triggers():
    text, weights = "1 2-3.4@" * 12_000, np.random.default_rng(1).normal(size=(S._FIRST[-1], len(S.KINDS))) * 0.1
    assert S.added_spans(text, [], weights, 0.0)


def test_islands_lose_nothing():
    """The best segmentation of the islands is that of the whole text."""
    rng = random.Random(8)
    weights = np.random.default_rng(3).normal(size=(S._FIRST[-1], len(S.KINDS))) * 0.4
    words = ["word", "12", "@", " ", " ", "\n", "x.y", "+1", "longerword" * 3, "(at)", "é", "555-1234"]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "pad " * 20]) for _ in range(25))
        whole = S.Lattice(text, 0, len(text))
        want = [(int(whole.edge[i]), int(whole.edge[j]), k) for i, j, k in S.best(whole.table(whole.scores(weights)))]
        got = []
        for a, b in S.islands(text):
            part = S.Lattice(text, a, b)
            got += [(int(part.edge[i]), int(part.edge[j]), k) for i, j, k in S.best(part.table(part.scores(weights)))]
        assert got == want


@pytest.fixture(scope="module")
def weights(spark):
    return S.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_training_is_repeatable(spark, weights):
    assert np.array_equal(weights, S.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(3)))


def test_held_out(spark, weights):
    """Forms that the rules miss, in documents that training has not seen; nothing in documents without."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()[2000:]
    found = total = wrong = clean = 0
    for text in texts:
        base = S.disjoint(S.base_spans(text or ""))
        if not base:
            clean += 1
            wrong += bool(text and S.added_spans(text, [], weights))
            continue
        kind, s, e = base[0]
        for other in S.variants(kind, text[s:e]):
            a, b = max(0, s - 200), e + 200
            shown = text[a:s] + other + text[e:b]
            rules = S.base_spans(shown)
            total += 1
            found += (kind, s - a, s - a + len(other)) in rules + S.added_spans(shown, rules, weights)
    assert total > 500 and found / total > 0.85
    assert clean > 5000 and wrong / clean < 0.002


@pytest.mark.parametrize("which", ["odd", "none"])
def test_rows(spark, weights, which, request):
    df = request.getfixturevalue(which)
    got = S.personal_data(df, weights)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sorted((str(r["doc_id"]), sha256(S._listed(S.base_spans(r["text"] or "")).encode()).hexdigest()) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got.collect()) == want


def test_query_rows(spark, make, weights):
    texts = ["mail é a.b@c.org, +1 (222) 555-1234", "é 10.0.0.255 4539148803436467 x 300.1.1.1", None, "call (212) 555-0199 now"]
    rows = S.personal_data(make([(i, t, "a") for i, t in enumerate(texts)]), weights).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        base, spans = S.base_spans(text), [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert base == slow_spans(text) and {(k, str(s), str(e)) for k, s, e in base} <= set(spans)
        assert [r[f"n_{k}"] for k in S.KINDS] == [sum(x[0] == k for x in spans) for k in S.KINDS]


def test_query_counts_base_spans(spark, make, tmp_path):
    """The query's counts are fixed by the rules; what the field adds is in ``spans`` alone."""
    from graphssl.llm.queries import op13_semi_markov_pii

    rng = random.Random(6)
    texts = [f"please call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} now" for _ in range(60)]
    texts += ["please call (212) 555-0199 now", None, "host 10.0.0.255 up"]
    make([(i, t, "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op13_semi_markov_pii(spark, str(tmp_path)).collect()
    added = 0
    for r in rows:
        base = slow_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in S.KINDS] == [sum(x[0] == k for x in base) for k in S.KINDS]
        assert r["base_sha256"] == sha256(S._listed(base).encode()).hexdigest()
        added += len([x for x in r["spans"].split(",") if x]) - len(base)
    assert len(rows) == len(texts) and added > 0


def test_nothing_to_learn_from(spark, make):
    docs = make([(0, "only 12 words and 34 numbers", "a"), (1, None, "b")])
    rows = S.personal_data(docs, S.train(docs)).collect()
    assert all(r["spans"] == "" for r in rows) and len(rows) == 2
    assert S.personal_data(make([]), S.train(make([]))).collect() == []
