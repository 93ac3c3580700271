"""Operators whose results are exact, against brute force."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from graphssl.llm import backoff, bloom_dedup, bpe, mixing, preference, suffix_levels

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def docs_of(df):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in df.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- exact dedup ------------------------------------------------------------------------------------------------

def dedup_expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[sha(re.sub(r"[\x20\x09-\x0D]+", " ", t))].append(i)
    out = Counter()
    for s, ids in groups.items():
        first = min(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            out[(i, first, len(ids), k == 0, s)] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_exact_duplicates(which, request):
    df = request.getfixturevalue(which)
    got = Counter(tuple(r) for r in bloom_dedup.exact_duplicates(df).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == dedup_expected(docs_of(df))
    stay = bloom_dedup.drop_exact_duplicates(df)
    assert stay.columns == df.columns
    kept = Counter((i, s) for (i, _, _, k, s), n in got.items() if k for _ in range(n))
    assert Counter((r["doc_id"], sha(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""))) for r in stay.collect()) == kept


def test_filter_never_misses_a_repeat(spark):
    keys = spark.range(4000).select((F.col("id") % 3500).cast("string").alias("k"))
    split = bloom_dedup.split_by_filter(keys, "k", 4000).collect()
    count = Counter(r["k"] for r in split)
    assert all(r["maybe_repeated"] for r in split if count[r["k"]] > 1)
    assert sum(r["maybe_repeated"] for r in split) < 1500        # and most unique rows pass


# -- tokens -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_bpe_equals_the_library(which, request):
    df, path = request.getfixturevalue(which), public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in docs_of(df):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, bpe.encode_decode_digests(df, path).collect())) == want


def test_bpe_keeps_few_strings():
    """Whatever a worker keeps, the ids are the same; a word between spaces is kept once."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    whole, lean = bpe.Tokenizer(text), bpe.Tokenizer(text, 3, 2)
    for t in ("the quick brown fox it's 12 foxes", "a  b\n c", "", " x", "quick brown fox, again the fox", "é日本 <|endoftext|> fox"):
        assert whole.encode(t).tolist() == lean.encode(t).tolist()
    assert len(lean._word_ids) <= 3 and len(lean._spaced_ids) <= 2
    once = bpe.Tokenizer(text)
    once.encode("the quick brown fox")
    assert set(once._spaced_ids) == {"quick", "brown", "fox"} and set(once._word_ids) == {"the"}


def test_bpe_round_trip(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(odd, path), path)
    assert Counter(map(tuple, back.collect())) == Counter((i, t) for i, t, _ in docs_of(odd))


def merged(word, ranks):
    """Merge by merge, the lowest rank first, leftmost on a tie."""
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        rank = min(pairs)[0]
        k, out = 0, []
        while k < len(parts):
            if k + 1 < len(parts) and ranks.get((parts[k], parts[k + 1])) == rank:
                out.append(parts[k] + parts[k + 1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


def test_automaton_on_random_merge_lists():
    import random
    r = random.Random(4)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                merges.append((a, b))
                tokens.append(a + b)
        ids = {t: i for i, t in enumerate(tokens)}
        m = bpe.MergeAutomaton([0, 1, 2], {i: t for t, i in ids.items()})
        for rank, (a, b) in enumerate(merges):
            m.gadget(rank, ids[a], ids[b], ids[a + b])
        m.finish()
        ranks = {p: k for k, p in enumerate(merges)}
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 16)))
            assert [tokens[i] for i in m.path(word)] == merged(word, ranks), (merges, word)


# -- repeated strings -------------------------------------------------------------------------------------------

def repeats_expected(rows):
    seen, out = set(), Counter()
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1]))):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            else:
                seen.add(b[p:p + 100])
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_suffix_levels(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    got = Counter(map(tuple, suffix_levels.remove_repeats(df).collect()))
    assert got == repeats_expected(docs_of(df))


def test_rows_that_share_an_id(make):
    """Only bytes that stand elsewhere go, whatever the doc_ids."""
    p, u, v = (" ".join(f"{c}{k}" for k in range(60)) for c in "puv")
    for ids in ((None, None, None, 4), (1, 1, 1, 1), (2, 2, None, 3)):
        df = make([(i, t, "s") for i, t in zip(ids, (p + u, v + p, p + u, u + "x"))])
        got = Counter(map(tuple, suffix_levels.remove_repeats(df).collect()))
        assert got == repeats_expected(docs_of(df))


def test_levels_of_small_batches():
    import random

    import numpy as np
    r, index, seen = random.Random(5), suffix_levels.Levels(), set()
    for _ in range(40):
        text = bytes(r.choice(b"ab") for _ in range(5)) * 60
        text = text[:r.randint(100, 300)]
        starts = np.arange(len(text) - 99)
        want = []
        for s in starts:
            want.append(text[s:s + 100] in seen)
            seen.add(text[s:s + 100])
        assert index.add(np.frombuffer(text, np.uint8), starts).tolist() == want
    assert len(index.levels) <= 8


# -- backoff ----------------------------------------------------------------------------------------------------

def backoff_expected(rows, order):
    texts = [WORD.findall(t) for _, t, _ in rows]
    grams = [Counter(tuple(w[k - m:k]) for m in range(1, order + 1) for k in range(m, len(w) + 1)) for w in texts]
    total, n = sum(grams, Counter()), sum(map(len, texts))
    out = []
    for (i, _, _), w, own in zip(rows, texts, grams):
        c = lambda g: total[g] - own[g]
        s, short = 0.0, 0
        for k in range(len(w)):
            for m in range(min(order, k + 1), 0, -1):
                g = tuple(w[k + 1 - m:k + 1])
                if m == 1:
                    s += math.log(max(c(g), 0.5) / max(n - len(w), 1))
                    short += 1
                elif c(g) > 0:
                    s += math.log(c(g) / c(g[:-1]))
                    break
                else:
                    s += math.log(0.4)
        out.append(((i is not None, i or 0), len(w), short, s))
    return sorted(out)


@pytest.mark.parametrize("which,order", [("odd", 2), ("some", 2), ("some", 3), ("none", 2)])
def test_backoff(which, order, request):
    df = request.getfixturevalue(which)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_words"], r["n_short"], r["log_score"])
                 for r in backoff.backoff_scores(df, order).collect())
    want = backoff_expected(docs_of(df), order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-4 for g, w in zip(got, want))      # the scores are rounded to 4 places


# -- mixing -----------------------------------------------------------------------------------------------------

def targets_expected(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_mixing(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    rows = docs_of(df)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    target = targets_expected(sizes) if rows else {}
    got = mixing.mix_report(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t))) for i, t, _ in rows)
    by_source = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[r["source_size"], round(r["target"], 6)].append(r["taken"])
    want = Counter()
    for s, t in target.items():
        want[sizes[s], round(t, 6)] += round(t)
    assert {k: sum(v) for k, v in by_source.items()} == dict(want)
    again = mixing.mix_report(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_rows_hold_the_taken_words(some, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    out = mixing.mixed_documents(some)
    assert out.columns == some.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix_report(some).collect() if r["taken"]})


def test_mixed_rows_of_one_doc_id_stay_apart(make, odd):
    rows = [(1, "a b c", "s"), (1, "d e f", "s"), (1, "g h", "s"), (2, "i", "s"), (2, "i", "s"),
            *((None, f"n{k} m", "s") for k in range(6)), (None, "n0 m", "s"), (None, None, "s")]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(make(rows)).collect())
    assert got == Counter((i, t) for i, t, _ in rows if t)          # the one source is taken once
    got = mixing.mixed_documents(odd).collect()
    words = Counter()
    for r in got:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    taken = Counter()
    for r in mixing.mix_report(odd).collect():
        taken[r["doc_id"]] += r["taken"]
    assert words == +taken
    texts = {(r["doc_id"], r["source"]): r["text"] for r in odd.collect() if r["text"]}
    assert all(texts[r["doc_id"], r["source"]].startswith(r["text"]) for r in got)


def test_tree_keeps_quotas_and_draws_hypergeometrically(spark):
    quotas = spark.createDataFrame([(o, n) for o, n in enumerate([300, 100, 7, 1])], "ord long, n long")
    got = mixing.split_tree(quotas, 3, 1).collect()
    total = Counter()
    shard = Counter()
    for r in got:
        total[r["ord"]] += r["n"]
        shard[r["shard"]] += r["n"]
    assert total == Counter({0: 300, 1: 100, 2: 7, 3: 1}) and set(shard.values()) == {51}
    grid = [(r + 0.5) / 400 for r in range(400)]
    df = spark.createDataFrame([(u,) for u in grid], "u double")
    k = df.select(mixing.hypergeometric(F.lit(30), F.lit(12), F.lit(10), F.col("u")).alias("k")).collect()
    count = Counter(r["k"] for r in k)
    for x in range(11):
        p = math.comb(12, x) * math.comb(18, 10 - x) / math.comb(30, 10)
        assert abs(count[x] / 400 - p) < 0.005


# -- preference pairs -------------------------------------------------------------------------------------------

def render(turns):
    text, spans = "", []
    for role, t in turns:
        begin = len(text) + len(f"<|turn|>{role}\n")
        if role == "assistant":
            spans.append(f"{begin}-{begin + len(t) + len('<|end|>')}")
        text += f"<|turn|>{role}\n{t}<|end|>\n"
    return text, ";".join(spans)


def test_preference_rows(spark):
    u, a, b = ("user", "hé 🙂"), ("assistant", "yes"), ("assistant", "no")
    cases = [([u, a], [u, b]), ([u, a], [u, a]), ([u], [u, a]), ([], [a]), ([], []), ([a, u, b], [a, u, a, u]),
             (None, [u]), ([("user", None), (None, "x")], [("user", ""), (None, "y")])]
    pairs = spark.createDataFrame(list(enumerate_pairs(cases)), f"pair_id long, chosen {preference._TURNS}, rejected {preference._TURNS}, prompt string")
    got = {r["pair_id"]: r for r in preference.preference_rows(pairs).collect()}
    for k, (c, r) in enumerate(cases):
        c, r = ([(x or "", y or "") for x, y in s or []] for s in (c, r))
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        row = got[k]
        assert (row["n_shared"], row["prompt"]) == (n, render(c[:n])[0])
        assert (row["chosen"], row["chosen_mask"]) == render(c[n:])
        assert (row["rejected"], row["rejected_mask"]) == render(r[n:])


def enumerate_pairs(cases):
    for k, (c, r) in enumerate(cases):
        yield k, c, r, "clash"


def test_swapped_replies(spark):
    rows = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "r1", "x"), (1, 2, "user", None, "x"), (2, 0, "user", "only", "x"),
            (4, 0, None, "sys", "x"), (4, 1, "assistant", "r4", "x"), (4, 1, "assistant", "r4", "x"), (None, 0, "user", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r["pair_id"]: [(x["role"], x["text"]) for x in r["rejected"]] for r in preference.swapped_replies(turns).collect()}
    assert got == {1: [("user", "q"), ("assistant", ""), ("user", "")],
                   2: [("user", "only"), ("assistant", "r4")],
                   4: [("", "sys"), ("assistant", "r4"), ("assistant", "r1")]}
    assert preference.preference_rows(preference.swapped_replies(turns.limit(0))).collect() == []
