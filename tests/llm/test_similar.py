"""Fingerprints, near-duplicates, paragraphs, toxicity and the pipeline."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphssl.llm import dart_minhash, edit_fingerprint, paragraphs, similar, toxicity
from graphssl.llm.common import utf8

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    w = WORD.findall(text)
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    union = sum((a | b).values())
    return union > 0 and sum((a & b).values()) >= 0.8 * union - 1e-9


def classes(items, same):
    """Smallest item of each component."""
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in same:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


# -- fingerprints -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_fingerprints(which, request):
    df = request.getfixturevalue(which)
    rows = sorted(docs_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = edit_fingerprint.fingerprints(df).collect()
    want = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        e = t[:len(t) - k] + n[:k]
        a, b, c = (edit_fingerprint.walk([x])[0] for x in (t, e, n))
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(),
              round(edit_fingerprint.likeness(a, b), 9), round(edit_fingerprint.likeness(a, c), 9))] += 1
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got)) == want


def slow_walk(text):
    """The embedding a step at a time."""
    s = edit_fingerprint._symbols(text)
    level = int(edit_fingerprint.scale_of(np.array([len(text)]))[0])
    out, at, step = bytes([level]), 0, 0
    while text and step < 3 * len(text):
        j = step % edit_fingerprint.BLOCK
        if j == 0:
            coins = edit_fingerprint._coins(step // edit_fingerprint.BLOCK)
            levels = edit_fingerprint._levels(step, edit_fingerprint.BLOCK)
        if levels[j] >= level and s[at]:
            out += bytes([s[at]])
        at += coins[j][s[at]]
        step += 1
    return out


def test_walk_step_by_step():
    texts = ["", "a", "abc", "x" * 70, "hello wörld 🙂 " * 30, "".join(chr(97 + (k * k) % 23) for k in range(9000))]
    assert edit_fingerprint.walk(texts) == [slow_walk(t) for t in texts]


def test_edited_texts_go_on_from_their_texts():
    r = np.random.default_rng(12)
    text = lambda n: "".join(r.choice(list("abcdé "), n))
    texts = [text(int(n)) for n in [1, 3, 4, 5, 63, 65, 130, 700, 2500, 2600, 9000, 40]]
    edited = [edit_fingerprint.edited_text(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    forks = {len(texts) + i: (i, len(t) - len(t) // 4) for i, t in enumerate(texts)}
    every = texts + edited
    assert edit_fingerprint.walk(every, forks) == [edit_fingerprint.walk([t])[0] for t in every]


def whole_walk(text):
    """The embedding a step at a time, up to the text's end."""
    symbols, out, at, step = edit_fingerprint._symbols(text), bytes([0]), 0, 0
    coins, levels = edit_fingerprint._coins(0), edit_fingerprint._levels(0, edit_fingerprint.BLOCK)
    while symbols[at]:
        out += bytes([symbols[at]]) if levels[step] >= 0 else b""
        at += coins[step][symbols[at]]
        step += 1
    return out


def test_short_texts_are_walked_whole():
    r = np.random.default_rng(5)
    texts = ["n/a", *"cjnqryQ", *("".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 1 + k % 12)) for k in range(300))]
    want = [whole_walk(t) for t in texts]
    assert any(len(w) - 1 > 3 * len(t) for w, t in zip(want, texts))
    assert [edit_fingerprint.walk([t])[0] for t in texts] == want
    beside = ["x" * 60, "a longer text of one level", "z" * 5000]
    assert edit_fingerprint.walk([*texts, *beside])[:len(texts)] == want


def test_likeness_falls_with_edits():
    r = np.random.default_rng(1)
    base = "".join(r.choice(list("abcdefghij "), 3000))
    near = base[:700] + "zz" + base[700:2000] + base[2003:]
    far = "".join(r.choice(list("abcdefghij "), 3000))
    a, b, c = edit_fingerprint.walk([base, near, far])
    assert edit_fingerprint.likeness(a, b) > 0.8 > 0.3 > edit_fingerprint.likeness(a, c)
    assert edit_fingerprint.likeness(a, a) == 1


def test_near_pairs(make):
    r = np.random.default_rng(2)
    rows = []
    for k in range(30):
        t = "".join(r.choice(list("abcdefghij "), 600 + 200 * k))
        rows += [(3 * k, t, "s"), (3 * k + 1, t, "s"), (3 * k + 2, t[:200] + "QQ" + t[200:], "s")]
    prints = edit_fingerprint.fingerprints(make(rows))
    got = {x["doc_id"]: x["class_id"] for x in edit_fingerprint.near_pairs(prints).collect()}
    assert sum(got[3 * k + 1] == 3 * k for k in range(30)) == 30
    assert sum(got[3 * k + 2] == 3 * k for k in range(30)) >= 28
    assert all(c // 3 == i // 3 for i, c in got.items())


def test_bands_see_edits_at_the_front():
    r = np.random.default_rng(6)
    near = met = 0
    for n in range(8, 128):
        x = r.integers(1, 256, n).astype(np.uint8)
        for share in (0.05, 0.1, 0.15):
            y = x[:n - n // 20].copy()                              # shorter, and other samples at the front
            y[:int(share * n)] = r.integers(1, 256, int(share * n))
            a, b = bytes(1) + x.tobytes(), bytes(1) + y.tobytes()
            keys = [set(k) for k in edit_fingerprint._bands(pd.Series([a.hex(), b.hex()]))]
            if edit_fingerprint.likeness(a, b) >= 0.8:
                near, met = near + 1, met + bool(keys[0] & keys[1])
    assert near > 300 and met >= 0.94 * near


def test_near_classes_keep_rows_without_doc_id(make):
    r = np.random.default_rng(7)
    t, u = ("".join(r.choice(list("abcdefghij "), 900)) for _ in range(2))
    rows = [(None, t, "s"), (None, t + "x", "s"), (5, u, "s"), (5, t, "s"), (4, u, "s"), (None, "", "s")]
    got = edit_fingerprint.near_pairs(edit_fingerprint.fingerprints(make(rows))).collect()
    assert Counter((x["doc_id"], x["class_id"], x["n_chars"]) for x in got) == Counter(
        [(None, 5, 900), (None, 5, 901), (5, 5, 900), (5, 4, 900), (4, 4, 900), (None, None, 0)])
    assert len({x["class_key"] for x in got}) == 3


def test_near_classes_against_all_pairs(spark):
    """The components of all pairs that share a band and are alike; among them a crowd of
    texts with the same opening."""
    r = np.random.default_rng(9)
    text = lambda n: "".join(r.choice(list("abcdefghij "), n))
    opening, texts = text(900), []
    texts += [opening + text(int(n)) for n in r.integers(100, 2200, 120)]
    for _ in range(30):
        t = text(int(r.integers(40, 1500)))
        texts += [t, t + text(len(t) // 10), t[: len(t) * 9 // 10], text(len(t) // 8) + t]
    prints = edit_fingerprint.walk(texts)
    keys = edit_fingerprint._bands(pd.Series([p.hex() for p in prints]))
    bands = [set(k) for k in keys]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
             if prints[a] == prints[b] or bands[a] & bands[b] and edit_fingerprint.likeness(prints[a], prints[b]) >= 0.8]
    want = classes(set(range(len(texts))), pairs)
    df = spark.createDataFrame([(i, p.hex()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {x["doc_id"]: x["class_id"] for x in edit_fingerprint.near_pairs(df).collect()}
    assert got == want and 30 < len(set(want.values())) < len(texts)


def test_prints_of_one_level_are_told_apart_at_that_level(spark, monkeypatch):
    """Equal samples at the next level are no reason to write a pair whose own level differs in 30 %."""
    r = np.random.default_rng(14)
    base = r.integers(1, 256, 120).astype(np.uint8)
    free = np.flatnonzero(~edit_fingerprint._kept(3, 4, 120))
    rows = []
    for i in range(20):
        x = base.copy()
        x[r.choice(free, 45, replace=False)] = r.integers(1, 256, 45)
        rows.append((i, (bytes([3]) + x.tobytes()).hex()))
    written, write = [], similar.write_table

    def counted(df, name="table"):
        out = write(df, name)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(similar, "write_table", counted)
    got = edit_fingerprint.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == {i: i for i, _ in rows}
    assert sum(written) == 0


# -- near-duplicates --------------------------------------------------------------------------------------------

def near_expected(rows):
    """``(doc_id, class_id, class_size, kept)`` of every row, by all pairs of rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    s = [(shingles(t or ""), t or "") for _, t in rows]
    same = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if s[a][1] == s[b][1] or alike(s[a][0], s[b][0])]
    of = classes(set(range(len(s))), same)
    size = Counter(of.values())
    return Counter((rows[k][0], rows[of[k]][0], size[of[k]], of[k] == k) for k in range(len(rows)))


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    want = near_expected(docs_of(df))
    got = Counter(map(tuple, dart_minhash.near_duplicates(df).select("doc_id", "class_id", "class_size", "kept").collect()))
    assert got == want
    kept = dart_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in want.elements() if r[3])


def test_rows_without_doc_id_are_near_duplicates(make):
    words = [f"w{i}" for i in range(100)]
    t, u = " ".join(words), " ".join([*words[:99], "other"])
    df = make([(1, t, "s"), (None, u, "s"), (None, u, "s"), (1, u, "s"), (1, t, "s"), (2, "alone here", "s")])
    assert Counter(map(tuple, dart_minhash.near_duplicates(df).select("doc_id", "class_id", "class_size", "kept").collect())) \
        == near_expected(docs_of(df))
    assert Counter((r["doc_id"], r["text"]) for r in dart_minhash.drop_near_duplicates(df).collect()) == Counter(
        [(None, u), (2, "alone here")])


@pytest.mark.parametrize("refined", [False, True])
def test_hot_bucket_loses_no_component(spark, refined):
    """One bucket with two chains whose links no single leader sees."""
    texts, items = {}, []
    for chain in range(2):
        for k in range(12):
            words = [f"c{chain}w{j}" for j in range(4 * k, 4 * k + 60)]
            texts[chain * 100 + k] = " ".join(words)
    items = spark.createDataFrame([(1, i) for i in texts], "bucket long, item long")
    table = spark.createDataFrame(list(texts.items()), "item long, text string")
    calls = []
    refine = lambda x: calls.append(1) or similar.prefix_elements(x, similar.texts_of(table), 5, 0.8)
    alike_pairs = lambda p: similar.similar_pairs(p, similar.texts_of(table), 5, 0.8)
    links = similar.bucket_links(items, alike_pairs, refine if refined else None, 0.8 if refined else 0.0)
    assert len(calls) == refined
    label = {r["item"]: r["label"] for r in similar.components(links).collect()}
    s = {i: shingles(t) for i, t in texts.items()}
    want = classes(texts, [(a, b) for a in texts for b in texts if a < b and alike(s[a], s[b])])
    assert {i: label.get(i, i) for i in texts} == want and len(set(want.values())) == 2


def test_a_bucket_is_read_in_few_rounds(spark, monkeypatch):
    """A bucket of many items, nearly all unlike: the rows of all rounds do not grow with the square of its size."""
    n = 600
    buckets = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("item"))
    read, between = [], similar._between
    monkeypatch.setattr(similar, "_between", lambda rows, *rest: read.append(rows.count()) or between(rows, *rest))
    links, label = similar.bucket_classes(buckets, lambda pairs: pairs.filter("b - a = 550"))
    assert sorted(map(tuple, links.collect())) == [(k, k + 550) for k in range(50)]
    assert sorted(map(tuple, label.collect())) == sorted([(k, k) for k in range(50)] + [(k + 550, k) for k in range(50)])
    assert len(read) <= 3 and sum(read) <= 3 * n


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["item"]: r["label"] for r in similar.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 160)}}


def test_components_keep_links_between_roots_only(spark, monkeypatch):
    """A round hands on the links between different roots, fewer each time."""
    sizes, write = [], similar.write_table

    def counted(df, name="table"):
        out = write(df, name)
        sizes.extend([out.count()] if name == "links" else [])
        return out
    monkeypatch.setattr(similar, "write_table", counted)
    order = np.random.default_rng(4).permutation(200).tolist()
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = {r["item"]: r["label"] for r in similar.components(links).collect()}
    assert got == dict.fromkeys(order, 0)
    assert len(sizes) > 1 and sizes[-1] == 0 and all(2 * y <= x for x, y in zip(sizes, sizes[1:]))


def test_paragraphs_are_written_once_with_their_bands(odd, monkeypatch):
    """The codes of a unit come back with the unit, and items need no further look at them."""
    written, write = {}, paragraphs.write_table

    def noted(df, name="table"):
        written[name] = df.columns
        return write(df, name)
    monkeypatch.setattr(paragraphs, "write_table", noted)
    paragraphs.repeated_paragraphs(odd)
    assert "hits" not in written and "band0" in written["lines"] and "band0" in written["items"]


def test_texts_of_unlike_paragraphs_are_not_fetched(make, monkeypatch):
    """Paragraphs that share a band but too few shingles are told apart by their parities."""
    r = np.random.default_rng(3)
    texts = []
    for k in range(40):
        base = [f"w{x}" for x in r.integers(0, 10**6, 40)]
        near = base[:37] + ["other"] * 3
        half = base[:22] + [f"v{x}" for x in r.integers(0, 10**6, 18)]
        texts += [" ".join(x) for x in (base, near, half)]
    seen, pairs = [], similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda p, *rest: seen.append(p.count()) or pairs(p, *rest))
    got = {x["doc_id"]: x for x in paragraphs.remove_paragraphs(make([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert {i for i, x in got.items() if x["n_removed"]} == {i for i in range(120) if i % 3 == 1}
    assert all(got[i]["first_doc_ids"] == [i - 1] for i in range(1, 120, 3))
    assert sum(seen) == 40


def test_merged_components(spark):
    """Later links join what is there: named and unnamed items, and several components at once."""
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    first = [(5, 6), (6, 7), (20, 21), (30, 31), (40, 41)]
    later = [(3, 7), (21, 31), (50, 51), (2, 3), (51, 52), (6, 7), (60, 60)]
    label = similar.merged(similar.components(frame(first)), frame(later))
    want = {r["item"]: r["label"] for r in similar.components(frame(first + later)).collect()}
    assert {r["item"]: r["label"] for r in label.collect()} == want and label.count() == len(want)
    assert {r["item"]: r["label"] for r in similar.merged(label, frame([])).collect()} == want


def test_dart_agreement_is_weighted_jaccard():
    r = np.random.default_rng(3)
    h = np.unique(r.integers(1, 1 << 63, 400).astype(np.uint64))
    w = np.stack([r.integers(0, 5, len(h)), r.integers(0, 5, len(h))]).astype(float)
    w[1, :250] = w[0, :250]
    w[:, 0] = [0.5, 1.5]
    row, el = np.nonzero(w)
    sig = dart_minhash.dart_signatures(h[el], w[row, el], row, 2, 3000)
    jaccard = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((sig[0] == sig[1]).mean() - jaccard) < 0.03


# -- paragraphs -------------------------------------------------------------------------------------------------

def paragraph_units(text):
    """``(begin, text, whole)`` of lines with a word, and of sentences of eight words of longer lines, in bytes."""
    at = 0
    for line in text.split("\n"):
        if WORD.findall(line):
            yield at, line, True
        b = at
        for part in re.findall(r"(?s:.*?[.!?](?=[\x20\x09-\x0D])|.+\Z)", line):
            if paragraphs.SENTENCE_WORDS <= len(WORD.findall(part)) < len(WORD.findall(line)):
                yield b, part, False
            b += len(part.encode())
        at += len(line.encode()) + 1


def paragraphs_expected(rows):
    """Per row (in the order of doc_id, text digest) the units that repeat: begin, bytes, words, first doc_id, whole."""
    found = [(i, at, -len(x.encode()), x, w) for i, (_, t) in enumerate(rows) for at, x, w in paragraph_units(t)]
    s = [shingles(x[3]) for x in found]
    by_text, having = defaultdict(list), defaultdict(list)
    for k, x in enumerate(s):
        by_text[frozenset(x.items())].append(k)         # equal bags of shingles: one of them meets the others
    for bag, ks in by_text.items():
        for g, _ in bag:
            having[g].append(ks[0])
    same = {(a, b) for ks in having.values() for n, a in enumerate(ks) for b in ks[n + 1:]}     # alike ones share a shingle
    same = [(a, b) for a, b in same if alike(s[a], s[b])] + [(ks[0], k) for ks in by_text.values() for k in ks[1:]]
    label = classes(range(len(s)), same)
    members = defaultdict(list)
    for k, c in label.items():
        members[c].append(found[k])
    gone = defaultdict(set)
    for m in members.values():
        f = min(m)
        for i, at, less, x, whole in m:
            if i != f[0] or at >= f[1] - f[2] or at - less <= f[1]:
                gone[i].add((at, -less, len(WORD.findall(x)), rows[f[0]][0], whole))
    return gone


def paragraph_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    repeated, want = paragraphs_expected(rows), Counter()
    for k, (i, t) in enumerate(rows):
        raw = t.encode()
        lines = [g for g in repeated[k] if g[4]]
        units = sorted(lines + [g for g in repeated[k] if not g[4] and not any(x[0] <= g[0] < x[0] + x[1] for x in lines)])
        runs = []
        for g in units:
            if runs and len(raw[runs[-1][-1][0] + runs[-1][-1][1]:g[0]].split()) < paragraphs.SENTENCE_WORDS:
                runs[-1].append(g)
            else:
                runs.append([g])
        big = [r for r in runs if sum(g[2] for g in r) >= paragraphs.RUN_WORDS]
        gone = sorted({*lines, *(g for r in big for g in r)})
        goes = np.zeros(len(raw), bool)
        for at, n, _, _, whole in gone:
            goes[at:at + n + (whole and raw[at + n:at + n + 1] == b"\n")] = True
        kept = bytes(x for x, y in zip(raw, goes) if not y)
        long = sum(g[2] >= paragraphs.LONG_WORDS for g in lines)
        passages = sum(not all(g[4] for g in r) for r in big)
        firsts = tuple(sorted({g[3] for g in gone}, key=lambda x: (x is not None, x or 0)))
        want[(i, len(raw), long + passages, len(lines) - long, len(raw) - len(kept), firsts, hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize("which", ["odd", "some", "none"])
def test_paragraphs(which, request):
    df = request.getfixturevalue(which)
    got = Counter((*r[:5], tuple(r[5]), r[6]) for r in map(tuple, paragraphs.remove_paragraphs(df).collect()))
    assert got == paragraph_rows(docs_of(df))


def test_rows_that_share_an_id(make):
    """Only lines that stand elsewhere go, whatever the doc_ids."""
    p, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "puv")
    for ids in ((None, None, 4), (1, 1, 1), (2, 2, None)):
        df = make([(i, t, "s") for i, t in zip(ids, (f"{p}\n{u}", f"{v}\n{p}\nshort line", f"{u}x\nshort line"))])
        got = Counter((*r[:5], tuple(r[5]), r[6]) for r in map(tuple, paragraphs.remove_paragraphs(df).collect()))
        assert got == paragraph_rows(docs_of(df))


def test_short_lines(make):
    """Lines under 20 words: equal ones of any length, and near ones."""
    r = np.random.default_rng(4)
    lines = [" ".join(f"v{x}" for x in r.integers(0, 500, n)) for n in range(1, 20) for _ in range(6)]
    near = [" ".join([*x.split()[:-1], "other"]) for x in lines]
    rows = [(0, "\n".join(lines), "s"), (1, "\n".join(["new", *lines, "", " "]), "s"), (2, "\n".join(near), "s"),
            (3, "x y x y x y", "s"), (4, "y x y x y x", "s"), (5, "a b c d", "s"), (6, "a  b c\td", "s"), (7, "d c b a", "s")]
    found = [(i, at, x) for i, t, _ in rows for at, x, _ in paragraph_units(t)]
    grams = [shingles(x) for _, _, x in found]
    label = classes(range(len(found)), [(a, b) for a in range(len(found)) for b in range(a) if alike(grams[a], grams[b])])
    want = {(found[k][0], found[k][1]) for k, c in label.items() if k != c}
    got = {(x["doc"], x["begin"]) for x in paragraphs.repeated_paragraphs(make(rows)).collect()}
    assert {(4, 0), (6, 0)} <= want and not {(5, 0), (7, 0)} & want and sum(i == 2 for i, _ in want) > 20
    assert got == want


def test_passages_inside_lines(make):
    """Passages of whole sentences go wherever they are set; a single repeated sentence, and a line with its own
    long sentence, stay."""
    r = np.random.default_rng(8)

    def text(n):
        return " ".join(f"q{x}" for x in r.integers(0, 10 ** 6, n))

    passage = ". ".join(text(n) for n in (9, 3, 12, 14, 11)) + "!"
    single = text(15) + "."
    rows = [(0, f"{text(8)}. {passage} {text(30)}\n{single} {text(6)}", "s"), (1, f"{text(40)} {text(9)}. {passage} {text(9)}", "s"),
            (2, f"{passage}\n{text(9)}. {single} {text(12)}?", "s"), (3, f"{text(90)}. End", "s"),
            (4, f"é {text(9)}. {passage}\n\n{passage} {text(7)}. {passage}", "s")]
    df = make(rows)
    got = Counter((*x[:5], tuple(x[5]), x[6]) for x in map(tuple, paragraphs.remove_paragraphs(df).collect()))
    assert got == paragraph_rows(docs_of(df))
    n = {x[0]: x[2] for x in got}
    assert [n[k] for k in range(4)] == [0, 1, 1, 0] and n[4] >= 1


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tuned()
    assert bands <= paragraphs.MOST_BANDS and 1 - (1 - 0.8 ** rows) ** bands >= paragraphs.RECALL


# -- toxicity ---------------------------------------------------------------------------------------------------

def test_gradients():
    """Analytic against numeric."""
    net = toxicity.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Words(*utf8(pa.array(["some bad words here", "a fine day", ""], pa.large_string())))
    pick, label = np.arange(3), np.array([1.0, 0.0, 1.0])
    shown = np.ones(max(1, len(t.word)))

    def loss():
        z = net.forward(net.inputs(t).astype(np.float64), *t.tokens(pick)).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(label == 1, z, -z)))))
    g = net.gradients(t, pick, label, shown)
    r = np.random.default_rng(0)
    for name, value in net.p.items():
        flat, grad = value.reshape(-1), np.asarray(g[name]).reshape(-1)
        places = r.choice(len(flat), min(4, len(flat)), replace=False)
        places = np.unique(np.append(places, np.argmax(np.abs(grad))))
        for k in places:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - grad[k]) < 2e-3, (name, k)


@pytest.fixture(scope="module")
def toxic_table(spark, make):
    r = np.random.default_rng(7)
    words = np.array([f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lan", "mor", "nit", "pos", "rut", "sel")])
    rows, labels = [], []
    for i in range(500):
        text = list(r.choice(words, r.integers(5, 160)))
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            text.insert(int(r.integers(0, len(text))), "zorg" + str(r.choice(["a", "ix", "um"])))
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 0, int(bad)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(toxic_table):
    docs, labels = toxic_table
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 500
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}


def test_toxicity_odd_rows(odd, none, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    labels = spark.createDataFrame([(0, 1, "x"), (6, 0, "x"), (1, 1, "x"), (2, 0, "x"), (3, None, "x"), (None, 1, "x"), (2, 0, "x")],
                                   "doc_id long, toxic int, score string")
    got = toxicity.score(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs_of(odd))
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1        # texts without words
    assert toxicity.score(none, labels).collect() == []
    one = toxicity.score(odd, labels.filter("toxic = 1")).collect()
    assert {r["score"] for r in one} == {1.0}
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_a_long_text_scores_as_its_highest_window():
    net = toxicity.Network(2)
    words = [f"w{k}" for k in range(200)]
    whole = net.score(*utf8(pa.array([" ".join(words)], pa.large_string())))[0]
    windows = [" ".join(words[k:k + toxicity.WINDOW]) for k in range(0, 200, toxicity.STRIDE)]
    n = 1 + -(-(200 - toxicity.WINDOW) // toxicity.STRIDE)
    best = net.score(*utf8(pa.array(windows[:n], pa.large_string()))).max()
    assert abs(whole - best) < 1e-6
