"""The prefix trie against sequences put together in Python."""
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from graphssl.llm import prefix_trie as pt

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, size string, depth string, fp string, c string, pos string"


def make_turns(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA).repartition(4)


def fifth(c):
    base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
    return base, zlib.crc32(str(c).encode()) % 9


def expected(rows, splice=fifth):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        base, h = splice(c)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    n_leaves, saved, children = Counter(), Counter(), Counter()
    for seq, who in members.items():
        if seq:
            children[seq[:-1]] += 1
        leaf = all(built[c] == seq for c in who)
        for d in range(len(seq) + 1):
            n_leaves[seq[:d]] += leaf
            saved[seq[:d]] += (len(who) - 1) * (len(seq[-1][1].encode()) if seq else 0)
    out = Counter()
    for seq, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if built[c] == seq))
        out[(min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), children[seq], n_leaves[seq], saved[seq],
             sha256(ends.encode()).hexdigest())] += 1
    return out


ODD = ([(c, t, "user" if t % 2 else None, f"turn {t} é" if t < 4 else f"own {c % 7} {t}") for c in range(-12, 40) for t in range(c % 11)]
       + [(50, None, None, None), (50, None, "a", ""), (50, 1, "a", "tie"), (50, 1, "a", "tie"), (50, 1, "a", "other"), (50, 1, "b", "tie")]
       + [(None, 1, "user", "nobody"), (None, None, None, None)]
       + [(c, t, "user", "the same") for c in (60, 61, 65, 70, 75) for t in range(300)]        # long, common all the way
       + [(81, t, "user", f"long {t} " * 400) for t in range(120)]
       + [(c, t, "user", "ab") for c in (101, 102) for t in range(2)]                            # bases that do not exist
       + [(10 ** 15 + 1, 0, "u", ""), (10 ** 15, 0, "u", None)])


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rows", [ODD, [], [(None, 0, "u", "x")], [(4, 0, "u", "x")]], ids=["odd", "none", "no id", "one"])
def test_trie(spark, rows):
    df = pt.prefix_trie(make_turns(spark, rows))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(df) == expected(rows)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(pt.prefix_trie(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_other_splice(spark):
    """Everybody takes the first 200 turns of one long conversation (a hot base)."""
    rows = [(0, t, "u", f"t{t % 3}") for t in range(250)] + [(c, t, "u", f"{c}") for c in range(1, 60) for t in range(c % 3 + 199)]
    df = make_turns(spark, rows)
    splice = df.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("base"), F.lit(200).cast("long").alias("h"))
    assert got(pt.prefix_trie(df, splice)) == expected(rows, lambda c: (0, 200))


def test_collisions_start_again(spark, monkeypatch):
    """Primes so small that fingerprints collide: the verification finds it."""
    monkeypatch.setattr(pt, "TRIES", 60)
    tried = []
    whole = pt.head_products
    monkeypatch.setattr(pt, "head_products", lambda turns, seed, primes: tried.append(seed) or whole(turns, seed, primes))
    rows = [(c, t, "u", f"x{c}{t}") for c in range(0, 40, 5) for t in range(2)]
    assert got(pt.prefix_trie(make_turns(spark, rows), primes=(5, 7))) == expected(rows)
    assert len(tried) > 1
    monkeypatch.setattr(pt, "TRIES", 2)
    with pytest.raises(RuntimeError):
        pt.prefix_trie(make_turns(spark, [(c, 0, "u", f"{c}") for c in range(0, 400, 5)]), primes=(3, 5))


def test_many_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    rows = [(c, 0, "u", "all alike") for c in range(0, 500, 5)]
    assert got(pt.prefix_trie(make_turns(spark, rows))) == expected(rows)
