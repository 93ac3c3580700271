"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target in words: the weights 5, 2, 1 (repeating over the
   sources in code point order, null last) share all words; a target stops at
   three times its source's words and the excess is shared again by weight.
2. The documents of a source are permuted by a seeded hash and cut into blocks
   of about ``BLOCK_ROWS`` rows.  The target, rounded to whole words, is the
   source's exact quota: whole passes over all its blocks, then the first blocks
   of one more pass, the last of them cut at the word where the quota ends.
3. A binary tree deals these block draws to ``2^L`` output shards.  A node holds
   one count per source; a multivariate hypergeometric draw (without
   replacement) decides how many of each go to its left half, the rest go right.
   Every leaf holds about ``SHARD_BLOCKS`` draws in random proportions, and all
   leaves together hold exactly the quotas.
4. Each shard draws the next blocks of each source's permuted sequence, so no
   two shards share a draw, and shuffles its rows by a seeded hash.

DataFrame functions only.  No step groups the rows of a source: a hot source is
many blocks.  Texts are read once, to count words; all later tables are numbers.

Defined results: a null text has no words; a document without words is taken 0
times; sources without words have target 0; a null source is a source, ranked
last; rows that repeat a doc_id are documents of their own; an empty table gives
an empty table; the same rows and seed give the same mix, however they are
partitioned; other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphssl.llm.common import partitions
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: The contract's weights, cap and word pattern.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents per block (a block is permuted as one unit).
BLOCK_ROWS = 256
#: Block draws per output shard.
SHARD_BLOCKS = 16
#: Tree levels between two cuts of the lineage.
LEVELS_PER_CUT = 4


def sized(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size)``: words of every document, with its ``keys``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *keys)


def ranked_sources(rows: DataFrame) -> DataFrame:
    """``(source, ord, weight, source_size, docs)``; ranks come from a range sort, so
    no task sees all the sources."""
    spark = rows.sparkSession
    key = F.col("source").asc_nulls_last()
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    dealt = write_table(per.repartitionByRange(partitions(spark), key)
                        .withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    counts = (dealt.groupBy("part").count()
              .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    ranked = dealt.join(F.broadcast(counts), "part").withColumn(
        "ord", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          (F.col("ord") % len(WEIGHTS) + 1).cast("int")).cast("double")
    return ranked.select("source", "ord", weight.alias("weight"), "source_size", "docs")


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: ``min(cap, level * weight)`` at the level where the targets
    add up to all words.  Each round is one aggregate; a level only rises."""
    cap = (F.lit(CAP) * F.col("source_size")).cast("double")
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > cap
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"), F.sum(full.cast("long")).alias("n")).head()
        if row["all"] is None or not row["free"] or row["n"] == capped:
            break
        capped = row["n"]
        level = (row["all"] - (row["fixed"] or 0.0)) / row["free"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def hypergeometric(rest: Column, n: Column, left: Column, u: Column) -> Column:
    """How many of ``n`` marked among ``rest`` draws go left, if ``left`` of them go
    left in all: the distribution's quantile at ``u``.

    Probabilities follow from their ratios, from eight standard deviations below
    the mean (or the support's end) to eight above; less than 1e-14 lies outside."""
    rest, n, left = (c.cast("double") for c in (rest, n, left))
    mean = left * n / rest
    sd = F.sqrt(F.greatest(mean * (1 - n / rest) * (rest - left) / F.greatest(rest - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0.0), left - (rest - n), F.floor(mean - 8 * sd - 2).cast("double")).cast("long")
    high = F.least(n, left, F.ceil(mean + 8 * sd + 2).cast("double")).cast("long")

    def step(k: Column) -> Column:
        return (n - k) * (left - k) / ((k + 1) * (rest - n - left + k + 1))

    def start() -> Column:
        return F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("k"))

    def walk(ks: Column, bound: Column) -> Column:
        return F.aggregate(ks, start(), lambda z, k: F.struct(
            (z["w"] * step(k)).alias("w"), (z["s"] + z["w"]).alias("s"),
            F.when(z["k"].isNull() & (z["s"] + z["w"] >= bound), k).otherwise(z["k"]).alias("k")))

    ks = F.sequence(low, high)
    # transform() over a one-element array gives the list and the total a name.
    return F.transform(F.array(ks), lambda a: F.transform(
        F.array(walk(a, F.lit(0.0))["s"]),
        lambda total: F.coalesce(walk(a, u * total)["k"], F.element_at(a, -1)))[0])[0]


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``(ord, n)`` block draws per source to ``(shard, ord, n)`` over ``2^levels`` shards."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "ord", F.col("n").cast("long").alias("n"))
    kind = "array<struct<ord:bigint,n:bigint,l:bigint>>"
    for level in range(levels):
        per = nodes.groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("ord", "n"))).alias("parts"), F.sum("n").alias("total"))
        half = F.floor(F.col("total") / 2).cast("long")
        coin = F.lit(level)

        def draw(z, x):
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), coin, F.col("node"), x["ord"]), 11) / float(1 << 53)
            got = F.when(z["rest"] == x["n"], z["left"]).otherwise(hypergeometric(z["rest"], x["n"], z["left"], u))
            return F.transform(F.array(got.cast("long")), lambda g: F.struct(
                (z["rest"] - x["n"]).alias("rest"), (z["left"] - g).alias("left"),
                F.concat(z["out"], F.array(F.struct(x["ord"].alias("ord"), x["n"].alias("n"), g.alias("l")))).alias("out")))[0]

        begin = F.struct(F.col("total").alias("rest"), half.alias("left"), F.array().cast(kind).alias("out"))
        split = per.select("node", F.explode(F.aggregate("parts", begin, draw)["out"]).alias("x"))
        side = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("x.l").alias("n")),
                                 F.struct(F.lit(1).alias("s"), (F.col("x.n") - F.col("x.l")).alias("n"))))
        nodes = (split.select("node", F.col("x.ord").alias("ord"), side.alias("c"))
                 .select((F.col("node") * 2 + F.col("c.s")).alias("node"), "ord", F.col("c.n").alias("n"))
                 .filter("n > 0"))
        if level % LEVELS_PER_CUT == LEVELS_PER_CUT - 1:
            nodes = write_table(nodes, "tree")
    return nodes.withColumnRenamed("node", "shard")


def plan_mix(docs: DataFrame, seed: int = 7, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, draws)``: every document with its place in its source's permuted
    blocks, and every block draw with its shard, pass and word limit.  ``keys`` are
    columns that go with the documents and order those of equal doc_id and size."""
    base = write_table(sized(docs, keys), "sized")
    sources = write_table(with_targets(ranked_sources(base)), "targets")
    small = small_hint(sources, sources.count())
    perm = F.xxhash64(F.lit(seed), F.col("doc_id"))
    n_blocks = F.ceil(F.col("docs") / BLOCK_ROWS).cast("long")
    placed = (base.alias("d").join(small.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
              .select("d.doc_id", "d.size", *[f"d.{k}" for k in keys], "s.ord", "s.source_size", "s.target", perm.alias("perm"),
                      F.pmod(F.xxhash64(F.lit(seed + 1), F.col("d.doc_id")), n_blocks).alias("block")))
    inside = Window.partitionBy("ord", "block").orderBy("perm", "doc_id", "size", *keys)
    rows = write_table(placed.withColumn("place", F.row_number().over(inside))
                       .withColumn("begin", F.sum("size").over(
                           inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")), "permuted")
    blocks = rows.groupBy("ord", "block").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("ord").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("start", F.sum("words").over(along) - F.col("words"))
    quota = F.round("target").cast("long")
    passes = F.floor(quota / F.col("source_size")).cast("long")
    limit = F.least(F.col("words"), quota - F.col("pass") * F.col("source_size") - F.col("start"))
    draws = (blocks.join(small.filter("source_size > 0"), "ord")
             .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), passes)))
             .withColumn("limit", limit).filter("limit > 0")
             .withColumn("draw", F.row_number().over(Window.partitionBy("ord").orderBy("pass", "block")) - 1)
             .select("ord", "block", "pass", "limit", "draw"))
    draws = write_table(draws, "draws")
    n = draws.count()
    levels = max(0, (n // SHARD_BLOCKS).bit_length())
    dealt = split_tree(draws.groupBy("ord").agg(F.count(F.lit(1)).alias("n")), levels, seed)
    first = Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = (dealt.withColumn("end", F.sum("n").over(first))
             .select("ord", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("draw")))
    return rows, draws.join(dealt, ["ord", "draw"])


def mix(docs: DataFrame, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per taken document and draw: ``(ord, block, place, doc_id, size,
    words, shard, position)`` and the ``keys``; ``words`` below ``size`` only where a
    quota ends.  Sorting a shard by ``position`` is its local shuffle."""
    rows, draws = plan_mix(docs, seed, keys)
    words = F.least(F.col("size"), F.col("limit") - F.col("begin"))
    return (rows.join(draws, ["ord", "block"]).withColumn("words", words).filter("words > 0")
            .select("ord", "block", "place", "doc_id", "size", "words", "shard",
                    F.xxhash64(F.lit(seed + 2), "shard", "ord", "block", "place", "pass").alias("position"), *keys))


def mix_report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every document with what the mix takes of it."""
    rows, draws = plan_mix(docs, seed)
    per = draws.groupBy("ord", "block").agg(F.collect_list("limit").alias("limits"))    # at most 4 draws
    taken = F.aggregate(F.coalesce("limits", F.array().cast("array<bigint>")), F.lit(0).cast("long"),
                        lambda z, x: z + F.greatest(F.lit(0), F.least(F.col("size"), x - F.col("begin"))))
    return (rows.join(per, ["ord", "block"], "left")
            .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per draw, in shards shuffled
    locally.  Where a quota ends inside a document, its row keeps the first words.
    A written row number tells the rows of one doc_id (or of none) apart."""
    spark = docs.sparkSession
    digest = F.md5(F.to_json(F.struct("*")).cast("binary"))     # so that numbers order equal rows only
    keyed = write_table(docs.select("*", digest.alias("_digest"), F.monotonically_increasing_id().alias("_row")), "rows")
    plan = mix(keyed, seed, ("_digest", "_row")).select("_row", "words", F.col("size").alias("_size"),
                                                        F.col("shard").alias("_shard"), F.col("position").alias("_pos"))
    # The draws of one document (at most four) travel as one row.
    per = plan.groupBy("_row", "_size").agg(F.collect_list(F.struct("words", "_shard", "_pos")).alias("_draws"))
    met = keyed.join(per, "_row")
    met = met.withColumn("_d", F.explode("_draws"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)),
                               F.lit(1), F.col("_d.words").cast("int")), "")
    out = met.withColumn("text", F.when(F.col("_d.words") < F.col("_size"), cut).otherwise(F.col("text")))
    return (out.repartition(partitions(spark), F.col("_d._shard"))
            .sortWithinPartitions("_d._shard", "_d._pos").select(docs.columns))
