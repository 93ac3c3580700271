"""Sources, sinks and dataset preparation.

Every loader returns DataFrames with the library's row schema::

    id bigint, features array<double>, label bigint (NULL = unlabelled)

plus a ground-truth frame ``(id bigint, correct_label bigint)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import to_double_array
from ..session import write_table

INPUT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("features", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("label", T.LongType(), True),
])

# Iris CSV layout and class-name mapping of the reference loader
# (anything that is neither of the first two names maps to class 2).
IRIS_FEATURES = ["SepalLength", "SepalWidth", "PetalLength", "PetalWidth"]
IRIS_CLASS_0 = "Iris-setosa"
IRIS_CLASS_1 = "Iris-versicolor"
IRIS_OTHER_CLASS = 2

#: EMNIST-style CSV: column 0 = label, then 784 pixel columns.
EMNIST_PIXELS = 784


def mask_labels(df: DataFrame, lo: int = 0, hi: int = 8, by: str = "features",
                truth_col: str = "correct_label") -> DataFrame:
    """Keep the true label iff ``pmod(hash, 100)`` lies in ``[lo, hi)``.

    ``by="features"`` hashes the feature vector (identical vectors share one
    fate, as in the reference; the hash is ``xxhash64``); ``by="id"`` uses
    ``pmod(id, 100)``, which an SQL oracle can reproduce.
    """
    if by == "features":
        bucket = F.pmod(F.xxhash64("features"), F.lit(100))
    elif by == "id":
        bucket = F.pmod(F.col("id"), F.lit(100))
    else:
        raise ValueError(f"unknown masking key {by!r}")
    keep = (bucket >= lo) & (bucket < hi)
    return df.withColumn("label", F.when(keep, F.col(truth_col)).cast("bigint"))


def split_truth(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(input rows, ground truth)`` as two projections of one frame."""
    return (df.select("id", "features", "label"),
            df.select("id", F.col("correct_label").cast("bigint").alias("correct_label")))


def class_name_to_label(col) -> "F.Column":
    """Class name -> numeric label (fixed mapping above)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c == IRIS_CLASS_0, F.lit(0)).when(c == IRIS_CLASS_1, F.lit(1))
            .otherwise(F.lit(IRIS_OTHER_CLASS)).cast("bigint"))


def number_rows(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``df`` with row numbers from 0 in the order of its content (all columns, nulls first).

    Two passes: rows are sorted over range partitions and written with their place in
    the partition; one count per partition gives the offsets.  The numbers follow from the rows alone, so
    they are the same for every split of the input, on a rerun and in every frame derived from the
    result; rows that agree in every column may swap."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *tied.columns).sortWithinPartitions(*tied.columns).drop("_tie")
    placed = write_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # the function's fixed layout: partition above bit 33, place in the partition below
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()    # one row a partition
    offsets, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["n"]
    starts = spark.createDataFrame(offsets, "_part long, _start long")
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .select((F.col("_start") + place).alias(id_col), *df.columns))


def load_iris(spark: SparkSession, path: str, lo: int = 0, hi: int = 8,
              mask_by: str = "features") -> tuple[DataFrame, DataFrame]:
    """Iris-style CSV with header -> ``(input rows, truth)``."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in IRIS_FEATURES]
                          + [T.StructField("Species", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    df = number_rows(raw.select(                                          # S5
        F.array(*[F.col(c) for c in IRIS_FEATURES]).alias("features"),    # S7
        class_name_to_label("Species").alias("correct_label")))
    return split_truth(mask_labels(df, lo, hi, mask_by))


def load_emnist(spark: SparkSession, path: str, partitions: int | None = None,
                lo: int = 0, hi: int = 8, persist: bool = False,
                mask_by: str = "features", n_features: int = EMNIST_PIXELS) -> tuple[DataFrame, DataFrame]:
    """S2 (+S11): header-less CSV, column 0 = label, then ``n_features`` numbers.

    A line is split straight into one array, so that wide rows (784 pixels) never become as many
    columns.  Empty lines are skipped; what is missing or no number is NULL; more fields are ignored."""
    parts = F.split(F.col("value"), ",")
    numbers = F.concat(F.transform(F.slice(parts, 2, n_features), lambda x: F.trim(x)).try_cast("array<double>"),
                       F.array_repeat(F.lit(None).cast("double"), n_features))
    df = number_rows(spark.read.text(path).where(F.trim("value") != "").select(
        F.slice(numbers, 1, n_features).alias("features"), F.trim(parts[0]).try_cast("bigint").alias("correct_label")))
    df = mask_labels(df, lo, hi, mask_by)
    if partitions:
        df = df.repartition(partitions)
    if persist:
        df = df.persist()
    return split_truth(df)


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """S3: in-memory ``(id, features, label)`` tuples."""
    return spark.createDataFrame(
        [(int(i), [float(x) for x in f], None if l is None else int(l)) for i, f, l in rows],
        INPUT_SCHEMA)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Saved graph ``(id, neighbors array<struct<id, similarity>>)`` -> long
    edge table ``(id, nbr, sim)``."""
    g = spark.read.parquet(path).select("id", "neighbors")
    nid, nsim = g.schema["neighbors"].dataType.elementType.fieldNames()[:2]
    return g.select("id", F.explode("neighbors").alias("n")).select(
        "id", F.col("n").getField(nid).cast("bigint").alias("nbr"),
        F.col("n").getField(nsim).cast("double").alias("sim"))


def load_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver table ``embeddings`` -> ``(id, features array<double>, correct_label)``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("bigint").alias("id"),
                    to_double_array("embedding").alias("features"),
                    F.col("label").cast("bigint").alias("correct_label"))


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S12 sink: predictions as parquet."""
    df.write.mode(mode).parquet(path)
