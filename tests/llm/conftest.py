import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns whose names the operators use for their own.
    *[T.StructField(c, T.StringType()) for c in ("size", "kept", "bucket", "item", "label", "score", "_range", "ord",
                                                 "text_sha256", "class_id", "words", "doc", "lo", "chunk", "n")]])


@pytest.fixture(scope="session")
def make(spark):
    """``make([(doc_id, text, source), ...])``: a documents table with clashing columns."""
    def of(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, len(t or ""), *["x"] * 15) for i, t, s in rows], SCHEMA).repartition(3)
    return of


BASE = " ".join(f"w{i % 37}{'abcdefgh'[i % 8]} tail{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows."""
    return make([
        (0, BASE, "b"), (1, BASE, None), (2, BASE.replace("tail40", "other"), "b"), (3, None, "a"), (4, "", "a"),
        (5, "  \t ", "c"), (6, "one two", "c"), (7, "one two", "c"), (7, "one two", "c"), (None, "no id here", "b"),
        (None, None, None), (8, "long " * 30_000 + "end", "a"), (9, "é日本語 🙂 <|endoftext|> x", "b"),
        (-5, BASE + "\n" + BASE, "z"), (11, "a\n\n\nb", "z")])


@pytest.fixture(scope="session")
def none(make):
    return make([])
