"""Rows that every operator of the subpackage must bear: nulls, empty and long texts, ties, repeats, extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.LongType())])
LONG = "palabra larga y otra más " * 3000
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE + " more"), (4, None), (5, ""), (6, "   \n\t "), (7, "!!! ??? 123"), (8, "word"), (9, "word"), (10, LONG), (11, LONG + "fin"),
    (12, "Ünï cödé İstanbul ΣΑΣ 日本 語 😀 é"), (13, "a  b <|endoftext|> c\n\n d "), (14, "x" * 5000), (15, "ONE two THREE four five"), (16, "one TWO three FOUR five"), (17, "\x1c odd space here 's 've"),
]


def rows():
    out = [(i, t, None if i == 8 else "en" if i % 2 else "es", None if i == 3 else "src0", None if t is None else len(t), "clash", "clash", -1) for i, t in TEXTS]
    return [*out, out[0]]  # a row that repeats


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
