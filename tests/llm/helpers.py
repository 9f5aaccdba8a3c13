"""Small inputs that every operator must take, and a few plain reference pieces."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ODD = [None, "", "   \n\t ", "...!!!", "one", "One two, THREE four", "é漢😀  a", "x" * 5000, LONG, "same words again and again", "same words again and again"]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, texts, extra=()):
    """Rows with ids from 0, one null id and null columns; ``extra`` names more columns."""
    rows = [(i if i != 3 else None, t, None if i % 2 else "en", None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in extra:
        frame = frame.withColumn(name, frame["doc_id"])
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)
