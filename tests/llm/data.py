"""Documents with every odd case, and frames made of them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, "   \t\n  ", "de", None, 7),
    (6, "12345 --- !!! 678", "fr", "b", 17),
    (None, "Ohne Nummer läuft der Text über die Straße und zurück.", "de", "b", 54),
    (None, None, None, None, None),
    (7, "naïve café　\x1c\x85 été \U0001F600\U0001F600 日本語 and 'quotes' don't we'll", "fr", "b", 50),
    (8, "word " * 30_000 + "end", "en", "c", 150_003),
    (9, "x", "en", "c", 1),
]

CLASHING = ["score", "hit", "fp", "lines", "n_words", "h", "root", "bucket", "c0", "c1", "n", "drop", "line", "host", "ids", "__text"]


def odd(spark, more=()):
    return spark.createDataFrame([*ODD, *more], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The frame with extra columns named like what operators use inside."""
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
