"""Rows that every operator on documents has to bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.StringType())]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"{WORDS[i % 20]}{i % 977}" for i in range(40_000))
ROWS = [
    (1, "Alpha beta gamma delta.", "en", "s", 1), (2, "Alpha beta gamma delta.", "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t ", "en", "s", 3),
    (6, LONG, "en", "s", 9), (7, LONG, "en", "s", 9), (None, "Alpha beta gamma delta.", "en", "s", 1), (None, "only here", "en", "s", 1), (8, "twice", "en", "s", 1), (8, "twice", "en", "s", 1),
    (9, "héé ünï 日本   \x85 \x1c x", "fr", "s", 1), (10, "ALPHA BETA GAMMA DELTA.", "en", "s", 1), (12, " ".join(WORDS), "en", "s", 1), (13, " ".join(WORDS[5:]), "en", "s", 1), (14, LONG + " tail", "en", "s", 9),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, "clash", "clash", 0, "clash") for r in rows], SCHEMA)
