"""Small awkward inputs that every corpus operator must take."""

import random

from pyspark.sql import types as T

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "po", "ra", "si", "tu", "ve") for b in ("lan", "mer", "nok", "pir", "sot", "tag", "vun", "zel")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns that operators use or add themselves.
    *[T.StructField(c, T.StringType()) for c in ("_id", "_text", "_node", "_key", "_row", "n_words", "n_lines", "size", "kept", "taken", "contaminated")],
])


def rows(given):
    return [(i, t, lang, source, None if t is None else len(t), *["x"] * 11) for i, t, lang, source in given]


def odd_rows():
    long = "\n".join(prose(100 + i, 200) for i in range(300))
    given = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "one", "en", "a"), (5, long, "en", "a"),
             (6, prose(6, 80), None, None), (6, prose(6, 80), None, None), (None, prose(7, 90), "en", "b"), (8, "é ß " * 60, "de", "b"),
             (9, prose(6, 80), "en", "b"), (-5, prose(9, 70) + "\n" + prose(9, 70), "", "")]
    return rows(given)


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
