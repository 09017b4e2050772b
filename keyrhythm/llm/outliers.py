"""Quality rules by robust multivariate outliers: minimum covariance determinant by language and source.

Each document becomes a vector of transformed text statistics, kept as whole numbers so that sums do
not depend on their order. A group's estimate starts at its medians. Every concentration step ranks
the rows by Mahalanobis distance and takes mean and covariance of the nearest ones. The rank needs
no sort and no group in one task: moments are summed per narrow range of distances, and the ranges
below the cut, a bounded number of rows for each group, make the next estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keyrhythm.llm import tokens
from keyrhythm.llm.common import packed, unpacked, written
from keyrhythm.llm.registry import query, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud"]
UNIT = 1024
#: The least spread of each statistic that counts as ordinary, so that one that hardly varies does not
#: make every other value an outlier.
FLOORS = (0.25, 0.05, 0.05, 0.1, 0.1, 0.05)
SIZE = len(FLOORS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
#: Of the chi-squared distribution with six degrees of freedom: its median, and what one in a million exceeds.
CHI2_MEDIAN_6, CHI2_TAIL_6 = 5.348, 38.26
BINS_PER_DOUBLING, LAST_BIN = 64, 4095

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LOUD = np.zeros(256, np.int64)
_LOUD[[*range(65, 91), ord("!")]] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _again(values: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Which values occur more than once in their document."""
    order = np.lexsort((values, document))
    v, d = values[order], document[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _repeats(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Per document, values that equal an earlier one."""
    order = np.lexsort((values, document))
    v, d = values[order], document[order]
    return np.bincount(d[1:][(v[1:] == v[:-1]) & (d[1:] == d[:-1])], minlength=n)


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a batch."""
    parts: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for lo, hi, offsets, data in tokens.chunks(column):
        n = hi - lo
        starts, ends, first = tokens.spans(data, offsets)
        hashed = tokens.hashes(data, starts, ends)
        in_word = ~tokens.SPACE[data]
        letters = tokens.sums(in_word & ((data & 0xC0) != 0x80), offsets)
        window, document = tokens.windows(hashed, first, 3)
        twice = np.zeros(len(hashed) + 3, bool)
        if len(window):
            size = np.diff(first)
            at = np.flatnonzero(np.arange(len(hashed)) + 3 <= np.repeat(first[1:], size))
            again = at[_again(window, document)]
            for j in range(3):
                twice[again + j] = True
        line_start, line_end, line_first = tokens.spans(data, offsets, _NEWLINE)
        line_of = np.repeat(np.arange(n), np.diff(line_first))
        total = np.concatenate(([0], np.cumsum(in_word)))
        with_word = total[line_end] > total[line_start] if len(line_start) else np.zeros(0, bool)
        lines = tokens.hashes(data, line_start[with_word], line_end[with_word])
        for out, values in zip(parts, (
            np.diff(first), letters, tokens.sums(_SYMBOL[data], offsets), _repeats(lines, line_of[with_word], n),
            tokens.sums(twice[: len(hashed)], first), np.bincount(line_of[with_word], minlength=n),
            tokens.sums(_LOUD[data], offsets),
        )):
            out.append(np.asarray(values, np.int64))
    return {name: np.concatenate(p) if p else np.zeros(0, np.int64) for name, p in zip(COUNTS, parts)}


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns (the text only if asked for) and the counts of ``COUNTS``."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = text_counts(batch.column(text))
            columns = [batch.column(c) for c in names] + [pa.array(counted[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *COUNTS])

    return docs.mapInArrow(count, schema)


def _vector() -> list[Column]:
    """The transformed statistics as whole numbers."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = [F.log1p("n_words"), F.log(chars / words), F.log1p(F.col("n_symbols") / words),
              F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words,
              F.col("n_loud") / chars]
    return [F.round(v * UNIT).cast("bigint").alias(f"_x{i}") for i, v in enumerate(values)]


def _known(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads as first centre and shape."""
    quartiles = rows.groupBy("_fit").agg(*[
        F.percentile_approx(f"_x{i}", [0.25, 0.5, 0.75], 10000).alias(f"_q{i}") for i in range(SIZE)])
    spread = [F.greatest((F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]) / (1.349 * UNIT), F.lit(FLOORS[i])) for i in range(SIZE)]
    inverse = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS]
    return quartiles.select("_fit", F.array(*[F.col(f"_q{i}")[1] / F.lit(float(UNIT)) for i in range(SIZE)]).alias("_centre"),
                            F.array(*inverse).alias("_inverse"))


def _distances(rows: DataFrame, estimates: DataFrame, salts: int) -> DataFrame:
    """Add ``_d2``. A large group's rows are dealt over ``salts`` copies of its estimate."""
    salted = estimates.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    joined = rows.withColumn("_salt", F.pmod(F.hash(*[f"_x{i}" for i in range(SIZE)]), F.lit(salts))).join(salted, ["_fit", "_salt"])
    off = [F.col(f"_x{i}") / UNIT - F.col("_centre")[i] for i in range(SIZE)]
    d2 = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        d2 = d2 + off[i] * off[j] * F.col("_inverse")[k] * (1 if i == j else 2)
    return joined.withColumn("_d2", d2).drop("_salt", "_centre", "_inverse")


_FITTED = "_fit string, _centre array<double>, _inverse array<double>"


def _concentrate(rows: DataFrame, estimates: DataFrame, share: float, salts: int) -> DataFrame:
    """One concentration step: the estimate from the ``share`` of each group that is nearest."""
    bins = F.least(F.lit(LAST_BIN), F.floor(BINS_PER_DOUBLING * F.log2(1 + F.greatest(F.col("_d2"), F.lit(0.0))))).cast("int")
    moments = _distances(rows, estimates, salts).groupBy("_fit", bins.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(SIZE)],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in PAIRS])

    def fit(key, frame):
        import pandas as pd

        frame = frame.sort_values("_bin")
        n = np.cumsum(frame["_n"].to_numpy())
        take = int(np.searchsorted(n, share * n[-1])) + 1
        near = frame.iloc[:take]
        count = float(near["_n"].sum())
        mean = np.array([near[f"_s{i}"].sum() for i in range(SIZE)]) / count / UNIT
        cov = np.zeros((SIZE, SIZE))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = near[f"_s{i}_{j}"].sum() / count / UNIT / UNIT - mean[i] * mean[j]
        # The nearest rows spread less than all ordinary ones: the median distance tells by how much.
        middle = 2.0 ** ((frame["_bin"].iloc[int(np.searchsorted(n, 0.5 * n[-1]))] + 0.5) / BINS_PER_DOUBLING) - 1
        inverse = np.linalg.inv(cov * max(1.0, middle / CHI2_MEDIAN_6) + np.diag(np.square(FLOORS)))
        return pd.DataFrame({"_fit": [key[0]], "_centre": [mean.tolist()], "_inverse": [[inverse[p] for p in PAIRS]]})

    return moments.groupBy("_fit").applyInPandas(fit, _FITTED)


def mark_outliers(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True,
    share: float = 0.75, steps: int = 4, cutoff: float = CHI2_TAIL_6, min_rows: int = 50, salts: int = 16,
) -> DataFrame:
    """All columns, the counts, ``base_failed``, ``distance`` (squared, Mahalanobis) and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated three-word windows.
    Documents that pass it are compared with the estimate of their language and source; with fewer than
    ``min_rows`` such documents with that of the language, then with that of all. A distance above
    ``cutoff`` is rejected. NULL and empty texts have no words and fail; NULL languages and sources are
    groups of their own; repeated rows each count. Input columns named like the new ones are replaced.
    An empty table gives an empty one.
    """
    new = [*COUNTS, "base_failed", "distance", "kept"]
    names = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    docs = packed(docs, [*new, text], _tongue=lang, _from=source, _text=text)
    counted = written(with_counts(docs, "_text", keep_text), "text-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tongue = _known(F.col("_tongue"))
    group = F.concat(tongue, F.lit("\n"), _known(F.col("_from")))
    marked = counted.withColumns({"base_failed": failed, "_lang": tongue, "_group": group})
    sizes = marked.where(~F.col("base_failed")).groupBy("_lang", "_group").count()
    by_lang = sizes.groupBy("_lang").agg(F.sum("count").alias("_of_lang"))
    chosen = written(sizes.join(by_lang, "_lang").select(
        "_group", F.when(F.col("count") >= min_rows, F.col("_group")).when(F.col("_of_lang") >= min_rows, F.col("_lang"))
        .otherwise(F.lit("")).alias("_fit")), "outlier-groups")
    passing = marked.where(~F.col("base_failed"))
    # A level's estimate is made from all of its rows, also those of groups with an estimate of their own.
    levels = chosen.select(F.col("_fit")).distinct()
    rows = passing.select(F.explode(F.array(F.col("_group"), F.col("_lang"), F.lit(""))).alias("_fit"), *_vector())
    rows = written(rows.join(levels, "_fit", "left_semi"), "outlier-vectors")
    estimates = written(_start(rows), "outlier-estimates")
    for _ in range(steps):
        estimates = written(_concentrate(rows, estimates, share, salts), "outlier-estimates")
    fitted = chosen.join(estimates, "_fit").drop("_fit").withColumnRenamed("_group", "_fit")
    judged = _distances(passing.withColumnRenamed("_group", "_fit").select("*", *_vector()), fitted, salts)
    kept_columns = [*counted.columns, "base_failed"]
    judged = judged.select(*kept_columns, F.col("_d2").alias("distance"), (F.col("_d2") <= cutoff).alias("kept"))
    rejected = marked.where("base_failed").select(*kept_columns, F.lit(None).cast("double").alias("distance"),
                                                  F.lit(False).alias("kept"))
    out = judged.unionByName(rejected)
    out = unpacked(out, *[F.col("_text").alias(text)] * keep_text, *new)
    return out.select(*[f"`{c}`" for c in names], *new)


@query("op4_quality_outliers")
def op4_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    out = mark_outliers(docs, keep_text=False)
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("distance", 3).alias("distance"))
