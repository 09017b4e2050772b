"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a hash-random key. Inside its source the key's range is cut into buckets, each
sorted and summed in its own task; a small table of bucket totals gives each bucket its start. A
document's place in its source's running total of words then tells how often it is taken: whole
epochs for all, and one more for the documents before the point where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyrhythm.llm.common import n_words, packed, unpacked, written
from keyrhythm.llm.registry import query, table

SOURCE = ["_no_source", "_source"]


def targets(per_source: DataFrame, weights: list[int], most: int) -> DataFrame:
    """Add ``target``: the words each source gives. One row per source in, a few numbers each.

    The sources share the total by weight; none gives more than ``most`` times what it has, and
    what it cannot give is shared again. With the sources sorted by the level at which they fill
    up, the level of the rest follows from running sums.
    """
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.partitionBy(F.lit(0)).orderBy(*SOURCE)
    at = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    limit = (F.col("source_size") * most).cast("double")
    by_level = Window.partitionBy(F.lit(0)).orderBy("_full", *SOURCE)
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    marked = (per_source.withColumn("_weight", weight).withColumn("_limit", limit)
              .withColumn("_full", F.col("_limit") / F.col("_weight"))
              .withColumn("_level", (F.sum("source_size").over(everything).cast("double")
                                     - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(after)))
    level = F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_level"))).over(everything)["_level"]
    return (marked.withColumn("target", F.least(F.col("_limit"), F.coalesce(level * F.col("_weight"), F.col("_limit"))))
            .drop("_weight", "_limit", "_full", "_level"))


def mix_sources(
    sized: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, hex_digits: int = 3,
) -> DataFrame:
    """All columns plus ``source_size``, ``target``, ``epochs`` (whole ones) and ``taken`` (words).

    Sources in code point order, NULL last, take the ``weights`` in turn. ``taken`` of a source adds
    up to its target cut to a whole number; the document at the border gives a part. A row's key
    depends on its id and the seed alone. Rows that repeat an id lie side by side and are taken one
    by one. A NULL id is an id of its own; size 0 is never taken. An empty table gives an empty one.
    Input columns named like the new ones are replaced.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    rows = (packed(sized, ["source_size", "target", "epochs", "taken"], _id=doc_id, _from=source, _size=size)
            .withColumns({"_key": key, "_no_source": F.col("_from").isNull(), "_source": F.coalesce(F.col("_from"), F.lit(""))})
            .withColumn("_bucket", F.substring("_key", 1, hex_digits)))
    buckets = written(rows.groupBy(*SOURCE, "_bucket").agg(F.sum("_size").alias("_words")), "mix-buckets")
    per_source = targets(buckets.groupBy(*SOURCE).agg(F.sum("_words").alias("source_size")), list(weights), most)
    earlier = Window.partitionBy(*SOURCE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (buckets.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
              .join(per_source, SOURCE))
    inside = (Window.partitionBy(*SOURCE, "_bucket").orderBy("_key", "_id", "_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor("target")
    has_any = F.col("source_size") > 0
    out = rows.join(starts, [*SOURCE, "_bucket"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    out = out.withColumn("epochs", F.when(has_any, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(rest, F.col("_size")))
    taken = (F.col("epochs") * F.col("_size") + part).cast("bigint")
    return unpacked(out, "source_size", "target", "epochs", taken.alias("taken"))


OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
v AS (SELECT *, (source_size * 3)::DOUBLE AS most, (source_size * 3)::DOUBLE / weight AS filled FROM s),
e AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY filled, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY filled, source IS NULL, source
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (
    SELECT source, source_size,
           least(most, coalesce(first_value(CASE WHEN filled >= level THEN level END IGNORE NULLS)
                 OVER (ORDER BY filled ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, most)) AS target
    FROM e),
p AS (
    SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - before, size)))::BIGINT AS taken
FROM p
"""


@query("op8_mix_sources", OP8_SQL)
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")
