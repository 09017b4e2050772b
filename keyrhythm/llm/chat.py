"""Chat formatting: logged snapshots of growing conversations collapse to the longest ones.

A turn's hash is bound to its place; the hash of a prefix is the exclusive or of its turns' hashes,
a rolling value that partial results can be combined to. Conversations whose full hash is some
longer conversation's prefix hash, found by an anti-join, are snapshots and go. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyrhythm.llm.common import written
from keyrhythm.llm.registry import query, table

PREFIX = ["_length", "_h1", "_h2"]


def _turn_hash(seed: int) -> Column:
    """Of place, role and text; NULL and empty differ."""
    return F.xxhash64(F.lit(seed), "_place", F.col("_role").isNull(), "_role", F.col("_text").isNull(), "_text")


def placed_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, chunk: int = 256) -> DataFrame:
    """Distinct turns with ``_place`` (from 1), ``_size`` and the prefix hashes ``_h1``, ``_h2``.

    A conversation of any length is cut into chunks of turn numbers: places and hashes run inside a
    chunk, and a small table carries count and hash over the borders.
    """
    rows = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"), F.col(role).cast("string").alias("_role"),
                        F.col(text).cast("string").alias("_text")).distinct()
    rows = rows.withColumns({"_none": F.col("_conv").isNull(), "_conv": F.coalesce(F.col("_conv"), F.lit(0)),
                             "_chunk": F.coalesce(F.floor(F.col("_turn") / chunk), F.lit(-(1 << 62)))})
    rows = written(rows, "chat-turns")
    keys = ["_none", "_conv"]
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(over), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(*keys))}).drop("_n")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first())
    rows = rows.join(counts, [*keys, "_chunk"]).withColumn("_place", F.col("_before") + F.row_number().over(inside))
    rows = rows.withColumns({"_t1": _turn_hash(1), "_t2": _turn_hash(2)})
    running = Window.partitionBy(*keys, "_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_r1": F.bit_xor("_t1").over(running), "_r2": F.bit_xor("_t2").over(running)}).drop("_t1", "_t2", "_before")
    rows = written(rows, "chat-places")
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by("_r1", "_place").alias("_e1"), F.max_by("_r2", "_place").alias("_e2"))
    ends = ends.select(*keys, "_chunk", *[F.coalesce(F.bit_xor(f"_e{i}").over(over), F.lit(0)).alias(f"_c{i}") for i in (1, 2)])
    return rows.join(ends, [*keys, "_chunk"]).select(
        *keys, "_chunk", "_turn", "_role", "_text", "_place", "_size", *[F.col(f"_r{i}").bitwiseXOR(F.col(f"_c{i}")).alias(f"_h{i}") for i in (1, 2)])


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse_snapshots(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 512,
) -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, text)``: the maximal conversations, rendered.

    A conversation goes if its turns (roles and texts in order of turn) are the first turns of a
    longer one; of equal ones the smallest id stays, and ``n_copies`` counts them. A conversation of
    more than ``part_turns`` turns comes in parts, from 0, so no row grows without bound. Rows equal
    in all four columns are one turn; different rows with the same turn number follow in order of
    role and text, NULLs first. A NULL id is a conversation of its own, after all others; a NULL role
    or text is rendered empty, but differs from an empty one. Other columns are left out. An empty
    table gives an empty one.
    """
    placed = written(placed_turns(turns, conv_id, turn, role, text), "chat-prefixes")
    prefixes = placed.where("_place < _size").select(F.col("_place").alias("_length"), "_h1", "_h2").distinct()
    whole = placed.where("_place = _size").select("_none", "_conv", F.col("_size").alias("_length"), "_h1", "_h2")
    whole = whole.groupBy(*PREFIX).agg(F.min(F.struct("_none", "_conv")).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
    maximal = whole.join(prefixes, PREFIX, "left_anti").select("_first.*", "n_copies")
    rows = placed.join(maximal, ["_none", "_conv"])
    part = F.floor((F.col("_place") - 1) / part_turns).cast("int")
    lines = F.sort_array(F.collect_list(F.struct("_place", render_turn(F.col("_role"), F.col("_text")).alias("_line"))))
    out = rows.groupBy("_none", "_conv", part.alias("part")).agg(
        F.first("_size").alias("n_turns"), F.first("n_copies").alias("n_copies"), lines.alias("_lines"))
    return out.select(F.when(~F.col("_none"), F.col("_conv")).alias(conv_id), "part", "n_turns", "n_copies",
                      F.array_join(F.transform("_lines", lambda x: x["_line"]), "").alias(text))


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (
    SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
           md5(string_agg(coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-'), chr(2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS seen,
           string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
               OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
f AS (
    SELECT *, row_number() OVER (PARTITION BY seen ORDER BY conv_id NULLS LAST) AS nth, count(*) OVER (PARTITION BY seen) AS n_copies
    FROM o WHERE place = n)
SELECT conv_id, 0::INTEGER AS part, n AS n_turns, n_copies, shown AS text
FROM f WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.place < o.n AND o.place = f.n AND o.seen = f.seen)
"""


@query("op1_chat_snapshots", OP1_SQL)
def op1_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_snapshots(table(spark, folder, "conversations"))
