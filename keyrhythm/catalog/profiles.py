"""Group statistics, wide rows and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyrhythm.catalog import sqltext
from keyrhythm.catalog.registry import query, table
from keyrhythm.functions.encode import indicators
from keyrhythm.functions.numeric import rounded, to_number
from keyrhythm.operators import sketch
from keyrhythm.operators.filters import inside
from keyrhythm.operators.impute import fill_with_group_mean
from keyrhythm.operators.profile import ALL_STATS, Difference, Measure, observations, profile, wide_profile
from keyrhythm.operators.sequence import latencies
from keyrhythm.session import new_folder
from keyrhythm.sources.files import read_csv_table, write_table

TYPES = ("click", "error", "purchase", "signup", "view")
STATS = ("mean", "median", "amax", "amin", "var", "std", "iqr", "skew", "kurtosis")
VALUE = Measure("value", "event_type", "value", TYPES)
VALUE_SQL = ("value", "event_type", "value", TYPES)


def _round_all(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in df.columns if c not in keep])


def _price_stats(names) -> list:
    return [rounded(F.col(s) / 1e6 if s == "var" else F.col(s)).alias(s) for s in names]


def _price_sql(names) -> str:
    return ", ".join(sqltext.rounded(sqltext.scaled(s, sqltext.stat(s, "l_extendedprice")), s) for s in names)


LINE_PRICE = Measure("price", "l_returnflag", "l_extendedprice", ("A", "N", "R"))


def _line_profile(spark, folder):
    obs = observations(table(spark, folder, "lineitem"), "l_suppkey", [LINE_PRICE])
    return profile(obs, ["l_suppkey", "category"])


MOMENTS = ["mean", "median", "amax", "amin", "var", "std", "iqr"]


@query("group_profile", f"""
SELECT l_suppkey, l_returnflag, count(*) AS count, {_price_sql(MOMENTS)}
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_suppkey, l_returnflag
""")
def group_profile(spark, folder):
    return _line_profile(spark, folder).select(
        "l_suppkey", F.col("category").alias("l_returnflag"), "count", *_price_stats(MOMENTS)
    )


@query("group_shape", f"""
SELECT l_suppkey, l_returnflag, {_price_sql(['skew', 'kurtosis'])}
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_suppkey, l_returnflag
""")
def group_shape(spark, folder):
    return _line_profile(spark, folder).select(
        "l_suppkey", F.col("category").alias("l_returnflag"), *_price_stats(["skew", "kurtosis"])
    )


JSON_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"


@query("flight_profile", f"""
SELECT user_id, event_type, count(*) AS count,
       {', '.join(sqltext.rounded(sqltext.stat(s, 'k'), s) for s in STATS)}
FROM (SELECT user_id, event_type, {JSON_K} AS k FROM events) GROUP BY user_id, event_type
""")
def flight_profile(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", to_number(F.get_json_object("props", "$.k")))
    stats = profile(observations(rows, "user_id", [Measure("k", "event_type", "k", TYPES)]), ["user_id", "category"])
    return stats.select(
        "user_id", F.col("category").alias("event_type"), "count", *[rounded(s).alias(s) for s in STATS]
    )


WIDE = sqltext.wide([VALUE_SQL], STATS)
WIDE_DIFFERENCE = Difference("click_view_mean_difference", "value", "click", "view")
WIDE_DIFFERENCE_SQL = "abs({} - {})".format(*(
    sqltext.stat("mean", "value", f"event_type = '{t}'") for t in ("click", "view")
))


def events_wide(spark, folder):
    """Valid events summarised per user and type, one wide row per user."""
    rows = table(spark, folder, "events").where(inside(["value"], 200.0))
    return wide_profile(rows, "user_id", [VALUE], STATS, [WIDE_DIFFERENCE], required="value")


EVENTS_WIDE_SQL = (
    "SELECT user_id, " + ", ".join(sqltext.rounded(e, n) for n, e in WIDE)
    + ", " + sqltext.rounded(WIDE_DIFFERENCE_SQL, "click_view_mean_difference")
    + " FROM events WHERE value > 0 AND value < 200 GROUP BY user_id"
)


@query("wide_profile", f"""
SELECT w.*, c_mktsegment FROM ({EVENTS_WIDE_SQL}) w JOIN customer ON c_custkey = user_id
""")
def wide_events(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return _round_all(events_wide(spark, folder).join(users, "user_id"), ["user_id", "c_mktsegment"])


@query("csv_roundtrip", EVENTS_WIDE_SQL)
def csv_roundtrip(spark, folder):
    wide = events_wide(spark, folder)
    path = new_folder(spark, "csv")
    write_table(wide, path, "csv")
    return _round_all(read_csv_table(spark, path, wide.schema), ["user_id"])


@query("mean_difference", f"""
SELECT user_id, {sqltext.rounded(WIDE_DIFFERENCE_SQL, 'click_view_mean_difference')}
FROM events WHERE value > 0 AND value < 200 GROUP BY user_id
""")
def mean_difference(spark, folder):
    rows = table(spark, folder, "events").where(inside(["value"], 200.0))
    wide = wide_profile(rows, "user_id", [VALUE], ["mean"], [WIDE_DIFFERENCE], required="value")
    return wide.select("user_id", rounded("click_view_mean_difference").alias("click_view_mean_difference"))


@query("impute_group_mean", """
WITH s AS (SELECT user_id, event_type, CASE WHEN count(*) > 12 THEN var_samp(value) END AS spread
           FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, round(coalesce(spread, avg(spread) OVER (PARTITION BY user_id)) / 1e3 + 1e-9, 6) + 0.0 AS spread
FROM s
""")
def impute_group_mean(spark, folder):
    stats = profile(observations(table(spark, folder, "events"), "user_id", [VALUE]), ["user_id", "category"])
    gaps = stats.select("user_id", "category", F.when(F.col("count") > 12, F.col("var")).alias("spread"))
    filled = fill_with_group_mean(gaps, ["user_id"], ["spread"])
    return filled.select(
        "user_id", F.col("category").alias("event_type"), rounded(F.col("spread") / 1e3).alias("spread")
    )


COMBINED = [
    Measure("price", "l_returnflag", "l_discount", ("A", "N", "R")),
    Measure("quantity", "l_linestatus", "l_quantity", ("F", "O")),
]
COMBINED_SQL = [("price", "l_returnflag", "l_discount", ("A", "N", "R")),
                ("quantity", "l_linestatus", "l_quantity", ("F", "O"))]


@query("combined_stats", "SELECT l_suppkey, " + ", ".join(
    sqltext.rounded(e, n) for n, e in sqltext.wide(COMBINED_SQL, STATS)
) + " FROM lineitem WHERE l_tax < 0.06 AND l_tax > 0 GROUP BY l_suppkey"
    " HAVING count(*) FILTER (WHERE l_returnflag IN ('A', 'N', 'R')) > 0")
def combined_stats(spark, folder):
    rows = table(spark, folder, "lineitem").where(inside(["l_tax"], 0.06))
    return _round_all(wide_profile(rows, "l_suppkey", COMBINED, STATS, required="price"), ["l_suppkey"])


# Feature tables: a customer is the labelled user, an event's value the hold time, and the time
# since the user's previous event the latency of the transition between the two types.
HOLD = Measure("hold_time", "event_type", "value", ("click", "purchase", "view"))
LATENCY = Measure("latency_time", "direction", "latency_s", ("click_view", "view_click", "view_view"))
TABLE_STATS = ("mean", "median", "amax", "amin", "iqr", "skew", "kurtosis", "std")
DIFFERENCE = Difference("click_view_mean_difference", "latency_time", "click_view", "view_click")


def events_with_latency(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "ts")
    seen = latencies(
        rows, "user_id", "ts", "event_type", ["ts", "event_id"], separator="_"
    )
    return seen.withColumn("latency_s", F.col("latency_ms") / 1000.0).where(
        inside(["value"], 200.0) & inside(["latency_s"], 100000.0)
    )


def users(spark, folder) -> DataFrame:
    coded = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_acctbal") > 4000).cast("int").alias("label"),
        (F.col("c_nationkey") < 12).cast("int").alias("flag"),
        "c_mktsegment",
    )
    return coded.select("user_id", "label", "flag", *indicators("c_mktsegment", ["BUILDING", "HOUSEHOLD"], "segment"))


def feature_table(spark, folder, measures=(HOLD, LATENCY), required="hold_time") -> DataFrame:
    wide = wide_profile(
        events_with_latency(spark, folder), "user_id", list(measures), TABLE_STATS,
        [DIFFERENCE] if LATENCY in measures else [], required,
    )
    return users(spark, folder).join(wide, "user_id")


SEEN_SQL = """
SELECT * FROM (
  SELECT user_id, value, event_type, lag(event_type) OVER w || '_' || event_type AS direction,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000.0 / 1000.0 AS latency_s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE direction IS NOT NULL AND value > 0 AND value < 200 AND latency_s > 0 AND latency_s < 100000
"""
USERS_SQL = """
SELECT c_custkey AS user_id, CAST(c_acctbal > 4000 AS INTEGER) AS label, CAST(c_nationkey < 12 AS INTEGER) AS flag,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS segment_BUILDING,
       CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS segment_HOUSEHOLD FROM customer
"""
HOLD_SQL = ("hold_time", "event_type", "value", HOLD.levels)
LATENCY_SQL = ("latency_time", "direction", "latency_s", LATENCY.levels)
DIFFERENCE_SQL = "abs({} - {})".format(*(
    sqltext.stat("mean", "latency_s", f"direction = '{d}'") for d in ("click_view", "view_click")
))


def _table_sql(measures, required: str, difference: bool, columns: str = "*") -> str:
    cells = [(n, e) for n, e in sqltext.wide(measures, TABLE_STATS)]
    if difference:
        cells.append(("click_view_mean_difference", DIFFERENCE_SQL))
    inner = ", ".join(sqltext.rounded(e, n, 4) for n, e in cells)
    return (
        f"SELECT {columns} FROM ({USERS_SQL}) JOIN (SELECT user_id, {inner} FROM ({SEEN_SQL}) GROUP BY user_id "
        f"HAVING count(*) FILTER (WHERE {required}) > 0) USING (user_id)"
    )


IS_HOLD = "event_type IN ('click', 'purchase', 'view')"
IS_LATENCY = "direction IN ('click_view', 'view_click', 'view_view')"
PROFILE_COLUMNS = ["user_id", "label", "flag", "segment_BUILDING", "segment_HOUSEHOLD"]


@query("feature_table", _table_sql([HOLD_SQL, LATENCY_SQL], IS_HOLD, True))
def both_table(spark, folder):
    return _round_all(feature_table(spark, folder), PROFILE_COLUMNS, 4)


@query("hold_table", _table_sql([HOLD_SQL], IS_HOLD, False))
def hold_table(spark, folder):
    return _round_all(feature_table(spark, folder, (HOLD,)), PROFILE_COLUMNS, 4)


@query("latency_table", _table_sql([LATENCY_SQL], IS_LATENCY, True))
def latency_table(spark, folder):
    return _round_all(feature_table(spark, folder, (LATENCY,), "latency_time"), PROFILE_COLUMNS, 4)


CHOSEN = ["mean_click_hold_time", "amax_view_hold_time", "skew_purchase_hold_time", "mean_view_click_latency_time",
          "iqr_view_view_latency_time"]


@query("select_optimal", _table_sql(
    [HOLD_SQL, LATENCY_SQL], IS_HOLD, True, ", ".join(["user_id", "label", "flag", *CHOSEN])
))
def select_optimal(spark, folder):
    return _round_all(feature_table(spark, folder).select("user_id", "label", "flag", *CHOSEN), ["user_id", "label", "flag"], 4)


assert set(STATS) == set(ALL_STATS)


def _rank_flags(df, keys, quartiles=(("q1", 0.25), ("median", 0.5), ("q3", 0.75))):
    """Whether each sketched quartile's true rank is as near as stated. ``df`` has the rows and their group's quartiles."""
    far = 2 * sketch.rank_error()
    n = F.count("*")
    flags = []
    for name, p in quartiles:
        below, upto = F.sum((F.col("value") < F.col(name)).cast("bigint")), F.sum((F.col("value") <= F.col(name)).cast("bigint"))
        flags.append(((below / n <= p + far) & (upto / n >= p - far)).alias(f"{name}_near"))
    return df.groupBy(*keys).agg(*flags)


@query("sketched_profile", f"""
SELECT l_returnflag, count(*) AS count, {_price_sql(["mean", "amax", "amin", "var", "std", "skew", "kurtosis"])},
       true AS q1_near, true AS median_near, true AS q3_near
FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_returnflag
""")
def sketched_profile(spark, folder):
    """Statistics from mergeable sketches: states by ship year, merged. Moments are exact, quartiles within the stated rank error."""
    rows = table(spark, folder, "lineitem").where(F.col("l_returnflag").isin("A", "N", "R")).select(
        "l_returnflag", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value"))
    merged = sketch.merged_states(sketch.states(rows, ["l_returnflag", "year"]), ["l_returnflag"])
    told = sketch.statistics(merged, ["l_returnflag"])
    near = _rank_flags(rows.join(F.broadcast(told.select("l_returnflag", "q1", "median", "q3")), "l_returnflag"), ["l_returnflag"])
    kept = ["mean", "amax", "amin", "var", "std", "skew", "kurtosis"]
    return told.select("l_returnflag", "count", *_price_stats(kept)).join(near, "l_returnflag")
