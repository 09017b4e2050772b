"""Parsing, encoding, filters, semi joins and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyrhythm.catalog.registry import query, table
from keyrhythm.functions.encode import null_unless_in, one_hot, true_false
from keyrhythm.functions.keys import LEFT_HAND_CODES, RIGHT_HAND_CODES, SPACE_CODES, hand_of
from keyrhythm.functions.numeric import rounded, to_number
from keyrhythm.functions.text import id_from_log_path, id_from_profile_path, profile_fields
from keyrhythm.operators.filters import inside, keep_large_groups, keys_of, mild_or_untreated, semi_join_spread
from keyrhythm.operators.impute import negatives_to_mean
from keyrhythm.operators.profile import last_per_group
from keyrhythm.session import new_folder
from keyrhythm.sources.files import read_tsv_table, union_logs, write_table


@query("profile_parse", """
SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS user_id, c_name AS name,
       CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal AS balance, c_mktsegment AS segment
FROM customer
""")
def profile_parse(spark, folder):
    line = F.concat(
        F.lit("Name: "), "c_name", F.lit("\r\nNation: "), F.col("c_nationkey").cast("string"),
        F.lit("\r\nBalance: "), F.col("c_acctbal").cast("string"), F.lit("\r\nSegment: "), "c_mktsegment", F.lit("\r\n"),
    )
    path = F.concat(F.lit("users/User_"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(".txt"))
    raw = table(spark, folder, "customer").select(path.alias("path"), line.alias("text"))
    fields = raw.select(
        id_from_profile_path("path").alias("user_id"),
        *[f.alias(n) for f, n in zip(profile_fields("text", ["Name", "Nation", "Balance", "Segment"]),
                                     ["name", "nation", "balance", "segment"])],
    )
    return fields.withColumn("balance", to_number("balance"))


@query("id_from_path", """
SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS file_id FROM orders
""")
def id_from_path(spark, folder):
    path = F.concat(
        F.lit("data/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("_"),
        F.date_format("o_orderdate", "yyMM"), F.lit(".txt"),
    )
    return table(spark, folder, "orders").select("o_orderkey", id_from_log_path(path).alias("file_id"))


@query("tsv_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def tsv_roundtrip(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = new_folder(spark, "tsv")
    write_table(rows, path, "tsv")
    return read_tsv_table(spark, path, rows.schema)


@query("recode_binary", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS flag FROM customer
""")
def recode_binary(spark, folder):
    text = F.when(F.col("c_acctbal") < 0, "------").when(F.col("c_acctbal") > 4000, "True").otherwise("False")
    return table(spark, folder, "customer").select("c_custkey", true_false(text).alias("flag"))


@query("recode_keep", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '------' WHEN c_acctbal > 4000 THEN '1' ELSE '0' END AS flag FROM customer
""")
def recode_keep(spark, folder):
    text = F.when(F.col("c_acctbal") < 0, "------").when(F.col("c_acctbal") > 4000, "True").otherwise("False")
    return table(spark, folder, "customer").select("c_custkey", true_false(text, "keep").alias("flag"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS
) + " FROM customer")
def one_hot_segments(spark, folder):
    return one_hot(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("null_invalid", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS priority FROM orders
""")
def null_invalid(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", null_unless_in("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("priority")
    )


@query("coerce_numeric", """
SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN value END AS number FROM events
""")
def coerce_numeric(spark, folder):
    value, kind = F.col("value").cast("string"), F.col("event_type")
    text = (
        F.when(kind == "click", value)
        .when(kind == "signup", F.concat(F.lit("00"), value))
        .when(kind == "error", F.concat(value, F.lit("d")))
        .when(kind == "view", F.concat(F.lit("L"), value))
        .otherwise("")
    )
    return table(spark, folder, "events").select("event_id", to_number(text).alias("number"))


@query("cohort", """
SELECT c_custkey FROM customer
WHERE (c_acctbal > 4000 AND c_mktsegment = 'BUILDING') OR (c_acctbal <= 4000 AND c_nationkey >= 12)
""")
def cohort(spark, folder):
    coded = table(spark, folder, "customer").select(
        "c_custkey",
        (F.col("c_acctbal") > 4000).cast("int").alias("label"),
        F.col("c_mktsegment").alias("severity"),
        (F.col("c_nationkey") < 12).cast("int").alias("treated"),
    )
    return coded.where(mild_or_untreated("label", "severity", "treated", "BUILDING")).select("c_custkey")


@query("valid_range", """
SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events
WHERE value > 0 AND value < 50 AND CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) > 0
  AND CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) < 50
""")
def valid_range(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", "value", to_number(F.get_json_object("props", "$.k")).alias("k")
    )
    return rows.where(inside(["value", "k"], 50.0))


@query("min_group_size", """
SELECT event_id, user_id FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 66)
""")
def min_group_size(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id")
    return keep_large_groups(rows, "user_id", 66)


@query("semi_users_with_logs", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)
""")
def semi_users_with_logs(spark, folder):
    users = keys_of(table(spark, folder, "events"), "user_id", "c_custkey")
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(users, "c_custkey", "left_semi")


@query("semi_logs_in_cohort", """
SELECT event_id, user_id, value FROM events
WHERE user_id IN (SELECT c_custkey FROM customer
                  WHERE (c_acctbal > 4000 AND c_mktsegment = 'BUILDING') OR (c_acctbal <= 4000 AND c_nationkey >= 12))
""")
def semi_logs_in_cohort(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "value")
    return semi_join_spread(rows, keys_of(cohort(spark, folder), "c_custkey", "user_id"), "user_id")


@query("impute_negative", """
SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN (SELECT avg(c_acctbal) FROM customer) ELSE c_acctbal END + 1e-9, 6) + 0.0
       AS balance FROM customer
""")
def impute_negative(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return negatives_to_mean(rows, "balance").select("c_custkey", rounded("balance").alias("balance"))


@query("last_per_group", "SELECT user_id, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
def last_value(spark, folder):
    return last_per_group(table(spark, folder, "events"), "user_id", "value", ["ts", "event_id"])


@query("union_logs", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
""")
def union_tables(spark, folder):
    customers = table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    suppliers = table(spark, folder, "supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS id", "s_name AS name")
    return union_logs([customers, suppliers])


def _in(codes):
    return ", ".join(str(c) for c in codes)


@query("map_category", f"""
SELECT p_partkey, CASE WHEN p_size IN ({_in(LEFT_HAND_CODES)}) THEN 'L' WHEN p_size IN ({_in(RIGHT_HAND_CODES)}) THEN 'R'
                       WHEN p_size IN ({_in(SPACE_CODES)}) THEN 'S' END AS hand
FROM part
""")
def map_category(spark, folder):
    return table(spark, folder, "part").select("p_partkey", hand_of("p_size").alias("hand"))
