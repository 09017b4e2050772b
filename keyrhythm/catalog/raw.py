"""Raw profile files and keystroke logs to the feature tables, in every variant.

A customer is a user with a profile file; an event is a line of the user's log file. Both are written
under the recorder's names and read back with the readers of the raw formats.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from keyrhythm.catalog import sqltext
from keyrhythm.catalog.registry import query, table
from keyrhythm.config import KEYSTROKE_FIELDS, LEVELS, PROFILE_FIELDS, VARIANTS
from keyrhythm.functions.numeric import rounded
from keyrhythm.plans.features import feature_tables
from keyrhythm.session import new_folder
from keyrhythm.sources.files import list_files, read_keystrokes, read_profiles, typed_keystrokes
from keyrhythm.sources.raw import write_log_files, write_profile_files

MORE_THAN = 50


def profiles(spark, folder):
    key = F.col("c_custkey")
    told = {
        "BirthYear": F.concat(F.lit("19"), F.lpad((key % 60 + 20).cast("string"), 2, "0")),
        "Gender": F.when(key % 2 == 0, "Female").otherwise("Male"),
        "Parkinsons": F.when(F.col("c_acctbal") > 4000, "True").otherwise("False"),
        "Tremors": F.when(F.col("c_nationkey") < 12, "True").otherwise("False"),
        "Sided": F.when(key % 3 == 0, "Left").when(key % 3 == 1, "None").otherwise("Right"),
        "Impact": F.when(key % 5 < 3, "Mild").when(key % 5 == 3, "Severe").otherwise("------"),
        "Levadopa": F.when(key % 7 == 0, "True").otherwise("False"),
    }
    lines = [F.concat(F.lit(f"{name}: "), told.get(name, F.lit("------")), F.lit("\r\n")) for name in PROFILE_FIELDS]
    texts = table(spark, folder, "customer").select(
        F.lpad(key.cast("string"), 10, "0").alias("user_id"), F.concat(*lines).alias("text")
    )
    path = new_folder(spark, "users")
    write_profile_files(texts, path)
    return read_profiles(spark, path)


def keystrokes(spark, folder):
    n = F.col("event_id")
    hand = F.when(F.col("event_type") == "click", "L").when(F.col("event_type") == "view", "R").when(
        F.col("event_type") == "purchase", "S").otherwise("X")
    later = F.when(n % 3 == 0, "L").when(n % 3 == 1, "R").otherwise("S")
    told = {
        "user_id": F.lpad(F.col("user_id").cast("string"), 10, "0"),
        "Date": F.when(n % 2 == 0, "160801").otherwise("160902"),
        "Timestamp": F.lit("10:00:00.000"), "Hand": hand, "Direction": F.concat(hand, later),
        "Hold time": F.concat(F.floor(F.col("value") * 25).cast("string"), F.lit(".5")),
        "Latency time": F.when(n % 97 == 0, "1C").otherwise((n * 7919 % 3500).cast("string")),
        "Flight time": F.lit("0100.0"),
    }
    path = new_folder(spark, "logs")
    rows = table(spark, folder, "events").select(*[told[c].alias(c) for c in KEYSTROKE_FIELDS], "event_id")
    write_log_files(rows, path, KEYSTROKE_FIELDS, ["event_id"])
    return read_keystrokes(spark, path)


RAW_SQL = f"""
p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS user_id, CAST(c_acctbal > 4000 AS INTEGER) AS "Parkinsons",
             CAST(c_nationkey < 12 AS INTEGER) AS "Tremors", CAST(c_custkey % 7 = 0 AS INTEGER) AS "Levadopa",
             CASE c_custkey % 3 WHEN 0 THEN 'Left' WHEN 1 THEN 'None' ELSE 'Right' END AS sided,
             CASE c_custkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END AS gender, c_custkey % 5 < 3 AS mild FROM customer),
cohort AS (SELECT * FROM p WHERE ("Parkinsons" = 1 AND mild) OR ("Parkinsons" = 0 AND "Levadopa" = 0)),
typed AS (SELECT *, hand || CASE event_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'S' END AS direction FROM (
            SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS user_id, event_id, floor(value * 25) + 0.5 AS hold,
                   CASE event_type WHEN 'click' THEN 'L' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'S' ELSE 'X' END AS hand,
                   CASE WHEN event_id % 97 <> 0 THEN CAST(event_id * 7919 % 3500 AS DOUBLE) END AS latency FROM events)),
own AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS size FROM typed)
"""


def _sql(variant: str, name: str) -> str:
    config = VARIANTS[variant]
    measures = [m for m in config.measures if name in ("both", m.suffix.split("_")[0])]
    told = [(m.suffix, m.category.lower(), m.suffix.split("_")[0], m.levels) for m in measures]
    cells = sqltext.wide(told, config.stats)
    for d in config.differences:
        for suffix, category, value, _ in told:
            if d.suffix == suffix:
                means = [sqltext.stat("mean", value, f"{category} = '{level}'") for level in (d.first, d.second)]
                cells.append((d.name, f"abs({means[0]} - {means[1]})"))
    first = told[0]
    levels = ", ".join(f"'{level}'" for level in first[3])
    coded = [f"CAST({c.lower()} = '{level}' AS INTEGER) AS \"{c}_{level}\"" for c in config.one_hot for level in LEVELS[c]]
    coded += ['"Levadopa"'] if "Levadopa" not in (*config.dropped, *config.dropped_at_end) else []
    return f"""
WITH {RAW_SQL}
SELECT "Parkinsons", "Tremors", {', '.join(coded)}, s.* EXCLUDE (user_id) FROM cohort JOIN (
  SELECT user_id, {', '.join(sqltext.rounded(sqltext.scaled(n.split('_')[0], e), n, 4) for n, e in cells)}
  FROM own WHERE size > {MORE_THAN} AND hold > 0 AND hold < {config.upper} AND latency > 0 AND latency < {config.upper}
  GROUP BY user_id HAVING count(*) FILTER (WHERE {first[1]} IN ({levels})) > 0) s USING (user_id)
"""


def _table(spark, folder, variant: str, name: str):
    config = replace(VARIANTS[variant], more_than=MORE_THAN)
    out = feature_tables(profiles(spark, folder), keystrokes(spark, folder), config)[name]
    measured = set(config.statistic_names())
    return out.select(*[
        rounded(F.col(c) / 1e6 if c.startswith("var_") else c, 4).alias(c) if c in measured else c for c in out.columns
    ])


def _register(variant: str, name: str) -> None:
    @query(f"raw_{name}_{variant}", _sql(variant, name))
    def raw_table(spark, folder):
        return _table(spark, folder, variant, name)


for _variant in VARIANTS:
    _register(_variant, "both")
_register("wide", "hold")
_register("wide", "latency")


@query("raw_file_list", """
SELECT 'User_' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || '.txt' AS file, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS user_id,
       CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS place FROM customer
""")
def raw_file_list(spark, folder):
    """The sorted list of profile files with the id of each."""
    texts = table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("user_id"), F.lit("Gender: Male\r\n").alias("text"))
    path = new_folder(spark, "users")
    write_profile_files(texts, path)
    return list_files(spark, path)


@query("raw_keystrokes", """
SELECT lpad(CAST(user_id AS VARCHAR), 10, '0') AS file_id, CASE event_id % 2 WHEN 0 THEN '160801' ELSE '160902' END AS "Date",
       CAST(floor(value * 25) + 0.5 AS DOUBLE) AS hold, CASE WHEN event_id % 97 <> 0 THEN CAST(event_id * 7919 % 3500 AS DOUBLE) END AS latency
FROM events
""")
def raw_keystrokes(spark, folder):
    """Log files read back: the id of the file name, and times of which corrupt ones are missing."""
    rows = typed_keystrokes(keystrokes(spark, folder))
    return rows.select("file_id", "Date", F.col("Hold time").alias("hold"), F.col("Latency time").alias("latency"))
