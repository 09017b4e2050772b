"""Transitions, pairs and keystrokes from ordered events."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyrhythm.catalog.registry import query, table
from keyrhythm.functions.keys import category_of
from keyrhythm.functions.numeric import rounded
from keyrhythm.operators.sequence import keystrokes_from_key_events, latencies

LAGGED = """
SELECT event_id, user_id, event_type, lag(event_type) OVER w AS earlier, row_number() OVER w AS place,
       (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000.0 AS latency_ms
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def _seen(spark, folder, pairs="sliding"):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    return latencies(
        rows, "user_id", "ts", "event_type", ["ts", "event_id"], pairs=pairs, separator="_"
    )


@query("derive_latency", f"""
SELECT event_id, user_id, round(latency_ms + 1e-9, 3) + 0.0 AS latency_ms FROM ({LAGGED}) WHERE earlier IS NOT NULL
""")
def derive_latency(spark, folder):
    return _seen(spark, folder).select("event_id", "user_id", rounded("latency_ms", 3).alias("latency_ms"))


@query("derive_transitions", f"""
SELECT user_id, earlier || '_' || event_type AS direction, count(*) AS n, round(avg(latency_ms) / 1e3 + 1e-9, 4) + 0.0 AS mean_s
FROM ({LAGGED}) WHERE earlier IS NOT NULL GROUP BY 1, 2
""")
def derive_transitions(spark, folder):
    return _seen(spark, folder).groupBy("user_id", "direction").agg(
        F.count("*").alias("n"), rounded(F.avg("latency_ms") / 1e3, 4).alias("mean_s")
    )


@query("derive_pairs", f"""
SELECT event_id, user_id, earlier || '_' || event_type AS direction, round(latency_ms + 1e-9, 3) + 0.0 AS latency_ms
FROM ({LAGGED}) WHERE place % 2 = 0
""")
def derive_pairs(spark, folder):
    return _seen(spark, folder, "disjoint").select(
        "event_id", "user_id", "direction", rounded("latency_ms", 3).alias("latency_ms")
    )


CODES = {65: ["click"], 74: ["view"], 32: ["purchase"], 75: ["signup"], 999: ["error"]}

KEY_EVENTS = """
typed AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, CAST(round(value * 1000) AS BIGINT) * 60000 AS held,
         CASE event_type WHEN 'click' THEN 65 WHEN 'view' THEN 74 WHEN 'purchase' THEN 32
                         WHEN 'signup' THEN 75 ELSE 999 END AS code FROM events),
keys AS (
  SELECT user_id, 2 * event_id AS seq, t, code, 'down' AS action FROM typed
  UNION ALL SELECT user_id, 2 * event_id + 1, t + held, code, 'up' FROM typed),
known AS (SELECT *, lag(action) OVER w AS before, lag(t) OVER w AS before_t
          FROM keys WINDOW w AS (PARTITION BY user_id ORDER BY t, seq)),
used AS (SELECT *, CASE code WHEN 65 THEN 'L' WHEN 74 THEN 'R' WHEN 75 THEN 'R' WHEN 32 THEN 'S' END AS hand
         FROM known WHERE action = 'up' OR before IS NULL OR before = 'up')
"""

# Flight runs from the event before an accepted down, which is always an up.
KEYSTROKES = f"""
WITH {KEY_EVENTS},
paired AS (SELECT *, lead(action) OVER w AS a, lead(t) OVER w AS up, lead(code) OVER w AS released
           FROM used WINDOW w AS (PARTITION BY user_id ORDER BY t, seq)),
presses AS (SELECT user_id, seq, t AS down, before_t, hand, CASE WHEN released = code THEN (up - t) / 1000.0 END AS hold
            FROM paired WHERE action = 'down' AND a = 'up'),
told AS (SELECT *, lag(hand) OVER w AS hand0, lag(down) OVER w AS down0
         FROM presses WINDOW w AS (PARTITION BY user_id ORDER BY down, seq))
SELECT user_id, down AS at_us, hand, round(hold + 1e-9, 3) + 0.0 AS hold, hand0 || hand AS direction,
       round((down - down0) / 1000.0 + 1e-9, 3) + 0.0 AS latency, round((down - before_t) / 1000.0 + 1e-9, 3) + 0.0 AS flight
FROM told WHERE down0 IS NOT NULL
"""

# A key-up ends all accepted downs of its key since that key's up before; the first of them starts the hold.
TYPED_ROWS = f"""
WITH {KEY_EVENTS},
rounds AS (SELECT *, count(*) FILTER (WHERE action = 'up') OVER (PARTITION BY user_id, code ORDER BY t, seq
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(action = 'up' AS BIGINT) AS round
           FROM used),
held AS (SELECT *, CASE WHEN action = 'up'
                   THEN (t - min(t) FILTER (WHERE action = 'down') OVER (PARTITION BY user_id, code, round)) / 1000.0 END AS hold
         FROM rounds),
paired AS (SELECT *, lag(hold) OVER (PARTITION BY user_id ORDER BY t, seq) AS last_hold FROM held),
told AS (SELECT *, lag(t) OVER w AS down0, row_number() OVER w AS place,
                coalesce(last_value(hand IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, seq
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'L') AS hand0
         FROM paired WHERE action = 'down' WINDOW w AS (PARTITION BY user_id ORDER BY t, seq))
SELECT user_id, t AS at_us, hand0 AS hand, round(last_hold + 1e-9, 3) + 0.0 AS hold, hand0 || coalesce(hand, 'L') AS direction,
       round((t - down0) / 1000.0 + 1e-9, 3) + 0.0 AS latency, round((t - before_t) / 1000.0 + 1e-9, 3) + 0.0 AS flight
FROM told WHERE place % 2 = 0
"""


def _keystrokes(spark, folder, **options):
    typed = table(spark, folder, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.round(F.col("value") * 1000).cast("bigint") * 60000).alias("held"),
        category_of("event_type", {str(c): names for c, names in CODES.items()}).cast("int").alias("key_code"),
    )
    both = F.array(
        F.struct(F.timestamp_micros("t").alias("ts"), (F.col("event_id") * 2).alias("seq"), F.lit("down").alias("action")),
        F.struct(F.timestamp_micros(F.col("t") + F.col("held")).alias("ts"), (F.col("event_id") * 2 + 1).alias("seq"),
                 F.lit("up").alias("action")),
    )
    keys = typed.select("user_id", "key_code", F.explode(both).alias("_k")).select("user_id", "key_code", "_k.*")
    rows = keystrokes_from_key_events(keys, **options)
    return rows.select(
        "user_id", F.unix_micros("ts").alias("at_us"), F.col("Hand").alias("hand"),
        rounded("`Hold time`", 3).alias("hold"), F.col("Direction").alias("direction"),
        rounded("`Latency time`", 3).alias("latency"), rounded("`Flight time`", 3).alias("flight"),
    )


@query("derive_keystrokes", KEYSTROKES)
def derive_keystrokes(spark, folder):
    return _keystrokes(spark, folder)


@query("derive_typed_rows", TYPED_ROWS)
def derive_typed_rows(spark, folder):
    """Disjoint pairs told from the earlier key, as a page sends them."""
    return _keystrokes(spark, folder, pairs="disjoint", side="previous", unknown="typed")
