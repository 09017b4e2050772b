"""Typing sessions made from documents: the words of a text play the keys of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyrhythm.catalog import modelsql, sqltext
from keyrhythm.catalog.registry import query, table
from keyrhythm.config import CHOSEN_FEATURES, FOUR_DIRECTIONS, FeatureConfig
from keyrhythm.functions.numeric import rounded, to_number
from keyrhythm.operators.gaussian import QuadraticDiscriminant
from keyrhythm.operators.profile import Measure
from keyrhythm.plans.classifiers import tree
from keyrhythm.plans.scoring import explode_sessions, score_sessions, session_features, session_statistics
from keyrhythm.session import new_folder, settled
from keyrhythm.sources.files import sessions_from_posts
from keyrhythm.sources.models import fit_pipeline, load_pipeline, save_model


def _hand(length):
    return F.when(length <= 3, "L").when(length <= 6, "R").when(length <= 9, "S").otherwise("X")


def sessions(spark, folder, of=None) -> DataFrame:
    """(session_id, profile, keys): one session per document, or per document whose ``doc_id`` is in the table ``of``."""
    lengths = F.transform(F.filter(F.split("text", " "), lambda w: F.length(w) > 0), lambda w: F.length(w))
    # A file may be a single split; the texts are spread before the work on them.
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    if of is not None:
        # Spark would join the finished sessions and so make the keys of all.
        docs = docs.join(of.select("doc_id"), "doc_id", "left_semi")
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # Each word's hand is found once, not for both of the keys that it plays.
    words = F.transform(lengths, lambda n: F.struct(n.alias("n"), _hand(n).alias("hand")))
    docs = docs.select("doc_id", "lang", "n_chars", words.alias("_n"))

    def key(before, own):
        return F.struct(
            own["hand"].alias("Hand"), (own["n"] * 25.0).cast("string").alias("Hold time"),
            F.concat(before["hand"], own["hand"]).alias("Direction"),
            ((before["n"] + own["n"]) * 40.0).cast("string").alias("Latency time"),
            (before["n"] * 15.0).cast("string").alias("Flight time"),
        )

    count = F.greatest(F.size("_n") - 1, F.lit(0))
    keys = F.zip_with(F.slice("_n", F.lit(1), count), F.slice("_n", F.lit(2), count), key)
    profile = F.struct(
        F.lit("Female").alias("Gender"), F.when(F.col("n_chars") > 1000, "Yes").otherwise("No").alias("Tremors"),
        F.when(F.col("lang") == "en", "None").when(F.col("lang") == "fr", "Left").otherwise("Right").alias("Sided"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("session_id"), profile.alias("profile"), keys.alias("keys"))


def posted_sessions(spark, folder) -> DataFrame:
    """The same sessions, written as the posted JSON array (profile first, then the keys) and read back."""
    # The keys are written by one call for the whole array, not by one for each key.
    told = sessions(spark, folder).select("session_id", F.to_json("profile").alias("_profile"), F.to_json("keys").alias("_keys"))
    payload = F.concat(F.lit("["), "_profile", F.when(F.col("_keys") == "[]", "]").otherwise(F.concat(F.lit(","), F.substring("_keys", 2, 2**31 - 1))))
    return sessions_from_posts(told.select("session_id", payload.alias("payload")))


def _hand_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 3 THEN 'L' WHEN {n} <= 6 THEN 'R' WHEN {n} <= 9 THEN 'S' ELSE 'X' END"


KEYS_SQL = f"""
words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS place
          FROM documents),
lengths AS (SELECT doc_id, place, length(w) AS n, lag(length(w)) OVER (PARTITION BY doc_id ORDER BY place) AS n0
            FROM words WHERE length(w) > 0),
keys AS (SELECT CAST(doc_id AS VARCHAR) AS session_id,
                CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS position,
                {_hand_sql('n')} AS hand, n * 25.0 AS hold, {_hand_sql('n0')} || {_hand_sql('n')} AS direction,
                (n0 + n) * 40.0 AS latency, n0 * 15.0 AS flight FROM lengths WHERE n0 IS NOT NULL),
valid AS (SELECT * FROM keys WHERE hold > 0 AND hold < 2000 AND latency > 0 AND latency < 2000)
"""


@query("session_explode", f"""
WITH {KEYS_SQL}
SELECT session_id, position, hand, CAST(hold AS DOUBLE) AS hold, direction, CAST(latency AS DOUBLE) AS latency,
       CAST(flight AS DOUBLE) AS flight FROM keys
""")
def session_explode(spark, folder):
    return explode_sessions(posted_sessions(spark, folder)).select(
        "session_id", "position", F.col("Hand").alias("hand"), to_number("`Hold time`").alias("hold"),
        F.col("Direction").alias("direction"), to_number("`Latency time`").alias("latency"),
        to_number("`Flight time`").alias("flight"),
    )


STATS = FeatureConfig().stats


def _filled_sql() -> str:
    parts = []
    for suffix, category, levels in (
        ("hold_time", "hand", ("L", "R", "S")), ("latency_time", "direction", FOUR_DIRECTIONS)
    ):
        listed = ", ".join(f"'{level}'" for level in levels)
        value = suffix.split("_")[0]
        stats = ", ".join(f"{sqltext.stat(s, f'CAST({value} AS DOUBLE)')} AS {s}" for s in STATS)
        parts.append(
            f"SELECT session_id, '{suffix}' AS measure, {category} AS level, {stats} FROM valid "
            f"WHERE {category} IN ({listed}) GROUP BY session_id, {category}"
        )
    filled = ", ".join(f"coalesce({s}, avg({s}) OVER (PARTITION BY session_id, measure)) AS {s}" for s in STATS)
    return f"stats AS ({' UNION ALL '.join(parts)}), filled AS (SELECT session_id, measure, level, {filled} FROM stats)"


def _cell_sql(name: str) -> str:
    if name == "Tremors":
        return "max(CAST(n_chars > 1000 AS DOUBLE))"
    if name == "Sided_None":
        return "max(CAST(lang = 'en' AS DOUBLE))"
    stat, level, suffix = name.split("_", 2)
    return f"max({stat}) FILTER (WHERE measure = '{suffix}' AND level = '{level}')"


@query("session_features", f"WITH {KEYS_SQL}, {_filled_sql()} SELECT CAST(doc_id AS VARCHAR) AS session_id, " + ", ".join(
    f"round(coalesce({_cell_sql(c)}, 0) + 1e-9, 5) + 0.0 AS {c}" for c in CHOSEN_FEATURES
) + " FROM documents LEFT JOIN filled ON session_id = CAST(doc_id AS VARCHAR) GROUP BY doc_id")
def features(spark, folder):
    out = session_features(sessions(spark, folder))
    return out.select("session_id", *[rounded(c, 5).alias(c) for c in CHOSEN_FEATURES])


def fitted_session_model(spark, folder, classifier=None, columns=tuple(CHOSEN_FEATURES)):
    """A classifier (a tree, if none is given) over chosen features, fitted on the sessions whose documents have labels."""
    labels = table(spark, folder, "labels")
    known = sessions(spark, folder, of=labels)
    labels = labels.select(F.col("doc_id").cast("string").alias("session_id"), F.col("quality").alias("label"))
    rows = settled(session_features(known, columns=columns).join(labels, "session_id"))
    return fit_pipeline(rows, list(columns), classifier or tree(5))


@query("session_score")
def session_score(spark, folder):
    return score_sessions(sessions(spark, folder), fitted_session_model(spark, folder))


#: Two features on which SQL can state the discriminant.
SCORED = ("mean_L_hold_time", "mean_LR_latency_time")


def fitted_discriminant(spark, folder):
    return fitted_session_model(spark, folder, QuadraticDiscriminant(), SCORED)


DISCRIMINANT_SQL = f"""
WITH {KEYS_SQL}, {_filled_sql()},
f AS (SELECT CAST(doc_id AS VARCHAR) AS key, {", ".join(f"CAST(coalesce({_cell_sql(c)}, 0) AS DOUBLE) AS x{i}" for i, c in enumerate(SCORED))}
      FROM documents LEFT JOIN filled ON session_id = CAST(doc_id AS VARCHAR) GROUP BY doc_id),
cases AS (SELECT 0 AS held, key, quality AS label, x0, x1, false AS test FROM f JOIN labels ON key = CAST(doc_id AS VARCHAR)
          UNION ALL SELECT 0, key, NULL, x0, x1, true FROM f), {modelsql.discriminant()}
SELECT key AS session_id, CAST(prediction AS INTEGER) AS prediction FROM ({modelsql.predicted("discriminant")})
"""


@query("session_score_discriminant", DISCRIMINANT_SQL)
def session_score_discriminant(spark, folder):
    return score_sessions(sessions(spark, folder), fitted_discriminant(spark, folder), columns=SCORED)


@query("model_reload", DISCRIMINANT_SQL)
def model_reload(spark, folder):
    """What the model tells after it was saved and loaded again."""
    path = new_folder(spark, "model")
    save_model(fitted_discriminant(spark, folder), path)
    return score_sessions(sessions(spark, folder), load_pipeline(path), columns=SCORED)


@query("session_flight", f"""
WITH {KEYS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS session_id, """ + ", ".join(
    sqltext.rounded(sqltext.stat(s, "CAST(flight AS DOUBLE)", f"direction = '{d}'"), f"{s}_{d}_flight_time", 5)
    for s in STATS for d in FOUR_DIRECTIONS
) + " FROM documents LEFT JOIN valid ON session_id = CAST(doc_id AS VARCHAR) GROUP BY doc_id")
def session_flight(spark, folder):
    measure = Measure("flight_time", "Direction", "Flight time", FOUR_DIRECTIONS)
    out = session_statistics(sessions(spark, folder), [measure], STATS, FeatureConfig(), fill=False)
    return out.select("session_id", *[rounded(c, 5).alias(c) for c in out.columns if c.endswith("_flight_time")])
