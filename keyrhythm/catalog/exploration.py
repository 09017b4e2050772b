"""Scaling, univariate scores and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyrhythm.catalog.documents import DOCUMENTS_SQL, FEATURES, labelled_documents
from keyrhythm.catalog.registry import query, table
from keyrhythm.functions.numeric import rounded
from keyrhythm.operators import explore
from keyrhythm.operators.gaussian import class_covariances, class_moments
from keyrhythm.operators.scaling import fit_scaling, unit_array, unit_rows
from keyrhythm.operators.selection import anova_f, gini_scores


def _part(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")


@query("standard_scale", """
SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () + 1e-9, 6) + 0.0 AS p_size,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () + 1e-9, 6) + 0.0 AS p_retailprice
FROM part
""")
def standard_scale(spark, folder):
    rows = _part(spark, folder)
    out = fit_scaling(rows, ["p_size", "p_retailprice"]).apply(rows)
    return out.select("p_partkey", *[rounded(c).alias(c) for c in ("p_size", "p_retailprice")])


@query("unit_variance", """
SELECT p_partkey, round(p_size / stddev_pop(p_size) OVER () + 1e-9, 6) + 0.0 AS p_size,
       round(p_retailprice / stddev_pop(p_retailprice) OVER () + 1e-9, 6) + 0.0 AS p_retailprice
FROM part
""")
def unit_variance(spark, folder):
    rows = _part(spark, folder)
    out = fit_scaling(rows, ["p_size", "p_retailprice"], centred=False).apply(rows)
    return out.select("p_partkey", *[rounded(c).alias(c) for c in ("p_size", "p_retailprice")])


@query("l2_normalize", """
SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice) + 1e-9, 6) + 0.0 AS p_size,
       round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice) + 1e-9, 6) + 0.0 AS p_retailprice
FROM part
""")
def l2_normalize(spark, folder):
    rows = _part(spark, folder).withColumn("p_size", F.col("p_size").cast("double"))
    out = unit_rows(rows, ["p_size", "p_retailprice"])
    return out.select("p_partkey", *[rounded(c).alias(c) for c in ("p_size", "p_retailprice")])


@query("l2_normalize_vectors", """
WITH v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS position
           FROM embeddings)
SELECT vec_id, CAST(position AS INTEGER) AS position, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-9, 6) + 0.0 AS value
FROM v
""")
def l2_normalize_vectors(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(unit_array("embedding")).alias("position", "v"))
    return rows.select("vec_id", "position", rounded("v").alias("value"))


def _unfolded(columns=FEATURES, source=DOCUMENTS_SQL, keep="label") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS feature, {c} AS x FROM ({source})" for c in columns)


ANOVA_SQL = f"""
SELECT feature, (sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
FROM (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v,
             sum(sum(x)) OVER (PARTITION BY feature) / sum(count(*)) OVER (PARTITION BY feature) AS grand
      FROM ({_unfolded()}) GROUP BY feature, label)
GROUP BY feature
"""


@query("anova_f", f"SELECT feature, round(f + 1e-9, 6) + 0.0 AS f_score FROM ({ANOVA_SQL})")
def anova(spark, folder):
    return anova_f(labelled_documents(spark, folder), FEATURES, "label").select(
        "feature", rounded("f_score").alias("f_score")
    )


BINNED_SQL = f"""
SELECT label, feature, CASE WHEN high = low THEN 0 ELSE least(floor((x - low) / (high - low) * 4), 3) END AS bin
FROM (SELECT *, min(x) OVER (PARTITION BY feature) AS low, max(x) OVER (PARTITION BY feature) AS high FROM ({_unfolded()}))
"""


@query("gini_score", f"""
WITH cells AS (SELECT feature, bin, label, count(*) AS n FROM ({BINNED_SQL}) GROUP BY 1, 2, 3),
bins AS (SELECT feature, sum(n) AS size, sum(n * n) AS sq FROM cells GROUP BY feature, bin),
after AS (SELECT feature, sum(size) AS total, sum(size - sq / size) AS impure FROM bins GROUP BY feature),
classes AS (SELECT feature, sum(n) AS c FROM cells GROUP BY feature, label),
before AS (SELECT feature, 1 - sum(c * c) / (sum(c) * sum(c)) AS prior FROM classes GROUP BY feature)
SELECT feature, round(prior - impure / total + 1e-9, 6) + 0.0 AS gini_score FROM after JOIN before USING (feature)
""")
def gini(spark, folder):
    return gini_scores(labelled_documents(spark, folder), FEATURES, "label").select(
        "feature", rounded("gini_score").alias("gini_score")
    )


@query("gaussian_nb_stats", f"""
SELECT label, feature, count(*) AS n, round(avg(x) + 1e-9, 4) + 0.0 AS mean, round(var_pop(x) / 1e6 + 1e-9, 6) + 0.0 AS var
FROM ({_unfolded()}) GROUP BY label, feature
""")
def gaussian_nb_stats(spark, folder):
    stats = class_moments(labelled_documents(spark, folder), FEATURES, "label")
    return stats.select(
        "label", "feature", "n", rounded("mean", 4).alias("mean"), rounded(F.col("var") / 1e6).alias("var")
    )


def _covariance_sql() -> str:
    parts = []
    for i, a in enumerate(FEATURES):
        for j in range(i, len(FEATURES)):
            parts.append(
                f"SELECT label, {i} AS i, {j} AS j, count(*) AS n, round(covar_samp({a}, {FEATURES[j]}) / 1e3 + 1e-9, 5) + 0.0 "
                f"AS covariance FROM d GROUP BY label"
            )
    return f"WITH d AS ({DOCUMENTS_SQL}) " + " UNION ALL ".join(parts)


@query("qda_stats", _covariance_sql())
def qda_stats(spark, folder):
    rows = labelled_documents(spark, folder).select("label", F.array(*FEATURES).alias("x"))
    cells = class_covariances(rows, "x", "label")
    return cells.select("label", "i", "j", "n", rounded(F.col("covariance") / 1e3, 5).alias("covariance"))


@query("feature_statistics", f"""
SELECT feature, round(avg(x) + 1e-9, 5) + 0.0 AS mean, round(quantile_cont(x, 0.5) + 1e-9, 5) + 0.0 AS median,
       round(stddev_samp(x) / avg(x) + 1e-9, 5) + 0.0 AS dispersion, round(min(x) + 1e-9, 5) + 0.0 AS min, round(max(x) + 1e-9, 5) + 0.0 AS max,
       count(*) - count(x) AS missing
FROM ({_unfolded(['value', 'k'], "SELECT event_type, value, CASE WHEN k >= 10 THEN k END AS k FROM (SELECT event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)", 'event_type')})
GROUP BY feature
""")
def feature_statistics(spark, folder):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, folder, "events").select("value", F.when(k >= 10, k).alias("k"))
    out = explore.feature_statistics(rows, ["value", "k"])
    return out.select(
        "feature", *[rounded(c, 5).alias(c) for c in ("mean", "median", "dispersion", "min", "max")], "missing"
    )


@query("box_summary", f"""
SELECT feature, label, count(x) AS count, round(min(x) + 1e-9, 5) + 0.0 AS min, round(quantile_cont(x, 0.25) + 1e-9, 5) + 0.0 AS q1,
       round(quantile_cont(x, 0.5) + 1e-9, 5) + 0.0 AS median, round(quantile_cont(x, 0.75) + 1e-9, 5) + 0.0 AS q3,
       round(max(x) + 1e-9, 5) + 0.0 AS max, round(avg(x) + 1e-9, 5) + 0.0 AS mean, round(any_value(f) + 1e-9, 5) + 0.0 AS f_score
FROM ({_unfolded()}) JOIN ({ANOVA_SQL}) USING (feature) GROUP BY feature, label
""")
def box_summary(spark, folder):
    out = explore.box_summary(labelled_documents(spark, folder), FEATURES, "label")
    return out.select(
        "feature", "label", "count",
        *[rounded(c, 5).alias(c) for c in ("min", "q1", "median", "q3", "max", "mean", "f_score")],
    )


@query("histogram", """
SELECT CAST(least(floor((value - low) / (high - low) * 10), 9) AS INTEGER) AS bin, event_type, count(*) AS n
FROM events CROSS JOIN (SELECT min(value) AS low, max(value) AS high FROM events) GROUP BY 1, 2
""")
def histogram(spark, folder):
    return explore.histogram(table(spark, folder, "events"), "value", "event_type", 10)


@query("crosstab_chi2", """
WITH cells AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
rows AS (SELECT o_orderpriority, sum(n) AS r FROM cells GROUP BY 1),
columns AS (SELECT o_orderstatus, sum(n) AS c FROM cells GROUP BY 1),
full_grid AS (SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n, r * c / (SELECT sum(n) FROM cells) AS e
              FROM rows CROSS JOIN columns LEFT JOIN cells USING (o_orderpriority, o_orderstatus))
SELECT o_orderpriority, o_orderstatus, CAST(n AS BIGINT) AS observed, round(e + 1e-9, 5) + 0.0 AS expected,
       round((n - e) * (n - e) / e + 1e-9, 5) + 0.0 AS chi2_part FROM full_grid
""")
def crosstab_chi2(spark, folder):
    out = explore.sieve(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select(
        "o_orderpriority", "o_orderstatus", "observed", rounded("expected", 5).alias("expected"),
        rounded("chi2_part", 5).alias("chi2_part"),
    )


def _chi2_sql(feature: str, expression: str) -> str:
    """Total chi-squared; for an even number of degrees of freedom its tail is a finite sum."""
    return f"""
SELECT '{feature}' AS feature, round(x + 1e-9, 6) + 0.0 AS chi2, CAST(df AS INTEGER) AS freedom,
       round(exp(-x / 2) * list_sum(list_transform(range(CAST(df // 2 AS BIGINT)), lambda k: pow(x / 2, k) / factorial(CAST(k AS INTEGER))))
             + 1e-9, 6) + 0.0 AS p
FROM (SELECT sum((coalesce(n, 0) - e) * (coalesce(n, 0) - e) / e) AS x,
             (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df
      FROM (SELECT a, b, r * c / t AS e FROM (SELECT a, count(*) AS r FROM ({expression}) GROUP BY a)
            CROSS JOIN (SELECT b, count(*) AS c FROM ({expression}) GROUP BY b)
            CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS t FROM ({expression})))
      LEFT JOIN (SELECT a, b, count(*) AS n FROM ({expression}) GROUP BY a, b) USING (a, b))
"""


@query("chi2_scores", _chi2_sql("priority", "SELECT o_orderpriority AS a, o_orderstatus AS b FROM orders") + " UNION ALL " + _chi2_sql(
    "year", "SELECT year(o_orderdate) AS a, o_orderstatus AS b FROM orders"
))
def chi2_scores(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), "o_orderstatus"
    )
    out = explore.chi2_scores(rows, ["priority", "year"], "o_orderstatus")
    return out.select("feature", rounded("chi2").alias("chi2"), "freedom", rounded("p").alias("p"))


@query("mosaic_shares", """
SELECT CAST(least(floor((p_size - l1) / (h1 - l1) * 4), 3) AS INTEGER) AS p_size_bin,
       CAST(least(floor((p_retailprice - l2) / (h2 - l2) * 4), 3) AS INTEGER) AS p_retailprice_bin,
       p_brand, count(*) AS n, round(count(*) / any_value(total) + 1e-9, 6) + 0.0 AS share
FROM part CROSS JOIN (SELECT CAST(min(p_size) AS DOUBLE) AS l1, CAST(max(p_size) AS DOUBLE) AS h1,
                             min(p_retailprice) AS l2, max(p_retailprice) AS h2, count(*) AS total FROM part)
GROUP BY 1, 2, 3
""")
def mosaic_shares(spark, folder):
    out = explore.mosaic(table(spark, folder, "part"), "p_size", "p_retailprice", "p_brand", 4)
    return out.withColumn("share", rounded("share"))


@query("linear_projection", """
SELECT l_orderkey, l_linenumber,
       round(a + b * cos(2 * pi() / 3) + c * cos(4 * pi() / 3) + 1e-9, 6) + 0.0 AS x,
       round(b * sin(2 * pi() / 3) + c * sin(4 * pi() / 3) + 1e-9, 6) + 0.0 AS y
FROM (SELECT l_orderkey, l_linenumber,
             (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS a,
             (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()) AS b,
             (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS c
      FROM lineitem)
""")
def linear_projection(spark, folder):
    out = explore.linear_projection(
        table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], ["l_orderkey", "l_linenumber"]
    )
    return out.select("l_orderkey", "l_linenumber", rounded("x").alias("x"), rounded("y").alias("y"))
