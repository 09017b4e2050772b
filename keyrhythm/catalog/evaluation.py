"""Splits, folds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyrhythm.catalog.documents import DOCUMENTS_SQL, PREDICTIONS_SQL, labelled_documents, rule_predictions
from keyrhythm.catalog.registry import query, table
from keyrhythm.functions.numeric import rounded
from keyrhythm.operators import metrics as M
from keyrhythm.operators.splits import contiguous_folds, stratified_folds, stratified_split
from keyrhythm.operators.voting import majority, mean_probabilities, most_likely


@query("class_balance", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def class_balance(spark, folder):
    return M.class_balance(table(spark, folder, "labels"), "quality")


@query("stratified_split", """
SELECT doc_id, quality, CAST(place <= floor(size * 0.4 + 0.5) AS INTEGER) AS is_test FROM (
  SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS size,
         row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS place
  FROM labels)
""")
def split_labels(spark, folder):
    return stratified_split(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("kfold_assign", """
SELECT c_custkey, CAST(CASE WHEN place < longer * (size + 1) THEN place // (size + 1)
                            ELSE longer + (place - longer * (size + 1)) // size END AS INTEGER) AS fold
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place,
             count(*) OVER () // 7 AS size, count(*) OVER () % 7 AS longer FROM customer)
""")
def kfold_customers(spark, folder):
    return contiguous_folds(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 7)


@query("stratified_kfold", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels
""")
def stratified_kfold(spark, folder):
    return stratified_folds(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "quality")


VOTES_SQL = f"""
SELECT doc_id, CAST(chars > 900 AS INTEGER) AS a, CAST(digits > 12 AS INTEGER) AS b,
       CASE WHEN word_length > 7 THEN 2 WHEN word_length > 6 THEN 1 ELSE 0 END AS c, lines / (lines + 8.0) AS p
FROM ({DOCUMENTS_SQL})
"""


def _votes(spark, folder):
    long = F.when(F.col("word_length") > 7, 2).when(F.col("word_length") > 6, 1).otherwise(0)
    return labelled_documents(spark, folder).select(
        "doc_id", (F.col("chars") > 900).cast("int").alias("a"), (F.col("digits") > 12).cast("int").alias("b"),
        long.alias("c"), (F.col("lines") / (F.col("lines") + 8.0)).alias("p"),
    )


@query("vote_hard", f"""
SELECT doc_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE least(a, b, c) END AS prediction
FROM ({VOTES_SQL})
""")
def vote_hard(spark, folder):
    return _votes(spark, folder).select("doc_id", majority(F.array("a", "b", "c")).cast("int").alias("prediction"))


@query("vote_soft", f"""
SELECT doc_id, round((p + a * 0.8 + (1 - a) * 0.3 + b * 0.6 + (1 - b) * 0.4) / 3 + 1e-9, 6) + 0.0 AS probability,
       CAST((p + a * 0.8 + (1 - a) * 0.3 + b * 0.6 + (1 - b) * 0.4) / 3 > 0.5 AS INTEGER) AS prediction
FROM ({VOTES_SQL})
""")
def vote_soft(spark, folder):
    def pair(p):
        return F.array(1.0 - p, p)

    told = [F.col("p"), F.when(F.col("a") == 1, 0.8).otherwise(0.3), F.when(F.col("b") == 1, 0.6).otherwise(0.4)]
    mean = _votes(spark, folder).select("doc_id", mean_probabilities([pair(p) for p in told]).alias("mean"))
    return mean.select(
        "doc_id", rounded(F.get("mean", F.lit(1))).alias("probability"),
        most_likely(F.col("mean")).cast("int").alias("prediction"),
    )


@query("confusion", f"""
WITH p AS ({PREDICTIONS_SQL}), classes AS (SELECT label AS c FROM p UNION SELECT prediction FROM p)
SELECT a.c AS label, b.c AS prediction, count(p.doc_id) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN p ON p.label = a.c AND p.prediction = b.c GROUP BY 1, 2
""")
def confusion(spark, folder):
    return M.confusion(rule_predictions(spark, folder))


CLASSES_SQL = f"""
WITH p AS ({PREDICTIONS_SQL}), classes AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
counts AS (SELECT class, count(*) FILTER (WHERE label = class) AS support,
                  count(*) FILTER (WHERE prediction = class) AS predicted,
                  count(*) FILTER (WHERE label = class AND prediction = class) AS hits
           FROM classes CROSS JOIN p GROUP BY class),
scores AS (SELECT class, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
                  CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
                  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1 FROM counts)
"""


def _rounded_scores(df, keep):
    return df.select(*keep, *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("prf_per_class", CLASSES_SQL + """
SELECT class, round(precision + 1e-9, 6) + 0.0 AS precision, round(recall + 1e-9, 6) + 0.0 AS recall, round(f1 + 1e-9, 6) + 0.0 AS f1, support
FROM scores
""")
def prf_per_class(spark, folder):
    return _rounded_scores(M.per_class(rule_predictions(spark, folder)), ["class"])


@query("class_report", CLASSES_SQL + """, rows AS (
SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scores
UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM scores
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support) FROM scores)
SELECT class, round(precision + 1e-9, 6) + 0.0 AS precision, round(recall + 1e-9, 6) + 0.0 AS recall, round(f1 + 1e-9, 6) + 0.0 AS f1,
       CAST(support AS BIGINT) AS support FROM rows
""")
def class_report(spark, folder):
    return _rounded_scores(M.class_report(rule_predictions(spark, folder)), ["class"])


@query("metrics", f"""
SELECT round(avg(CAST(label = prediction AS INTEGER)) + 1e-9, 6) + 0.0 AS accuracy FROM ({PREDICTIONS_SQL})
""")
def accuracy(spark, folder):
    return M.accuracy(rule_predictions(spark, folder)).select(rounded("accuracy").alias("accuracy"))


STEPS_SQL = f"""
WITH steps AS (SELECT score, sum(CAST(label = 1 AS INTEGER)) AS p, sum(CAST(label <> 1 AS INTEGER)) AS n
               FROM ({PREDICTIONS_SQL}) GROUP BY score),
running AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp,
                   sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM steps),
points AS (SELECT score, tp / all_p AS tpr, fp / all_n AS fpr, tp / (tp + fp) AS precision FROM running),
moves AS (SELECT *, lag(tpr, 1, 0.0) OVER (ORDER BY score DESC) AS tpr0, lag(fpr, 1, 0.0) OVER (ORDER BY score DESC) AS fpr0
          FROM points)
"""


@query("roc_points", STEPS_SQL + """
SELECT score AS threshold, round(fpr + 1e-9, 6) + 0.0 AS fpr, round(tpr + 1e-9, 6) + 0.0 AS tpr FROM points
UNION ALL SELECT CAST('infinity' AS DOUBLE), 0.0, 0.0
""")
def roc_points(spark, folder):
    points = M.roc_points(rule_predictions(spark, folder))
    return points.select("threshold", rounded("fpr").alias("fpr"), rounded("tpr").alias("tpr"))


@query("auc", STEPS_SQL + "SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2) + 1e-9, 6) + 0.0 AS auc FROM moves")
def auc(spark, folder):
    return M.ranking_scores(rule_predictions(spark, folder)).select(rounded("auc").alias("auc"))


@query("average_precision", STEPS_SQL + """
SELECT round(sum((tpr - tpr0) * precision) + 1e-9, 6) + 0.0 AS average_precision FROM moves
""")
def average_precision(spark, folder):
    scores = M.ranking_scores(rule_predictions(spark, folder))
    return scores.select(rounded("average_precision").alias("average_precision"))


@query("misclassified", f"""
SELECT doc_id, d.chars, d.digits, CAST(d.label <> p.prediction AS INTEGER) AS misclassified
FROM ({DOCUMENTS_SQL}) d JOIN ({PREDICTIONS_SQL}) p USING (doc_id)
""")
def misclassified(spark, folder):
    rows = labelled_documents(spark, folder).select("doc_id", "chars", "digits")
    return M.mark_misclassified(rows, rule_predictions(spark, folder), "doc_id")
