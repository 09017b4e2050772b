"""Neighbours, votes, discriminants, boosting, elimination, metrics."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from keyrhythm.operators import metrics as M
from keyrhythm.operators.boosting import AdaBoost
from keyrhythm.operators.gaussian import QuadraticDiscriminant
from keyrhythm.operators.neighbours import (
    NearestNeighbours, ProjectionIndex, nearest_neighbours, neighbour_vote, neighbours_by_rings, neighbours_by_tiles,
)
from keyrhythm.operators.scaling import fit_scaling, unit_rows
from keyrhythm.operators.selection import recursive_elimination
from keyrhythm.operators.voting import Voting, majority
from keyrhythm.plans import classifiers as C
from keyrhythm.plans import evaluate as E


def brute_force(train, queries, k):
    """Indices of the k nearest training rows, nearest first, lower index first on a tie."""
    out = []
    for q in queries:
        away = ((train - q) ** 2).sum(axis=1)
        out.append(np.lexsort((np.arange(len(train)), away))[:k].tolist())
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 6, (5, 3))
    train = np.round(centres[rng.integers(0, 5, 400)] + rng.normal(0, 1, (400, 3)), 1)
    train[200:260] = train[0]  # a heap of copies
    queries = np.vstack([np.round(rng.normal(0, 6, (40, 3)), 1), train[:10]])
    return train, queries


@pytest.mark.parametrize("form", ["broadcast", "rings", "small blocks", "tiles", "small tiles"])
def test_neighbours_are_exact(spark, points, form):
    train, queries = points
    t = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(train)], "key bigint, label int, x array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "key bigint, x array<double>")
    if form == "broadcast":
        got = nearest_neighbours(t, q, 7)
    elif form == "rings":
        got = nearest_neighbours(t, q, 7, broadcast_bytes=0)
    elif form == "tiles":
        got = neighbours_by_tiles(t, q, 7, "key", "x", "label")
    elif form == "small tiles":
        got = neighbours_by_tiles(t.repartition(5), q, 7, "key", "x", "label", block_rows=11, query_rows=8)
    else:
        got = neighbours_by_rings(t, q, 7, "key", "x", "label", pivots=6, rings=4, block_rows=15, query_rows=9)
    rows = {r["key"]: [n["neighbour"] for n in r["neighbours"]] for r in got.collect()}
    assert [rows[i] for i in range(len(queries))] == brute_force(train, queries, 7)


@pytest.mark.parametrize("form", ["broadcast", "rings", "tiles"])
def test_keys_of_text(spark, points, form):
    train, queries = points
    t = spark.createDataFrame([(f"t{i:04d}", i % 3, x.tolist()) for i, x in enumerate(train)], "key string, label int, x array<double>")
    q = spark.createDataFrame([(f"q{i:04d}", x.tolist()) for i, x in enumerate(queries)], "key string, x array<double>")
    make = {"broadcast": nearest_neighbours, "rings": neighbours_by_rings, "tiles": neighbours_by_tiles}[form]
    got = make(t, q, 7, "key", "x", "label")
    rows = {r["key"]: [int(n["neighbour"][1:]) for n in r["neighbours"]] for r in got.collect()}
    assert [rows[f"q{i:04d}"] for i in range(len(queries))] == brute_force(train, queries, 7)


@pytest.mark.parametrize("clustered", [True, False])
def test_the_index_reaches_its_recall(spark, clustered):
    """Wide vectors, in clusters and without any structure, where many more buckets must be searched."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (30, 24)) if clustered else np.zeros((1, 24))
    train = centres[rng.integers(0, len(centres), 3000)] + rng.normal(0, 1, (3000, 24))
    queries = centres[rng.integers(0, len(centres), 400)] + rng.normal(0, 1, (400, 24))
    t = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(train)], "key bigint, label int, x array<double>").persist()
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "key bigint, x array<double>")
    index = ProjectionIndex(t, bucket_rows=50, block_rows=40).tune(q, 5, recall=0.93)
    found = {r["key"]: {n["neighbour"] for n in r["neighbours"] or []} for r in index.search(q, 5, query_rows=150).collect()}
    exact = brute_force(train, queries, 5)
    recall = sum(len(found[i] & set(exact[i])) for i in range(len(queries))) / (5 * len(queries))
    buckets = 2 ** index.planes.normals.shape[1]
    assert index.measured >= 0.93 and recall >= 0.9 and sum(index.counts.values()) == 3000
    assert buckets == 64 and index.probes < (32 if clustered else 64)
    index.probes = buckets
    whole = {r["key"]: [n["neighbour"] for n in r["neighbours"]] for r in index.search(q, 5).collect()}
    assert [whole[i] for i in range(len(queries))] == exact


def test_neighbours_of_many_classes(spark):
    rows = [(f"k{i}", float(i % 4), float(i % 4 * 10 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, label double, a double").select("key", "label", array_to_vector(F.array("a")).alias("features"))
    told = NearestNeighbours(5).fit(df).transform(df)
    assert told.where("label != prediction").count() == 0 and len(told.first()["probability"]) == 4


def test_fewer_points_than_k_and_vote_ties(spark):
    t = spark.createDataFrame([(0, 2, [0.0]), (1, 1, [1.0])], "key bigint, label int, x array<double>")
    q = spark.createDataFrame([(0, [0.1])], "key bigint, x array<double>")
    for limit in (10**9, 0):
        got = nearest_neighbours(t, q, 5, broadcast_bytes=limit).select(F.size("neighbours"), neighbour_vote(F.col("neighbours")))
        assert [tuple(r) for r in got.collect()] == [(2, 1)]


def test_majority(spark):
    df = spark.createDataFrame([([1, 0, 1],), ([2, 0, 1],), ([3, 3, 0, 0],)], "v array<int>")
    assert [r[0] for r in df.select(majority(F.col("v"))).collect()] == [1, 0, 0]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        label = i % 2
        x = rng.normal(0, 1 + label, 3) + np.array([2.0 * label, -label, 0.0])
        rows.append((i, label, *[float(v) for v in x]))
    return spark.createDataFrame(rows, "key bigint, label int, a double, b double, c double").coalesce(1).persist()


def features(df):
    return df.select("key", "label", array_to_vector(F.array("a", "b", "c")).alias("features"))


def test_discriminant_equals_the_formula(spark, blobs):
    rows = features(blobs)
    told = C.predictions(QuadraticDiscriminant().fit(rows), rows).orderBy("key").toPandas()
    data = blobs.orderBy("key").toPandas()
    x, y = data[["a", "b", "c"]].to_numpy(), data["label"].to_numpy()
    scores = []
    for c in (0, 1):
        s = np.cov(x[y == c].T)
        away = x - x[y == c].mean(axis=0)
        scores.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1]
                      - 0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(s), away))
    assert (told["prediction"].to_numpy() == np.argmax(scores, axis=0)).all()
    assert told["score"].to_numpy() == pytest.approx(1 / (1 + np.exp(scores[0] - scores[1])), abs=1e-9)


def test_singular_class_is_ridged(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), 1.0) for i in range(20)], "key bigint, label int, a double, b double")
    rows = df.select("key", "label", array_to_vector(F.array("a", "b")).alias("features"))
    told = C.predictions(QuadraticDiscriminant().fit(rows), rows)
    assert told.where("label != prediction").count() == 0


def test_boosting_beats_its_tree_and_stops(spark, blobs):
    rows = features(blobs)
    model = AdaBoost(rounds=8, maxDepth=1, settle_every=3).fit(rows)
    assert 1 < len(model.trees) <= 8
    boosted = M.accuracy(C.predictions(model, rows)).first()[0]
    stump = M.accuracy(C.predictions(AdaBoost(rounds=1, maxDepth=1).fit(rows), rows)).first()[0]
    assert boosted > stump
    assert len(AdaBoost(rounds=8, maxDepth=20).fit(rows).trees) == 1
    assert sum(model.featureImportances.toArray()) == pytest.approx(1.0)


def test_votes_of_models(spark, blobs):
    rows = features(blobs)
    members = {"tree": C.tree(3), "bayes": C.naive_bayes(), "lr": C.logistic(240)}
    hard = C.predictions(Voting(members, "hard").fit(rows), rows)
    soft = C.predictions(Voting(members, "soft").fit(rows), rows)
    assert hard.count() == soft.count() == 240
    assert M.accuracy(hard).first()[0] > 0.7 and M.accuracy(soft).first()[0] > 0.7


def test_margin_has_probabilities(spark, blobs):
    told = C.predictions(C.linear_margin(240).fit(features(blobs)), features(blobs)).toPandas()
    assert told["score"].between(0, 1).all()
    assert ((told["score"] > 0.5) == (told["prediction"] == 1)).mean() > 0.9


def test_elimination_ranks_are_nested(spark, blobs):
    noisy = blobs.withColumn("zero", F.lit(0.0))
    ranks = recursive_elimination(noisy, ["a", "b", "c", "zero"], "label", C.tree(4).fit)
    assert sorted(ranks.values()) == [1, 2, 3, 4] and ranks["zero"] == 4
    assert sorted(recursive_elimination(noisy, ["a", "b", "c", "zero"], "label", C.tree(4).fit, keep=2).values()) == [1, 1, 2, 3]


def test_report_of_models(spark, blobs):
    report = E.evaluate_models(blobs, ["a", "b", "c"], "label", "key", {"bayes": C.naive_bayes()}, folds=3)
    got = {r["metric"]: r["value"] for r in report.collect()}
    assert set(got) == {"accuracy", "precision", "recall", "f1", "auc", "average_precision", "cv_mean", "cv_std"}
    assert 0.7 < got["accuracy"] <= 1 and got["auc"] > 0.7


def test_every_classifier_fits(spark, blobs):
    rows = features(blobs)
    for name, model in C.line_up(240, 3, trees=4, rounds=4, depth=5, boosted_depth=3, perceptron_rounds=2).items():
        assert C.predictions(model.fit(rows), rows).where("prediction IS NOT NULL").count() == 240, name


def test_scaling(spark, blobs):
    flat = blobs.withColumn("flat", F.lit(3.0))
    out = fit_scaling(flat, ["a", "flat"]).apply(flat)
    row = out.agg(F.avg("a"), F.stddev_pop("a"), F.max("flat"), F.min("flat")).first()
    assert tuple(row) == pytest.approx((0.0, 1.0, 0.0, 0.0), abs=1e-9)
    zero = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double")
    assert sorted(map(tuple, unit_rows(zero, ["a", "b"]).collect())) == [(0.0, 0.0), (0.6, 0.8)]


PREDICTIONS = [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (0, 0, 0.4), (0, 0, 0.0)]


def predicted(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PREDICTIONS)], "key int, label int, prediction int, score double")


def test_metrics_by_hand(spark):
    df = predicted(spark)
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion(df).collect()}
    assert cells == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    one = M.per_class(df).where("class = 1").first()
    assert (one["precision"], one["recall"], one["support"]) == pytest.approx((2 / 3, 2 / 3, 3))
    pairs = [(1 if a > b else 0.5 if a == b else 0) for la, _, a in PREDICTIONS if la for lb, _, b in PREDICTIONS if not lb]
    assert M.ranking_scores(df).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_auc_of_hard_answers(spark):
    df = predicted(spark).withColumn("score", F.col("prediction").cast("double"))
    got = M.ranking_scores(df).first()
    assert got["auc"] == pytest.approx((2 / 3 + 3 / 4) / 2)
    precision, recall, prevalence = 2 / 3, 2 / 3, 3 / 7
    assert got["average_precision"] == pytest.approx(precision * recall + (1 - recall) * prevalence)


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (2, 0, 0.2)], "label int, prediction int, score double")
    rows = {r["class"]: r for r in M.per_class(df).collect()}
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["f1"]) == (0.0, 0.0, 0.0)
    assert M.confusion(df).count() == 4


def test_fits_share_a_pool_and_keep_their_order(spark, blobs):
    rows = features(blobs)
    models = {"bayes": C.naive_bayes(), "tree": C.tree(3), "discriminant": QuadraticDiscriminant()}
    done = E.fitted([(m, rows) for m in models.values()], at_once=3)
    assert [type(m).__name__ for m in done] == ["NaiveBayesModel", "DecisionTreeClassificationModel", "QuadraticDiscriminantModel"]
    assert E.fitted([]) == []


def test_test_and_score_averages_over_the_classes(spark):
    rng = np.random.default_rng(2)
    made = [(i, float(i % 3), float(rng.normal(i % 3)), float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame(made, "key long, label double, a double, b double").select("key", "label", array_to_vector(F.array("a", "b")).alias("features"))
    report = E.test_and_score(df, {"bayes": C.naive_bayes()}, folds=3)
    got = {(r["fold"], r["metric"]): r["value"] for r in report.collect()}
    assert len(got) == 15 and all(0.3 < v <= 1 for v in got.values())
    split = E.stratified_folds(df, "key", "label", 3).persist()
    for fold in range(3):
        model = C.naive_bayes().fit(split.where(F.col("fold") != fold))
        told = model.transform(split.where(F.col("fold") == fold)).toPandas()
        scores = np.stack(told["probability"].apply(lambda v: v.toArray()).to_numpy())
        areas = []
        for c in range(3):
            own, other = scores[told["label"] == c, c], scores[told["label"] != c, c]
            areas.append(((own[:, None] > other[None]) + 0.5 * (own[:, None] == other[None])).mean())
        assert got[fold, "auc"] == pytest.approx(np.mean(areas), abs=1e-9)
        assert got[fold, "accuracy"] == pytest.approx((told["label"] == told["prediction"]).mean())


def test_sweep_tells_the_best_so_far(spark, blobs):
    out = E.sweep(blobs, ["a", "b", "c"], [3, 2, 1], "label", "key", {"bayes": C.naive_bayes(), "tree": C.tree(2)}, folds=3).orderBy("step").collect()
    assert [(r["step"], r["features"], r["model"]) for r in out] == [(i, 3 - i // 2, ("bayes", "tree")[i % 2]) for i in range(6)]
    for name in ("bayes", "tree"):
        own = [r for r in out if r["model"] == name]
        assert [r["best"] for r in own] == [max(r["accuracy"] for r in own[: i + 1]) for i in range(3)]
    assert all(0.5 < r["cv_accuracy"] <= 1 for r in out)


def test_narrow_points_are_searched_by_leaves(spark):
    """The same neighbours as by brute force, from a small part of the points; equal vectors leave their k smallest keys."""
    import pyarrow as pa

    from keyrhythm.operators import neighbours as N

    rng = np.random.default_rng(0)
    for width, step in ((2, 1.0), (3, 0.0)):
        x = rng.normal(size=(6000, width)) * 3
        x = np.floor(x / step) if step else x
        held = N.Points(pa.table({"key": np.arange(len(x)), "label": np.zeros(len(x), np.int32), "x": pa.array(list(x))}), "key", "label", "x")
        asked = np.concatenate([x[:150], rng.normal(size=(50, width)) * 9])
        got = held.lists(asked, 5).to_pylist()
        for row, at, squared in N.k_smallest(asked, x, 5):
            assert [n["neighbour"] for n in got[row]] == list(at) and [n["distance"] for n in got[row]] == list(np.sqrt(squared))
        assert held.boxes is not None and max(len(m) for m in held.boxes[0]) <= N.LEAF
    rows = spark.range(1000).selectExpr("id AS key", "array(CAST(id % 7 AS DOUBLE), 0D) AS x", "CAST(id % 2 AS INT) AS label")
    assert sorted(r.key for r in N.fewest(rows, 3, "key", "x").collect()) == list(range(21))


def test_index_recall_asks_every_hundredth_row_of_all(spark, tmp_path, monkeypatch):
    from keyrhythm.catalog import models

    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 16))[rng.integers(0, 9, 700)] + 0.1 * rng.normal(size=(700, 16))
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(700)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    exact, seen = models.nearest_neighbours, []

    def told(train, queries, k, key, *names):
        found = exact(train, queries, k, key, *names)
        seen.append((train.count(), sorted((r["vec_id"], tuple(r["near"])) for r in found.select(key, models.others(key, 5).alias("near")).collect())))
        return found

    monkeypatch.setattr(models, "nearest_neighbours", told)
    got = models.knn_index_recall(spark, str(tmp_path)).first()
    x = x.astype(np.float32).astype(float)
    near = {i: tuple(j for j in np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable") if j != i)[:5] for i in range(0, 700, 100)}
    assert seen == [(700, sorted(near.items()))]
    # All seven queries are in the tuning sample, so its recall is the one that is found, itself not counted.
    assert got["recall"] == got["tuned"] >= 0.9
