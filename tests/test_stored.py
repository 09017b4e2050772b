"""Own estimators and models written and read again, alone and in pipelines; what they tell stays the same."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from keyrhythm.operators.boosting import AdaBoost, AdaBoostModel, Tree, cut_points
from keyrhythm.operators.gaussian import QuadraticDiscriminant
from keyrhythm.operators.neighbours import NearestNeighbours
from keyrhythm.operators.voting import Voting
from keyrhythm.plans import classifiers as C
from keyrhythm.plans.classifiers import LinearMargin

COLUMNS = ["a", "b", "c"]
MAKERS = {
    "adaboost": lambda: AdaBoost(rounds=5, maxDepth=2, settle_every=2),
    "discriminant": lambda: QuadraticDiscriminant(),
    "neighbours": lambda: NearestNeighbours(3),
    "hard": lambda: Voting({"tree": C.tree(3), "discriminant": QuadraticDiscriminant(), "bayes": C.naive_bayes()}, "hard"),
    "soft": lambda: Voting({"boosted": AdaBoost(rounds=2), "nested": Voting({"bayes": C.naive_bayes()}, "soft")}, "soft"),
    "margin": lambda: LinearMargin(regParam=0.01, maxIter=20),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    made = []
    for i in range(240):
        label = i % 2
        x = rng.normal(0, 1 + label, 3) + np.array([2.0 * label, -label, 0.0])
        made.append((i, float(label), *[float(v) for v in x]))
    return spark.createDataFrame(made, "key bigint, label double, a double, b double, c double").coalesce(1).persist()


def pipeline(name):
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), MAKERS[name]()])


def told(model, rows):
    return [tuple(r) for r in C.predictions(model, rows).orderBy("key").collect()]


@pytest.mark.parametrize("name", MAKERS)
def test_a_reloaded_pipeline_tells_the_same(spark, rows, tmp_path, name):
    model = pipeline(name).fit(rows)
    before = told(model, rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.uid == model.uid and loaded.stages[1].uid == model.stages[1].uid
    after = told(loaded, rows)
    assert [r[:3] for r in after] == [r[:3] for r in before]
    assert [r[3] for r in after] == pytest.approx([r[3] for r in before], abs=1e-9)
    assert 0 < sum(r[2] for r in before) < len(before)


@pytest.mark.parametrize("name", ["adaboost", "neighbours", "soft", "margin"])
def test_a_reloaded_estimator_fits_the_same(spark, rows, tmp_path, name):
    made = pipeline(name)
    made.write().save(str(tmp_path / "estimator"))
    again = Pipeline.load(str(tmp_path / "estimator"))
    assert again.getStages()[1].plain() == made.getStages()[1].plain()
    assert told(again.fit(rows), rows) == told(made.fit(rows), rows)


def test_a_wrong_class_is_refused(spark, rows, tmp_path):
    model = pipeline("discriminant").fit(rows).stages[1]
    model.write().save(str(tmp_path / "model"))
    with pytest.raises(AssertionError):
        AdaBoostModel.load(str(tmp_path / "model"))


def test_boosting_equals_a_direct_computation(spark, rows):
    """The rounds' weights and trees, against numpy on all rows at once."""
    data = rows.orderBy("key").toPandas()
    x, y = data[COLUMNS].to_numpy(), data["label"].to_numpy().astype(int)
    model = pipeline("adaboost").fit(rows).stages[1]
    cuts = cut_points(rows.select(F.array(*COLUMNS).alias("x")), "x", 64)
    weights = np.full(len(y), 1.0 / len(y))
    for tree in model.trees:
        best = min(
            (round(1 - sum(w[y[s] == c].sum() ** 2 / w.sum() for s, w in ((x[:, j] <= t, weights[x[:, j] <= t]), (x[:, j] > t, weights[x[:, j] > t])) for c in (0, 1)), 12), j, t)
            for j in range(3) for t in cuts[j] if (x[:, j] <= t).any() and (x[:, j] > t).any())
        assert (tree.feature[0], tree.cut[0]) == best[1:]
        leaf = tree.leaves(x)
        for node in np.unique(leaf):
            own = weights[leaf == node]
            share = np.array([own[y[leaf == node] == c].sum() for c in (0, 1)]) / own.sum()
            assert np.exp(tree.logs[node]) == pytest.approx(share, abs=1e-9)
        logs = tree.logs[leaf]
        weights *= np.exp(-0.5 * 0.5 * (logs[np.arange(len(y)), y] - logs[np.arange(len(y)), 1 - y]))
        weights /= weights.sum()


def test_boosting_with_several_classes_missing_features_and_many_rounds(spark):
    rng = np.random.default_rng(3)
    made = [(i, float(i % 3), float(rng.normal(i % 3, 0.7)) if i % 11 else float("nan"), float(i % 3 == 2)) for i in range(300)]
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(
        spark.createDataFrame(made, "key long, label double, a double, b double"))
    model = AdaBoost(rounds=60, maxDepth=1, settle_every=7).fit(rows)
    assert 7 < len(model.trees) <= 60 and len(model.transform(rows).first()["probability"]) == 3
    hits = model.transform(rows).where("label = prediction").count()
    assert hits > 0.8 * 300
    # However many rounds, prediction is one function over the rows.
    plan = model.transform(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_deep_trees_stop_when_no_row_is_wrong(spark, rows):
    model = AdaBoost(rounds=8, maxDepth=20, most_cells=2000).fit(VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows))
    assert len(model.trees) == 1 and told(model, VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)) != []


def test_tree_walk():
    tree = Tree(np.array([0, -1, 1, -1, -1]), np.array([1.0, 0, 5.0, 0, 0]), np.zeros(5), np.array([1, -1, 3, -1, -1]), np.zeros((5, 2)))
    assert tree.leaves(np.array([[1.0, 9], [2.0, 5], [2.0, 6]])).tolist() == [1, 3, 4]


def test_margin_probabilities_are_calibrated_on_unseen_rows(spark):
    """Many useless features: a curve fitted on the training margins is far too sure, the held-out one is not."""
    rng = np.random.default_rng(11)
    names = [f"x{i}" for i in range(40)]

    def make(n, seed):
        local = np.random.default_rng(seed)
        x = local.normal(size=(n, 40))
        y = (x[:, 0] + local.normal(size=n) * 2 > 0).astype(float)
        return spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], "key long, label double, " + ", ".join(f"{c} double" for c in names))

    train, test = (VectorAssembler(inputCols=names, outputCol="features").transform(make(n, s)) for n, s in ((160, 1), (1500, 2)))
    model = LinearMargin(regParam=1e-4, maxIter=50).fit(train)

    def log_loss(m):
        rows = C.predictions(m, test).select("label", "score").toPandas()
        p = np.clip(rows["score"], 1e-12, 1 - 1e-12)
        return -np.where(rows["label"] == 1, np.log(p), np.log(1 - p)).mean()

    from pyspark.ml.classification import LogisticRegression

    seen = model.machine.transform(train).drop("prediction")
    sure = LogisticRegression(featuresCol="rawPrediction", rawPredictionCol="_raw", regParam=1e-6).fit(seen)
    naive = type(model)(model.machine, sure)
    assert log_loss(model) < log_loss(naive) and log_loss(model) < np.log(2) + 0.05
    del rng
