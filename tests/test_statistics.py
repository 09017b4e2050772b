"""Group statistics: edge cases, heavy groups, and agreement of the forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyrhythm.functions.numeric import magnitude_bucket, to_number
from keyrhythm.operators.profile import (
    ALL_STATS, Difference, Measure, observations, profile, profile_small_groups, wide_profile, widen,
)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def reference(values):
    x = np.asarray(values, dtype=float)
    m = x.mean()
    m2 = ((x - m) ** 2).mean()
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    return {
        "count": len(x), "mean": m, "median": q2, "amax": x.max(), "amin": x.min(),
        "var": x.var(ddof=1), "std": x.std(ddof=1), "iqr": q3 - q1,
        "skew": ((x - m) ** 3).mean() / m2 ** 1.5, "kurtosis": ((x - m) ** 4).mean() / m2 ** 2 - 3,
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_key_with_most_rows(spark, partitions):
    rng = np.random.default_rng(1)
    heavy = np.round(rng.lognormal(4.5, 0.7, 6000), 1).tolist()
    wide = (rng.normal(0, 1, 900) * 1e6).tolist()
    tight = (1000 + rng.normal(0, 1e-4, 500)).tolist()
    data = [("heavy", v) for v in heavy] + [("wide", v) for v in wide] + [("tight", v) for v in tight]
    df = spark.createDataFrame(data, "k string, value double").repartition(partitions)
    got = rows_of(profile(df, ["k"]), "k")
    for key, values in (("heavy", heavy), ("wide", wide), ("tight", tight)):
        for name, wanted in reference(values).items():
            assert got[(key,)][name] == pytest.approx(wanted, rel=1e-6, abs=1e-9), (key, name)


def test_forms_agree(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    obs = observations(events, "user_id", [Measure("v", "event_type", "value", ("click", "view"))])
    a = rows_of(profile(obs, ["user_id", "category"]), "user_id", "category")
    b = rows_of(profile_small_groups(obs, ["user_id", "category"]), "user_id", "category")
    assert a.keys() == b.keys()
    for key in a:
        for stat in ALL_STATS:
            assert a[key][stat] == pytest.approx(b[key][stat], rel=1e-9, abs=1e-9)


def test_single_row_and_no_spread(spark):
    df = spark.createDataFrame([("one", 5.0), ("flat", 0.1), ("flat", 0.1), ("flat", 0.1)], "k string, value double")
    got = rows_of(profile(df, ["k"]), "k")
    one, flat = got[("one",)], got[("flat",)]
    assert (one["mean"], one["median"], one["iqr"]) == (5.0, 5.0, 0.0)
    assert one["var"] is None and one["std"] is None and one["skew"] is None
    assert (flat["mean"], flat["var"], flat["std"]) == (0.1, 0.0, 0.0)
    assert flat["skew"] is None and flat["kurtosis"] is None
    zero = rows_of(profile(df, ["k"], degenerate="zero"), "k")[("flat",)]
    assert (zero["skew"], zero["kurtosis"]) == (0.0, -3.0)


def test_wide_row_keeps_missing_levels_null_and_needs_the_required_measure(spark):
    df = spark.createDataFrame(
        [("u", "L", 10.0, "LL", 1.0), ("u", "L", 20.0, "LR", 3.0), ("v", "X", 1.0, "LL", 2.0)],
        "user string, hand string, hold double, direction string, latency double",
    )
    measures = [Measure("hold", "hand", "hold", ("L", "R")), Measure("latency", "direction", "latency", ("LL", "LR"))]
    wide = wide_profile(df, "user", measures, ["mean", "amax"], [Difference("d", "latency", "LL", "LR")], "hold")
    assert wide.columns == ["user", "mean_L_hold", "mean_R_hold", "amax_L_hold", "amax_R_hold",
                            "mean_LL_latency", "mean_LR_latency", "amax_LL_latency", "amax_LR_latency", "d"]
    [row] = wide.collect()
    assert row["user"] == "u" and row["mean_L_hold"] == 15.0 and row["mean_R_hold"] is None and row["d"] == 2.0
    stats = profile(observations(df, "user", measures), ["user", "measure", "category"])
    assert widen(stats, "user", measures, ["mean"]).count() == 2
    both = wide_profile(df, "user", measures, ["amax"], [Difference("d", "latency", "LL", "LR")])
    assert [c for c in both.columns if c.startswith("mean_")] == [] and "d" in both.columns


def test_buckets_follow_the_order(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([
        rng.normal(0, 1, 500), rng.lognormal(0, 20, 500), 2.0 ** np.arange(-30, 40), np.nextafter(2.0 ** np.arange(-30, 40), 0),
        -(2.0 ** np.arange(-5, 5)), [0.0, -0.0, 1e300, 5e-324],
    ])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("b", magnitude_bucket("v", 4))
    rows = sorted((r["v"], r["b"]) for r in df.collect())
    buckets = [b for _, b in rows]
    assert all(b is not None for b in buckets) and buckets == sorted(buckets)
    assert all(b <= v for v, b in rows)


def test_number_text(spark):
    texts = ["0125.0", " 7 ", "-3.5e2", ".5", "5.", "1d", "1f", "LR", "1C", "0x1", "", "NaN", "1 2", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(to_number("t").alias("n")).collect()]
    assert got == [125.0, 7.0, -350.0, 0.5, 5.0] + [None] * 9


def test_row_order_and_layout_do_not_matter(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "user_id", F.col("event_type").alias("category"), "value"
    )
    plain = sorted(profile(events, ["user_id", "category"]).collect())
    mixed = sorted(profile(events.repartition(9).orderBy(F.rand(3)), ["user_id", "category"]).collect())
    for a, b in zip(plain, mixed):
        assert all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b))


def test_nan_is_a_missing_value(spark):
    data = [("a", "x", v) for v in (1.0, 2.0, 3.0, 4.0, float("nan"), None)]
    df = spark.createDataFrame(data, "k string, c string, value double")
    obs = observations(df, "k", [Measure("v", "c", "value", ("x",))])
    for rows in (obs, df):
        got = rows_of(profile(rows, ["k"]), "k")[("a",)]
        assert (got["count"], got["mean"], got["amax"], got["median"]) == (4, 2.5, 4.0, 2.5)
