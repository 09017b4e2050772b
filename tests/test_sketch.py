"""Sketched statistics: exact moments, quartiles within the stated rank error, states that merge, bounded stream state."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyrhythm.config import VARIANTS
from keyrhythm.operators import sketch
from keyrhythm.operators.profile import Measure, observations, profile
from keyrhythm.plans.features import statistics
from keyrhythm.streaming.jobs import start_window_states, windowed_profile

EXACT = ("count", "mean", "amax", "amin", "var", "std", "skew", "kurtosis")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(100, 30_000), rng.normal(1000, 1, 9_000), np.full(500, 7.0), [3.5]])
    group = np.concatenate([np.zeros(30_000), np.ones(9_000), np.full(500, 2), [3]]).astype(int)
    made = spark.createDataFrame([(int(g), i % 17, float(v)) for i, (g, v) in enumerate(zip(group, values))], "g int, part int, value double")
    return made.unionByName(spark.createDataFrame([(0, 1, None), (0, 2, float("nan")), (4, 0, None)], "g int, part int, value double")).persist()


@pytest.mark.parametrize("merged", [False, True])
@pytest.mark.parametrize("degenerate", ["null", "zero"])
def test_sketched_statistics(spark, rows, merged, degenerate):
    if merged:
        got = sketch.statistics(sketch.merged_states(sketch.states(rows, ["g", "part"]), ["g"]), ["g"], degenerate)
    else:
        got = sketch.profile_sketched(rows, ["g"], degenerate=degenerate)
    got = {r["g"]: r for r in got.collect()}
    wanted = {r["g"]: r for r in profile(rows, ["g"], degenerate=degenerate).collect()}
    assert set(got) == set(wanted) == {0, 1, 2, 3}
    for g, row in wanted.items():
        for name in EXACT:
            assert got[g][name] == (pytest.approx(row[name], rel=1e-7, abs=1e-9) if row[name] is not None else None), (g, name)
    values = {g: np.sort([r["value"] for r in rows.where(F.col("g") == g).collect() if r["value"] is not None and r["value"] == r["value"]]) for g in wanted}
    for g, held in values.items():
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            low, high = (np.searchsorted(held, got[g][name], side=s) / len(held) for s in ("left", "right"))
            assert low - 2 * sketch.rank_error() <= p <= high + 2 * sketch.rank_error(), (g, name)


def test_larger_sketches_are_nearer():
    assert sketch.rank_error(3200) < sketch.rank_error(800) < sketch.rank_error(200) < 0.02


def test_the_settings_choose_the_sketch(spark):
    from dataclasses import replace

    typed = spark.createDataFrame([("u", "L", "LL", float(i), float(i)) for i in range(1, 50)], "user_id string, Hand string, Direction string, `Hold time` double, `Latency time` double")
    exact, near = (statistics(typed, replace(VARIANTS["chosen"], exact=e)) for e in (True, False))
    assert exact.columns == near.columns
    assert "kll" not in exact._jdf.queryExecution().analyzed().toString().lower() and "kll" in near._jdf.queryExecution().analyzed().toString().lower()
    for a, b in zip(exact.orderBy("measure").collect(), near.orderBy("measure").collect()):
        assert abs(a["median"] - b["median"]) <= 1 and a["mean"] == b["mean"] and a["count"] == b["count"]


def test_stream_state_is_bounded_and_the_sink_is_whole(spark, tmp_path):
    """Forty hourly batches of two users: the state holds the open windows only, however long the stream is."""
    source = tmp_path / "in"
    for hour in range(40):
        batch = spark.createDataFrame([(u, 1_700_000_000 // 3600 * 3600 + hour * 3600 + i * 60, "x", float(hour * 100 + i + u)) for u in (1, 2) for i in range(60)],
                                      "user long, s long, kind string, value double")
        batch.select("user", F.timestamp_seconds("s").alias("ts"), "kind", "value").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    measure = Measure("value", "kind", "value", ("x",))
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = start_window_states(stream, "user", [measure], "ts", checkpoint, sink, "1 hour", "10 minutes")
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in json.loads(p.json)["stateOperators"]]
    assert len(held) >= 40 and max(held) <= 3 * 2
    last = spark.read.parquet(sink).agg(F.max("window_end")).first()[0]
    seen = spark.read.parquet(str(source)).where(F.col("ts") < F.lit(last))
    wanted = profile(observations(seen, "user", [measure]), ["user", "measure", "category"]).orderBy("user").collect()
    got = windowed_profile(spark, sink, "user").orderBy("user").collect()
    assert [r["count"] for r in got] == [r["count"] for r in wanted] and got[0]["count"] >= 38 * 60
    for a, b in zip(got, wanted):
        for name in EXACT:
            assert a[name] == pytest.approx(b[name], rel=1e-7), name
    hourly = windowed_profile(spark, sink, "user", by_window=True)
    assert hourly.count() == spark.read.parquet(sink).count() and hourly.where("count != 60").count() == 0
