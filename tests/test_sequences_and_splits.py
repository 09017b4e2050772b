"""Chunked lags, key events, running totals, splits and folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keyrhythm.functions.keys import hand_of
from keyrhythm.functions.numeric import magnitude_bucket
from keyrhythm.operators.prefix import positions, running_totals
from keyrhythm.operators.sequence import keystrokes_from_key_events, latencies, with_previous
from keyrhythm.operators.ranges import with_range
from keyrhythm.operators.splits import contiguous_folds, stratified_folds, stratified_split

START = dt.datetime(2024, 1, 1, 10, 0, 0)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def test_previous_row_crosses_chunks_and_gaps(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 40 * 3600_000), 300))
    data = [("heavy", i, at(t)) for i, t in enumerate(times)] + [("one", 0, at(5))]
    df = spark.createDataFrame(data, "user string, seq int, ts timestamp")
    got = with_previous(df, "user", ["ts", "seq"], ["seq"], F.date_trunc("hour", "ts"), position="place")
    rows = {(r["user"], r["seq"]): r for r in got.collect()}
    assert len(rows) == 301 and rows[("one", 0)]["previous"] is None
    for i in range(300):
        row = rows[("heavy", i)]
        assert row["place"] == i + 1
        assert (row["previous"] and row["previous"]["seq"]) == (i - 1 if i else None)


def test_pairs(spark):
    data = [("u", i, at(100 * i), "LRLS"[i]) for i in range(4)]
    df = spark.createDataFrame(data, "user string, seq int, ts timestamp, hand string")
    def run(pairs):
        out = latencies(df, "user", "ts", "hand", ["ts", "seq"], F.date_trunc("hour", "ts"), pairs)
        return [(r["seq"], r["direction"], r["latency_ms"]) for r in out.orderBy("seq").collect()]
    assert run("sliding") == [(1, "LR", 100.0), (2, "RL", 100.0), (3, "LS", 100.0)]
    assert run("disjoint") == [(1, "LR", 100.0), (3, "LS", 100.0)]


# F (left), J (right) with a second key pressed while it is down, space, an unknown key.
KEYS = [(0, 70, "down"), (80, 70, "up"), (200, 74, "down"), (220, 70, "down"), (300, 74, "up"), (310, 70, "up"),
        (500, 32, "down"), (560, 32, "up"), (700, 255, "down"), (750, 255, "up")]


def keystrokes(spark, keys=KEYS, **options):
    df = spark.createDataFrame([("u", at(t), i, c, a) for i, (t, c, a) in enumerate(keys)],
                               "user_id string, ts timestamp, seq int, key_code int, action string")
    rows = keystrokes_from_key_events(df, **options).orderBy("ts").collect()
    return [(r["Hand"], r["Hold time"], r["Direction"], r["Latency time"], r["Flight time"]) for r in rows]


def test_key_events(spark):
    assert keystrokes(spark) == [
        ("R", 100.0, "LR", 200.0, 120.0), ("S", 60.0, "RS", 300.0, 190.0), (None, 50.0, None, 200.0, 140.0),
    ]
    assert keystrokes(spark, side="previous")[0] == ("L", 80.0, "LR", 200.0, 120.0)
    assert keystrokes(spark, side="previous")[1] == ("R", None, "RS", 300.0, 190.0)
    assert len(keystrokes(spark, pairs="disjoint")) == 2
    assert keystrokes(spark, side="previous", unknown="typed")[2] == ("S", 60.0, "SL", 200.0, 140.0)


def test_flight_runs_from_the_last_key_up(spark):
    keys = [(0, 65, "down"), (50, 66, "down"), (100, 65, "up"), (140, 66, "up"), (300, 75, "down"), (310, 75, "up")]
    assert keystrokes(spark, keys) == [("R", 10.0, "LR", 300.0, 160.0)]
    assert keystrokes(spark, keys, side="previous") == [("L", None, "LR", 300.0, 160.0)]


def test_hold_runs_from_the_first_accepted_down(spark):
    # B is released without an accepted down, so A counts again; its one up ends both downs.
    keys = [(0, 65, "down"), (10, 66, "down"), (20, 66, "up"), (30, 65, "down"), (90, 65, "up"), (100, 75, "down")]
    assert keystrokes(spark, keys, side="previous") == [
        ("L", None, "LL", 30.0, 10.0), ("L", 90.0, "LR", 70.0, 10.0),
    ]


def test_unknown_keys_at_the_start_and_over_hours(spark):
    hour = 3600_000
    keys = [(t + d, c, a) for t, c in ((0, 255), (hour, 74), (2 * hour, 255), (4 * hour, 65)) for d, a in ((0, "down"), (50, "up"))]
    rows = keystrokes(spark, keys, side="previous", unknown="typed")
    assert [(r[0], r[2]) for r in rows] == [("L", "LR"), ("R", "RL"), ("R", "RL")]


def test_hands(spark):
    df = spark.createDataFrame([(65,), (74,), (32,), (255,)], "c int")
    assert [r[0] for r in df.select(hand_of("c")).collect()] == ["L", "R", "S", None]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(5)
    data = [(g, v, rng.randint(0, 9)) for g, n in (("heavy", 500), ("small", 3)) for v in rng.sample(range(-2000, 2000), n)]
    df = spark.createDataFrame(data, "g string, v int, w int")
    got = running_totals(df, ["g"], ["v"], magnitude_bucket("v", 3), {"w_run": F.col("w")}, descending)
    rows = {(r["g"], r["v"]): (r["w_run"], r["w_run_total"]) for r in got.collect()}
    assert len(rows) == len(data)
    for group in ("heavy", "small"):
        total = 0
        own = sorted([d for d in data if d[0] == group], key=lambda d: d[1], reverse=descending)
        for _, v, w in own:
            total += w
            assert rows[(group, v)] == (total, sum(d[2] for d in own))


def test_positions_over_the_whole_table(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 7 - 300)
    got = positions(df, [], ["id"], magnitude_bucket("id", 4)).orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(1, 1001)) and {r["size"] for r in got} == {1000}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_contiguous_folds(spark, kind):
    df = spark.range(103).select(F.format_string("user%05d", "id").alias("key") if kind == "string" else F.col("id").alias("key"))
    folds = [r["fold"] for r in contiguous_folds(df, "key", 10).orderBy("key").collect()]
    assert folds == sorted(folds)
    assert [folds.count(i) for i in range(10)] == [11, 11, 11] + [10] * 7


def test_more_folds_than_rows(spark):
    folds = [r["fold"] for r in contiguous_folds(spark.range(3).withColumnRenamed("id", "key"), "key", 5).orderBy("key").collect()]
    assert folds == [0, 1, 2]


def test_stratified(spark):
    df = spark.range(200).select(F.col("id").alias("key"), F.when(F.col("id") < 30, 1).when(F.col("id") == 199, 2).otherwise(0).alias("label"))
    split = stratified_split(df, "key", "label", 0.4, 0)
    parts = {r["label"]: (r["n"], r["t"]) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()}
    assert parts == {0: (169, 68), 1: (30, 12), 2: (1, 0)}
    again = stratified_split(df.repartition(5), "key", "label", 0.4, 0)
    assert sorted(split.collect()) == sorted(again.select(split.columns).collect())
    other = stratified_split(df, "key", "label", 0.4, 1)
    assert sorted(split.collect()) != sorted(other.collect())
    folds = stratified_folds(df, "key", "label", 5).groupBy("label", "fold").count().collect()
    ones = [r["count"] for r in folds if r["label"] == 1]
    assert ones == [6] * 5


@pytest.mark.parametrize("key", ["user_{:014d}", 1_700_000_000_000, "2024"])
def test_ranges_follow_any_key(spark, key):
    """Long common prefixes, large numbers and dates are spread alike; NULL keys stay."""
    number = F.col("id")
    value = F.concat(F.lit("user_"), F.lpad(number.cast("string"), 14, "0")) if key == "user_{:014d}" else (
        number + F.lit(key) if isinstance(key, int) else F.date_add(F.lit(dt.date(2024, 1, 1)), number.cast("int")))
    df = spark.range(20_000).select(value.alias("key"), (number % 3).alias("label"))
    df = df.unionByName(spark.range(2).select(F.lit(None).cast(df.schema["key"].dataType).alias("key"), F.lit(None).cast("bigint").alias("label")))
    sizes = with_range(df, "b", ["key"]).groupBy("b").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    sizes = sizes.orderBy("b").collect()
    assert len(sizes) > 100 and max(r["n"] for r in sizes) < 600 and [r["b"] for r in sizes if r["lo"] is None] == [None]
    assert all(a["hi"] < b["lo"] for a, b in zip(sizes[1:], sizes[2:]))
    assert contiguous_folds(df, "key", 10).groupBy("fold").count().agg(F.sum("count"), F.max("count")).first()[:] == (20_002, 2001)
    assert stratified_folds(df, "key", "label", 5).count() == 20_002
    assert stratified_split(df.where("key IS NOT NULL"), "key", "label").count() == 20_000


def spread(ranged, name="b"):
    """Ranges that hold rows, and the share of the largest."""
    sizes = [r["count"] for r in ranged.groupBy(name).count().collect()]
    return len(sizes), max(sizes) / sum(sizes)


def test_close_values_and_scores_are_spread(spark):
    close = spark.range(100_000).select((F.lit(1000.0) + F.col("id") * 31.0 / 100_000).alias("v"), F.lit(1).alias("g"))
    scores = spark.range(100_000).select((F.lit(0.5) + (F.col("id") - 50_000) * 1e-12).alias("v"), F.lit(1).alias("g"))
    for rows in (close, scores):
        ranges, largest = spread(with_range(rows, "b", ["v"], ["g", "v"]))
        assert ranges >= 32 and largest <= 1 / 32


def test_a_heavy_user_and_a_heavy_instant_are_spread(spark):
    n = F.col("id")
    # One user has a third of the rows, half of them at the same instant; the others are spread over a year.
    heavy = n % 3 == 0
    ts = F.when(heavy & (n % 2 == 0), F.lit(1_700_000_000)).when(heavy, F.lit(1_700_000_000) + n % 60).otherwise(F.lit(1_700_000_000) + n * 97 % 31_536_000)
    rows = spark.range(90_000).select(F.when(heavy, F.lit(0)).otherwise(n % 500 + 1).alias("user"), F.timestamp_seconds(ts).alias("ts"), n.alias("seq"))
    ranged = with_range(rows, "b", ["ts", "seq"], ["user", "ts", "seq"])
    ranges, largest = spread(ranged.where("user = 0"))
    assert ranges >= 32 and largest <= 1 / 16
    orders = ranged.groupBy("b").agg(F.min(F.struct("ts", "seq")).alias("lo"), F.max(F.struct("ts", "seq")).alias("hi")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(orders, orders[1:]))
    got = with_previous(rows, "user", ["ts", "seq"], ["seq"], position="place").where("user = 0").select("place", "seq", "previous.seq").orderBy("place").collect()
    wanted = [r["seq"] for r in rows.where("user = 0").orderBy("ts", "seq").collect()]
    assert [r[1] for r in got] == wanted and [r[2] for r in got] == [None, *wanted[:-1]] and [r[0] for r in got] == list(range(1, 30_001))


def test_ranges_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "v double")
    assert with_range(none, "b", ["v"]).count() == 0
    same = spark.createDataFrame([(2.0,)] * 5 + [(None,)], "v double")
    assert {(r["v"], r["b"] is None) for r in with_range(same, "b", ["v"]).collect()} == {(2.0, False), (None, True)}


def test_range_search_is_compiled(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(None if i % 41 == 0 else float(rng.randrange(40)), i) for i in range(400)], "v double, i int")
    ranged = with_range(rows, "b", ["v", "i"], parts=7)
    assert "aggregate(" not in ranged._jdf.queryExecution().optimizedPlan().toString()
    told = sorted((r["v"], r["i"], r["b"]) for r in ranged.where("v IS NOT NULL").collect())
    # 400 rows are all in the sample, so the borders are the rows' own.
    borders = [told[len(told) * i // 7][:2] for i in range(1, 7)]
    assert [b for _, _, b in told] == [sum(x <= (v, i) for x in borders) for v, i, _ in told]
    assert ranged.where("v IS NULL AND b IS NOT NULL").count() == 0 and ranged.columns == ["v", "i", "b"]
