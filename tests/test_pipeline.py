"""Raw files to feature tables, sessions, and streams, on made-up text of the raw shapes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyrhythm.config import CHOSEN_FEATURES, VARIANTS, FeatureConfig, model_columns
from keyrhythm.functions.encode import one_hot
from keyrhythm.operators.filters import inside, keep_large_groups, semi_join_spread
from keyrhythm.operators.impute import handle_missing, negatives_to_mean
from keyrhythm.operators.profile import Measure, observations, profile
from keyrhythm.plans.classifiers import tree
from keyrhythm.plans.features import class_counts, feature_tables
from keyrhythm.plans.scoring import explode_sessions, score_sessions, session_features, session_statistics
from keyrhythm.sources.files import (
    read_keystrokes, read_profiles, read_sessions, sessions_from_posts, typed_keystrokes, write_table,
)
from keyrhythm.sources.models import fit_pipeline, load_pipeline, save_model
from keyrhythm.streaming.jobs import (
    running_profile, session_stream, start_running_counts, start_session_scoring, table_stream,
)

DIRECTIONS = ["LL", "LR", "LS", "RL", "RR", "RS", "SL", "SR", "SS"]


def user(i):
    return f"USER{i:06d}"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Twelve users; 0-3 diagnosed and mild, 4-7 neither diagnosed nor treated, the rest outside the
    cohort; user 3 has too few keystrokes, user 7 no profile, user 11 no log."""
    root = tmp_path_factory.mktemp("raw")
    (root / "users").mkdir()
    (root / "data").mkdir()
    rng = random.Random(8)
    for i in range(12):
        diagnosed, impact = (i < 4 or i >= 10), "Mild" if i < 4 else "Severe" if i >= 10 else "------"
        lines = [
            f"BirthYear: {1950 + i if i else ''}", f"Gender: {'Male' if i % 2 else 'Female'}", f"Parkinsons: {diagnosed}",
            f"Tremors: {i % 3 == 0}", "DiagnosisYear: ------", f"Sided: {['None', 'Left', 'Right'][i % 3]}",
            "UPDRS: Don't know", f"Impact: {impact}", f"Levadopa: {i in (8, 9)}", "DA: False", "MAOB: False", "Other: False",
        ]
        if i != 7:
            (root / "users" / f"User_{user(i)}.txt").write_bytes(("\r\n".join(lines) + "\r\n").encode())
        if i == 11:
            continue
        for month in ("1608", "1609"):
            rows = []
            for _ in range(4 if i == 3 else 60):
                d = rng.choice(DIRECTIONS)
                hold, latency = rng.randint(1, 2500) / 10, rng.randint(1, 30000) / 10
                rows.append([user(i), "160801", "10:00:00.000", d[1], f"{hold:06.1f}", d, f"{latency:06.1f}", "0100.0", ""])
            rows[0][4], rows[1][6] = "0000.0", "2000.0"
            rows[2][4:7] = ["LR", "0100.0", "1C"]
            (root / "data" / f"{user(i)}_{month}.txt").write_bytes(("".join("\t".join(r) + "\r\n" for r in rows)).encode())
    return root


def test_profiles(spark, raw):
    rows = {r["user_id"]: r for r in read_profiles(spark, str(raw / "users")).collect()}
    assert len(rows) == 11
    assert rows[user(0)]["BirthYear"] == "" and rows[user(0)]["UPDRS"] == "Don't know"
    assert rows[user(1)]["Gender"] == "Male" and rows[user(5)]["Impact"] == "------" and rows[user(1)]["Other"] == "False"


def test_keystrokes(spark, raw):
    rows = read_keystrokes(spark, str(raw / "data"))
    assert rows.count() == 10 * 120 + 8
    assert rows.where("file_id != user_id").count() == 0
    bad = typed_keystrokes(rows).where("`Hold time` IS NULL")
    assert bad.count() == 22 and bad.where("`Latency time` IS NULL").count() == 22


@pytest.mark.parametrize("name,width", [("three_second", 63), ("chosen", 64), ("wide", 109), ("lean", 54)])
def test_feature_tables(spark, raw, name, width):
    config = VARIANTS[name].with_rows_more_than(50)
    tables = feature_tables(read_profiles(spark, str(raw / "users")), read_keystrokes(spark, str(raw / "data")), config)
    both = tables["both"]
    assert len(both.columns) == width and both.columns[0] == "Parkinsons"
    assert set(model_columns(name)) <= set(both.columns)
    assert set(model_columns(name, "hold")) <= set(tables["hold"].columns)
    assert set(model_columns(name, "latency")) <= set(tables["latency"].columns)
    if name in ("chosen", "lean"):
        return
    both = both.persist()
    assert {r["Parkinsons"]: r["n"] for r in class_counts(both).collect()} == {1: 3, 0: 3}
    rows = read_keystrokes(spark, str(raw / "data")).toPandas()
    rows = rows[rows["user_id"] == user(0)]
    hold = rows["Hold time"].where(~rows["Hold time"].isin(["LR"])).astype(float)
    latency = rows["Latency time"].where(rows["Latency time"] != "1C").astype(float)
    ok = (hold > 0) & (latency > 0) & (hold < config.upper) & (latency < config.upper)
    left = hold[ok & (rows["Hand"] == "L")]
    got = {round(r["mean_L_hold_time"], 6) for r in both.collect()}
    assert round(left.mean(), 6) in got


def test_widths_of_model_inputs():
    lengths = {(n, t): len(model_columns(n, t)) for n in VARIANTS for t in ("both", "hold", "latency")}
    assert lengths[("three_second", "both")] == 61 and lengths[("three_second", "hold")] == 10
    assert lengths[("three_second", "latency")] == 22 and lengths[("chosen", "both")] == 60
    assert lengths[("wide", "hold")] == 34 and lengths[("wide", "latency")] == 78
    assert lengths[("lean", "latency")] == 32 and lengths[("lean", "both")] == 53


def test_strict_bounds(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2000.0, 1.0), (1.0, None), (0.1, 1999.9)], "a double, b double")
    assert df.where(inside(["a", "b"], 2000.0)).count() == 1


def test_missing_rules(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "k int, a double, b double")
    assert handle_missing(df, ["a", "b"], "drop").count() == 1
    assert handle_missing(df, ["a", "b"], "zero").where("k = 1").first()["b"] == 0.0
    assert handle_missing(df, ["a", "b"], "mean").where("k = 1").first()["b"] == 4.0
    assert handle_missing(df, ["a", "b"], "keep").where("b IS NULL").count() == 1
    with pytest.raises(Exception, match="missing value in b"):
        handle_missing(df, ["a", "b"], "error").collect()


def test_negatives(spark):
    df = spark.createDataFrame([(-3.0,), (1.0,), (5.0,)], "a double")
    assert sorted(r[0] for r in negatives_to_mean(df, "a").collect()) == [1.0, 1.0, 5.0]


def test_heavy_key_in_semi_join_and_group_rule(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"))
    keys = spark.createDataFrame([(1,), (4,), (-9,)], "key bigint")
    assert semi_join_spread(df, keys, "key").count() == 669
    assert keep_large_groups(df, "key", 1).count() == 668
    assert keep_large_groups(df, "key", 668).count() == 0


def test_semi_join_repeats_no_key(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"))
    out = semi_join_spread(df, spark.createDataFrame([(1,), (4,), (-9,)], "key bigint"), "key")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    # By a shuffle, without a broadcast, the rows are the same.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert out.count() == 669
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_levels_are_fixed_or_observed(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    assert one_hot(df, "c").columns == ["k", "c_a", "c_b"]
    assert one_hot(df, "c", ["b", "z"]).orderBy("k").collect()[0].asDict() == {"k": 1, "c_b": 1, "c_z": 0}


def session(i, rng, n=60):
    keys = []
    for _ in range(n):
        d = rng.choice(DIRECTIONS)
        keys.append({"Hand": d[1], "Hold time": rng.randint(-5, 2200) / 10 if i % 2 else rng.randint(1, 900) / 10,
                     "Direction": d, "Latency time": rng.randint(0, 2600), "Flight time": 5})
    return {"session_id": str(i), "keys": keys,
            "profile": {"Gender": "Male", "Tremors": "Yes" if i % 2 else "No", "Sided": ["None", "Left", "Right"][i % 3]}}


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inbox")
    rng = random.Random(9)
    made = [session(i, rng, 0 if i == 13 else 60) for i in range(14)]
    for part in range(2):
        text = "\n".join(json.dumps(s) for s in made[part * 7:(part + 1) * 7])
        (folder / f"part{part}.json").write_text(text + "\n")
    return folder, made


def test_session_rows_equal_grouped_statistics(spark, inbox):
    sessions = read_sessions(spark, str(inbox[0]))
    config = FeatureConfig(stats=("mean", "median", "amax", "amin", "var", "std", "iqr", "skew", "kurtosis"))
    wide = {r["session_id"]: r for r in session_statistics(sessions, config.measures, config.stats, config, fill=False).collect()}
    keys = sessions.select("session_id", F.explode("keys").alias("k")).select("session_id", "k.*")
    valid = typed_keystrokes(keys).where(inside(["Hold time", "Latency time"], 2000.0))
    grouped = profile(observations(valid, "session_id", config.measures), ["session_id", "measure", "category"]).collect()
    assert len(grouped) > 80
    for r in grouped:
        for stat in config.stats:
            got = wide[r["session_id"]][f"{stat}_{r['category']}_{r['measure']}"]
            wanted = None if r[stat] is None else pytest.approx(r[stat], rel=1e-9, abs=1e-9)
            assert got == wanted, (r["session_id"], stat)


def test_exploded_sessions_parse_each_post_once(spark):
    profile, key = {"Gender": "Female"}, {"Hand": "L", "Hold time": "75.0"}
    bodies = {"two": json.dumps([profile, key, {"Hand": "R"}]), "gap": json.dumps([profile, key, None, key]),
              "bare": json.dumps([profile]), "none": "[]", "torn": "{", "null": None}
    posts = spark.createDataFrame([(k, v) for k, v in bodies.items()], "session_id string, payload string")
    rows = explode_sessions(sessions_from_posts(posts))
    assert sorted((r["session_id"], r["position"], r["Hand"], r["Gender"]) for r in rows.collect()) == [
        ("gap", 0, "L", "Female"), ("gap", 1, None, "Female"), ("gap", 2, "L", "Female"), ("two", 0, "L", "Female"), ("two", 1, "R", "Female")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "size(transform" not in plan


def test_session_features_are_complete(spark, inbox):
    rows = session_features(read_sessions(spark, str(inbox[0]))).orderBy(F.col("session_id").cast("int")).collect()
    assert rows[0].asDict().keys() == {"session_id", *CHOSEN_FEATURES}
    assert all(v is not None for r in rows for v in r)
    empty = rows[13]
    assert empty["Tremors"] == 1.0 and sum(v for k, v in empty.asDict().items() if k.endswith("time")) == 0.0
    assert [r["Sided_None"] for r in rows[:3]] == [1.0, 0.0, 0.0]


def test_strict_categories_leave_out_unknown_directions(spark, inbox):
    sessions = read_sessions(spark, str(inbox[0]))
    loose, strict = session_features(sessions), session_features(sessions, strict_categories=True)
    key = "mean_S_hold_time"
    # No direction of the four ends in S, so no S key is left.
    assert strict.agg(F.max(key)).first()[0] == 0.0 and loose.agg(F.max(key)).first()[0] > 0.0


def test_posted_form(spark, inbox):
    made = inbox[1]
    posts = spark.createDataFrame([(s["session_id"], json.dumps([s["profile"], *s["keys"]])) for s in made],
                                  "session_id string, payload string")
    a = {r["session_id"]: r for r in session_features(sessions_from_posts(posts)).collect()}
    b = {r["session_id"]: r for r in session_features(read_sessions(spark, str(inbox[0]))).collect()}
    assert a == b


def test_model_survives_saving_and_stream_equals_batch(spark, inbox, tmp_path):
    sessions = read_sessions(spark, str(inbox[0]))
    rows = session_features(sessions).withColumn("label", F.col("session_id").cast("int") % 2)
    model = fit_pipeline(rows, CHOSEN_FEATURES, tree(4))
    save_model(model, str(tmp_path / "model"))
    loaded = load_pipeline(str(tmp_path / "model"))
    batch = sorted(score_sessions(sessions, model).collect())
    assert batch == sorted(score_sessions(sessions, loaded).collect()) and len(batch) == 14
    stream = session_stream(spark, str(inbox[0]), files_per_batch=1)
    start_session_scoring(stream, loaded, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_running_statistics_go_on_after_new_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    measure = Measure("value", "event_type", "value", ("click", "view"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part, rows in enumerate((events.where("event_id < 600"), events.where("event_id >= 600"))):
        rows.write.mode("append").parquet(source)
        stream = table_stream(spark, source, events.schema)
        start_running_counts(stream, "user_id", [measure], state).awaitTermination()
        seen = events if part else events.where("event_id < 600")
        wanted = profile(observations(seen, "user_id", [measure]), ["user_id", "measure", "category"])
        got = running_profile(spark, state, "user_id")
        a = {(r["user_id"], r["category"]): r for r in wanted.collect()}
        b = {(r["user_id"], r["category"]): r for r in got.collect()}
        assert a.keys() == b.keys()
        for key in a:
            assert b[key]["count"] == a[key]["count"]
            assert b[key]["median"] == pytest.approx(a[key]["median"]) and b[key]["skew"] == pytest.approx(a[key]["skew"])


def test_tables_survive_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", value', 0.1), (2, None, None)], "k int, t string, v double")
    for form in ("csv", "tsv"):
        path = str(tmp_path / form)
        write_table(df, path, form)
        reader = spark.read.schema(df.schema).option("header", form == "csv").option("sep", "\t" if form == "tsv" else ",")
        assert sorted(reader.csv(path).collect()) == sorted(df.collect())


@pytest.mark.parametrize("digit", range(10))
def test_profile_values_may_end_in_any_digit(spark, digit):
    """Every line's value ends in the digit, whatever the line's place is."""
    from keyrhythm.config import PROFILE_FIELDS
    from keyrhythm.functions.text import profile_fields

    text = "".join(f"{name}:  v{digit}{digit} \r\n" for name in PROFILE_FIELDS)
    row = spark.createDataFrame([(text,)], "t string").select(*profile_fields("t", PROFILE_FIELDS)).first()
    assert row.asDict() == {name: f"v{digit}{digit}" for name in PROFILE_FIELDS}


def test_raw_files_are_written_under_the_recorder_s_names(spark, tmp_path):
    from keyrhythm.config import KEYSTROKE_FIELDS
    from keyrhythm.sources.files import list_files
    from keyrhythm.sources.raw import write_log_files, write_profile_files

    profiles = spark.createDataFrame([(f"{i:010d}", f"Gender: Male{i}\r\n") for i in range(25)], "user_id string, text string")
    assert write_profile_files(profiles, str(tmp_path / "users")) == 25
    assert sorted(p.name for p in (tmp_path / "users").iterdir()) == [f"User_{i:010d}.txt" for i in range(25)]
    assert [tuple(r) for r in list_files(spark, str(tmp_path / "users")).orderBy("place").collect()] == [
        (f"User_{i:010d}.txt", f"{i:010d}", i + 1) for i in range(25)]
    assert {r["user_id"]: r["Gender"] for r in read_profiles(spark, str(tmp_path / "users")).collect()}["0000000019"] == "Male19"
    logs = spark.createDataFrame([(f"{i % 3:010d}", f"16{8 + i % 2:02d}01", "10:00:00.000", "L", f"{i:04d}.0", "LL", "0100.0", None, i) for i in range(90)],
                                 ", ".join(f"`{c}` string" for c in KEYSTROKE_FIELDS) + ", n int")
    assert write_log_files(logs, str(tmp_path / "logs"), KEYSTROKE_FIELDS, ["n"]) == 6
    assert sorted(p.name for p in (tmp_path / "logs").iterdir()) == [f"{i:010d}_{m}.txt" for i in range(3) for m in ("1608", "1609")]
    first = (tmp_path / "logs" / "0000000000_1608.txt").read_bytes().split(b"\r\n")
    assert [line.split(b"\t")[4] for line in first[:3]] == [b"0000.0", b"0006.0", b"0012.0"] and first[0].endswith(b"\t") and first[-1] == b""
    read = read_keystrokes(spark, str(tmp_path / "logs"))
    assert read.count() == 90 and read.where("file_id != user_id").count() == 0


def test_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    from keyrhythm.sources.files import list_files

    folder = tmp_path / "users"
    folder.mkdir()
    for name, text in (("User_000000000b.txt", "Gender: Male\r\n"), ("User_000000000a.txt", "Gender: Ünsure\r\n"), ("User_000000000c.txt", ""), ("_SUCCESS", "x")):
        (folder / name).write_text(text, encoding="utf-8", newline="")
    read, listed = read_profiles(spark, str(folder)), list_files(spark, str(folder))
    assert all("Relation" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (read, listed))
    assert {r["user_id"]: r["Gender"] for r in read.collect()} == {"000000000a": "Ünsure", "000000000b": "Male"}
    assert [r["file"] for r in listed.orderBy("place").collect()] == ["User_000000000a.txt", "User_000000000b.txt"]


def test_logs_are_read_by_tasks_as_spark_reads_them(spark, tmp_path):
    import gzip

    from keyrhythm.functions.text import id_from_log_path
    from keyrhythm.sources.files import KEYSTROKE_SCHEMA

    folder = tmp_path / "data"
    folder.mkdir()
    row = "\t".join(["000000000a", "160801", "10:00:00.000", "L", "0001.0", "LL", "0002.0", "0100.0", ""])
    odd = [row, "", " \t ", "short\tline", row + "\tmore", '"quoted\tfield"\tx', '"open\tx', "Ünsure\t\t\x00\t", "\t\t\ta"]
    texts = {"a_1608": "\r\n".join([row] * 40) + "\r\n", "b_1608": "\n".join(odd), "c_1609": "\r".join([row] * 3), "d_1609": "\ufeff" + row + "\r\n\r\n" + row,
             "_hidden": row, "e_1608": ""}
    for name, text in texts.items():
        (folder / f"00000000{name}.txt" if name[0] != "_" else folder / name).write_bytes(text.encode())
    (folder / "00000000f_1608.txt.gz").write_bytes(gzip.compress((row + "\r\n").encode() * 30))
    expected = spark.read.schema(KEYSTROKE_SCHEMA).option("sep", "\t").csv(str(folder)).withColumn("file_id", id_from_log_path(F.col("_metadata.file_path")))
    want = sorted(map(str, expected.collect()))
    for options in ({}, {"piece": 50, "block": 7}, {"piece": 101, "block": 1000}, {"piece": 1}):
        read = read_keystrokes(spark, str(folder), **options)
        assert "Relation" not in read._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, read.collect())) == want
    assert read_keystrokes(spark, [str(folder / "00000000a_1608.txt"), str(folder / "00000000c_1609.txt")]).count() == 43


def test_raw_files_are_opened_once(spark, raw, monkeypatch):
    opened = spark.sparkContext.accumulator(0)
    keystrokes = read_keystrokes(spark, str(raw / "data"))

    def seen(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    config = VARIANTS["wide"].with_rows_more_than(50)
    tables = feature_tables(read_profiles(spark, str(raw / "users")), keystrokes.mapInArrow(seen, keystrokes.schema), config)
    assert sum(len(tables[name].collect()) for name in ("both", "hold", "latency")) == 18
    assert opened.value == 10 * 120 + 8


def test_sessions_cost_what_is_asked_of_them(spark, tmp_path):
    from keyrhythm.catalog.sessions import sessions

    docs = spark.createDataFrame([(i, "word " * i + "a bc", "en", "x", 5 * i) for i in range(9)] + [(None, "a b", None, "x", 3)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(2, 1), (2, 0), (5, 1), (77, 1), (None, 1)], "doc_id bigint, quality int")
    chosen, every = sessions(spark, str(tmp_path), of=labels), sessions(spark, str(tmp_path))
    assert sorted(r["session_id"] for r in chosen.collect()) == ["2", "5"] and every.count() == 10
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("zip_with") < plan.index("LeftSemi")  # the keys are made above the join
    few, all_ = session_features(every, columns=("mean_L_hold_time", "mean_LR_latency_time")), session_features(every)
    assert "Flight time#" not in few._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1].split("\n", 1)[0]
    assert sorted(map(str, few.collect())) == sorted(map(str, all_.select(*few.columns).collect()))


def test_json_lines_are_packed(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", ("Male", "Yes", None), [("L", "1.0", "LL", None, "2.0")] * i) for i in range(3)],
                                 "session_id string, profile struct<Gender:string,Tremors:string,Sided:string>, "
                                 "keys array<struct<Hand:string,`Hold time`:string,Direction:string,`Latency time`:string,`Flight time`:string>>")
    write_table(rows, str(tmp_path / "sessions"), "json")
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "sessions").glob("part-*"))
    assert sorted(read_sessions(spark, str(tmp_path / "sessions")).collect()) == sorted(rows.collect())


def test_posted_keys_are_written_by_one_call(spark, tmp_path):
    from keyrhythm.catalog.sessions import posted_sessions, sessions

    spark.createDataFrame([(1, "en", 9, "a bb  cccc"), (2, "fr", 1, "one"), (3, None, 0, ""), (4, "de", None, None)],
                          "doc_id bigint, lang string, n_chars bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    posted = posted_sessions(spark, str(tmp_path))
    got = {r.session_id: r["keys"] for r in posted.collect()}
    want = {r.session_id: r["keys"] for r in sessions(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in "123"} == {k: want[k] for k in "123"} and len(got["1"]) == 2
    assert "transform(keys" not in posted._jdf.queryExecution().analyzed().toString()
