"""Hard negatives: packed products are exact, and the whole result equals brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from keyrhythm.llm import hard_negatives as code
from keyrhythm.llm.hard_negatives import Anchors, Block, Words, best_positions, cut_into_blocks, hard_negatives, packed_scores, quantised, scanned

OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def schema(id_type=T.LongType(), label_type=T.IntegerType()):
    return T.StructType([T.StructField("vec_id", id_type), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", label_type),
                         *[T.StructField(c, T.StringType()) for c in ("id", "x", "asked", "rank", "_a", "rows")]])


def frame(spark, rows, **kinds):
    return spark.createDataFrame([(*r, *["z"] * 6) for r in rows], schema(**kinds)).repartition(3)


def brute(rows, is_anchor, k=5, m=3, low=50, high=95):
    sound = [(i, [int(math.floor(256 * v)) if abs(v) < 2**45 else 256 * int(v) for v in x], l) for i, x, l in rows
             if i is not None and l is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a in sorted({r[0] for r in sound if is_anchor(r[0])}):
        _, q, label = min((r for r in sound if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = sorted(((-sum(p * c for p, c in zip(q, x)), i, l) for i, x, l in sound if i != a), key=lambda r: r[:2])
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            band = [r for r in scored if r[2] != label and low * -s <= -100 * r[0] <= high * -s][:m]
            out += [(a, p, n + 1, r[1], -s, -r[0]) for n, r in enumerate(band)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(*OUT).collect())


@pytest.mark.parametrize("reach", [1, 200, 40_000, 2**20, 2**31, 2**40])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_packed_products_are_exact(reach, n):
    rng = np.random.default_rng(reach + n)
    a, c = rng.integers(-reach, reach + 1, (9, 16)), rng.integers(-reach, reach + 1, (n, 16))
    wanted = a.astype(object) @ c.astype(object).T
    assert (packed_scores(a, c).astype(object) == wanted).all()
    assert (packed_scores(a, np.full_like(c, reach)).astype(object) == a.astype(object) @ np.full_like(c, reach).astype(object).T).all()


def test_ties_go_to_the_earlier_row_and_huge_numbers_stay_exact():
    scores = np.array([[5, 7, 7, -1, 7], [0, 0, 0, 0, 0]])
    row, column = best_positions(scores, np.array([[True] * 5, [False, True, False, True, True]]), 2)
    assert list(zip(row, column)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    row, column = best_positions(scores.astype(object) * 10**30, np.ones((2, 5), bool), 2)
    assert list(zip(row, column)) == [(0, 1), (0, 2), (1, 0), (1, 1)]
    assert quantised(np.array([[1e30, -0.5]]), 256.0)[0, 0] == 256 * int(1e30)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(8)], 1 if rng.random() < 0.4 else rng.randrange(6)) for i in range(240)]
    rows += [(300 + i, rows[5][1], rows[5][2] if i % 2 else 7) for i in range(40)]  # one vector many times
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, block_rows=32, anchor_rows=4)
    wanted = brute(rows, lambda i: i % 20 == 0)
    assert wanted and found(got) == wanted


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.4], 1), (2, [0.6, 0.4], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
            (None, [1.0, 1.0], 1), (7, [1.0, 1.0], None), (8, [], 2), (9, [0.7], 2), (10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (10, [0.1, 0.0], 3),
            (20, [1e30, 1.0], 4), (30, [-1.0, 0.0, 0.5], 1), (2, [0.6, 0.4], 2)]
    wanted = brute([(i, x and x + [0.0] * (3 - len(x)) if x and None not in x else ([0.0] * 3 if x == [] else x), l) for i, x, l in rows], lambda i: i % 10 == 0)
    got = found(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=2, anchor_rows=1))
    assert wanted and got == wanted


def test_text_ids_and_labels(spark):
    rng = random.Random(9)
    rows = [(i, [rng.random() for _ in range(4)], rng.randrange(3)) for i in range(60)]
    named = [(f"v{i:03d}", x, "abc"[l]) for i, x, l in rows]
    got = hard_negatives(frame(spark, named, id_type=T.StringType(), label_type=T.StringType()), F.col("vec_id").endswith("0"), block_rows=16)
    assert found(got) == [(f"v{a:03d}", f"v{p:03d}", r, f"v{n:03d}", s, t) for a, p, r, n, s, t in brute(rows, lambda i: i % 10 == 0)]


def test_empty_table_and_no_anchor(spark):
    assert found(hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert found(hard_negatives(frame(spark, [(1, [1.0], 1)]), F.col("vec_id") % 10 == 0)) == []


def test_blocks_are_bounded_and_whole(spark):
    rows = frame(spark, [(i, [float(i)], 0) for i in range(100)]).select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x"))
    blocks = cut_into_blocks(rows, 16).select("rows").collect()
    assert max(len(b.rows) for b in blocks) <= 16 and sorted(r.id for b in blocks for r in b.rows) == list(range(100))


def test_block_puts_candidates_in_order():
    import pyarrow as pa

    rows = pa.array([{"id": 3, "label": 1, "x": [1.0]}, {"id": 1, "label": 2, "x": [1.0, 2.0]}], pa.struct([("id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.float64()))]))
    block = Block(rows).ordered()
    assert block.ids.tolist() == [1, 3] and block.width == 2 and block.integers(2, 1.0).tolist() == [[1, 2], [1, 0]]


@pytest.mark.parametrize("reach, fields", [(150, 2), (2**20, 1), (2**24 - 1, 1)])
@pytest.mark.parametrize("signs", [(1, 1), (1, -1), (-1, -1), (0, 0)])
def test_words_of_doubles_are_exact_at_their_bounds(reach, fields, signs):
    rng = np.random.default_rng(reach)
    a, c = (s * np.full((5, 8), reach) if s else rng.choice([-reach, reach], (5, 8)) for s in signs)
    c = np.concatenate([c, -c, c[::-1], rng.integers(-reach, reach + 1, (6, 8))])
    words = Words.of(c, code._longest(a))
    assert words.fields >= fields and words.n_words < len(c) or fields == 1
    assert np.abs(words.words).max() <= 2**53
    wanted = a.astype(object) @ c.astype(object).T
    assert (words.scores(a.astype(float)).astype(object) == wanted).all() and (packed_scores(a, c).astype(object) == wanted).all()


def arrow(rows, **more):
    import pyarrow as pa

    fields = [("id", pa.int64()), ("label", pa.int64()), ("x", pa.list_(pa.float32()))]
    if more:
        fields.append(("positives", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))
    return pa.array([dict(zip(("id", "label", "x"), r)) | {k: v[r[0]] for k, v in more.items()} for r in rows], pa.struct(fields))


@pytest.mark.parametrize("dense", [0, 2, 1000])
@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_a_task_keeps_the_best_over_all_its_blocks(monkeypatch, dense, spread):
    import pyarrow as pa

    monkeypatch.setattr(code, "DENSE", dense)
    monkeypatch.setattr(code, "CELLS", 420)
    monkeypatch.setattr(code, "SAMPLE", 16)
    monkeypatch.setattr(code, "HELD", 2)
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 2, 3]), [round(0.5 + rng.gauss(0, spread), 2), 0.5 + rng.choice([-0.3, 0.0])]) for i in range(400)]
    mine = [r for r in rows if r[0] % 10 == 0]
    rng.shuffle(rows)
    blocks = [rows[i:i + 60] for i in range(0, 400, 60)]
    wanted = brute([(i, x, l) for i, l, x in rows], lambda i: i % 10 == 0)

    def batches(asked):
        parts = [asked[::3], asked[1::3], asked[2::3]]
        for b in blocks:
            for n in range(3):
                yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (
                    parts[n], arrow(b))]], names=["_a", "anchors", "rows"])

    def all_found(asked, *rest):
        out, sizes = {}, []
        for a in scanned(batches(asked), lambda block: Anchors(block, 256.0, *rest)):
            slot, score, ids = a.best.settle()
            sizes.append(len(slot) <= a.best.k * len(a.best.floor))
            for place, s, i in zip(slot.tolist(), score.tolist(), ids.tolist()):
                anchor = a.block.rows[place // max(1, a.slots)]["id"].as_py()
                out.setdefault((anchor, place % max(1, a.slots)), set()).add((-s, i))
        return {k: sorted(v) for k, v in out.items()}, sizes

    near, sizes = all_found(arrow(mine), 5)
    best = {a: v[:5] for (a, _), v in near.items()}
    assert all(sizes)
    far, sizes = all_found(arrow(mine, positives={a: [{"id": i, "score": -s} for s, i in v] for a, v in best.items()}), 3, (50, 95))
    assert all(sizes)
    got = sorted((a, best[a][n][1], rank + 1, i, -best[a][n][0], -s) for (a, n), v in far.items() for rank, (s, i) in enumerate(v[:3]))
    assert wanted and got == wanted
