"""k nearest neighbours, exact for tables of any size, and an index for when nearly all of them will do.

- A training table whose measured size is below ``broadcast_bytes`` is broadcast once and every query
  row is answered where it lies.
- Narrow vectors: a larger table is cut into cells around pivots and each cell into distance rings.
  The triangle inequality tells from the ring table alone which rings can hold one of a query's k
  nearest, so a query travels only to those rings (an equi join on the ring's block).
- Wide vectors, of which rings prune little: both tables are cut into blocks of bounded size, and every
  block of queries meets every block of points once.
- ``ProjectionIndex``: points lie in buckets by the signs of random projections, and a query looks into
  the buckets that are most likely to hold its neighbours, as many as a measured recall asks for.

In all forms a block gives at most k candidates per query, and the best k of those are the answer. No
pair is ever emitted that is not a candidate. Keys may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.sql import Column, DataFrame, Window, functions as F

from keyrhythm.operators.stored import Stored
from keyrhythm.operators.voting import majority
from keyrhythm.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
#: Vectors up to this width are searched by rings, wider ones by tiles.
NARROW = 8


def k_smallest(queries: np.ndarray, points: np.ndarray, k: int, cells: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: places of its k nearest points and their squared distances.

    Fast products pick the candidates with some slack; the candidates' distances are then taken
    exactly, and equal distances are ordered by the points' places: put the points in order of their key.
    """
    k = min(k, len(points))
    if not k:
        return
    norms = (points * points).sum(axis=1)
    step = max(1, cells // max(1, len(points)))
    for start in range(0, len(queries), step):
        block = queries[start:start + step]
        own = (block * block).sum(axis=1)
        rough = own[:, None] - 2.0 * (block @ points.T) + norms[None, :]
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (own + norms.max()) + 1e-12
        for row in range(len(block)):
            near = np.flatnonzero(rough[row] <= limit[row] + slack[row])
            away = points[near] - block[row]
            exact = (away * away).sum(axis=1)
            best = np.lexsort((near, exact))[:k]
            yield start + row, near[best], exact[best]


def _dense(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _objects(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text as plain objects: the string columns of pandas may come in several chunks, which Spark does not take back."""
    return pdf.astype({c: object for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype)})


class Size(NamedTuple):
    bytes: int
    width: int


def measured(train: DataFrame, vector: str) -> Size:
    """Bytes of the training matrix in memory, and how wide it is."""
    row = train.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    width = int(row["d"] or 0)
    return Size(int(row["n"]) * (8 * width + 16), width)


def fewest(train: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """The k smallest keys of each distinct vector: as equal vectors are equally far, no others are among k nearest.

    Spark limits each vector's rows before it moves them.
    """
    place = F.row_number().over(Window.partitionBy(vector).orderBy(key))
    return train.withColumn("_at", place).where(F.col("_at") <= k).drop("_at")


#: Points of a leaf, which is searched as a whole.
LEAF = 128


def leaves(x: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The rows in groups of at most ``size`` that lie together: halves along the widest side, again and again."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = x[rows]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, side], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return out


def k_smallest_narrow(queries: np.ndarray, points: np.ndarray, k: int, boxes: tuple) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``k_smallest``, where a query meets only the leaves whose box is no farther than its k-th nearest can be."""
    members, low, high = boxes
    k = min(k, len(points))
    step = max(1, 1_000_000 // len(members))
    for start in range(0, len(queries), step):
        block = queries[start : start + step]
        near = np.zeros((len(block), len(members)))
        for d in range(points.shape[1]):
            x = block[:, d : d + 1]
            near += np.maximum(0.0, np.maximum(low[:, d] - x, x - high[:, d])) ** 2
        closest = near.argmin(axis=1)
        for row, own in enumerate(block):
            held = members[closest[row]]
            if len(held) < k:
                order = np.argsort(near[row], kind="stable")
                enough = int(np.argmax(np.cumsum([len(members[i]) for i in order]) >= k)) + 1
                held = np.concatenate([members[i] for i in order[:enough]])
            limit = np.partition(((points[held] - own) ** 2).sum(axis=1), k - 1)[k - 1]
            held = np.concatenate([members[i] for i in np.flatnonzero(near[row] <= limit * (1 + 1e-9) + 1e-12)])
            away = points[held] - own
            exact = (away * away).sum(axis=1)
            among = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
            best = among[np.lexsort((held[among], exact[among]))[:k]]
            yield start + row, held[best], exact[best]


class Points:
    """A training table that a task holds: keys in order, labels, vectors."""

    def __init__(self, rows: pa.Table | pa.StructArray, key: str, label: str, vector: str):
        if isinstance(rows, pa.StructArray):
            rows = pa.table({c: rows.field(c) for c in (key, label, vector)})
        rows = rows.sort_by(key)
        self.keys, self.labels, x = (_whole(rows[c]) for c in (key, label, vector))
        self.x = _matrix(x) if len(x) else np.empty((0, 0))
        self.boxes = None
        if self.x.shape[1] <= NARROW and len(self.x) > 4 * LEAF and np.isfinite(self.x).all():
            members = leaves(self.x)
            self.boxes = (members, np.stack([self.x[m].min(axis=0) for m in members]), np.stack([self.x[m].max(axis=0) for m in members]))

    def _nearest(self, queries: np.ndarray, k: int):
        if self.boxes is not None and len(queries) and np.isfinite(queries).all():
            return k_smallest_narrow(queries, self.x, k, self.boxes)
        return k_smallest(queries, self.x, k)

    def lists(self, queries: np.ndarray, k: int) -> pa.Array:
        """The neighbours of each query as a list of structs, nearest first."""
        # Equal queries are answered once.
        asked, back = np.unique(queries, axis=0, return_inverse=True) if len(queries) else (queries, np.zeros(0, int))
        places, distances = [np.empty(0, int)] * len(asked), [np.empty(0)] * len(asked)
        for row, at, squared in self._nearest(asked, k):
            places[row], distances[row] = at, np.sqrt(squared)
        places, distances = [places[i] for i in back.ravel()], [distances[i] for i in back.ravel()]
        counts = np.array([len(p) for p in places], np.int32)
        at = pa.array(np.concatenate(places) if places else np.empty(0, int), pa.int64())
        told = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(distances) if distances else np.empty(0)), self.keys.take(at), self.labels.take(at)],
            names=["distance", "neighbour", "label"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), told)


def _neighbours_type(key_type: str) -> str:
    return f"array<struct<distance:double,neighbour:{key_type},label:int>>"


def held_points(train: DataFrame, key: str, vector: str, label: str):
    """The whole training table, which must be small, as a broadcast variable."""
    rows = train.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(vector).alias("x")).toArrow()
    return train.sparkSession.sparkContext.broadcast(Points(rows, "key", "label", "x"))


def answered_by(shipped, queries: DataFrame, k: int, key_type: str, vector: str) -> DataFrame:
    """Add ``neighbours`` (nearest first) to every query row where it lies."""
    @F.arrow_udf(_neighbours_type(key_type))
    def nearest(x: pa.Array) -> pa.Array:
        return shipped.value.lists(_matrix(x), k)

    return queries.withColumn("neighbours", nearest(F.col(vector).cast("array<double>")))


def neighbours_by_broadcast(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str,
                            label: str) -> DataFrame:
    return answered_by(held_points(train, key, vector, label), queries, k, dict(train.dtypes)[key], vector)


def merged(candidates: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """Queries with the best k of their candidates (id, neighbour, label, distance). At most k rows per query and block arrive here."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    best = candidates.withColumn("_at", place).where(F.col("_at") <= k)
    answers = best.groupBy(F.col("id").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("distance", "neighbour", "label"))).alias("neighbours")
    )
    return queries.join(answers, key, "left")


def neighbours_by_tiles(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str,
                        block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """The same result by meeting every block of queries with every block of points; a task holds one of each."""
    kind = dict(train.dtypes)[key]
    points = train.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_struct_array()
            for start in range(0, len(rows), block_rows):
                part = rows[start:start + block_rows]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["points"])

    blocks = cut_lineage(points.mapInArrow(cut, f"points array<struct<id:{kind},label:int,x:array<double>>>").withColumn(
        "share", F.monotonically_increasing_id()))
    shares = max(1, blocks.count())
    query_parts = max(1, -(-queries.count() // query_rows))
    asked = queries.groupBy(F.pmod(F.xxhash64(key), F.lit(query_parts)).cast("int").alias("part")).agg(
        F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"))).alias("asked"))
    left = blocks.select("points", F.pmod(F.xxhash64("share"), F.lit(shares)).cast("int").alias("share"),
                         F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("part"))
    right = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, asked in zip(batch.column(0), batch.column(1)):
                held, rows = Points(points.values, "id", "label", "x"), asked.values
                yield from _candidates(held, rows.field("id"), _matrix(rows.field("x")), k)

    found = left.join(right, ["part", "share"]).select("points", "asked").mapInArrow(
        answer, f"id {kind}, neighbour {kind}, label int, distance double")
    return merged(found, queries, k, key)


def _candidates(held: Points, ids: pa.Array, x: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(id, neighbour, label, distance) of each query's k nearest points."""
    told = held.lists(x, k)
    rows = told.flatten()
    owner = pa.array(np.repeat(np.arange(len(told)), told.value_lengths().to_numpy()), pa.int64())
    yield pa.RecordBatch.from_arrays([ids.take(owner), rows.field("neighbour"), rows.field("label"), rows.field("distance")],
                                     names=["id", "neighbour", "label", "distance"])


def neighbours_by_rings(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str,
                        pivots: int = 64, rings: int = 16, block_rows: int = 20_000,
                        query_rows: int = 50_000) -> DataFrame:
    """The same result for a training table of any size."""
    chosen = train.select(key, vector).orderBy(F.xxhash64(key), key).limit(pivots).collect()
    centres = np.array([row[vector] for row in chosen], dtype=float)
    kind = dict(train.dtypes)[key]

    def to_cells(batches):
        for pdf in batches:
            x = _dense(pdf["x"])
            cell = np.empty(len(x), dtype=int)
            squared = np.empty(len(x))
            for row, at, s in k_smallest(x, centres, 1):
                cell[row], squared[row] = at[0], s[0]
            yield _objects(pdf).assign(cell=cell, radius=np.sqrt(squared))

    plain = train.select(
        F.col(key).alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x")
    )
    placed = cut_lineage(
        plain.mapInPandas(to_cells, f"id {kind}, label int, x array<double>, cell int, radius double")
    )
    # Two tables of at most ``pivots`` and ``pivots * rings`` rows come to the driver.
    reach = {r["cell"]: r["far"] for r in placed.groupBy("cell").agg(F.max("radius").alias("far")).collect()}
    far = F.get(F.array(*[F.lit(float(reach.get(c, 0.0))) for c in range(len(centres))]), F.col("cell"))
    ring = F.when(far > 0, F.least(F.floor(F.col("radius") / far * rings), F.lit(rings - 1))).otherwise(0)
    placed = placed.withColumn("ring", ring.cast("int"))
    table = (
        placed.groupBy("cell", "ring")
        .agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        .orderBy("cell", "ring").toPandas()
    )
    cell, low, high, count = (table[c].to_numpy() for c in ("cell", "low", "high", "n"))
    parts = np.maximum(1, -(-count // block_rows)).astype(int)
    number = {(int(c), int(r)): i for i, (c, r) in enumerate(zip(cell, table["ring"]))}
    query_parts = max(1, -(-queries.count() // query_rows))

    def to_rings(batches):
        # A query's vector is repeated for every ring it may need, so few rows are held at a time.
        for pdf in map(_objects, batches):
            for start in range(0, len(pdf), 256):
                yield from routes(pdf.iloc[start:start + 256])

    def routes(asked: pd.DataFrame):
        x = _dense(asked["x"])
        at_row = np.arange(len(x))
        to_pivot = np.sqrt(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))[:, cell]
        at_most = to_pivot + high
        order = np.argsort(at_most, axis=1, kind="stable")
        filled = np.cumsum(count[order], axis=1) >= k
        first = np.where(filled.any(axis=1), filled.argmax(axis=1), len(cell) - 1)
        limit = at_most[at_row, order[at_row, first]]
        at_least = np.maximum(0.0, np.maximum(to_pivot - high, low - to_pivot))
        rows, ring_no = np.nonzero(at_least <= limit[:, None] * (1 + 1e-9) + 1e-9)
        repeat = parts[ring_no]
        part = np.concatenate([np.arange(r) for r in repeat]).astype(int)
        rows, ring_no = np.repeat(rows, repeat), np.repeat(ring_no, repeat)
        for start in range(0, len(rows), 16384):
            cut = slice(start, start + 16384)
            sent = asked.iloc[rows[cut]]
            yield pd.DataFrame({
                "id": sent["id"].to_numpy(), "x": sent["x"].to_numpy(), "share": sent["share"].to_numpy(),
                "block": ring_no[cut], "part": part[cut],
            })

    asked = queries.select(
        F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"),
        F.pmod(F.xxhash64(key), F.lit(query_parts)).cast("int").alias("share"),
    )
    routed = asked.mapInPandas(to_rings, f"id {kind}, x array<double>, share int, block int, part int")
    block_no = F.create_map(*[F.lit(v) for (c, r), i in number.items() for v in (c * rings + r, i)])
    stored = placed.withColumn("block", F.element_at(block_no, F.col("cell") * rings + F.col("ring")))
    part_count = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("block"))
    stored = stored.select(
        "id", "label", "x", "block", F.pmod(F.xxhash64("id"), part_count).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(int(query_parts) - 1))).alias("share"),
    )

    return merged(_block_answers(stored, routed, k, kind), queries, k, key)


def _block_answers(stored: DataFrame, routed: DataFrame, k: int, kind: str) -> DataFrame:
    """Candidates (id, neighbour, label, distance) of the queries that were sent to each (block, part, share)."""
    def best_of_block(points: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(points) or not len(asked):
            kinds = [points.schema.field("id").type, points.schema.field("id").type, pa.int32(), pa.float64()]
            return pa.table([pa.array([], k) for k in kinds], names=["id", "neighbour", "label", "distance"])
        held = Points(points, "id", "label", "x")
        asked = asked.combine_chunks()
        ids, x = (_whole(asked[c]) for c in ("id", "x"))
        return pa.Table.from_batches(list(_candidates(held, ids, _matrix(x), k)))

    on = ["block", "part", "share"]
    return stored.groupBy(*on).cogroup(routed.groupBy(*on)).applyInArrow(
        best_of_block, f"id {kind}, neighbour {kind}, label int, distance double"
    )


class Planes(NamedTuple):
    """Random hyperplanes through a point; a bucket's number has a bit for each plane that its points lie above."""

    mean: np.ndarray
    normals: np.ndarray

    @property
    def codes(self) -> np.ndarray:
        bits = self.normals.shape[1]
        return (np.arange(2**bits)[:, None] >> np.arange(bits)) & 1

    def bucket(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) @ self.normals) > 0) @ (1 << np.arange(self.normals.shape[1]))

    def order(self, x: np.ndarray) -> np.ndarray:
        """All buckets for each query, the likeliest first: the fewer and the closer planes lie between, the likelier."""
        side = (x - self.mean) @ self.normals
        squares, above, codes = side**2, side > 0, self.codes.T
        # The squared distances to all planes between the query and a bucket.
        cost = (squares * above) @ (1 - codes) + (squares * ~above) @ codes
        return np.argsort(cost, axis=1, kind="stable")


class ProjectionIndex:
    """Points in buckets by the signs of random projections, searched by as many buckets as a recall asks for.

    Fitted on at most ``sample`` points, chosen by a hash of their key: their mean is what projections
    are taken around. Every point is indexed; a bucket of more than ``block_rows`` is cut into parts.
    ``tune`` finds for a sample of queries, answered exactly, how far down each query's list of
    buckets, nearest first, its true neighbours lie, and sets ``probes`` to the smallest number that
    reaches ``recall``, which is then measured as ``measured``. Untuned, all buckets are searched.
    """

    def __init__(self, train: DataFrame, key: str = "key", vector: str = "x", label: str = "label", bucket_rows: int = 2000,
                 block_rows: int = 20_000, most_bits: int = 10, sample: int = 10_000, seed: int = 0):
        self.key, self.vector, self.label, self.block_rows = key, vector, label, block_rows
        self.kind = dict(train.dtypes)[key]
        chosen = train.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
        x = _matrix(_whole(chosen[vector]))
        bits = int(np.clip(np.ceil(np.log2(max(1, train.count() / bucket_rows))), 1, min(most_bits, x.shape[1])))
        normals, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], bits)))
        self.planes = Planes(x.mean(axis=0), normals)
        self.probes = 2**bits
        self.measured: float | None = None
        self.placed = cut_lineage(self._placed(train))
        self.counts = {r["block"]: r["n"] for r in self.placed.groupBy("block").agg(F.count("*").alias("n")).collect()}

    def _placed(self, train: DataFrame) -> DataFrame:
        planes = self.planes

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _objects(pdf).assign(block=planes.bucket(_dense(pdf["x"])).astype(np.int32))

        plain = train.select(F.col(self.key).alias("id"), F.col(self.label).cast("int").alias("label"),
                             F.col(self.vector).cast("array<double>").alias("x"))
        return plain.mapInPandas(place, f"id {self.kind}, label int, x array<double>, block int")

    def tune(self, queries: DataFrame, k: int, recall: float = 0.9, sample: int = 200, itself: bool = True) -> "ProjectionIndex":
        """Choose ``probes`` on at most ``sample`` queries, answered by brute force over all points.

        ``itself=False`` is for queries that are points: their k nearest others are looked for.
        """
        asked = queries.select(self.key, self.vector).orderBy(F.xxhash64(self.key), self.key).limit(sample)
        train = self.placed.select(F.col("id").alias(self.key), F.col("x").alias(self.vector), F.col("label").alias(self.label))
        exact = neighbours_by_tiles(train, asked, k if itself else k + 1, self.key, self.vector, self.label).select(
            F.col(self.vector).alias("x"), (F.col("neighbours.neighbour") if itself else others(self.key, k)).alias("near"))
        true = exact.withColumn("neighbour", F.explode("near")).join(
            self.placed.select(F.col("id").alias("neighbour"), "block"), "neighbour").select("x", "block").toPandas()
        if not len(true):
            return self
        places = np.argmax(self.planes.order(_dense(true["x"])) == true["block"].to_numpy()[:, None], axis=1)
        reached = np.cumsum(np.bincount(places, minlength=len(self.planes.codes))) / len(places)
        self.probes = int(np.argmax(reached >= recall)) + 1
        self.measured = float(reached[self.probes - 1])
        return self

    def search(self, queries: DataFrame, k: int, query_rows: int = 50_000) -> DataFrame:
        """Queries with ``neighbours``, found in their ``probes`` likeliest buckets."""
        parts = {b: max(1, -(-n // self.block_rows)) for b, n in self.counts.items()}
        shares = max(1, -(-queries.count() // query_rows))
        by_bucket = np.array([parts.get(b, 0) for b in range(len(self.planes.codes))])
        planes, probes = self.planes, self.probes

        def routes(batches):
            for pdf in map(_objects, batches):
                for start in range(0, len(pdf), 1024):
                    asked = pdf.iloc[start:start + 1024]
                    probed = planes.order(_dense(asked["x"]))[:, :probes]
                    row, block = np.repeat(np.arange(len(asked)), probed.shape[1]), probed.ravel()
                    repeat = by_bucket[block]
                    part = np.concatenate([np.arange(r) for r in repeat]).astype(int)
                    row, block = np.repeat(row, repeat), np.repeat(block, repeat)
                    for cut in range(0, len(row), 16384):
                        sent = asked.iloc[row[cut:cut + 16384]]
                        yield pd.DataFrame({"id": sent["id"].to_numpy(), "x": sent["x"].to_numpy(), "share": sent["share"].to_numpy(),
                                            "block": block[cut:cut + 16384], "part": part[cut:cut + 16384]})

        asked = queries.select(F.col(self.key).alias("id"), F.col(self.vector).cast("array<double>").alias("x"),
                               F.pmod(F.xxhash64(self.key), F.lit(shares)).cast("int").alias("share"))
        routed = asked.mapInPandas(routes, f"id {self.kind}, x array<double>, share int, block int, part int")
        count = F.get(F.array(*[F.lit(max(1, int(p))) for p in by_bucket]), F.col("block"))
        stored = self.placed.select("id", "label", "x", "block", F.pmod(F.xxhash64("id"), count).cast("int").alias("part"),
                                    F.explode(F.sequence(F.lit(0), F.lit(int(shares) - 1))).alias("share"))
        return merged(_block_answers(stored, routed, k, self.kind), queries, k, self.key)


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "x",
                       label: str = "label", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Queries with ``neighbours``: array of (distance, neighbour, label), nearest first, ties by key. Keys are unique."""
    size = measured(train, vector)
    if size.width <= NARROW:
        train = fewest(train, k, key, vector)
        size = measured(train, vector)
    if size.bytes <= broadcast_bytes:
        return neighbours_by_broadcast(train, queries, k, key, vector, label)
    form = neighbours_by_rings if size.width <= NARROW else neighbours_by_tiles
    return form(train, queries, k, key, vector, label)


def others(key: str, k: int) -> Column:
    """The keys of a query's k nearest points other than itself, from its ``neighbours``, of which there are k + 1."""
    return F.slice(F.filter("neighbours.neighbour", lambda n: n != F.col(key)), 1, k)


def neighbour_vote(neighbours: Column) -> Column:
    """Majority label; the smallest label wins a tie."""
    return majority(F.transform(neighbours, lambda n: n["label"]))


class NearestNeighbours(Estimator, HasFeaturesCol, HasLabelCol, Stored):
    """k-nearest-neighbour classifier for any number of classes. Rows need a unique ``keyCol`` of any type that can be ordered."""

    def __init__(self, k: int = 5, keyCol: str = "key", featuresCol: str = "features", labelCol: str = "label",
                 broadcast_bytes: int = BROADCAST_BYTES):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.k, self.key, self.broadcast_bytes = k, keyCol, broadcast_bytes

    def plain(self) -> dict:
        return {"k": self.k, "keyCol": self.key, "broadcast_bytes": self.broadcast_bytes}

    def _fit(self, dataset: DataFrame) -> "NearestNeighboursModel":
        train = dataset.select(
            F.col(self.key).alias("key"), F.col(self.getLabelCol()).cast("int").alias("label"),
            vector_to_array(self.getFeaturesCol()).alias("x"),
        )
        classes = max(2, (train.agg(F.max("label")).first()[0] or 0) + 1)
        if (train.agg(F.max(F.size("x"))).first()[0] or 0) <= NARROW:
            train = fewest(train, self.k, "key", "x")
        return NearestNeighboursModel(train, classes, self.k, self.key, self.broadcast_bytes, self.getFeaturesCol())


class NearestNeighboursModel(Model, HasFeaturesCol, Stored):
    """Holds the training table. A small one is collected and broadcast at its first use and kept."""

    def __init__(self, train: DataFrame, classes: int, k: int, keyCol: str, broadcast_bytes: int, features: str = "features"):
        super().__init__()
        self._set(featuresCol=features)
        self.train, self.classes, self.k, self.key, self.broadcast_bytes = train, classes, k, keyCol, broadcast_bytes
        self._size, self._held = None, None

    def plain(self) -> dict:
        return {"classes": self.classes, "k": self.k, "keyCol": self.key, "broadcast_bytes": self.broadcast_bytes}

    def tables(self) -> dict[str, DataFrame]:
        return {"train": self.train}

    @classmethod
    def restored(cls, plain: dict, tables: dict[str, DataFrame], parts: dict) -> "NearestNeighboursModel":
        return cls(tables["train"], **plain)

    def neighbours(self, asked: DataFrame) -> DataFrame:
        """(key, x) rows with their ``neighbours``."""
        if self._size is None:
            self._size = measured(self.train, "x")
        if self._size.bytes > self.broadcast_bytes:
            form = neighbours_by_rings if self._size.width <= NARROW else neighbours_by_tiles
            return form(self.train, asked, self.k, "key", "x", "label")
        if self._held is None:
            self._held = held_points(self.train, "key", "x", "label")
        return answered_by(self._held, asked, self.k, dict(self.train.dtypes)["key"], "x")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in dataset.columns]).alias("_row")
        told = self.neighbours(dataset.select(F.col(self.key).alias("key"), vector_to_array(self.getFeaturesCol()).alias("x"), row))
        votes = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), lambda c: F.size(
            F.filter("neighbours", lambda n: n["label"] == c)) / F.size("neighbours"))
        return told.select(
            "_row.*", array_to_vector(votes).alias("probability"), neighbour_vote(F.col("neighbours")).cast("double").alias("prediction"),
        )
