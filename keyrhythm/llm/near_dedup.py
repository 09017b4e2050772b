"""Near-duplicates by a chosen-path set similarity join on word shingles.

Documents with the same shingle set are one class from the start. Every class has a signature of
minwise tokens. Each tree branches on one or two of them: classes that share a chosen token share a
node. A node with few members is compared exhaustively; one with many is branched again on tokens
that the node chooses, so only sets that agree again and again stay together. Independent trees are
repeated for recall. Candidates pass a comparison of signatures and are confirmed on full sets.

Copies by the thousand would stay together on every path. So the members of each first node are
linked to its smallest member before anything else. Nodes whose members are all connected by then
have nothing to add. In the others, members that have an alike but unconnected one are compared on
full sets, the most alike first, until they are connected: links grow with members, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyrhythm.llm import tokens
from keyrhythm.llm.common import packed, unpacked, with_extremes, written
from keyrhythm.llm.components import components
from keyrhythm.llm.registry import query, table

U64 = np.uint64
FEATURES = "_id bigint, n_shingles bigint, _s1 bigint, _s2 bigint, _sig binary"


def shingles(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of a chunk's documents, borders per document)."""
    for lo, hi, offsets, data in tokens.chunks(column):
        n = hi - lo
        hashed, first = tokens.words(data, offsets, fold=tokens.LOWERED)
        count = np.diff(first)
        found, document = tokens.windows(hashed, first, size)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            whole = [tokens.windows(hashed[first[d] : first[d + 1]], np.array([0, count[d]]), int(count[d]))[0] for d in short]
            found, document = np.concatenate([found, *whole]), np.concatenate([document, short])
            order = np.argsort(document, kind="stable")
            found, document = found[order], document[order]
        borders = tokens.per_document(document, n)
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            found[a:b].sort()
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (document[1:] != document[:-1])
        yield lo, found[fresh], tokens.per_document(document[fresh], n)


def signatures(values: np.ndarray, borders: np.ndarray, coordinates: int) -> np.ndarray:
    """Minwise tokens (32 bits each) of each document that has shingles; the others get zeros."""
    n = len(borders) - 1
    out = np.zeros((n, coordinates), np.uint32)
    some = np.flatnonzero(np.diff(borders))
    if len(some):
        factor, shift = tokens.numbers(11, coordinates) | tokens.ONE, tokens.numbers(12, coordinates)
        starts = borders[some]
        for i in range(coordinates):
            out[some, i] = np.minimum.reduceat(values * factor[i] + shift[i], starts) >> U64(32)
    return out


def _features(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, values, borders in shingles(batch.column(1), size):
                n = len(borders) - 1
                some = np.flatnonzero(np.diff(borders))
                s1, s2 = np.zeros(n, U64), np.zeros(n, U64)
                if len(some):
                    s1[some] = np.add.reduceat(tokens.mixed(values), borders[some])
                    s2[some] = np.bitwise_xor.reduceat(tokens.mixed(values + U64(0x5851F42D4C957F2D)), borders[some])
                rows = signatures(values, borders, coordinates)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(np.diff(borders), pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["_id", "n_shingles", "_s1", "_s2", "_sig"])
    return run


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _chosen(nodes: np.ndarray, coordinates: int, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, coordinate) of the tokens each node branches on: one, or two with the odds that make the
    expected number 1 / share, so that pairs of that similarity keep meeting."""
    one = tokens.mixed(nodes ^ U64(0xA24BAED4963EE407))
    two = tokens.mixed(one + U64(0x9FB21C651E98DF25))
    first = (one % U64(coordinates)).astype(np.int64)
    second = (first + 1 + (two % U64(coordinates - 1)).astype(np.int64)) % coordinates
    more = np.flatnonzero((tokens.mixed(two) >> U64(11)).astype(np.float64) / 2.0**53 < 1.0 / share - 1.0)
    return [(np.arange(len(nodes)), first), (more, second[more])]


def _branch(coordinates: int, share: float, trees: int | None = None):
    """From ``(_id, [_node, _comp,] _sig)`` to the nodes below; with ``trees``, from the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = tokens.numbers(13, trees) if trees else None
        for batch in batches:
            if not len(batch):
                continue
            sig = _matrix(batch.column("_sig"), np.uint32, coordinates)
            ids = batch.column("_id").to_numpy()
            if trees:
                at, node = np.repeat(np.arange(len(ids)), trees), np.tile(roots, len(ids))
            else:
                at, node = np.arange(len(ids)), batch.column("_node").to_numpy().view(U64)
            for rows, coordinate in _chosen(node, coordinates, share):
                row = at[rows]
                token = sig[row, coordinate].astype(U64) + (coordinate.astype(U64) << U64(32))
                below = tokens.mixed(node[rows] * U64(0xD1342543DE82EF95) + tokens.mixed(token))
                columns = [pa.array(ids[row]), pa.array(below.view(np.int64))]
                if not trees:
                    columns.append(pa.array(batch.column("_comp").to_numpy()[row]))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_node"] + ["_comp"] * (not trees))
    return run


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _sketch_filter(coordinates: int, least: int):
    """Keeps pairs whose signatures agree in at least ``least`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (_matrix(batch.column(c), np.uint32, coordinates) for c in ("_sig_a", "_sig_b"))
                yield batch.filter(pa.array(_alike(a, b) >= least)).select(["a", "b"])
    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one node after another (rows of a node lie together; nodes are small here)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        node = batch.column("_node").to_numpy()
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column("_node")[0].as_py() != node[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _unlinked(rows: pa.Table, coordinates: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(member, later members, tokens in common) for what is not yet connected and has alike signatures."""
    comps = rows.column("_comp").to_numpy()
    sig = np.frombuffer(b"".join(rows.column("_sig").to_pylist()), np.uint32).reshape(len(rows), coordinates)
    for i in range(len(rows) - 1):
        other = np.flatnonzero(comps[i + 1 :] != comps[i]) + i + 1
        common = _alike(sig[other], sig[i])
        near = common >= least
        if near.any():
            yield i, other[near], common[near]


def _promising(coordinates: int, least: int):
    """Members of small nodes that have an unconnected member with an alike signature in the same node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            marked = np.zeros(len(rows), bool)
            for i, others, _ in _unlinked(rows, coordinates, least):
                marked[i] = True
                marked[others] = True
            if marked.any():
                picked = rows.filter(pa.array(marked)).select(["_id", "_node", "_comp"]).combine_chunks()
                yield from picked.to_batches()
    return run


def _link_nodes(coordinates: int, least: int, percent: int):
    """Links that connect what is to be connected inside each node, confirmed on full sets.

    The most alike pairs come first, and pairs that are connected by then are passed over: a node adds
    fewer links than it has members. Of the nodes that two members share only the first looks at them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            node = rows.column("_node")[0].as_py()
            ids, comps = rows.column("_id").to_numpy(), rows.column("_comp").to_numpy()
            shared = [set(n) for n in rows.column("_nodes").to_pylist()]
            sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("_set")]
            pairs = [(-int(c), i, int(j)) for i, others, common in _unlinked(rows, coordinates, least) for j, c in zip(others, common)]
            parent = {int(c): int(c) for c in comps}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            found = []
            for _, i, j in sorted(pairs):
                x, y = root(int(comps[i])), root(int(comps[j]))
                if x == y or min(shared[i] & shared[j]) != node:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[max(x, y)] = min(x, y)
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, borders in shingles(batch.column(1), size):
                packed = [values[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(packed)), pa.array(packed, pa.binary())], names=["_id", "_set"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("_set_a"), batch.column("_set_b")):
                a, b = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return run


class _Join:
    """The tables and settings that the steps of one join share."""

    def __init__(self, docs: DataFrame, reps: DataFrame, size: int, percent: int, coordinates: int):
        self.docs, self.reps, self.size, self.percent, self.coordinates = docs, reps, size, percent, coordinates
        share = percent / 100
        self.share = share
        #: Four standard deviations below what a pair of just that similarity shows.
        self.least = int(coordinates * share - 4 * (coordinates * share * (1 - share)) ** 0.5)

    def alike(self, pairs: DataFrame) -> DataFrame:
        sig = self.reps.select("_id", "_sig")
        pairs = pairs.join(sig.withColumnsRenamed({"_id": "a", "_sig": "_sig_a"}), "a")
        pairs = pairs.join(sig.withColumnsRenamed({"_id": "b", "_sig": "_sig_b"}), "b")
        return pairs.mapInArrow(_sketch_filter(self.coordinates, self.least), "a bigint, b bigint")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """Full sets of the given ids, taken anew from the texts."""
        ids = written(ids.select("_id").distinct(), f"{name}-ids")
        return written(self.docs.join(ids, "_id", "left_semi").mapInArrow(_sets(self.size), "_id bigint, _set binary"), f"{name}-sets")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = written(pairs, f"{name}-candidates")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("_id")), name)
        both = pairs.join(sets.withColumnsRenamed({"_id": "a", "_set": "_set_a"}), "a")
        both = both.join(sets.withColumnsRenamed({"_id": "b", "_set": "_set_b"}), "b")
        return written(both.mapInArrow(_confirm(self.percent), "a bigint, b bigint"), name)

    def linked(self, members: DataFrame) -> DataFrame:
        """Links inside small nodes. Full sets go only to members with an alike, unconnected one."""
        sig = self.reps.select("_id", "_sig")
        alike = _by_node(members.select("_id", "_node", "_comp").join(sig, "_id"), "_sig").mapInArrow(
            _promising(self.coordinates, self.least), "_id bigint, _node bigint, _comp bigint")
        alike = written(alike, "path-alike")
        nodes = alike.groupBy("_id").agg(F.collect_set("_node").alias("_nodes"))
        rows = alike.join(nodes, "_id").join(sig, "_id").join(self.sets(alike, "path"), "_id")
        return written(_by_node(rows, "_sig", "_nodes", "_set").mapInArrow(
            _link_nodes(self.coordinates, self.least, self.percent), "a bigint, b bigint"), "path-links")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85,
    trees: int = 12, coordinates: int = 128, node_limit: int = 2048, max_depth: int = 12,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Words are separated by white space, with A-Z in lower case. A document's set holds its distinct
    ``size``-word shingles, of fewer words the whole sequence; documents without words or with a NULL
    text have an empty set and are linked with nothing. Two documents are linked if their sets'
    Jaccard similarity is at least ``percent``; ``component_id`` is the smallest id reachable, and
    ``kept`` marks the document that bears it. Every row with that id is kept if rows repeat an id
    with the same text. A NULL id gets its component's id and is not kept, or keeps its place without
    a component if no other document is linked. An empty table gives an empty one. Shingles are
    64-bit hashes of whole words. Ids that repeat with different texts count as one document that
    has all of their links. Nodes still large after ``max_depth`` levels are compared exhaustively
    in blocks of ``node_limit`` members.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    features = written(docs.mapInArrow(_features(size, coordinates), FEATURES), "shingle-features")
    key = ["n_shingles", "_s1", "_s2"]
    classes = written(features.where("n_shingles > 0").groupBy(*key).agg(
        F.min("_id").alias("_rep"), F.first("_sig").alias("_sig")), "shingle-classes")
    reps = classes.where(F.col("_rep").isNotNull()).select(F.col("_rep").alias("_id"), "_s1", "_s2", "_sig")
    join = _Join(docs, reps, size, percent, coordinates)

    nodes = reps.select("_id", "_sig").mapInArrow(_branch(coordinates, join.share, trees), "_id bigint, _node bigint")
    nodes = written(nodes, "path-nodes")
    shared = with_extremes(nodes, "_node", "_id", "_id").where("_low <> _high")
    members = written(shared.select("_id", "_node", "_low"), "path-members")

    stars = members.where("_id > _low").select(F.col("_low").alias("a"), F.col("_id").alias("b")).distinct()
    nearest = join.alike(stars).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = join.confirmed(nearest, "star-links")
    found = written(components(links), "star-components")

    members = _apart(members.select("_id", "_node").join(found, members["_id"] == found["id"], "left")
                     .select("_id", "_node", F.coalesce("component", "_id").alias("_comp")))
    small, depth = [], 0
    while True:
        members = written(members, "path-level")
        small.append(members.where(F.col("_n") <= node_limit))
        large = members.where(F.col("_n") > node_limit)
        depth += 1
        if large.isEmpty():
            break
        if depth > max_depth:
            small.append(_blocks(large, node_limit))
            break
        below = large.select("_id", "_node", "_comp").join(reps.select("_id", "_sig"), "_id").mapInArrow(
            _branch(coordinates, join.share), "_id bigint, _node bigint, _comp bigint")
        members = _apart(below)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    found = written(components(links.unionByName(join.linked(rest))), "components")

    labelled = classes.join(found, classes["_rep"] == found["id"], "left").select(
        *key, F.coalesce("component", "_rep").alias("component_id"))
    out = features.select("_id", *key).join(labelled, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(doc_id), "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("_id"), component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, marks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``marks`` (of ``near_duplicates``) keeps, once each if id and text repeat."""
    key = {"_k": F.coalesce(F.col("_id").cast("bigint"), F.lit(0)), "_none": F.col("_id").isNull()}
    kept = marks.where("kept").select(F.col(doc_id).alias("_id")).withColumns(key).select(*key).distinct()
    keyed = packed(docs, _id=doc_id, _text=text).withColumns({**key, "_h": F.xxhash64(F.coalesce(F.col("_text"), F.lit("")), F.lit(3))})
    ordered = Window.partitionBy("_k", "_none").orderBy("_h")
    out = keyed.drop("_id", "_text").join(kept, ["_k", "_none"], "left_semi").withColumns(
        {"_nth": F.row_number().over(ordered), "_same": F.lag("_h").over(ordered)})
    return unpacked(out.where((F.col("_nth") == 1) | (F.col("_same") != F.col("_h"))))


def _apart(members: DataFrame) -> DataFrame:
    """The members of nodes that still hold different components, with the nodes' sizes."""
    apart = with_extremes(members, "_node", "_comp", "_id").where("_low <> _high")
    return apart.select("_id", "_node", "_comp", "_n")


def _by_node(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a node side by side in one task; nodes are small here."""
    return rows.select("_node", "_id", "_comp", *columns).repartition("_node").sortWithinPartitions("_node", "_id")


def _blocks(members: DataFrame, limit: int) -> DataFrame:
    """Small nodes in which every two members of a node that stayed large meet.

    Members are dealt to blocks by hash; the members of block i join the pair (i, j) for every j.
    """
    blocks = F.ceil(2 * F.col("_n") / limit).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64("_node", F.least("_block", "_other"), F.greatest("_block", "_other"))
    return dealt.select("_id", pair.alias("_node"), "_comp", "_n")


OP9_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                                 ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
    FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY ALL),
e AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id,
       coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query("op9_near_dedup", OP9_SQL)
def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
