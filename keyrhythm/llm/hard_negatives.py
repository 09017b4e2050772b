"""Hard negatives by exact integer products, several candidates to one wide integer.

Components are integers. Those of several candidates of a block are put into separate fields of one
wide integer, so that one multiplication with an anchor's component multiplies all of them; the sums
of these products over the components hold every candidate's score in its own field. Fields are as
wide as the block at hand needs, so no score ever runs into the next field. As long as a field fits,
the words are whole numbers of at most 53 bits, which doubles hold exactly, and the products are
matrix products of doubles; beyond that the components are biased to be non-negative and the words
have 64 bits, and where even one field would not fit those, Python's unbounded integers are the words.

All rows are cut into blocks where they are scanned; the anchors, a stated set of queries, are cut
into blocks too, and every anchor block meets every block of rows once for the positives and once
for the negatives. A task keeps the best rows of an anchor block over all the blocks that it meets,
so most scores are only held against a floor; a window merges what the tasks found.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyrhythm.llm.common import written
from keyrhythm.llm.registry import query, table

WORD_BITS = 64
#: Products and sums of fields above this many bits are left to Python's integers.
MOST_BITS = 62
#: Whole numbers up to this many bits are exact as doubles.
DOUBLE_BITS = 53
#: Scores that are made at a time: so many stay near the processor.
CELLS = 1 << 18
#: Scores whose best give a first floor, candidates a row on average above which a step is cut to its best, and anchor blocks a task keeps.
SAMPLE, DENSE, HELD = 1024, 256, 8
#: The score of a row that is no candidate; true 64-bit scores stay above.
NEVER = np.int64(-(2**63))


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers: 64-bit ones, or Python's where those are too small."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x.astype(np.float64))
    if not scaled.size or np.abs(scaled).max() < 2.0**40:
        return scaled.astype(np.int64)
    # Doubles above 2 ** 53 are whole numbers, so an integer scale multiplies them exactly.
    exact = [int(s) if abs(s) < 2.0**53 else int(v) * int(scale) for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(x.shape)


def _longest(x: np.ndarray) -> float:
    """At least the length of the longest row and the largest component."""
    if not x.size or x.dtype == object:
        return float("inf") if x.size else 0.0
    x = x.astype(np.float64)
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) * (1 + 1e-9)


class Words:
    """Rows packed into whole numbers that doubles hold exactly: field f of word w is the row f * (words) + w.

    With s = (longest anchor) * (longest row), every score and every partial sum of one lies within -s..s, so
    does its field around its middle, and a word's partial sums stay below s * (1 + B + ...) <= 2 ** 53 for B = 2 ** bits > 2 s.
    They are therefore exact in any order, with or without fused multiplications.
    """

    def __init__(self, rows: np.ndarray, bits: int, fields: int):
        self.n, self.bits, self.fields = len(rows), bits, min(fields, max(1, len(rows)))
        self.n_words = -(-self.n // self.fields)
        self.words = np.zeros((self.n_words, rows.shape[1]))
        for f in range(self.fields):
            part = rows[f * self.n_words : (f + 1) * self.n_words]
            self.words[: len(part)] += part * float(1 << (f * bits))

    @classmethod
    def of(cls, rows: np.ndarray, longest: float) -> "Words | None":
        """The words for anchors up to that length, or None where not even one field fits."""
        most = max(longest, 1.0) * max(_longest(rows), 1.0)
        if rows.dtype == object or most >= 2.0 ** (DOUBLE_BITS - 1):
            return None
        most = int(most) + 1
        bits, fields = (2 * most).bit_length(), 1
        while fields < 8 and most * sum(1 << (f * bits) for f in range(fields + 1)) <= 2**DOUBLE_BITS:
            fields += 1
        return cls(rows, bits, fields)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        out = np.empty((len(anchors), self.n_words * self.fields), np.int64)
        half, mask = 1 << (self.bits - 1), np.int64((1 << self.bits) - 1)
        whole = (anchors @ self.words.T).astype(np.int64)
        whole += np.int64(sum(half << (f * self.bits) for f in range(self.fields)))
        for f in range(self.fields):
            field = out[:, f * self.n_words : (f + 1) * self.n_words]
            np.right_shift(whole, np.int64(f * self.bits), out=field)
            if f < self.fields - 1:
                field &= mask
            field -= np.int64(half)
        return out[:, : self.n]


def scorer(rows: np.ndarray, longest: float) -> Callable[[np.ndarray], np.ndarray]:
    """Exact inner products of anchors, none longer than ``longest``, with the rows, which are packed once."""
    words = Words.of(rows, longest) if len(rows) and rows.shape[1] else None
    # Anchors of 64-bit integers are below 2 ** 40 each, and Python's integers are never words of doubles.
    return (lambda a: packed_scores(a, rows)) if words is None else (lambda a: packed_scores(a, rows) if a.dtype == object else words.scores(a.astype(np.float64)))


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of integer matrices, by products of packed words.

    Where doubles hold at least one field, they are the words (``Words``). Otherwise, with b = -min(rows) the biased components lie in 0..r. An anchor's sum over its components a of
    a * (biased component) lies between r times its negative components and r times its positive ones,
    so a field of bits for the largest such span holds it once the negative end is added.
    """
    if not len(rows) or not len(anchors) or not rows.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    if anchors.dtype != object and (words := Words.of(rows, _longest(anchors))):
        return words.scores(anchors.astype(np.float64))
    bias = -int(rows.min())
    reach = int(rows.max()) + bias
    # Sums of a row's components stay within 64 bits: those are below 2 ** 40 where they are not Python's.
    ups, downs = np.where(anchors > 0, anchors, 0).sum(axis=1), np.where(anchors < 0, -anchors, 0).sum(axis=1)
    low = int(downs.max()) * reach
    bits = max(1, (int(ups.max()) * reach + low).bit_length())
    lifted = int(max(ups.max(), downs.max())) * (abs(bias) + 1)
    exact = object not in (anchors.dtype, rows.dtype) and max(bits, lifted.bit_length()) <= MOST_BITS
    kind, fields = (np.uint64, WORD_BITS // bits) if exact else (object, 8)
    shift = (lambda f: np.uint64(f * bits)) if exact else (lambda f: 1 << (f * bits))
    n_words = -(-len(rows) // fields)
    biased = np.zeros((n_words * fields, rows.shape[1]), kind)
    biased[: len(rows)] = rows.astype(np.int64 if exact else object) + bias
    words = np.zeros((n_words, rows.shape[1]), kind)
    for f in range(fields):
        words = words + ((biased[f::fields] << shift(f)) if exact else biased[f::fields] * shift(f))
    # Negative anchor components wrap around in the 64-bit ring; adding ``low`` in every field makes all fields whole again.
    left = anchors.astype(np.int64).view(np.uint64) if exact else anchors.astype(object)
    lift = sum(low << (f * bits) for f in range(fields))
    products = left @ words.T + (np.uint64(lift) if exact else lift)
    out = np.empty((len(anchors), n_words * fields), np.int64 if exact else object)
    mask = (1 << bits) - 1
    for f in range(fields):
        field = ((products >> shift(f)) & np.uint64(mask)).astype(np.int64) if exact else (products // shift(f)) & mask
        out[:, f::fields] = field - low
    return out[:, : len(rows)] - ((ups - downs).astype(out.dtype) * bias)[:, None]


def best_positions(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, highest first, ties by column."""
    n = scores.shape[1]
    if not scores.size or not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    roomy = scores.dtype != object and int(np.abs(scores).max()) < 2 ** (MOST_BITS - n.bit_length())
    keys = (scores if roomy else scores.astype(object)) * n + (n - 1 - np.arange(n))
    least = np.int64(-(2**63)) if roomy else int(keys.min()) - 1
    keys = np.where(allowed, keys, least)
    top = np.sort(np.partition(keys, n - k, axis=1)[:, n - k :] if roomy and k < n else keys, axis=1)[:, ::-1][:, :k]
    row, rank = np.nonzero(top != least)
    return row, (n - 1 - top[row, rank] % n).astype(np.int64)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; a shorter one ends in zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


class Block:
    """Rows (id, label, x) of one Arrow list value; candidates are put in order of their id."""

    def __init__(self, rows: pa.Array):
        self.rows = rows
        self.ids, self.labels = (np.array(rows.field(c).to_pylist(), dtype=object) if not pa.types.is_integer(rows.field(c).type)
                                 else rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        lengths = rows.field("x").value_lengths().to_numpy(zero_copy_only=False)
        self.width = int(lengths.max()) if len(lengths) else 0

    def ordered(self) -> "Block":
        return Block(self.rows.take(pa.array(np.argsort(self.ids, kind="stable"))))

    def by_label(self) -> "Block":
        """In order of the label, and of the id within one."""
        return Block(self.rows.take(pa.array(np.lexsort((_order(self.ids), _order(self.labels))))))

    def integers(self, width: int, scale: float) -> np.ndarray:
        return quantised(matrix(self.rows.field("x"), width), scale)


def _codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same small numbers for equal values of both, in the values' order."""
    codes = np.unique(np.concatenate([left, right]), return_inverse=True)[1]
    return codes[: len(left)], codes[len(left) :]


def _order(values: np.ndarray) -> np.ndarray:
    """Numbers that sort as the values do."""
    return np.unique(values, return_inverse=True)[1] if values.dtype == object else values


class Best:
    """The k best rows of each slot over all blocks so far: the highest scores, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, NEVER)
        self.parts, self.waiting, self.held = [], 0, 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.parts.append((slot, score, ids))
            self.waiting += len(slot)
            if self.waiting > max(self.held, len(self.floor) * self.k):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, score, id) of the best. A full slot's floor is its last score: lower rows cannot enter any more, equal ones can."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)
        slot, score, ids = (np.concatenate(c) for c in zip(*self.parts))
        by = np.lexsort((_order(ids), -_order(score), slot))
        begins = np.searchsorted(slot[by], slot[by])
        by = by[np.arange(len(by)) - begins < self.k]
        slot, score, ids = slot[by], score[by], ids[by]
        if len(slot) >= self.k:
            last = np.flatnonzero(slot[self.k - 1 :] == slot[: len(slot) - self.k + 1]) + self.k - 1
            self.floor[slot[last]] = [min(max(s, int(NEVER)), 2**63 - 1) for s in score[last].tolist()]
        self.parts, self.waiting, self.held = [(slot, score, ids)], 0, len(slot)
        return slot, score, ids


class Anchors:
    """A block of anchors in order of their label, and the best rows found for them so far.

    Without bounds the slots are the anchors, and their rows those of the anchor's label with another id. With bounds
    the slots are the anchors' positives, and their rows those of other labels between the positive's bounds.
    """

    def __init__(self, block: "Block", scale: float, k: int, bounds: tuple[int, int] | None = None):
        self.block = block.by_label()
        self.scale, self.k, self.bounds = scale, k, bounds
        self.x = self.block.integers(self.block.width, scale)
        self.longest = _longest(self.x)
        self.slots = 1
        if bounds:
            found = self.block.rows.field("positives")
            n = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            self.slots = int(n.max()) if len(n) else 0
            has = np.arange(self.slots) < n[:, None]
            own = np.zeros(has.shape, np.int64)
            own[has] = found.flatten().field("score").to_numpy(zero_copy_only=False)
            # low p <= 100 n <= high p, as bounds of n. Without a positive no score is allowed.
            low, high = bounds
            own = own.astype(object)
            self.exact = [np.where(has, -(-low * own // 100), 1), np.where(has, high * own // 100, 0)]
            self.least, self.most = (np.clip(c, int(NEVER) + 1, 2**63 - 1).astype(np.int64) for c in self.exact)
        self.best = Best(len(self.x) * self.slots, k)

    def meet(self, rows: "Block") -> None:
        rows = rows.by_label()
        width = min(self.block.width, rows.width)
        a, c = self.x[:, :width], rows.integers(rows.width, self.scale)[:, :width]
        a_label, c_label = _codes(self.block.labels, rows.labels)
        if self.bounds:
            self._negatives(a, a_label, scorer(c, self.longest), c_label, rows.ids)
        else:
            a_id, c_id = _codes(self.block.ids, rows.ids)
            for label in np.intersect1d(a_label, c_label):
                (i, j), (s, e) = (np.searchsorted(x, [label, label + 1]) for x in (a_label, c_label))
                self._positives(a, a_id, i, j, scorer(c[s:e], self.longest), c_id[s:e], rows.ids[s:e])

    def _positives(self, a, a_id, i, j, score_of, c_id, ids) -> None:
        step = max(1, CELLS // len(ids))
        for start in range(i, j, step):
            stop = min(start + step, j)
            scores = score_of(a[start:stop])
            left, right = np.searchsorted(c_id, a_id[start:stop]), np.searchsorted(c_id, a_id[start:stop], "right")
            allowed = np.ones(scores.shape, bool) if scores.dtype == object else None
            for r in np.flatnonzero(left < right):
                (scores if allowed is None else allowed)[r, left[r] : right[r]] = NEVER if allowed is None else False
            floor = self.best.floor[start:stop]
            row, column = self._above(scores, floor, None) if allowed is None else (None, None)
            if row is None:
                row, column = best_positions(scores, scores != NEVER if allowed is None else allowed, self.k)
            self.best.add(start + row, scores[row, column], ids[column])

    def _negatives(self, a, a_label, score_of, c_label, ids) -> None:
        by_id, step = None, max(1, CELLS // max(1, len(ids)))
        for start in range(0, len(a) if self.slots else 0, step):
            stop = min(start + step, len(a))
            scores = score_of(a[start:stop])
            own = a_label[start:stop]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            allowed = np.ones(scores.shape, bool) if scores.dtype == object else None
            for i, j in zip(begins, [*begins[1:], len(own)]):
                s, e = np.searchsorted(c_label, [own[i], own[i] + 1])
                (scores if allowed is None else allowed)[i:j, s:e] = NEVER if allowed is None else False
            row, numbers = None, range(self.slots)
            if allowed is None:
                floor = self.best.floor.reshape(-1, self.slots)[start:stop]
                least, most = np.maximum(self.least[start:stop], floor), self.most[start:stop]
                for n in numbers if (floor == NEVER).all() else ():
                    least[:, n] = np.maximum(least[:, n], self._kth(scores, most[:, n]))
                some = least <= most
                row, column = self._above(scores, np.where(some, least, 2**63 - 1).min(1), np.where(some, most, NEVER).max(1))
            if row is not None:
                found = scores[row, column]
                for n in numbers:
                    here = (found >= least[row, n]) & (found <= most[row, n])
                    self.best.add((start + row[here]) * self.slots + n, found[here], ids[column[here]])
                continue
            by_id = np.argsort(ids, kind="stable") if by_id is None else by_id
            allowed = scores != NEVER if allowed is None else allowed
            scores, allowed = scores[:, by_id], allowed[:, by_id]
            for n in numbers:
                least, most = ((c[start:stop, n, None]) for c in (self.exact if scores.dtype == object else (self.least, self.most)))
                row, column = best_positions(scores, allowed & (scores >= least) & (scores <= most), self.k)
                self.best.add((start + row) * self.slots + n, scores[row, column], ids[by_id[column]])

    def _kth(self, scores: np.ndarray, most: np.ndarray | None) -> np.ndarray:
        """The k-th best score of some of a row's candidates, a floor of the k-th best of all; NEVER if there are fewer."""
        some = scores[:, :: max(1, scores.shape[1] // SAMPLE)]
        if some.shape[1] < self.k:
            return np.full(len(scores), NEVER)
        some = some if most is None else np.where(some <= most[:, None], some, NEVER)
        return np.partition(some, some.shape[1] - self.k, axis=1)[:, some.shape[1] - self.k]

    def _above(self, scores: np.ndarray, floor: np.ndarray, most: np.ndarray | None) -> tuple:
        """(row, column) of the candidates from their row's floor to its most, or None if those are many."""
        if most is None and (floor == NEVER).any():
            floor = np.maximum(floor, self._kth(scores, None))
        found = scores >= np.maximum(floor, NEVER + 1)[:, None]
        if most is not None:
            found &= scores <= most[:, None]
        flat = np.flatnonzero(found)
        return (None, None) if len(flat) > DENSE * len(scores) else np.divmod(flat, scores.shape[1])


def scanned(batches: Iterator[pa.RecordBatch], begin: Callable[["Block"], Anchors]) -> Iterator[Anchors]:
    """The anchor blocks of (_a, anchors, rows) with what all their blocks of rows gave; a few are kept at a time."""
    held: OrderedDict[int, Anchors] = OrderedDict()
    for batch in batches:
        for number, a, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if number not in held:
                if len(held) >= HELD:
                    yield held.popitem(last=False)[1]
                held[number] = begin(Block(a.values))
            held.move_to_end(number)
            held[number].meet(Block(r.values))
    yield from held.values()


def cut_into_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks ``rows`` of at most ``block_rows`` rows, cut where the rows are scanned: no shuffle, whatever the keys are."""
    kind = f"array<{rows.schema.simpleString()}>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rows = batch.to_struct_array()
            for start in range(0, len(all_rows), block_rows):
                part = all_rows[start : start + block_rows]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["rows"])

    return rows.mapInArrow(cut, f"rows {kind}")


def met(anchors: DataFrame, blocks: DataFrame, anchor_blocks: int, shares: int) -> DataFrame:
    """Every anchor block beside every block of rows; pairs are dealt by anchor block and a share of the blocks."""
    left = anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(anchor_blocks)).cast("int").alias("_a")).agg(
        F.collect_list(F.struct(*anchors.columns)).alias("anchors")).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = blocks.withColumns({
        "_share": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)).cast("int"),
        "_a": F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))})
    return right.join(left, ["_a", "_share"]).select("_a", "anchors", "rows")


def _first(rows: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The k rows of each key with the highest score, then the smallest id. At most k rows a task and key arrive here."""
    order = Window.partitionBy(*keys).orderBy(F.desc("_score"), F.asc("_row"))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = 4096, anchor_rows: int = 4096, blocks_a_share: int = 16,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    A component x counts as floor(scale * x); a score is the inner product with the anchor, the higher
    the better, ties by smaller id. Positives are the first rows of the anchor's label with another
    id, negatives the first rows of another label whose score is ``low`` to ``high`` percent of the
    positive's. Scores are exact; one beyond 64 bits is returned as the nearest 64-bit number.

    Rows take no part if the id, label or vector is NULL, or a component is NULL, NaN or infinite. A
    vector shorter than another ends in zeros; an empty one scores 0. Rows that share an id are all
    candidates; of anchors that share an id only that with the smallest label and vector is one.
    An anchor without positives, or a positive without negatives, has no rows; an empty table gives
    an empty one. Ids and labels may be of any type that can be ordered. Other columns are left out.
    """
    spark = rows.sparkSession
    # ``is_anchor`` may use any of the caller's columns, so it is evaluated before they are left out.
    own = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("x"),
                      F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    sound = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(
        ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    blocks = written(cut_into_blocks(sound.select("id", "label", "x"), block_rows), "candidate-blocks")
    anchors = written(sound.where("asked").groupBy("id").agg(F.min(F.struct("label", "x")).alias("_v")).select("id", "_v.label", "_v.x"), "anchors")
    n_blocks, n_anchors = blocks.count(), anchors.count()
    anchor_blocks = max(1, -(-n_anchors // anchor_rows))
    # A task meets several blocks with the same anchors, as long as there is work for all cores.
    shares = max(1, -(-n_blocks // blocks_a_share), min(n_blocks, -(-2 * spark.sparkContext.defaultParallelism // anchor_blocks)))
    id_kind = dict(anchors.dtypes)["id"]

    def told(score: np.ndarray) -> pa.Array:
        return pa.array([min(max(s, -(2**63)), 2**63 - 1) for s in score.tolist()] if score.dtype == object else score, pa.int64())

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in scanned(batches, lambda block: Anchors(block, scale, positives)):
            slot, score, ids = a.best.settle()
            own = a.block.rows.field("id")
            yield pa.RecordBatch.from_arrays([own.take(pa.array(slot)), pa.array(ids, own.type), told(score)], names=["_anchor", "_row", "_score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in scanned(batches, lambda block: Anchors(block, scale, negatives, (low, high))):
            slot, score, ids = a.best.settle()
            own, slots = a.block.rows.field("id"), max(1, a.slots)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(slot // slots)), pa.array(slot % slots, pa.int32()), pa.array(ids, own.type), told(score)],
                                             names=["_anchor", "_number", "_row", "_score"])

    near = met(anchors, blocks, anchor_blocks, shares).mapInArrow(find_positives, f"_anchor {id_kind}, _row {id_kind}, _score bigint")
    near = _first(near, ["_anchor"], positives, "_place")
    chosen = near.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_place"), F.col("_row").alias("id"), F.col("_score").alias("score")))).alias("positives"))
    asked = written(anchors.join(chosen, F.col("id") == F.col("_anchor")).drop("_anchor"), "anchors-with-positives")
    far = met(asked, blocks, anchor_blocks, shares).mapInArrow(find_negatives, f"_anchor {id_kind}, _number int, _row {id_kind}, _score bigint")
    far = _first(far, ["_anchor", "_number"], negatives, "rank")
    pairs = asked.select(F.col("id").alias("_anchor"), F.posexplode("positives").alias("_number", "_p"))
    return far.join(pairs, ["_anchor", "_number"]).select(
        F.col("_anchor").alias("anchor_id"), F.col("_p.id").alias("positive_id"), "rank", F.col("_row").alias("negative_id"),
        F.col("_p.score").alias("positive_score"), F.col("_score").alias("negative_score"))


OP11_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    key = F.col("vec_id")
    rows = rows.withColumn("label", F.when(key % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint")))
    return hard_negatives(rows, key % 50 == 0)
