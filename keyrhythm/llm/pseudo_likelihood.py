"""LM scoring by masked pseudo-likelihood: every word is predicted from the words on both sides.

Word counts over the whole corpus give the vocabulary: the most frequent words are classes of their
own, the others share classes by hash, and inside a class a word has its share of the class's count.
A small window network predicts the class from the two words before and the two behind. It is
trained in rounds that share the documents: each task starts from the same weights, takes gradient steps
on every word of its own documents, and the weighted mean of all tasks' weights, summed as a tree on the
executors, starts the next round. After the last round every word has been trained on. What is counted, trained on and scored is the whole corpus. Words are told from the
texts twice, to count them and to write their classes, which the rounds and the scores then read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.llm import tokens
from keyrhythm.llm.common import written
from keyrhythm.llm.registry import query, table

U64 = np.uint64
SIDES = (-2, -1, 1, 2)
SLOTS = 1 << 16


class Vocabulary:
    """Class and share of each word, from tables of fixed size.

    ``frequent``: hashes of the words with classes of their own. ``slots``: counts of all other words by
    hash slot. A slot stands for one class, so a word's share is that of its slot.
    """

    def __init__(self, frequent: np.ndarray, slots: np.ndarray, classes: int):
        order = np.argsort(frequent)
        self.frequent, self.own = frequent[order], np.arange(len(frequent))[order]
        self.classes, self.shared = classes, classes - 1 - len(frequent)
        self.first = len(frequent)
        by_class = np.bincount(np.arange(SLOTS) % self.shared, weights=slots + 1.0, minlength=self.shared)
        self.share = np.log((slots + 1.0) / by_class[np.arange(SLOTS) % self.shared]).astype(np.float32)

    def classify(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, log share in the class)."""
        slot = (hashed >> U64(48)).astype(np.int64)
        out, share = self.first + slot % self.shared, self.share[slot]
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, hashed), len(self.frequent) - 1)
            hit = self.frequent[at] == hashed
            out, share = np.where(hit, self.own[at], out), np.where(hit, np.float32(0), share)
        return out, share


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(hash, n)`` over all documents; each task adds up its batches' words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in tokens.chunks(batch.column(0)):
                found, n = np.unique(tokens.words(data, offsets, fold=tokens.LOWERED)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.select(text).mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, classes: int, own: int) -> Vocabulary:
    """``own`` words and ``SLOTS`` sums come to the driver, however large the corpus is."""
    counts = written(counts, "word-counts")
    top = counts.orderBy(F.desc("n"), "hash").limit(own).collect()
    frequent = np.array([r["hash"] for r in top], np.int64).view(U64)
    slot = F.shiftrightunsigned("hash", 48).alias("slot")
    names = counts.sparkSession.createDataFrame([(r["hash"],) for r in top], "hash bigint")
    slots = np.zeros(SLOTS)
    for r in counts.join(F.broadcast(names), "hash", "left_anti").groupBy(slot).agg(F.sum("n").alias("n")).collect():
        slots[r["slot"]] = r["n"]
    return Vocabulary(frequent, slots, classes)


class Network:
    """Embeddings of the four neighbours, one hidden layer, a softmax over the classes. float32."""

    def __init__(self, classes: int, width: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        self.weights = [draw(classes, width) * np.float32(np.sqrt(classes)) * np.float32(0.3), draw(len(SIDES) * width, hidden),
                        np.zeros(hidden, np.float32), draw(hidden, classes) * np.float32(0.1), np.zeros(classes, np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, w in enumerate(self.weights):
            self.weights[i] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def _hidden(self, sides: np.ndarray) -> np.ndarray:
        """The hidden layer. Each side's part of the first layer is a table with a row for each class."""
        emb, w1, b1, _, _ = self.weights
        width = emb.shape[1]
        h = b1 + (emb @ w1[:width])[sides[:, 0]]
        for k in range(1, len(SIDES)):
            h += (emb @ w1[k * width : (k + 1) * width])[sides[:, k]]
        return np.tanh(h, out=h)

    def forward(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden layer, probabilities, log probabilities) for rows of neighbour classes."""
        w2, b2 = self.weights[3:]
        h = self._hidden(sides)
        z = h @ w2
        z += b2
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        p /= total
        z -= np.log(total)
        return h, p, z

    def step(self, sides: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step on the mean negative log probability."""
        emb, w1, b1, w2, b2 = self.weights
        (classes, width), n = emb.shape, len(target)
        h, dz, _ = self.forward(sides)
        dz[np.arange(n), target] -= 1
        dz /= n
        dh = (dz @ w2.T) * (1 - h * h)
        # The slope of each side's table: the rows of one class summed.
        cell = (sides + np.arange(len(SIDES)) * classes).T.ravel().astype(np.int32)
        order = np.argsort(cell, kind="stable")
        found = cell[order]
        start = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        tables = np.zeros((len(SIDES) * classes, dh.shape[1]), dh.dtype)
        tables[found[start]] = np.add.reduceat(dh[order % n], start, axis=0)
        demb = np.zeros_like(emb)
        for k in range(len(SIDES)):
            part, own = tables[k * classes : (k + 1) * classes], slice(k * width, (k + 1) * width)
            demb += part @ w1[own].T
            w1[own] -= rate * (emb.T @ part)
        w2 -= rate * (h.T @ dz)
        b2 -= rate * dz.sum(axis=0)
        b1 -= rate * dh.sum(axis=0)
        emb -= rate * demb


def neighbours(classes: np.ndarray, first: np.ndarray, edge: int) -> np.ndarray:
    """Classes of the words on both sides of each word; ``edge`` beyond the document."""
    n = len(classes)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, len(SIDES)), edge, np.int64)
    at = np.arange(n)
    for k, side in enumerate(SIDES):
        there = at + side
        inside = (there >= first[document]) & (there < first[document + 1])
        out[inside, k] = classes[there[inside]]
    return out


def _classified(column: pa.Array, vocabulary: Vocabulary):
    for _, _, offsets, data in tokens.chunks(column):
        hashed, first = tokens.words(data, offsets, fold=tokens.LOWERED)
        yield first, *vocabulary.classify(hashed)


#: Words that are worked on together.
PIECE = 1 << 17


def coded(docs: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, classes, share)``: the classes of a text's words, packed, and the sum of their log shares."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = _packed_type(vocabulary.classes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            at = 0
            for first, classes, share in _classified(batch.column(1), known):
                packed = classes.astype(kind)
                running = np.concatenate(([0.0], np.cumsum(share, dtype=np.float64)))
                column = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [
                    None, pa.py_buffer(first.astype(np.int64) * packed.itemsize), pa.py_buffer(packed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(first) - 1), column, pa.array(running[first[1:]] - running[first[:-1]])],
                                                 names=[doc_id, "classes", "share"])
                at += len(first) - 1

    named = docs.select(doc_id, text)
    return named.mapInArrow(encode, f"{doc_id} {named.schema[doc_id].dataType.simpleString()}, classes binary, share double")


def _packed_type(classes: int):
    return np.uint8 if classes <= 1 << 8 else np.uint16 if classes <= 1 << 16 else np.uint32


def _unpacked(column: pa.Array, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of each document's first word, classes) of whole documents, about ``PIECE`` words at a time."""
    kind = np.dtype(_packed_type(classes))
    for _, _, offsets, data in tokens.chunks(column, PIECE * kind.itemsize):
        yield offsets // kind.itemsize, np.frombuffer(data.tobytes(), kind)


def _pieces(classes: np.ndarray, first: np.ndarray, edge: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first word, word after the last, neighbours) of all words, ``PIECE`` at a time, however long a document is."""
    reach = max(SIDES)
    for lo in range(0, len(classes), PIECE):
        hi = min(lo + PIECE, len(classes))
        near = slice(max(0, lo - reach), min(hi + reach, len(classes)))
        borders = np.clip(first - near.start, 0, near.stop - near.start)
        yield lo, hi, neighbours(classes[near], borders, edge)[lo - near.start : hi - near.start]


def _train_part(network: Network, start, rate: float, batch_words: int):
    """A task's own steps from the shared weights, on every word: rows of (words, weights times words), as float64 bytes."""
    classes = len(network.weights[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network.load(start.value)
        trained = 0
        for batch in batches:
            for first, found in _unpacked(batch.column(0), classes):
                for begin, end, sides in _pieces(found, first, classes - 1):
                    for lo in range(begin, end, batch_words):
                        hi = min(lo + batch_words, end)
                        network.step(sides[lo - begin : hi - begin], found[lo:hi], rate)
                        trained += hi - lo
        if trained:
            yield pa.RecordBatch.from_arrays([pa.array([trained]), pa.array([(network.flat().astype(np.float64) * trained).tobytes()], pa.binary())], names=["n", "w"])
    return run


def train(words: DataFrame, network: Network, rounds: int, rate: float, batch_words: int) -> Network:
    """A pass over every word of the ``coded`` documents, each of which belongs to one of the ``rounds``."""
    spark = words.sparkSession
    for r in range(rounds):
        start = spark.sparkContext.broadcast(network.flat())
        own = words.where(F.pmod(F.xxhash64("classes"), F.lit(rounds)) == r).select("classes")
        parts = own.mapInArrow(_train_part(network, start, rate / (1 + r), batch_words), "n bigint, w binary")
        add = lambda a, b: (a[0] + b[0], (np.frombuffer(a[1]) + np.frombuffer(b[1])).tobytes())
        n, total = parts.rdd.map(lambda row: (row["n"], bytes(row["w"]))).treeAggregate(
            (0, b""), lambda a, b: add(a, b) if a[0] else b, lambda a, b: add(a, b) if a[0] and b[0] else (a if a[0] else b), depth=3)
        if n:
            network.load(np.frombuffer(total) / n)
        start.unpersist()
    return network


def pseudo_likelihood(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = 128, own: int = 63, width: int = 16, hidden: int = 24,
    rounds: int = 2, rate: float = 0.5, batch_words: int = 512,
) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` for each row of ``docs``.

    The log-likelihood sums, over all words of the text, the log probability of the word given the two
    on each side. Words are separated by white space, A-Z in lower case. A NULL or empty text has no
    words, sum 0 and no mean. Repeated rows each count and are scored alike; NULL ids stay NULL; other
    columns are left out. An empty table gives an empty one. Weights are means over tasks, so scores of
    runs with other partitions differ a little.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    vocabulary = build_vocabulary(count_words(slim, "_text"), classes, own)
    words = written(coded(slim, "_id", "_text", vocabulary), "word-classes")
    network = train(words, Network(classes, width, hidden), rounds, rate, batch_words)
    weights = spark.sparkContext.broadcast(network.flat())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(classes, width, hidden)
        model.load(weights.value)
        for batch in batches:
            n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
            for first, found in _unpacked(batch.column(1), classes):
                p = np.empty(len(found))
                for begin, end, sides in _pieces(found, first, classes - 1):
                    for lo in range(begin, end, 1024):
                        hi = min(lo + 1024, end)
                        z = model.forward(sides[lo - begin : hi - begin])[2]
                        p[lo:hi] = z[np.arange(hi - lo), found[lo:hi]]
                running = np.concatenate(([0.0], np.cumsum(p)))
                n.append(np.diff(first))
                total.append(running[first[1:]] - running[first[:-1]])
            likelihood = np.concatenate(total) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(likelihood)], names=["_id", "n_words", "log_likelihood"])

    kind = slim.schema["_id"].dataType.simpleString()
    out = words.mapInArrow(score, f"_id {kind}, n_words bigint, log_likelihood double")
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select(F.col("_id").alias(doc_id), "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


@query("op6_pseudo_likelihood")
def op6_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    out = pseudo_likelihood(table(spark, folder, "documents"))
    return out.withColumns({c: F.round(c, 3) for c in ("log_likelihood", "mean_log_likelihood")})
