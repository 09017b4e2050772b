"""Benchmark decontamination by spaced seeds that tolerate substituted words.

A mask marks the positions of a ten-word window that count; the others may differ. Windows of the
test items and of the documents are hashed under each mask and joined. Around every hit the words
are compared along the diagonal, and the stretch that fits best decides.

Documents are hashed in their tasks. A bit table of fixed greatest size, made from the test hashes,
drops nearly all windows there; what passes is joined exactly, so the table decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.llm import tokens
from keyrhythm.llm.common import packed, unpacked, written
from keyrhythm.llm.registry import query, table

#: 1: the word counts; 0: it may be any. Chosen so that single substitutions seldom hit all masks.
MASKS = ("1101001011", "1110010011", "1011010101", "1100101101")
SPAN = len(MASKS[0])
#: Words kept on both sides of a hit for the comparison.
AROUND = 64
U64 = np.uint64
REGIONS = "_id bigint, _region bigint, _words binary, _at array<int>, _key array<bigint>"


def seeds(hashed: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, document, key) of all windows inside a document, for each mask."""
    n = len(hashed) - SPAN + 1
    if n <= 0:
        return
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + SPAN <= first[document + 1])
    document = document[at]
    factors = tokens.numbers(21, SPAN) | tokens.ONE
    for m, mask in enumerate(MASKS):
        key = np.full(n, tokens.numbers(22, len(MASKS))[m], U64)
        for j, bit in enumerate(mask):
            if bit == "1":
                key += hashed[j : j + n] * factors[j]
        yield at, document, tokens.mixed(key[at])


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, offsets, data in tokens.chunks(column):
        yield lo, *tokens.words(data, offsets, tokens.NOT_ALNUM, tokens.LOWERED)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hashed, first in _words(batch.column(1)):
            packed = [hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(packed)), pa.array(packed, pa.binary())], names=["_item", "_words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, words in zip(batch.column(0), batch.column(1)):
            hashed = np.frombuffer(words.as_buffer(), U64)
            for at, _, key in seeds(hashed, np.array([0, len(hashed)])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), item.as_py())), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64))],
                    names=["_item", "_from", "_key"])


def _probes(key: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return key >> U64(64 - log2_bits), (key & U64(0xFFFFFFFF)) >> U64(32 - log2_bits)


def bit_table(keys: DataFrame, at_least: int = 16, at_most: int = 26) -> np.ndarray:
    """Two bits for each key in a table of at most ``2 ** at_most`` bits (8 MiB), set on the executors."""
    log2_bits = min(at_most, max(at_least, int(512 * max(1, keys.count()) - 1).bit_length()))
    one = F.shiftrightunsigned("_key", 64 - log2_bits)
    two = F.shiftrightunsigned(F.col("_key").bitwiseAND(F.lit(0xFFFFFFFF)), 32 - log2_bits)
    words = keys.select(F.explode(F.array(one, two)).alias("_bit")).groupBy(F.shiftright("_bit", 3).alias("_byte")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(_bit & 7 as int))")).alias("_bits"))
    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    for row in words.toLocalIterator():
        out[row["_byte"]] = row["_bits"]
    return out


def _regions(table_bits):
    """Stretches of document words around windows that pass the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table_bits.value
        log2_bits = int(len(bits) * 8).bit_length() - 1
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hashed, first in _words(batch.column(1)):
                hits = []
                for at, document, key in seeds(hashed, first):
                    left = np.arange(len(key))
                    for side in (0, 1):
                        probe = _probes(key[left], log2_bits)[side]
                        left = left[(bits[(probe >> U64(3)).astype(np.int64)] >> (probe & U64(7)).astype(np.uint8)) & 1 == 1]
                    hits.append((at[left], document[left], key[left]))
                if not hits or not sum(len(h[0]) for h in hits):
                    continue
                at, document, key = (np.concatenate([h[i] for h in hits]) for i in range(3))
                order = np.argsort(at, kind="stable")
                at, document, key = at[order], document[order], key[order]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > AROUND) | (np.diff(document) > 0))))
                out: list[list] = [[], [], [], [], []]
                for a, b in zip(new, [*new[1:], len(at)]):
                    # A long stretch is cut: its pieces overlap by the words around their hits.
                    for c in range(a, b, 2048):
                        d, e = document[c], min(b, c + 2048)
                        start, end = max(first[d], at[c] - AROUND), min(first[d + 1], at[e - 1] + SPAN + AROUND)
                        part, offsets = hashed[start:end], at[c:e] - start
                        told = np.concatenate((part * tokens.mixed(np.arange(1, len(part) + 1, dtype=U64)),
                                               tokens.mixed(key[c:e] + offsets.astype(U64))))
                        name = tokens.mixed(np.array([np.sum(told)], U64))
                        for column, value in zip(out, (ids[lo + d], int(name.view(np.int64)[0]), part.tobytes(), offsets.tolist(),
                                                       key[c:e].view(np.int64).tolist())):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["_id", "_region", "_words", "_at", "_key"])
    return run


def best_stretch(a: np.ndarray, b: np.ndarray, shift: int, penalty: int = 2) -> tuple[int, int, int]:
    """(words that agree, start, end in ``a``) of the stretch with the best balance along one diagonal.

    ``b[j]`` lies at ``a[j + shift]``; an equal word counts 1, a different one ``-penalty``.
    """
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi <= lo:
        return 0, 0, 0
    same = a[lo:hi] == b[lo - shift : hi - shift]
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -penalty))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), lo + start, lo + end


def _verify(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agreed = []
            for region, item, shift in zip(batch.column("_words"), batch.column("_item_words"), batch.column("_shift").to_pylist()):
                a, b = np.frombuffer(region.as_buffer(), U64), np.frombuffer(item.as_buffer(), U64)
                agreed.append(best_stretch(a, b, shift)[0])
            out = pa.RecordBatch.from_arrays([batch.column("_region"), batch.column("_item"), pa.array(agreed, pa.int32())],
                                             names=["_region", "_item", "_agreed"])
            yield out.filter(pa.array([x >= min_words for x in agreed], pa.bool_()))
    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_words: int = 12, salts: int = 16,
) -> DataFrame:
    """``(doc_id, item_id, agreed)``: documents and the items of which they hold a passage.

    Words are runs of ASCII letters and digits and of all other scripts' characters, in lower case.
    A passage is a stretch along which the words of document and item agree, where each substituted
    word must be paid for by two that agree, with at least ``min_words`` in agreement. Items with
    fewer words than a window can't be found. Items with the same words count as one, that with the
    smallest id. NULL or empty texts match nothing; rows that repeat an id share one result. A NULL
    id is reported as NULL. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("bigint"), F.col(item_text)).mapInArrow(_item_words, "_item bigint, _words binary")
    items = written(items.groupBy("_words").agg(F.min("_item").alias("_item")).where("_item IS NOT NULL"), "benchmark-items")
    keys = written(items.select("_item", "_words").mapInArrow(_item_seeds, "_item bigint, _from int, _key bigint"), "benchmark-seeds")
    bits = spark.sparkContext.broadcast(bit_table(keys.select("_key")))
    regions = written(docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(_regions(bits), REGIONS), "seed-regions")

    # Copies of a passage with the same words around it are one region.
    distinct = written(regions.groupBy("_region").agg(*[F.first(c).alias(c) for c in ("_words", "_at", "_key")]), "seed-distinct")
    hits = distinct.select("_region", F.explode(F.arrays_zip("_at", "_key")).alias("h")).select(
        "_region", F.col("h._at").alias("_at"), F.col("h._key").alias("_key"), F.pmod(F.hash("_region"), F.lit(salts)).alias("_salt"))
    salted = keys.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    diagonals = hits.join(salted, ["_key", "_salt"]).select("_region", "_item", (F.col("_at") - F.col("_from")).alias("_shift")).distinct()
    both = diagonals.join(distinct.select("_region", "_words"), "_region").join(
        items.withColumnRenamed("_words", "_item_words"), "_item")
    found = both.select("_region", "_item", "_shift", "_words", "_item_words").mapInArrow(_verify(min_words), "_region bigint, _item bigint, _agreed int")
    found = found.groupBy("_region", "_item").agg(F.max("_agreed").alias("_agreed"))
    of = regions.select("_id", "_region").distinct().join(found, "_region")
    return of.groupBy(F.col("_id").alias(doc_id), F.col("_item").alias(item_id)).agg(F.max("_agreed").alias("agreed"))


def with_contamination(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """All columns of ``docs`` plus ``contaminated``, ``n_items``, ``first_item`` and ``agreed`` (the most)."""
    per_doc = found.groupBy(F.col(doc_id).alias("_id")).agg(
        F.count(F.lit(1)).alias("n_items"), F.min(item_id).alias("first_item"), F.max("agreed").alias("agreed"))
    out = packed(docs, ["contaminated", "n_items", "first_item", "agreed"], _doc=doc_id)
    out = out.join(per_doc, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    return unpacked(out, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", "agreed")


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = written(contamination(docs, table(spark, folder, "benchmark")), "contamination")
    out = with_contamination(docs.select("doc_id"), found)
    return out.select("doc_id", "contaminated", "n_items", "first_item", "agreed")
