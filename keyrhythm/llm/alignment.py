"""Alignment of two tokenizers over the same texts, on Arrow arrays.

Both tokenizations of a text cover the same bytes. Lists of token ids are flattened, byte lengths
summed up to the place where each token ends, counted through the documents of a chunk, so that one
number stands for a document and an end. A hash join of both sides on it gives all places where a
token of either side ends, and those where both do, which cut the tokens into groups. Between two
neighbouring places lies exactly one token of each side: every place is one link.

Corpus-wide counts of linked ids are summed per batch of rows first and merged by Spark.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keyrhythm.llm.common import written
from keyrhythm.llm.registry import query, table

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that are aligned at a time; a longer text is aligned alone.
CHUNK = 1 << 20
#: The split pattern of the byte-level vocabulary, and the mark for a space in pieces.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"
#: One segment of a text that starts with a space: spaces and what follows them up to the next space.
SEGMENT = re.compile(r" *[^ ]+| +\Z")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A byte-level vocabulary file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["content"] for t in told.get("added_tokens", [])}
        letters = byte_letters()
        ids = {token: i for token, i in told["model"]["vocab"].items() if token not in special}
        ranks = {bytes(letters[c] for c in token): i for token, i in ids.items()}
        self.encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokens = [b""] * (1 + max(told["model"]["vocab"].values()))
        for token, i in ranks.items():
            self.tokens[i] = token

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, a space put before each, and how many each has."""
        found = [self.encode(" " + text) for text in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts


class PieceTokenizer:
    """A piece model with byte fallback, which itself puts a space before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id(MARK)
        # Where no piece goes on into the next space, each segment is encoded as if it stood alone.
        self.by_segment = not any(MARK in p.lstrip(MARK) for p in pieces)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_segment:
            found = self.model.encode(texts, num_threads=1)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts
        split = [SEGMENT.findall(" " + text) for text in texts]
        n_segments = np.fromiter(map(len, split), np.int64, len(split))
        coded = pc.dictionary_encode(pa.array(itertools.chain.from_iterable(split), pa.large_string(), size=int(n_segments.sum())))
        each = self.model.encode([s[1:] for s in coded.dictionary.to_pylist()], num_threads=1)
        lists = pa.array([ids or [self.space] for ids in each], pa.large_list(pa.int32())).take(coded.indices)
        upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        counts = np.diff(upto[np.concatenate([[0], np.cumsum(n_segments)])])
        return lists.flatten().to_numpy(), counts


@lru_cache(maxsize=2)
def tokenizers(folder: str, byte_file: str, piece_file: str) -> tuple[ByteTokenizer, PieceTokenizer, "Told"]:
    left, right = ByteTokenizer(f"{folder}/{byte_file}"), PieceTokenizer(f"{folder}/{piece_file}")
    return left, right, Told(left, right)


class Told:
    """Tokens as bytes, and ids as text with what follows them: inside a group, or at the end of its part."""

    def __init__(self, left: ByteTokenizer, right: PieceTokenizer):
        self.tokens = [pa.array(side.tokens, pa.large_binary()) for side in (left, right)]
        self.lengths = [np.array([len(t) for t in side.tokens], np.int64) for side in (left, right)]
        self.second = 2 * len(left.tokens)
        self.written = pa.array([f"{i}{end}" for side, last in ((left, "|"), (right, ";")) for i in range(len(side.tokens)) for end in (",", last)], pa.large_string())


def joined(tokens: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of all tokens, one after the other."""
    taken = tokens.take(pa.array(ids)).buffers()[2]
    return taken.to_pybytes() if taken else b""


def same_bytes(told: Told, texts: list[bytes], sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which texts both sides' tokens spell byte for byte."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.ones(len(texts), bool)
    whole = b"".join(texts)
    for tokens, lengths, (ids, counts) in zip(told.tokens, told.lengths, sides):
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        out &= np.diff(ends) == sizes
        spelt = joined(tokens, ids)
        if spelt != whole:
            for i in np.flatnonzero(out):
                out[i] = spelt[ends[i] : ends[i + 1]] == texts[i]
    return out


def kept(ids: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids, counts) if good.all() else (ids[np.repeat(good, counts)], counts[good])


def aligned(told: Told, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray | list]:
    """Links, groups and their written form of texts whose tokens spell the same bytes on both sides."""
    ends = [np.cumsum(told.lengths[side][ids]) for side, (ids, _) in enumerate((a, b))]
    doc_ends = ends[0][np.cumsum(a[1]) - 1]
    left, right = (pa.table({"end": end, side: pa.array(ids)}) for end, side, (ids, _) in zip(ends, "ab", (a, b)))
    places = left.join(right, keys="end", join_type="full outer", use_threads=False).combine_chunks()
    places = places.take(pa.array(np.argsort(places["end"].to_numpy())))
    has_a, has_b = (places[c].is_valid().to_numpy() for c in "ab")
    # Up to an end, the token there is the next one that ends; at a text's end both sides have one.
    link_a, link_b = (pc.fill_null_backward(places[c]).to_numpy() for c in "ab")
    doc = np.searchsorted(doc_ends, places["end"].to_numpy())
    cut = has_a & has_b
    group = np.cumsum(cut) - cut
    upto_a, upto_b = np.cumsum(has_a)[cut], np.cumsum(has_b)[cut]
    # A group's part of the first side stands before its part of the second.
    at_a = np.arange(len(a[0])) + np.concatenate([[0], upto_b])[group[has_a]]
    at_b = np.arange(len(b[0])) + upto_a[group[has_b]]
    order = np.empty(len(a[0]) + len(b[0]), np.int64)
    order[at_a] = 2 * a[0].astype(np.int64) + cut[has_a]
    order[at_b] = told.second + 2 * b[0].astype(np.int64) + cut[has_b]
    taken = told.written.take(pa.array(order))
    text, offsets = memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int64)
    last = offsets[np.concatenate([[0], np.cumsum(a[1] + b[1])])]
    n_docs = len(doc_ends)
    pair = (doc * len(told.lengths[0]) + link_a) * len(told.lengths[1]) + link_b
    pair.sort()
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    rest, pair_b = np.divmod(pair[first], len(told.lengths[1]))
    pair_doc, pair_a = np.divmod(rest, len(told.lengths[0]))
    return {
        "n_groups": np.bincount(doc[cut], minlength=n_docs), "n_links": np.bincount(doc, minlength=n_docs),
        "digest": [hashlib.sha256(text[start : end - 1]).hexdigest() for start, end in zip(last[:-1], last[1:])],
        "n_pairs": np.bincount(pair_doc, minlength=n_docs), "a": pair_a.astype(np.int32), "b": pair_b.astype(np.int32),
        "times": np.diff(np.append(first, len(pair))).astype(np.int32),
    }


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<a:int,b:int,times:int>>"


def align_chunk(texts: list[str], left: ByteTokenizer, right: PieceTokenizer, told: Told) -> list[pa.Array]:
    """The columns ``ALIGNED`` of some texts."""
    full = np.array([bool(t) for t in texts], bool)
    some = [t for t in texts if t]
    a, b = (side(some) if some else (np.empty(0, np.int32), np.empty(0, np.int64)) for side in (left, right))
    good = same_bytes(told, [b" " + t.encode() for t in some], [a, b])
    a, b = kept(*a, good), kept(*b, good)
    full[full] = good
    columns = {n: np.zeros(len(texts), np.int64) for n in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
    digests, pairs = np.full(len(texts), "", object), pa.array([], PAIR)
    if full.any():
        found = aligned(told, a, b)
        columns["n_a"][full], columns["n_b"][full] = a[1], b[1]
        for name in ("n_groups", "n_links", "n_pairs"):
            columns[name][full] = found[name]
        digests[full] = found["digest"]
        pairs = pa.StructArray.from_arrays([pa.array(found[c]) for c in ("a", "b", "times")], fields=list(PAIR))
    offsets = pa.array(np.concatenate([[0], np.cumsum(columns.pop("n_pairs"))]), pa.int32())
    return [*map(pa.array, columns.values()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(offsets, pairs)]


def chunked(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > CHUNK:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def align_texts(docs: DataFrame, folder: str, byte_file: str, piece_file: str) -> DataFrame:
    """(_row, _text) rows to (_row, ``ALIGNED``) rows."""
    kind = docs.schema["_row"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, told = tokenizers(folder, byte_file, piece_file)
        names = ["_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
        for batch in batches:
            column = batch.column("_text")
            for start, end in chunked(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = [t or "" for t in column[start:end].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_row")[start:end], *align_chunk(texts, left, right, told)], names=names)
                # What a chunk needed is given back to the machine, not kept for the next one.
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(align, f"_row {kind}, {ALIGNED}")


def pair_counts(aligned_docs: DataFrame, most_held: int = 1 << 20) -> DataFrame:
    """(a, b, docs): in how many rows the ids are linked. Counted per batch in the tasks, merged by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            pairs = batch.column(0).flatten()
            part = pa.table({"a": pairs.field("a"), "b": pairs.field("b")}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            part = part.select(["a", "b", "count_all"]).rename_columns(["a", "b", "docs"])
            held = part if held is None else pa.concat_tables([held, part]).group_by(["a", "b"], use_threads=False).aggregate(
                [("docs", "sum")]).select(["a", "b", "docs_sum"]).rename_columns(["a", "b", "docs"])
            if held.num_rows > most_held:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    partial = aligned_docs.select("pairs").mapInArrow(count, "a int, b int, docs bigint")
    return partial.groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def align_tokenizers(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, byte_file: str = "byte_bpe_50k.json",
    piece_file: str = "piece_bpe_32k.model", most_broadcast: int = 1_000_000,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and the linked id ``pairs`` of each row.

    A row's text is a document. NULL and empty texts, and texts that the tokens of a side do not
    spell byte for byte, have zeros, an empty digest and no pairs. Rows are not told apart by their
    id: repeated rows are as many documents, and ids may be NULL. Other columns are left out. An
    empty table gives an empty one. A text is aligned as a whole in one task, texts in chunks.

    Counts of id pairs are broadcast for at most ``most_broadcast`` pairs. If there are more, those
    are broadcast that make up at least one in ``most_broadcast`` of all linked pairs, of which there
    cannot be more than that; none of the others is frequent, and they are joined by a shuffle.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("at"), F.col(f"`{doc_id}`").alias("id")).alias("_row"),
                       F.col(f"`{text}`").alias("_text"))
    found = written(align_texts(rows, folder, byte_file, piece_file), "aligned")
    counts = written(pair_counts(found), "pair-counts")
    best = F.col("docs") == F.max("docs").over(Window.partitionBy("a"))
    told = counts.select(_pair().alias("_pair"), "docs", best.cast("int").alias("_best"))
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("links")).first()
    linked = found.select(F.col("_row.at").alias("_at"), F.explode("pairs").alias("_p")).select("_at", _pair("_p.").alias("_pair"), "_p.times")
    if size["n"] <= most_broadcast:
        met = linked.join(F.broadcast(told), "_pair")
    else:
        told = written(told, "pairs-told")
        frequent = F.col("docs") * most_broadcast >= size["links"]
        often = F.broadcast(told.where(frequent))
        met = linked.join(often, "_pair").unionByName(linked.join(often, "_pair", "left_anti").join(told.where(~frequent), "_pair"))
    sums = met.groupBy("_at").agg(F.sum(F.col("times") * F.col("_best")).alias("_n_best"), F.sum(F.col("times") * F.col("docs")).alias("_count_sum"))
    zero = F.lit(0).cast("bigint")
    return found.join(sums, F.col("_row.at") == F.col("_at"), "left").select(
        F.col("_row.id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", F.coalesce("_n_best", zero).alias("n_best"),
        F.coalesce("_count_sum", zero).alias("count_sum"), "groups_sha256", "pairs")


def _pair(of: str = ""):
    """Both ids in one number."""
    return F.shiftleft(F.col(f"{of}a").cast("bigint"), 32) + F.col(f"{of}b")


@query("op13_align_tokenizers")
def op13_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenizers(table(spark, folder, "documents")).drop("pairs")
