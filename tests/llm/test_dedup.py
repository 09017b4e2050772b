"""Line dedup and near-dedup against brute force."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyrhythm.llm import near_dedup
from keyrhythm.llm.components import components
from keyrhythm.llm.line_dedup import drop_repeated_lines
from keyrhythm.llm.near_dedup import near_duplicates, one_of_each
from odd import SCHEMA, no_docs, odd_docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    return {i: "\n".join(x for x in (text or "").split("\n") if key(x) not in gone or gone[key(x)] == i) for i, text in docs}


def line_docs():
    rng = random.Random(1)
    shared = [prose(i, 12) for i in range(6)]
    return [(i, "\n".join(rng.choice([prose(1000 + i, 9), rng.choice(shared), "  " + rng.choice(shared).upper() + "\t", "short", ""]) for _ in range(8)))
            for i in range(60)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines_as_by_brute_force(spark, batches, fanout):
    docs = line_docs()
    out = drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), batches=batches, fanout=fanout, buckets=3)
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs)


def test_lines_of_odd_documents(spark):
    out = drop_repeated_lines(odd_docs(spark))
    got = out.collect()
    assert len(got) == 11 and out.columns == [*[c for c in SCHEMA.names if c != "n_lines"], "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r.n_lines) for r in got if r.doc_id in (1, 2)} == {(1, "", 1), (2, "", 1)}
    assert all(r["_id"] == "x" and r["_row"] == "x" for r in got)
    assert drop_repeated_lines(no_docs(spark)).count() == 0


def test_repeated_rows_keep_and_null_ids_lose(spark):
    line = prose(5, 20)
    docs = [(None, line), (1, line), (2, line), (3, line), (9, line), (9, line)]
    got = drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), buckets=2).collect()
    assert sorted((r.doc_id or 0, r.text != "") for r in got) == [(0, False), (1, False), (2, False), (3, False), (9, True), (9, True)]


def shingle_set(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(docs, percent):
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def near_docs(n_base=12, per=14, seed=3):
    rng = random.Random(seed)
    out, i = [], 0
    for b in range(n_base):
        base = prose(b, rng.choice([3, 30, 90, 160])).split()
        for _ in range(per):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            out.append((i * 7 % 1009, rng.choice([" ".join(words), " ".join(words).upper(), "\n".join(words)])))
            i += 1
    return out


@pytest.mark.parametrize("percent,limit,depth", [(85, 2048, 12), (80, 4, 12), (80, 4, 1)])
def test_components_as_by_brute_force(spark, percent, limit, depth):
    """Small limits force branching, and depth 1 the comparison in blocks."""
    docs = near_docs()
    out = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=percent, node_limit=limit, max_depth=depth).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(docs, percent)
    assert all(r.kept == (r.component_id == r.doc_id) for r in out)
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(shingle_set(t)) for i, t in docs}


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_docs(spark)
    got = near_duplicates(docs).collect()
    assert len(got) == 11
    told = {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in got}
    assert {(1, False, 1, True), (2, False, 2, True), (3, False, 3, True), (4, True, 4, True), (6, True, 6, True), (9, True, 6, False),
            (None, True, None, True)} <= told
    kept = one_of_each(docs, near_duplicates(docs))
    assert kept.columns == SCHEMA.names
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [-5, 1, 2, 3, 4, 5, 6, 8]
    assert kept.where("doc_id is null").count() == 1
    assert near_duplicates(no_docs(spark)).count() == 0


def test_null_id_joins_its_component(spark):
    docs = spark.createDataFrame(rows([(None, prose(1, 60), "en", "a"), (4, prose(1, 60), "en", "a")]), SCHEMA)
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [(0, 4, False), (4, 4, True)]


def test_shingles_hash_alike_in_any_batch():
    texts = [prose(i, 1 + i * 7) for i in range(30)]
    whole = {}
    for lo, values, borders in near_dedup.shingles(pa.array(texts), 5):
        for k in range(len(borders) - 1):
            whole[lo + k] = values[borders[k] : borders[k + 1]].tolist()
    for i, t in enumerate(texts):
        (_, values, borders), = near_dedup.shingles(pa.array([t]), 5)
        assert values.tolist() == whole[i] and len(values) == len(shingle_set(t))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint").select(F.col("a"), "b")).count() == 0
