"""Quality rules, mixing, decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from keyrhythm.llm import outliers
from keyrhythm.llm.decontaminate import best_stretch, contamination, with_contamination
from keyrhythm.llm.mixing import mix_sources
from keyrhythm.llm.outliers import COUNTS, FLOORS, UNIT, mark_outliers, text_counts
from odd import SCHEMA, no_docs, odd_docs, odd_rows, prose, rows
from test_dedup import brute_components, brute_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered, seen, dup, lines = Counter(windows), set(), set(), 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update((i, i + 1, i + 2))
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    loud = sum(c == "!" or "A" <= c <= "Z" for c in text)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), lines, loud)


def test_counts_as_by_brute_force():
    rng = random.Random(4)
    texts = [None, "", " ", "a b c a b c", "x\n\nx\n \nx", "\xa0é ü\tb", "a a a a", prose(1, 50000), *[r[1] for r in odd_rows()]]
    texts += ["".join(rng.choice("ab #!A\n\t\x1fé") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = text_counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[c].tolist() for c in COUNTS))) == [brute_counts(t) for t in texts]
    assert all(len(v) == 0 for v in text_counts(pa.array([], pa.string())).values())


def test_an_outlier_goes_and_its_group_stays(spark):
    rng = random.Random(2)
    given = [(i, prose(i, rng.randrange(60, 300)), rng.choice(["en", "fr"]), "a") for i in range(240)]
    given += [(1000 + i, " ".join(w + "###" for w in prose(5000 + i, 120).split()), "en", "a") for i in range(10)]
    out = mark_outliers(spark.createDataFrame(rows(given), SCHEMA)).collect()
    assert {r.doc_id for r in out if not r.kept} == {1000 + i for i in range(10)} and not any(r.base_failed for r in out)
    # The same estimate, with sorted distances instead of counted ranges.
    for lang in ("en", "fr"):
        group = [r for r in out if r.lang == lang]
        n, chars = np.array([max(r.n_words, 1) for r in group], float), np.array([max(int(c), 1) for c in (brute_counts(r.text)[1] for r in group)], float)
        cols = [np.log1p(n), np.log(chars / n), np.log1p(np.array([r.n_symbols for r in group]) / n),
                np.array([r.n_dup_lines / max(int(r.n_lines), 1) for r in group]), np.array([r.n_repeat_words for r in group]) / n,
                np.array([r.n_loud for r in group]) / chars]
        x = np.round(np.stack(cols, 1) * UNIT) / UNIT
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        centre, inverse = q[1], np.diag(1 / np.maximum((q[2] - q[0]) / 1.349, FLOORS) ** 2)
        for _ in range(4):
            d2 = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
            near = x[np.argsort(d2)[: int(0.75 * len(x)) + 1]]
            cov = np.cov(near.T, bias=True) * max(1.0, np.median(d2) / outliers.CHI2_MEDIAN_6)
            centre, inverse = near.mean(axis=0), np.linalg.inv(cov + np.diag(np.square(FLOORS)))
        want = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        got = np.array([r.distance for r in group])
        assert np.corrcoef(want, got)[0, 1] > 0.99 and np.median(np.abs(want - got) / (1 + want)) < 0.15


def test_rules_on_odd_documents(spark):
    out = mark_outliers(odd_docs(spark))
    got = out.collect()
    assert len(got) == 11 and out.columns[: 5] == SCHEMA.names[:5]
    failed = {(r.doc_id, r.base_failed) for r in got}
    assert {(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (None, False), (8, True)} <= failed
    assert all(not (r.base_failed and r.kept) for r in got)
    assert mark_outliers(no_docs(spark)).count() == 0


def test_mix_meets_each_budget(spark):
    rng = random.Random(5)
    given = [(i if i % 40 else None, rng.choice(["a", "b", "c", "Z", None]) if i % 3 else "a", rng.randrange(0, 90)) for i in range(1500)]
    frame = spark.createDataFrame([(*g, "x") for g in given], "doc_id bigint, source string, size bigint, _key string")
    got = mix_sources(frame).collect()
    assert len(got) == 1500 and all(r["_key"] == "x" for r in got)
    have, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        have[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert r.epochs * r.size <= r.taken <= min(3, r.epochs + 1) * r.size
    assert all(r.source_size == have[r.source] for r in got)
    assert {s: int(t) for s, t in target.items()} == dict(taken)
    weights = dict(zip(sorted(have, key=lambda s: (s is None, s)), [1, 2, 3, 1, 2]))
    wanted, open_ = {}, set(have)
    while True:
        left = sum(have.values()) - sum(wanted.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * have[s]}
        if not over:
            wanted |= share
            break
        wanted |= {s: 3 * have[s] for s in over}
        open_ -= over
    assert all(abs(wanted[s] - target[s]) < 1e-6 for s in have)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(frame.repartition(7)).collect()))


def test_mix_of_nothing(spark):
    schema = "doc_id bigint, source string, size bigint"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, "a", 0), (2, None, 0)], schema)).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 2


def fold(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(docs, items, least=12):
    out = set()
    for d, text in docs:
        a = np.array([hash(w) for w in fold(text)])
        for item, other in items:
            b = np.array([hash(w) for w in fold(other)])
            if any(best_stretch(a, b, s)[0] >= least for s in range(-len(b) + 1, len(a))):
                out.add((d, item))
    return out


def leak_case():
    rng = random.Random(8)
    items = [(i, prose(900 + i, rng.randrange(15, 60))) for i in range(12)]
    docs = []
    for i in range(60):
        words = prose(i, rng.randrange(20, 150)).split()
        if i % 2:
            passage = items[rng.randrange(12)][1].split()
            if i % 3 == 0:
                for at in range(rng.randrange(3, 8), len(passage), rng.randrange(6, 11)):
                    passage[at] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if i % 5 == 0 else w + "," for w in passage]
        docs.append((i, " ".join(words)))
    return docs, items


def test_leaks_as_by_brute_force(spark):
    docs, items = leak_case()
    found = contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got, want = {(r.doc_id, r.item_id) for r in found.collect()}, brute_leaks(docs, items)
    assert got <= want and len(want) > 25
    assert {d for d, _ in got} == {d for d, _ in want}


def test_leaks_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, prose(6, 40)), (4, prose(6, 40)), (None, "a b")], "item_id bigint, text string")
    docs = odd_docs(spark)
    found = contamination(docs, bench)
    assert {(r.doc_id, r.item_id, r.agreed) for r in found.collect()} == {(6, 3, 40), (9, 3, 40)}
    marked = with_contamination(docs, found)
    assert marked.count() == 11 and {r.doc_id for r in marked.where("contaminated").collect()} == {6, 9}
    assert contamination(no_docs(spark), bench).count() == 0
    assert contamination(docs, bench.where("false")).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    rng = random.Random(11)
    shared = [prose(4000 + i, 14) for i in range(3)]
    given = []
    for i in range(90):
        lines = [prose(i * 10 + k, 40) for k in range(2)] + [shared[i % 3]]
        given.append((i, "\n".join(lines), "en", rng.choice(["a", "b", None])))
    given += [(100 + i, given[i][1].replace(given[i][1].split()[3], "altered", 1), "en", "a") for i in range(10)]
    leak = prose(7777, 40)
    given += [(200, prose(1, 60) + " " + leak, "en", "a"), (201, "too short", "en", "a"), (None, prose(2, 70), None, "b"), (202, None, "en", "b")]
    docs = spark.createDataFrame(rows(given), SCHEMA)
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "mix"]

    def after(name, frame):
        out = stages[name](spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = after("quality_rules", docs)
    assert one.columns == SCHEMA.names
    assert {r.doc_id for r in one.collect()} == {g[0] for g in given} - {201, 202}
    two = after("line_dedup", one)
    before = {r.doc_id: r.text for r in one.collect() if r.doc_id is not None}
    assert {r.doc_id: r.text for r in two.collect() if r.doc_id is not None} == brute_lines(list(before.items()))
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = after("near_dedup", two)
    groups = brute_components([(r.doc_id, r.text) for r in two.collect() if r.doc_id is not None], 80)
    assert {r.doc_id for r in three.collect()} == set(groups.values()) | {None}
    four = after("decontaminate", three)
    assert {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()} == {200}
    five = after("mix", four)
    assert abs(sum(r.taken for r in five.collect()) - sum(len(WORD.findall(r.text)) for r in four.collect())) <= 3
    assert {"doc_id", "size", "target", "taken"} <= set(five.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([(1, None), (2, prose(6, 40))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = stage(spark, odd_docs(spark), str(tmp_path)).columns
    assert name == "mix" or columns == SCHEMA.names
    assert stage(spark, no_docs(spark), str(tmp_path)).count() == 0
    assert stage(spark, odd_docs(spark), str(tmp_path)).count() <= 11
