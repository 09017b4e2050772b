"""Chat snapshots, archives, secrets and the two language models."""

import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyrhythm.llm import kneser_ney, pseudo_likelihood, secrets, tokens, warc
from keyrhythm.llm.chat import collapse_snapshots
from keyrhythm.llm.kneser_ney import perplexities
from keyrhythm.llm.warc import read_warc, write_warc
from odd import no_docs, odd_docs, prose

TURNS = "conv_id bigint, turn bigint, role string, text string, _place string"


def test_snapshots_by_brute_force(spark):
    rng = random.Random(6)
    talks = {}
    for c in range(80):
        old = talks[rng.choice(list(talks))] if talks and rng.random() < 0.7 else []
        talks[c] = old[: rng.randrange(len(old) + 1)] + [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "why"])) for _ in range(rng.randrange(1, 4))]
    rows = [(c, 10 * k, r, t, "x") for c, talk in talks.items() for k, (r, t) in enumerate(talk)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in collapse_snapshots(spark.createDataFrame(rows + rows[:20], TURNS)).collect()}
    want = {}
    for c, talk in talks.items():
        equal = [o for o, other in talks.items() if other == talk]
        if c == min(equal) and not any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks.values()):
            want[c] = (len(talk), len(equal), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talk))
    assert got == want


def test_long_and_odd_conversations(spark):
    long = [(1, k, "user", f"t{k}", "x") for k in range(1300)] + [(2, k, "user", f"t{k}", "x") for k in range(700)]
    odd = [(None, 0, None, None, "x"), (3, None, "user", "", "x"), (4, None, "user", None, "x"), (5, 0, "a", "b", "x"), (5, 0, "a", "c", "x")]
    got = collapse_snapshots(spark.createDataFrame(long + odd, TURNS)).collect()
    assert sorted((r.conv_id or -1, r.part, r.n_turns) for r in got) == [(-1, 0, 1), (1, 0, 1300), (1, 1, 1300), (1, 2, 1300), (3, 0, 1), (4, 0, 1), (5, 0, 2)]
    assert "".join(r.text for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.part)).count("<|im_start|>") == 1300
    assert collapse_snapshots(spark.createDataFrame([], TURNS)).count() == 0


def pages(spark):
    rng = random.Random(7)
    given = [(i, f"http://x/{i}", rng.choice([None, "", "é" * 800, prose(i, 400), "dup " * 300, "\x1f\x8b\x08" * 400, "a\r\n\r\nb" * 300])) for i in range(150)]
    return given + [(given[3][0], "u\r\nv", given[3][2]), (None, None, "dup " * 300)]


def test_archive_round_trip_by_small_splits(spark, tmp_path):
    given = pages(spark)
    frame = spark.createDataFrame(given, "page_id bigint, url string, html string").withColumn("_id", F.lit("x")).repartition(3)
    write_warc(frame, f"{tmp_path}/w", level=0)  # stored, so that payload bytes stand in the file as they are
    first = {}
    for i, _, h in given:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            first[raw] = max(first.get(raw, -1), -1 if i is None else i)
    for split in (100, 5000, 1 << 20):
        got = read_warc(spark, f"{tmp_path}/w", split_bytes=split).collect()
        assert len(got) == len(given)
        told = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got)
        want = []
        for i, _, h in given:
            raw = (h or "").encode()
            own = raw not in first or first[raw] == i
            want.append((f"<urn:page:{'' if i is None else i}>", "response" if own else "revisit", "" if own else f"<urn:page:{first[raw]}>", len(raw),
                         "sha1:" + hashlib.sha1(raw).hexdigest(), raw if own else b""))
        assert told == sorted(want)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in files) == len(given)


def test_nested_members_and_empty_tables(spark, tmp_path):
    inner = warc.member(99, "http://inner", prose(1, 50), "d", 10, None, 6) * 3
    packer = warc.zlib.compressobj(0, warc.zlib.DEFLATED, warc.GZIP)
    outer = packer.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n") + packer.flush()
    data = outer + warc.member(1, "u", "h", "d", 1, None, 6)
    (tmp_path / "a").write_bytes(data)
    for start in (1, 60, len(outer) - 5):
        with open(tmp_path / "a", "rb") as file:
            assert [at for at, _ in warc.records(warc._Bytes(file, start), start, len(data))] == [len(outer)]
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0


def brute_base(text):
    """Straight from the rules, without lengths in the patterns."""
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_as_by_the_rules(spark):
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", " ", '"', "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0af", "é", "\n",
            "abc", "x9Zk3q", "ſecret", "toKen", ":="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "token=token: abcdefgh", prose(1, 30000)]
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in got:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [s for s in base.split(",") if s]
        assert all((texts[r.doc_id] or "")[f.start : f.end] == f.value for f in r.findings)


def test_novelty_tells_secrets_from_names():
    novelty = secrets.Novelty()
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = sum(bool(secrets.novel_spans(f"auth header: {''.join(rng.choice(alphabet) for _ in range(28))} end", novelty, 0.85, 40)) for _ in range(200))
    names = ["configuration_manager_session", "your_api_key_here", "example.password.placeholder", "DatabaseConnectionProvider", "authentication_token_service"]
    assert hits >= 198
    assert not any(secrets.novel_spans(f"auth token: {n} end", novelty, 0.85, 40) for n in names)
    assert not secrets.novel_spans(f"plain words {'x9Kd03mZpQ71LsvTqq'} without a place for it", novelty, 0.85, 40)


def test_scans_take_odd_tables(spark):
    for run in (secrets.scan_secrets, pseudo_likelihood.pseudo_likelihood):
        assert run(odd_docs(spark)).count() == 11
        assert run(no_docs(spark)).count() == 0
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(odd_docs(spark)).collect()}
    assert got[1].log_likelihood == 0 and got[2].mean_log_likelihood is None and got[5].n_words == 60000


def test_kneser_ney_sums_to_one_and_matches_counting(spark):
    """Against a plain implementation on nested dictionaries, and over the whole vocabulary."""
    texts = [prose(i % 7, 40) for i in range(25)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model = kneser_ney._Shards(kneser_ney.train(frame, "text"), 3)
    vocabulary = sorted({w for t in texts for w in t.split()})
    three, two, one = {}, {}, {}
    for t in texts:
        w = ["<s>", "<s>", *t.split()]
        for k in range(2, len(w)):
            three[tuple(w[k - 2 : k + 1])] = three.get(tuple(w[k - 2 : k + 1]), 0) + 1
    for g in three:
        two[g[1:]] = two.get(g[1:], 0) + 1
    for g in two:
        one[g[1:]] = one.get(g[1:], 0) + 1

    def discounts(counts):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.5 * k for k in (1, 2, 3)]

    d1, d2, d3 = discounts(one), discounts(two), discounts(three)
    cut = lambda n, d: d[min(n, 3) - 1]
    total = sum(one.values())
    unseen = sum(cut(n, d1) for n in one.values()) / total / (len(one) + 1)

    def p(word, context):
        if not context:
            return (one[(word,)] - cut(one[(word,)], d1)) / total + unseen if (word,) in one else unseen
        counts, d = (three, d3) if len(context) == 2 else (two, d2)
        here = {g[-1]: n for g, n in counts.items() if g[:-1] == context}
        if not here:
            return p(word, context[1:])
        n = here.get(word, 0)
        return ((n - cut(n, d)) if n else 0) / sum(here.values()) + sum(cut(v, d) for v in here.values()) / sum(here.values()) * p(word, context[1:])

    def scored(text):
        (_, _, offsets, data), = tokens.chunks(pa.array([text]))
        hashed, first = tokens.words(data, offsets, fold=tokens.LOWERED)
        return kneser_ney._log_probs(model, kneser_ney._grams(hashed, first), kneser_ney._contexts(hashed, first))

    for text in (texts[3], prose(99, 30), "never seen words here balan"):
        w = ["<s>", "<s>", *text.split()]
        want = [np.log(p(w[k], tuple(w[k - 2 : k]))) for k in range(2, len(w))]
        assert np.allclose(scored(text), want, atol=1e-4)
    context = texts[0].split()[:2]
    mass = sum(np.exp(scored(" ".join([*context, v]))[2]) for v in [*vocabulary, "neverseen"])
    assert abs(mass - 1) < 1e-4


def test_perplexity_of_held_out_text(spark):
    rng = random.Random(1)
    good = [(i, prose(i, 120), ["en", "de", None][i % 3], 1) for i in range(120)]
    bad = [(500 + i, " ".join("".join(rng.choice("qwxz#") for _ in range(6)) for _ in range(120)), "en", 0) for i in range(20)]
    docs = spark.createDataFrame([(*r[:3], "x") for r in good + bad] + [(900, None, "en", "x"), (None, prose(3, 50), "xx", "x")], "doc_id bigint, text string, lang string, _id string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad] + [(None, 1)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in perplexities(docs, labels).collect()}
    assert all(got[r[0]].kept for r in good) and not any(got[r[0]].kept for r in bad)
    assert not got[900].kept and got[900].perplexity is None and got[None].kept
    assert perplexities(docs.where("false"), labels).count() == 0
    assert all(r.kept == (r.n_words > 0) for r in perplexities(docs, labels.where("false")).collect())


def test_all_trusted_text_trains_and_a_joined_model_scores_alike(spark):
    # The words of each document are its own, so the model knows those it was trained on and no others.
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j % 9}" for j in range(12)), "en") for i in range(6000)] + [
        (6000, None, "en"), (6001, "w1x0", None), (6002, "w1x0 w1x1 w1x2 W1X3\tw1x4", "de"), (None, "w1x0 w1x1", "de")],
        "doc_id bigint, text string, lang string")
    docs = docs.unionByName(docs.where("doc_id < 3 OR doc_id >= 6000"))
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id bigint, quality int")
    told = {r.doc_id: r.perplexity for r in perplexities(docs, labels).where("doc_id < 6000").collect()}
    known = sum(p < 0.9 * max(told.values()) for p in told.values())
    assert 0.75 * 6000 < known < 0.85 * 6000 and len(told) == 6000
    few = docs.where("doc_id IS NULL OR doc_id < 60 OR doc_id >= 6000")
    held, joined = ([tuple(r) for r in perplexities(few, labels.where("doc_id < 60"), most_held=most).collect()] for most in (10**9, 0))
    assert len(held) == len(joined) == 60 + 4 + 3 + 3
    for a, b in zip(sorted(held, key=str), sorted(joined, key=str)):
        assert a[:3] == b[:3] and a[5] == b[5] and np.allclose([x or 0 for x in a[3:5]], [x or 0 for x in b[3:5]], rtol=1e-4)
    for empty in (docs.where("false"), docs.where("text IS NULL")):
        assert perplexities(empty, labels, most_held=0).count() == empty.count()


def test_a_joined_model_is_dropped_slice_after_slice(spark, monkeypatch):
    """No table of the whole model is stored, none of its slices stays, and no slice misses a context of another."""
    docs = spark.createDataFrame([(i, prose(i % 9, 40), "en") for i in range(30)] + [(30, None, "en"), (31, prose(2, 1), "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    made, written = [], kneser_ney.written

    def noted(df, name):
        made.append((name, out := written(df, name)))
        return out

    held = {r.doc_id: r for r in perplexities(docs, labels).collect()}
    monkeypatch.setattr(kneser_ney, "written", noted)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    joined = {r.doc_id: r for r in perplexities(docs, labels, most_held=0, slices=2, turns=2).collect()}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert len(held) == len(joined) == 32
    for a in held.values():
        b = joined[a.doc_id]
        assert a.n_words == b.n_words and a.kept == b.kept and np.allclose(a.perplexity or 0, b.perplexity or 0, rtol=1e-5)
    names = [name for name, _ in made]
    assert names.count("kn-trigrams") == names.count("kn-model") == 2 and names.count("kn-sums") == 4
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, table in made:
        gone = [f for f in table.inputFiles() if not (path := jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))).getFileSystem(conf).exists(path)]
        assert bool(gone) == (name in ("kn-trigrams", "kn-bigrams", "kn-words", "kn-p1", "kn-p2", "kn-model", "kn-documents", "kn-sums"))


def test_a_joined_model_is_asked_in_blocks(spark, monkeypatch):
    """What a slice is asked is a row for each chunk and group, not for each n-gram; texts of other chunks and rows alike keep their own sums."""
    docs = spark.createDataFrame([(i, prose(i % 40, 200), "en") for i in range(200)] + [(900, "", "en"), (901, "one", "en")], "doc_id bigint, text string, lang string")
    docs = docs.unionByName(docs.where("doc_id < 5")).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    blocks = []

    def noted(*given, asked=kneser_ney._asked):
        rows = docs.selectExpr("xxhash64(text)", "text").mapInArrow(asked(*given), kneser_ney.BLOCKS).collect()
        blocks.extend((len(rows), sum(len(r["_keys"] or b"") // 8 for r in rows)))
        return asked(*given)

    held = sorted((r.doc_id, r.n_words, round(r.perplexity or 0, 3), r.kept) for r in perplexities(docs, labels).collect())
    monkeypatch.setattr(kneser_ney, "_asked", noted)
    joined = sorted((r.doc_id, r.n_words, round(r.perplexity or 0, 3), r.kept) for r in perplexities(docs, labels, most_held=0).collect())
    assert len(held) == len(joined) == 207
    assert all(a[:2] == b[:2] and a[3] == b[3] and np.isclose(a[2], b[2], rtol=1e-5, atol=2e-3) for a, b in zip(held, joined))
    rows, keys = sum(blocks[::2]), sum(blocks[1::2])
    assert keys > 3 * 40_000 and rows < keys / 100


def test_network_learns_both_sides():
    """Words that their neighbours determine: the mean log probability of unseen text comes near certainty."""
    rng = np.random.default_rng(0)

    def text(n):
        out = []
        for _ in range(n):
            a = rng.integers(0, 8)
            out += [f"l{a}", f"m{a}", f"r{a}"]
        return " ".join(out)

    train, held = text(4000), text(400)

    def parts(t, vocabulary):
        (first, classes, share), = pseudo_likelihood._classified(pa.array([t]), vocabulary)
        return pseudo_likelihood.neighbours(classes, first, vocabulary.classes - 1), classes

    names = [f"{k}{a}" for k in "lmr" for a in range(8)]
    (_, _, offsets, data), = tokens.chunks(pa.array([" ".join(names)]))
    vocabulary = pseudo_likelihood.Vocabulary(tokens.words(data, offsets)[0], np.zeros(pseudo_likelihood.SLOTS), 32)
    network = pseudo_likelihood.Network(32, 8, 16)
    sides, classes = parts(train, vocabulary)
    for _ in range(4):
        for lo in range(0, len(classes), 128):
            network.step(sides[lo : lo + 128], classes[lo : lo + 128], 0.5)
    sides, classes = parts(held, vocabulary)
    z = network.forward(sides)[2]
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-4)
    middle = np.array([w.startswith("m") for w in held.split()])
    scores = z[np.arange(len(z)), classes]
    assert scores[middle].mean() > -0.2 > np.log(1 / 8)
    blind = sides.copy()
    blind[:, :2] = 31
    assert network.forward(blind)[2][np.arange(len(z)), classes][middle].mean() < scores[middle].mean()


def test_gradient_is_the_slope():
    network = pseudo_likelihood.Network(12, 4, 5, seed=2)
    network.weights = [w.astype(np.float64) for w in network.weights]
    rng = np.random.default_rng(1)
    sides, target = rng.integers(0, 12, (9, 4)), rng.integers(0, 12, 9)
    loss = lambda: -network.forward(sides)[2][np.arange(9), target].mean()
    before = [w.copy() for w in network.weights]
    network.step(sides, target, 1.0)
    slopes = [b - w for b, w in zip(before, network.weights)]
    for k, w in enumerate(before):
        network.weights = [b.copy() for b in before]
        at = np.unravel_index(rng.integers(w.size), w.shape)
        network.weights[k][at] += 1e-5
        up = loss()
        network.weights[k][at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - slopes[k][at]) < 1e-4


def test_every_word_is_trained_on_and_pieces_leave_no_seam(spark, monkeypatch):
    """The steps of a round take each word of the corpus once, in pieces that break documents too."""
    docs = spark.createDataFrame([(i, prose(i, 37 * i)) for i in range(9)], "_id bigint, _text string").coalesce(1)
    n = sum(37 * i for i in range(9))
    vocabulary = pseudo_likelihood.build_vocabulary(pseudo_likelihood.count_words(docs, "_text"), 128, 63)
    column = pa.array([bytes(r.classes) for r in pseudo_likelihood.coded(docs, "_id", "_text", vocabulary).orderBy("_id").collect()])
    ((first, classes),) = pseudo_likelihood._unpacked(column, 128)
    assert len(classes) == n
    whole = pseudo_likelihood.neighbours(classes, first, 127)
    monkeypatch.setattr(pseudo_likelihood, "PIECE", 50)
    cut = [(a, b, sides) for a, b, sides in pseudo_likelihood._pieces(classes, first, 127)]
    assert max(b - a for a, b, _ in cut) == 50 and np.array_equal(np.concatenate([sides for _, _, sides in cut]), whole)
    network, stepped = pseudo_likelihood.Network(128, 4, 4), []
    network.step = lambda sides, target, rate: stepped.append(len(target))

    class Start:
        value = network.flat()

    batch = pa.RecordBatch.from_arrays([column], names=["classes"])
    (out,) = pseudo_likelihood._train_part(network, Start, 0.1, 16)([batch])
    assert sum(stepped) == n and out.column(0)[0].as_py() == n


def test_rounds_over_the_corpus_raise_its_likelihood(spark):
    docs = spark.createDataFrame([(i, prose(i % 4, 300)) for i in range(40)], "doc_id bigint, text string").coalesce(2)
    few, more = ({r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(docs, rounds=k).collect()} for k in (0, 4))
    assert len(more) == 40 and all(r.n_words == 300 for r in more.values())
    assert abs(more[1].log_likelihood - more[5].log_likelihood) < 1e-6
    assert sum(r.log_likelihood for r in more.values()) > sum(r.log_likelihood for r in few.values())
