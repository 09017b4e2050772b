"""Alignment of two tokenizers: equal to the vendors' own encoders and to brute force over token spans."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from odd import no_docs, odd_docs, prose
from tokenizers import Tokenizer

from keyrhythm.llm import alignment
from keyrhythm.llm.alignment import TOKENIZERS, align_chunk, align_tokenizers, byte_letters, chunked, tokenizers

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = ["a", " ", "  ", "\n", " \n ", "a  b   c", "trailing   ", "   leading", "tab\tand\r\nlines\n\n", "<|endoftext|>", "a <|endoftext|> b", "<s> x </s> <unk>", "<0x41>",
       "\u2581", "a\u2581b", "\u00a0x\u3000y\u2028z\x85", "naïve façade Ærø", "日本語のテキスト", "🙂👩‍👩‍👧 e\u0301", "\x00\x01\x7f", "ﬁ ２ Å", "don't I'LL we've 'sx", "x" * 3000, " " * 500 + "y",
       "12345 3.14 1,000", "\ufeffbom", "\u200b\u200d", "\U0010ffff\ue000", "а́б в", "\u180e\u1680 z"]


@pytest.fixture(scope="module")
def vendors():
    byte = Tokenizer.from_file(f"{TOKENIZERS}/{FILES[0]}")
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{FILES[1]}")


def noise(seed, n):
    rng = random.Random(seed)
    ranges = [(32, 126), (32, 34), (0, 31), (160, 700), (0x300, 0x36F), (0x370, 0x52F), (0x600, 0x6FF), (0x900, 0xDFF), (0x2000, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F9FF)]
    return "".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(n))


def spans(tokens):
    out, at = [], 0
    for i, token in tokens:
        out.append((i, at, at + len(token)))
        at += len(token)
    return out


def brute(texts, vendors):
    byte, piece = vendors
    letters = byte_letters()
    aligned = []
    for text in texts:
        if not text:
            aligned.append(None)
            continue
        told = byte.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(told.ids, told.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("\u2581", " ").encode()) for i in piece.encode(text) for p in [piece.id_to_piece(i)]]
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (a, b)):
            aligned.append(None)
            continue
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, start = [], 0
        for end in cuts:
            parts.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        aligned.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    held = Counter(pair for x in aligned if x for pair in set(x[3]))
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (*x[:3], len(x[3]), sum(held[p] == highest[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]) for x in aligned]


def got(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_both_sides_encode_as_the_vendors_do(vendors):
    left, right, _ = tokenizers(TOKENIZERS, *FILES)
    texts = ODD + [noise(i, 400) for i in range(60)] + [prose(i, 200) for i in range(5)]
    ids, counts = left(texts)
    assert ids.tolist() == [i for e in vendors[0].encode_batch([" " + t for t in texts], add_special_tokens=False) for i in e.ids] and counts.sum() == len(ids)
    ids, counts = right(texts)
    assert right.by_segment and ids.tolist() == [i for e in vendors[1].encode(texts) for i in e] and counts.sum() == len(ids)


def test_same_as_brute_force(spark, vendors, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 1000)
    texts = ODD + [noise(i, 120) for i in range(20)] + [prose(i % 7, 30) for i in range(20)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted((str(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows], vendors)))
    assert got(align_tokenizers(docs)) == wanted
    # The same when only frequent pairs may be broadcast.
    assert got(align_tokenizers(docs, most_broadcast=40)) == wanted


def test_odd_and_empty_tables(spark, vendors):
    rows = odd_docs(spark).select("doc_id", "text").collect()
    texts = [r.text if r.text is None or len(r.text) < 50_000 else None for r in rows]
    short = spark.createDataFrame([(r.doc_id, t) for r, t in zip(rows, texts)], "doc_id long, text string")
    assert got(align_tokenizers(short)) == sorted((str(r.doc_id), *x) for r, x in zip(rows, brute(texts, vendors)))
    whole = align_tokenizers(odd_docs(spark)).where("doc_id = 5").first()
    assert whole.n_links == whole.n_a + whole.n_b - whole.n_groups and sum(p.times for p in whole.pairs) == whole.n_links
    assert align_tokenizers(no_docs(spark)).count() == 0


def test_texts_are_taken_whole_in_chunks(monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 10)
    assert list(chunked([4, 7, 0, 30, 1])) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert list(chunked([])) == []


def test_chunk_of_nothing():
    columns = align_chunk(["", ""], *tokenizers(TOKENIZERS, *FILES))
    assert [c.to_pylist() for c in columns] == [[0, 0]] * 4 + [["", ""], [[], []]]
