"""Personal data: base spans against the plain patterns, added ones against planted cases, learning on its own."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from odd import no_docs, odd_docs, prose

from keyrhythm.llm.personal_data import ADDRESS, KINDS, LABELERS, Reliabilities, base_spans, candidates, find_personal_data, fit_classifier, luhn

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def card(rng, prefix="4"):
    digits = prefix + "".join(rng.choice("0123456789") for _ in range(15 - len(prefix)))
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def iban(rng):
    account = "".join(rng.choice("0123456789") for _ in range(18))
    return next(f"DE{c:02d}{account}" for c in range(2, 99) if int(f"{account}1314{c:02d}") % 97 == 1)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["@", ".", "+", "-", " ", "(", ")", "a", "Z9", "12", "3", "255", "256", "0001", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "x@y.z", "é", "%", "\n", "1.2.3.4"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain_spans(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("0")


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" + " " * 400_000, "1." * 200_000, "a@" * 200_000, "a@b." * 100_000, "A" + "a" * 400_000, "(" * 400_000,
                                  "x@y.z " * 60_000, "AB12 " * 80_000, "Anna Maria " * 30_000])
def test_long_texts_take_linear_time(text):
    start = time.process_time()
    candidates(text, base_spans(text))
    assert time.process_time() - start < 5


def planted(seed, n):
    """Documents with true and false cases of the further kinds; (text, kind, start, end, whether it is personal data)."""
    rng = random.Random(seed)

    def number(n):
        return "".join(rng.choice("123456789") for _ in range(n))

    made = {
        "name": [(lambda: ("signed by ", f"Maria {rng.choice(['Keller', 'Lopez', 'Dubois'])}", "."), True), (lambda: ("contact Dr. ", "Peter Schmidt", " today"), True)],
        "phone": [(lambda: ("call ", f"({number(3)}) {number(3)}-{number(4)}", " now"), True), (lambda: ("order ", number(10), " was sent"), False)],
        "iban": [(lambda: ("account iban ", iban(rng), " at the bank"), True), (lambda: ("part ", f"DE{number(20)}", " in stock"), False)],
        "ssn": [(lambda: ("ssn ", f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ","), True), (lambda: ("serial ", f"000-{number(2)}-{number(4)}", "/7"), False)],
        "email": [(lambda: ("write to ", f"jo{number(2)} [at] mail [dot] com", " soon"), True)],
        "card": [(lambda: ("invoice ", str(int(card(rng)) // 10) + str((int(card(rng)) % 10)), " paid"), None)],
        "ip": [(lambda: ("version ", f"{rng.randint(300, 900)}.1.{number(1)}.{number(1)}", " released"), False)],
    }
    out = []
    for i in range(n):
        kind = rng.choice(list(made))
        make, true = rng.choice(made[kind])
        before, value, after = make()
        head = prose(seed * n + i, 30) + " " + before
        if true is None:
            true = luhn(value)
        out.append((head + value + after + " " + prose(seed * n + i + 1, 20), kind, len(head), len(head) + len(value), true))
    return out


def test_added_spans_find_planted_cases_and_leave_the_others(spark):
    cases = planted(1, 900)
    clean = [prose(5000 + i, 80) for i in range(200)]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(10_000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(KINDS[f.kind], f.start, f.end) for f in r.findings] for r in find_personal_data(docs).collect()}
    for kind in ("name", "phone", "iban", "ssn", "email"):
        asked = [(i, c) for i, c in enumerate(cases) if c[1] == kind and c[4]]
        hit = sum(any(s < c[3] and c[2] < e for _, s, e in found[i]) for i, c in asked)
        assert hit >= 0.9 * len(asked) > 0, kind
    wrong = [(c[1], c[0][c[2]:c[3]]) for i, c in enumerate(cases) if not c[4] and any(s < c[3] and c[2] < e for _, s, e in found[i])]
    assert len(wrong) <= 0.05 * sum(not c[4] for c in cases), wrong[:5]
    assert not any(found[10_000 + i] for i in range(len(clean)))


def test_whole_result(spark):
    texts = ["mail a.b@c.de or +49 30 1234567 89, ip 10.0.0.1 and 10.0.0.256", "é🙂 x@y.zz 4111 1111 1111 1111", "", None, "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_personal_data(docs).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(told(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
        assert r.spans == told(sorted((f.kind, f.start, f.end) for f in r.findings))


def test_odd_and_empty_tables(spark):
    rows = find_personal_data(odd_docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs(spark).collect())
    assert find_personal_data(no_docs(spark)).count() == 0
    text_ids = spark.createDataFrame([("a", "x@y.zz"), (None, None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.spans) for r in find_personal_data(text_ids).collect()) == [("None", ""), ("a", "email:0:6")]


def test_reliabilities_are_learned_without_labels():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.3
    good = np.array([0.95, 0.6, 0.8, 0.9, 0.7, 0.85, 0.5])
    right = rng.random((len(truth), len(LABELERS))) < good
    votes = np.where(right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    votes[:, LABELERS.index("check")] = 0  # the one labeler whose reliability is given
    good[LABELERS.index("check")] = 0.5
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Reliabilities(np.full(len(patterns), ADDRESS), patterns, counts)
    p = model.posterior(np.full(len(truth), ADDRESS), votes)
    # Nearly as good as the decision of one who knows prior and reliabilities.
    known = (votes * np.log(good / (1 - good))).sum(axis=1) + np.log(0.3 / 0.7) > 0
    assert abs(model.prior[ADDRESS] - 0.3) < 0.05 and ((p > 0.5) == truth).mean() > (known == truth).mean() - 0.005
    said = model.table[1, :, 1]
    assert said[0] > said[4] and said[3] > said[6]


def test_classifier_fits_soft_labels():
    rng = np.random.default_rng(5)
    x = np.hstack([rng.normal(size=(4000, 3)), np.ones((4000, 1))])
    soft = 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.0, 0.5]))))
    assert np.abs(fit_classifier(x, soft) - [2.0, -1.0, 0.0, 0.5]).max() < 0.05
