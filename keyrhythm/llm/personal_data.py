"""Personal data by weak supervision: fixed patterns, and further spans that many unsure labelers agree on.

1. Every text is scanned once. Matches of the base patterns stay as they are. Anything that looks like
   personal data in some way (also base look-alikes that failed their check) is a candidate, and a set
   of labelers, built on patterns, word lists and the words around, votes on it: yes, no or nothing.
2. How often each pattern of votes occurs is counted over all texts. Expectation-maximisation on these
   counts estimates the share of true candidates of each kind and how reliable each labeler is, without
   any labelled text.
3. Its answers train a classifier on what is known of a span, votes included, which decides on all candidates.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyrhythm.llm.common import written
from keyrhythm.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name", "address", "birth")
EMAIL, IP, CARD, PHONE, IBAN, SSN, NAME, ADDRESS, BIRTH = range(9)

#: The base patterns, written so that no run is scanned twice.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP_LIKE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD_LIKE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_LIKE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# End of fixed values.

#: Look-alikes beyond the base patterns.
NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
DOT = re.compile(r"[\[({]\x20?dot\x20?[\])}]|\x20dot\x20", re.IGNORECASE)
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}|\x20dot\x20[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
IBAN_LIKE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
DATE_SHAPE = re.compile(r"(?:[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})")
NAMES = re.compile(r"(?<![^\W_])[A-ZÀ-Ý][a-zà-ÿ]+\.?\x20[A-ZÀ-Ý][a-zà-ÿ]+(?:\x20[A-ZÀ-Ý][a-zà-ÿ]+)?")
STREET = re.compile(r"(?<![0-9])[0-9]{1,5},?\x20(?:[A-ZÀ-Ý][a-zà-ÿ]+\x20){1,3}[A-Z][a-z]+\b|(?<![^\W_])[A-ZÀ-Ý][a-zà-ÿß]+(?:straße|strasse|weg|platz|gasse|allee)\x20[0-9]{1,4}"
                    r"|(?<![0-9])[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place|chemin)\x20(?:de\x20|du\x20|la\x20|des\x20){0,2}[A-ZÀ-Ý][a-zà-ÿ]+"
                    r"|(?<![^\W_])(?:Calle|Avenida|Plaza|Paseo)\x20(?:de\x20|del\x20|la\x20){0,2}[A-ZÀ-Ý][a-zà-ÿ]+,?\x20[0-9]{1,4}")

#: Word lists of the labelers.
GIVEN = set("""
adam alan albert alexander alice amanda amy ana andrea andrew angela anna anne antonio barbara benjamin bernard betty brian bruno carlos
carmen carol caroline catherine charles charlotte christian christine christopher claire claudia daniel david deborah dennis diana diego
donald donna dorothy edward elena elizabeth emily emma eric eva fernando florian francis frank franz gabriel george gerard hannah hans heinz
helen helga henry hugo ines isabel jack jacob james jan jane javier jean jennifer jessica joan johann john jorge jose joseph juan julia karen
karl katharina kevin klaus laura lisa louis louise lucas lucia luis manuel margaret maria marie mark martin mary matthew michael miguel
nancy nicolas olivia pablo patricia paul pedro peter petra philip pierre rachel ralf raul rebecca richard robert rosa ruth samuel sandra
sarah sofia sophie stefan stephen susan teresa thomas ursula victor walter werner william wolfgang
""".split())
TITLES = set("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sr sra don doña".split())
STREET_WORDS = set("street st avenue ave road rd lane ln drive dr boulevard blvd court ct square sq terrace way place pl rue calle avenida plaza paseo chemin".split())
ENDINGS = set("com org net edu gov io de fr es uk it nl eu info biz ch at be ca us".split())
COUNTRIES = set("AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
CUES = {
    EMAIL: "email e-mail mail contact reach write correo courriel kontakt".split(),
    IP: "ip address host server adresse dirección login client".split(),
    CARD: "card visa mastercard amex credit payment karte tarjeta carte".split(),
    PHONE: "phone tel telephone call mobile cell fax telefon teléfono téléphone handy anruf ring dial".split(),
    IBAN: "iban account konto bank cuenta compte transfer".split(),
    SSN: "ssn social security".split(),
    NAME: "name contact regards sincerely patient customer client mr mrs ms dr herr frau señor madame monsieur signed".split(),
    ADDRESS: "address lives live residence at adresse wohnhaft dirección domicile street home".split(),
    BIRTH: "born birth dob birthday geboren geburtsdatum nacido nacimiento né née naissance".split(),
}
AGAINST = set("order invoice version build isbn issn serial sku ticket page page's section chapter total sum price qty quantity lot batch part model figure table line id ref reference "
              "bestellung rechnung seite pedido factura página commande facture".split())
# End of fixed values.

LABELERS = ("shape", "check", "list", "cue", "company", "bounds", "variety")
WORDS = re.compile(r"[^\W\d_][\w'-]*")
#: Buckets of the classifier for the word before a span.
BEFORE = 32


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def octets(value: str) -> bool:
    parts = [p.lstrip("0") for p in value.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def mod97(value: str) -> bool:
    plain = value.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether the whole pattern matches) at each @ with something before it. Leftmost, not overlapping."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        if start < at:
            host = HOST.match(text, at + 1)
            if host:
                yield start, host.end(), True
                done = host.end()
            else:
                end = at + 1
                while end < len(text) and end - at < 64 and (text[end].isascii() and text[end].isalnum() or text[end] == "-"):
                    end += 1
                if end > at + 1:
                    yield start, end, False
        # What lies before the @ is settled, whatever comes next.
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass their check."""
    found = [(EMAIL, s, e) for s, e, whole in emails(text) if whole]
    found += [(IP, m.start(), m.end()) for m in IP_LIKE.finditer(text) if octets(m.group())]
    for m in CARD_LIKE.finditer(text):
        # A card has at most 18 separators; longer runs fail without being looked at.
        if m.end() - m.start() <= 37 and 13 <= len(digits := digits_of(m.group())) <= 19 and luhn(digits):
            found.append((CARD, m.start(), m.end()))
    found += [(PHONE, m.start(), m.end()) for m in PHONE_LIKE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Look-alikes of every kind, the base spans among them: (kind, start, end), each once."""
    found = set(base)
    found |= {(EMAIL, s, e) for s, e, _ in emails(text)}
    reached = 0
    for dot in DOT.finditer(text):
        if dot.start() >= reached and (m := SPELT.search(text, max(reached, dot.start() - 160), min(len(text), dot.end() + 160))):
            found.add((EMAIL, m.start(), m.end()))
            reached = m.end()
    for m in NUMBER.finditer(text):
        value, start, end = m.group(), m.start(), m.end()
        if end - start > 40:
            continue
        n = len(digits_of(value))
        if SSN_SHAPE.fullmatch(value):
            found.add((SSN, start, end))
        elif DATE_SHAPE.fullmatch(value):
            found.add((BIRTH, start, end))
        elif value.count(".") == 3 and IP_LIKE.fullmatch(value):
            found.add((IP, start, end))
        elif 13 <= n <= 19 and CARD_LIKE.fullmatch(value):
            found.add((CARD, start, end))
        elif 7 <= n <= 12:
            found.add((PHONE, start, end))
    found |= {(IBAN, m.start(), m.end()) for m in IBAN_LIKE.finditer(text)}
    for m in NAMES.finditer(text):
        word = m.group().split(" ", 1)[0].lower()
        # A full stop after a name ends a sentence; after a title it may not.
        if word in GIVEN or word.rstrip(".") in TITLES:
            found.add((NAME, m.start(), m.end()))
    for m in STREET.finditer(text):
        if not m.group()[0].isdigit() or STREET_WORDS & {w.lower() for w in m.group().split()}:
            found.add((ADDRESS, m.start(), m.end()))
    # Inside a base span nothing else is looked for.
    own, taken, at, out = set(base), sorted((s, e) for _, s, e in base), 0, []
    for kind, start, end in sorted(found, key=lambda f: (f[1], f[2], f[0])):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        next_one, clear = at, True
        while clear and next_one < len(taken) and taken[next_one][0] < end:
            clear = taken[next_one][1] <= start
            next_one += 1
        if clear or (kind, start, end) in own:
            out.append((kind, start, end))
    return out


@dataclass
class Span:
    """What the labelers see: the candidate, the words before it, its neighbours and other candidates nearby."""

    kind: int
    value: str
    words: list[str]
    left: str
    right: str
    company: bool


def shape_votes(s: Span) -> int:
    n = len(digits_of(s.value))
    if s.kind == EMAIL:
        return 1 if "@" in s.value and "." in s.value.rpartition("@")[2] else 0
    if s.kind == PHONE:
        groups = re.findall(r"[0-9]+", s.value)
        return 1 if len(groups) > 1 and 9 <= n <= 12 and max(map(len, groups)) <= 5 and min(map(len, groups)) >= 2 else -1 if len(groups) == 1 and s.value[0] != "+" else 0
    if s.kind == CARD:
        return 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", s.value) else 0
    return 1 if s.kind in (IP, IBAN, SSN) else 0


def check_votes(s: Span) -> int:
    digits = digits_of(s.value)
    if s.kind == CARD:
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if s.kind == IP:
        return 1 if octets(s.value) else -1
    if s.kind == IBAN:
        return 1 if mod97(s.value) else -1
    if s.kind == SSN:
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if s.kind == PHONE:
        return -1 if not 9 <= len(digits) <= 15 else 0
    if s.kind == BIRTH:
        parts = [int(p) for p in re.findall(r"[0-9]+", s.value)]
        day, month, year = parts if parts[2] > 31 else parts[::-1]
        return 1 if 1 <= day <= 31 and 1 <= month <= 12 and 1900 <= year <= 2025 else -1
    return 0


def list_votes(s: Span) -> int:
    words = [w.lower().rstrip(".") for w in re.split(r"[^\w]+", s.value) if w]
    if s.kind == EMAIL:
        return 1 if words and words[-1] in ENDINGS else -1
    if s.kind == NAME:
        return 1 if set(words) & GIVEN else 0
    if s.kind == ADDRESS:
        return 1 if set(words) & STREET_WORDS or re.search(r"stra(?:ß|ss)e|platz|gasse|allee", s.value) else 0
    if s.kind == IBAN:
        return 1 if s.value[:2] in COUNTRIES else -1
    return 0


def cue_votes(s: Span) -> int:
    near = set(s.words)
    return 1 if near & set(CUES[s.kind]) or s.kind == NAME and s.value.split(" ")[0].rstrip(".").lower() in TITLES else -1 if near & AGAINST else 0


def company_votes(s: Span) -> int:
    return 1 if s.company else 0


def bounds_votes(s: Span) -> int:
    """A span that is part of a longer word, number, path or code is none."""
    tied = any(c and (c.isalnum() or c in "_/\\=#$%&@+-") for c in (s.left, s.right))
    return -1 if tied else 1


def variety_votes(s: Span) -> int:
    digits = digits_of(s.value)
    return -1 if len(digits) >= 7 and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 0


VOTE: tuple[Callable[[Span], int], ...] = (shape_votes, check_votes, list_votes, cue_votes, company_votes, bounds_votes, variety_votes)


def seen(text: str, found: list[tuple[int, int, int]], reach: int = 48, company: int = 120) -> Iterator[tuple[int, int, int, list[int], list[float]]]:
    """Each candidate with its votes and the classifier's other numbers; ``found`` is in order of the start."""
    for at, (kind, start, end) in enumerate(found):
        words = [w.lower() for w in WORDS.findall(text, max(0, start - reach), start)][-4:]
        near = found[max(0, at - 4) : at] + found[at + 1 : at + 5]
        together = any(k != kind and s < end + company and start < e + company for k, s, e in near)
        span = Span(kind, text[start:end], words, text[start - 1] if start else "", text[end] if end < len(text) else "", together)
        value = span.value
        digits = sum(c.isdigit() for c in value) / len(value)
        marks = sum(not c.isalnum() for c in value) / len(value)
        bucket = zlib.crc32(words[-1].encode()) % BEFORE if words else -1
        yield kind, start, end, [vote(span) for vote in VOTE], [min(len(value), 64) / 64, digits, marks, float(bucket)]


#: Chances of a no and of a yes on false and on true candidates, of the votes that are cast, as believed before
#: any is counted: a vote is right more often than wrong.
USUAL = ((0.75, 0.25), (0.25, 0.75))
#: Known and not learned: what fails a checksum or lies out of range is not of its kind, but for misprints.
KNOWN = {"check": ((0.7, 0.3), (0.002, 0.998))}


class Reliabilities:
    """Binary expectation-maximisation on counted vote patterns.

    ``prior[kind]`` is the share of true candidates; ``table[y, labeler, vote]`` the chance of a no (0) and of a
    yes (1) on a false (0) or true (1) candidate, among the votes that a labeler casts: whether it
    casts one depends on the kind and tells nothing. Both start from what is believed, which also
    counts like ``belief`` of all candidates in every round, so true and false cannot change places.
    """

    def __init__(self, kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50, belief: float = 0.05):
        start = np.array([[KNOWN.get(name, USUAL)[y] for name in LABELERS] for y in (0, 1)])
        learned = np.array([name not in KNOWN for name in LABELERS])[None, :, None]
        self.prior, self.table = np.full(len(KINDS), 0.5), start
        counts = counts.astype(float)
        weight = max(10.0, belief * counts.sum())
        for _ in range(rounds if len(counts) else 0):
            p = self.posterior(kinds, votes)
            share = np.stack([(1 - p) * counts, p * counts])
            self.prior = (np.bincount(kinds, share[1], len(KINDS)) + 5.0) / (np.bincount(kinds, counts, len(KINDS)) + 10.0)
            cast = np.stack([share @ (votes == -1), share @ (votes == 1)], axis=2)
            self.table = np.where(learned, (cast + weight * start) / (cast.sum(axis=2, keepdims=True) + weight), start)

    def posterior(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """The chance that each candidate is true."""
        logs = np.log(self.table[1]) - np.log(self.table[0])
        odds = (votes == -1) @ logs[:, 0] + (votes == 1) @ logs[:, 1] + np.log(self.prior[kinds]) - np.log1p(-self.prior[kinds])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def features(kinds: np.ndarray, votes: np.ndarray, hints: np.ndarray) -> np.ndarray:
    """The classifier's inputs: kind, both directions of each vote, look of the span, the word before it."""
    before = hints[:, 3].astype(int)
    words = np.zeros((len(kinds), BEFORE))
    known = np.flatnonzero(before >= 0)
    words[known, before[known]] = 1
    return np.hstack([np.eye(len(KINDS))[kinds], votes > 0, votes < 0, hints[:, :3], words, np.ones((len(kinds), 1))])


def fit_classifier(x: np.ndarray, soft: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on probabilities as labels, by Newton's method."""
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (soft - p) - penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


SPAN = "struct<kind:int,start:int,end:int>"
CANDIDATE = "struct<kind:int,start:int,end:int,votes:array<tinyint>,hints:array<double>>"
SPAN_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
CANDIDATE_TYPE = pa.struct([*SPAN_TYPE, ("votes", pa.list_(pa.int8())), ("hints", pa.list_(pa.float64()))])


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def look(rows: DataFrame) -> DataFrame:
    """(_row, base, candidates) of (_row, _text)."""
    kind = rows.schema["_row"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for value in batch.column("_text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                found.append([{"kind": k, "start": s, "end": e, "votes": v, "hints": h} for k, s, e, v, h in seen(text, candidates(text, spans))])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(base, pa.list_(SPAN_TYPE)), pa.array(found, pa.list_(CANDIDATE_TYPE))],
                                             names=["_row", "base", "candidates"])

    return rows.mapInArrow(scan, f"_row {kind}, base array<{SPAN}>, candidates array<{CANDIDATE}>")


def learn(looked: DataFrame, most_spans: int) -> tuple[Reliabilities, np.ndarray]:
    """Reliabilities from all candidates' votes, and the classifier's weights from a bounded sample of candidates.

    The counted patterns that come to the driver are at most 9 kinds x 3 ** 7 votes.
    """
    spans = looked.select(F.col("_row.at").alias("_at"), F.explode("candidates").alias("_c")).select("_at", "_c.*")
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    kinds, votes = np.array([r.kind for r in patterns], int), np.array([list(r.votes) for r in patterns], int).reshape(-1, len(LABELERS))
    model = Reliabilities(kinds, votes, np.array([r.n for r in patterns]))
    sample = spans.orderBy(F.xxhash64("_at", "start", "end", "kind"), "_at", "start", "end", "kind").limit(most_spans).collect()
    if not sample:
        return model, np.zeros(features(kinds, votes, np.zeros((0, 4))).shape[1])
    kinds, votes, hints = np.array([r.kind for r in sample]), np.array([list(r.votes) for r in sample]), np.array([list(r.hints) for r in sample])
    return model, fit_classifier(features(kinds, votes, hints), model.posterior(kinds, votes))


RESULT = ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string, "
          f"findings array<{SPAN}>")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, most_spans: int = 20_000) -> DataFrame:
    """``doc_id``, counts of base spans by kind and of added ones, digest of the base spans, all spans as text and as ``findings``.

    Base spans always stay. Added spans are candidates outside them to which the classifier gives at
    least ``least``; of overlapping ones the first longest stays. Places are code points, the end
    excluded, ordered by kind and then start. Votes of all texts are counted; only the classifier's
    fit takes a sample, of ``most_spans`` candidates chosen by hash.

    A NULL or empty text has no spans. Rows do not depend on each other but for what was learned from
    all of them; repeated rows are scanned one by one, and a NULL id stays NULL. An empty table
    gives an empty one; other columns are left out.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("at"), F.col(f"`{doc_id}`").alias("id")).alias("_row"), F.col(f"`{text}`").alias("_text"))
    looked = written(look(rows), "candidates")
    _, weights = learn(looked, most_spans)
    kind = looked.schema["_row"].dataType["id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for base_value, found_value in zip(batch.column("base"), batch.column("candidates")):
                base = [(r["kind"], r["start"], r["end"]) for r in base_value.as_py()]
                spans = base + chosen(base, found_value.as_py(), weights, least)
                counts = [sum(s[0] == k for s in base) for k in range(4)]
                cells = (*counts, len(spans) - len(base), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans),
                         [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans)])
                for column, cell in zip(out, cells):
                    column.append(cell)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(SPAN_TYPE)]
            yield pa.RecordBatch.from_arrays([batch.column("_row").field("id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                                             names=["_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "findings"])

    return looked.mapInArrow(decide, f"_id {kind}, {RESULT}").withColumnRenamed("_id", doc_id)


def chosen(base: list[tuple[int, int, int]], found: list[dict], weights: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Accepted candidates that overlap neither a base span nor an earlier accepted one."""
    held = set(base)
    found = [f for f in found if (f["kind"], f["start"], f["end"]) not in held]
    if not found:
        return []
    x = features(np.array([f["kind"] for f in found]), np.array([f["votes"] for f in found], int), np.array([f["hints"] for f in found], float))
    sure = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) >= least
    out, done = [], 0
    for f in sorted((f for f, yes in zip(found, sure) if yes), key=lambda f: (f["start"], -f["end"], f["kind"])):
        if f["start"] >= done:
            out.append((f["kind"], f["start"], f["end"]))
            done = f["end"]
    return out


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents")).drop("findings")
