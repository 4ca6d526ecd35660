"""Personal data by weak supervision.

Candidate spans (mail addresses, telephone numbers, IP addresses, payment cards, IBANs,
social security numbers) are found by loose patterns. Labelers vote on each, for (1),
against (0) or not at all (-1): strict patterns, checksums, gazetteers, the words around,
other candidates near by, and the shape of the surroundings. Expectation-maximisation over
the vote patterns of the whole corpus, counted, estimates for each kind the share of true
candidates and how reliable each labeler is on true and on false ones; its posteriors train
the final classifier, a logistic regression on votes, kind, length and share of digits,
which decides on every span.

The corpus is gathered as counts of vote patterns, whose number is bounded by the labelers
and not by the data (six kinds, three votes of each of six labelers, 20 shapes: 87,480 rows
at most, a broadcast of some 5 MB). Overlapping candidates: the earlier kind of KINDS goes first, then the
earlier start.

Defined results: null and empty texts have no spans and stay as they are; a probability that
equals the threshold is enough; digits are ASCII digits; a null doc_id is
reported as null; repeated rows are treated each; a corpus without candidates, or an empty
table, gives no spans. Whole texts are scanned. Only doc_id and text (and n_chars, where
texts are masked) are used, so other columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

THRESHOLD = 0.5
LABELERS = ("format", "checksum", "gazetteer", "context", "neighbour", "surroundings")
#: kind -> loose pattern; a mail address is looked for around its "@".
LOOSE: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"[\w.+%-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}"),
    "iban": re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){3,7}(?: ?[A-Za-z0-9]{1,3})?\b"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])|(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.+])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w]|\.[0-9])|(?<![\w.])\+[0-9]{1,3}(?:[ ./-]?\(?[0-9]{1,5}\)?){2,7}(?![\w]|\.[0-9])|(?<![\w.])\(0[0-9]{1,5}\) ?[0-9]{4,9}(?!\w)|(?<![\w.])0[0-9]{2,5}[ /-][0-9]{5,9}(?!\w)"),
}
KINDS = tuple(LOOSE)
STRICT: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"[\w+%-]+(?:\.[\w+%-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"),
    "ssn": re.compile(r"(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ ./-]?\(?[0-9]{1,5}\)?){2,7}|\(?0[0-9]{1,5}\)?[ /-]?[0-9]{4,9}"),
}
#: Public top-level domains, calling codes, card prefixes and IBAN countries.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co me eu de fr es it nl be ch at uk us ca au nz jp cn in br mx ar cl pt pl se no fi dk ie cz ru ua za kr".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 353 351 352 358 380 420 421".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE SK".split())
CARDS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4)|35|30|36|38")
FOR: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|correo|kontakt|courriel|mailto)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login|from)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|tél|teléfono|whatsapp)\b"),
}
AGAINST: dict[str, re.Pattern[str]] = {
    "ip": re.compile(r"(?i)\b(?:version|release|build|section|v)\s*\.?$"),
    "card": re.compile(r"(?i)\b(?:isbn|order|invoice|tracking|serial|timestamp|id|issn|ean|barcode)\b[\s:#no.]*$"),
    "phone": re.compile(r"(?i)\b(?:isbn|pages?|pp|lines?|rows?|order|serial)\b[\s:#.]*$"),
    "ssn": re.compile(r"(?i)\b(?:isbn|part|serial|order)\b[\s:#no.]*$"),
}
#: What every candidate has in it: texts without are left out in the JVM.
TRIGGER = "[0-9@]|:[A-Fa-f]{0,4}:"
#: Steps of a candidate's length and of its share of digits, so that the patterns are bounded in number.
LENGTHS, DIGITS = 5, 4
SPANS = "doc_id bigint, start bigint, stop bigint, kind string, pattern string"
Span = tuple[int, int, str, str]


def luhn(digits: str) -> bool:
    """For ASCII digits."""
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """For ASCII letters, digits and spaces."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def valid_ip(s: str) -> bool:
    try:
        ip_address(s)
    except ValueError:
        return all(x.isascii() and x.isdigit() and int(x) < 256 for x in s.split("."))
    return True


def loose_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates without overlap, in order of their start."""
    found: list[tuple[int, int, str]] = []
    for kind, rx in LOOSE.items():
        if kind == "email":
            hits, at = [], -1
            while (at := text.find("@", at + 1)) >= 0:
                # the local part, backwards from the "@"
                start = at
                while start and at - start < 64 and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
                    start -= 1
                if m := rx.match(text, start):
                    hits.append((m.start(), m.end() - (text[m.end() - 1] in ".-")))
        else:
            hits = [m.span() for m in rx.finditer(text)]
        for a, b in hits:
            k = bisect_left(found, (a,))
            if (not k or found[k - 1][1] <= a) and (k == len(found) or b <= found[k][0]):
                found.insert(k, (a, b, kind))
    return found


def vote(text: str, a: int, b: int, kind: str, near: bool) -> str:
    """One character a labeler ("+", "-", or "." for none), then the classifier's own features: length and share of digits, in steps."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    before, after = text[max(0, a - 40) : a], text[b : b + 1]
    form = STRICT[kind].fullmatch(s) is not None
    check: bool | None = None
    if kind == "card":
        check = True if luhn(digits) else None
        if len(set(digits)) == 1:
            check = False
    elif kind == "iban":
        check = mod97(s) or None
    elif kind == "ip":
        check = valid_ip(s)
        form = check if ":" in s else form
    elif kind == "phone":
        check = (8 if s[0] == "+" else 9 if s[0] in "(0" else 10) <= len(digits) <= 15
        form = form and check
    elif kind == "ssn":
        check = form
    known: bool | None = None
    if kind == "email":
        known = True if s.rsplit(".", 1)[-1].lower() in DOMAINS else None
    elif kind == "phone":
        known = True if s[0] == "+" and digits.startswith(CALLING) else None
    elif kind == "card":
        known = True if CARDS.match(digits) else None
    elif kind == "iban":
        known = s[:2].upper() in IBAN_COUNTRIES
    elif kind == "ip":
        known = False if s.startswith("0.") or s.startswith(("127.", "255.255.")) else None
    around: bool | None = True if FOR[kind].search(before) else None
    if kind in AGAINST and AGAINST[kind].search(before):
        around = False
    edges = (not before or before[-1].isspace() or before[-1] in "\"'(<[{:;,=|") and (not after or after.isspace() or after in "\"')>]}:;,.!?|")
    votes = (form, check, known, around, True if near else None, True if edges else None)
    return "".join("." if v is None else "-+"[v] for v in votes) + str(min(LENGTHS - 1, len(s) // 8)) + str(len(digits) * (DIGITS - 1) // len(s))


def candidates(text: str) -> list[Span]:
    """(start, stop, kind, pattern) of every candidate span."""
    spans = loose_spans(text)
    out = []
    for k, (a, b, kind) in enumerate(spans):
        near = (k > 0 and a - spans[k - 1][1] <= 80) or (k + 1 < len(spans) and spans[k + 1][0] - b <= 80)
        out.append((a, b, kind, vote(text, a, b, kind, near)))
    return out


def candidate_spans(docs: DataFrame) -> DataFrame:
    """The candidates of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = [(i, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in candidates(t)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in SPANS.split(", ")])

    return docs.select("doc_id", "text").where(F.col("text").rlike(TRIGGER)).mapInArrow(run, SPANS)


@dataclass
class Model:
    """By kind: the share of true candidates and each labeler's reliability on true and on false ones, by EM; and the classifier's weights."""

    rate: dict[str, float]
    reliability: dict[tuple[str, str], tuple[float, float]]
    weights: np.ndarray

    def probability(self, kind: str, pattern: str) -> float:
        return float(1 / (1 + np.exp(-features(kind, pattern) @ self.weights)))


def votes_of(pattern: str) -> list[float]:
    return [{"+": 1.0, "-": -1.0, ".": 0.0}[c] for c in pattern[: len(LABELERS)]]


def features(kind: str, pattern: str) -> np.ndarray:
    """Bias, votes (+1, -1, 0), kind, the kind's own format and checksum votes, length, and share of digits."""
    votes = votes_of(pattern)
    own = [v * (kind == k) for k in KINDS for v in votes[:2]]
    return np.array([1.0, *votes, *(float(kind == k) for k in KINDS), *own, int(pattern[-2]) / LENGTHS, int(pattern[-1]) / DIGITS])


def reliabilities(votes: np.ndarray, n: np.ndarray, prior: float, rounds: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """EM over one kind's vote patterns: share of true ones, P(+ | true, voted), P(- | false, voted), posteriors.

    A prior of eight right votes in ten, for each class, holds a labeler that seldom votes near that; none may count
    as worse than chance, which keeps the classes from changing places; the share has a prior of ten candidates.
    """
    hit, miss, rate = np.full(votes.shape[1], 0.8), np.full(votes.shape[1], 0.8), prior
    plus, minus = votes > 0, votes < 0
    for _ in range(rounds):
        odds = np.log(rate / (1 - rate)) + plus @ np.log(hit / (1 - miss)) + minus @ np.log((1 - hit) / miss)
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        true, false = n * p, n * (1 - p)
        hit = np.clip((true @ plus + 8) / (true @ (plus | minus) + 10), 0.55, 0.99)
        miss = np.clip((false @ minus + 8) / (false @ (plus | minus) + 10), 0.55, 0.99)
        rate = float(np.clip((true.sum() + 10 * prior) / (n.sum() + 10), 0.02, 0.98))
    return rate, hit, miss, p


def fit(counts: Mapping[tuple[str, str], int], prior: float = 0.5, rounds: int = 50) -> Model:
    """EM over the counted vote patterns of each kind, then one logistic regression on all posteriors."""
    keys = sorted(counts)
    width = len(features(KINDS[0], "." * len(LABELERS) + "00"))
    if not keys:
        return Model({}, {}, np.zeros(width))
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([votes_of(pattern) for _, pattern in keys])
    p = np.zeros(len(keys))
    rate, reliability = {}, {}
    for kind in KINDS:
        own = [i for i, (k, _) in enumerate(keys) if k == kind]
        if own:
            rate[kind], hit, miss, p[own] = reliabilities(votes[own], n[own], prior, rounds)
            reliability |= {(kind, name): (float(a), float(b)) for name, a, b in zip(LABELERS, hit, miss, strict=True)}
    x = np.stack([features(*k) for k in keys])
    start = np.zeros(width)
    start[1 : 1 + len(LABELERS)] = 1.0
    w = start.copy()
    share = n / n.sum()
    for _ in range(60):  # Newton steps with a ridge towards one vote, one unit of odds
        q = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (share * (q - p)) + 1e-4 * (w - start)
        hess = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return Model(rate, reliability, w)


def fit_corpus(spans: DataFrame) -> tuple[Model, dict[tuple[str, str], float]]:
    """The model of the corpus's candidates, and the probability of each pattern that occurs."""
    counts = {(r["kind"], r["pattern"]): r["n"] for r in spans.groupBy("kind", "pattern").agg(F.count("*").alias("n")).collect()}
    model = fit(counts)
    return model, {k: model.probability(*k) for k in counts}


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, stop, kind, probability) of each span the classifier takes for personal data."""
    spans = checkpointed(candidate_spans(docs))
    _, probability = fit_corpus(spans)
    rows = [(*k, p) for k, p in sorted(probability.items())]
    scores = docs.sparkSession.createDataFrame(rows, "kind string, pattern string, probability double")
    return spans.join(F.broadcast(scores), ["kind", "pattern"]).where(F.col("probability") >= threshold).select("doc_id", "start", "stop", "kind", "probability")


def mask(text: str, probability: Mapping[tuple[str, str], float], threshold: float) -> str:
    out, at = [], 0
    for a, b, kind, pattern in candidates(text):
        if probability.get((kind, pattern), 0.0) >= threshold:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]]) if out else text


def mask_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span found replaced by its kind in brackets, and n_chars, if there is one, counted anew there.

    Columns and rows stay; a text without findings stays as it is. The candidates are found
    in one scan for the counts and in another for masking, so no text is shuffled.
    """
    _, probability = fit_corpus(candidate_spans(docs))
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    trigger = re.compile(TRIGGER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            masked = [mask(t, probability, threshold) if t and trigger.search(t) else t for t in texts]
            columns = list(b.columns)
            columns[text_at] = pa.array(masked, b.schema.field(text_at).type)
            if chars_at is not None:
                counts = [n if new is old else len(new) for n, new, old in zip(columns[chars_at].to_pylist(), masked, texts, strict=True)]
                columns[chars_at] = pa.array(counts, b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
