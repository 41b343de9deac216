"""Personal data by weak supervision: three labelers vote on candidate spans, and a span classifier learns from the votes.

Candidates are the spans of strict rules (the base, which always stay) and of looser ones: spelled-out e-mail addresses,
national phone numbers, account numbers and names of people. A regex, a gazetteer and a context labeler each vote yes,
no or not at all. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each
kind, and with that how likely each pattern is a true span; these soft labels train a naive Bayes classifier on hashed features of
the span and the words around it. Looser candidates that it accepts are added.

Everything learned is a function of counts per (kind, votes, feature), a table whose size does not depend on the
corpus; all documents enter it. Text is read twice, and no text is shuffled.

Defined results: a null text is empty and has no spans; spans are code point offsets, end exclusive, ordered by kind and start; a looser
span that overlaps a base span is dropped; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "person")
FEATURES = 512
WINDOW = 40
#: Pseudo counts with which each labeler starts: right in 8 of 10 cases.
PRIOR_RIGHT, PRIOR_WRONG = 8.0, 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TWO_DIGITS = re.compile(r"[0-9]{2}")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?[A-Za-z0-9-]{2,63}){1,4}\b")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_WORD = re.compile(r"[^\W\d_]+")

# Common given names, mail domains, card issuers' first digits and words that announce each kind.
NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Sandra Paul Emily Andrew Anna Hans Klaus Jürgen Wolfgang Ursula "
    "Sabine Monika Pierre Jean Marie Nathalie Isabelle Philippe Carlos José Juan Antonio Carmen Pilar Miguel Lucía".split()
)
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
ANNOUNCE = {
    "email": frozenset("email mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip address host server client from login".split()),
    "card": frozenset("card visa credit mastercard amex payment karte tarjeta carte".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell telefon anrufen llamar".split()),
    "account": frozenset("iban account bank konto cuenta compte".split()),
    "person": frozenset("name named mr mrs ms dr dear sincerely herr frau señor madame".split()),
}
DENY = frozenset("version isbn issn order invoice section chapter figure table page article release build".split())

#: One or more given names and a surname, with or without a title; a search can begin at a given name or at a title before it only.
_GIVEN = "(?:" + "|".join(sorted(NAMES)) + ")"
_PERSON = re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|M|Sr|Sra)\.?\x20)?{_GIVEN}(?:\x20{_GIVEN})*\x20[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{{2,20}}(?!\w)")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, int, int] = (0, 0, 0)
    features: tuple[int, ...] = ()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strict rules: leftmost and not overlapping within a kind; what a rule's check refuses is not tried again.

    Written so that the time is linear in the text, also for long runs of digits or letters.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(last, at + 1))
    for m in _DOTTED.finditer(text):
        part, at = m[0].split("."), m.start()
        for i in range(0, len(part) - 3, 4):
            size = sum(map(len, part[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in part[i : i + 4]):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _looser(text: str) -> Iterator[tuple[str, int, int]]:
    if " dot " in text or "dot]" in text or "dot)" in text:
        yield from (("email", m.start(), m.end()) for m in _SPELLED.finditer(text))
    if _TWO_DIGITS.search(text):
        yield from (("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text))
        yield from (("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text))
    if any(name in text for name in NAMES):
        yield from (("person", m.start(), m.end()) for m in _PERSON.finditer(text))


def _regex_vote(kind: str, own: str, base: bool) -> int:
    if base:
        return 1
    if kind == "account":  # the usual check: letters as numbers, the first four behind the rest, modulo 97
        flat = own.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == "phone":
        return 1 if len(set(own) & set("-.() ")) >= 1 and own.lstrip("(")[0] in "23456789" else -1
    return 1 if kind == "email" else 0


def _gazetteer_vote(kind: str, own: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", own.rstrip(")]"))[-1].lower() in ENDINGS else -1
    if kind == "card":
        return 1 if own.startswith(ISSUERS) else -1
    if kind == "person":
        return 1 if own.split()[-2] in NAMES else 0
    return 0


def _context_vote(kind: str, before: list[str]) -> int:
    return 1 if ANNOUNCE[kind] & set(before) else -1 if DENY & set(before) else 0


def _features(kind: str, own: str, before: list[str]) -> tuple[int, ...]:
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", own)))[:24]
    tokens = [f"shape {shape}", f"size {len(own) // 4}", *(f"near {w}" for w in set(before[-3:]))]
    return tuple(sorted({xxhash.xxh3_64_intdigest(f"{kind} {t}".encode()) % FEATURES for t in tokens}))


def candidates(text: str) -> list[Span]:
    """Base spans and looser ones that do not touch them, with votes and features."""
    base = base_spans(text)
    found = [(k, a, b, True) for k, a, b in base]
    taken = None  # a byte per character, made only if there is a looser span
    for kind, a, b in _looser(text):
        if taken is None:
            taken = bytearray(len(text))
            for _, x, y in base:
                taken[x:y] = b"\x01" * (y - x)
        if taken.find(1, a, b) < 0:
            found.append((kind, a, b, False))
            taken[a:b] = b"\x01" * (b - a)
    out = []
    for kind, a, b, is_base in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])):
        own, before = text[a:b], [w.lower() for w in _WORD.findall(text[max(0, a - WINDOW) : a])]
        votes = (_regex_vote(kind, own, is_base), _gazetteer_vote(kind, own), _context_vote(kind, before))
        out.append(Span(kind, a, b, is_base, votes, _features(kind, own, before)))
    return out


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation for one kind: the share of right votes of each labeler, and how likely each pattern is true."""
    right, share = np.full(3, PRIOR_RIGHT / (PRIOR_RIGHT + PRIOR_WRONG)), 0.5
    truth = {}
    for _ in range(rounds):
        for votes in counts:
            yes, no = share, 1 - share
            for v, r in zip(votes, right, strict=True):
                if v:
                    yes *= r if v > 0 else 1 - r
                    no *= 1 - r if v > 0 else r
            truth[votes] = yes / (yes + no)
        good, all_ = np.full(3, PRIOR_RIGHT), np.full(3, PRIOR_RIGHT + PRIOR_WRONG)
        for votes, n in counts.items():
            for i, v in enumerate(votes):
                if v:
                    good[i] += n * (truth[votes] if v > 0 else 1 - truth[votes])
                    all_[i] += n
        right = good / all_
        share = (sum(n * truth[v] for v, n in counts.items()) + 1) / (sum(counts.values()) + 2)
    return right, truth


@dataclass(frozen=True)
class SpanModel:
    """Per kind: reliabilities of the labelers, log odds of a true span, and log odds that each feature adds."""

    right: dict[str, np.ndarray]
    odds: dict[str, float]
    weights: dict[str, np.ndarray]

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        out = []
        for s in candidates(text or ""):
            logit = self.odds[s.kind] + self.weights[s.kind][list(s.features)].sum()
            score = float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            if s.base or score >= 0.5:
                out.append((s.kind, s.start, s.end, s.base, score))
        return out


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Learn from the candidates of all texts; at most kinds x 27 x (features + 1) rows of counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                for s in candidates(value.as_py() or ""):
                    table.update((s.kind, *s.votes, f) for f in (-1, *s.features))
        rows = list(zip(*([*k, n] for k, n in table.items()), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(rows)], names=["kind", "r", "g", "c", "feature", "n"])

    counts = docs.select(F.col(text).cast("string")).mapInArrow(count, "kind string, r bigint, g bigint, c bigint, feature bigint, n bigint")
    rows = counts.groupBy("kind", "r", "g", "c", "feature").agg(F.sum("n").alias("n")).collect()
    right, odds, weights = {}, {}, {}
    for kind in KINDS:
        own = {p: 0.0 for p in product((-1, 0, 1), repeat=3)}
        own |= {(x.r, x.g, x.c): float(x.n) for x in rows if x.kind == kind and x.feature < 0}
        right[kind], truth = reliabilities({p: n for p, n in own.items() if n})
        true, false = np.full(FEATURES, 0.5), np.full(FEATURES, 0.5)
        yes = sum(n * truth[p] for p, n in own.items() if n)
        no = sum(own.values()) - yes
        for x in rows:
            if x.kind == kind and x.feature >= 0:
                p = truth[(x.r, x.g, x.c)]
                true[x.feature] += x.n * p
                false[x.feature] += x.n * (1 - p)
        odds[kind] = float(np.log((yes + 1) / (no + 1)))
        weights[kind] = np.log(true / (yes + 1)) - np.log(false / (no + 1))
    return SpanModel(right, odds, weights)


def spans_of(model: SpanModel, text: Column, spark) -> Column:
    """Column of spans: array of (kind, start, end, base, score), by kind in the order of ``KINDS`` and by start."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint, base: boolean, score: double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "score")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in shared.value.spans(t)] for t in texts], dtype=object)

    return found(text.cast("string"))


def redacted(model: SpanModel, text: Column, spark) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans, one mark covers all. Null stays null."""
    shared = spark.sparkContext.broadcast(model)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for kind, start, end, *_ in sorted(shared.value.spans(value), key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [value[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, value[at:]])

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(clean, na_action="ignore")

    return cleaned(text.cast("string"))
