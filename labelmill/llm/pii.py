"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score.

Every proposed span has a prior by kind, raised or lowered by context words within 40 characters before and 20
after it.  The four base kinds are always reported with their score; the kinds that this method adds must reach ``threshold``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
THRESHOLD = 0.6
BEFORE, AFTER = 40, 20

# The base patterns.  The runs that open a pattern start where no run of the same kind is under way, which
# finds the same leftmost matches in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|"
    r"(?:password|passwd|api_key|secret|token)=[^\s&;,]{6,})")
_DIGITS = re.compile(r"[0-9]")
# Lengths of IBANs by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LT": 20, "LU": 20, "LV": 21,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.8}
# Context words, in four languages.
NEAR = {
    "email": r"mail|contact|kontakt|correo|courriel|write to",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|appel|llam|anruf|t[ée]l",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|social|security|taxpayer",
    "secret": r"key|token|secret|password|login|user",
}
AGAINST = r"example|sample|test|version|isbn|invoice|order|serial|dummy|beispiel|exemple|ejemplo"
_NEAR = {k: re.compile(v, re.IGNORECASE) for k, v in NEAR.items()}
_AGAINST = re.compile(AGAINST, re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Country length and the check digits of an IBAN without blanks."""
    if IBAN_LENGTH.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an @, cut at the end of the match before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every span that its validator confirms, by kind, then start; offsets in code points."""
    for s, e in _emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        yield "secret", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised by a supporting word nearby and lowered by a contrary one."""
    around = text[max(0, start - BEFORE):start] + " " + text[end:end + AFTER]
    return min(1.0, max(0.0, PRIOR[kind] + 0.25 * bool(_NEAR[kind].search(around))
                        - 0.25 * bool(_AGAINST.search(around))))


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score).  Base kinds always stay; added kinds need ``threshold``."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in propose(text)] if text else []
    return [x for x in found if x[0] in BASE_KINDS or x[3] >= threshold]


def detect(text: Column, threshold: float = THRESHOLD) -> Column:
    """array<struct<kind, start, end, score>>; empty for null or empty text."""
    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), x)) for x in find_spans(t, threshold)]
                             for t in texts], dtype=object)

    return spans(text)


def redacted(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """Spans replaced by their kind; of overlapping spans the joint stretch becomes the first one's kind."""
    spans = sorted((s, -e, k) for k, s, e, _ in find_spans(text, threshold))
    if not spans:
        return text
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, -end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
           threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data replaced by its kind and ``length`` (where there is such a column) brought up to
    date for the rows that changed.  No row is dropped; null text stays null."""
    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, threshold) for t in texts], dtype=object)

    name = fresh(docs, "_clean")
    out = docs.withColumn(name, clean(F.col(text)))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        changed = ~F.col(name).eqNullSafe(F.col(text))
        out = out.withColumn(length, F.when(changed, F.length(name).cast(kind)).otherwise(F.col(length)))
    return out.withColumn(text, F.col(name)).drop(name)


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of their spans, and all spans."""
    out = docs.select("doc_id", detect(F.col("text")).alias("_s"))
    kinds = {k: i for i, k in enumerate(KINDS)}
    # The detector yields spans by kind in the listed order, then by start.
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("_s", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("_s", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds if k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("_s", name), ",").alias("spans"))


def base_digest(text: str | None) -> str:
    spans = [x[:3] for x in find_spans(text) if x[0] in BASE_KINDS]
    return hashlib.sha256(joined(spans).encode()).hexdigest()
