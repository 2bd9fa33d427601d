"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

`find_spans` works on one whole text. The kinds email, ip, card and phone are the base ones: leftmost,
non-overlapping matches per kind; a match that fails its check is dropped. They keep their place
whatever their score. Further kinds are added where they overlap no base span and none added before:

- iban: country, check digits and account, confirmed by the mod-97 rule; words in capitals and numbers after
  the account may look like a part of it, so every end at a word's end is tried, the country's length first;
- secret: a value assigned to a name such as token or api_key, confirmed if its characters vary like random ones;
- local_phone, national_id: number shapes without a checksum, kept only where a word near them
  lifts the score to `threshold`.

Defined cases: a null or empty text has no spans; each row gives one row, repeated rows included;
offsets count code points, the end is exclusive; other columns are not carried along. All scans are
linear in the text, and spans are merged by search in sorted starts, so neither long runs nor many spans do harm.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds in listed order, base ones first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "local_phone", "national_id")

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Every start, with the longest run of characters behind it that may belong to the account.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])\(?0?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|token|secret|passw(?:or)?d)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_=.-]{16,}+)"
)
_NOT_DIGIT = re.compile(r"[^0-9]")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
# Lengths of the accounts by country, without spaces; they only say which end is tried first.
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_WINDOW = 48
_WORD = re.compile(r"[^\W\d_]+")
# Score of a confirmed shape before its surroundings are read.
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.8, "local_phone": 0.3, "national_id": 0.3}
_NEAR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "credit", "debit", "payment", "mastercard"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
    "iban": {"iban", "account", "bank", "transfer"},
    "secret": {"credentials", "private", "login", "auth"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
    "national_id": {"ssn", "social", "security", "identity"},
}
_AGAINST = {
    "ip": {"version", "release", "section"},
    "secret": {"example", "placeholder", "sample"},
    "card": {"order", "tracking", "serial", "token", "key"},
    "local_phone": {"order", "invoice", "serial", "part"},
    "national_id": {"order", "invoice", "serial", "part"},
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


# Bits a character of a secret carries at least, by the frequencies of its own characters.
SECRET_BITS = 2.8


def varied(value: str) -> bool:
    """Whether the characters of a value are spread like those of a generated one."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= SECRET_BITS


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at sign: the run of local characters not used by an earlier match, then a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start not used by an earlier match: the end at the country's length, or else the longest, that passes mod-97."""
    free = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < free:
            continue
        ends = [e for e in range(m.end(1), start + 14, -1) if text[e - 1] != " " and text[e : e + 1] not in _ALNUM]
        accounts = [(e, a) for e in ends if len(a := text[start:e].replace(" ", "")) >= 15]
        accounts.sort(key=lambda x: len(x[1]) != _IBAN_LENGTHS.get(x[1][:2]))
        if (end := next((e for e, a in accounts if mod97(a)), None)) is not None:
            yield start, end
            free = end


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SECRET.finditer(text):
        if varied(m[1]):
            yield "secret", m.start(1), m.end(1)
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end()
    for m in _NATIONAL_ID.finditer(text):
        yield "national_id", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - _WINDOW) : start] + "\n" + text[end : end + _WINDOW // 2])}
    score = _START[kind] + 0.3 * bool(near & _NEAR[kind]) - 0.3 * bool(near & _AGAINST.get(kind, set()))
    return round(min(1.0, max(0.0, score)), 2)


class _Taken:
    """Places that are taken: given ranges, which may overlap, and those added since, which do not."""

    def __init__(self, ranges: list[tuple[int, int]]):
        ranges = sorted(ranges)
        self.starts, self.ends, high = [a for a, _ in ranges], [], 0
        for _, b in ranges:
            high = max(high, b)
            self.ends.append(high)
        self.added: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> bool:
        """Take a range if it is free."""
        k = bisect_left(self.starts, end)
        if k and self.ends[k - 1] > start:
            return False
        k = bisect_left(self.added, (end, 0))
        if k and self.added[k - 1][1] > start:
            return False
        self.added.insert(k, (start, end))
        return True


def find_spans(text: str, threshold: float = 0.5) -> list[Span]:
    """All spans of one text, ordered by start, then kind as listed."""
    spans = [Span(k, s, e, _score(text, k, s, e)) for k, s, e in _proposals(text)]
    kept = [s for s in spans if s.kind in BASE_KINDS]
    taken = _Taken([(s.start, s.end) for s in kept])
    kept += [s for s in spans if s.kind not in BASE_KINDS and s.score >= threshold and taken.add(s.start, s.end)]
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind)))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per text: the key and `spans`, an array of (kind, start, end, score)."""
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in find_spans(v, threshold)] if v else [] for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, _SPANS)], names=["key", "spans"])

    kind = source.schema["key"].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int,score:double>>"
    return source.mapInArrow(run, f"key {kind}, spans {spans}").withColumnRenamed("key", key)
