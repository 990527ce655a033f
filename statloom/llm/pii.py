"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns; every base span is
kept whatever its score. Further kinds (iban by its country's length and mod-97,
imei and national ids by Luhn, ssn by its ranges) are added if their score, with
the words nearby, reaches ``MIN_SCORE``. National ids are Canada's SIN, Sweden's
personnummer and South Africa's id. An imei has a card's shape: words of devices,
and none of cards, nearby add it beside the card's span.

Defined results: null and empty texts have no spans; equal texts have equal
spans; texts of any length are scanned in time linear in their length; other
columns are ignored whatever their names are.
"""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "imei", "national")
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start at the head of a run of digits only, and ends at the end of one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_IMEI = re.compile(r"(?<![0-9])[0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{6}[ -]?[0-9](?![0-9])")
_NATIONAL = re.compile(
    r"(?<![0-9-])(?:[1-79][0-9]{2}([ -]?)[0-9]{3}\1[0-9]{3}|[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[-+][0-9]{4}|[0-9]{4}[01][0-9]{2}))(?![0-9-])"
)
_DIGIT = re.compile(r"[0-9]")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, said in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in said.split()
}

#: Score of a confirmed span without context.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "imei": 0.4, "national": 0.4}
#: Words that raise a kind's score if they stand nearby.
RAISE = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security"),
    "imei": ("imei", "device", "serial"),
    "national": ("personnummer", "identity", "insurance", "social", "citizen", "sin"),
}
#: Words that lower any score.
LOWER = ("example", "sample", "version", "test", "dummy")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds: leftmost, not overlapping within a kind, failing ones dropped."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def ibans(text: str) -> list[tuple[str, int, int]]:
    """IBANs, in groups or not: as long as their country says, or, in other countries, up to the last end of a group that mod-97 confirms."""
    out, end = [], 0
    for m in _IBAN.finditer(text):
        start, at, n, ends = m.start(), m.start(), 0, {}
        if start < end:
            continue
        while n < 34 and at < len(text):
            at += n > 0 and text[at] == " "
            if not (text[at : at + 1].isascii() and text[at : at + 1].isalnum() and not text[at].islower()):
                break
            at, n = at + 1, n + 1
            if not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()):
                ends[n] = at
        known = IBAN_LENGTHS.get(m[0][:2])
        for k in sorted((k for k in ends if (k == known if known else k >= 15)), reverse=True):
            if mod97(text[start : ends[k]]):
                end = ends[k]
                out.append(("iban", start, end))
                break
    return out


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the further kinds."""
    out = ibans(text)
    out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out += [("imei", *m.span()) for m in _IMEI.finditer(text) if luhn(_digits(m[0]))]
    out += [("national", *m.span()) for m in _NATIONAL.finditer(text) if luhn(_digits(m[0]))]
    return out


def near_words(text: str, start: int, end: int) -> set[str]:
    return set(re.findall(r"[a-z]+", f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()))


def score(text: str, kind: str, start: int, end: int) -> float:
    """A confirmed span's score: 0.25 more for a word of its kind nearby, 0.3 less for a word that marks examples."""
    near = near_words(text, start, end)
    s = BASE_SCORE[kind] + 0.25 * bool(near & set(RAISE[kind])) - 0.3 * bool(near & set(LOWER))
    return round(min(1.0, max(0.0, s)), 2)


def find(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base spans always, others from ``min_score`` on and where no base span lies (an imei may lie on a card's)."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*x, score(text, *x)) for x in base]
    taken, taken_but_cards = _Cover(base), _Cover([x for x in base if x[0] != "card"])
    for x in proposed(text):
        s = score(text, *x)
        device = x[0] == "imei" and not near_words(text, x[1], x[2]) & set(RAISE["card"])
        if s >= min_score and not (taken_but_cards if device else taken).meets(x[1], x[2]):
            out.append((*x, s))
    return out


class _Cover:
    """Does any of some spans overlap a range? A binary search each."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(itertools.accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and found: array of (kind, start, end, score), in code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def row(doc_id, text):
            return doc_id, [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(text, min_score)]

        return row

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,score:double>>")


def _is(kind: str):
    return lambda x: x["kind"] == F.lit(kind)


def _digested(found: str = "found") -> list:
    place = F.create_map(*(F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("s"), place[x["kind"]].alias("k"), x["end"].alias("e"), x["kind"].alias("kind"), x["score"].alias("score"))))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.size(F.filter(found, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return [*counts, F.sha2(said(F.filter(ordered, lambda x: x["k"] < 4)), 256).alias("base_sha256"), said(ordered).alias("spans"), F.array_join(F.transform(ordered, lambda x: x["score"].cast("string")), ",").alias("scores")]


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(table(spark, sf_dir, "documents"))
    top = F.array_max(F.transform("found", lambda x: x["score"]))
    return rows.select("doc_id", *_digested(), top.alias("max_score"))  # scores: in the order of spans
