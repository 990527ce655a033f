"""Secret scans with DataFrame functions only.

Base spans follow three fixed patterns. The method adds spans: candidate
strings of one character class are scanned with a sliding window whose Shannon
entropy is kept up to date by incremental counts (one symbol enters, one
leaves); the largest window entropy is held against the class's threshold.
Candidates on the allow list, and those that touch a base span, are not added.
A path, flag or name is on it only if every part between its separators is a
word, a number or short; else a candidate counts whole, by the class of its most
telling part.

Defined results: null and empty texts have no spans; positions are code points,
ends are exclusive; equal texts have equal spans; other columns are ignored
whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns; letters of the first one's names match in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a symbol from which a window of a class is random. Plain words never count.
THRESHOLDS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("hex part", r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{20,}(?![A-Za-z0-9])", 3.0),
    ("alnum part", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-z]{20,}(?![A-Za-z0-9])", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).+$", 3.8),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.6),
)
#: An ordinary part of a path, flag or name: a UUID, a few characters, words with digits at the end, or digits.
PART = r"(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[A-Za-z0-9]{1,7}|(?:[A-Z]?[a-z]++)++[0-9]*+|[A-Z]++[0-9]*+|[0-9]++)(?![A-Za-z0-9])"
#: Strings that look random and aren't secrets.
ALLOWED = (
    r"(?i)example",
    r"(?i)placeholder",
    r"(?i)^x+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)^sha(1|256|384|512)-",
    r"^(0123456789|abcdefghij|ABCDEFGHIJ)",
    rf"^(?=[/_=+-]|.*(?://|--|__))(?:[/_=+-]++|{PART})++$",
)

#: Symbols of the alphabet whose counts share one number, and the bits of a count.
PACKED, COUNT_BITS = 12, 5
#: Matches that are put in place together: keeps the work in proportion to their number.
RUN = 256

_SPANS = "array<struct<s:int,e:int,v:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(rows: Column, start: Column, least: int) -> Column:
    """Spans of matches (p: text before, f: match, g: group) from a position on."""
    first = F.struct(start.alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["f"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["f"].alias("v")))
        return F.struct(e.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, first, step, lambda a: a["out"])


def spans(text: Column, pattern: str, keep_group: int = 0, least: int = 0) -> Column:
    """Spans (s, e, v: the match) of all leftmost, non-overlapping matches; those whose group is shorter than ``least`` are dropped.

    The pieces between the matches and the matches themselves give the
    positions: each start is the length of all that stands before. Lengths are
    summed over runs of matches first, so that no array grows past a run.
    """
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group)) if keep_group else found
    every = bound(found, lambda f: F.arrays_zip(F.slice(parts, 1, F.size(f)).alias("p"), f.alias("f"), (group if keep_group else f).alias("g")))

    def place(rows: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda k: F.slice(rows, k * RUN + 1, RUN))
        return bound(runs, starts)

    def starts(runs: Column) -> Column:
        long = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + F.length(x["p"]) + F.length(x["f"])))
        at = F.aggregate(long, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(runs, F.slice(at, 1, F.size(runs)), lambda r, s: _placed(r, s, least)))

    return F.when(F.rlike(text, F.lit(pattern)), bound(every, place)).otherwise(_none())


def window_entropy(value: Column, size: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of ``size`` symbols of a candidate.

    The state holds the counts of the alphabet's symbols, ``PACKED`` of them to
    a number, and the sum of c*log2(c); a step adds the entering symbol's one
    and takes the leaving symbol's. Time is linear in the candidate's length.
    """
    if size >= 1 << COUNT_BITS:
        raise ValueError(f"windows of at most {(1 << COUNT_BITS) - 1} symbols")
    weigh = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(size + 2)))
    words = -(-(len(ALPHABET) + 1) // PACKED)
    # a symbol is its number among the packed counts (from 1) and its count's place there
    code = lambda c: F.struct((F.floor(c / PACKED) + 1).cast("int").alias("at"), ((c % PACKED) * COUNT_BITS).cast("int").alias("by"))
    symbols = F.transform(F.split(value, ""), lambda c: code(F.instr(F.lit(ALPHABET), c)))
    shift = lambda n, by: F.call_function("shiftleft", F.lit(n).cast("long"), by)
    held = lambda n, x: F.call_function("shiftright", F.element_at(n, x["at"]), x["by"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def scan(all_: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("n"), F.lit(0.0).alias("w"), F.lit(1e9).alias("least"), F.lit(0).alias("i"))

        def changed(n: Column, w: Column, x: Column, by: int) -> Column:
            return F.struct(F.transform(n, lambda c, k: F.when(k + 1 == x["at"], c + shift(by, x["by"])).otherwise(c)).alias("n"), w.alias("w"))

        def step(acc: Column, into: Column) -> Column:
            i = acc["i"] + 1

            def entered(s: Column) -> Column:
                out = F.element_at(all_, F.greatest(i - size, F.lit(1)))
                gone = held(s["n"], out)
                left = changed(s["n"], s["w"] + F.element_at(weigh, gone) - F.element_at(weigh, gone + 1), out, -1)
                return bound(F.when(i > size, left).otherwise(s), lambda t: F.struct(t["n"].alias("n"), t["w"].alias("w"), F.when(i >= size, F.least(acc["least"], t["w"])).otherwise(acc["least"]).alias("least"), i.alias("i")))

            had = held(acc["n"], into)
            return bound(changed(acc["n"], acc["w"] + F.element_at(weigh, had + 2) - F.element_at(weigh, had + 1), into, 1), entered)

        return F.aggregate(all_, start, step, lambda a: F.lit(math.log2(size)) - a["least"] / size)

    return bound(symbols, scan)


def is_random(value: Column) -> Column:
    """Does a candidate's largest window entropy reach the threshold of its character class?"""
    need = F.lit(None).cast("double")
    for _, pattern, bits in reversed(THRESHOLDS):
        need = F.when(F.rlike(value, F.lit(pattern)), F.lit(bits)).otherwise(need)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(pattern))
    return F.when(allowed | need.isNull(), F.lit(False)).otherwise(window_entropy(value) >= need)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and an array of spans (s, e, v: the matched text) per kind."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", spans(text, ASSIGN, 2, MIN_ASSIGNED).alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, CANDIDATE).alias("candidates"))
    base = F.concat("assign", "access", "hex")
    # written out as lambdas over one struct, so that the base spans are built once a row
    free = F.filter("candidates", lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    found = F.filter(free, lambda c: is_random(c["v"]))
    return rows.withColumn("base", base).withColumn("entropy", found).select("doc_id", "text", *KINDS)


def _said(kinds: tuple[str, ...]) -> Column:
    tagged = [F.transform(k, _tag(KINDS.index(k), k)) for k in kinds]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _tag(place: int, kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("place"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def digest(rows: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts[:3], F.sha2(_said(KINDS[:3]), 256).alias("base_sha256"), _said(KINDS).alias("spans"), counts[3])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns of ``docs``, with every span of the text replaced by ``mark`` and ``n_chars`` (if there) counted anew.

    Overlapping spans are replaced together; a null text stays null. Only texts
    with spans are rewritten.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found_, candidates, every, clean_ = fresh(docs, "_base", "_candidates", "_all", "_clean")
    work = docs.withColumns({found_: F.concat(spans(text, ASSIGN, 2, MIN_ASSIGNED), spans(text, ACCESS), spans(text, HEX)), candidates: spans(text, CANDIDATE)})
    free = F.filter(candidates, lambda c: ~F.exists(F.col(found_), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    found = F.filter(free, lambda c: is_random(c["v"]))
    work = work.withColumn(every, F.array_sort(F.concat(found_, found)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        new = F.struct(x["e"].alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))
        return F.when(x["s"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(every, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    work = work.withColumn(clean_, F.when(F.size(every) > 0, clean).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)
    out = [F.col(clean_).alias("text") if c == "text" else F.when(F.size(every) > 0, F.length(clean_).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return work.select(*out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
