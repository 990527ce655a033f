"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of 13 consecutive words of the benchmark items (items of fewer
words are one window) is a pattern of one automaton over normalised text; each
document is scanned once, and matches are mapped back to offsets of the
original text. Words are runs of A-Z, a-z, 0-9 and non-ASCII characters, with
A-Z lower-cased.

Defined results: null and empty texts have no words and are never
contaminated; null item ids are skipped, repeated item ids count once, items
without words match nothing; an empty benchmark leaves every document clean;
other columns are ignored whatever their names are.

The items reach the driver in pieces of ``CHUNK_BYTES`` of text; each piece is
one automaton and one more pass over the rows, without a shuffle, so neither
the driver nor a worker ever holds more than one piece.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_rows, sha256_hex, table

WINDOW = 13
#: Benchmark text that one automaton may hold; larger benchmarks take several passes.
CHUNK_BYTES = 8 << 20
MIN_SHARE = 20  # contaminated: hit words are at least 1/20 of the words

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Byte table: A-Z to a-z, other ASCII that is not part of a word to a space, UTF-8 bytes as they are.
_TABLE = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalised(text: str | None) -> tuple[str, int]:
    """The words, each with one space before and after, and their number."""
    words = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    return (f" {b' '.join(words).decode('utf-8')} ", len(words)) if words else ("", 0)


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    norm, n = normalised(text)
    words = norm.split(" ")[1:-1]
    if not n:
        return []
    return [f" {' '.join(words[i : i + size])} " for i in range(max(1, n - size + 1))]


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """Automaton over the windows; each value is (number of words, ids of the items that have the window)."""
    import ahocorasick

    found: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            found.setdefault(w, set()).add(item)
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(w, (w.count(" ") - 1, sorted(ids)))
    if found:
        auto.make_automaton()
    return auto, bool(found)


def hits(auto, norm: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges [first, end) inside matches, and the ids of the items found."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    found = list(auto.iter(norm))
    if not found:
        return ranges, items
    at = word = 0
    spans = []
    for end, (n, ids) in found:  # in order of their ends
        word += norm.count(" ", at, end + 1)
        at = end + 1
        last = word - 1  # words that end before this space
        spans.append((last - n, last))
        items.update(ids)
    for a, b in sorted(spans):
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
        else:
            ranges.append((a, b))
    return ranges, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word ranges in the text as it was."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(_ascii_lower(text))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    piece, held = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():  # a partition of the benchmark at a time
        piece.append((r["i"], r["t"]))
        held += len(r["t"])
        if held >= size:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


_CACHE: dict[str, tuple] = {}


def _cached(key: str, items: list[tuple[str, str]], window: int):
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = automaton(items, window)
    return _CACHE[key]


SCHEMA = "doc_id long, text string, n_words long, ranges array<struct<first:int,end:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text, n_words, hit word ranges and items found, of every document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = _pieces(benchmark, id_col="item_id", text_col="text", size=chunk_bytes)
    first, more = next(pieces, []), True
    done = False
    while more:
        following = next(pieces, None)
        more = following is not None
        sent = spark.sparkContext.broadcast(first)  # CHUNK_BYTES at most, and one text
        rows = map_rows(rows, _scanner(sent, window, done, keep_text or more), schema)
        first, done = following, True
    return rows


def _scanner(sent, window: int, again: bool, keep_text: bool):
    key = uuid.uuid4().hex  # of this pass, for the worker's cache

    def make():
        auto, any_ = _cached(key, sent.value, window)

        def row(doc_id, text, n_words=0, ranges=(), items=()):
            norm, n = normalised(text)
            found, ids = hits(auto, norm) if any_ and n else ([], set())
            if again:
                found = _merge(found, [(r["first"], r["end"]) for r in ranges])
                ids |= set(items)
            return doc_id, text if keep_text else None, n, [{"first": a, "end": b} for a, b in found], sorted(ids)

        return row

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated and the hit spans (code points of the original text)."""
    rows = scan(docs, benchmark, window, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def row(doc_id, text, n_words, ranges, items):
            found = [(r["first"], r["end"]) for r in ranges]
            n_hit = sum(b - a for a, b in found)
            spans = [{"start": a, "end": b} for a, b in original_spans(text or "", found)]
            return doc_id, n_words, n_hit, len(items), items, n_hit > 0 and MIN_SHARE * n_hit >= n_words, spans

        return row

    return map_rows(rows, make, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, spans array<struct<start:int,end:int>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns as they were; no shuffle.

    With several automata the ranges found so far travel with the rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    spark, schema, arrow = docs.sparkSession, docs.schema, to_arrow_schema(docs.schema)
    names = docs.columns
    pieces = _pieces(benchmark, "item_id", "text", chunk_bytes)
    rows, current = docs, next(pieces, [])
    (carried,) = fresh(docs, "_hit_ranges")
    wide = StructType([*schema.fields, StructField(carried, ArrayType(StructType([StructField("first", IntegerType()), StructField("end", IntegerType())])))])
    wide_arrow = to_arrow_schema(wide)
    again = False
    while current is not None:
        following = next(pieces, None)
        sent, key, last, seen = spark.sparkContext.broadcast(current), uuid.uuid4().hex, following is None, again

        def run(batches, sent=sent, key=key, last=last, seen=seen):
            import pyarrow as pa

            auto, any_ = _cached(key, sent.value, window)
            at = names.index("text")
            for batch in batches:
                keep, ranges = [], []
                old = batch.column(len(names)).to_pylist() if seen else None
                for i, text in enumerate(batch.column(at)):
                    norm, n = normalised(text.as_py())
                    found = hits(auto, norm)[0] if any_ and n else []
                    if seen:
                        found = _merge(found, [(r["first"], r["end"]) for r in old[i]])
                    n_hit = sum(b - a for a, b in found)
                    keep.append(not (n_hit > 0 and MIN_SHARE * n_hit >= n))
                    ranges.append([{"first": a, "end": b} for a, b in found])
                cols = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
                if last:
                    out = pa.RecordBatch.from_arrays(cols, schema=arrow).filter(pa.array(keep, pa.bool_()))
                else:
                    out = pa.RecordBatch.from_arrays([*cols, pa.array(ranges, wide_arrow.field(carried).type)], schema=wide_arrow)
                if out.num_rows:
                    yield out

        rows, again, current = rows.mapInArrow(run, schema if last else wide), True, following
    return rows


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    rows = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))
