"""Document fingerprints by I-Match with randomised lexicons.

Terms whose share of documents lies in a band (neither rare nor common) form
the lexicon. A fingerprint is a hash of the sorted distinct lexicon terms of a
text, and a short hash for each of several random subsets of the lexicon, from
dense to sparse; the likeness of two fingerprints is the share of equal subset
hashes among the subsets that hold a term of either text.

Document counts cover all documents. The lexicon doesn't grow with the corpus:
no more than (mean distinct terms of a document) / ``low`` terms can be in a
share ``low`` of the documents. A corpus of such long texts that this exceeds
``MAX_LEXICON``, the most that is sent to executors, is refused: ``low`` is to
be set higher for it.

Defined results: a text without lexicon terms is fingerprinted by all its
terms, one without words (null counts as empty) by itself, and both are like
equal fingerprints only; equal texts have equal fingerprints; rows of equal id
are ordered by their text, null ids come last; a single document is its own
next one; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, sha256_hex, table

LOW, HIGH = 0.0005, 0.2
MAX_LEXICON = 1_000_000
#: Subsets as (bits, number): a subset of b bits holds a term in 2^b.
SUBSETS = ((1, 2), (2, 2), (3, 4), (4, 6), (5, 8), (6, 8), (7, 8), (8, 8), (9, 8), (10, 6), (11, 4))
#: Distinct terms that a task counts before it passes the counts on.
HELD_TERMS = 300_000
EMPTY = "----"
#: Rows per range of the sample that balances the ranges, and the characters of a text that tell rows of one id apart there.
SAMPLED, HEAD_CHARS = 40, 64

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_TABLE).split())


def term_hash(term: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(term, 5)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term hash, number of documents that have it); counted in the task before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([_signed(term_hash(t)) for t in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(at, SLICE_ROWS).to_pylist():
                    held.update(terms(text))
                if len(held) >= HELD_TERMS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, most: int = MAX_LEXICON) -> np.ndarray:
    """Sorted hashes of the terms in the band; at most ``most`` of them."""
    from .near import Scratch

    scratch = Scratch(docs.sparkSession, "lexicon")
    n_docs = docs.count()
    counts = document_counts(docs, text_col)
    floor = max(1, int(np.ceil(low * n_docs)))
    kept = scratch.keep(counts.where((F.col("n") >= floor) & (F.col("n") <= max(high * n_docs, 1))))
    n_terms = kept.count()
    if n_terms > most:
        raise ValueError(f"{n_terms} terms are in the band, {most} can be sent to executors: raise low")
    out = np.sort(np.array(kept.select("term").toArrow().column("term").to_numpy()))
    scratch.clear()
    return out


_SEEDS = np.random.default_rng(29).integers(1, 1 << 63, sum(k for _, k in SUBSETS), dtype=np.uint64) | np.uint64(1)
_MASKS = np.array([(1 << b) - 1 for b, k in SUBSETS for _ in range(k)], dtype=np.uint64)


class Fingerprinter:
    """Fingerprints of texts over one lexicon."""

    def __init__(self, band: np.ndarray) -> None:
        self.band = frozenset(band.tolist())
        self.known: dict[bytes, int | None] = {}

    def _own(self, term: bytes) -> int | None:
        if len(self.known) >= HELD_TERMS:
            self.known.clear()
        h = term_hash(term)
        out = self.known[term] = h if _signed(h) in self.band else None
        return out

    def __call__(self, text: str | None) -> str:
        found = terms(text)
        known, own = self.known, self._own
        hashes = [h for h in (known[t] if t in known else own(t) for t in found) if h is not None]
        if not hashes:
            raw = b"\0".join(sorted(found)) if found else b"\1" + (text or "").encode("utf-8", "replace")
            return _short(raw, 8) + ":" + EMPTY * len(_SEEDS)
        ordered = np.sort(np.array(hashes, dtype=np.uint64))
        mixed = (ordered[:, None] * _SEEDS) >> np.uint64(40)
        inside = (mixed & _MASKS) == 0
        some = inside.any(axis=0)
        subsets = [_short(ordered[inside[:, k]].tobytes(), 2) if some[k] else EMPTY for k in range(len(_SEEDS))]
        return _short(ordered.tobytes(), 8) + ":" + "".join(subsets)


def _short(raw: bytes, size: int) -> str:
    return hashlib.blake2b(raw, digest_size=size).hexdigest()


def likeness(a: str, b: str) -> float:
    """Share of equal subset hashes among the subsets that either text has terms in; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    same = some = 0
    for i in range(17, len(a), 4):
        x, y = a[i : i + 4], b[i : i + 4]
        if x != EMPTY or y != EMPTY:
            some += 1
            same += x == y
    return same / some if some else 0.0


_MADE: dict[str, Fingerprinter] = {}


def _fingerprinter(band: np.ndarray) -> Fingerprinter:
    key = hashlib.sha256(band.tobytes()).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Fingerprinter(band)
    return _MADE[key]


def fingerprint(docs: DataFrame, band: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every document."""
    from .common import map_rows

    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if band is None else band)  # MAX_LEXICON numbers at most
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        f = _fingerprinter(sent.value)
        return lambda doc_id, text: (doc_id, f(text))

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, fingerprint string")


def _cuts(rows: DataFrame, parts: int) -> list[tuple]:
    """Where ``parts`` ranges of the order begin, as (id, head of the text). They only balance tasks: a sample of about ``SAMPLED`` rows per range."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS)
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    sample = rows.select("doc_id", head.alias("head")).sample(share, seed=17).collect()
    known = sorted(((r["doc_id"], r["head"]) for r in sample if r["doc_id"] is not None), key=lambda x: x[1])
    known.sort(key=lambda x: x[0], reverse=True)
    known += sorted((None, r["head"]) for r in sample if r["doc_id"] is None)
    return list(dict.fromkeys(known[k * len(known) // parts] for k in range(1, parts))) if known else []


def _place(cuts: list[tuple], kind: str) -> Column:
    """Number of the range of a row: of the cuts at or before it. Two levels keep the search short."""
    if not cuts:
        return F.lit(0)
    head = F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS)
    doc_id = F.col("doc_id")

    def past(cut: Column) -> Column:
        own = doc_id.eqNullSafe(cut["id"]) & (head >= cut["head"])
        return F.when(cut["id"].isNull(), own).otherwise(own | doc_id.isNull() | F.coalesce(doc_id < cut["id"], F.lit(False)))

    cut = lambda c: F.struct(F.lit(c[0]).cast(kind).alias("id"), F.lit(c[1]).alias("head"))
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.array(*(cut(g[-1]) for g in groups))
    fine = F.array(*(F.array(*(cut(c) for c in g)) for g in groups), F.array(cut(cuts[-1])))
    whole = F.size(F.filter(coarse, past))
    inside = F.size(F.filter(F.element_at(fine, whole + 1), past))
    return F.when(whole == len(groups), F.lit(len(cuts))).otherwise(whole * step + inside).cast("int")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, ahead, doc_id, text) in descending order of the id within each part, a part in one partition.

    The first row of each part is there once more, ``ahead`` = 1, at the end of
    the part before it (of the last part, for the first one), so that every
    row's next one can be read from its own part. One shuffle of the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    place = _place(_cuts(rows, parts), kind)
    heads = sorted((r["part"], r["head"]) for r in rows.select("doc_id", place.alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).collect())  # a row per part
    rows = rows.withColumn("part", place)
    if heads:
        before = [(head, part, heads[i - 1][0]) for i, (part, head) in enumerate(heads)]
        look = spark.createDataFrame(before, f"head {kind}, head_part int, before int")
        known = rows.join(F.broadcast(look), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("part") == F.col("head_part")), "left")  # a row per part
        own = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
        rows = known.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead"))))))
        rows = rows.select("at.part", "at.ahead", "doc_id", "text")
    else:
        rows = rows.select("part", F.lit(0).alias("ahead"), "doc_id", "text")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), "text")


def compare_next(docs: DataFrame, band: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses (to the edited text's, to the next document's)."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if band is None else band)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        f = _fingerprinter(sent.value)
        out: list[tuple] = []
        held = None  # part, doc_id, text, fingerprint of the row that waits for its next one

        def pair(following: str, of_next: str):
            _, doc_id, text, own = held
            k = len(text) // 3
            edited = text[: len(text) - k] + following[:k]
            new = f(edited) if edited != text else own
            out.append((doc_id, len(text), sha256_hex(edited), own, new, likeness(own, new), likeness(own, of_next)))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cut = batch.slice(at, SLICE_ROWS)
                for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    text = text or ""
                    if held and held[0] != part:
                        held = None  # its next row was the first that was ahead
                    if ahead and held is None:
                        continue
                    own = f(text)
                    if held:
                        pair(text, own)
                    held = None if ahead else (part, doc_id, text, own)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(2).type), pa.array(cols[1], pa.int64()), *(pa.array(c) for c in cols[2:])], names=names)
                    out.clear()

    return neighbours(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
