"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text. A
document is cut into short windows at spaces; each window is compressed with
either dictionary, and the bytes saved by the toxic one are its distance.
Counts of windows beyond calibrated thresholds give the score through a
logistic curve fitted on labelled rows that the dictionaries haven't seen.

Both dictionaries share an ordinary part, and a part made of the ordinary
windows that the toxic one compresses best, so that chance matches cancel out.

Training uses a bounded sample of the labelled rows: at most ``MAX_TOXIC`` and
``MAX_ORDINARY`` different rows, in the order of a hash of their ids, up to
``MAX_SAMPLE_BYTES`` of text each, and of their words at most ``BASE_WORDS`` for
the shared part. Scores use whole texts and nothing but the
text.

Defined results: null and empty texts have no windows and get the score of a
text without any sign; without labelled rows of both classes every score is 0;
a row labelled more than once is toxic if any of its labels is; equal texts get
equal scores; other columns are ignored whatever their names are.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local, map_rows, table

MAX_TOXIC = 3_000
MAX_ORDINARY = 6_000
MAX_SAMPLE_BYTES = 24 << 20
WINDOW = 40
LEVEL = 7
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
CUT = 0.7
#: Words of ordinary sample texts, in random order, that train the part both dictionaries share.
BASE_WORDS = 150_000
#: Part of the sample that trains the dictionaries; the rest calibrates the scores.
DICTIONARY_SHARE = 0.6
GRAMS = (4, 5, 6)
#: Weight of a toxic row against its share: puts the score's 0.7 where both kinds of error are rare.
TOXIC_WEIGHT = 2.5


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Windows of ``size`` bytes and up to the next space; each also has the space before it."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" "
    out, at, n = [], 0, len(raw) - 1
    while at < n:
        end = raw.find(b" ", at + size)
        if end < 0 or end > at + 4 * size:
            end = min(n, at + (size if end >= 0 else 4 * size))
        out.append(raw[at : end + 1])
        at = end
    return out


_BLANK = bytes(32 if c in b"\t\n\r" else c for c in range(256))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def features(self, text: str | None) -> list[float]:
        diff = self._diff()
        found = Counter(diff(w) for w in windows(text)) if text else Counter()
        n = sum(found.values())
        top = max(found, default=0)
        out = [1.0, math.log1p(n), max(top, 0) / 4, min(max(top, 0), 3) / 3]
        for t in THRESHOLDS:
            c = sum(k for d, k in found.items() if d >= t)
            out += [math.log1p(c), min(1.0, 10 * c / n) if n else 0.0]
        return out

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = sum(a * b for a, b in zip(self.features(text), self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def _diff(self):
        return _differ(self.toxic, self.ordinary)


@functools.lru_cache(maxsize=2)
def _differ(toxic: bytes, ordinary: bytes):
    """Bytes that a window takes with the ordinary dictionary beyond those with the toxic one."""
    a, b = _compress(toxic), _compress(ordinary)
    return lambda window: len(b(window)) - len(a(window))


def _compress(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _trained(samples: list[bytes], size: int, keep: int, segment: int) -> bytes:
    """The content of a dictionary trained on samples; its end, where the most useful segments are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-keep:]
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[-keep:]


def _gram_counts(texts: list[str]) -> Counter:
    """Documents, summed over words, that hold an n-gram of characters."""
    words: Counter = Counter()
    for t in texts:
        words.update(set(t.split()))
    out: Counter = Counter()
    for w, c in words.items():
        s = f" {w} "
        for g in {s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1)}:
            out[g] += c
    return out


def _telling(toxic: list[str], ordinary: list[str]) -> set[str]:
    """N-grams that toxic texts hold far more often than ordinary ones."""
    a, b = _gram_counts(toxic), _gram_counts(ordinary)
    na, nb = len(toxic), len(ordinary)
    out = set()
    for g, c in a.items():
        p, q = min(1.0, c / na), min(1.0, b[g] / (nb + 1))
        both = (p * na + q * nb) / (na + nb)
        spread = math.sqrt(max(1e-12, both * (1 - both) * (1 / na + 1 / nb)))
        if c >= max(4, 0.03 * na) and p > 25 * q and (p - q) / spread > 6:
            out.add(g)
    return out


def fit(toxic: list[str], ordinary: list[str], n_toxic: int, n_ordinary: int) -> Model:
    """A model from sample texts; ``n_toxic`` and ``n_ordinary`` are the numbers of labelled rows that the samples stand for."""
    if not toxic or not ordinary:
        return Model(b"", b"", ())
    at, bt = int(DICTIONARY_SHARE * len(toxic)) or 1, int(DICTIONARY_SHARE * len(ordinary)) or 1
    train = list(dict.fromkeys(t.lower() for t in toxic[:at])), list(dict.fromkeys(t.lower() for t in ordinary[:bt]))
    telling = _telling(*train)

    def tells(word: str) -> bool:
        s = f" {word} "
        return any(s[i : i + n] in telling for n in GRAMS for i in range(len(s) - n + 1))

    ours = [f" {w} ".encode("utf-8", "replace") for t in train[0] for w in sorted(set(t.split())) if tells(w)]
    rest = [f" {w} ".encode("utf-8", "replace") for t in train[1] for w in sorted(set(t.split()))]
    random.Random(7).shuffle(rest)
    base = _trained(rest[:BASE_WORDS], 8192, 6000, 32)
    signs = _trained(ours, 2048, 1500, 24) if ours else b" "
    cuts = [w for t in train[1] for w in windows(t)]
    for _ in range(3):  # ordinary windows that look toxic go into both
        model = Model(base + signs, base, ())
        diff = model._diff()
        hard = [w for w in cuts if diff(w) >= 3]
        if len(hard) < 50:
            break
        base += _trained(hard, 1500, 1100, 16)
    model = Model(base + signs, base, ())
    held = [*toxic[at:], *ordinary[bt:]] if at < len(toxic) and bt < len(ordinary) else [*toxic, *ordinary]
    n_pos = len(toxic) - at if len(held) < len(toxic) + len(ordinary) else len(toxic)
    x = np.array([model.features(t) for t in held])
    y = np.array([1.0] * n_pos + [0.0] * (len(held) - n_pos))
    weight = np.where(y > 0, TOXIC_WEIGHT * n_toxic / n_pos, n_ordinary / (len(held) - n_pos))
    return Model(model.toxic, model.ordinary, tuple(_logistic(x, y, weight / weight.mean())))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> list[float]:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def held_out(doc_id: Column) -> Column:
    """Rows that may only be judged: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows of ``docs`` that aren't held out (a bounded sample of them)."""
    by_id = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    usable = by_id.where(~held_out(F.col("_id")))
    totals = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # a row per class
    texts: dict[int, list[str]] = {}
    for y, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        # a stated number of ids; documents are then matched against them without a shuffle of texts
        ids = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id")
        rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        rows = rows.join(F.broadcast(ids), "_id", "left_semi").withColumn("_key", F.xxhash64("_text"))
        sizes = rows.groupBy("_id", "_key").agg(F.max(F.octet_length("_text")).alias("_n")).orderBy(F.xxhash64("_id"), "_id", "_key").limit(most).collect()
        chosen, size = {}, 0
        for r in sizes:
            size += r["_n"]
            if chosen and size > MAX_SAMPLE_BYTES:
                break
            chosen[r["_id"], r["_key"]] = len(chosen)
        # no more than MAX_SAMPLE_BYTES of text leave the tasks, a repeated row once
        picks = local(docs.sparkSession, list(chosen), rows.select("_id", "_key").schema)
        got = rows.join(F.broadcast(picks), ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.first("_text").alias("_text"))
        found = sorted((chosen[r["_id"], r["_key"]], r["_text"]) for r in got.toLocalIterator())
        texts[y] = [t for _, t in found]
    return fit(texts[1], texts[0], totals.get(1, 0), totals.get(0, 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some KB
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = sent.value
        return lambda doc_id, text: (doc_id, m.score(text))

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), make, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, all columns as they were."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for batch in batches:
            keep = [m.score(t.as_py()) < cut for t in batch.column(at)]  # a text at a time
            kept = batch.filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
