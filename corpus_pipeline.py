"""Corpus pipeline: toxicity, near copies, benchmark passages, secrets, tokens.

Every stage reads what its predecessor kept. All but the last return the
columns of ``documents``.

Defined results: null texts count as empty ones, which no stage drops except as
copies of each other; rows of equal or null id are kept or dropped one by one;
an empty table gives an empty result; further columns pass through unread,
whatever their names are, up to the last stage.

The stages that run Python set small Arrow batches in the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import decontaminate, near, pieces, secrets, toxicity
from statloom.llm.common import small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model is fitted on this stage's own input."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard similarity 0.8 or more connect: the one of the least id."""
    small_batches(spark)
    return near.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return pieces.encode(docs, pieces.model_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode),
]

#: The scores, the similarity join and the tokens can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again as the next one's input."""
    scratch = near.Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with near.temporary():  # a stage's own tables go once its rows are written
            docs = scratch.keep(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    docs = STAGES[-1][1](spark, docs, sf_dir)
    return docs.select("doc_id", "n_tokens", "ids", F.col("ids_sha256"), F.col("decoded_sha256"))
