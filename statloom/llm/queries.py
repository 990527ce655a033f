"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from . import decontaminate, imatch, licenses, near, pieces, pii, secrets, sharding, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_url_filter": url_filter.op2,
    "op3_licenses": licenses.op3,
    "op4_secrets": secrets.op4,
    "op5_ngram_jaccard": near.op5,
    "op6_pii": pii.op6,
    "op7_sentencepiece": pieces.op7,
    "op8_sharding": sharding.op8,
    "op9_imatch": imatch.op9,
    "op10_decontaminate": decontaminate.op10,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
}
