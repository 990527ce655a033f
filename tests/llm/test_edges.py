"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from statloom.llm import decontaminate, imatch, licenses, near, pieces, pii, secrets, sharding, toxicity, url_filter

LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 50_000 + "1" * 50_000
ROWS = [
    (1, "Some plain text about nothing in particular, twice over.", "en"),
    (1, "Some plain text about nothing in particular, twice over.", "en"),
    (2, "Some plain text about nothing in particular, twice over.", None),
    (3, "", "en"),
    (4, None, None),
    (None, "a row without an id", "en"),
    (None, None, None),
    (5, LONG, "la"),
    (6, "\u0000 tab\tline\nend é 😀 ▁ " * 3, "xx"),
    (7, "!!! ...", "xx"),
]
SCHEMA = "doc_id long, text string, lang string"


def clashing(df):
    """Columns named like those that operators make."""
    names = ["node", "bucket", "shard", "slot", "size", "score", "spans", "found", "part", "block", "comp", "_id", "entropy", "assign", "fingerprint", "ranges", "items", "n", "term", "copies", "_many", "_base", "_all", "_clean", "_candidates", "_text"]
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module", params=["rows", "clashing", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {"rows": df, "clashing": clashing(df), "empty": df.limit(0)}[request.param]


def size(docs):
    return docs.count()


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == size(docs) and all(0 <= r.score <= 1 for r in rows)
    no = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, no).collect()} <= {0.0}
    assert toxicity.drop_toxic(docs, no).count() == size(docs)


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/1"), (1, "http://A.example.com/en/1"), (2, None), (3, ""), (None, "no scheme"), (4, "x://" + "h" * 100_000)], "page_id long, url string")
    pages = pages.withColumns({n: F.lit(1) for n in ("host", "path", "rule", "_block", "w0", "listed", "canonical_url")})
    for p in (pages, pages.limit(0)):
        for urls in (spark.createDataFrame([("a.example.com/en/1",), (None,), ("",)], "u string"), spark.createDataFrame([], "u string")):
            out = url_filter.judge(p, urls).collect()
            assert len(out) == p.count()
            assert all(r.host == "" and r.path == "" for r in out if r.page_id in (2, 3, None))


def test_licenses(docs):
    rows = licenses.scan(docs).collect()
    assert len(rows) == size(docs) and all(r.licenses == [] for r in rows)


def test_secrets(docs):
    rows = secrets.digest(secrets.scan(docs)).collect()
    assert len(rows) == size(docs)
    kept = secrets.redact(docs)
    assert kept.columns == docs.columns and kept.count() == size(docs)


def test_near(docs):
    rows = near.join(docs).collect()
    assert len(rows) == size(docs)
    for r in rows:
        if r.doc_id in (1, 2):
            assert r.class_id == 1 and r.n_links == 2
        if r.doc_id in (5, 6, 7):
            assert r.class_id == r.doc_id and r.n_links == 0
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == ([1, 3, 5, 6, 7] if rows else [])


def test_pii(docs):
    rows = pii.detect(docs).collect()
    assert len(rows) == size(docs) and all(r.found == [] for r in rows)


def test_pieces(docs):
    rows = pieces.encode(docs, pieces.model_path()).collect()
    assert len(rows) == size(docs)
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows)


def test_sharding(docs):
    rows, _ = sharding.shard(docs, 3, 64)
    rows = rows.collect()
    assert len(rows) == size(docs)
    for k in range(3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_imatch(docs):
    rows = imatch.compare_next(docs).collect()
    assert len(rows) == size(docs)
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) <= 1


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame([("a", "plain text about nothing"), ("a", "plain text about nothing"), ("b", None), (None, "x y z"), ("c", "..."), ("d", "")], "item_id string, text string").withColumn("doc_id", F.lit(1))
    for b in (bench, bench.limit(0)):
        rows = decontaminate.decontaminate(docs, b).collect()
        assert len(rows) == size(docs)
        hit = b is bench
        assert all((r.contaminated and r.n_hit == 4 and r.items == ["a"]) == hit for r in rows if r.doc_id in (1, 2))
        kept = decontaminate.drop_contaminated(docs, b)
        assert kept.columns == docs.columns and kept.count() == size(docs) - (3 if hit and rows else 0)
