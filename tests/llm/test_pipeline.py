"""The pipeline on a small table, each stage against what it should keep."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import common, near, pieces


def test_stages_keep_clean_documents(spark, tmp_path):
    lines = [f"plain words number {i} about the {k} thing that nobody else says in {i * 7} ways" for i in range(60) for k in ("red", "blue")]
    rows = [(i, f"{t} {t[::-1]}", "en", "s", len(t) * 2 + 1) for i, t in enumerate(lines)]
    rows += [(500, rows[3][1], "en", "s", 1), (501, "my password=abcdef123456 is here", "en", "s", 32)]
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows += [(502, passage, "en", "s", len(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    scratch, df, seen = near.Scratch(spark, "test"), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        df = scratch.keep(stage(spark, df, str(tmp_path)))
        seen[name] = {r.doc_id: r for r in df.collect()}
        if name != "sentencepiece":
            assert df.columns == docs.columns
    assert 500 not in seen["ngram_jaccard_join"] and 3 in seen["ngram_jaccard_join"]
    assert 502 in seen["ngram_jaccard_join"] and 502 not in seen["decontamination"]
    assert seen["secret_scans"][501].text == "my [secret] is here" and seen["secret_scans"][501].n_chars == len("my [secret] is here")
    assert set(seen["sentencepiece"]) == set(seen["secret_scans"])
    with open(pieces.model_path(), "rb") as f:
        table = pieces.PieceTable(f.read())
    for k, r in seen["sentencepiece"].items():
        assert table.decode(r.ids) == seen["secret_scans"][k].text
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r.ids_sha256 for k, r in seen["sentencepiece"].items()}


def test_stages_get_small_batches(spark, tmp_path):
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", 3 << 20
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha1((F.col("id") * 1000 + k).cast("string"))))
    docs = spark.range(0, 800, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))  # 10 MB of text in one file
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never said")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "secret_scans":  # no Python
                spark.conf.set(key, before)
                stage(spark, docs, str(tmp_path))
                found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
                assert sum(found) > 8 << 20 and max(found) < most, name
        spark.conf.set(key, "1m")  # a smaller size stays
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_rows_of_the_driver_need_no_python_worker(spark):
    schema = spark.createDataFrame([], "id long, name string").schema
    for rows in ([(1, "a"), (None, "ä"), (-(2**63), None)], []):
        made = common.local(spark, rows, schema)
        assert made.schema == schema and [tuple(r) for r in made.collect()] == rows
        assert "RDD" not in made._jdf.queryExecution().executedPlan().toString()
    when = spark.sql("select timestamp'2020-01-01 00:00:00' t")
    assert common.local(spark, [tuple(when.first())], when.schema).collect() == when.collect()
