"""Sessions, the registry and streams."""

import pytest
from pyspark.sql import functions as F

from statloom.operators import clean
from statloom.plans import registry
from statloom.session import Session
from statloom.streaming import events


def test_cleaning_sessions_roll_back(spark):
    s = Session(spark)
    s.put("a", spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "id long, v string"))
    c = s.clean("a")
    c.apply("drop", lambda df: clean.drop_na(df, ["v"]))
    assert c.current.count() == 2 and c.checkpoints() == ["loaded", "drop"]
    assert {r["column"]: (r.rows_before, r.rows_after) for r in c.verify().collect()} == {"id": (3, 2), "v": (3, 2)}
    assert c.rollback().count() == 3
    assert ("id", "keep as key") in s.suggestions("a")
    assert s.query("SELECT max(id) AS m FROM a").first().m == 3
    with pytest.raises(KeyError):
        s.get("b")


def test_registry_finds_operators():
    assert ("regression", "ols") in registry.search("least squares")
    assert registry.info("kruskal").startswith("kruskal(")


def test_streams_agree_with_batches(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    df.write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read(spark, str(tmp_path / "in"), df.schema), "ts", ["k"], "v", late="0 seconds")
    events.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r.start, r.k): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.k): r.n for r in events.windowed(df, "ts", ["k"], "v").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert events.sessions(df, "ts", "k", "90 minutes").count() == 100
