from pyspark.sql import functions as F

from lodestrata.streaming import changes

SCHEMA = "path string, kind string, ts timestamp"


def test_debounce_draws_bursts_together(spark):
    at = lambda ms: F.timestamp_millis(F.lit(ms))
    rows = [("a", 0), ("b", 400), ("a", 800), ("c", 1301), ("d", 1801)]
    df = spark.createDataFrame([(p, "modify", ms) for p, ms in rows], "path string, kind string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = [(r.paths, r.n_events) for r in changes.debounce(df).orderBy("start").collect()]
    assert got == [(["a", "b"], 3), (["c", "d"], 2)]  # a gap of just 500 ms still belongs to the burst
    assert at is not None


def test_relevant(spark):
    df = spark.createDataFrame([("a.py", "create"), (".git/x", "create"), ("b/.idx/y", "modify"), ("c.py", "access"), ("_d/e.py", "remove")], "path string, kind string")
    assert sorted(r.path for r in changes.relevant(df).collect()) == ["_d/e.py", "a.py"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a.py", "create"), ("a.py", "modify"), (".git/x", "create")], "path string, kind string").withColumn("ts", F.current_timestamp()).coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    events = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    q = changes.follow(events, seen.append, str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(120)
    assert seen == [["a.py"]]
    d = changes.debounce(events, late="1 second")
    assert d.isStreaming
