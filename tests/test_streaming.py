"""Streams of small files: sessions keep their state over batches, windows count late rows up to the watermark."""

from datetime import datetime

from cairn.streaming import sessions


def gathered(df, tmp_path, mode="update"):
    """All rows that a stream puts out, batch by batch."""
    out = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: out.append(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_sessions_over_batches(spark, tmp_path):
    schema = "session string, turn long, answer string"
    batches = [[("a", 1, "Toledo"), ("b", 1, " Nao sei ")], [("a", 3, "teste"), ("a", 2, None)], [("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z"), ("c", 4, "w")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for rows in gathered(sessions.sessions(stream), tmp_path):
        for r in rows:
            last[r.session] = (r.used, r.gave_up)
    assert last["b"] == (3, True) and last["c"] == (3, False)
    # An answer that is missing gives up as well.
    assert last["a"] == (3, True)


def test_windowed_counts(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(at(0, 5), "click"), (at(0, 59), "click"), (at(1, 0), "view"), (at(1, 30), "click")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    got = {(r.window.start.hour, r.event_type): r.n for rows in gathered(sessions.windowed_counts(stream), tmp_path) for r in rows}
    assert got == {(0, "click"): 2, (1, "view"): 1, (1, "click"): 1}


def test_ingest_adds_each_key_once(spark, tmp_path):
    schema = "id long, v string"
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for ck in ("c1", "c2"):
        sessions.ingest(stream(), str(tmp_path / "out"), "id", str(tmp_path / ck)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
