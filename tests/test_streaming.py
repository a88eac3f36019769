from conftest import SF

from quillgrid.streaming.events import sessions, stream, windowed_timings


def test_windows_and_sessions(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    df = stream(spark, str(tmp_path / "in"), batch.schema, 1)
    for name, f in (("w", windowed_timings), ("s", sessions)):
        q = f(df).writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(n) FROM out_w").first()[0] > 0
    assert spark.sql("SELECT count(*) FROM out_s").first()[0] >= 0
