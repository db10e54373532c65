"""A stream gives what the table gives."""

from docgauge.streaming import scores


def test_windowed_scores(spark, tmp_path):
    schema = "candidate string, image string, text string, latency double, at timestamp"
    rows = spark.sql("SELECT * FROM VALUES ('c', 'a.png', 'abcd', 1D, timestamp'2026-01-01 00:01:00'), ('c', 'b.png', 'x', 3D, timestamp'2026-01-01 00:02:00'), ('c', 'a.png', 'abc', 1D, timestamp'2026-01-01 00:07:00'), ('c', 'z.png', '', 9D, timestamp'2026-01-01 02:00:00'), ('c', 'a.png', '', 9D, timestamp'2026-01-01 03:00:00') v(candidate, image, text, latency, at)")
    rows.write.json(str(tmp_path / "in"))
    truth = spark.createDataFrame([("a", "abcd"), ("b.png", "x")], "image string, text string")
    stream = scores.windowed(spark.readStream.schema(schema).json(str(tmp_path / "in")), truth)
    q = stream.writeStream.outputMode("append").format("memory").queryName("scores_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.window.start): (r.cer, r.latency_avg, r.n) for r in spark.table("scores_out").collect()}
    assert got == {"2026-01-01 00:00:00": (0.0, 2.0, 2), "2026-01-01 00:05:00": (0.25, 1.0, 1)}
