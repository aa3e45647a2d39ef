from datetime import datetime, timedelta

from glyphmill import streaming

SCHEMA = "ws_key bigint, series_id string, reader_id string, region_key bigint, fa string, answer string, submitted_at timestamp_ntz, received_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def row(k, days, fa="a", region=1, answer=None, reader="r"):
    at = DAY + timedelta(days=days)
    return (k, "s", reader, region, fa, answer, at, at + timedelta(hours=1))


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    return streaming.reply_stream(spark, f"{tmp_path}/in/*", SCHEMA)


def test_resent_replies_count_once_and_windows_close(spark, tmp_path):
    stream = feed(spark, tmp_path, [[row(1, 0), row(2, 0, "b", 2)], [row(3, 0)], [row(4, 90, "z", 9, "drop")], [row(5, 91, "y", 9)]])
    q = streaming.once(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.fa for r in spark.table("once").collect()} == {"a", "b", "z", "y"} and spark.table("once").count() == 4
    q = streaming.answers_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.replies, r.answers) for r in spark.table("windows").collect()] == [(3, 0)]


def test_upsert_keeps_the_newest(spark, tmp_path):
    stream = feed(spark, tmp_path, [[row(1, 0, "old"), row(2, 0, "x", 2)], [row(3, 5, "new")], [row(4, 1, "late")]])
    q = streaming.upsert_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    version = (tmp_path / "out/current").read_text()
    assert {(r.region_key, r.fa) for r in spark.read.parquet(f"{tmp_path}/out/{version}").collect()} == {(1, "new"), (2, "x")}
