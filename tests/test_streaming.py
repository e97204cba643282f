import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trafficlens import schema
from trafficlens.operators import sessions as S
from trafficlens.operators import traffic as T
from trafficlens.sources import files
from trafficlens.sources import views as V
from trafficlens.sources.store import Store
from trafficlens.streaming import jobs

BASE = dt.datetime(2024, 1, 1)


def packets(spark, spec):
    """Packets from (id, seconds) pairs."""
    rows = [(i, BASE + dt.timedelta(seconds=s), "192.168.1.1", "8.8.8.8", "tcp", 5000, 80, 24, 100, 64, None, None, None, None, False) for i, s in spec]
    return spark.createDataFrame(rows, schema.ddl(schema.PACKET))


def stream(spark, tmp_path, *batches):
    source = str(tmp_path / "in")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
    return files.read_packet_stream(spark, source, files_per_trigger=1)


def collect(spark, df, tmp_path, name="out"):
    path = str(tmp_path / name)
    jobs.write_table(df, path, path + "-checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@pytest.fixture
def split_packets(spark, folder, tmp_path):
    """The test packets in time order, one file per batch."""
    p = V.packets(spark, folder).withColumn("_part", F.ntile(4).over(Window.orderBy("ts"))).cache()
    return stream(spark, tmp_path, *[p.filter(F.col("_part") == k).drop("_part") for k in range(1, 5)])


def test_timeline_equals_batch_up_to_the_watermark(spark, folder, split_packets, tmp_path, rows):
    got = collect(spark, jobs.traffic_timeline(split_packets, "1 hour"), tmp_path)
    batch = V.packets(spark, folder)
    newest = batch.agg(F.max("ts")).first()[0]
    want = T.timeline(batch, "1 hour").filter(F.col("end") <= F.lit(newest - dt.timedelta(minutes=10)))
    assert rows(got) == rows(want)


def test_sessions_equal_batch_up_to_the_watermark(spark, folder, split_packets, tmp_path, rows):
    got = collect(spark, jobs.tcp_sessions(split_packets), tmp_path)
    batch = V.packets(spark, folder)
    # Spark filters before it advances the watermark, so only TCP packets move it.
    newest = S.with_endpoints(batch).agg(F.max("ts")).first()[0]
    want = S.tcp_sessions(batch).filter(F.col("last_seen") <= F.lit(newest - dt.timedelta(minutes=15)))
    assert rows(got) == rows(want)


def test_counters_equal_batch(spark, folder, split_packets, tmp_path, rows):
    path = str(tmp_path / "counters")
    jobs.write_table(jobs.running_counters(split_packets), path, path + "-checkpoint", available_now=True).awaitTermination()
    batch = V.packets(spark, folder)
    newest = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=70)
    closed = jobs.running_counters(batch).filter(F.col("start") <= F.lit(newest))
    assert rows(jobs.read_counters(spark, path)) == rows(closed.groupBy("dimension", "value").agg(F.sum("packets")))


def test_late_packets(spark, tmp_path):
    # Lateness is judged by the watermark of the batch before: 01:00 when the fourth batch arrives.
    # There one packet is just in time and one too late.
    batches = [[(1, 10)], [(2, 4200)], [(3, 4260)], [(4, 3590), (5, 3605)], [(6, 99999)]]
    df = stream(spark, tmp_path, *[packets(spark, b) for b in batches])
    got = collect(spark, jobs.traffic_timeline(df, "1 minute"), tmp_path)
    counted = {(r["start"] - BASE).total_seconds(): r["packets"] for r in got.collect()}
    assert counted == {0: 1, 3600: 1, 4200: 1, 4260: 1}


def test_detections_are_written_once(spark, tmp_path):
    scored = packets(spark, [(i, i) for i in range(20)]).withColumns({"is_malicious": F.col("packet_id") % 2 == 0, "confidence": F.col("packet_id") / 20.0})
    source, out = str(tmp_path / "scored"), str(tmp_path / "out")
    scored.write.parquet(source)
    df = spark.readStream.schema(scored.schema).parquet(source)
    # A lost checkpoint replays the batch: the tables stay the same.
    for attempt in ("a", "b"):
        jobs.write_detections(df, out, str(tmp_path / attempt), available_now=True).awaitTermination()
        store = Store(spark, out)
        assert store.read("detections").count() == 20
        assert sorted(r["detection_id"] for r in store.read("alerts").collect()) == [16, 18]
    # Rows appended by a batch job lie in the same table.
    store.append("detections", store.read("detections").limit(3).drop("dt").withColumn("id", F.col("id") + 100))
    assert store.read("detections").count() == 23


def test_the_model_decides_about_live_packets(spark, tmp_path):
    """Without the truth, what the model predicts is stored and raises alerts."""
    scored = packets(spark, [(i, i) for i in range(10)]).withColumns(
        {"is_malicious": F.lit(None).cast("boolean"), "confidence": F.col("packet_id") / 9.0, "is_predicted_malicious": F.col("packet_id") > 4}
    )
    scored.write.parquet(str(tmp_path / "scored"))
    df = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "scored"))
    jobs.write_detections(df, str(tmp_path / "out"), str(tmp_path / "c"), available_now=True).awaitTermination()
    store = Store(spark, str(tmp_path / "out"))
    assert {r["id"]: r["is_malicious"] for r in store.read("detections").collect()} == {i: i > 4 for i in range(10)}
    assert sorted(r["detection_id"] for r in store.read("alerts").collect()) == [7, 8, 9]


def test_retention(spark):
    df = packets(spark, [(1, 0), (2, 90000)]).withColumnRenamed("ts", "timestamp")
    assert [r["packet_id"] for r in jobs.retained(df, "2024-01-02 12:00:00", "1 day").collect()] == [2]
