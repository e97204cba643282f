"""Folded logs, dropped days, batch marks, and the streaming jobs that rest on them."""

import datetime as dt
import os
import statistics

import pytest
from pyspark.sql import functions as F
from test_streaming import BASE, collect, packets, stream

from trafficlens.operators import alerts as A
from trafficlens.operators import signatures as SG
from trafficlens.sources import folded
from trafficlens.sources import views as V
from trafficlens.sources.folded import FoldedLog
from trafficlens.sources.store import Store
from trafficlens.streaming import jobs


@pytest.fixture
def log(spark, tmp_path):
    return FoldedLog(spark, str(tmp_path / "log"), "k string, n bigint", folded.sums(["k"], ["n"]))


def entries(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, n long")


def test_the_same_before_and_after_compaction(spark, log, rows):
    assert rows(log.read()) == [] and log.compact() == -1
    for k in range(6):
        assert log.append(entries(spark, ("a", k), ("b", 1))) == k
        before = rows(log.read())
        if k % 2:
            assert log.compact() == k and log.tail == []
        assert rows(log.read()) == before == [("a", sum(range(k + 1))), ("b", k + 1)]


def test_readers_touch_snapshot_and_tail_only(spark, log, rows):
    for k in range(5):
        log.append(entries(spark, ("a", 1)))
        if k == 2:
            log.compact()
    names = [os.path.basename(p) for p in log.folders_read()]
    assert names == ["snapshot-000000000002", "entries-000000000003", "entries-000000000004"]
    assert {os.path.basename(os.path.dirname(r[0])) for r in log.entries().select(F.input_file_name()).collect()} <= set(names)


def test_incomplete_folders_do_not_count(spark, log, tmp_path, rows):
    log.append(entries(spark, ("a", 1)))
    for name in ("entries-000000000001", "snapshot-000000000007"):
        entries(spark, ("a", 100)).write.parquet(str(tmp_path / "log" / name))
        os.remove(tmp_path / "log" / name / "_SUCCESS")
    assert rows(log.read()) == [("a", 1)] and log.snapshot == -1
    # The failed write is done again.
    log.append(entries(spark, ("a", 5)), 1)
    assert rows(log.read()) == [("a", 6)]


def test_positions_are_written_once(spark, log, rows):
    for _ in range(2):
        log.append(entries(spark, ("a", 3)), 0)
        log.append(entries(spark, ("a", 4)), 1)
    assert rows(log.read()) == [("a", 7)]
    log.compact()
    log.append(entries(spark, ("a", 4)), 1)
    assert rows(log.read()) == [("a", 7)]


def test_a_reader_outlives_one_compaction(spark, log, rows):
    log.append(entries(spark, ("a", 1)))
    log.append(entries(spark, ("a", 2)))
    running = log.read()
    log.compact()
    assert rows(running) == [("a", 3)]


def test_folders_are_bounded(spark, log, tmp_path):
    for k in range(12):
        log.append(entries(spark, ("a", 1)), k)
        if k % 3 == 2:
            log.compact()
    assert len(os.listdir(tmp_path / "log")) <= 8
    assert log.read().first()["n"] == 12


def test_newest_entries_and_rows(spark, tmp_path, rows):
    log = FoldedLog(spark, str(tmp_path / "n"), "id bigint, t bigint, v string", folded.newest_per("id", ["t", "v"]))
    for part in ([(1, 1, "a"), (2, 5, "x")], [(1, 3, "c"), (2, 4, "y")], [(1, 3, "b"), (3, None, None)]):
        log.append(spark.createDataFrame(part, log.schema))
        log.compact()
    assert rows(log.read()) == [(1, 3, "c"), (2, 5, "x"), (3, None, None)]
    top = FoldedLog(spark, str(tmp_path / "t"), "id bigint, t bigint", folded.newest_rows(3, ["t", "id"]))
    for k in range(4):
        top.append(spark.createDataFrame([(10 * k + j, j) for j in range(5)], top.schema))
    top.compact()
    assert top.entries().count() == 3 and rows(top.read()) == [(14, 4), (24, 4), (34, 4)]


def test_decisions_resolve_alike_from_log_and_snapshot(spark, folder, tmp_path, rows):
    log, decisions = A.decision_log(spark, str(tmp_path / "d")), V.decisions(spark, folder)
    want = rows(A.resolve_status(V.alerts(spark, folder), decisions))
    log.append(decisions.filter("status <> 'confirmed'"))
    log.compact()
    log.append(decisions.filter("status = 'confirmed'"))
    assert rows(A.resolve_status(V.alerts(spark, folder), log.read())) == want
    log.compact()
    assert rows(A.resolve_status(V.alerts(spark, folder), log.read())) == want


def test_signature_log_equals_upsert(spark, folder, tmp_path, rows):
    log = SG.signature_log(spark, str(tmp_path / "s"))
    log.append(V.signatures(spark, folder))
    additions = V.signature_additions(spark, folder)
    for k in (1, 0):  # later entries first
        log.append(SG.log_entries(additions.filter(F.col("id") % 2 == k)))
        log.compact()
    assert rows(log.read()) == rows(SG.upsert(V.signatures(spark, folder), additions).select(*log.read().columns))


def test_days_are_dropped_whole(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append("detections", V.detections(spark, folder))
    day = F.to_date("timestamp").cast("string")
    days = lambda: {r[0] for r in store.read("detections").select(day).collect()}
    every, running = sorted(days()), store.read("detections")
    assert store.drop_days("detections", every[4]) == []
    assert sorted(days()) == every[4:] and running.count() == 1000
    # The next call takes the files away; the horizon does not move back.
    assert len(store.drop_days("detections", every[2])) == 4
    assert sorted(days()) == every[4:] and store.horizons("detections") == [every[4]][:1] or store.horizons("detections")[-1] == every[4]
    files = {n for n in os.listdir(tmp_path / "s" / "detections") if n.startswith("dt=")}
    assert files == {f"dt={d}" for d in every[4:]}
    with pytest.raises(ValueError):
        store.drop_days("training_history", "2024-01-01")
    with pytest.raises(ValueError):
        store.drop_days("detections", "yesterday")


def test_a_begun_batch_is_looked_for(spark, folder, tmp_path, monkeypatch):
    store, rows = Store(spark, str(tmp_path / "s")), V.alerts(spark, folder)
    looked = []
    has_batch = Store.has_batch
    monkeypatch.setattr(Store, "has_batch", lambda self, *a: looked.append(a) or has_batch(self, *a))
    n = rows.count()
    for k in range(3):
        store.append("alerts", rows, f"w:{k}")
    assert not looked and store.read("alerts").count() == 3 * n
    # Written, but the writer died before it said so; and begun without rows.
    os.remove(tmp_path / "s/_batches/alerts/done/w/2")
    store.folders.mark(f"{tmp_path}/s/_batches/alerts/begun/w/2")
    store.folders.mark(f"{tmp_path}/s/_batches/alerts/begun/w/3")
    for k in (1, 2, 3):
        store.append("alerts", rows, f"w:{k}")
    assert len(looked) == 2 and store.read("alerts").count() == 4 * n


def test_live_counters_survive_replay(spark, tmp_path, rows):
    df = stream(spark, tmp_path, *[packets(spark, [(10 * b + i, 100 * b + i) for i in range(10)]) for b in range(5)])
    path = str(tmp_path / "live")
    for attempt in ("a", "b"):  # a lost checkpoint replays every batch
        jobs.write_counters(df, path, str(tmp_path / attempt), compact_every=2, available_now=True).awaitTermination()
        got = {(r["dimension"], r["value"]): r["packets"] for r in jobs.live_counters(spark, path).collect()}
        assert got == {("protocol", "tcp"): 50, ("source", "192.168.1.1"): 50, ("destination", "8.8.8.8"): 50, ("port", "80"): 50}
    assert len(os.listdir(path)) <= 6


def test_newest_rows_of_a_stream(spark, tmp_path):
    df = stream(spark, tmp_path, *[packets(spark, [(b + 5 * i, b + 5 * i) for i in range(20)]) for b in range(5)]).select("packet_id", "ts")
    path = str(tmp_path / "newest")
    jobs.write_newest(df, 7, path, path + "-checkpoint", compact_every=2, available_now=True).awaitTermination()
    log = jobs.newest_log(spark, path, "packet_id bigint, ts timestamp", 7, ["ts", "packet_id"])
    assert sorted(r["packet_id"] for r in log.read().collect()) == list(range(93, 100))
    assert log.entries().count() <= 7 + 7 and all(spark.read.parquet(p).count() <= 7 for p in log.folders_read())


def test_late_packets_stand_apart(spark, tmp_path, rows):
    df = stream(spark, tmp_path, *[packets(spark, b) for b in ([(1, 10)], [(2, 4200)], [(3, 3590), (4, 3660), (5, 20)])])
    path = str(tmp_path / "late")
    for attempt in ("a", "b"):
        jobs.write_timeline_with_late(df, path, str(tmp_path / attempt), available_now=True).awaitTermination()
        # Closed is what ends by 4200 - 600 s.
        got = {(r["start"] - BASE).total_seconds(): (r["in_time"], r["behind"]) for r in jobs.timeline_parts(spark, path).collect()}
        assert got == {0: (1, 1), 4200: (1, 0), 3540: (0, 1), 3660: (1, 0)}


def test_repeats_are_dropped(spark, tmp_path):
    # The last repeat of packet 1 lies behind the watermark, as a first packet there would.
    batches = [[(1, 0), (2, 5), (1, 0)], [(2, 5), (3, 300)], [(4, 9000)], [(5, 9001)], [(1, 0), (6, 1), (5, 9001), (7, 9002)]]
    df = stream(spark, tmp_path, *[packets(spark, b) for b in batches])
    got = collect(spark, jobs.distinct_packets(df).select("packet_id"), tmp_path)
    assert sorted(r["packet_id"] for r in got.collect()) == [1, 2, 3, 4, 5, 7]


def test_beacon_gaps_across_slots_and_batches(spark, tmp_path):
    times = [0, 1, 9, 10, 11, 35, 36, 59]
    beats = [(i, t) for i, t in enumerate(times)]
    pay = lambda df: df.withColumn("payload", F.lit("GET /gate.php HTTP/1.1"))
    df = stream(spark, tmp_path, pay(packets(spark, beats[::2])), pay(packets(spark, beats[1::2])), packets(spark, [(50, 5000)]), packets(spark, [(51, 9000)]))
    got = collect(spark, jobs.beaconing(df, "1 minute", slot="10 seconds"), tmp_path).collect()
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert len(got) == 1 and got[0]["packets"] == 8 and got[0]["endpoint_hits"] == 8 and got[0]["start"] == BASE
    assert got[0]["mean_gap_s"] == pytest.approx(statistics.mean(gaps)) and got[0]["std_gap_s"] == pytest.approx(statistics.pstdev(gaps))


def test_sliding_scans_equal_batch(spark, tmp_path, rows):
    from trafficlens.operators import detectors

    syn = lambda df: df.withColumns({"flags": F.lit(2), "dport": (F.col("packet_id") % 37).cast("int")})
    parts = [syn(packets(spark, [(i, 7 * i) for i in range(b, 200, 2)])) for b in (0, 1)]
    df = stream(spark, tmp_path, *parts, packets(spark, [(999, 99_999)]).withColumn("flags", F.lit(2)), packets(spark, [(998, 99_998)]).withColumn("flags", F.lit(2)))
    got = collect(spark, jobs.port_scans(df, "5 minutes", min_ports=5, slide="2 minutes", late="30 minutes"), tmp_path)
    whole = parts[0].unionByName(parts[1])
    assert rows(got) == rows(detectors.port_scan(whole, "5 minutes", "2 minutes", min_ports=5)) and got.count() > 5


def test_alerts_meet_decisions_in_time(spark, tmp_path):
    at = lambda minutes: BASE + dt.timedelta(minutes=minutes)
    sides = {
        "a": (["id string, timestamp timestamp", [("x", at(0))], [("y", at(1)), ("z", at(2))], [("end", at(9000))], [("end2", at(9001))]]),
        "d": (["alert_id string, status string, decided_at timestamp", [("x", "confirmed", at(5))], [("x", "rejected", at(30)), ("y", "confirmed", at(5000))], [("other", "rejected", at(9000))], [("other", "rejected", at(9001))]]),
    }
    live = []
    for name, (kind, *parts) in sides.items():
        for part in parts:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        live.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    got = collect(spark, jobs.reviewed_alerts(*live, within="1 hour"), tmp_path)
    assert sorted((r["id"], r["decision"]) for r in got.collect() if not r["id"].startswith("end")) == [("x", "confirmed"), ("x", "rejected"), ("y", None), ("z", None)]
