"""Operators on small literal inputs, compared with hand-computed or brute-force results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import header as H
from trafficlens.functions import rules as R
from trafficlens.functions import text as X
from trafficlens.functions import vectors
from trafficlens.operators import alerts as A
from trafficlens.operators import detectors as D
from trafficlens.operators import features as FE
from trafficlens.operators import graph as G
from trafficlens.operators import normalize as N
from trafficlens.operators import ranking as RK
from trafficlens.operators import sessions as S
from trafficlens.operators import signatures as SG
from trafficlens.operators import traffic as T

BASE = dt.datetime(2024, 1, 1)
PACKET = "packet_id bigint, ts timestamp, src string, dst string, proto string, sport int, dport int, flags int, len int, ttl int, frag boolean, icmp_type int, icmp_code int, payload string, is_malicious boolean"


def packet(i, seconds=0.0, src="192.168.1.1", dst="8.8.8.8", proto="tcp", sport=5000, dport=80, flags=24, size=100, payload=None, bad=False):
    return (i, BASE + dt.timedelta(seconds=seconds), src, dst, proto, sport, dport, flags, size, 64, None, None, None, payload, bad)


def test_session_gap_boundary(spark, rows):
    df = spark.createDataFrame([packet(1, 0), packet(2, 300), packet(3, 601), packet(4, 602)], PACKET)
    out = S.tcp_sessions(df).select("packets")
    assert rows(out) == [(2,), (2,)]


@pytest.mark.parametrize("gap", [1, 7, 300])
def test_sessions_and_gaps_with_one_hot_key(spark, gap):
    rng = random.Random(gap)
    times, t = [], 0.0
    for _ in range(2000):
        t += rng.choice([0.0, 0.2, 1.0, 6.9, 7.0, 7.1, 59.0, 61.0, 299.0, 300.0, 301.0, 4000.0]) * rng.choice([0, 1, 1])
        times.append(t)
    data = [("hot", BASE + dt.timedelta(seconds=x)) for x in times] + [("cold", BASE)]
    df = spark.createDataFrame(data, "k string, ts timestamp").repartition(5)
    got = S.sessionize(df, ["k"], gap_seconds=gap).filter("k = 'hot'").orderBy("start").collect()
    micros = sorted(round(x * 1e6) for x in times)
    want, start, last, n = [], micros[0], micros[0], 0
    for m in micros:
        if m - last > gap * 1_000_000:
            want.append((start, last, n))
            start, n = m, 0
        last, n = m, n + 1
    want.append((start, last, n))
    base = int((BASE - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    as_micros = [(round((r["start"] - BASE).total_seconds() * 1e6), round((r["last_seen"] - BASE).total_seconds() * 1e6), r["rows"]) for r in got]
    assert base and as_micros == want
    gaps = sorted(round(r["gap_s"] * 1e6) for r in S.gaps(df, ["k"]).collect())
    assert gaps == sorted(b - a for a, b in zip(micros, micros[1:]))


def test_seeded_rank_is_exact(spark):
    import hashlib

    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(500)], "id bigint, g string")
    for digits in (1, 2, 4):
        got = {r["id"]: (r["rank"], r["group_size"]) for r in RK.seeded_rank(df, "id", 42, "g", digits).collect()}
        for g in ("big", "small"):
            ids = sorted((i for i in range(500) if ("big" if i % 3 else "small") == g), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
            assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_samples_are_the_first_ranks(spark, rows):
    df = spark.range(300)
    ranked = RK.seeded_rank(df, "id", 42)
    for n in (0, 1, 50, 299, 300, 1000):
        assert rows(RK.seeded_sample(df, "id", n)) == rows(ranked.filter(F.col("rank") <= n).select("id"))
    without = spark.createDataFrame([(1,), (None,), (None,), (2,)], "id bigint")
    assert [RK.seeded_sample(without, "id", n).count() for n in (2, 3, 9)] == [2, 3, 4]
    assert RK.seeded_sample(df.limit(0), "id", 5).count() == 0


def test_pieces_are_cuts_of_the_ranks(spark, monkeypatch):
    half = F.floor(F.col("group_size") / 2)
    many = [(i, "abc"[i % 3] if i % 7 else None) for i in range(400)]
    repeated = many + [(None, "a")] * 300 + [(5, "b")] * 200 + [(None, None)] * 9
    for most in (RK.MOST_GROUPS, 2):
        monkeypatch.setattr(RK, "MOST_GROUPS", most)
        for data in (many, repeated):
            df = spark.createDataFrame(data, "id bigint, g string").repartition(3)
            for digits in (1, 4):
                got = RK.seeded_pieces(df, "id", 42, [F.lit(20), half, F.lit(10_000)], "g", digits)
                assert got.columns == ["id", "g", "piece"]
                counts = {(r["g"], r["piece"]): r["n"] for r in got.groupBy("g", "piece").agg(F.count("*").alias("n")).collect()}
                for g in ("a", "b", "c", None):
                    n = sum(x[1] == g for x in data)
                    assert (counts[g, 0], counts[g, 1]) == (20, n // 2 - 20) and counts[g, 2] == n - n // 2
                ranked = RK.seeded_rank(df, "id", 42, "g", digits)
                want = ranked.select("id", "g", ((F.col("rank") > 20).cast("int") + (F.col("rank") > half).cast("int")).alias("piece"))
                key = lambda r: (str(r["g"]), str(r["id"]), r["piece"])
                assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_pieces_move_no_row_unless_keys_repeat(spark):
    def plan(df):
        return RK.seeded_pieces(df, "id", 42, [F.lit(20)], "g")._jdf.queryExecution().optimizedPlan().toString()

    df = spark.range(100).withColumn("g", F.col("id") % 2)
    assert "Window" not in plan(df) and "Union" not in plan(df)
    assert "Window" in plan(df.withColumn("id", F.lit(None).cast("bigint")))


def test_flow_features_use_exact_durations(spark):
    df = spark.createDataFrame([packet(1, 0, size=1000), packet(2, 1.9, size=900), packet(3, 0, src="9.9.9.9")], PACKET)
    f = {r["packet_id"]: r for r in FE.header_features(df, with_flow=True).collect()}
    assert f[1]["flow_duration"] == pytest.approx(1.9 / 3600)
    assert f[1]["packet_rate"] == pytest.approx(2 / 1.9 / 1000)
    assert f[1]["byte_rate"] == pytest.approx(1900 / 1.9 / 1e6)
    assert (f[3]["flow_duration"], f[3]["packet_rate"], f[3]["byte_rate"]) == (0.0, 0.0, pytest.approx(100 / 1e6))
    single = FE.header_features(df).filter("packet_id = 1").first()
    assert (single["flow_duration"], single["packet_rate"], single["byte_rate"]) == (0.0, 0.0, pytest.approx(0.001))


def test_header_features_of_missing_fields(spark):
    df = spark.createDataFrame([(1, BASE) + (None,) * 13], PACKET)
    f = FE.header_features(df).first().asDict()
    assert f.pop("packet_id") == 1 and set(f.values()) == {0.0} and len(f) == 15


def test_flow_facts_join_null_ports(spark):
    df = spark.createDataFrame([packet(1, proto="icmp", sport=None, dport=None), packet(2, 5, proto="icmp", sport=None, dport=None)], PACKET)
    assert [r["flow_packets"] for r in G.with_flow_facts(df).collect()] == [2, 2]


def test_flag_texts(spark):
    df = spark.createDataFrame([(None,), (0,), (2,), (18,), (24,), (255,)], "f int")
    out = [tuple(r) for r in df.select(H.flag_text(F.col("f")), F.array_join(H.flag_names(F.col("f")), "+"), H.hex_text(F.col("f"))).collect()]
    assert out == [
        ("None", "", "-"), ("0x00", "", "0x0"), ("0x02 (SYN)", "SYN", "0x2"), ("0x12 (SYN, ACK)", "SYN+ACK", "0x12"),
        ("0x18 (PSH, ACK)", "PSH+ACK", "0x18"), ("0xff (FIN, SYN, RST, PSH, ACK, URG, ECE, CWR)", "FIN+SYN+RST+PSH+ACK+URG", "0xff"),
    ]


def test_human_bytes(spark):
    sizes = {0: "0 B", 512: "512.0 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 1025: "1.0 KB", 2**50: "1024.0 TB", 1152: "1.12 KB"}
    df = spark.createDataFrame([(k,) for k in sizes], "n bigint")
    assert [r[0] for r in df.select(X.human_bytes(F.col("n"))).collect()] == list(sizes.values())
    wide = df.select(X.human_bytes(F.col("n"), ("B", "KB", "MB", "GB", "TB", "PB")).alias("t")).filter("t like '%PB'")
    assert wide.count() == 1


def test_timestamps(spark):
    texts = ["2024-01-01T10:00:00", "2024-01-01T10:00:00.250Z", "2024-01-01 10:00:00.000001", "2024-01-01T12:00:00+02:00", "yesterday", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.unix_micros(X.parse_timestamp(F.col("t")))).collect()]
    ten = 1704103200_000000
    assert got == [ten, ten + 250000, ten + 1, ten, None, None]


def test_time_bands(spark):
    df = spark.range(24).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    bands = [r[0] for r in df.select(X.time_band(F.col("t"))).collect()]
    assert bands == ["night"] * 8 + ["working_hours"] * 10 + ["after_hours"] * 5 + ["night"]


def test_attack_rules(spark):
    data = [
        packet(1, flags=2, dport=443, payload=None), packet(2, dport=21, payload="USER admin"), packet(3, payload="a'; --"),
        packet(4, payload="<script>"), packet(5, proto="udp", dport=53, payload="x" * 101), packet(6, proto="UDP", dport=5353, sport=6000),
        packet(7, proto="icmp", sport=None, dport=None, flags=None), packet(8, dport=9, payload="BASE64"), packet(9, dport=9, payload="/admin/"),
        packet(10, dport=9, payload=None), packet(11, dport=22, payload="PASS x"), packet(12, dport=80, payload="SELECT 'x'"),
    ]
    df = spark.createDataFrame(data, PACKET).withColumn("d", R.packet_attack_description())
    got = {r["packet_id"]: (r["d"], r["c"]) for r in df.withColumn("c", R.attack_category(F.col("d"))).collect()}
    assert got[1] == ("Possible port scan from 192.168.1.1 targeting port 443 on 8.8.8.8", "Port Scan")
    assert [got[i][1] for i in range(2, 13)] == [
        "Brute Force", "Injection Attack", "XSS Attack", "DNS Attack", "Other", "Other", "Data Exfiltration", "C&C Communication",
        "Other", "Brute Force", "Injection Attack",
    ]
    assert got[2][0].endswith("FTP service") and got[11][0].endswith("SSH service")


def test_normalise_from_csv_columns(spark):
    df = spark.createDataFrame([("1.2.3.4", 53, "udp", "BENIGN"), (None, None, "dns", "DDoS")], "src string, dst_port int, protocol string, label string")
    out = [tuple(r) for r in N.normalize_packets(df).drop("ts").collect()]
    assert out[0] == ("1.2.3.4", "192.168.1.2", "udp", 1024, 53, 0, 128, 64, N.DNS_PAYLOAD, False)
    assert out[1] == ("192.168.1.1", "192.168.1.2", "dns", 1024, 80, 0, 128, 64, N.HTTP_PAYLOAD, True)


def test_target_choice_and_binarising(spark):
    df = spark.createDataFrame([("a", 1), ("Benign", 0), ("c", 1)], "attack_type string, is_malicious int")
    assert N.pick_target(df) == "attack_type"
    with pytest.raises(ValueError):
        N.pick_target(df.select(F.lit(1).alias("x")))
    assert [r[0] for r in N.binarise_target(df, "attack_type").collect()] == [1, 0, 1]
    assert [r[1] for r in N.binarise_target(df, "is_malicious").collect()] == [1, 0, 1]
    two = spark.createDataFrame([("web",), ("dos",)], "label string")
    assert [r[0] for r in N.binarise_target(two, "label").collect()] == [1, 0]


def test_infinities_become_missing(spark):
    df = spark.createDataFrame([(float("inf"), 1), (float("-inf"), 2), (float("nan"), 3), (1.5, 4)], "x double, y int")
    clean = N.infinite_to_null(df)
    assert [r[0] for r in clean.collect()] == [None, None, None, 1.5]
    assert N.drop_incomplete(clean).count() == 1 and N.has_nulls(clean).first()[0] and not N.has_nulls(df).first()[0]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    row = df.select(vectors.argmax(F.col("v")), vectors.fit_width(F.col("v"), 5), vectors.fit_width(F.col("v"), 2)).first()
    assert tuple(row) == (1, [1.0, 3.0, 3.0, 0.0, 0.0], [1.0, 3.0])


def test_status_resolution(spark, rows):
    alerts = spark.createDataFrame([("a", 1, BASE, "pending", None, None), ("b", 2, BASE, "pending", None, None)], "id string, detection_id bigint, timestamp timestamp, status string, admin_notes string, reviewed_at timestamp")
    later = BASE + dt.timedelta(hours=1)
    log = spark.createDataFrame([("a", "needs_analysis", "hm", BASE), ("a", "confirmed", "yes", later), ("zz", "rejected", "no", later)], "alert_id string, status string, admin_notes string, decided_at timestamp")
    resolved = A.resolve_status(alerts, log)
    assert rows(resolved.select("id", "status", "admin_notes", "reviewed_at")) == [("a", "confirmed", "yes", later), ("b", "pending", None, None)]


def test_signature_maintenance(spark, rows):
    assert SG.bad_patterns(spark, [r"a(b|c)\Z", "a(b", None, "x", "*", r"(?P<n>a)(?P=n)"]) == {"a(b", None, "*"}
    with pytest.raises(ValueError):
        SG.signature_entry(spark, 1, "bad", "a(b", "2024-01-01")
    one = SG.signature_entry(spark, 1, "x", "abc", "2024-01-01")
    two = SG.signature_entry(spark, 2, "x", "abcd", "2024-01-02")
    three = SG.signature_entry(spark, 3, "y", "z" * 60, "2024-01-01")
    base = SG.upsert(one.limit(0).withColumns({"is_active": F.lit(True), "created_at": F.col("added_at"), "updated_at": F.col("added_at")}), one.unionByName(two).unionByName(three))
    assert rows(base.select("id", "name", "pattern")) == [(1, "x", "abcd"), (3, "y", "z" * 60)]
    off = spark.createDataFrame([(1, False, BASE), (1, True, BASE - dt.timedelta(days=1)), (99, False, BASE)], "id bigint, is_active boolean, changed_at timestamp")
    toggled = SG.toggle(base, off)
    assert rows(SG.active(toggled).select("id")) == [(3,)]
    assert rows(SG.delete(base, spark.createDataFrame([(3,)], "id bigint")).select("id")) == [(1,)]
    assert SG.listing(base).filter("id = 3").first()["pattern"] == "z" * 50 + "..."


def test_detectors(spark):
    scan = [packet(i, i / 10, src="203.0.113.9", dport=i, flags=2) for i in range(1, 13)]
    login = [packet(100 + i, i, src="203.0.113.8", dport=22, payload="USER admin\r\nPASS x") for i in range(6)]
    flood = [packet(200 + i, 1, src=f"198.51.100.{i}", dst="192.168.1.10", dport=80, flags=2) for i in range(25)]
    leak = [packet(300, 3, payload="BASE64DATA"), packet(301, 3, dst="192.168.1.3", payload="BASE64DATA")]
    beat = [packet(400 + i, 60 * i, src="192.168.1.77", dst="1.2.3.4", payload="GET /gate.php") for i in range(5)]
    df = spark.createDataFrame(scan + login + flood + leak + beat, PACKET)
    assert [(r["src"], r["ports"]) for r in D.port_scan(df).collect()] == [("203.0.113.9", 12)]
    assert [(r["src"], r["attempts"]) for r in D.brute_force(df).collect()] == [("203.0.113.8", 6)]
    assert [(r["dst"], r["sources"]) for r in D.flood(df, min_packets=20).collect()] == [("192.168.1.10", 25)]
    assert [(r["src"], r["marker_hits"]) for r in D.exfiltration(df).collect()] == [("192.168.1.1", 1)]
    b = D.beaconing(df).collect()
    assert [(r["src"], r["packets"], r["mean_gap_s"], r["std_gap_s"]) for r in b] == [("192.168.1.77", 5, 60.0, 0.0)]


def test_empty_input(spark):
    df = spark.createDataFrame([], PACKET)
    assert tuple(T.totals(df).first()) == (0, 0, 0, 0)
    assert tuple(T.truth_shares(df).first()) == (0.0, 0.0)
    assert FE.feature_vectors(df).count() == 0 and D.beaconing(df).count() == 0


def test_shares_sum_to_one_hundred(spark, folder):
    from trafficlens.sources import views as V

    total = T.protocol_distribution(V.packets(spark, folder)).agg(F.sum("percentage")).first()[0]
    assert total == pytest.approx(100.0)
