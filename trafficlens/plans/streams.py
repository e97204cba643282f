"""The streaming jobs, run over everything available; results come from the tables they wrote."""

from pyspark.sql import functions as F

from trafficlens import dims, schema
from trafficlens.functions import text as X
from trafficlens.operators import features as FE
from trafficlens.operators import models as MD
from trafficlens.plans.detection import DAY, bounds
from trafficlens.plans.oracle import internal, over, time_text
from trafficlens.plans.registry import query
from trafficlens.plans.traffic import BYTES, MAL, SESSION_SQL, service_join
from trafficlens.plans.payloads import BUILTIN_HITS
from trafficlens.session import new_folder
from trafficlens.sources import files, views as V
from trafficlens.sources.store import Store
from trafficlens.streaming import jobs

WATERMARK = "(select epoch_us(max(ts)) - 600 * 1000000 from packets)"
# Spark filters before it advances the watermark, so only the packets that form sessions move it.
TCP_WATERMARK = "(select epoch_us(max(ts)) - 600 * 1000000 from packets where proto = 'tcp' and sport is not null and dport is not null)"


def _packets(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return V.packets_from_events(files.read_packet_stream(spark, sf, table_schema=schema.ddl(schema.EVENTS), names="events.parquet"))


def _finish(started):
    started.awaitTermination()


def _written(spark, df, name):
    path = new_folder(spark, name)
    _finish(jobs.write_table(df, f"{path}/out", f"{path}/checkpoint", available_now=True))
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _udp_model(spark, sf):
    """A model of a decision that SQL can state: one feature tells UDP packets."""
    batch = V.packets(spark, sf).withColumn("label", (F.col("proto") == "udp").cast("int"))
    return MD.train(FE.feature_vectors(batch, keep=("label",)), "logistic_regression")


def _detected(spark, sf):
    path = new_folder(spark, "detections")
    # Live packets come without the truth.
    live = _packets(spark, sf).withColumn("is_malicious", F.lit(None).cast("boolean"))
    _finish(jobs.write_detections(jobs.scored_packets(live, _udp_model(spark, sf)), path, f"{path}/checkpoint", available_now=True))
    return Store(spark, path)


@query(
    "t1_t4_stream_detections",
    over("""select id, src_ip, dst_port, protocol, length, protocol = 'udp' as is_malicious, true as by_confidence, 35 as width,
 cast(null as boolean) as truth, src_port from detections""", "detections"),
)
def _(spark, sf):
    truth = F.from_json("packet_data", schema.ddl(schema.PACKET))["is_malicious"]
    by_confidence = ((F.col("confidence") > 0.5) == F.col("is_malicious")).alias("by_confidence")
    rows = _detected(spark, sf).read("detections")
    return rows.select("id", "src_ip", "dst_port", "protocol", "length", "is_malicious", by_confidence, F.size("feature_data").alias("width"), truth.alias("truth"), "src_port")


@query("t4_stream_alerts", over("select sha256(cast(id as varchar) || ':score') as id, id as detection_id, 'pending' as status from detections where protocol = 'udp'", "detections"))
def _(spark, sf):
    return _detected(spark, sf).read("alerts").select("id", "detection_id", "status")


@query(
    "t2_stream_timeline",
    over(f"""select {time_text('b')} as "start", packets, bytes, malicious from (select time_bucket(interval '1 hour', ts) as b, count(*) as packets, {BYTES} as bytes, {MAL} as malicious from packets group by 1) q
 where epoch_us(b + interval '1 hour') <= {WATERMARK}""", "packets"),
)
def _(spark, sf):
    out = _written(spark, jobs.traffic_timeline(_packets(spark, sf), "1 hour"), "timeline")
    return out.withColumn("start", X.time_text(F.col("start"))).drop("end")


@query("t3_stream_sessions", over(f"select * from ({SESSION_SQL.format(gap=300)}) s where last_seen + 300 * 1000000 <= {TCP_WATERMARK}", "packets"))
def _(spark, sf):
    out = _written(spark, jobs.tcp_sessions(_packets(spark, sf)), "sessions")
    return out.withColumns({c: F.unix_micros(c) for c in ("start", "last_seen")})


HOUR = "time_bucket(interval '1 hour', ts)"


@query(
    "t5_stream_counters",
    over(f"""select 'protocol' as dimension, proto as value, count(*) as packets from closed group by 2 union all select 'source', src, count(*) from closed group by 2
 union all select 'destination', dst, count(*) from closed group by 2 union all select 'port', cast(dport as varchar), count(*) from closed where dport is not null group by 2""", "packets",
         closed=f"select * from packets where epoch_us({HOUR} + interval '1 hour') <= {WATERMARK}"),
)
def _(spark, sf):
    path = new_folder(spark, "counters")
    _finish(jobs.write_table(jobs.running_counters(_packets(spark, sf)), f"{path}/out", f"{path}/checkpoint", available_now=True))
    return jobs.read_counters(spark, f"{path}/out")


def _parts(spark, sf, parts):
    """A stream of files written one after the other, one or more per batch."""
    path = new_folder(spark, "parts")
    for part in parts:
        V.table(spark, sf, "events").filter(part).coalesce(1).write.mode("append").parquet(path)
    return path


@query("t6_stream_rate", "select cast(3 as bigint) as batches, count(*) as packets, cast(2 as bigint) as most_files from events")
def _(spark, sf):
    """Six files at two per batch: three batches, no packet lost."""
    path = _parts(spark, sf, [f"event_id % 6 = {k}" for k in range(6)])
    out = new_folder(spark, "rate")
    stream = files.read_packet_stream(spark, path, 2, schema.ddl(schema.EVENTS)).select("event_id", F.input_file_name().alias("file"))

    def save(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    _finish(stream.writeStream.option("checkpointLocation", f"{out}-checkpoint").foreachBatch(save).trigger(availableNow=True).start())
    per_batch = spark.read.parquet(out).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    return per_batch.agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("packets"), F.max("files").alias("most_files"))


@query(
    "t8_stream_late_packets",
    over(f"""select {time_text('b')} as "start", count(*) as packets from (select {HOUR} as b, packet_id, ts from packets) p
 where epoch_us(b + interval '1 hour') <= {WATERMARK} and (packet_id % 50 <> 0 or epoch_us(b + interval '1 hour') > (select epoch_us(max(ts)) - 600 * 1000000 from packets where packet_id % 50 > 1)) group by b""", "packets"),
)
def _(spark, sf):
    """Every fiftieth packet arrives after all others: those whose interval is closed by then are dropped.

    Lateness is judged by the watermark with which the batch before ran, so a batch lies between.
    """
    path = _parts(spark, sf, ["event_id % 50 > 1", "event_id % 50 = 1", "event_id % 50 = 0"])
    packets = V.packets_from_events(files.read_packet_stream(spark, path, 1, schema.ddl(schema.EVENTS)))
    out = _written(spark, jobs.traffic_timeline(packets, "1 hour"), "late")
    return out.select(X.time_text(F.col("start")).alias("start"), "packets")


def _packet_parts(spark, sf, parts):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return V.packets_from_events(files.read_packet_stream(spark, _parts(spark, sf, parts), 1, schema.ddl(schema.EVENTS)))


ALL_COUNTS = """select 'protocol' as dimension, proto as value, count(*) as packets from packets group by 2 union all select 'source', src, count(*) from packets group by 2
 union all select 'destination', dst, count(*) from packets group by 2 union all select 'port', cast(dport as varchar), count(*) from packets where dport is not null group by 2"""


@query("t5_live_counters", over(ALL_COUNTS, "packets"))
def _(spark, sf):
    """Five batches, a snapshot after every second; the open hour counts too."""
    path = new_folder(spark, "live")
    packets = _packet_parts(spark, sf, [f"event_id % 5 = {k}" for k in range(5)])
    _finish(jobs.write_counters(packets, f"{path}/log", f"{path}/checkpoint", compact_every=2, available_now=True))
    return jobs.live_counters(spark, f"{path}/log")


@query("l8_stream_newest", over('select packet_id, epoch_us(ts) as ts from packets order by packets.ts desc, packet_id desc limit 500', "packets"))
def _(spark, sf):
    """The newest 500 packets of a stream that brings them in any order."""
    path = new_folder(spark, "newest")
    packets = _packet_parts(spark, sf, [f"event_id % 5 = {k}" for k in range(5)]).select("packet_id", "ts")
    _finish(jobs.write_newest(packets, 500, f"{path}/log", f"{path}/checkpoint", compact_every=2, available_now=True))
    log = jobs.newest_log(spark, f"{path}/log", "packet_id bigint, ts timestamp", 500, ["ts", "packet_id"])
    return log.read().select("packet_id", F.unix_micros("ts").alias("ts"))


@query("t9_dropped_days", over("select id from detections where \"timestamp\" >= timestamp '2024-01-20 00:00:00'", "detections"))
def _(spark, sf):
    """Days before the 20th are hidden, then their files removed."""
    store = Store(spark, new_folder(spark, "days"))
    store.append("detections", V.detections(spark, sf))
    store.drop_days("detections", "2024-01-15")
    store.drop_days("detections", "2024-01-20")
    return store.read("detections").select("id")


@query("u3_stream_distinct_packets", "select event_id as packet_id from events")
def _(spark, sf):
    """Every file comes twice, the second time after others."""
    parts = [f"event_id % 4 = {k}" for k in (0, 1, 0, 2, 1, 3, 3, 2)]
    return _written(spark, jobs.distinct_packets(_packet_parts(spark, sf, parts), "60 days").select("packet_id"), "distinct")


ALERT_WATERMARK = """least((select epoch_us(max("timestamp")) from alerts), (select epoch_us(max(decided_at)) from decisions)) - 600 * 1000000"""


@query(
    "j1_stream_reviewed_alerts",
    over(f"""select a.id, d.status as decision, epoch_us(d.decided_at) as decided_at from alerts a left join decisions d on d.alert_id = a.id and d.decided_at between a."timestamp" and a."timestamp" + interval 90 minute
 where d.alert_id is not null or epoch_us(a."timestamp" + interval 90 minute) < {ALERT_WATERMARK}""", "alerts", "decisions"),
)
def _(spark, sf):
    """Alerts and decisions as two streams; decisions within ninety minutes count."""
    path = new_folder(spark, "reviews")
    sides = {"alerts": V.alerts(spark, sf).select("id", "timestamp"), "decisions": V.decisions(spark, sf).select("alert_id", "status", "decided_at")}
    for name, rows in sides.items():
        rows.write.parquet(f"{path}/{name}")
    live = [files.read_packet_stream(spark, f"{path}/{name}", None, rows.schema) for name, rows in sides.items()]
    found = _written(spark, jobs.reviewed_alerts(*live, within="90 minutes"), "reviewed")
    return found.select("id", "decision", F.unix_micros("decided_at").alias("decided_at"))


@query(
    "t8_late_side_table",
    over(f"""select {time_text('b')} as "start", count(*) filter (not behind) as in_time, count(*) filter (behind) as behind from
 (select {HOUR} as b, packet_id % 50 = 0 and epoch_us({HOUR} + interval '1 hour') <= (select epoch_us(max(ts)) - 600 * 1000000 from packets where packet_id % 50 > 0) as behind from packets) q group by b""", "packets"),
)
def _(spark, sf):
    """Every fiftieth packet comes after all others: what is too late for its hour stands apart, and no packet is lost."""
    path = new_folder(spark, "behind")
    packets = _packet_parts(spark, sf, ["event_id % 50 > 0", "event_id % 50 = 0"])
    _finish(jobs.write_timeline_with_late(packets, f"{path}/logs", f"{path}/checkpoint", "1 hour", available_now=True))
    return jobs.timeline_parts(spark, f"{path}/logs").select(X.time_text(F.col("start")).alias("start"), "in_time", "behind")


@query("t7_stream_signature_hits", over(f"select packet_id, signature from ({BUILTIN_HITS}) q", "packets"))
def _(spark, sf):
    return _written(spark, jobs.signature_hits(_packets(spark, sf)), "hits")


@query("t7_stream_services", over(service_join("analysis", "unknown"), "packets"))
def _(spark, sf):
    named = jobs.with_services(_packets(spark, sf)).select("packet_id", "src_service", "dst_service")
    return _written(spark, named, "services")


@query("t9_retention", over("select id from detections where \"timestamp\" > timestamp '2024-01-31 00:00:00' - interval 7 day", "detections"))
def _(spark, sf):
    return jobs.retained(V.detections(spark, sf), "2024-01-31 00:00:00", "7 days").select("id")


@query("t9_stream_retention", over("select packet_id from packets where ts > timestamp '2024-01-31 00:00:00' - interval 7 day", "packets"))
def _(spark, sf):
    recent = jobs.retained(_packets(spark, sf), "2024-01-31 00:00:00", "7 days", "ts")
    return _written(spark, recent.select("packet_id"), "recent")


# --- detectors on streams: the batch results of the intervals that the watermark has closed ---


def closed(condition: str, width: str, start: str = "b") -> str:
    """Spark filters before it advances the watermark, so only the packets a detector looks at move it."""
    return f"epoch_us({start} + interval '{width}') <= (select epoch_us(max(ts)) - 600 * 1000000 from packets where {condition})"


SYN = "proto = 'tcp' and flags = 2"
LOGIN = "proto = 'tcp' and dport in (21, 22) and (contains(payload, 'USER') or contains(payload, 'PASS'))"
REQUEST = "proto = 'tcp' and (flags = 2 or payload like 'GET %')"
OUTWARD = f"{internal('src')} and not {internal('dst')}"


def _shown(df):
    return df.withColumns({c: X.time_text(F.col(c)) for c in ("start", "end") if c in df.columns})


@query(
    "r1_stream_port_scan",
    over(f"select src, {bounds()}, syn_packets, ports from (select src, {DAY} as b, count(*) as syn_packets, count(distinct dport) as ports from packets where {SYN} group by 1, 2) q where ports >= 2 and {closed(SYN, '1 day')}", "packets"),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.port_scans(_packets(spark, sf), "1 day", min_ports=2), "scans"))


@query(
    "r2_stream_brute_force",
    over(f"""select src, dst, dport, {bounds('7 days')}, attempts from (select src, dst, dport, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as b, count(*) as attempts from packets
 where {LOGIN} group by 1, 2, 3, 4) q where {closed(LOGIN, '7 days')}""", "packets"),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.brute_force(_packets(spark, sf), "7 days", min_attempts=1), "logins"))


@query(
    "r3_stream_flood",
    over(f"""select dst, dport, {bounds()}, packets, sources from (select dst, dport, {DAY} as b, count(*) as packets, count(distinct src) as sources from packets
 where {REQUEST} group by 1, 2, 3) q where sources >= 2 and packets >= 2 and {closed(REQUEST, '1 day')}""", "packets"),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.floods(_packets(spark, sf), "1 day", min_sources=2, min_packets=2), "floods"))


@query(
    "r4_stream_exfiltration",
    over(f"""select src, {bounds()}, bytes_out, marker_hits from (select src, {DAY} as b, cast(sum(len) as bigint) as bytes_out, count(*) filter (contains(payload, 'BASE64')) as marker_hits from packets
 where {OUTWARD} group by 1, 2) q where (marker_hits > 0 or bytes_out >= 1000) and {closed(OUTWARD, '1 day')}""", "packets"),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.exfiltration(_packets(spark, sf), "1 day", min_bytes=1000), "exfiltration"))


ENDPOINTS = " or ".join(f"contains(payload, '{e}')" for e in dims.CONTROL_ENDPOINTS)


def slid(body: str, condition: str, width: int = 2) -> str:
    """``body`` over the packets of ``condition``, each in every window of ``width`` days that slides by a day; closed windows only."""
    copies = " union all ".join(f"select *, {DAY} - interval '{k} days' as b from packets where {condition}" for k in range(width))
    return over(f"select * exclude (b), {bounds(f'{width} days')} from ({body}) q where {closed(condition, f'{width} days')}", "packets", slid=copies)


@query("r1_stream_port_scan_sliding", slid("select src, b, count(*) as syn_packets, count(distinct dport) as ports from slid group by src, b having count(distinct dport) >= 3", SYN))
def _(spark, sf):
    return _shown(_written(spark, jobs.port_scans(_packets(spark, sf), "2 days", min_ports=3, slide="1 day"), "scans"))


@query("r2_stream_brute_force_sliding", slid("select src, dst, dport, b, count(*) as attempts from slid group by src, dst, dport, b", LOGIN, 7))
def _(spark, sf):
    return _shown(_written(spark, jobs.brute_force(_packets(spark, sf), "7 days", min_attempts=1, slide="1 day"), "logins"))


@query(
    "r3_stream_flood_sliding",
    slid("select dst, dport, b, count(*) as packets, count(distinct src) as sources from slid group by dst, dport, b having count(distinct src) >= 2 and count(*) >= 3", REQUEST),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.floods(_packets(spark, sf), "2 days", min_sources=2, min_packets=3, slide="1 day"), "floods"))


@query(
    "r4_stream_exfiltration_sliding",
    slid("""select src, b, cast(sum(len) as bigint) as bytes_out, count(*) filter (contains(payload, 'BASE64')) as marker_hits from slid group by src, b
 having sum(len) >= 1500 or count(*) filter (contains(payload, 'BASE64')) > 0""", OUTWARD, 3),
)
def _(spark, sf):
    return _shown(_written(spark, jobs.exfiltration(_packets(spark, sf), "3 days", min_bytes=1500, slide="1 day"), "exfiltration"))


ENDPOINTS = " or ".join(f"contains(payload, '{e}')" for e in dims.CONTROL_ENDPOINTS)


@query(
    "r5_stream_beaconing",
    over(f"""select src, dst, {bounds('7 days')}, packets, endpoint_hits, round(mean_gap_s, 3) as mean_gap_s, round(std_gap_s, 3) as std_gap_s from
 (select src, dst, b, count(*) as packets, count(*) filter ({ENDPOINTS}) as endpoint_hits, avg(g) as mean_gap_s, stddev_pop(g) as std_gap_s from
 (select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by src, dst, b order by ts)) / 1000000.0e0 as g from
 (select *, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as b from packets) p) g group by 1, 2, 3) q
 where endpoint_hits > 0 and packets >= 2 and {closed('true', '7 days')}""", "packets"),
)
def _(spark, sf):
    found = _written(spark, jobs.beaconing(_packets(spark, sf), "7 days", min_packets=2, slot="1 hour"), "beacons")
    return _shown(found).withColumns({c: F.round(c, 3) for c in ("mean_gap_s", "std_gap_s")})


@query(
    "r6_stream_attack_episodes",
    over("""select src_ip, category, min(t) as "start", max(t) as "end", count(*) as alerts from
 (select *, sum(opens) over (partition by src_ip, category order by t, packet_id) as episode from
 (select *, case when t - lag(t) over (partition by src_ip, category order by t, packet_id) <= 86400000000 then 0 else 1 end as opens from
 (select *, epoch_us(ts) as t from packet_alerts) a) o) s group by src_ip, category, episode
 having max(t) + 86400000000 <= (select max(epoch_us(ts)) - 600 * 1000000 from packet_alerts)""", "packet_alerts"),
)
def _(spark, sf):
    scored = _packets(spark, sf).withColumn("confidence", ((F.col("packet_id") * 37) % 100).cast("double") / 100.0)
    found = _written(spark, jobs.attack_episodes(scored, "86400 seconds"), "episodes")
    return found.withColumns({c: F.unix_micros(c) for c in ("start", "end")})
