"""Detectors over packets and alerts."""

from pyspark.sql import functions as F

from trafficlens.functions import text as X
from trafficlens.operators import detectors as D
from trafficlens.plans.oracle import internal, over
from trafficlens.plans.registry import query
from trafficlens.sources import views as V

DAY = "time_bucket(interval '1 day', ts)"


def _shown(df):
    return df.withColumns({c: X.time_text(F.col(c)) for c in ("start", "end") if c in df.columns})


def bounds(width: str = "1 day") -> str:
    return f"strftime(b, '%Y-%m-%d %H:%M:%S') as \"start\", strftime(b + interval '{width}', '%Y-%m-%d %H:%M:%S') as \"end\""


@query(
    "r1_port_scan",
    over(f"select src, {bounds()}, syn_packets, ports from (select src, {DAY} as b, count(*) as syn_packets, count(distinct dport) as ports from packets where proto = 'tcp' and flags = 2 group by 1, 2) q where ports >= 2", "packets"),
)
def _(spark, sf):
    return _shown(D.port_scan(V.packets(spark, sf), "1 day", min_ports=2))


@query(
    "r1_port_scan_sliding",
    over("""select src, strftime(b, '%Y-%m-%d %H:%M:%S') as "start", strftime(b + interval '2 days', '%Y-%m-%d %H:%M:%S') as "end", syn_packets, ports from
 (select src, b, count(*) as syn_packets, count(distinct dport) as ports from
 (select *, time_bucket(interval '1 day', ts) as b from packets union all select *, time_bucket(interval '1 day', ts) - interval '1 day' as b from packets) p
 where proto = 'tcp' and flags = 2 group by 1, 2) q where ports >= 3""", "packets"),
)
def _(spark, sf):
    return _shown(D.port_scan(V.packets(spark, sf), "2 days", "1 day", min_ports=3))


@query(
    "r2_brute_force",
    over(f"""select src, dst, dport, {bounds('7 days')}, attempts from (select src, dst, dport, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as b, count(*) as attempts from packets
 where proto = 'tcp' and dport in (21, 22) and (contains(payload, 'USER') or contains(payload, 'PASS')) group by 1, 2, 3, 4) q where attempts >= 1""", "packets"),
)
def _(spark, sf):
    return _shown(D.brute_force(V.packets(spark, sf), "7 days", min_attempts=1))


@query(
    "r3_flood",
    over(f"""select dst, dport, {bounds()}, packets, sources from (select dst, dport, {DAY} as b, count(*) as packets, count(distinct src) as sources from packets
 where proto = 'tcp' and (flags = 2 or payload like 'GET %') group by 1, 2, 3) q where sources >= 2 and packets >= 2""", "packets"),
)
def _(spark, sf):
    return _shown(D.flood(V.packets(spark, sf), "1 day", min_sources=2, min_packets=2))


# All packets within two hours and from forty hosts, so that the detectors' own thresholds and widths are met.
DENSE = "select * replace (timestamp '2024-01-01 00:00:00' + to_seconds(packet_id % 7200) as ts, '10.0.0.' || cast(packet_id % 40 as varchar) as src, cast(1 + packet_id % 977 as integer) as dport) from packets"


def _dense(spark, sf):
    k = F.col("packet_id")
    return V.packets(spark, sf).withColumns(
        {"ts": F.timestamp_seconds(F.lit(1704067200) + k % 7200), "src": F.concat(F.lit("10.0.0."), k % 40), "dport": (1 + k % 977).cast("int")}
    )


@query(
    "r1_port_scan_defaults",
    over(f"select src, {bounds('1 hour')}, syn_packets, ports from (select src, time_bucket(interval '1 hour', ts) as b, count(*) as syn_packets, count(distinct dport) as ports from dense where proto = 'tcp' and flags = 2 group by 1, 2) q where ports >= 10", "packets", dense=DENSE),
)
def _(spark, sf):
    return _shown(D.port_scan(_dense(spark, sf), "1 hour"))


@query(
    "r2_brute_force_defaults",
    over(f"""select src, dst, dport, {bounds('5 minutes')}, attempts from (select src, dst, dport, time_bucket(interval '5 minutes', ts) as b, count(*) as attempts from logins group by 1, 2, 3, 4) q where attempts >= 5""", "packets",
         logins="""select * replace ('10.0.0.' || cast(user_id % 5 as varchar) as src, '10.0.1.1' as dst, 22 as dport, timestamp '2024-01-01 00:00:00' + to_seconds(event_id % 7200) as ts) from
 (select packets.*, user_id, event_id from packets join events on event_id = packet_id) e where proto = 'tcp' and (contains(payload, 'USER') or contains(payload, 'PASS'))"""),
)
def _(spark, sf):
    k = F.col("packet_id")
    users = V.table(spark, sf, "events").select(F.col("event_id").alias("packet_id"), "user_id")
    p = V.packets(spark, sf).join(users, "packet_id").withColumns(
        {"src": F.concat(F.lit("10.0.0."), F.col("user_id") % 5), "dst": F.lit("10.0.1.1"), "dport": F.lit(22), "ts": F.timestamp_seconds(F.lit(1704067200) + k % 7200)}
    )
    return _shown(D.brute_force(p))


@query(
    "r3_flood_defaults",
    over(f"""select dst, dport, {bounds('1 hour')}, packets, sources from (select 'all' as dst, 80 as dport, time_bucket(interval '1 hour', ts) as b, count(*) as packets, count(distinct src) as sources from dense
 where proto = 'tcp' and (flags = 2 or payload like 'GET %') group by 3) q where sources >= 20 and packets >= 100""", "packets", dense=DENSE),
)
def _(spark, sf):
    return _shown(D.flood(_dense(spark, sf).withColumns({"dst": F.lit("all"), "dport": F.lit(80)}), "1 hour"))


@query(
    "r4_exfiltration",
    over(f"""select src, {bounds()}, bytes_out, marker_hits from (select src, {DAY} as b, cast(sum(len) as bigint) as bytes_out, count(*) filter (contains(payload, 'BASE64')) as marker_hits from packets
 where {internal('src')} and not {internal('dst')} group by 1, 2) q where marker_hits > 0 or bytes_out >= 1000""", "packets"),
)
def _(spark, sf):
    return _shown(D.exfiltration(V.packets(spark, sf), "1 day", min_bytes=1000))


@query(
    "r5_beaconing",
    over("""select src, dst, packets, endpoint_hits, round(mean_gap_s, 3) as mean_gap_s, round(std_gap_s, 3) as std_gap_s from
 (select src, dst, count(*) as packets, count(*) filter (contains(payload, 'gate.php') or contains(payload, 'config.bin') or contains(payload, 'updates.js') or contains(payload, '/admin/')) as endpoint_hits,
 avg(g) as mean_gap_s, stddev_pop(g) as std_gap_s from
 (select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by src, dst order by ts)) / 1000000.0e0 as g from packets) p group by 1, 2) q where endpoint_hits > 0 and packets >= 3""", "packets"),
)
def _(spark, sf):
    return D.beaconing(V.packets(spark, sf)).withColumns({c: F.round(c, 3) for c in ("mean_gap_s", "std_gap_s")})


@query(
    "r6_attack_episodes",
    over("""select src_ip, category, min(t) as "start", max(t) as "end", count(*) as alerts from
 (select *, sum(opens) over (partition by src_ip, category order by t, packet_id) as episode from
 (select *, case when t - lag(t) over (partition by src_ip, category order by t, packet_id) <= 86400000000 then 0 else 1 end as opens from
 (select *, epoch_us(ts) as t from packet_alerts) a) o) s group by src_ip, category, episode""", "packet_alerts"),
)
def _(spark, sf):
    e = D.episodes(V.described_alerts(spark, sf), gap_seconds=86400)
    return e.withColumns({c: F.unix_micros(c) for c in ("start", "end")})
