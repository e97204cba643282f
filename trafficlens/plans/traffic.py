"""Traffic aggregates, services, top lists, graph and sessions."""

from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import header as H
from trafficlens.functions import text as X
from trafficlens.operators import graph as G
from trafficlens.operators import sessions as S
from trafficlens.operators import traffic as T
from trafficlens.plans.oracle import internal, over, time_text
from trafficlens.plans.registry import query
from trafficlens.sources import views as V
from trafficlens.streaming import jobs


def r6(*columns):
    return {c: F.round(c, 6) for c in columns}


MAL = "count(*) filter (is_malicious)"
BYTES = "cast(coalesce(sum(len), 0) as bigint)"


@query("a1_totals", over(f"select count(*) as packets, {BYTES} as bytes, count(*) filter (not is_malicious) as benign, {MAL} as malicious from packets", "packets"))
def _(spark, sf):
    return T.totals(V.packets(spark, sf))


@query("a2_truth_percent", over(f"select round(100.0 * count(*) filter (not is_malicious) / count(*), 6) as benign_percent, round(100.0 * {MAL} / count(*), 6) as malicious_percent from packets", "packets"))
def _(spark, sf):
    return T.truth_shares(V.packets(spark, sf)).withColumns(r6("benign_percent", "malicious_percent"))


@query(
    "a3_protocol_distribution",
    over("""select protocol, packets, round(100.0 * packets / sum(packets) over (), 6) as percentage from
 (select case when lower(proto) in ('tcp','udp','icmp') then lower(proto) else 'other' end as protocol, count(*) as packets from packets group by 1) q""", "packets"),
)
def _(spark, sf):
    return T.protocol_distribution(V.packets(spark, sf)).withColumns(r6("percentage"))


@query("a4_malicious_protocols", over("select upper(protocol) as protocol, count(*) as packets from detections where is_malicious group by 1", "detections"))
def _(spark, sf):
    return T.malicious_protocols(V.detections(spark, sf))


@query("a5_packets_per_source", over("select src, count(*) as packets from packets where src is not null group by 1", "packets"))
def _(spark, sf):
    return T.packets_per(V.packets(spark, sf), "src")


@query("a6_packets_per_destination", over("select dst, count(*) as packets from packets where dst is not null group by 1", "packets"))
def _(spark, sf):
    return T.packets_per(V.packets(spark, sf), "dst")


@query("a7_packets_per_port", over("select dport, count(*) as packets from packets where coalesce(dport, 0) <> 0 group by 1", "packets"))
def _(spark, sf):
    return T.packets_per_port(V.packets(spark, sf))


@query(
    "a8_traffic_direction",
    over(f"""select case when {internal('src')} then 'internal' else 'external' end || '_to_' || case when {internal('dst')} then 'internal' else 'external' end as direction,
 count(*) as packets from packets group by 1""", "packets"),
)
def _(spark, sf):
    return T.direction_counts(V.packets(spark, sf))


@query("a9_per_minute", over(f"select {time_text(chr(34) + 'm' + chr(34))} as \"minute\", is_malicious, packets from (select date_trunc('minute', ts) as m, is_malicious, count(*) as packets from packets group by 1, 2) q", "packets"))
def _(spark, sf):
    return T.per_minute(V.packets(spark, sf)).withColumn("minute", X.time_text(F.col("minute")))


TIMELINE = f"""select {time_text('b')} as "start", packets, bytes, malicious from
 (select time_bucket(interval '{{w}}', ts) as b, count(*) as packets, {BYTES} as bytes, {MAL} as malicious from packets group by 1) q"""


@query("a10_traffic_timeline", over(TIMELINE.format(w="1 hour"), "packets"))
def _(spark, sf):
    return T.timeline(V.packets(spark, sf), "1 hour").withColumn("start", X.time_text(F.col("start"))).drop("end")


@query("a32_rate_history", over("select strftime(s, '%Y-%m-%d %H:%M:%S') as \"start\", cast(n as double) as rate from (select date_trunc('second', ts) as s, count(*) as n from packets group by 1) q order by s desc limit 60", "packets"))
def _(spark, sf):
    return T.rate_history(V.packets(spark, sf)).withColumn("start", X.time_text(F.col("start")))


@query(
    "a34_protocol_counters",
    over(f"""select is_malicious, count(*) as packets, {BYTES} as bytes, count(*) filter (proto = 'tcp') as tcp, count(*) filter (proto = 'udp') as udp,
 count(*) filter (proto = 'icmp') as icmp, count(*) filter (proto not in ('tcp','udp','icmp')) as other from packets group by 1""", "packets"),
)
def _(spark, sf):
    return T.protocol_counters(V.packets(spark, sf))


@query("a19_detections_per_class", over("select is_malicious, count(*) as detections from detections group by 1", "detections"))
def _(spark, sf):
    return T.class_counts(V.detections(spark, sf))


# --- services and top lists ---

def service_values(catalog: str) -> str:
    ports = dims.SERVICE_PORTS if catalog == "analysis" else dims.DISPLAY_PORTS[catalog]
    return "(values " + ", ".join(f"({p}, '{s}')" for p, s in ports.items()) + ")"


def service_join(catalog: str, missing: str) -> str:
    return f"""select packet_id, coalesce(s.service, '{missing}') as src_service, coalesce(d.service, '{missing}') as dst_service from packets
 left join {service_values(catalog)} s(port, service) on s.port = sport left join {service_values(catalog)} d(port, service) on d.port = dport"""


@query("j3_services", over(service_join("analysis", "unknown"), "packets"))
def _(spark, sf):
    return T.with_services(V.packets(spark, sf)).select("packet_id", "src_service", "dst_service")


for _catalog in ("overview", "dashboard"):

    @query(f"j4_display_services_{_catalog}", over(service_join(_catalog, "Unknown"), "packets"))
    def _(spark, sf, catalog=_catalog):
        return T.with_services(V.packets(spark, sf), catalog).select("packet_id", "src_service", "dst_service")


@query("j12_common_port", over(f"select packet_id, coalesce(sport in ({', '.join(map(str, dims.SERVICE_PORTS))}), false) or coalesce(dport in ({', '.join(map(str, dims.SERVICE_PORTS))}), false) as common_port from packets", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", H.uses_common_port(F.col("sport"), F.col("dport")).alias("common_port"))


def top_hosts_sql(column: str) -> str:
    return over(f"""select {column} as ip, count(*) as packets, case when {internal(column)} then 'Internal' else 'External' end as network
 from packets where {column} is not null group by {column} order by packets desc, {column} limit 10""", "packets")


@query("l5_top_sources", top_hosts_sql("src"))
def _(spark, sf):
    return T.top_hosts(V.packets(spark, sf), "src")


@query("l6_top_destinations", top_hosts_sql("dst"))
def _(spark, sf):
    return T.top_hosts(V.packets(spark, sf), "dst")


def top_ports_sql(n: int, catalog: str) -> str:
    return over(f"""select q.dport as port, coalesce(s.service, 'Unknown') as service, cast(q.dport as varchar) || coalesce(' (' || s.service || ')', '') as label, packets
 from (select dport, count(*) as packets from packets where coalesce(dport, 0) <> 0 group by 1 order by packets desc, dport limit {n}) q
 left join {service_values(catalog)} s(port, service) on s.port = q.dport""", "packets")


@query("l7_top_ports_dashboard", top_ports_sql(15, "dashboard"))
def _(spark, sf):
    return T.top_ports(V.packets(spark, sf), 15, "dashboard")


@query("l7_top_ports_overview", top_ports_sql(10, "overview"))
def _(spark, sf):
    return T.top_ports(V.packets(spark, sf), 10, "overview")


# --- graph, flows, sessions ---


@query("a13_edges", over(f"select src, dst, count(*) as packets, {MAL} as malicious_count, round({MAL} / cast(count(*) as double), 6) as malicious_ratio from packets where src is not null and dst is not null group by 1, 2", "packets"))
def _(spark, sf):
    return G.edges(V.packets(spark, sf)).withColumns(r6("malicious_ratio"))


@query(
    "a14_weighted_edges",
    over("""select src, dst, count(*) as weight, bool_or(is_malicious) as is_malicious, max(proto) filter (rn = 1) as protocol
 from (select *, row_number() over (partition by src, dst order by ts, proto) as rn from packets) q group by 1, 2""", "packets"),
)
def _(spark, sf):
    return G.weighted_edges(V.packets(spark, sf))


@query("a15_node_degree", over("select ip, count(*) as degree from (select src as ip from e union all select dst from e) q group by 1", "packets", e="select distinct src, dst from packets where src is not null and dst is not null"))
def _(spark, sf):
    return G.node_degree(V.packets(spark, sf))


@query("u1_nodes", over(f"select ip, case when {internal('ip')} then 'internal' else 'external' end as side from (select src as ip from packets union select dst from packets) q where ip is not null", "packets"))
def _(spark, sf):
    return G.nodes(V.packets(spark, sf))


@query(
    "a30_flow_rollup",
    over(f"select src, dst, sport, dport, proto, epoch_us(min(ts)) as flow_start, epoch_us(max(ts)) as flow_end, count(*) as flow_packets, {BYTES} as flow_bytes from packets group by 1, 2, 3, 4, 5", "packets"),
)
def _(spark, sf):
    return G.flow_rollup(V.packets(spark, sf)).withColumns({c: F.unix_micros(c) for c in ("flow_start", "flow_end")})


SESSION_SQL = """select endpoint_a, endpoint_b, min(t) as "start", max(t) as last_seen, count(*) as packets from
 (select *, sum(opens) over (partition by endpoint_a, endpoint_b order by t, packet_id) as session from
 (select *, case when t - lag(t) over (partition by endpoint_a, endpoint_b order by t, packet_id) <= {gap}000000 then 0 else 1 end as opens from
 (select least(a, b) as endpoint_a, greatest(a, b) as endpoint_b, epoch_us(ts) as t, packet_id from
 (select *, src || ':' || cast(sport as varchar) as a, dst || ':' || cast(dport as varchar) as b from packets
 where proto = 'tcp' and sport is not null and dport is not null) p) k) o) s group by endpoint_a, endpoint_b, session"""


@query("a31_tcp_sessions", over(SESSION_SQL.format(gap=300), "packets"))
def _(spark, sf):
    return S.tcp_sessions(V.packets(spark, sf)).withColumns({c: F.unix_micros(c) for c in ("start", "last_seen")})


@query("a31_tcp_sessions_six_hours", over(SESSION_SQL.format(gap=21600), "packets"))
def _(spark, sf):
    found = S.tcp_sessions(V.packets(spark, sf), gap_seconds=21600)
    return found.withColumns({c: F.unix_micros(c) for c in ("start", "last_seen")})


@query("u2_concatenate_histories", over("select packet_id, category from packet_alerts where severity = 'High' union all select packet_id, category from packet_alerts where severity <> 'High'", "packet_alerts"))
def _(spark, sf):
    a = V.described_alerts(spark, sf).select("packet_id", "category", "severity")
    high, rest = a.filter("severity = 'High'"), a.filter("severity <> 'High'")
    return high.unionByName(rest).drop("severity")


@query("u3_distinct_rows", "select distinct l_partkey % 50 as part_group, l_linenumber, l_returnflag, l_linestatus from lineitem")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("part_group"), "l_linenumber", "l_returnflag", "l_linestatus")
    return rows.dropDuplicates()


@query("t5_counters_batch", over("select 'protocol' as dimension, proto as value, count(*) as packets from packets group by 2 union all select 'source', src, count(*) from packets group by 2 union all select 'destination', dst, count(*) from packets group by 2 union all select 'port', cast(dport as varchar), count(*) from packets where dport is not null group by 2", "packets"))
def _(spark, sf):
    hours = jobs.running_counters(V.packets(spark, sf))
    return hours.groupBy("dimension", "value").agg(F.sum("packets").alias("packets"))
