"""Projections and filters on packets: normalising, cleaning, header features, display expressions."""

from pyspark.sql import functions as F

from trafficlens import dims, schema
from trafficlens.functions import address as AD
from trafficlens.functions import header as H
from trafficlens.functions import rules as R
from trafficlens.functions import text as X
from trafficlens.functions import vectors
from trafficlens.operators import networks as NW
from trafficlens.operators import alerts as A
from trafficlens.operators import features as FE
from trafficlens.operators import normalize as N
from trafficlens.operators import traffic as T
from trafficlens.plans.oracle import DESCRIPTION, SEVERITY, over, time_text
from trafficlens.plans.registry import query
from trafficlens.sources import views as V

HTTP_SQL = "'GET / HTTP/1.1' || chr(13) || chr(10) || 'Host: example.com' || chr(13) || chr(10) || chr(13) || chr(10)"


def r6(*columns):
    return {c: F.round(F.col(f"`{c}`"), 6) for c in columns}


# --- normalising ---


@query(
    "p1_normalise_packets",
    over(f"""select packet_id, {time_text('ts')} as ts, coalesce(src, '192.168.1.1') as src, coalesce(dst, '192.168.1.2') as dst, proto,
 coalesce(sport, 1024) as sport, coalesce(dport, 80) as dport, coalesce(flags, case when proto = 'tcp' then 16 else 0 end) as flags, len, ttl,
 coalesce(payload, case when coalesce(dport, 80) = 80 then {HTTP_SQL} when dport = 53 then 'dns' else 'test_payload' end) as payload, is_malicious from packets""", "packets"),
)
def _(spark, sf):
    out = N.normalize_packets(V.raw_flows(spark, sf), keep=("packet_id",))
    # The binary DNS default is shown as text: SQL text columns cannot hold it everywhere.
    payload = F.when(F.col("payload") == N.DNS_PAYLOAD, "dns").otherwise(F.col("payload"))
    return out.withColumns({"ts": X.time_text(F.col("ts")), "payload": payload})


@query(
    "p1_normalise_sparse_columns",
    over("""select packet_id, coalesce(src, '192.168.1.1') as src, '192.168.1.2' as dst, 'tcp' as proto, 1024 as sport, 80 as dport, 16 as flags,
 len, 64 as ttl, false as is_malicious from packets""", "packets"),
)
def _(spark, sf):
    raw = V.packets(spark, sf).select("packet_id", "src", F.col("len").alias("packet_length"))
    return N.normalize_packets(raw, keep=("packet_id",)).drop("ts", "payload")


@query(
    "p2_default_payload",
    over("""select packet_id, case when p = 80 then '474554202F20485454502F312E310D0A486F73743A206578616D706C652E636F6D0D0A0D0A'
 when p = 53 then '000100000001000000000000' else '746573745F7061796C6F6164' end as payload_hex from (select packet_id, coalesce(dport, 80) as p from packets) q""", "packets"),
)
def _(spark, sf):
    out = N.normalize_packets(V.raw_flows(spark, sf).drop("payload"), keep=("packet_id",))
    return out.select("packet_id", F.hex(F.encode("payload", "UTF-8")).alias("payload_hex"))


@query("p3_truth_from_label", over("select packet_id, is_malicious from packets", "packets"))
def _(spark, sf):
    raw = V.raw_flows(spark, sf)
    return raw.select("packet_id", N.truth_flag(raw).alias("is_malicious"))


@query("p3_truth_from_number", "select event_id as packet_id, value > 100 as is_malicious from events")
def _(spark, sf):
    raw = V.table(spark, sf, "events").select(F.col("event_id").alias("packet_id"), (F.col("value") > 100).cast("int").alias("is_attack"))
    return raw.select("packet_id", N.truth_flag(raw).alias("is_malicious"))


def _typed_events(spark, sf):
    kind = F.when(F.col("event_type") == "view", "Benign").otherwise(F.col("event_type"))
    return V.table(spark, sf, "events").select("event_id", "value", kind.alias("attack_type"), (F.col("value") > 100).alias("is_attack"))


TYPED = "select event_id, value, case event_type when 'view' then 'Benign' else event_type end as attack_type, value > 100 as is_attack from events"


@query("p4_pick_target", f"select attack_type as target, count(*) as n from ({TYPED}) q group by 1")
def _(spark, sf):
    df = _typed_events(spark, sf)
    return df.groupBy(F.col(N.pick_target(df)).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_binarise_many_values", f"select event_id, case when lower(attack_type) = 'benign' then 0 else 1 end as attack_type from ({TYPED}) q")
def _(spark, sf):
    return N.binarise_target(_typed_events(spark, sf).select("event_id", "attack_type"), "attack_type")


@query("p5_binarise_two_values", "select o_orderkey, case when o_totalprice > 200000 then 1 else 0 end as size_class from orders")
def _(spark, sf):
    size = F.when(F.col("o_totalprice") > 200000, "large").otherwise("benign")
    rows = V.table(spark, sf, "orders").select("o_orderkey", size.alias("size_class"))
    return N.binarise_target(rows, "size_class")


@query("p6_split_features", "select event_id, value from events")
def _(spark, sf):
    features, _target = N.split_features(_typed_events(spark, sf).drop("is_attack"), "attack_type")
    return features


FLOW_STATS = {
    "Average Packet Size": "len * 1.0e0", "Flow Bytes/s": "len / (ttl * 1.0e0)", "Max Packet Length": "len * 2.0e0",
    "Fwd Packet Length Mean": "len / 2.0e0", "Fwd IAT Min": "ttl * 1.0e0", "Total Length of Fwd Packets": "len + ttl * 1.0e0",
    "Flow IAT Mean": "ttl * 2.0e0", "Fwd Packet Length Max": "len + 1.0e0", "Fwd IAT Std": "ttl / 2.0e0", "Fwd Header Length": "20.0e0",
}
FLOW_SQL = ", ".join(f'round({e}, 6) as "{n}"' for n, e in FLOW_STATS.items())
FLOW_LABEL = "case when is_malicious then 'Web Attack' else 'BENIGN' end as \"Label\""


@query("p7_drop_identifiers", over(f"select {FLOW_SQL}, {FLOW_LABEL} from packets", "packets"))
def _(spark, sf):
    return N.drop_identifiers(V.flow_features(spark, sf)).withColumns(r6(*FLOW_STATS))


@query("p8_numeric_columns", over(f'select sport as "Source Port", dport as "Destination Port", {FLOW_SQL} from packets', "packets"))
def _(spark, sf):
    df = V.flow_features(spark, sf)
    return df.select(*[F.col(f"`{c}`") for c in N.numeric_columns(df)]).withColumns(r6(*FLOW_STATS))


@query(
    "p9_categorical_columns",
    over(f"""select concat_ws('-', src, dst, cast(sport as varchar), cast(dport as varchar), proto) as "Flow ID", src as "Source IP", dst as "Destination IP", proto as "Protocol", {FLOW_LABEL} from packets""", "packets"),
)
def _(spark, sf):
    df = V.flow_features(spark, sf)
    return df.select(*[F.col(f"`{c}`") for c in N.categorical_columns(df)])


@query("p19_selected_features", over(f"select {FLOW_SQL} from packets", "packets"))
def _(spark, sf):
    return N.select_flow_features(V.flow_features(spark, sf)).withColumns(r6(*FLOW_STATS))


def _dirty(spark, sf):
    """Line items with an infinite value where there is no tax and no value where there is no discount."""
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(tax == 0, float("inf")).when(tax == 0.01, float("-inf")).otherwise(tax).alias("tax"),
        F.when(discount != 0, discount).alias("discount"),
    )


@query("p10_infinite_to_null", "select l_orderkey, l_linenumber, case when l_tax = 0 or l_tax = 0.01 then null else l_tax end as tax, nullif(l_discount, 0) as discount from lineitem")
def _(spark, sf):
    return N.infinite_to_null(_dirty(spark, sf))


@query("p11_drop_incomplete", "select l_orderkey, l_linenumber, l_tax as tax, l_discount as discount from lineitem where l_tax <> 0 and l_tax <> 0.01 and l_discount <> 0")
def _(spark, sf):
    return N.drop_incomplete(N.infinite_to_null(_dirty(spark, sf)))


@query("p12_has_nulls", "select bool_or(l_discount = 0) as has_nulls from lineitem")
def _(spark, sf):
    return N.has_nulls(_dirty(spark, sf))


# --- header features ---

PRIVATE_SQL = """case when not regexp_full_match({c}, '\\d+\\.\\d+\\.\\d+\\.\\d+') or {c} is null then 0.0
 when starts_with({c}, '192.168.') or starts_with({c}, '203.0.113.') or starts_with({c}, '172.16.') or starts_with({c}, '10.') then 0.0 else 1.0 end"""


@query("h1_h2_public_addresses", over(f"select packet_id, cast({PRIVATE_SQL.format(c='src')} as double) as source_ip_public, cast({PRIVATE_SQL.format(c='dst')} as double) as dest_ip_public from packets", "packets"))
def _(spark, sf):
    return FE.header_features(V.packets(spark, sf)).select("packet_id", "source_ip_public", "dest_ip_public")


IP_NUMBER = "(cast(split_part({c}, '.', 1) as bigint) * 16777216 + cast(split_part({c}, '.', 2) as bigint) * 65536 + cast(split_part({c}, '.', 3) as bigint) * 256 + cast(split_part({c}, '.', 4) as bigint))"
NETWORKS = "(values (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295))"


@query(
    "j11_private_ranges",
    over(f"""select packet_id, s.lo is not null as src_private, d.lo is not null as dst_private from
 (select packet_id, {IP_NUMBER.format(c='src')} as sn, {IP_NUMBER.format(c='dst')} as dn from packets) q
 left join {NETWORKS} s(lo, hi) on sn between s.lo and s.hi left join {NETWORKS} d(lo, hi) on dn between d.lo and d.hi""", "packets"),
)
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", AD.is_private(F.col("src")).alias("src_private"), AD.is_private(F.col("dst")).alias("dst_private"))


NETWORK_TABLE = """select *, 8 + k % 25 as p, case k % 5 when 0 then 3232235776 when 1 then 3405803776 when 2 then 134744064 when 3 then 2886729984 else 16843008 end + k * 7919 % 512 as n
 from (select o_orderkey as k, lpad(cast(o_orderkey as varchar), 9, '0') as label from orders) o"""


@query(
    "j11_networks_from_a_table",
    over("""select packet_id, label as src_network, p as src_bits from packets left join (select src, label, p, row_number() over (partition by src order by p desc, label) as r from
 (select *, sn // pow2 as net from seen, widths) q join nets using (p, net)) x on x.src = packets.src and r = 1""", "packets",
         seen=f"select src, {IP_NUMBER.format(c='src')} as sn from (select distinct src from packets) d",
         widths="select p, cast(pow(2, 32 - p) as bigint) as pow2 from (select unnest(range(8, 33)) as p) w",
         nets=f"select p, n // cast(pow(2, 32 - p) as bigint) as net, min(label) as label from ({NETWORK_TABLE}) t group by 1, 2"),
)
def _(spark, sf):
    """A network per order (15,000 at scale 0.01) of 8 to 32 bits, overlapping each other."""
    k = F.col("o_orderkey")
    base = F.when(k % 5 == 0, 3232235776).when(k % 5 == 1, 3405803776).when(k % 5 == 2, 134744064).when(k % 5 == 3, 2886729984).otherwise(16843008).cast("bigint")
    n = base + k * 7919 % 512
    text = F.concat_ws(".", *[(F.floor(n / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])
    table = V.table(spark, sf, "orders").select(F.concat(text, F.lit("/"), (8 + k % 25).cast("string")).alias("network"), F.lpad(k.cast("string"), 9, "0").alias("label"))
    found = NW.lookup(V.packets(spark, sf).select("packet_id", "src"), "src", table)
    return found.select("packet_id", F.col("network_label").alias("src_network"), F.col("network_bits").cast("bigint").alias("src_bits"))


@query(
    "j11_networks_from_a_table_v6",
    """select event_id, label, p as bits from events left join (select x, label, p, row_number() over (partition by x order by p desc, label) as r from
 (select x, p, x >> cast(64 - p as integer) as net from (select distinct user_id * 61 % 65536 as x from events) e, (select unnest(range(50, 65)) as p) w) q join
 (select p, (o_orderkey * 37 % 65536) >> cast(64 - p as integer) as net, min(lpad(cast(o_orderkey as varchar), 9, '0')) as label from (select *, 50 + o_orderkey % 15 as p from orders) o group by 1, 2) n using (p, net)) f
 on x = user_id * 61 % 65536 and r = 1""",
)
def _(spark, sf):
    """The same for IPv6, 50 to 64 bits."""
    k = F.col("o_orderkey")
    group = lambda c: F.lower(F.hex(c))
    table = V.table(spark, sf, "orders").select(
        F.concat(F.lit("2001:DB8:0:"), group(k * 37 % 65536), F.lit("::/"), (50 + k % 15).cast("string")).alias("network"), F.lpad(k.cast("string"), 9, "0").alias("label")
    )
    events = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("2001:db8::"), group(F.col("user_id") * 61 % 65536), F.lit(":0:0:1:"), (F.col("event_id") % 9).cast("string")).alias("ip"))
    found = NW.lookup(events, "ip", table, into="label", bits="bits")
    return found.select("event_id", "label", F.col("bits").cast("bigint").alias("bits"))


@query(
    "h3_h12_header_features",
    over(f"""select packet_id, round(least(coalesce(sport, 0) / 65535.0e0, 1), 6) as source_port_numeric, round(least(coalesce(dport, 0) / 65535.0e0, 1), 6) as dest_port_numeric,
 cast(lower(proto) = 'tcp' as double) as protocol_tcp, cast(lower(proto) = 'udp' as double) as protocol_udp, cast(lower(proto) = 'icmp' as double) as protocol_icmp,
 round(least(coalesce(len, 0) / 65535.0e0, 1), 6) as packet_size, round(case when lower(proto) = 'tcp' then coalesce(flags, 0) / 255.0e0 else 0 end, 6) as tcp_flags,
 0.0e0 as fragment, round(coalesce(ttl, 0) / 255.0e0, 6) as ttl,
 cast(coalesce(sport in ({', '.join(map(str, dims.SERVICE_PORTS))}), false) or coalesce(dport in ({', '.join(map(str, dims.SERVICE_PORTS))}), false) as double) as common_port from packets""", "packets"),
)
def _(spark, sf):
    f = FE.header_features(V.packets(spark, sf)).drop("source_ip_public", "dest_ip_public", *H.FLOW_FEATURES)
    return f.withColumns(r6(*[c for c in f.columns if c != "packet_id"]))


@query(
    "h13_h15_flow_features",
    over("""select packet_id, round(d / 3600.0, 6) as flow_duration, round(case when d > 0 then least(n / d / 1000.0, 1.0) else 0 end, 6) as packet_rate,
 round(least(case when d > 0 then b / d else b end / 1000000.0, 1.0), 6) as byte_rate from
 (select packet_id, least((epoch_us(max(ts) over w) - epoch_us(min(ts) over w)) / 1000000.0e0, 3600.0e0) as d, cast(count(*) over w as double) as n, cast(sum(len) over w as double) as b
 from packets window w as (partition by src, dst, sport, dport, proto)) q""", "packets"),
)
def _(spark, sf):
    f = FE.header_features(V.packets(spark, sf), with_flow=True).select("packet_id", *H.FLOW_FEATURES)
    return f.withColumns(r6(*H.FLOW_FEATURES))


# --- scalar functions on packets ---

FLAG_CASES = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
FLAG_SQL = "concat_ws({sep}, " + ", ".join(f"case when (f & {b}) <> 0 then '{n}' end" for n, b in FLAG_CASES.items()) + "{more})"


@query("f9_flag_names", over(f"select packet_id, {FLAG_SQL.format(sep=chr(39) + '|' + chr(39), more='')} as names from (select packet_id, coalesce(flags, 0) as f from packets) q", "packets"))
def _(spark, sf):
    names = H.flag_names(F.coalesce("flags", F.lit(0)))
    return V.packets(spark, sf).select("packet_id", F.array_join(names, "|").alias("names"))


@query(
    "f10_flag_text",
    over(f"""select packet_id, case when f is null then 'None' when n = '' then c else c || ' (' || n || ')' end as flag_text from
 (select packet_id, f, '0x' || lpad(lower(to_hex(f)), 2, '0') as c, {FLAG_SQL.format(sep=chr(39) + ', ' + chr(39), more=", case when (f & 64) <> 0 then 'ECE' end, case when (f & 128) <> 0 then 'CWR' end")} as n
 from (select packet_id, cast(case when flags is null then null else (flags + packet_id * 7) % 256 end as integer) as f from packets) p) q""", "packets"),
)
def _(spark, sf):
    flags = ((F.col("flags") + F.col("packet_id") * 7) % 256).cast("int")
    return V.packets(spark, sf).select("packet_id", H.flag_text(flags).alias("flag_text"))


@query("f11_icmp_and_window_defaults", over("select packet_id, case when proto = 'icmp' then 0 end as icmp_type, case when proto = 'icmp' then 0 end as icmp_code, case when proto = 'tcp' then 0 end as tcp_window from packets", "packets"))
def _(spark, sf):
    return FE.analyze_packets(V.packets(spark, sf)).select("packet_id", "icmp_type", "icmp_code", "tcp_window")


HUMAN_SQL = """case when b = 0 then '0 B' when b < 1024 then cast(round_even(b, 2) as varchar) || ' B' when b < 1048576 then cast(round_even(b / 1024, 2) as varchar) || ' KB'
 when b < 1073741824 then cast(round_even(b / 1048576, 2) as varchar) || ' MB' when b < 1099511627776 then cast(round_even(b / 1073741824, 2) as varchar) || ' GB'
 when b < 1125899906842624 or {tb} then cast(round_even(b / 1099511627776, 2) as varchar) || ' TB' else cast(round_even(b / 1125899906842624, 2) as varchar) || ' PB' end"""
SIZES = "select src, cast(sum(len) * (case when src like '8.8%' then 1 when src like '172%' then 1000000 when src like '203%' then 100000000000 else 3333 end) as double) as b from packets group by src"


@query("f12_human_bytes", over(f"select src, {HUMAN_SQL.format(tb='true')} as total, {HUMAN_SQL.format(tb='false')} as total_wide from sizes", "packets", sizes=SIZES))
def _(spark, sf):
    src = F.col("src")
    factor = F.when(src.startswith("8.8"), 1).when(src.startswith("172"), 1000000).when(src.startswith("203"), 100000000000).otherwise(3333)
    sizes = V.packets(spark, sf).groupBy("src").agg((F.sum("len").cast("double")).alias("n")).select("src", (F.col("n") * factor).alias("b"))
    wide = ("B", "KB", "MB", "GB", "TB", "PB")
    return sizes.select("src", X.human_bytes(F.col("b")).alias("total"), X.human_bytes(F.col("b"), wide).alias("total_wide"))


@query("f13_host_zone", over("select packet_id, case when src like '192.168.%' then 'internal' when src like '172.16.%' then 'dmz' else 'external' end as src_zone, case when dst like '192.168.%' or dst like '10.%' or dst like '172.16.%' then 'internal' else 'external' end as dst_side from packets", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", AD.host_zone(F.col("src")).alias("src_zone"), AD.host_side(F.col("dst")).alias("dst_side"))


@query("f14_parse_timestamp", "select event_id, epoch_us(ts) as parsed_iso, epoch_us(ts) as parsed_plain from events")
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ts = F.col("ts").cast("timestamp")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    plain = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return V.table(spark, sf, "events").select(
        "event_id", F.unix_micros(X.parse_timestamp(iso)).alias("parsed_iso"), F.unix_micros(X.parse_timestamp(plain)).alias("parsed_plain")
    )


@query("f15_clock_text", over("select packet_id, strftime(ts, '%H:%M:%S') as clock, left(strftime(ts, '%H:%M:%S.%f'), 12) as clock_millis from packets", "packets"))
def _(spark, sf):
    ts = F.col("ts")
    return V.packets(spark, sf).select("packet_id", X.clock(ts).alias("clock"), X.clock(ts, millis=True).alias("clock_millis"))


@query("f16_time_floor", over(f"select packet_id, {time_text('date_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)')} as one_minute, strftime(time_bucket(interval '10 minutes', ts), '%Y-%m-%d %H:%M:%S') as ten_minutes from packets", "packets"))
def _(spark, sf):
    ts = F.col("ts")
    p = V.packets(spark, sf).select("packet_id", X.minute(ts).alias("m"), X.bin_start(ts, "10 minutes").alias("t"))
    return p.select("packet_id", X.time_text(F.col("m")).alias("one_minute"), X.time_text(F.col("t")).alias("ten_minutes"))


@query("f17_time_band", over("select band, count(*) as packets from (select case when hour(ts) >= 8 and hour(ts) < 18 then 'working_hours' when hour(ts) >= 18 and hour(ts) < 23 then 'after_hours' else 'night' end as band from packets) q group by 1", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).groupBy(X.time_band(F.col("ts")).alias("band")).agg(F.count(F.lit(1)).alias("packets"))


@query(
    "f18_packet_json",
    over("""select packet_id as id, packet_id, epoch_us(ts) as ts, src, dst, proto, sport, dport, flags, len, ttl, packet_id % 3 = 0 as frag,
 cast(packet_id % 5 as integer) as icmp_type, cast(packet_id % 7 as integer) as icmp_code, payload, is_malicious from packets""", "packets"),
)
def _(spark, sf):
    k = F.col("packet_id")
    packets = V.scored_packets(spark, sf).withColumns({"frag": k % 3 == 0, "icmp_type": (k % 5).cast("int"), "icmp_code": (k % 7).cast("int")})
    back = F.from_json("packet_data", schema.ddl(schema.PACKET))
    return A.detections_from(packets).select("id", back.alias("p")).select("id", "p.*").withColumn("ts", F.unix_micros("ts"))


@query("h10_fragment_flag", over("select packet_id, case packet_id % 3 when 1 then 1.0e0 else 0.0e0 end as fragment from packets", "packets"))
def _(spark, sf):
    k = F.col("packet_id") % 3
    packets = V.packets(spark, sf).withColumn("frag", F.when(k == 0, False).when(k == 1, True))
    return packets.select("packet_id", H.HEADER_FEATURES["fragment"]().alias("fragment"))


@query("f3_binary_content_type", over("select packet_id, case packet_id % 3 when 0 then 'binary' when 1 then 'text' else 'unknown' end as content_type from packets", "packets"))
def _(spark, sf):
    """Payloads of control bytes, of words and of nothing."""
    k = F.col("packet_id")
    payload = F.when(k % 3 == 0, F.concat(F.lit("\x01\x02\x03\x04\x05\x06"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("plain words "), k.cast("string"))).otherwise("")
    packets = V.packets(spark, sf).select("packet_id", F.when(k % 3 == 0, F.lit("\x01\x02\x03\x04\x05\x06")).otherwise(payload).alias("payload"))
    return FE.payload_analysis(packets).select("packet_id", "content_type")


@query("f19_attack_description", over(f"select packet_id, {DESCRIPTION} as description from packets", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", R.packet_attack_description().alias("description"))


@query("f20_attack_category", over("select id, category from packet_alerts", "packet_alerts"))
def _(spark, sf):
    return V.described_alerts(spark, sf).select("id", "category")


@query("f21_severity", over(f"select id, {SEVERITY} as severity from detections", "detections"))
def _(spark, sf):
    return V.detections(spark, sf).select("id", R.severity(F.col("confidence")).alias("severity"))


@query("f22_decision", over("select id, confidence > 0.5 as decision from detections", "detections"))
def _(spark, sf):
    return V.detections(spark, sf).select("id", R.is_malicious_score(F.col("confidence")).alias("decision"))


RISKS = """case when not is_malicious then 'No malicious patterns detected' else coalesce(nullif(concat_ws('|',
 case when contains(payload, '<script>') or contains(payload, 'onerror=') then 'XSS attack detected' end,
 case when contains(payload, chr(39)) and (contains(upper(payload), 'SELECT') or contains(upper(payload), 'UNION')) then 'SQL Injection attempt detected' end,
 case when contains(payload, '--') or (contains(payload, ';') and (contains(upper(payload), 'DROP') or contains(upper(payload), 'UPDATE'))) then 'SQL command injection detected' end,
 case when contains(payload, '..') and (contains(payload, '/') or contains(payload, chr(92))) then 'Directory traversal attempt detected' end,
 case when contains(lower(payload), 'passwd') or contains(lower(payload), 'shadow') then 'Sensitive file access attempt' end), ''), 'Suspicious traffic pattern detected') end"""


@query("f23_risk", over(f"select packet_id, case when payload is not null then {RISKS} end as flags, case when payload is not null then case when is_malicious then 'High' else 'Low' end end as level from packets", "packets"))
def _(spark, sf):
    payload, bad = F.col("payload"), F.col("is_malicious")
    return V.packets(spark, sf).select(
        "packet_id", F.array_join(R.risk_flags(payload, bad), "|").alias("flags"), R.risk_level(payload, bad).alias("level")
    )


ATTACK_TYPE = "case category when 'Port Scan' then 'port_scan' when 'Brute Force' then 'brute_force' when 'DDoS' then 'ddos' when 'Data Exfiltration' then 'data_exfiltration' when 'C&C Communication' then 'malware_communication' end"


@query(
    "f24_attack_catalogue",
    over(f"""select a.id, c.name as attack_name, c.severity as catalogue_severity, c.duration as duration_s from (select id, {ATTACK_TYPE} as t from packet_alerts) a
 join (values ('port_scan', 'Port Scan', 'Medium', 15), ('brute_force', 'Brute Force Attack', 'High', 20), ('ddos', 'DDoS Attack', 'Critical', 30),
 ('data_exfiltration', 'Data Exfiltration', 'High', 25), ('malware_communication', 'Malware Command & Control', 'Critical', 40)) c(t, name, severity, duration) on c.t = a.t""", "packet_alerts"),
)
def _(spark, sf):
    category = F.col("category")
    kind = (
        F.when(category == "Port Scan", "port_scan").when(category == "Brute Force", "brute_force").when(category == "DDoS", "ddos")
        .when(category == "Data Exfiltration", "data_exfiltration").when(category == "C&C Communication", "malware_communication")
    )
    catalogue = dims.attack_catalogue(spark).withColumnRenamed("severity", "catalogue_severity")
    alerts = V.described_alerts(spark, sf).select("id", kind.alias("attack_type"))
    return alerts.join(F.broadcast(catalogue), "attack_type").drop("attack_type")


@query("f25_direction", over("select packet_id, case when src like '192.168.%' or src like '10.%' or src like '172.16.%' then 'internal' else 'external' end || '_to_' || case when dst like '192.168.%' or dst like '10.%' or dst like '172.16.%' then 'internal' else 'external' end as direction from packets", "packets"))
def _(spark, sf):
    return V.packets(spark, sf).select("packet_id", AD.direction(F.col("src"), F.col("dst")).alias("direction"))


@query("f29_defaults", over("select packet_id, coalesce(src, 'unknown') as src, coalesce(dst, 'unknown') as dst, coalesce(proto, 'unknown') as proto, coalesce(sport, 0) as sport, coalesce(dport, 0) as dport, coalesce(len, 0) as len from packets", "packets"))
def _(spark, sf):
    return N.with_defaults(V.packets(spark, sf)).select("packet_id", "src", "dst", "proto", "sport", "dport", "len")


@query("f30_alert_id", over("select id as detection_id, sha256(cast(id as varchar) || ':score') as alert_id from detections", "detections"))
def _(spark, sf):
    return V.detections(spark, sf).select(F.col("id").alias("detection_id"), R.alert_id(F.col("id")).alias("alert_id"))


@query(
    "f32_protocol_names",
    over("""select packet_id, n.name as protocol_name from (select packet_id, case proto when 'icmp' then 1 when 'tcp' then 6 when 'udp' then 17 end + packet_id % 2 * 41 as num from packets) q
 left join (values (1, 'icmp'), (6, 'tcp'), (17, 'udp'), (47, 'gre'), (50, 'esp'), (51, 'ah'), (58, 'ipv6-icmp'), (89, 'ospf'), (132, 'sctp')) n(num, name) on n.num = q.num""", "packets"),
)
def _(spark, sf):
    proto = F.col("proto")
    number = F.when(proto == "icmp", 1).when(proto == "tcp", 6).when(proto == "udp", 17) + F.col("packet_id") % 2 * 41
    return T.with_protocol_name(V.packets(spark, sf).select("packet_id", number.alias("n")), "n").drop("n")


# --- vectors ---


@query("f7_fit_width", "select vec_id, 76 as width, round(list_sum(embedding[1:76]), 4) as total from embeddings")
def _(spark, sf):
    v = V.table(spark, sf, "embeddings").select("vec_id", vectors.fit_width(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return v.select("vec_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("f8_argmax", "select vec_id, list_position(embedding, list_max(embedding)) - 1 as best from embeddings")
def _(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("best"))


# --- packet views ---


@query(
    "p21_packet_listing",
    over("""select packet_id, left(strftime(ts, '%H:%M:%S.%f'), 12) as "time", src as source, dst as destination, upper(proto) as protocol, len as length,
 coalesce('0x' || lower(to_hex(flags)), '-') as flags, coalesce(cast(sport as varchar), '-') as src_port, coalesce(cast(dport as varchar), '-') as dst_port,
 case when is_malicious then 'Malicious' else 'Benign' end as status from packets""", "packets"),
)
def _(spark, sf):
    return A.packet_listing(V.packets(spark, sf))


@query(
    "p22_header_view",
    over(f"""select packet_id, {time_text('ts')} as "timestamp", src as source_ip, dst as destination_ip, upper(proto) as protocol, cast(len as varchar) || ' bytes' as length,
 case when proto in ('tcp', 'udp') then coalesce(cast(sport as varchar), '-') end as source_port, case when proto in ('tcp', 'udp') then coalesce(cast(dport as varchar), '-') end as destination_port,
 case when proto = 'tcp' then case coalesce(flags, 0) when 2 then '0x02 (SYN)' when 16 then '0x10 (ACK)' when 24 then '0x18 (PSH, ACK)' else '0x00' end end as tcp_flags,
 case when proto = 'icmp' then '-' end as icmp_type, case when proto = 'icmp' then '-' end as icmp_code from packets""", "packets"),
)
def _(spark, sf):
    return A.header_view(V.packets(spark, sf))
