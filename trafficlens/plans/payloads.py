"""Payload inspection and feature vectors."""

from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import header as H
from trafficlens.functions import payload as P
from trafficlens.functions import text as X
from trafficlens.operators import features as FE
from trafficlens.operators import signatures as SG
from trafficlens.plans.oracle import over, time_text
from trafficlens.plans.projections import PRIVATE_SQL, r6
from trafficlens.plans.registry import query
from trafficlens.plans.traffic import service_values
from trafficlens.sources import views as V

# Counts of every byte of every text, as SQL: the hexadecimal form cut into pairs.
BYTE_COUNTS = "select k, b, count(*) as n from (select {key} as k, unnest(regexp_extract_all(hex(encode({col})), '..')) as b from {table} where {col} <> '') q group by 1, 2"
ENTROPY = """select k, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy,
 round(cast(sum(n) filter (b between '20' and '7E') as double) / sum(n), 6) as printable_ratio, cast(sum(n) as bigint) as payload_size from counts group by 1"""


def counts_of(table: str, key: str, col: str) -> str:
    return BYTE_COUNTS.format(table=table, key=key, col=col)


def payload_sql(name: str, pattern: str, column: str = "payload") -> str:
    """Signature or content test in RE2 syntax."""
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def signature_sql(name: str, column: str = "payload") -> str:
    flags = "is" if name in dims.MULTILINE_SIGNATURES else "i"
    return f"coalesce({payload_sql(name, f'(?{flags})' + dims.ATTACK_SIGNATURES[name].replace(chr(92) + 'Z', chr(92) + 'z'), column)}, false)"


def content_sql(column: str, printable: str) -> str:
    tests = " ".join(f"when {payload_sql(n, f'(?{f})' + p, column)} then '{n}'" for n, (f, p) in dims.CONTENT_PATTERNS.items())
    return f"case when coalesce({column}, '') = '' then 'unknown' {tests} when {printable} > 0.8 then 'text' else 'binary' end"


PACKET_COUNTS = counts_of("packets", "packet_id", "payload")


@query("f2_payload_size", "select doc_id, cast(strlen(text) as integer) as payload_size from documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.octet_length(P.payload_bytes(F.col("text"))).alias("payload_size"))


@query(
    "a25_a26_payload_statistics",
    over(f"select packet_id, coalesce(entropy, 0) as entropy, coalesce(printable_ratio, 0) as printable_ratio, coalesce(payload_size, 0) as payload_size from packets left join ({ENTROPY}) e on e.k = packet_id", "packets", counts=PACKET_COUNTS),
)
def _(spark, sf):
    a = FE.payload_analysis(V.spread(V.packets(spark, sf))).select("packet_id", "entropy", "printable_ratio", F.col("payload_size").cast("bigint"))
    # A constant payload has entropy 0, never -0.
    return a.withColumns(r6("entropy", "printable_ratio")).withColumn("entropy", F.col("entropy") + 0.0)


@query(
    "a25_a26_document_statistics",
    over(f"select doc_id, coalesce(entropy, 0) as entropy, coalesce(printable_ratio, 0) as printable_ratio, coalesce(payload_size, 0) as payload_size from documents left join ({ENTROPY}) e on e.k = doc_id", counts=counts_of("documents", "doc_id", "text")),
)
def _(spark, sf):
    a = FE.payload_analysis(V.spread(V.table(spark, sf, "documents")), "text", "doc_id")
    out = a.select("doc_id", "entropy", "printable_ratio", F.col("payload_size").cast("bigint"))
    return out.withColumns(r6("entropy", "printable_ratio")).withColumn("entropy", F.col("entropy") + 0.0)


@query(
    "a27_byte_frequency",
    over("""select k as packet_id, '0x' || lower(ltrim(b, '0')) as byte, round(n / cast(total as double), 6) as share from
 (select *, sum(n) over (partition by k) as total, row_number() over (partition by k order by n desc, b) as rn from counts) q where rn <= 10""", "packets", counts=PACKET_COUNTS),
)
def _(spark, sf):
    a = FE.payload_analysis(V.spread(V.packets(spark, sf)))
    rows = a.select("packet_id", F.explode_outer("byte_frequency").alias("byte", "share")).filter("byte is not null")
    return rows.withColumns(r6("share"))


@query("f3_content_type", over(f"select packet_id, {content_sql('payload', '1.0')} as content_type from packets", "packets"))
def _(spark, sf):
    return FE.payload_analysis(V.spread(V.packets(spark, sf))).select("packet_id", "content_type")


@query("f3_page_content_type", f"select page_id, {content_sql('html', '1.0')} as content_type from pages")
def _(spark, sf):
    return FE.payload_analysis(V.spread(V.table(spark, sf, "pages")), "html", "page_id").select("page_id", "content_type")


FLAG_SELECT = ", ".join(f"{signature_sql(n)} as {n}" for n in dims.ATTACK_SIGNATURES)


@query("f4_signature_flags", over(f"select packet_id, {FLAG_SELECT} from packets", "packets"))
def _(spark, sf):
    parts = V.spread(V.packets(spark, sf)).select("packet_id", P.payload_text(F.col("payload")).alias("t"))
    return parts.select("packet_id", *[c.alias(n) for n, c in P.signature_flags(F.lower("t")).items()])


@query("f4_document_signature_flags", "select doc_id, " + ", ".join(f"{signature_sql(n, 'text')} as {n}" for n in dims.ATTACK_SIGNATURES) + " from documents")
def _(spark, sf):
    parts = V.spread(V.table(spark, sf, "documents")).select("doc_id", P.payload_text(F.col("text")).alias("t"))
    return parts.select("doc_id", *[c.alias(n) for n, c in P.signature_flags(F.lower("t")).items()])


PARTS = f"""select packet_id, payload is not null as has, coalesce(entropy, 0) as entropy, coalesce(printable_ratio, 0) as printable_ratio,
 coalesce(payload_size, 0) as payload_size, {content_sql('payload', '1.0')} as kind, {FLAG_SELECT} from packets left join ({ENTROPY}) e on e.k = packet_id"""
PAYLOAD_VALUES = ", ".join(
    ["entropy", "printable_ratio", "cast(payload_size as double) as payload_size", "cast(" + " + ".join(f"cast({n} as int)" for n in dims.ATTACK_SIGNATURES) + " as double) as signature_hits"]
    + [f"cast({n} as double) as {n}" for n in dims.ATTACK_SIGNATURES]
    + [f"cast(kind = '{n}' as double) as content_{n}" for n in dims.CONTENT_PATTERNS]
)


@query("f5_payload_features", over(f"select packet_id, {PAYLOAD_VALUES} from parts", "packets", counts=PACKET_COUNTS, parts=PARTS))
def _(spark, sf):
    v = FE.feature_vectors(V.spread(V.packets(spark, sf)))
    names = list(enumerate(FE.FEATURE_NAMES))[15:]
    return v.select("packet_id", *[(F.round(F.col("features")[i], 6) + 0.0).alias(n) for i, n in names])


COMMON = ", ".join(map(str, dims.SERVICE_PORTS))
HEADER_VALUES = f"""{PRIVATE_SQL.format(c='src')} as source_ip_public, {PRIVATE_SQL.format(c='dst')} as dest_ip_public,
 least(coalesce(sport, 0) / 65535.0e0, 1) as source_port_numeric, least(coalesce(dport, 0) / 65535.0e0, 1) as dest_port_numeric,
 cast(proto = 'tcp' as double) as protocol_tcp, cast(proto = 'udp' as double) as protocol_udp, cast(proto = 'icmp' as double) as protocol_icmp,
 least(len / 65535.0e0, 1) as packet_size, case when proto = 'tcp' then coalesce(flags, 0) / 255.0e0 else 0 end as tcp_flags, 0.0e0 as fragment,
 ttl / 255.0e0 as ttl, cast(coalesce(sport in ({COMMON}), false) or coalesce(dport in ({COMMON}), false) as double) as common_port,
 0.0e0 as flow_duration, 0.0e0 as packet_rate, least(len / 1000000.0e0, 1) as byte_rate"""
VECTOR_TABLES = {
    "counts": PACKET_COUNTS, "parts": PARTS, "head": f"select packet_id, {HEADER_VALUES} from packets",
    "tail": f"select packet_id, {PAYLOAD_VALUES} from parts",
    "vectors": "select head.packet_id, [" + ", ".join(f"round(cast({n} as double), 6)" for n in FE.FEATURE_NAMES) + "] as v from head join tail on head.packet_id = tail.packet_id",
}


@query("f6_feature_vector", over("select packet_id, cast(len(v) as integer) as width, " + ", ".join(f"v[{i + 1}] as f{i}" for i in range(35)) + " from vectors", "packets", **VECTOR_TABLES))
def _(spark, sf):
    v = FE.feature_vectors(V.spread(V.packets(spark, sf)))
    return v.select("packet_id", F.size("features").alias("width"), *[(F.round(F.col("features")[i], 6) + 0.0).alias(f"f{i}") for i in range(35)])


@query(
    "f27_feature_table",
    over("select packet_id, cast(p as integer) as position, [" + ", ".join(f"'{n}'" for n in FE.FEATURE_NAMES) + "][p + 1] as feature, v[p + 1] as value from vectors, range(35) r(p)", "packets", **VECTOR_TABLES),
)
def _(spark, sf):
    t = FE.feature_table(FE.feature_vectors(V.spread(V.packets(spark, sf))))
    return t.withColumn("value", F.round("value", 6) + 0.0)


@query("x3_inspection_off", over("select packet_id, 0.0e0 as payload_total, 35 as width from packets", "packets"))
def _(spark, sf):
    v = FE.feature_vectors(V.spread(V.packets(spark, sf)), dpi=False)
    total = F.aggregate(F.slice("features", 16, 20), F.lit(0.0), lambda a, x: a + F.abs(x))
    return v.select("packet_id", total.alias("payload_total"), F.size("features").alias("width"))


SIG_NAMES = ", ".join(f"case when {n} then '{n}' end" for n in dims.ATTACK_SIGNATURES)


@query(
    "f31_packet_analysis",
    over(f"""select p.packet_id, {time_text('p.ts')} as "timestamp", p.src as src_ip, p.dst as dst_ip, coalesce(sport, 0) as src_port, coalesce(dport, 0) as dst_port, proto as protocol, len as length,
 coalesce(s.service, 'unknown') as src_service, coalesce(d.service, 'unknown') as dst_service,
 case when proto = 'tcp' then case flags when 2 then 'SYN' when 16 then 'ACK' when 24 then 'PSH,ACK' else '' end end as tcp_flags,
 case when has then kind end as content_type, case when has then concat_ws(',', {SIG_NAMES}) end as detections, case when has then entropy end as entropy,
 case when has then cast(parts.payload_size as bigint) end as payload_size, case when has then parts.printable_ratio end as printable_ratio, frequent,
 array_to_string(list_transform(v, lambda x: cast(cast(round(x * 1000000) as bigint) as varchar)), ',') as features
 from packets p join parts on parts.packet_id = p.packet_id join vectors on vectors.packet_id = p.packet_id left join frequent_bytes f on f.k = p.packet_id left join {service_values('analysis')} s(port, service) on s.port = sport
 left join {service_values('analysis')} d(port, service) on d.port = dport""", "packets", **VECTOR_TABLES, frequent_bytes="""select k, string_agg('0x' || lower(ltrim(b, '0')) || ':' || cast(cast(round(n * 1000000 / cast(total as double)) as bigint) as varchar), ',' order by n desc, b) as frequent from
 (select *, sum(n) over (partition by k) as total, row_number() over (partition by k order by n desc, b) as rn from counts) q where rn <= 10 group by k"""),
)
def _(spark, sf):
    a = FE.analyze_packets(V.spread(V.packets(spark, sf)))
    millionths = lambda x: F.round(x * 1000000).cast("bigint").cast("string")
    frequent = F.transform(F.map_entries("payload.byte_frequency"), lambda e: F.concat(e["key"], F.lit(":"), millionths(e["value"])))
    return a.select(
        "packet_id", X.time_text(F.col("timestamp")).alias("timestamp"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "src_service", "dst_service",
        F.array_join("tcp_flags", ",").alias("tcp_flags"), "payload.content_type",
        F.array_join("payload.detections", ",").alias("detections"), (F.round("payload.entropy", 6) + 0.0).alias("entropy"),
        F.col("payload.payload_size").cast("bigint").alias("payload_size"), F.round("payload.printable_ratio", 6).alias("printable_ratio"),
        F.array_join(frequent, ",").alias("frequent"), F.array_join(F.transform("features", lambda x: millionths(F.round(x, 6))), ",").alias("features"),
    )


# --- signature matching ---

BUILTIN_HITS = " union all ".join(f"select packet_id, '{n}' as signature, ts from packets where {signature_sql(n)}" for n in dims.ATTACK_SIGNATURES)
USER_HITS = "select packet_id, name as signature, ts from packets join merged_signatures on is_active and regexp_matches(payload, '(?is)' || pattern)"


def _user_signatures(spark, sf):
    merged = SG.upsert(V.signatures(spark, sf), V.signature_additions(spark, sf))
    return SG.active(merged)


@query("j5_signature_hits", over(f"select packet_id, signature from ({BUILTIN_HITS} union all {USER_HITS}) q", "packets", "merged_signatures"))
def _(spark, sf):
    return SG.matches(V.spread(V.packets(spark, sf)), _user_signatures(spark, sf))



@query(
    "j5_many_signature_hits",
    over(f"""select packet_id, signature from ({BUILTIN_HITS}) q where signature <> 'xss' union all
 select packet_id, 'bot_' || regexp_extract(payload, '"id":"bot([0-9]+)"', 1) from packets where regexp_extract(payload, '"id":"bot([0-9]+)"', 1) in (select cast(c_custkey as varchar) from customer)
 union all select packet_id, 'xss' from packets where regexp_matches(payload, '(?i)slowloris$')
 union all select packet_id, 'service' from packets where regexp_matches(payload, '(?i)"service"|DNS_QUERY_[a-z]+')""", "packets"),
)
def _(spark, sf):
    """A rule per customer, one that replaces a built-in, one with a named group; an old pattern of a name gives way to the newest."""
    bots = V.table(spark, sf, "customer").select(
        F.concat(F.lit("bot_"), "c_custkey").alias("name"), F.concat(F.lit('"id":"bot'), "c_custkey", F.lit('"')).alias("pattern"), F.col("c_custkey").alias("id")
    )
    more = spark.createDataFrame([("xss", "slowloris$", 2), ("xss", "GET", 1), ("service", '(?P<q>")service(?P=q)|DNS_QUERY_[a-z]+', 1)], "name string, pattern string, id bigint")
    return SG.matches(V.spread(V.packets(spark, sf)), bots.unionByName(more))


@query(
    "j5_rule_index_hits",
    over("""select packet_id, 'order_' || k as signature from (select packet_id, regexp_extract(payload, 'gate\\.php\\?id=([0-9]+) HTTP', 1) as k from packets) g where k in (select cast(o_orderkey as varchar) from orders where o_orderkey % 3 <> 1)
 union all select packet_id, 'order_' || k from (select packet_id, regexp_extract(payload, '"id":"bot([0-9]+)"', 1) as k from packets) b where k in (select cast(o_orderkey as varchar) from orders where o_orderkey % 3 = 1)""", "packets"),
)
def _(spark, sf):
    """A rule per order, 15,000 at scale 0.01: looked up by the texts they require; a third of them have alternatives."""
    k = F.col("o_orderkey").cast("string")
    gate = F.concat(F.lit(r"gate\.php\?id="), k, F.lit(r" HTTP/1\.[01]$"))
    bot = F.concat(F.lit("bot "), k, F.lit(' reported|"id":"bot'), k, F.lit('"'))
    rules = V.table(spark, sf, "orders").select(F.concat(F.lit("order_"), k).alias("name"), F.when(F.col("o_orderkey") % 3 == 1, bot).otherwise(gate).alias("pattern"))
    return SG.matches(V.spread(V.packets(spark, sf)), rules, include_builtin=False)


BAD = "case s_suppkey % 4 when 0 then s_name || '(' when 1 then '[' || s_name when 2 then '*' || s_name else s_name || '|x' end"


@query("x1_refused_signatures", f"select s_suppkey as id, {BAD} as pattern, s_suppkey % 4 = 3 as accepted from supplier")
def _(spark, sf):
    log = V.signature_additions(spark, sf).join(V.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.expr(BAD).alias("bad")), "id")
    accepted, refused = SG.checked(log.drop("pattern").withColumnRenamed("bad", "pattern"))
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
    return both.select((F.col("id") - 1000).alias("id"), "pattern", "accepted")


@query(
    "j5_signature_hits_per_hour",
    over(f"select signature, {time_text('h')} as \"hour\", n as packets from (select signature, date_trunc('hour', ts) as h, count(*) as n from ({BUILTIN_HITS}) q group by 1, 2) r", "packets"),
)
def _(spark, sf):
    p = V.spread(V.packets(spark, sf))
    # The time travels with the hit, so no join back is needed.
    hits = SG.matches(p.withColumn("packet_key", F.struct("packet_id", F.date_trunc("hour", "ts").alias("hour"))), key="packet_key")
    counted = hits.groupBy("signature", "packet_key.hour").agg(F.count(F.lit(1)).alias("packets"))
    return counted.withColumn("hour", X.time_text(F.col("hour")))


@query("j5_page_signature_hits", " union all ".join(f"select page_id, '{n}' as signature from pages where {signature_sql(n, 'html')}" for n in dims.ATTACK_SIGNATURES))
def _(spark, sf):
    return SG.matches(V.spread(V.table(spark, sf, "pages")), payload="html", key="page_id")


@query("x2_feature_registry", over("select packet_id, " + ", ".join(f"v[{i + 1}] as {n}" for i, n in enumerate(H.HEADER_FEATURES)) + " from vectors", "packets", **VECTOR_TABLES))
def _(spark, sf):
    values = [(F.round(build().cast("double"), 6) + 0.0).alias(n) for n, build in H.HEADER_FEATURES.items()]
    return V.spread(V.packets(spark, sf)).select("packet_id", *values)
