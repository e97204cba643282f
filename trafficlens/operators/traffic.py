"""Traffic aggregates. Every one is a hash aggregate with a map-side partial step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens import dims
from trafficlens.functions import address, text



def _malicious() -> Column:
    return F.coalesce(F.col("is_malicious"), F.lit(False))


def _bytes() -> Column:
    return F.coalesce(F.sum(F.col("len").cast("bigint")), F.lit(0)).alias("bytes")


def _packets() -> Column:
    return F.count(F.lit(1)).alias("packets")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def totals(packets: DataFrame) -> DataFrame:
    return packets.agg(
        _packets(), _bytes(), F.count_if(~_malicious()).alias("benign"), F.count_if(_malicious()).alias("malicious")
    )


def truth_shares(packets: DataFrame) -> DataFrame:
    t = totals(packets)
    return t.select(
        percent(F.col("benign"), F.col("packets")).alias("benign_percent"),
        percent(F.col("malicious"), F.col("packets")).alias("malicious_percent"),
    )


def _proto_bucket(known=("tcp", "udp", "icmp")) -> Column:
    proto = F.lower("proto")
    return F.when(proto.isin(*known), proto).otherwise("other")


def protocol_distribution(packets: DataFrame) -> DataFrame:
    """Packets per protocol with share; the window sees at most four rows."""
    counts = packets.groupBy(_proto_bucket().alias("protocol")).agg(_packets())
    return counts.withColumn("percentage", percent(F.col("packets"), F.sum("packets").over(W.partitionBy())))


def malicious_protocols(detections: DataFrame) -> DataFrame:
    return (
        detections.filter("is_malicious")
        .groupBy(F.upper(F.coalesce("protocol", F.lit("unknown"))).alias("protocol"))
        .agg(_packets())
    )


def packets_per(packets: DataFrame, column: str) -> DataFrame:
    """Packets per source or destination; rows without a value are skipped."""
    return packets.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(_packets())


def packets_per_port(packets: DataFrame) -> DataFrame:
    """Packets per destination port, without missing ports and port 0."""
    return packets.filter("dport is not null and dport <> 0").groupBy("dport").agg(_packets())


def direction_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy(address.direction(F.col("src"), F.col("dst")).alias("direction")).agg(_packets())


def per_minute(packets: DataFrame) -> DataFrame:
    return packets.groupBy(text.minute(F.col("ts")).alias("minute"), _malicious().alias("is_malicious")).agg(_packets())


def timeline(packets: DataFrame, width: str = "1 minute") -> DataFrame:
    """Packets, bytes and malicious packets per interval; works on batches and on watermarked streams."""
    return packets.groupBy(F.window("ts", width)).agg(
        _packets(), _bytes(), F.count_if(_malicious()).alias("malicious")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "packets", "bytes", "malicious")


def protocol_counters(packets: DataFrame) -> DataFrame:
    """Counters per truth label: bytes and packets of each protocol group."""
    groups = ("tcp", "udp", "icmp", "other")
    return packets.groupBy(_malicious().alias("is_malicious")).agg(
        _packets(), _bytes(), *[F.count_if(_proto_bucket() == g).alias(g) for g in groups]
    )


def rate_history(packets: DataFrame, seconds: int = 1, keep: int = 60) -> DataFrame:
    """Packets per second for the newest ``keep`` non-empty intervals."""
    slot = (F.floor(F.unix_seconds("ts") / seconds) * seconds).alias("second")
    rates = packets.groupBy(slot).agg(_packets())
    return (
        rates.orderBy(F.desc("second"))
        .limit(keep)
        .select(F.timestamp_seconds("second").alias("start"), (F.col("packets") / float(seconds)).alias("rate"))
    )


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("is_malicious").agg(F.count(F.lit(1)).alias("detections"))


def top_hosts(packets: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Busiest hosts with the network they belong to; ties go to the smaller address."""
    top = packets_per(packets, column).orderBy(F.desc("packets"), column).limit(n)
    return top.select(
        F.col(column).alias("ip"), "packets", address.host_side(F.col(column), "Internal", "External").alias("network")
    )


def top_ports(packets: DataFrame, n: int = 15, catalog: str = "dashboard") -> DataFrame:
    """Busiest destination ports, labelled ``port (service)`` where the catalogue knows the port."""
    top = packets_per_port(packets).orderBy(F.desc("packets"), "dport").limit(n)
    named = with_service(top, "dport", "service", catalog, missing="Unknown")
    port = F.col("dport").cast("string")
    label = F.when(F.col("service") == "Unknown", port).otherwise(F.concat(port, F.lit(" ("), "service", F.lit(")")))
    return named.select(F.col("dport").alias("port"), "service", label.alias("label"), "packets")


def with_service(
    df: DataFrame, port: str, name: str, catalog: str = "analysis", missing: str = "unknown"
) -> DataFrame:
    """Add a service name. The dimension has at most 29 rows, so the broadcast is bounded by construction."""
    dim = dims.services(df.sparkSession, catalog).select(F.col("port").alias(f"_{port}"), F.col("service").alias(name))
    joined = df.join(F.broadcast(dim), F.col(port) == F.col(f"_{port}"), "left").drop(f"_{port}")
    return joined.withColumn(name, F.coalesce(name, F.lit(missing)))


def with_services(packets: DataFrame, catalog: str = "analysis") -> DataFrame:
    missing = "unknown" if catalog == "analysis" else "Unknown"
    return with_service(
        with_service(packets, "sport", "src_service", catalog, missing), "dport", "dst_service", catalog, missing
    )


def with_protocol_name(df: DataFrame, number: str) -> DataFrame:
    """Add the name of an IP protocol number (nine-row dimension)."""
    dim = dims.ip_protocols(df.sparkSession)
    return df.join(F.broadcast(dim), F.col(number) == F.col("protocol_number"), "left").drop("protocol_number")
