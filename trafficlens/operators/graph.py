"""Traffic graph and flow roll-ups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import address

FLOW_KEY = ("src", "dst", "sport", "dport", "proto")


def _linked(packets: DataFrame) -> DataFrame:
    return packets.filter("src is not null and dst is not null")


def edges(packets: DataFrame) -> DataFrame:
    """Packets and malicious share per source and destination."""
    out = _linked(packets).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if("is_malicious").alias("malicious_count")
    )
    return out.withColumn("malicious_ratio", F.col("malicious_count") / F.col("packets"))


def weighted_edges(packets: DataFrame) -> DataFrame:
    """Weight, whether any packet was malicious, and the protocol seen first (the smaller name on a tie).

    The large step counts per protocol with fixed-width sums only, so it stays a hash aggregate; picking the
    first protocol then sees a few rows per edge.
    """
    per_protocol = _linked(packets).groupBy("src", "dst", F.coalesce("proto", F.lit("other")).alias("proto")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("is_malicious").alias("bad"), F.min("ts").alias("first")
    )
    return per_protocol.groupBy("src", "dst").agg(
        F.sum("n").alias("weight"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("is_malicious"),
        F.min_by("proto", F.struct("first", "proto")).alias("protocol"),
    )


def nodes(packets: DataFrame) -> DataFrame:
    """Distinct addresses seen as source or destination, with their side."""
    both = packets.select(F.explode(F.array("src", "dst")).alias("ip"))
    return both.filter("ip is not null").distinct().withColumn("side", address.host_side(F.col("ip")))


def node_degree(packets: DataFrame) -> DataFrame:
    """Number of distinct outgoing plus incoming edges of each address."""
    pairs = _linked(packets).select("src", "dst").distinct()
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("ip"))
    return ends.groupBy("ip").agg(F.count(F.lit(1)).alias("degree"))


def flow_rollup(packets: DataFrame) -> DataFrame:
    """Start, end, packets and bytes per 5-tuple."""
    return packets.groupBy(*FLOW_KEY).agg(
        F.min("ts").alias("flow_start"), F.max("ts").alias("flow_end"),
        F.count(F.lit(1)).alias("flow_packets"), F.sum(F.col("len").cast("bigint")).alias("flow_bytes"),
    )


def with_flow_facts(packets: DataFrame) -> DataFrame:
    """Packets with the facts of their flow.

    Flows are unique per key, so only the packet side can be skewed; adaptive skew joins split it.
    """
    flows = flow_rollup(packets)
    renamed = flows.select(*[F.col(k).alias(f"_{k}") for k in FLOW_KEY], "flow_start", "flow_end", "flow_packets", "flow_bytes")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FLOW_KEY]
    return packets.join(renamed, same, "left").drop(*[f"_{k}" for k in FLOW_KEY])
