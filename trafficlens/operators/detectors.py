"""Detectors for the attack patterns of the traffic model. They run on batches; ``streaming.jobs`` has them with watermarks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import address
from trafficlens.operators import sessions


def _window(width: str, slide: str | None) -> Column:
    return F.window("ts", width, slide) if slide else F.window("ts", width)


def _bounds() -> list[Column]:
    return [F.col("window.start").alias("start"), F.col("window.end").alias("end")]


def _distinct(column: str, approximate: bool) -> Column:
    """Exact distinct counts shuffle by the counted value too, so one hot key does not end in one task."""
    return F.approx_count_distinct(column, 0.01) if approximate else F.count_distinct(column)


def syn(packets: DataFrame) -> DataFrame:
    """TCP packets that open a connection."""
    return packets.filter("lower(proto) = 'tcp' and flags = 2")


def logins(packets: DataFrame) -> DataFrame:
    """Login attempts over SSH or FTP."""
    return packets.filter("dport in (21, 22) and lower(proto) = 'tcp' and (payload like '%USER%' or payload like '%PASS%')")


def requests(packets: DataFrame) -> DataFrame:
    """TCP packets that ask for service."""
    return packets.filter("lower(proto) = 'tcp' and (flags = 2 or payload like 'GET %')")


def outward(packets: DataFrame) -> DataFrame:
    """Packets from an internal host to an external one."""
    return packets.filter(address.is_internal(F.col("src")) & ~address.is_internal(F.col("dst")))


def encoded() -> Column:
    """Whether the payload announces encoded data."""
    return F.coalesce(F.col("payload").contains("BASE64"), F.lit(False))


def port_scan(
    packets: DataFrame, width: str = "1 minute", slide: str | None = None, min_ports: int = 10, approximate: bool = False
) -> DataFrame:
    """Sources that send SYN to many ports within a window. ``approximate`` for streams."""
    found = syn(packets).groupBy("src", _window(width, slide)).agg(
        F.count(F.lit(1)).alias("syn_packets"), _distinct("dport", approximate).alias("ports")
    )
    return found.filter(F.col("ports") >= min_ports).select("src", *_bounds(), "syn_packets", "ports")


def brute_force(
    packets: DataFrame, width: str = "5 minutes", slide: str | None = None, min_attempts: int = 5
) -> DataFrame:
    """Repeated logins against SSH or FTP. Also on streams."""
    found = logins(packets).groupBy("src", "dst", "dport", _window(width, slide)).agg(F.count(F.lit(1)).alias("attempts"))
    return found.filter(F.col("attempts") >= min_attempts).select("src", "dst", "dport", *_bounds(), "attempts")


def flood(
    packets: DataFrame, width: str = "1 minute", slide: str | None = None, min_sources: int = 20,
    min_packets: int = 100, approximate: bool = False,
) -> DataFrame:
    """Many sources sending SYN or GET to one service."""
    found = requests(packets).groupBy("dst", "dport", _window(width, slide)).agg(
        F.count(F.lit(1)).alias("packets"), _distinct("src", approximate).alias("sources")
    )
    return found.filter((F.col("sources") >= min_sources) & (F.col("packets") >= min_packets)).select(
        "dst", "dport", *_bounds(), "packets", "sources"
    )


def exfiltration(
    packets: DataFrame, width: str = "10 minutes", slide: str | None = None, min_bytes: int = 10_000_000
) -> DataFrame:
    """Internal hosts that send encoded data or many bytes outside. Also on streams."""
    found = outward(packets).groupBy("src", _window(width, slide)).agg(
        F.sum(F.col("len").cast("bigint")).alias("bytes_out"), F.count_if(encoded()).alias("marker_hits")
    )
    return found.filter((F.col("marker_hits") > 0) | (F.col("bytes_out") >= min_bytes)).select(
        "src", *_bounds(), "bytes_out", "marker_hits"
    )


def control_endpoint() -> Column:
    """Whether the payload names a known control endpoint."""
    endpoint = F.lit(False)
    for e in dims.CONTROL_ENDPOINTS:
        endpoint = endpoint | F.coalesce(F.col("payload").contains(e), F.lit(False))
    return endpoint


def beaconing(packets: DataFrame, min_packets: int = 3) -> DataFrame:
    """Pairs that contact a known control endpoint, with mean and deviation of the gaps between packets."""
    keys = ["src", "dst"]
    linked = packets.filter("src is not null and dst is not null")
    pairs = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.count_if(control_endpoint()).alias("endpoint_hits"))
    suspects = pairs.filter((F.col("endpoint_hits") > 0) & (F.col("packets") >= min_packets))
    # Only packets of suspects are ordered; Spark broadcasts the pairs if they turn out to be few.
    rhythm = sessions.gaps(linked.join(suspects, keys, "left_semi"), keys).groupBy(*keys).agg(
        F.avg("gap_s").alias("mean_gap_s"), F.stddev_pop("gap_s").alias("std_gap_s")
    )
    return suspects.join(rhythm, keys)


def episodes(alerts: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Runs of alerts per source and category: start, end, number."""
    found = sessions.sessionize(alerts, ["src_ip", "category"], gap_seconds=gap_seconds)
    return found.select("src_ip", "category", "start", F.col("last_seen").alias("end"), F.col("rows").alias("alerts"))
