"""Packet features and the full packet analysis record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions import header as H
from trafficlens.functions import payload as P
from trafficlens.operators import graph, traffic

PAYLOAD_WIDTH = 4 + len(dims.ATTACK_SIGNATURES) + len(dims.CONTENT_PATTERNS)


def header_columns(with_flow: bool = False) -> dict[str, Column]:
    """The 15 header features by name. ``with_flow`` reads the flow facts added by ``with_flow_facts``."""
    flow = (
        H.flow_features(F.col("flow_start"), F.col("flow_end"), F.col("flow_packets"), F.col("flow_bytes"))
        if with_flow
        else H.single_packet_flow()
    )
    return {name: build() for name, build in H.HEADER_FEATURES.items()} | flow


def header_features(packets: DataFrame, with_flow: bool = False) -> DataFrame:
    """One column per header feature, next to ``packet_id``."""
    source = graph.with_flow_facts(packets) if with_flow else packets
    return source.select("packet_id", *[c.alias(n) for n, c in header_columns(with_flow).items()])


def with_payload_parts(df: DataFrame, payload: str = "payload", dpi: bool = True) -> DataFrame:
    """Add byte text, size, byte counts, content type and signature flags of a payload column.

    The parts are columns of their own so that later expressions share them instead of repeating the work.
    ``dpi=False`` turns inspection off: every packet then looks as if it had no payload.
    """
    text = P.payload_text(F.col(payload), df.schema[payload].dataType) if dpi else F.lit(None).cast("string")
    df = df.withColumn("_text", text)
    text, lower = F.col("_text"), F.col("_lower")
    df = df.withColumns(
        {"_lower": F.lower("_text"), "_size": F.coalesce(F.length(text), F.lit(0)), "_chars": P.distinct_bytes(text)}
    )
    df = df.withColumn("_left", P.octets_left(text, F.col("_chars")))
    return df.withColumns(
        {
            "_counts": P.byte_counts(F.col("_chars"), F.col("_left")),
            "_kind": P.content_type(text, lower),
            **{f"_sig_{n}": c for n, c in P.signature_flags(lower).items()},
        }
    )


def _flags() -> list[Column]:
    return [F.col(f"_sig_{n}") for n in dims.ATTACK_SIGNATURES]


def builtin_hits() -> Column:
    """Names of the built-in signatures that matched, in catalogue order."""
    return F.array_compact(F.array(*[F.when(F.col(f"_sig_{n}"), n) for n in dims.ATTACK_SIGNATURES]))


def _payload_vector() -> Column:
    hits = sum((f.cast("int") for f in _flags()), F.lit(0))
    return P.payload_features(F.col("_text"), F.col("_kind"), _flags(), hits, F.col("_counts"))


def payload_analysis(df: DataFrame, payload: str = "payload", key: str = "packet_id", dpi: bool = True) -> DataFrame:
    """Content type, matched signatures, entropy, printable ratio, frequent bytes and size per payload."""
    parts = with_payload_parts(df, payload, dpi)
    text, size, counts = F.col("_text"), F.col("_size"), F.col("_counts")
    return parts.select(
        key,
        F.col("_kind").alias("content_type"),
        builtin_hits().alias("detections"),
        F.when(size > 0, P.entropy(counts, size)).otherwise(0.0).alias("entropy"),
        F.when(size > 0, P.printable_ratio(text)).otherwise(0.0).alias("printable_ratio"),
        F.when(size > 0, P.byte_frequency(counts, size)).alias("byte_frequency"),
        size.alias("payload_size"),
    )


def feature_vectors(packets: DataFrame, with_flow: bool = False, dpi: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Vectors of 15 header and 20 payload values; the payload part is zero without payload or inspection."""
    source = graph.with_flow_facts(packets) if with_flow else packets
    parts = with_payload_parts(source, dpi=dpi)
    head = F.array(*[c.cast("double") for c in header_columns(with_flow).values()])
    return parts.select("packet_id", *keep, F.concat(head, _payload_vector()).alias("features"))


FEATURE_NAMES = (
    *H.HEADER_FEATURES,
    *H.FLOW_FEATURES,
    "entropy", "printable_ratio", "payload_size", "signature_hits",
    *dims.ATTACK_SIGNATURES,
    *[f"content_{n}" for n in dims.CONTENT_PATTERNS],
)


def feature_table(vectors: DataFrame) -> DataFrame:
    """Long form: one row per packet and feature name."""
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    # The outer form keeps Spark from inferring a filter that would compute every vector a second time.
    return vectors.select("packet_id", F.posexplode_outer("features").alias("position", "value")).select(
        "packet_id", "position", F.element_at(names, F.col("position") + 1).alias("feature"), "value"
    )


def analyze_packets(packets: DataFrame, with_flow: bool = False, dpi: bool = True) -> DataFrame:
    """Full record per packet: addresses, services, flags, ICMP fields, payload analysis, feature vector."""
    source = traffic.with_services(graph.with_flow_facts(packets) if with_flow else packets)
    parts = with_payload_parts(source, dpi=dpi)
    text, size, counts = F.col("_text"), F.col("_size"), F.col("_counts")
    proto = F.lower("proto")
    head = F.array(*[c.cast("double") for c in header_columns(with_flow).values()])
    inspected = F.struct(
        F.col("_kind").alias("content_type"), builtin_hits().alias("detections"),
        P.entropy(counts, size).alias("entropy"), P.printable_ratio(text).alias("printable_ratio"),
        P.byte_frequency(counts, size).alias("byte_frequency"), size.alias("payload_size"),
    )
    window = F.col("window") if "window" in packets.columns else F.lit(None).cast("int")
    return parts.select(
        "packet_id", F.col("ts").alias("timestamp"),
        F.coalesce("src", F.lit("unknown")).alias("src_ip"), F.coalesce("dst", F.lit("unknown")).alias("dst_ip"),
        F.coalesce("sport", F.lit(0)).alias("src_port"), F.coalesce("dport", F.lit(0)).alias("dst_port"),
        F.coalesce("proto", F.lit("unknown")).alias("protocol"), F.coalesce("len", F.lit(0)).alias("length"),
        "src_service", "dst_service",
        F.when(proto == "tcp", H.flag_names(F.coalesce("flags", F.lit(0)))).alias("tcp_flags"),
        F.when(proto == "tcp", F.coalesce(window, F.lit(0))).alias("tcp_window"),
        F.when(proto == "icmp", F.coalesce("icmp_type", F.lit(0))).alias("icmp_type"),
        F.when(proto == "icmp", F.coalesce("icmp_code", F.lit(0))).alias("icmp_code"),
        F.when(text.isNotNull(), inspected).alias("payload"),
        F.concat(head, _payload_vector()).alias("features"),
    )
