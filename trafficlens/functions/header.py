"""Header features and TCP flag formatting."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens import dims
from trafficlens.functions.address import is_public

TCP_FLAG_BITS = {"FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08, "ACK": 0x10, "URG": 0x20, "ECE": 0x40, "CWR": 0x80}

FLOW_FEATURES = ("flow_duration", "packet_rate", "byte_rate")


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("double")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _proto_is(name: str) -> Column:
    return F.lower(F.col("proto")) == name


def uses_common_port(sport: Column, dport: Column) -> Column:
    known = list(dims.SERVICE_PORTS)
    return F.coalesce(sport.isin(known), F.lit(False)) | F.coalesce(dport.isin(known), F.lit(False))


# Feature name -> expression, in vector order.
HEADER_FEATURES = {
    "source_ip_public": lambda: _flag(is_public(F.col("src"))),
    "dest_ip_public": lambda: _flag(is_public(F.col("dst"))),
    "source_port_numeric": lambda: F.least(_number("sport") / 65535.0, F.lit(1.0)),
    "dest_port_numeric": lambda: F.least(_number("dport") / 65535.0, F.lit(1.0)),
    "protocol_tcp": lambda: _flag(_proto_is("tcp")),
    "protocol_udp": lambda: _flag(_proto_is("udp")),
    "protocol_icmp": lambda: _flag(_proto_is("icmp")),
    "packet_size": lambda: F.least(_number("len") / 65535.0, F.lit(1.0)),
    "tcp_flags": lambda: F.when(_proto_is("tcp"), _number("flags") / 255.0).otherwise(0.0),
    "fragment": lambda: _flag(F.col("frag")),
    "ttl": lambda: _number("ttl") / 255.0,
    "common_port": lambda: _flag(uses_common_port(F.col("sport"), F.col("dport"))),
}


def flow_seconds(start: Column, end: Column) -> Column:
    """Flow duration in seconds with sub-second precision, cut at one hour; 0 when unknown."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.when(seconds.isNull(), 0.0).otherwise(F.least(seconds, F.lit(3600.0)))


def flow_features(start: Column, end: Column, packets: Column, size: Column) -> dict[str, Column]:
    """Duration, packet rate and byte rate, each scaled to 0-1."""
    seconds = flow_seconds(start, end)
    packets = F.coalesce(packets, F.lit(1)).cast("double")
    size = F.coalesce(size, F.lit(0)).cast("double")
    lasts = seconds > 0
    return {
        "flow_duration": seconds / 3600.0,
        "packet_rate": F.when(lasts, F.least(packets / seconds / 1000.0, F.lit(1.0))).otherwise(0.0),
        "byte_rate": F.least(F.when(lasts, size / seconds).otherwise(size) / 1e6, F.lit(1.0)),
    }


def single_packet_flow() -> dict[str, Column]:
    """Flow features of a packet without flow facts: only its own length counts."""
    never = F.lit(None).cast("timestamp")
    return flow_features(never, never, F.lit(1), F.col("len"))


def flag_names(flags: Column, bits: int = 6) -> Column:
    """Names of the set TCP flags among the lowest ``bits`` bits."""
    chosen = [(n, b) for n, b in TCP_FLAG_BITS.items() if b < (1 << bits)]
    return F.array_compact(F.array(*[F.when(flags.bitwiseAND(b) != 0, n) for n, b in chosen]))


def flag_text(flags: Column) -> Column:
    """``0x12 (SYN, ACK)``; a missing value reads ``None``."""
    code = F.format_string("0x%02x", flags)
    names = F.array_join(flag_names(flags, 8), ", ")
    text = F.when(names == "", code).otherwise(F.concat(code, F.lit(" ("), names, F.lit(")")))
    return F.when(flags.isNull(), "None").otherwise(text)


def hex_text(value: Column) -> Column:
    """Lower-case hexadecimal without padding; ``-`` when missing."""
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(value))), F.lit("-"))
