"""Bring captured rows into the packet layout and clean tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens import dims

# Source columns in order of preference, and the default of each packet field.
FIELD_SOURCES = {
    "src": (("src_ip", "src"), "192.168.1.1", "string"),
    "dst": (("dst_ip", "dst"), "192.168.1.2", "string"),
    "sport": (("src_port",), 1024, "int"),
    "dport": (("dst_port",), 80, "int"),
    "proto": (("protocol",), "tcp", "string"),
    "len": (("pkt_len", "packet_length"), 128, "int"),
    "ttl": (("ttl",), 64, "int"),
}
HTTP_PAYLOAD = "GET / HTTP/1.1\r\nHost: example.com\r\n\r\n"
DNS_PAYLOAD = "\x00\x01\x00\x00\x00\x01\x00\x00\x00\x00\x00\x00"
OTHER_PAYLOAD = "test_payload"


def default_payload(proto: Column, dport: Column) -> Column:
    return (
        F.when((proto == "http") | (dport == 80), HTTP_PAYLOAD)
        .when((proto == "dns") | (dport == 53), DNS_PAYLOAD)
        .otherwise(OTHER_PAYLOAD)
    )


def truth_flag(df: DataFrame) -> Column:
    """Truth from ``label`` (text other than benign, or a truthy number), else ``is_attack``, else False."""
    types = dict(df.dtypes)
    if "label" in types:
        label = F.col("label")
        truth = F.lower(label) != "benign" if types["label"] == "string" else label.cast("boolean")
    elif "is_attack" in types:
        truth = F.col("is_attack").cast("boolean")
    else:
        truth = F.lit(False)
    return F.coalesce(truth, F.lit(False))


def normalize_packets(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of any flow file as packets: first source column that exists, NULL and absent take the default."""

    def field(name: str) -> Column:
        sources, default, kind = FIELD_SOURCES[name]
        found = next((s for s in sources if s in df.columns), None)
        default = F.lit(default)
        return (F.coalesce(F.col(found).cast(kind), default) if found else default).cast(kind)

    out = df.select(
        *keep,
        *[field(n).alias(n) for n in FIELD_SOURCES],
        (F.col("tcp_flags").cast("int") if "tcp_flags" in df.columns else F.lit(None).cast("int")).alias("_flags"),
        (F.col("timestamp") if "timestamp" in df.columns else F.lit(None)).cast("timestamp").alias("ts"),
        (F.col("payload") if "payload" in df.columns else F.lit(None).cast("string")).alias("_payload"),
        truth_flag(df).alias("is_malicious"),
    )
    flags = F.coalesce("_flags", F.when(F.col("proto") == "tcp", 16).otherwise(0))
    payload = F.coalesce("_payload", default_payload(F.col("proto"), F.col("dport")))
    return out.select(
        *keep, "ts", "src", "dst", "proto", "sport", "dport", flags.alias("flags"), "len", "ttl",
        payload.alias("payload"), "is_malicious",
    )


def pick_target(df: DataFrame) -> str:
    """Name of the target column; an error if none of the usual names exists."""
    found = next((c for c in dims.TARGET_COLUMNS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no target column; expected one of {', '.join(dims.TARGET_COLUMNS)}")
    return found


def binarise_target(df: DataFrame, target: str) -> DataFrame:
    """Target as 0/1. More than two values: benign is 0. Two other values: benign, else the smaller, is 0."""
    # Three values decide the case, so at most three rows reach the driver.
    values = [r[0] for r in df.select(target).na.drop().distinct().limit(3).collect()]
    c = F.col(target)
    if len(values) > 2:
        binary = F.when(F.lower(c.cast("string")) == "benign", 0).otherwise(1)
    elif all(v in (0, 1) for v in values):
        binary = c.cast("int")
    else:
        zero = next((v for v in values if str(v).lower() == "benign"), min(values))
        binary = F.when(c == F.lit(zero), 0).otherwise(1)
    return df.withColumn(target, F.when(c.isNotNull(), binary))


def split_features(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def drop_identifiers(df: DataFrame, columns: tuple[str, ...] = dims.FLOW_IDENTIFIERS) -> DataFrame:
    return df.drop(*columns)


def select_flow_features(df: DataFrame, columns: tuple[str, ...] = dims.SELECTED_FLOW_FEATURES) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Replace ±infinity and NaN by NULL in floating-point columns."""
    fixed = {}
    for name in _floating(df):
        c = F.col(f"`{name}`")
        fixed[name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.withColumns(fixed) if fixed else df


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop()


def has_nulls(df: DataFrame) -> DataFrame:
    """One row: whether any value of the table is NULL."""
    missing = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in df.columns])
    return df.agg(F.coalesce(F.bool_or(missing), F.lit(False)).alias("has_nulls"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing packet fields as ``unknown`` or 0."""
    texts, numbers = ("src", "dst", "proto"), ("sport", "dport", "len")
    return df.withColumns(
        {c: F.coalesce(c, F.lit("unknown")) for c in texts} | {c: F.coalesce(c, F.lit(0)) for c in numbers}
    )
