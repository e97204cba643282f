"""Sessions and inter-arrival gaps that stay balanced when one key holds most of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sessionize(df: DataFrame, keys: list[str], ts: str = "ts", gap_seconds: int = 300, **sums: Column) -> DataFrame:
    """Group rows of a key into sessions that end after more than ``gap_seconds`` of silence.

    Rows closer than the gap always share a session, so rows are first merged per (key, gap-wide slot) with
    a map-side aggregate. What the window then sees is bounded by elapsed time / gap per key, not by rows.
    ``sums`` names extra expressions to add up per session.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros(ts)
    slots = df.groupBy(*keys, F.floor(micros / gap).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
    )
    by_key = W.partitionBy(*keys).orderBy("_slot")
    opens = F.col("_first") - F.lag("_last").over(by_key) > gap
    marked = slots.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("_opens").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(
        F.timestamp_micros(F.min("_first")).alias("start"), F.timestamp_micros(F.max("_last")).alias("last_seen"),
        F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in sums],
    )


def with_endpoints(packets: DataFrame) -> DataFrame:
    """TCP packets with a direction-free pair of endpoints."""
    tcp = packets.filter("lower(proto) = 'tcp' and sport is not null and dport is not null")
    a = F.concat_ws(":", "src", F.col("sport").cast("string"))
    b = F.concat_ws(":", "dst", F.col("dport").cast("string"))
    return tcp.withColumns({"endpoint_a": F.least(a, b), "endpoint_b": F.greatest(a, b)})


def tcp_sessions(packets: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Both directions of a TCP conversation as one session."""
    found = sessionize(with_endpoints(packets), ["endpoint_a", "endpoint_b"], gap_seconds=gap_seconds)
    return found.select("endpoint_a", "endpoint_b", "start", "last_seen", F.col("rows").alias("packets"))


def gaps(df: DataFrame, keys: list[str], ts: str = "ts", slot_seconds: int = 60) -> DataFrame:
    """Seconds between neighbouring rows of a key, one row per gap.

    Neighbours inside a time slot come from a window over (key, slot); the gaps across slots come from the
    first and last row of each slot. No window ever spans all rows of a key.
    """
    micros = F.unix_micros(ts)
    slotted = df.select(*keys, micros.alias("_t"), F.floor(micros / (slot_seconds * 1_000_000)).alias("_slot"))
    inside = slotted.withColumn(
        "_gap", F.col("_t") - F.lag("_t").over(W.partitionBy(*keys, "_slot").orderBy("_t"))
    )
    edges = slotted.groupBy(*keys, "_slot").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    across = edges.withColumn(
        "_gap", F.col("_first") - F.lag("_last").over(W.partitionBy(*keys).orderBy("_slot"))
    )
    both = inside.select(*keys, "_gap").unionByName(across.select(*keys, "_gap"))
    return both.filter("_gap is not null").select(*keys, (F.col("_gap") / 1e6).alias("gap_s"))
