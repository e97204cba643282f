"""Sliding windows on streams from panes: a row is counted once, in its pane; windows add panes up."""

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
SKETCH_BITS = 14  # distinct counts: exact while small, about 1 % off beyond


def seconds(width: str) -> int:
    """Length of an interval text such as ``10 minutes``."""
    number, unit = width.split()
    return int(number) * SECONDS[unit.rstrip("s")]


def sliding(packets: DataFrame, keys: list[str], width: str, slide: str, counts: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, ``start``, ``end``, sums of ``counts`` and distinct numbers of ``distinct`` per window of ``width``, one every ``slide``.

    ``packets`` has a watermark on ``ts``. A pane is as long as the greatest common divisor of both; state is one row per
    open pane and key, and one per open window and key. Nothing is copied width / slide times but finished panes.
    """
    distinct = distinct or {}
    pane = f"{gcd(seconds(width), seconds(slide))} seconds"
    partial = packets.groupBy(*keys, F.window("ts", pane)).agg(
        *[F.sum(c.cast("bigint")).alias(n) for n, c in counts.items()], *[F.hll_sketch_agg(c, SKETCH_BITS).alias(n) for n, c in distinct.items()]
    )
    placed = partial.select(*keys, F.window_time("window").alias("at"), *counts, *distinct)
    whole = placed.groupBy(*keys, F.window("at", width, slide)).agg(
        *[F.sum(n).alias(n) for n in counts], *[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in distinct]
    )
    return whole.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *counts, *distinct)
