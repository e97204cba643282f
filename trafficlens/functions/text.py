"""Display expressions: sizes, clock times, time bands, timestamps."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(size: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """``1.5 KB``; pass a sixth unit for petabytes."""
    size = size.cast("double")
    step = F.lit(0)
    for i in range(1, len(units)):
        step = step + (size >= float(1024**i)).cast("int")
    scaled = F.bround(size / F.pow(F.lit(1024.0), step), 2)
    unit = F.element_at(F.array(*map(F.lit, units)), step + 1)
    return F.when(size == 0, "0 B").otherwise(F.concat(scaled.cast("string"), F.lit(" "), unit))


def clock(ts: Column, millis: bool = False) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS" if millis else "HH:mm:ss")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def bin_start(ts: Column, width: str) -> Column:
    """Start of the fixed-width time bin a timestamp falls into."""
    return F.window(ts, width)["start"]


def time_band(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when((hour >= 8) & (hour < 18), "working_hours")
        .when((hour >= 18) & (hour < 23), "after_hours")
        .when((hour >= 23) | (hour < 8), "night")
    )


def parse_timestamp(text: Column) -> Column:
    """ISO text (``T`` separator, optional ``Z`` or offset) or ``yyyy-MM-dd HH:mm:ss.ffffff``; else NULL."""
    return F.coalesce(
        F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


def shorten(text: Column, width: int = 50) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
