"""Continuous jobs. Each takes a streaming packet DataFrame and reuses the batch expressions.

State is bounded by event time: every stateful job sets a watermark and drops what is older.
"""

from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens import schema
from trafficlens.operators import alerts as A
from trafficlens.operators import detectors, features, models, sessions, signatures, traffic
from trafficlens.sources import folded
from trafficlens.sources.folded import FoldedLog
from trafficlens.sources.store import Store
from trafficlens.streaming import panes

LATE = "10 minutes"


def scored_packets(packets: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Packets with ``confidence`` and decision, without state."""
    keep = tuple(c for c in packets.columns if c != "packet_id")
    vectors = features.feature_vectors(packets, keep=keep)
    return models.score(vectors.withColumn("feature_data", F.col("features")), model, threshold).drop("features")


def traffic_timeline(packets: DataFrame, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """Traffic per interval; an interval is emitted once, when the watermark passes its end."""
    return traffic.timeline(packets.withWatermark("ts", late), width)


def tcp_sessions(packets: DataFrame, gap: str = "300 seconds", late: str = LATE) -> DataFrame:
    """TCP conversations closed by inactivity, both directions together."""
    keyed = sessions.with_endpoints(packets.withWatermark("ts", late))
    found = keyed.groupBy("endpoint_a", "endpoint_b", F.session_window("ts", gap)).agg(
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("packets")
    )
    return found.select("endpoint_a", "endpoint_b", F.col("session_window.start").alias("start"), "last_seen", "packets")


def counted_values(packets: DataFrame, width: str) -> DataFrame:
    """Packet counts by protocol, source, destination and port per interval: (start, dimension, value, packets)."""
    counted = F.explode(
        F.array(
            F.struct(F.lit("protocol").alias("dimension"), F.coalesce(F.lower("proto"), F.lit("other")).alias("value")),
            F.struct(F.lit("source").alias("dimension"), F.col("src").alias("value")),
            F.struct(F.lit("destination").alias("dimension"), F.col("dst").alias("value")),
            F.struct(F.lit("port").alias("dimension"), F.col("dport").cast("string").alias("value")),
        )
    )
    rows = packets.select("ts", counted.alias("c")).select("ts", "c.dimension", "c.value")
    found = rows.filter("value is not null").groupBy(F.window("ts", width), "dimension", "value").agg(F.count(F.lit(1)).alias("packets"))
    return found.select(F.col("window.start").alias("start"), "dimension", "value", "packets")


def running_counters(packets: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts of :func:`counted_values`, emitted once when their interval is over; :func:`write_counters` shows open ones too.

    State holds open intervals only; totals are sums over the written ones (:func:`read_counters`).
    """
    return counted_values(packets.withWatermark("ts", late), width)


def write_counters(packets: DataFrame, path: str, checkpoint: str, width: str = "1 hour", compact_every: int = 20, available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Counters that are up to date after every batch, open intervals and late packets included (:func:`live_counters`).

    A batch is counted on its own and its counts go to a folded log at the batch's number, so there is no state, a
    replayed batch changes nothing, and every ``compact_every`` batches the log becomes one snapshot.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        log = counter_log(batch.sparkSession, path)
        log.append(counted_values(batch, width), batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact()

    return _each_batch(packets, save, checkpoint, available_now, every)


def counter_log(spark: SparkSession, path: str) -> FoldedLog:
    return FoldedLog(spark, path, "start timestamp, dimension string, value string, packets bigint", folded.sums(["start", "dimension", "value"], ["packets"]))


def live_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all batches so far."""
    return counter_log(spark, path).entries().groupBy("dimension", "value").agg(F.sum("packets").alias("packets"))


def newest_log(spark: SparkSession, path: str, columns: str, n: int, order: list[str]) -> FoldedLog:
    return FoldedLog(spark, path, columns, folded.newest_rows(n, order))


def write_newest(rows: DataFrame, n: int, path: str, checkpoint: str, order: tuple[str, ...] = ("ts", "packet_id"), compact_every: int = 20, available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Keep the newest ``n`` rows of a stream (read by :func:`newest_log`): a batch adds its newest, compaction evicts the rest.

    At most ``n`` rows per batch since the last snapshot are stored, and ``n`` in it.
    """
    columns = schema.ddl({f.name: f.dataType.simpleString() for f in rows.schema.fields}).replace("`", "")

    def save(batch: DataFrame, batch_id: int) -> None:
        log = newest_log(batch.sparkSession, path, columns, n, list(order))
        log.append(log.fold(batch), batch_id)
        if (batch_id + 1) % compact_every == 0:
            log.compact()

    return _each_batch(rows, save, checkpoint, available_now, every)


def write_timeline_with_late(packets: DataFrame, path: str, checkpoint: str, width: str = "1 minute", late: str = LATE, available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Packets per interval, and apart from them the packets that came after their interval was closed (:func:`timeline_parts`).

    An interval is closed when the newest time of the batches before, less ``late``, has passed its end. Both tables and the
    newest times are folded logs at the batch's number, so together they always hold every packet once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        on_time, behind, clock = timeline_logs(batch.sparkSession, path)
        newest = clock.fold(clock.entries(batch_id - 1)).select((F.col("newest") - F.expr(f"interval {late}")).alias("t")).first()
        closed = F.col("end") <= F.lit(newest["t"] if newest else None).cast("timestamp")
        spot = F.window("ts", width)
        placed = batch.withColumn("_w", spot).withColumns({"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w").persist()
        try:
            on_time.append(placed.filter(~F.coalesce(closed, F.lit(False))).groupBy("start").agg(F.count(F.lit(1)).alias("packets")), batch_id)
            behind.append(placed.filter(closed).select("start", "ts", "packet_id"), batch_id)
            clock.append(placed.agg(F.lit(0).alias("k"), F.max("ts").alias("newest")), batch_id)
        finally:
            placed.unpersist()

    return _each_batch(packets, save, checkpoint, available_now, every)


def timeline_logs(spark: SparkSession, path: str) -> tuple[FoldedLog, FoldedLog, FoldedLog]:
    """Counts of packets in time, packets behind it, and the newest time seen."""
    newest = lambda rows: rows.groupBy("k").agg(F.max("newest").alias("newest"))
    return (
        FoldedLog(spark, f"{path}/in_time", "start timestamp, packets bigint", folded.sums(["start"], ["packets"])),
        FoldedLog(spark, f"{path}/behind", "start timestamp, ts timestamp, packet_id bigint", lambda rows: rows),
        FoldedLog(spark, f"{path}/clock", "k int, newest timestamp", newest),
    )


def timeline_parts(spark: SparkSession, path: str) -> DataFrame:
    """``start``, ``in_time`` and ``behind``: packets of each interval by when they came; their sum corrects the total."""
    on_time, behind, _ = timeline_logs(spark, path)
    counted = behind.read().groupBy("start").agg(F.count(F.lit(1)).alias("behind"))
    joined = on_time.read().withColumnRenamed("packets", "in_time").join(counted, "start", "full")
    return joined.select("start", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_time", "behind")])


def distinct_packets(packets: DataFrame, late: str = LATE, key: str = "packet_id") -> DataFrame:
    """Each packet once, ahead of scoring, counters or sessions.

    A key is remembered until ``late`` after its time, so state is bounded. A repeat that comes later than that lies behind
    the watermark and is dropped as a late row, like any other row behind it.
    """
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def reviewed_alerts(alerts: DataFrame, decisions: DataFrame, within: str = "1 day", late: str = LATE) -> DataFrame:
    """Live alerts with the decisions that reviewers make ``within`` some time after them: both sides are streams.

    Every pair is emitted when its later side comes; an alert without a decision is emitted once, with nulls, when the
    watermarks of both sides have passed its time limit. Decisions beyond it are not joined.
    """
    left = alerts.withWatermark("timestamp", late)
    right = decisions.select(F.col("alert_id"), F.col("status").alias("decision"), "decided_at").withWatermark("decided_at", late)
    fits = (F.col("id") == F.col("alert_id")) & (F.col("decided_at") >= F.col("timestamp")) & (F.col("decided_at") <= F.col("timestamp") + F.expr(f"interval {within}"))
    return left.join(right, fits, "left").drop("alert_id")


def _each_batch(rows: DataFrame, save, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(**trigger).start()


def port_scans(packets: DataFrame, width: str = "1 minute", late: str = LATE, min_ports: int = 10, slide: str | None = None) -> DataFrame:
    if not slide:
        return detectors.port_scan(packets.withWatermark("ts", late), width, min_ports=min_ports, approximate=True)
    found = panes.sliding(detectors.syn(packets.withWatermark("ts", late)), ["src"], width, slide, counts={"syn_packets": F.lit(1)}, distinct={"ports": F.col("dport")})
    return found.filter(F.col("ports") >= min_ports)


def brute_force(packets: DataFrame, width: str = "5 minutes", late: str = LATE, min_attempts: int = 5, slide: str | None = None) -> DataFrame:
    if not slide:
        return detectors.brute_force(packets.withWatermark("ts", late), width, min_attempts=min_attempts)
    found = panes.sliding(detectors.logins(packets.withWatermark("ts", late)), ["src", "dst", "dport"], width, slide, counts={"attempts": F.lit(1)})
    return found.filter(F.col("attempts") >= min_attempts)


def floods(packets: DataFrame, width: str = "1 minute", late: str = LATE, min_sources: int = 20, min_packets: int = 100, slide: str | None = None) -> DataFrame:
    if not slide:
        return detectors.flood(packets.withWatermark("ts", late), width, min_sources=min_sources, min_packets=min_packets, approximate=True)
    found = panes.sliding(detectors.requests(packets.withWatermark("ts", late)), ["dst", "dport"], width, slide, counts={"packets": F.lit(1)}, distinct={"sources": F.col("src")})
    return found.filter((F.col("sources") >= min_sources) & (F.col("packets") >= min_packets))


def exfiltration(packets: DataFrame, width: str = "10 minutes", late: str = LATE, min_bytes: int = 10_000_000, slide: str | None = None) -> DataFrame:
    if not slide:
        return detectors.exfiltration(packets.withWatermark("ts", late), width, min_bytes=min_bytes)
    sums = {"bytes_out": F.col("len"), "marker_hits": detectors.encoded().cast("int")}
    found = panes.sliding(detectors.outward(packets.withWatermark("ts", late)), ["src"], width, slide, counts=sums)
    return found.filter((F.col("marker_hits") > 0) | (F.col("bytes_out") >= min_bytes))


def beaconing(packets: DataFrame, width: str = "1 hour", late: str = LATE, min_packets: int = 3, slot: str = "10 seconds") -> DataFrame:
    """Pairs that contact a control endpoint, per interval, with mean and deviation of the gaps between their packets.

    The packets of a pair are ordered within a ``slot`` only, which must divide ``width``; the interval then joins the edges of
    its slots. So state holds the times of open slots and a few numbers for each slot of an open interval, and a hot pair is
    spread over its slots.
    """
    linked = packets.withWatermark("ts", late).filter("src is not null and dst is not null")
    slots = linked.groupBy("src", "dst", F.window("ts", slot)).agg(
        F.sort_array(F.collect_list(F.unix_micros("ts"))).alias("t"), F.count_if(detectors.control_endpoint()).alias("endpoint_hits")
    )
    gap_s = lambda later, earlier: (later - earlier) / 1e6
    square = lambda x: x * x
    t = F.col("t")
    inside = F.transform(F.slice(t, F.lit(2), F.size(t)), lambda x, i: square(gap_s(x, F.get(t, i))))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    edges = F.struct(F.get(t, F.lit(0)).alias("first"), F.get(t, F.size(t) - 1).alias("last"), F.size(t).alias("n"), total(inside).alias("squares"))
    parts = slots.select("src", "dst", F.window_time("window").alias("at"), "endpoint_hits", edges.alias("part"))
    found = parts.groupBy("src", "dst", F.window("at", width)).agg(
        F.sum("part.n").alias("packets"), F.sum("endpoint_hits").alias("endpoint_hits"), F.sort_array(F.collect_list("part")).alias("p")
    )
    suspects = found.filter((F.col("endpoint_hits") > 0) & (F.col("packets") >= min_packets))
    p, gaps = F.col("p"), F.col("packets") - 1
    across = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: square(gap_s(x["first"], F.get(p, i)["last"])))
    squares = total(F.transform(p, lambda x: x["squares"])) + total(across)
    mean = gap_s(F.get(p, F.size(p) - 1)["last"], F.get(p, F.lit(0))["first"]) / gaps
    return suspects.select(
        "src", "dst", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "packets", "endpoint_hits", mean.alias("mean_gap_s"),
        F.sqrt(F.greatest(squares / gaps - square(mean), F.lit(0.0))).alias("std_gap_s"),
    )


def attack_episodes(scored: DataFrame, gap: str = "300 seconds", late: str = LATE, threshold: float = 0.7) -> DataFrame:
    """Runs of alerts per source and category, closed by inactivity, from scored packets."""
    found = A.packet_alerts(scored.withWatermark("ts", late), threshold).groupBy("src_ip", "category", F.session_window("ts", gap)).agg(
        F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("alerts")
    )
    return found.select("src_ip", "category", F.col("session_window.start").alias("start"), F.col("last_seen").alias("end"), "alerts")


def signature_hits(packets: DataFrame, user_signatures: DataFrame | None = None) -> DataFrame:
    """Signature matches of each packet; the signature table is a static side."""
    return signatures.matches(packets, user_signatures)


def with_services(packets: DataFrame) -> DataFrame:
    return traffic.with_services(packets)


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Append finished rows to Parquet files, exactly once."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all written intervals."""
    rows = spark.read.schema("start timestamp, dimension string, value string, packets bigint").parquet(path)
    return rows.groupBy("dimension", "value").agg(F.sum("packets").alias("packets"))


def write_detections(
    scored: DataFrame, path: str, checkpoint: str, threshold: float = 0.7, available_now: bool = False, every: str = "1 minute", writer: str = "stream"
) -> StreamingQuery:
    """Append every scored packet to the store as a detection, and an alert for those decided malicious above the threshold.

    The tables are those of :class:`Store`, by day. Rows carry the number of their batch; a batch that is already there is
    not appended again, and alert ids derive from the detection, so a replay changes nothing. Queries that write to the
    same store need different ``writer`` names.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        store, name = Store(batch.sparkSession, path), f"{writer}:{batch_id:012d}"
        vector = "feature_data" if "feature_data" in batch.columns else None
        rows = A.detections_from(batch, vector).persist()
        try:
            store.append("detections", rows, name)
            store.append("alerts", A.alerts_from(rows, threshold), name)
        finally:
            rows.unpersist()

    return _each_batch(scored, save, checkpoint, available_now, every)


def retained(df: DataFrame, as_of: str | None, keep: str, ts: str = "timestamp") -> DataFrame:
    """Rows younger than ``keep`` (an interval such as ``7 days``) at ``as_of``; without it, at the time of the query or stream batch."""
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return df.filter(F.col(ts) > now - F.expr(f"interval {keep}"))
