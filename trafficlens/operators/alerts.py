"""Detections, alerts, reviewer decisions and feedback."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trafficlens import schema
from trafficlens.functions import header as H
from trafficlens.functions import rules
from trafficlens.functions import text as X
from trafficlens.sources import folded
from trafficlens.sources.folded import FoldedLog

def detections_from(scored: DataFrame, features: str | None = None, decision: str | None = None) -> DataFrame:
    """Detection rows from scored packets; ``is_malicious`` is the decision, the packet is kept as JSON with its truth.

    The decision is ``decision``, else the model's ``is_predicted_malicious``, else (packets that were never scored) the truth.
    """
    vector = F.col(features) if features else F.lit(None).cast("array<double>")
    decided = decision or ("is_predicted_malicious" if "is_predicted_malicious" in scored.columns else "is_malicious")
    packet = [c for c in (*schema.PACKET, "window") if c in scored.columns]
    return scored.select(
        F.col("packet_id").alias("id"), F.col("ts").alias("timestamp"),
        F.coalesce("src", F.lit("unknown")).alias("src_ip"), F.coalesce("dst", F.lit("unknown")).alias("dst_ip"),
        F.coalesce("sport", F.lit(0)).alias("src_port"), F.coalesce("dport", F.lit(0)).alias("dst_port"),
        F.coalesce("proto", F.lit("unknown")).alias("protocol"), F.coalesce("len", F.lit(0)).alias("length"),
        F.col(decided).alias("is_malicious"), "confidence", vector.alias("feature_data"),
        F.to_json(F.struct(*packet), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("packet_data"),
    )


def alerts_from(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pending alert for every malicious detection above the threshold."""
    hit = detections.filter(rules.raises_alert(F.col("is_malicious"), F.col("confidence"), threshold))
    return hit.select(
        rules.alert_id(F.col("id")).alias("id"), F.col("id").alias("detection_id"), "timestamp",
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("admin_notes"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def packet_alerts(packets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Alerts with their text, category and severity, straight from scored packets."""
    hit = packets.filter(rules.raises_alert(F.col("is_malicious"), F.col("confidence"), threshold))
    described = hit.withColumn("description", rules.packet_attack_description())
    return described.select(
        rules.alert_id(F.col("packet_id")).alias("id"), "packet_id", "ts", F.col("src").alias("src_ip"),
        F.col("dst").alias("dst_ip"), F.col("proto").alias("protocol"), "confidence",
        rules.severity(F.col("confidence")).alias("severity"), "description",
        rules.attack_category(F.col("description")).alias("category"), F.lit("pending").alias("status"),
    )


def detections_with_alerts(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every detection with its alerts, if any."""
    a = alerts.select(F.col("id").alias("alert_id"), "detection_id", "status", "reviewed_at")
    return detections.join(a, detections["id"] == a["detection_id"], "left").drop("detection_id")


def alerts_with_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    f = feedback.filter("alert_id is not null").select("alert_id", "label", F.col("timestamp").alias("feedback_at"))
    return alerts.join(f, alerts["id"] == f["alert_id"], "left").drop("alert_id")


def resolve_status(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts in their current state: the newest decision wins, decisions on unknown alerts do nothing."""
    order = F.struct("decided_at", "status")
    latest = decisions.groupBy("alert_id").agg(
        F.max_by(F.struct("status", "admin_notes", "decided_at"), order).alias("_d")
    )
    joined = alerts.join(latest, alerts["id"] == latest["alert_id"], "left")
    return joined.select(
        *[c for c in alerts.columns if c not in ("status", "admin_notes", "reviewed_at")],
        F.coalesce("_d.status", "status").alias("status"),
        F.coalesce("_d.admin_notes", "admin_notes" if "admin_notes" in alerts.columns else F.lit(None)).alias("admin_notes"),
        F.col("_d.decided_at").alias("reviewed_at"),
    )


def decision_log(spark: SparkSession, path: str) -> FoldedLog:
    """Reviewer decisions that are read as the newest per alert, however long the log is."""
    return FoldedLog(spark, path, schema.ddl(schema.TABLES["alert_decisions"]).replace("`", ""), folded.newest_per("alert_id", ["decided_at", "status"]))


def feedback_from(resolved: DataFrame, detections: DataFrame) -> DataFrame:
    """Feedback rows for confirmed (1) and rejected (0) alerts, with the vector of their detection."""
    verdict = resolved.filter(F.col("status").isin("confirmed", "rejected")).select(
        F.col("id").alias("alert_id"), "detection_id", F.col("reviewed_at").alias("_at"),
        (F.col("status") == "confirmed").cast("int").alias("label"),
    )
    d = detections.select(F.col("id").alias("detection_id"), "feature_data")
    return verdict.join(d, "detection_id").select(
        F.col("detection_id").alias("id"), F.col("_at").alias("timestamp"), "feature_data", "label", "alert_id"
    )


def history(processed: DataFrame, alerts: DataFrame) -> DataFrame:
    """Processed alerts plus every other alert, one row per id."""
    rest = alerts.join(processed.select("id"), "id", "left_anti")
    return processed.unionByName(rest)


def history_listing(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("ts").alias("timestamp"), F.col("src_ip").alias("source"), F.col("dst_ip").alias("destination"),
        F.upper("protocol").alias("protocol"), "severity", F.coalesce("status", F.lit("pending")).alias("status"),
        "description",
    )


def by_status(alerts: DataFrame, status: str | None = None) -> DataFrame:
    return alerts.filter(F.col("status") == status) if status else alerts


def pending(alerts: DataFrame) -> DataFrame:
    return by_status(alerts, "pending")


def by_truth(detections: DataFrame, is_malicious: bool | None = None) -> DataFrame:
    return detections if is_malicious is None else detections.filter(F.col("is_malicious") == is_malicious)


def by_id(df: DataFrame, value, column: str = "id") -> DataFrame:
    return df.filter(F.col(column) == value).limit(1)


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def severity_timeline(alerts: DataFrame, width: str = "10 minutes") -> DataFrame:
    return alerts.groupBy(X.bin_start(F.col("ts"), width).alias("time_bin"), "severity").agg(
        F.count(F.lit(1)).alias("alerts")
    )


def category_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("category").agg(F.count(F.lit(1)).alias("alerts"))


def status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("active_alerts"), F.count_if(F.col("status") == "pending").alias("pending_alerts"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Confirmed and rejected feedback with the share of confirmed rows."""
    counts = feedback.agg(
        F.count(F.lit(1)).alias("feedback"), F.count_if(F.col("label") == 1).alias("confirmed"),
        F.count_if(F.col("label") == 0).alias("rejected"),
    )
    return counts.withColumn("balance_ratio", F.col("confirmed") / F.greatest(F.lit(1), F.col("feedback")))


def feedback_timeline(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(
        X.minute(F.col("timestamp")).alias("minute"), rules.feedback_type(F.col("label")).alias("type")
    ).agg(F.count(F.lit(1)).alias("feedback"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def threat_ratios(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """Malicious, alert, false-positive and true-positive ratios from both tables in one aggregate."""
    d = detections.select(F.lit("d").alias("kind"), F.coalesce("is_malicious", F.lit(False)).alias("bad"), F.lit("").alias("status"))
    a = alerts.select(F.lit("a").alias("kind"), F.lit(False).alias("bad"), "status")
    t = d.unionByName(a).agg(
        F.count_if(F.col("kind") == "d").alias("packets"), F.count_if("bad").alias("malicious"),
        F.count_if(F.col("kind") == "a").alias("alerts"), F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )
    c = F.col
    return t.select(
        _ratio(c("malicious"), c("packets")).alias("malicious_ratio"), _ratio(c("alerts"), c("packets")).alias("alert_ratio"),
        _ratio(c("rejected"), c("alerts")).alias("false_positive_ratio"),
        _ratio(c("confirmed"), c("alerts")).alias("true_positive_ratio"),
    )


def run_counters(detections: DataFrame, alerts: DataFrame, training: DataFrame) -> DataFrame:
    """Processed packets, alerts, confirmed, rejected and retrainings, counted in one pass over the union."""
    tagged = (
        detections.select(F.lit("processed").alias("kind"))
        .unionByName(alerts.select(F.concat(F.lit("alert_"), "status").alias("kind")))
        .unionByName(training.filter("training_type = 'retraining'").select(F.lit("retraining").alias("kind")))
    )
    kind = F.col("kind")
    return tagged.agg(
        F.count_if(kind == "processed").alias("packets_processed"),
        F.count_if(kind.startswith("alert_")).alias("alerts_generated"),
        F.count_if(kind == "alert_confirmed").alias("admin_confirmed"),
        F.count_if(kind == "alert_rejected").alias("admin_rejected"),
        F.count_if(kind == "retraining").alias("retraining_count"),
    )


def retraining_readiness(feedback: DataFrame, training: DataFrame, as_of: Column, min_rows: int = 5, wait_s: int = 300) -> DataFrame:
    """Whether there is enough feedback and the last training is long enough ago."""
    tagged = feedback.select(F.lit(1).alias("n"), F.lit(None).cast("timestamp").alias("at")).unionByName(
        training.select(F.lit(0).alias("n"), F.col("timestamp").alias("at"))
    )
    state = tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("feedback"), F.max("at").alias("last_trained"))
    age = F.unix_seconds(as_of) - F.unix_seconds("last_trained")
    due = F.col("last_trained").isNull() | (age > wait_s)
    return state.select(
        "feedback", "last_trained", ((F.col("feedback") > min_rows) & due).alias("recommended"),
        (F.col("feedback") >= min_rows).alias("enabled"),
        F.greatest(F.lit(0), F.lit(min_rows) - F.col("feedback")).alias("missing_rows"),
    )


METRICS = ("accuracy", "precision", "recall", "f1_score", "false_positive_rate")


def metrics_long(training: DataFrame) -> DataFrame:
    """Training metrics as (run, metric, value) rows."""
    return training.unpivot(["timestamp", "model_type", "training_type"], list(METRICS), "metric", "value")


def metric_changes(training: DataFrame) -> DataFrame:
    """Change of every metric against the previous run of the same model type."""
    w = W.partitionBy("model_type", "metric").orderBy("timestamp")
    return metrics_long(training).select(
        "timestamp", "model_type", "metric", "value", (F.col("value") - F.lag("value").over(w)).alias("change")
    )


def training_listing(training: DataFrame) -> DataFrame:
    return training.select(
        F.col("timestamp"), F.col("model_type").alias("Model Type"), F.col("training_type").alias("Training Type"),
        F.col("dataset_size").alias("Dataset Size"), F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
        F.col("training_time").alias("Training Time (s)"),
    )


def packet_listing(packets: DataFrame) -> DataFrame:
    """Packet table as shown to an analyst."""
    return packets.select(
        "packet_id", X.clock(F.col("ts"), millis=True).alias("time"), F.coalesce("src", F.lit("Unknown")).alias("source"),
        F.coalesce("dst", F.lit("Unknown")).alias("destination"),
        F.upper(F.coalesce("proto", F.lit("Unknown"))).alias("protocol"), F.coalesce("len", F.lit(0)).alias("length"),
        H.hex_text(F.col("flags")).alias("flags"), F.coalesce(F.col("sport").cast("string"), F.lit("-")).alias("src_port"),
        F.coalesce(F.col("dport").cast("string"), F.lit("-")).alias("dst_port"),
        rules.status_text(F.col("is_malicious")).alias("status"),
    )


def header_view(packets: DataFrame) -> DataFrame:
    """Header fields by protocol; fields that do not apply are NULL."""
    proto = F.col("proto")
    ported = proto.isin("tcp", "udp")

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    return packets.select(
        "packet_id", X.time_text(F.col("ts")).alias("timestamp"), F.coalesce("src", F.lit("Unknown")).alias("source_ip"),
        F.coalesce("dst", F.lit("Unknown")).alias("destination_ip"),
        F.upper(F.coalesce("proto", F.lit("Unknown"))).alias("protocol"),
        F.concat(F.coalesce("len", F.lit(0)).cast("string"), F.lit(" bytes")).alias("length"),
        F.when(ported, shown("sport")).alias("source_port"), F.when(ported, shown("dport")).alias("destination_port"),
        F.when(proto == "tcp", H.flag_text(F.coalesce("flags", F.lit(0)))).alias("tcp_flags"),
        F.when(proto == "icmp", shown("icmp_type")).alias("icmp_type"),
        F.when(proto == "icmp", shown("icmp_code")).alias("icmp_code"),
    )
