"""Detections, alerts, reviews, feedback, training history and signature maintenance."""

from pyspark.sql import functions as F

from trafficlens.functions import rules as R
from trafficlens.functions import text as X
from trafficlens.operators import alerts as A
from trafficlens.operators import ranking as RK
from trafficlens.operators import signatures as SG
from trafficlens.plans.oracle import over, time_text
from trafficlens.plans.registry import query
from trafficlens.session import new_folder
from trafficlens.sources import views as V

AS_OF = "2024-02-01 00:00:00"


def _time(*columns):
    return {c: X.time_text(F.col(c)) for c in columns}


def _resolved(spark, sf):
    return A.resolve_status(V.alerts(spark, sf), V.decisions(spark, sf))


TS = f'{time_text(chr(34) + "timestamp" + chr(34))} as "timestamp"'
DET = f"id, {TS}, src_ip, dst_ip, src_port, dst_port, protocol, length, is_malicious, confidence"


def _detection_rows(df):
    columns = ("id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "is_malicious", "confidence")
    return df.select(*columns).withColumns(_time("timestamp"))


# --- detections ---


@query("p13_detections_by_truth", over(f"select {DET} from detections where is_malicious", "detections"))
def _(spark, sf):
    return _detection_rows(A.by_truth(V.detections(spark, sf), True))


@query("p15_detection_by_id", over(f"select {DET} from detections where id = 17", "detections"))
def _(spark, sf):
    return _detection_rows(A.by_id(V.detections(spark, sf), 17))


@query("p17_alert_condition", over("select id, is_malicious and confidence > 0.7 as alert from detections", "detections"))
def _(spark, sf):
    return V.detections(spark, sf).select("id", R.raises_alert(F.col("is_malicious"), F.col("confidence")).alias("alert"))


@query("l1_newest_detections", over(f'select {DET} from (select * from detections order by "timestamp" desc, id desc limit 100 offset 50) q', "detections"))
def _(spark, sf):
    return _detection_rows(RK.newest(V.detections(spark, sf), 100, 50))


@query("l8_retained_detections", over('select id from (select * from detections order by "timestamp" desc, id desc limit 1000) q', "detections"))
def _(spark, sf):
    return RK.newest(V.detections(spark, sf), 1000).select("id")


@query("l9_recent_packets", over("select packet_id from packets order by ts desc, packet_id desc limit 20", "packets"))
def _(spark, sf):
    return RK.newest(V.packets(spark, sf), 20, ts="ts", key="packet_id").select("packet_id")


@query("l11_seeded_sample", "select event_id from events order by md5('42:' || cast(event_id as varchar)), event_id limit 1000")
def _(spark, sf):
    return RK.seeded_sample(V.table(spark, sf, "events"), "event_id", 1000, 42).select("event_id")


# --- alerts ---


@query("s6_alerts", over(f"select id, detection_id, {TS}, status from alerts", "alerts"))
def _(spark, sf):
    return V.alerts(spark, sf).select("id", "detection_id", X.time_text(F.col("timestamp")).alias("timestamp"), "status")


@query("p14_alerts_by_status", over("select id, detection_id, status, admin_notes from resolved where status = 'confirmed'", "resolved"))
def _(spark, sf):
    return A.by_status(_resolved(spark, sf), "confirmed").select("id", "detection_id", "status", "admin_notes")


@query("p20_pending_alerts", over("select id, detection_id from resolved where status = 'pending'", "resolved"))
def _(spark, sf):
    return A.pending(_resolved(spark, sf)).select("id", "detection_id")


@query("l2_newest_alerts", over('select id from (select * from alerts order by "timestamp" desc, id desc limit 100) q', "alerts"))
def _(spark, sf):
    return RK.newest(V.alerts(spark, sf), 100).select("id")


@query("j1_detections_with_alerts", over("select d.id, d.confidence, a.id as alert_id, a.status from detections d left join alerts a on a.detection_id = d.id", "detections", "alerts"))
def _(spark, sf):
    return A.detections_with_alerts(V.detections(spark, sf), V.alerts(spark, sf)).select("id", "confidence", "alert_id", "status")


@query("j2_alerts_with_feedback", over("select a.id, a.detection_id, f.label from alerts a left join feedback f on f.alert_id = a.id", "alerts", "feedback"))
def _(spark, sf):
    return A.alerts_with_feedback(V.alerts(spark, sf), V.feedback(spark, sf)).select("id", "detection_id", "label")


@query("j6_resolved_alerts", over(f"select id, detection_id, status, admin_notes, {time_text('reviewed_at')} as reviewed_at from resolved", "resolved"))
def _(spark, sf):
    r = _resolved(spark, sf)
    return r.select("id", "detection_id", "status", "admin_notes", X.time_text(F.col("reviewed_at")).alias("reviewed_at"))


@query("j6_compacted_decisions", over(f"select id, detection_id, status, admin_notes, {time_text('reviewed_at')} as reviewed_at from resolved", "resolved"))
def _(spark, sf):
    """The decision log in four portions, folded twice on the way: readers touch a snapshot and what came after it."""
    log = A.decision_log(spark, new_folder(spark, "decisions"))
    decisions = V.decisions(spark, sf)
    for k in range(4):
        log.append(decisions.filter(F.pmod(F.xxhash64("alert_id", "decided_at"), F.lit(4)) == k))
        if k in (1, 2):
            log.compact()
    r = A.resolve_status(V.alerts(spark, sf), log.read())
    return r.select("id", "detection_id", "status", "admin_notes", X.time_text(F.col("reviewed_at")).alias("reviewed_at"))


@query("j10_alert_history", over("select id, status from resolved where status <> 'pending' union all select id, status from alerts where id not in (select id from resolved where status <> 'pending')", "resolved"))
def _(spark, sf):
    processed = _resolved(spark, sf).filter("status <> 'pending'").select("id", "status")
    return A.history(processed, V.alerts(spark, sf).select("id", "status"))


LISTING = f"select {time_text('ts')} as \"timestamp\", src_ip as source, dst_ip as destination, upper(protocol) as protocol, severity, coalesce(status, 'pending') as status, description from packet_alerts"


@query("p25_alert_history_listing", over(LISTING, "packet_alerts"))
def _(spark, sf):
    return A.history_listing(V.described_alerts(spark, sf)).withColumns(_time("timestamp"))


@query("l10_history_by_time", over(LISTING + " order by ts desc, id desc", "packet_alerts"))
def _(spark, sf):
    newest = V.described_alerts(spark, sf).orderBy(F.desc("ts"), F.desc("id"))
    return A.history_listing(newest).withColumns(_time("timestamp"))


@query("a11_severity_counts", over("select severity, count(*) as alerts from packet_alerts group by 1", "packet_alerts"))
def _(spark, sf):
    return A.severity_counts(V.described_alerts(spark, sf))


@query("a12_severity_timeline", over("select strftime(b, '%Y-%m-%d %H:%M:%S') as time_bin, severity, n as alerts from (select time_bucket(interval '10 minutes', ts) as b, severity, count(*) as n from packet_alerts group by 1, 2) q", "packet_alerts"))
def _(spark, sf):
    return A.severity_timeline(V.described_alerts(spark, sf)).withColumns(_time("time_bin"))


@query("a16_attack_categories", over("select category, count(*) as alerts from packet_alerts group by 1", "packet_alerts"))
def _(spark, sf):
    return A.category_counts(V.described_alerts(spark, sf))


@query("a36_alert_counts", over("select count(*) as active_alerts, count(*) filter (status = 'pending') as pending_alerts from resolved", "resolved"))
def _(spark, sf):
    return A.status_counts(_resolved(spark, sf))


@query(
    "a20_threat_ratios",
    over("""select round(m / n, 6) as malicious_ratio, round(a / n, 6) as alert_ratio, round(r / a, 6) as false_positive_ratio, round(c / a, 6) as true_positive_ratio from
 (select cast((select count(*) from detections) as double) as n, cast((select count(*) from detections where is_malicious) as double) as m,
 cast((select count(*) from resolved) as double) as a, cast((select count(*) from resolved where status = 'confirmed') as double) as c, cast((select count(*) from resolved where status = 'rejected') as double) as r) q""", "detections", "resolved"),
)
def _(spark, sf):
    t = A.threat_ratios(V.detections(spark, sf), _resolved(spark, sf))
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query(
    "a38_run_counters",
    over("""select (select count(*) from detections) as packets_processed, (select count(*) from resolved) as alerts_generated,
 (select count(*) from resolved where status = 'confirmed') as admin_confirmed, (select count(*) from resolved where status = 'rejected') as admin_rejected,
 (select count(*) from training_history where training_type = 'retraining') as retraining_count""", "detections", "resolved", "training_history"),
)
def _(spark, sf):
    return A.run_counters(V.detections(spark, sf), _resolved(spark, sf), V.training_history(spark, sf))


# --- feedback ---


@query("l3_latest_feedback", over('select id, label, round(port_value, 6) as port_value from (select * from feedback order by "timestamp" desc, id desc limit 1000) q', "feedback"))
def _(spark, sf):
    stored = V.feedback(spark, sf, vectors=True).withColumn("feature_json", F.to_json("feature_data"))
    newest = RK.newest(stored, 1000)
    decoded = F.from_json("feature_json", "array<double>")
    return newest.select("id", "label", F.round(decoded[3], 6).alias("port_value"))


@query(
    "a17_a18_feedback_balance",
    over("select count(*) as feedback, count(*) filter (label = 1) as confirmed, count(*) filter (label = 0) as rejected, round(count(*) filter (label = 1) / cast(greatest(1, count(*)) as double), 6) as balance_ratio from feedback", "feedback"),
)
def _(spark, sf):
    return A.feedback_counts(V.feedback(spark, sf)).withColumn("balance_ratio", F.round("balance_ratio", 6))


FEEDBACK_TYPE = "case label when 0 then 'Benign (Rejected)' when 1 then 'Malicious (Confirmed)' end"


@query("a35_feedback_timeline", over(f"select {time_text('m')} as \"minute\", type, n as feedback from (select date_trunc('minute', \"timestamp\") as m, {FEEDBACK_TYPE} as type, count(*) as n from feedback group by 1, 2) q", "feedback"))
def _(spark, sf):
    return A.feedback_timeline(V.feedback(spark, sf)).withColumns(_time("minute"))


@query("f26_feedback_type", over(f"select id, {FEEDBACK_TYPE} as type from feedback", "feedback"))
def _(spark, sf):
    return V.feedback(spark, sf).select("id", R.feedback_type(F.col("label")).alias("type"))


# --- training history ---

RUN_METRICS = ("accuracy", "precision", "recall", "f1_score", "false_positive_rate")
LONG = " union all ".join(f"select \"timestamp\", model_type, training_type, '{m}' as metric, {m} as value from training_history" for m in RUN_METRICS)


@query("l4_latest_training", over(f'select id, {TS}, dataset_size, round(accuracy, 6) as accuracy from (select * from training_history order by "timestamp" desc, id desc limit 20) q', "training_history"))
def _(spark, sf):
    newest = RK.newest(V.training_history(spark, sf), 20)
    return newest.select("id", X.time_text(F.col("timestamp")).alias("timestamp"), "dataset_size", F.round("accuracy", 6).alias("accuracy"))


@query(
    "p24_training_listing",
    over(f"""select {TS}, model_type as "Model Type", training_type as "Training Type", dataset_size as "Dataset Size", round(accuracy, 6) as "Accuracy",
 round(precision, 6) as "Precision", round(recall, 6) as "Recall", cast(training_time as double) as "Training Time (s)" from training_history""", "training_history"),
)
def _(spark, sf):
    t = A.training_listing(V.training_history(spark, sf)).withColumns(_time("timestamp"))
    return t.withColumns({c: F.round(c, 6) for c in ("Accuracy", "Precision", "Recall")})


@query("f28_metrics_long", over(f"select {TS}, training_type, metric, round(value, 6) as value from ({LONG}) q", "training_history"))
def _(spark, sf):
    long = A.metrics_long(V.training_history(spark, sf)).drop("model_type")
    return long.withColumns({**_time("timestamp"), "value": F.round("value", 6)})


@query("a37_metric_changes", over(f'select {TS}, model_type, metric, round(value, 6) as value, round(value - lag(value) over (partition by model_type, metric order by "timestamp"), 6) as change from ({LONG}) q', "training_history"))
def _(spark, sf):
    changes = A.metric_changes(V.training_history(spark, sf))
    return changes.withColumns({**_time("timestamp"), "value": F.round("value", 6), "change": F.round("change", 6) + 0.0})


@query(
    "a33_retraining_readiness",
    over(f"""select n as feedback, {time_text('t')} as last_trained, n > 5 and (t is null or epoch(timestamp '{AS_OF}') - epoch(t) > 300) as recommended, n >= 5 as enabled,
 greatest(0, 5 - n) as missing_rows from (select (select count(*) from feedback) as n, (select max("timestamp") from training_history) as t) q""", "feedback", "training_history"),
)
def _(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp")
    ready = A.retraining_readiness(V.feedback(spark, sf), V.training_history(spark, sf), as_of)
    return ready.withColumns(_time("last_trained"))


# --- signatures ---


def _merged(spark, sf):
    return SG.upsert(V.signatures(spark, sf), V.signature_additions(spark, sf))


SIGNATURE = f"id, name, pattern, description, category, is_active, {time_text('created_at')} as created_at, {time_text('updated_at')} as updated_at"


@query("j7_upsert_signatures", over(f"select {SIGNATURE} from merged_signatures", "merged_signatures"))
def _(spark, sf):
    return _merged(spark, sf).withColumns(_time("created_at", "updated_at"))


def _compacted(log, entries, key):
    """``log`` after three portions of entries, folded after the second."""
    for k in range(3):
        log.append(entries.filter(F.pmod(F.xxhash64(key), F.lit(3)) == k))
        if k == 1:
            log.compact()
    return log


def _signature_log(spark, sf):
    log = SG.signature_log(spark, new_folder(spark, "signatures"))
    log.append(V.signatures(spark, sf))
    return _compacted(log, SG.log_entries(V.signature_additions(spark, sf)), "id")


@query("j7_compacted_signatures", over(f"select {SIGNATURE} from merged_signatures", "merged_signatures"))
def _(spark, sf):
    return _signature_log(spark, sf).read().select("id", "name", "pattern", "description", "category", "is_active", *[c.alias(n) for n, c in _time("created_at", "updated_at").items()])


@query("j8_compacted_toggles", over("select id, name, is_active from toggled", "merged_signatures", toggled="""select m.id, m.name, coalesce(t.is_active, m.is_active) as is_active from merged_signatures m left join
 (select s_nationkey as id, arg_max(s_acctbal > 3000, s_suppkey) as is_active from supplier group by 1) t on t.id = m.id"""))
def _(spark, sf):
    toggles = _compacted(SG.toggle_log(spark, new_folder(spark, "toggles")), V.signature_toggles(spark, sf), "changed_at")
    return SG.toggle(_signature_log(spark, sf).read(), toggles.read()).select("id", "name", "is_active")


TOGGLED = """select m.id, m.name, coalesce(t.is_active, m.is_active) as is_active, m.pattern, m.category from merged_signatures m left join
 (select s_nationkey as id, arg_max(s_acctbal > 3000, s_suppkey) as is_active from supplier group by 1) t on t.id = m.id"""


def _toggled(spark, sf):
    return SG.toggle(_merged(spark, sf), V.signature_toggles(spark, sf))


@query("j8_toggle_signatures", over("select id, name, is_active from toggled", "merged_signatures", toggled=TOGGLED))
def _(spark, sf):
    return _toggled(spark, sf).select("id", "name", "is_active")


@query("p16_active_signatures", over("select id, name from toggled where is_active", "merged_signatures", toggled=TOGGLED))
def _(spark, sf):
    return SG.active(_toggled(spark, sf)).select("id", "name")


@query("j9_delete_signatures", over("select id, name from merged_signatures where id not in (select s_nationkey from supplier where s_acctbal < 2000)", "merged_signatures"))
def _(spark, sf):
    gone = V.table(spark, sf, "supplier").filter("s_acctbal < 2000").select(F.col("s_nationkey").cast("bigint").alias("id"))
    return SG.delete(_merged(spark, sf), gone).select("id", "name")


@query("p23_signature_listing", over("select id, name, category, case when length(pattern) > 50 then pattern[1:50] || '...' else pattern end as pattern, is_active from toggled", "merged_signatures", toggled=TOGGLED))
def _(spark, sf):
    return SG.listing(_toggled(spark, sf))
