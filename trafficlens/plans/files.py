"""Sources and sinks: everything written here is read back and compared with what went in."""

from pyspark.sql import functions as F

from trafficlens.functions import text as X
from trafficlens.operators.features import FEATURE_NAMES
from trafficlens.plans.oracle import over, time_text
from trafficlens.plans.registry import query
from trafficlens.session import new_folder
from trafficlens.sources import files, views as V
from trafficlens.sources.store import Store

FLOW_SCHEMA = "packet_id bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, pkt_len int, tcp_flags int, ttl int, label string"
FLOW_SQL = "select packet_id, src as src_ip, dst as dst_ip, sport as src_port, dport as dst_port, proto as protocol, len as pkt_len, flags as tcp_flags, ttl, case when is_malicious then 'Attack' else 'BENIGN' end as label from packets"


def _flows(spark, sf):
    return V.raw_flows(spark, sf).drop("timestamp", "payload")


@query("s1_s4_csv_files", over(FLOW_SQL, "packets"))
def _(spark, sf):
    path = new_folder(spark, "csv")
    files.write_csv(_flows(spark, sf), path)
    return files.read_csv(spark, path, FLOW_SCHEMA)


@query("s2_s3_json_files", over(FLOW_SQL, "packets"))
def _(spark, sf):
    path = new_folder(spark, "json")
    files.write_json(_flows(spark, sf), path)
    return files.read_json(spark, path, FLOW_SCHEMA)


@query("s5_append_detections", over(f'select id, {time_text(chr(34) + "timestamp" + chr(34))} as "timestamp", src_ip, dst_port, is_malicious, confidence, 35 as width from detections', "detections"))
def _(spark, sf):
    store, rows = Store(spark, new_folder(spark, "store")), V.detections(spark, sf, vectors=True)
    store.append("detections", rows.filter("is_malicious"))
    store.append("detections", rows.filter("not is_malicious"))
    stored = store.read("detections").select("id", "timestamp", "src_ip", "dst_port", "is_malicious", "confidence", F.size("feature_data").alias("width"))
    return stored.withColumn("timestamp", X.time_text(F.col("timestamp")))


@query("s6_append_alerts", over("select id, detection_id, status from alerts", "alerts"))
def _(spark, sf):
    store = Store(spark, new_folder(spark, "store"))
    store.append("alerts", V.alerts(spark, sf))
    return store.read("alerts").select("id", "detection_id", "status")


@query("s7_append_feedback", over("select id, label, alert_id, 35 as width, round(port_value, 6) as port_value, round(size_value, 6) as size_value from feedback", "feedback"))
def _(spark, sf):
    store = Store(spark, new_folder(spark, "store"))
    store.append("model_feedback", V.feedback(spark, sf, vectors=True))
    vector = F.col("feature_data")
    values = [F.round(vector[FEATURE_NAMES.index(n)], 6).alias(a) for n, a in (("dest_port_numeric", "port_value"), ("packet_size", "size_value"))]
    return store.read("model_feedback").select("id", "label", "alert_id", F.size(vector).alias("width"), *values)


@query("s8_append_training", over("select id, dataset_size, round(accuracy, 6) as accuracy, 0.0e0 as recall from training_history", "training_history"))
def _(spark, sf):
    store = Store(spark, new_folder(spark, "store"))
    store.append_training(V.training_history(spark, sf).drop("recall"))
    return store.read("training_history").select("id", "dataset_size", F.round("accuracy", 6).alias("accuracy"), "recall")


@query("s9_create_tables", over("select id, dataset_size, training_type from training_history", "training_history"))
def _(spark, sf):
    path = new_folder(spark, "store")
    store, prefix = Store(spark, path), "t" + path.rsplit("-", 1)[1] + "_"
    store.create_tables(prefix=prefix)
    store.append_training(V.training_history(spark, sf))
    rows = spark.table(f"{prefix}training_history").select("id", "dataset_size", "training_type").collect()
    # The result is a few rows; the catalog is left as it was.
    store.drop_tables(prefix=prefix)
    return spark.createDataFrame(rows, "id bigint, dataset_size bigint, training_type string")
