"""Column layouts of the packet stream and of the stored tables, as name -> SQL type."""

PACKET = {
    "packet_id": "bigint", "ts": "timestamp", "src": "string", "dst": "string", "proto": "string", "sport": "int",
    "dport": "int", "flags": "int", "len": "int", "ttl": "int", "frag": "boolean", "icmp_type": "int",
    "icmp_code": "int", "payload": "string", "is_malicious": "boolean",
}

# Raw event log the packet view is derived from.
EVENTS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}

TABLES = {
    "detections": {
        "id": "bigint", "timestamp": "timestamp", "src_ip": "string", "dst_ip": "string", "src_port": "int",
        "dst_port": "int", "protocol": "string", "length": "int", "is_malicious": "boolean", "confidence": "double",
        "feature_data": "array<double>", "packet_data": "string",
    },
    "alerts": {
        "id": "string", "detection_id": "bigint", "timestamp": "timestamp", "status": "string",
        "admin_notes": "string", "reviewed_at": "timestamp",
    },
    "alert_decisions": {
        "alert_id": "string", "status": "string", "admin_notes": "string", "decided_at": "timestamp",
    },
    "model_feedback": {
        "id": "bigint", "timestamp": "timestamp", "feature_data": "array<double>", "label": "int",
        "alert_id": "string",
    },
    "training_history": {
        "id": "bigint", "timestamp": "timestamp", "model_type": "string", "training_type": "string",
        "dataset_size": "bigint", "accuracy": "double", "precision": "double", "recall": "double",
        "f1_score": "double", "false_positive_rate": "double", "training_time": "double",
    },
    "dpi_signatures": {
        "id": "bigint", "name": "string", "pattern": "string", "description": "string", "category": "string",
        "is_active": "boolean", "created_at": "timestamp", "updated_at": "timestamp",
    },
}

# Day-partitioned tables: the partition column ``dt`` is derived from the event time on write.
DAY_PARTITIONED = ("detections", "alerts", "alert_decisions", "model_feedback")


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
