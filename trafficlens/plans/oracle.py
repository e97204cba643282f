"""Building blocks of the SQL texts: the derived tables as common table expressions."""

from trafficlens.sources.views import PACKET_COLUMNS


def time_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


DESCRIPTION = """case
 when lower(proto) = 'tcp' and flags = 2 then 'Possible port scan from ' || coalesce(src, '') || ' targeting port ' || cast(coalesce(dport, 0) as varchar) || ' on ' || coalesce(dst, '')
 when lower(proto) = 'tcp' and dport in (21, 22) and (contains(payload, 'USER') or contains(payload, 'PASS')) then 'Possible brute force attack on ' || case dport when 22 then 'SSH' else 'FTP' end || ' service'
 when lower(proto) = 'tcp' and dport in (80, 443) and ((contains(payload, chr(39)) and contains(payload, 'SELECT')) or contains(payload, ';') or contains(payload, '--')) then 'SQL Injection attempt detected'
 when lower(proto) = 'tcp' and dport in (80, 443) and (contains(payload, '<script>') or contains(payload, 'onerror=')) then 'Cross-site scripting (XSS) attempt detected'
 when lower(proto) = 'udp' and dport = 53 and length(payload) > 100 then 'Possible DNS tunneling detected'
 when lower(proto) = 'udp' and dport > 1024 and sport > 1024 then 'Suspicious UDP communication between unusual ports'
 when lower(proto) = 'icmp' then 'Suspicious ICMP packet detected, possible network mapping'
 when contains(payload, 'BASE64') then 'Potential data exfiltration with encoded content'
 when contains(payload, 'gate.php') or contains(payload, 'config.bin') or contains(payload, 'updates.js') or contains(payload, '/admin/') then 'Communication with potential C&C server detected'
 else 'Anomalous network traffic detected' end"""

CATEGORY = """case
 when contains(lower(description), 'port scan') then 'Port Scan'
 when contains(lower(description), 'brute force') then 'Brute Force'
 when contains(lower(description), 'injection') then 'Injection Attack'
 when contains(lower(description), 'xss') or contains(lower(description), 'cross-site') then 'XSS Attack'
 when contains(lower(description), 'exfiltration') or contains(lower(description), 'data') then 'Data Exfiltration'
 when contains(lower(description), 'dns') then 'DNS Attack'
 when contains(lower(description), 'ddos') or contains(lower(description), 'flood') then 'DDoS'
 when contains(lower(description), 'c&c') or contains(lower(description), 'command') or contains(lower(description), 'control') then 'C&C Communication'
 else 'Other' end"""

SEVERITY = "case when confidence > 0.85 then 'High' when confidence > 0.7 then 'Medium' else 'Low' end"


def internal(column: str) -> str:
    return f"(coalesce({column}, '') like '192.168.%' or coalesce({column}, '') like '10.%' or coalesce({column}, '') like '172.16.%')"


def metric_columns(cells: str = "") -> str:
    """Metrics from tn, fp, fn, tp of a table."""
    return """case when tp+tn+fp+fn > 0 then (tp+tn)/cast(tp+tn+fp+fn as double) else 0 end as accuracy,
 case when tp+fp > 0 then tp/cast(tp+fp as double) else 0 end as precision,
 case when tp+fn > 0 then tp/cast(tp+fn as double) else 0 end as recall,
 case when 2*tp+fp+fn > 0 then 2*tp/cast(2*tp+fp+fn as double) else 0 end as f1,
 case when fp+tn > 0 then fp/cast(fp+tn as double) else 0 end as false_positive_rate"""


CELLS = """count(*) filter (label = 0 and prediction = 0) as tn, count(*) filter (label = 0 and prediction = 1) as fp,
 count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 1 and prediction = 1) as tp"""

# name -> (needed names, body)
TABLES = {
    "packets": ((), "select " + ", ".join(f"{sql} as {name}" for name, sql in PACKET_COLUMNS.items()) + " from events"),
    "detections": (
        ("packets",),
        """select packet_id as id, ts as "timestamp", coalesce(src, 'unknown') as src_ip, coalesce(dst, 'unknown') as dst_ip,
 coalesce(sport, 0) as src_port, coalesce(dport, 0) as dst_port, coalesce(proto, 'unknown') as protocol,
 coalesce(len, 0) as length, is_malicious, cast((packet_id * 37) % 100 as double) / 100.0 as confidence from packets""",
    ),
    "alerts": (
        ("detections",),
        """select sha256(cast(id as varchar) || ':score') as id, id as detection_id, "timestamp", 'pending' as status
 from detections where is_malicious and confidence > 0.7""",
    ),
    "packet_alerts": (
        ("packets",),
        f"""select *, {CATEGORY} as category from (select sha256(cast(packet_id as varchar) || ':score') as id, packet_id, ts,
 src as src_ip, dst as dst_ip, proto as protocol, confidence, {SEVERITY} as severity, {DESCRIPTION} as description, 'pending' as status
 from (select *, cast((packet_id * 37) % 100 as double) / 100.0 as confidence from packets) q where is_malicious and confidence > 0.7) r""",
    ),
    "suspects": (("detections",), "select * from detections where is_malicious and confidence > 0.65"),
    "decisions": (
        ("suspects",),
        """select sha256(cast(id as varchar) || ':score') as alert_id, 'needs_analysis' as status, 'second look' as admin_notes, "timestamp" + interval 1 hour as decided_at from suspects where id % 3 = 0
 union all select sha256(cast(id as varchar) || ':score'), 'confirmed', 'true positive', "timestamp" + interval 2 hour from suspects where id % 3 = 0
 union all select sha256(cast(id as varchar) || ':score'), 'rejected', 'false positive', "timestamp" + interval 1 hour from suspects where id % 3 = 1""",
    ),
    "resolved": (
        ("alerts", "decisions"),
        """select a.id, a.detection_id, a."timestamp", coalesce(d.status, a.status) as status, d.admin_notes, d.decided_at as reviewed_at
 from alerts a left join (select * from (select *, row_number() over (partition by alert_id order by decided_at desc) as rn from decisions) x where rn = 1) d on d.alert_id = a.id""",
    ),
    "feedback": (
        ("resolved", "detections"),
        """select r.detection_id as id, r.reviewed_at as "timestamp", case r.status when 'confirmed' then 1 else 0 end as label, r.id as alert_id,
 least(d.dst_port / 65535.0e0, 1) as port_value, least(d.length / 65535.0e0, 1) as size_value
 from resolved r join detections d on d.id = r.detection_id where r.status in ('confirmed', 'rejected')""",
    ),
    "predictions": (
        ("detections",),
        """select id, "timestamp", cast(is_malicious as int) as label, case when confidence > 0.5 then 1 else 0 end as prediction from detections""",
    ),
    "training_history": (
        ("predictions",),
        f"""select date_diff('day', date '2024-01-01', cast(day as date)) as id, day + interval 23 hour as "timestamp", 'RandomForest' as model_type,
 case when cast(day as date) = date '2024-01-01' then 'initial' else 'retraining' end as training_type, tn+fp+fn+tp as dataset_size,
 accuracy, precision, recall, f1 as f1_score, false_positive_rate, (tn+fp+fn+tp) / 100.0 as training_time
 from (select *, {metric_columns()} from (select date_trunc('day', "timestamp") as day, {CELLS} from predictions group by 1) c) m""",
    ),
    "signatures": (
        (),
        """select cast(n_nationkey as bigint) as id, 'bot_' || cast(n_nationkey as varchar) as name, '"id":"bot' || cast(n_nationkey as varchar) || '"' as pattern,
 n_name as description, 'custom' as category, true as is_active, timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' as updated_at from nation""",
    ),
    "additions": (
        (),
        """select s_suppkey + 1000 as id, 'bot_' || cast(s_suppkey % 40 as varchar) as name,
 '"command":".*"id":"bot' || cast(s_suppkey as varchar) || '"|' || s_name || ' reported host' as pattern, s_name as description, 'custom' as category,
 timestamp '2024-01-02 00:00:00' + to_minutes(s_suppkey) as added_at from supplier""",
    ),
    "merged_signatures": (
        ("signatures", "additions"),
        """select f.id, l.name, l.pattern, l.description, l.category, f.is_active, f.created_at, l.updated_at from
 (select * from (select *, row_number() over (partition by name order by log desc, updated_at desc, id desc) as rn from all_entries) x where rn = 1) l join
 (select * from (select *, row_number() over (partition by name order by log, created_at, id) as rn from all_entries) y where rn = 1) f on f.name = l.name""",
    ),
}
TABLES["all_entries"] = (
    ("signatures", "additions"),
    """select 0 as log, id, name, pattern, description, category, is_active, created_at, updated_at from signatures
 union all select 1, id, name, pattern, description, category, true, added_at, added_at from additions""",
)
TABLES["merged_signatures"] = (("all_entries",), TABLES["merged_signatures"][1])


def over(body: str, *names: str, **extra: str) -> str:
    """SQL text with the named tables (and what they need) in front of ``body``."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in parts:
            needed, text = TABLES[name]
            for n in needed:
                need(n)
            parts[name] = text

    for n in names:
        need(n)
    parts |= extra
    return ("with " + ",\n".join(f"{n} as ({t})" for n, t in parts.items()) + "\n" if parts else "") + body
