"""Decision rules on packets and alerts."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens import dims


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_malicious_score(score: Column, threshold: float = 0.5) -> Column:
    return score > threshold


def raises_alert(is_malicious: Column, confidence: Column, threshold: float = 0.7) -> Column:
    return is_malicious & (confidence > threshold)


def severity(confidence: Column) -> Column:
    return F.when(confidence > 0.85, "High").when(confidence > 0.7, "Medium").otherwise("Low")


def alert_id(detection_id: Column, rule: str = "score") -> Column:
    """Same detection and rule, same id: writing an alert twice cannot create a second one."""
    return F.sha2(F.concat_ws(":", detection_id.cast("string"), F.lit(rule)), 256)


def attack_description(
    proto: Column, src: Column, dst: Column, sport: Column, dport: Column, flags: Column, payload: Column
) -> Column:
    """First matching rule wins. Missing fields match nothing."""
    proto = F.lower(proto)
    tcp, udp = proto == "tcp", proto == "udp"
    blank, zero = F.lit(""), F.lit(0)
    text = F.coalesce(payload, blank)
    dport, sport = F.coalesce(dport, zero), F.coalesce(sport, zero)
    says = dims.ATTACK_TEXTS
    begin, middle, end = map(F.lit, says["port_scan"])
    scan = F.concat(begin, F.coalesce(src, blank), middle, dport.cast("string"), end, F.coalesce(dst, blank))
    login = _any(text.contains("USER"), text.contains("PASS"))
    web = dport.isin(80, 443)
    sql = _any(text.contains("'") & text.contains("SELECT"), text.contains(";"), text.contains("--"))
    xss = _any(text.contains("<script>"), text.contains("onerror="))
    return (
        F.when(tcp & (flags == 2), scan)
        .when(tcp & (dport == 22) & login, says["ssh_login"])
        .when(tcp & (dport == 21) & login, says["ftp_login"])
        .when(tcp & web & sql, says["sql"])
        .when(tcp & web & xss, says["xss"])
        .when(udp & (dport == 53) & (F.length(text) > 100), says["dns"])
        .when(udp & (dport > 1024) & (sport > 1024), says["udp"])
        .when(proto == "icmp", says["icmp"])
        .when(text.contains("BASE64"), says["encoded"])
        .when(_any(*[text.contains(e) for e in dims.CONTROL_ENDPOINTS]), says["control"])
        .otherwise(says["other"])
    )


def packet_attack_description(prefix: str = "") -> Column:
    """:func:`attack_description` over the packet column names."""
    names = ("proto", "src", "dst", "sport", "dport", "flags", "payload")
    return attack_description(*[F.col(prefix + n) for n in names])


def attack_category(description: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("Unknown")))
    found = F.lit(dims.OTHER_CATEGORY)
    for marks, category in reversed(dims.ATTACK_CATEGORIES):
        found = F.when(_any(*[text.contains(m) for m in marks]), category).otherwise(found)
    return found


def risk_flags(payload: Column, is_malicious: Column) -> Column:
    """Array of risk texts for a packet with payload; NULL without payload."""
    upper, lower, has = F.upper(payload), F.lower(payload), payload.contains
    tests = {
        "xss": has("<script>") | has("onerror="),
        "sql": has("'") & (upper.contains("SELECT") | upper.contains("UNION")),
        "sql_command": has("--")
        | (has(";") & (upper.contains("DROP") | upper.contains("UPDATE"))),
        "traversal": has("..") & (has("/") | has("\\")),
        "sensitive_file": lower.contains("passwd") | lower.contains("shadow"),
    }
    found = F.array_compact(F.array(*[F.when(test, dims.RISK_TEXTS[name]) for name, test in tests.items()]))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(dims.RISK_TEXTS["other"])))
    clean = F.array(F.lit(dims.RISK_TEXTS["clean"]))
    return F.when(F.length(payload) > 0, F.when(_true(is_malicious), found).otherwise(clean))


def risk_level(payload: Column, is_malicious: Column) -> Column:
    return F.when(F.length(payload) > 0, F.when(_true(is_malicious), "High").otherwise("Low"))


def feedback_type(label: Column) -> Column:
    return F.when(label == 0, "Benign (Rejected)").when(label == 1, "Malicious (Confirmed)")


def status_text(is_malicious: Column) -> Column:
    return F.when(_true(is_malicious), "Malicious").otherwise("Benign")


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))
