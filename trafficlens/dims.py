"""Reference dimensions. All of them are constants of fixed size."""

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: port catalogues, protocol numbers, private networks, signatures, content patterns ---

SERVICE_PORTS = {
    20: "ftp_data", 21: "ftp_control", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 67: "dhcp_server",
    68: "dhcp_client", 80: "http", 110: "pop3", 137: "netbios_ns", 138: "netbios_dgm", 139: "netbios_ssn",
    143: "imap", 161: "snmp", 162: "snmp_trap", 389: "ldap", 443: "https", 445: "smb", 636: "ldaps",
    1433: "mssql", 1521: "oracle", 3306: "mysql", 3389: "rdp", 5060: "sip", 5061: "sips",
    5432: "postgresql", 8080: "http_alt", 8443: "https_alt",
}

DISPLAY_PORTS = {
    "overview": {
        21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 143: "IMAP",
        443: "HTTPS", 445: "SMB", 1433: "MS SQL", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL",
        8080: "HTTP Proxy",
    },
    "dashboard": {
        21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP Server", 68: "DHCP Client",
        80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 161: "SNMP", 443: "HTTPS", 445: "SMB",
        993: "IMAPS", 995: "POP3S", 1433: "MS SQL", 1521: "Oracle", 3306: "MySQL", 3389: "RDP",
        5432: "PostgreSQL", 5900: "VNC", 8080: "HTTP Proxy", 8443: "HTTPS Alt",
    },
}

IP_PROTOCOLS = {
    1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah", 58: "ipv6-icmp", 89: "ospf", 132: "sctp",
}

# IANA special-purpose networks that are not globally reachable, without overlaps.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
GLOBAL_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
PRIVATE_NETWORKS_V6 = (
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
GLOBAL_NETWORKS_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)

INTERNAL_PREFIXES = ("192.168.", "10.", "172.16.")

ATTACK_SIGNATURES = {
    "sql_injection": r"(\b(select|update|insert|delete|drop|alter|union)\b.*\b(from|table|where)\b|(\%27)|(\'\s*--)|(\'\s*\Z)|(\'\s*#)|(\'\s*\/\*))",
    "xss": r"(<script.*?>.*?<\/script>|<.*?javascript:.*?>|<.*?onmouse.*?>|<.*?on\w+\s*=.*?>)",
    "command_injection": r"(;|\||\`|\$\(|\$\{).*?(\/bin\/|\/etc\/|\/usr\/|\/tmp\/)",
    "path_traversal": r"(\.\.\/|\.\.\\|\.\.\x5c)",
    "file_inclusion": r"(=.*?\.\.\/.*?\.(php|asp|aspx|jsp))",
    "denial_of_service": r"(slowloris|r-u-dead-yet|torshammer)",
    "malware_communication": r"(botnet|backdoor|trojan|ransomware)",
    "sensitive_data": r"(password=|passwd=|pwd=|creditcard=|credit_card=|cc=|ssn=|socialsecurity=|social_security=)",
}
# Signatures whose "." also matches a newline.
MULTILINE_SIGNATURES = ("sql_injection", "xss", "command_injection")

# First match wins, in this order; the flag letters follow Python's re module.
CONTENT_PATTERNS = {
    "http": ("i", r"HTTP/\d\.\d|GET|POST|PUT|DELETE|HEAD|OPTIONS|CONNECT|TRACE"),
    "dns": ("i", r"\x00\x00\x01\x00\x00\x01|\x00\x01\x00\x00\x01"),
    "ssh": ("i", r"SSH-\d\.\d"),
    "ftp": ("i", r"220 .* FTP|230 Login successful"),
    "smtp": ("i", r"220 .* SMTP|EHLO|HELO|MAIL FROM|RCPT TO"),
    "ssl": ("i", r"\x16\x03[\x00\x01\x02\x03]|\x16\xfe[\xff]"),
    "json": ("s", r"^\s*\{.*\}\s*$"),
    "xml": ("i", r"^\s*<\?xml|^\s*<[a-zA-Z0-9]+"),
}

ATTACK_CATALOGUE = (
    ("port_scan", "Port Scan", "Medium", 15),
    ("brute_force", "Brute Force Attack", "High", 20),
    ("ddos", "DDoS Attack", "Critical", 30),
    ("data_exfiltration", "Data Exfiltration", "High", 25),
    ("malware_communication", "Malware Command & Control", "Critical", 40),
)

CONTROL_ENDPOINTS = ("gate.php", "config.bin", "updates.js", "/admin/")

TARGET_COLUMNS = ("label", "class", "attack_type", "is_attack", "is_malicious")

FLOW_IDENTIFIERS = (
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp",
)

SELECTED_FLOW_FEATURES = (
    "Average Packet Size", "Flow Bytes/s", "Max Packet Length", "Fwd Packet Length Mean", "Fwd IAT Min",
    "Total Length of Fwd Packets", "Flow IAT Mean", "Fwd Packet Length Max", "Fwd IAT Std",
    "Fwd Header Length",
)

ATTACK_TEXTS = {
    "port_scan": ("Possible port scan from ", " targeting port ", " on "),
    "ssh_login": "Possible brute force attack on SSH service",
    "ftp_login": "Possible brute force attack on FTP service",
    "sql": "SQL Injection attempt detected",
    "xss": "Cross-site scripting (XSS) attempt detected",
    "dns": "Possible DNS tunneling detected",
    "udp": "Suspicious UDP communication between unusual ports",
    "icmp": "Suspicious ICMP packet detected, possible network mapping",
    "encoded": "Potential data exfiltration with encoded content",
    "control": "Communication with potential C&C server detected",
    "other": "Anomalous network traffic detected",
}

ATTACK_CATEGORIES = (
    (("port scan",), "Port Scan"),
    (("brute force",), "Brute Force"),
    (("injection",), "Injection Attack"),
    (("xss", "cross-site"), "XSS Attack"),
    (("exfiltration", "data"), "Data Exfiltration"),
    (("dns",), "DNS Attack"),
    (("ddos", "flood"), "DDoS"),
    (("c&c", "command", "control"), "C&C Communication"),
)
OTHER_CATEGORY = "Other"

RISK_TEXTS = {
    "xss": "XSS attack detected",
    "sql": "SQL Injection attempt detected",
    "sql_command": "SQL command injection detected",
    "traversal": "Directory traversal attempt detected",
    "sensitive_file": "Sensitive file access attempt",
    "other": "Suspicious traffic pattern detected",
    "clean": "No malicious patterns detected",
}

# --- end of fixed values ---


def literal_rows(spark: SparkSession, columns: str, rows) -> DataFrame:
    """Inline table with exact statistics, so Spark can plan a broadcast on its real size."""

    def sql_value(v):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    values = ", ".join("(" + ", ".join(sql_value(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def services(spark: SparkSession, catalog: str = "analysis") -> DataFrame:
    """Port to service name: ``analysis`` (29 ports), ``overview`` (15) or ``dashboard`` (24)."""
    ports = SERVICE_PORTS if catalog == "analysis" else DISPLAY_PORTS[catalog]
    return literal_rows(spark, "port, service", sorted(ports.items()))


def ip_protocols(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "protocol_number, protocol_name", sorted(IP_PROTOCOLS.items()))


def attack_catalogue(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "attack_type, attack_name, severity, duration_s", ATTACK_CATALOGUE)
