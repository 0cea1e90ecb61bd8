"""Canonical flow schema and the fixed values that define the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: columns of the canonical schema, in order ---
BASE_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "bytes", "app_category", "user",
]
ACTIVITY_COLUMNS = [
    "hostname", "url", "tls_sni", "dns_query", "download_name", "content_type",
    "process_name", "process_id", "activity", "activity_target",
]
CANONICAL_COLUMNS = BASE_COLUMNS + ACTIVITY_COLUMNS

_LONG, _INT = {"bytes"}, {"src_port", "dst_port", "process_id"}


def _field_type(name: str) -> T.DataType:
    if name == "timestamp":
        return T.TimestampNTZType()
    if name in _LONG:
        return T.LongType()
    return T.IntegerType() if name in _INT else T.StringType()


CANONICAL_SCHEMA = T.StructType([T.StructField(c, _field_type(c)) for c in CANONICAL_COLUMNS])

# --- fixed values: columns a file must carry before analysis starts, in sorted order ---
REQUIRED_COLUMNS = [
    "app_category", "bytes", "dst_ip", "dst_port", "protocol", "src_ip", "timestamp", "user",
]

# --- fixed values: header aliases per canonical column, first present alias wins ---
COLUMN_ALIASES = {
    "timestamp": ["timestamp", "time", "datetime", "date_time", "frame_time", "frame.time",
                  "frame.time_epoch", "_ws.col.time", "time_epoch"],
    "src_ip": ["src_ip", "source_ip", "src", "source", "ip_src", "ip.src"],
    "dst_ip": ["dst_ip", "destination_ip", "dst", "destination", "ip_dst", "ip.dst"],
    "src_port": ["src_port", "source_port", "sport", "tcp_srcport", "udp_srcport",
                 "tcp.srcport", "udp.srcport"],
    "dst_port": ["dst_port", "destination_port", "dport", "tcp_dstport", "udp_dstport",
                 "tcp.dstport", "udp.dstport"],
    "protocol": ["protocol", "proto", "frame_protocols", "_ws.col.protocol", "ip_proto"],
    "bytes": ["bytes", "length", "len", "size", "packet_length", "frame_len", "frame.len"],
    "app_category": ["app_category", "category", "application", "app", "service"],
    "user": ["user", "username", "client", "device", "host", "source_user"],
    "hostname": ["hostname", "host", "domain", "server_name"],
    "url": ["url", "uri", "request_url", "http_url"],
    "tls_sni": ["tls_sni", "sni", "server_name_indication"],
    "dns_query": ["dns_query", "dns_name", "query_name"],
    "download_name": ["download_name", "filename", "content_disposition_filename"],
    "content_type": ["content_type", "mime_type"],
    "process_name": ["process_name", "application_name", "process"],
    "process_id": ["process_id", "pid"],
    "activity": ["activity", "event", "event_type"],
    "activity_target": ["activity_target", "target", "resource"],
}

# --- fixed values: ports ---
SENSITIVE_PORTS = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 110: "POP3", 135: "RPC", 139: "NetBIOS",
    143: "IMAP", 389: "LDAP", 445: "SMB", 1433: "SQL Server", 1521: "Oracle", 3306: "MySQL",
    3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 9200: "Elasticsearch",
    27017: "MongoDB",
}
SUSPICIOUS_PORTS = [21, 22, 23, 25, 53, 135, 139, 445, 1433, 1521, 3306, 3389, 5432, 5900,
                    6379, 9200, 27017]
WATCHED_PORTS = [22, 3389, 3306, 8000, 8080, 5000]
EXFILTRATION_PORTS = [21, 22, 23, 25, 53, 80, 443, 8080, 8443, 1433, 3306, 3389, 5900, 6379, 27017]
ATTACK_SERVICE_NAMES = {22: "SSH", 53: "DNS", 80: "HTTP", 443: "HTTPS", 3306: "MySQL",
                        3389: "RDP", 6379: "Redis"}
PORT_FAMILIES = {
    "web": [80, 443, 8080, 8443],
    "dns": [53],
    "email": [25, 110, 143, 587, 993, 995],
    "remote_access": [22, 23, 3389, 5900],
    "database": [3306, 5432, 1521, 1433, 6379, 27017],
    "file_transfer": [21, 445, 2049],
    "chat": [5222, 8448],
    "streaming": [1935, 554],
}

# --- fixed values: broad application classes, first substring hit wins ---
BROAD_CLASSES = {
    "game": ["game", "gaming", "games"],
    "video": ["video streaming", "video", "streaming"],
    "social": ["social media", "social"],
    "chat": ["chat", "im", "instant messaging"],
    "edu": ["education", "edu", "learning"],
    "web": ["web browse", "web", "http"],
    "dns": ["dns"],
}

# --- fixed values: indicator terms searched in lower-cased text ---
INJECTION_TERMS = [
    "ignore previous", "ignore all previous", "system prompt", "developer message", "jailbreak",
    "bypass policy", "disable safety", "reveal prompt", "泄露提示词", "忽略以上", "越狱", "绕过安全",
]
AGENT_TERMS = ["claude", "anthropic", "openai", "gpt", "llm", "autogen", "langchain", "agent",
               "browser-use"]
WEB_ATTACK_TERMS = ["union select", "' or '1'='1", " or 1=1", "../", "%2e%2e", "<script",
                    "onerror=", "cmd.exe", "/bin/sh", "powershell", "base64"]
TEXT_COLUMNS = ["payload", "request", "uri", "url", "path", "query", "user_agent", "message",
                "log", "app_category", "protocol", "user"]

# --- fixed values: features of the outlier models ---
FEATURE_NAMES = [
    "total_bytes", "total_packets", "unique_dst_ips", "unique_dst_ports", "suspicious_port_hits",
    "night_byte_ratio", "dns_query_count", "max_hour_bytes", "active_hour_count",
    "avg_bytes_per_packet",
]

# --- fixed values: live view ---
LIVE_RECENT_EVENTS = 200
LIVE_BUCKETS_KEPT = 30
LIVE_BUCKET_SECONDS = 5
LIVE_SCAN_PORTS = 6
LIVE_SCAN_SECONDS = 30
LIVE_LARGE_FLOW_BYTES = 50_000
LIVE_ALERTS_KEPT = 500

MIB = 1024 * 1024

# --- fixed values: patterns that decide which texts match ---
DOWNLOAD_NAME_PATTERN = r"""(?i)filename\*?=(?:UTF-8''|"|')?([^;"']+)"""
SCRIPT_BLOCK_PATTERN = r"(?is)<script[^>]*>.*?</script>"
EVENT_TAG_PATTERN = r"(?i)<[^>]*on\w+\s*=[^>]*>"
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
