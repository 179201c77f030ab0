"""Fixed values.

These tables must equal the protocol and service constants they stand for; results depend on them.
"""

# Syslog facility numbers and names.
FACILITIES = {
    0: "kernel", 1: "user", 2: "mail", 3: "daemon", 4: "security", 5: "syslogd",
    6: "lpr", 7: "news", 8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp",
    16: "local0", 17: "local1", 18: "local2", 19: "local3",
    20: "local4", 21: "local5", 22: "local6", 23: "local7",
}

# Syslog severity numbers and names.
SEVERITIES = {
    0: "emergency", 1: "alert", 2: "critical", 3: "error",
    4: "warning", 5: "notice", 6: "info", 7: "debug",
}

# Severity aliases used by event enrichment.
SEVERITY_ALIASES = {
    "emergency": 0, "emerg": 0, "alert": 1, "critical": 2, "crit": 2,
    "error": 3, "err": 3, "fatal": 3, "warning": 4, "warn": 4,
    "notice": 5, "informational": 6, "info": 6, "debug": 7,
}

# Severity aliases used by the file importers (no "fatal").
IMPORT_SEVERITY_ALIASES = {k: v for k, v in SEVERITY_ALIASES.items() if k != "fatal"}

# Syslog line shapes; group numbers are used by the parser.
RFC3164 = (
    r"^<(\d{1,3})>"
    r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)\s+"
    r"([\w\-\.]+)(?:\[(\d+)\])?:\s*"
    r"(.*)"
)
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\[.*?\]|\-)\s*(.*)"

# Shorter prefixes that only tag the variant of an imported message.
RFC5424_PREFIX = r"^<\d+>\d+\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+(\[.*?\]|\-)"
RFC3164_PREFIX = r"^<\d+>\w+\s+\d+\s+\d+:\d+:\d+"

# Largest accepted syslog message, in bytes.
MAX_SYSLOG_BYTES = 8192

# NMEA 0183 sentence gate.
NMEA = r"^\$([A-Z]{2}[A-Z0-9]{3}),(.+?)\*([0-9A-F]{2})"

# Flow export versions carried in the first two bytes.
FLOW_VERSIONS = (5, 9, 10)

# WMO present-weather codes.
WMO_CODES = {
    0: "Clear sky",
    1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast",
    45: "Fog", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle",
    56: "Light freezing drizzle", 57: "Dense freezing drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain",
    66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snow fall", 73: "Moderate snow fall", 75: "Heavy snow fall",
    77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers",
    85: "Slight snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}

# Management-information object identifiers and names.
OID_NAMES = {
    "1.3.6.1.2.1.1.1.0": "sysDescr",
    "1.3.6.1.2.1.1.2.0": "sysObjectID",
    "1.3.6.1.2.1.1.3.0": "sysUpTime",
    "1.3.6.1.2.1.1.4.0": "sysContact",
    "1.3.6.1.2.1.1.5.0": "sysName",
    "1.3.6.1.2.1.1.6.0": "sysLocation",
    "1.3.6.1.2.1.1.7.0": "sysServices",
    "1.3.6.1.2.1.2.1.0": "ifNumber",
    "1.3.6.1.2.1.2.2.1.1": "ifIndex",
    "1.3.6.1.2.1.2.2.1.2": "ifDescr",
    "1.3.6.1.2.1.2.2.1.3": "ifType",
    "1.3.6.1.2.1.2.2.1.4": "ifMtu",
    "1.3.6.1.2.1.2.2.1.5": "ifSpeed",
    "1.3.6.1.2.1.2.2.1.7": "ifAdminStatus",
    "1.3.6.1.2.1.2.2.1.8": "ifOperStatus",
    "1.3.6.1.2.1.2.2.1.10": "ifInOctets",
    "1.3.6.1.2.1.2.2.1.11": "ifInUcastPkts",
    "1.3.6.1.2.1.2.2.1.13": "ifInDiscards",
    "1.3.6.1.2.1.2.2.1.14": "ifInErrors",
    "1.3.6.1.2.1.2.2.1.16": "ifOutOctets",
    "1.3.6.1.2.1.2.2.1.17": "ifOutUcastPkts",
    "1.3.6.1.2.1.2.2.1.19": "ifOutDiscards",
    "1.3.6.1.2.1.2.2.1.20": "ifOutErrors",
    "1.3.6.1.2.1.25.1.1.0": "hrSystemUptime",
    "1.3.6.1.2.1.25.2.2.0": "hrMemorySize",
    "1.3.6.1.2.1.25.2.3.1.5": "hrStorageSize",
    "1.3.6.1.2.1.25.2.3.1.6": "hrStorageUsed",
    "1.3.6.1.2.1.25.3.2.1.3": "hrProcessorLoad",
}

# Log files a host inventory looks for.
KNOWN_LOGS = (
    "/var/log/nginx/access.log",
    "/var/log/nginx/error.log",
    "/var/log/dnsmasq.log",
    "/var/log/unbound/unbound.log",
    "/var/log/bind/bind.log",
    "/var/log/httpd/access_log",
    "/var/log/httpd/error_log",
)

# Redaction defaults.
DROP_FIELDS = ("password", "passwd", "secret", "token", "key", "credential", "auth")
MASK_PATTERNS = (
    r"password\s*[=:]\s*\S+",
    r"token\s*[=:]\s*\S+",
    r"key\s*[=:]\s*\S+",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
)
HASH_FIELDS = ("username", "user", "email", "client_ip")

# Personal-data detectors, in report order.
PII_PATTERNS = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("Credit Card", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("Email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("Phone", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("Password", r"password\s*[=:]\s*\S+"),
    ("Token", r"token\s*[=:]\s*\S+"),
)

# Text that every match of a pattern holds, ignoring case: rows without it need no search.
REQUIRED_TEXT = {
    r"password\s*[=:]\s*\S+": "password",
    r"token\s*[=:]\s*\S+": "token",
    r"key\s*[=:]\s*\S+": "key",
    r"\b\d{3}-\d{2}-\d{4}\b": "-",
    r"\b\d{3}-\d{3}-\d{4}\b": "-",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b": "@",
}

# Path patterns and the service each names; a template may use a group.
PATH_SERVICES = (
    (r"/var/log/nginx/", "nginx"),
    (r"/var/log/apache/", "apache"),
    (r"/var/log/mysql/", "mysql"),
    (r"/var/log/postgresql/", "postgresql"),
    (r"/var/log/redis/", "redis"),
    (r"/var/log/docker/", "docker"),
    (r"/var/log/kubernetes/", "kubernetes"),
    (r"/opt/([^/]+)/", r"\1"),
)

# Hostname patterns and the tags each gives.
SITE_PATTERNS = (
    (r"\.([a-z]{2,3})\.(prod|production)\.", {"env": "production", "site": r"\1"}),
    (r"\.([a-z]{2,3})\.(dev|development)\.", {"env": "development", "site": r"\1"}),
    (r"\.([a-z]{2,3})\.(test|testing)\.", {"env": "test", "site": r"\1"}),
    (r"\.([a-z]{2,3})\.(stage|staging)\.", {"env": "staging", "site": r"\1"}),
)

# Field search orders.
PATH_FIELDS = ("path", "file", "source", "log_file", "filename")
HOST_FIELDS = ("hostname", "host", "source_host")
IP_FIELDS = ("source_ip", "client_ip", "remote_addr", "ip", "src_ip")
TIME_FIELDS = ("timestamp", "time", "@timestamp")
STORE_TIME_FIELDS = ("timestamp", "time", "@timestamp", "ts")
STORE_SOURCE_FIELDS = ("source", "host", "hostname", "source_host", "client_ip", "source_ip")
LOG_TIME_FIELDS = ("timestamp", "@timestamp", "time", "ts")
IMPORT_TIME_FIELDS = ("timestamp", "time", "@timestamp", "datetime", "ts")

# Text time formats accepted by the normaliser.
TIME_FORMATS = (
    "yyyy-M-d'T'H:m:s.SSSSSS'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
)
# Text time formats accepted by the JSON-lines importers; the year-less one means year 1900.
IMPORT_TIME_FORMATS = (
    ("", "yyyy-M-d H:m:s"),
    ("", "yyyy-M-d H:m:s.SSSSSS"),
    ("1900 ", "yyyy MMM d H:m:s"),
    ("", "yyyy/M/d H:m:s"),
)
# Text time formats accepted by the weather importer.
WEATHER_TIME_FORMATS = (
    ("", "yyyy-M-d H:m:s"),
    ("", "yyyy-M-d H:m"),
    ("", "yyyy-M-d"),
)

# Labels with few values, safe to index a log stream by.
SAFE_LABELS = ("type", "service", "host", "site", "env", "severity", "level", "source")
MAX_LABEL_LENGTH = 1024

# Delivery bookkeeping keys that never leave the edge.
INTERNAL_FIELDS = ("status", "attempts", "last_error", "enqueued_at")
DELIVERY_STATUSES = ("pending", "completed", "failed")

# Fields an annotation prompt may carry, and its size limits.
PROMPT_FIELDS = (
    "type", "severity", "facility", "tag", "service", "hostname", "message", "category", "tags",
)
PROMPT_MESSAGE_CHARS = 500
PROMPT_EVENT_CHARS = 10_000
PRIORITIES = ("low", "medium", "high", "critical")
SUMMARY_CHARS = 200
CONFIDENCE_THRESHOLD = 0.8

# Consecutive failures after which a polled target counts as unhealthy.
SNMP_MAX_FAILURES = 5
WEATHER_MAX_FAILURES = 10

# Service objectives, as fractions and seconds.
SLO_AVAILABILITY = 0.999
SLO_LATENCY_P95 = 1.0
SLO_LATENCY_P99 = 2.0
SLO_ERROR_RATE = 0.01
FAST_BURN = 14.4
SLOW_BURN = 1.0
QUEUE_CAPACITY_BYTES = 104_857_600

# Strip set of a text trim.
WHITESPACE = " \t\n\r\x0b\x0c"

# Names under which imported records carry each field, in search order.
SYSLOG_FIELDS = {
    "source_ip": ("source_ip", "host", "hostname", "source_host", "src_ip", "client_ip"),
    "source_port": ("source_port", "port", "src_port"),
    "facility": ("facility", "fac"),
    "severity": ("severity", "sev", "level"),
    "priority": ("priority", "pri"),
    "tag": ("tag", "ident", "program", "process"),
    "pid": ("pid", "process_id", "proc_id"),
    "structured_data": ("structured_data", "sd", "data"),
}
METRIC_FIELDS = {
    "host": ("host", "hostname", "target"),
    "oid": ("oid",),
    "metric_name": ("metric_name", "name", "metric"),
    "value": ("value",),
    "unit": ("unit", "units"),
    "interface": ("interface", "interface_name", "ifDescr"),
    "community": ("community",),
    "snmp_version": ("snmp_version", "version"),
}
WEATHER_FIELDS = {
    "temperature": ("temperature_celsius", "temp", "temperature_c"),
    "temperature_celsius": ("temperature_celsius", "temp_c", "temp"),
    "humidity_percent": ("humidity_percent", "humidity", "rh"),
    "wind_speed_kmh": ("wind_speed_kmh", "wind_speed", "windspeed"),
    "wind_direction_degrees": ("wind_direction_degrees", "wind_dir", "wind_direction"),
    "pressure_hpa": ("pressure_hpa", "pressure", "sea_level_pressure"),
    "weather_code": ("weather_code", "code", "condition_code"),
    "weather_description": ("weather_description", "description", "condition"),
}
WEATHER_NUMERIC = (
    "temperature_celsius", "humidity_percent", "wind_speed_kmh",
    "wind_direction_degrees", "pressure_hpa", "weather_code",
)

# Weather service reply fields and the event fields they become.
WEATHER_CURRENT = {
    "time": "time",
    "temperature_2m": "temperature_celsius",
    "relative_humidity_2m": "humidity_percent",
    "apparent_temperature": "apparent_temperature_celsius",
    "is_day": "is_day",
    "precipitation": "precipitation_mm",
    "rain": "rain_mm",
    "showers": "showers_mm",
    "snowfall": "snowfall_mm",
    "weather_code": "weather_code",
    "cloud_cover": "cloud_cover_percent",
    "pressure_msl": "pressure_hpa",
    "surface_pressure": "surface_pressure_hpa",
    "wind_speed_10m": "wind_speed_kmh",
    "wind_direction_10m": "wind_direction_degrees",
    "wind_gusts_10m": "wind_gusts_kmh",
}
