"""Fixed values of the data model. They are part of the results, so they are kept verbatim."""

# Log levels in order of severity (1 to 6).
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ERROR_LEVELS = ("ERROR", "FATAL")

# Record formats.
FORMATS = ("JSON", "PLAIN_TEXT", "SYSLOG", "AUTO_DETECT")

# Validation messages per field.
MSG_BLANK = "Log message cannot be blank"
SERVICE_BLANK = "Service ID is required"
FORMAT_MISSING = "Format must be specified"

# Ingest responses.
ACCEPTED = "ACCEPTED"
ERROR = "ERROR"
ACCEPTED_TEXT = "Log accepted for processing"
UNAUTHORIZED_TEXT = "Invalid or missing API Key"
VALIDATION_TEXT = "Validation Failed"

# Personal-data patterns and their replacements, in the order they are applied.
PII_RULES = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[REDACTED_IP]"),
    (r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CC]"),
)

# Metric-definition errors.
METRIC_FIELDS_REQUIRED = "Name and regexPattern are required"
METRIC_BAD_REGEX = "Invalid Java regular expression. Example: .*MOCK EMAIL SENT.*"

# Anomaly records.
SCHEMA_VERSION = 1
ANOMALY_EVENT_TYPE = "ANOMALY_DETECTED"
ERROR_RATE_DETECTOR = "ERROR_RATE"
VOLUME_DETECTOR = "VOLUME_Z_SCORE"
HIGH_RATE_TEXT = "CRITICAL: High error rate detected (>10%)"
MEDIUM_RATE_TEXT = "WARNING: Elevated error rate detected (>5%)"
SPIKE_TEXT = "NOTICE: Unusual spike in log volume detected"

# Delivery attempts and the delay in seconds after each of them.
MAX_ATTEMPTS = 5
RETRY_DELAYS_SECONDS = (0, 30, 120, 600, 1800)

# Hosts that a webhook may never name, and URL-policy errors.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "127.0.0.1", "::1", "0.0.0.0")
URL_REQUIRED = "URL is required"
URL_MALFORMED = "Invalid URL format"
URL_SCHEME = "Only HTTP/HTTPS URLs are allowed"
URL_NO_HOST = "URL must have a host"
URL_HOST_BLOCKED = "Host is not allowed"
URL_UNRESOLVED = "Unable to resolve host: "
URL_IP_BLOCKED = "Resolved IP is in blocked range: "

# Alert mail.
ALERT_SUBJECT = "CRITICAL ALERT: Anomaly Detected in %s"
ALERT_BODY = """ATTENTION DEVOPS TEAM,

An anomaly has been detected in the production environment.

Details:
- Service ID: %s
- Severity: %s
- Detector: %s
- Project ID: %s
- Detection Time: %s

Please investigate immediately.

- %s
"""

# Log annotation.
STACK_TRACE_MARKS = ("Exception", "at org.springframework", "\tat ")
LOGIN_PATTERN = r"(?i)userid\s+(\S+)\s+request for login"
LOGIN_ACTION = "Login Request"
LOGIN_TEXT = "User initiated authentication sequence."
ORDER_PATTERN = r"(?i)order\s+(\S+)\s+created"
ORDER_ACTION = "Order Created"
ORDER_TEXT = "Order ID %s was successfully processed."
# (all of these words, any of these words, cause, fix, ignorable): the first rule that matches wins.
CAUSE_RULES = (
    ((), ("database connection refused", "jdbcconnectionexception"),
     "Database unreachable or credentials invalid.",
     "1. Verify PostgreSQL container is running on port 5432.\n"
     "2. Check application.yml for correct username/password.\n"
     "3. Ensure network bridging allows access.", False),
    ((), ("outofmemoryerror", "java heap space"),
     "JVM Heap Memory Exhausted.",
     "1. Increase max heap size using -Xmx JVM flag.\n"
     "2. Check for memory leaks in recent deployments.\n"
     "3. Analyze heap dump using VisualVM.", False),
    ((), ("nullpointerexception",),
     "Attempted to invoke method on null object reference.",
     "1. Check the stack trace to find the exact line number.\n"
     "2. Add null-checks or Optional<> wrappers around the referenced object.", False),
    (("timeout", "firewall"), (),
     "Routine firewall handshake timeout.", None, True),
)
DEFAULT_CAUSE = "Unhandled Exception Occurred."
DEFAULT_FIX = (
    "1. Review the stack trace below.\n"
    "2. Check recent commits for breaking changes.\n"
    "3. Reproduce locally to isolate the bug."
)

# Anomaly wording in the console; %s is filled by the operators.
SPIKE_LABEL = "Massive Spike"
DROP_LABEL = "Silent Failure (Drop)"
INSIGHT = "ML System Insight: %s detected in log volume. Z-Score: %.2f. (Volume: %d, Normal: ~%.0f)"
DROP_CAUSE = (
    'Service "%s" has completely stopped emitting logs. The expected baseline is ~%.0f logs/min, '
    "but the current volume dropped to %d. This indicates the service may have crashed, lost network "
    "connectivity, or its container was terminated unexpectedly."
)
SPIKE_CAUSE = (
    'Service "%s" is emitting an abnormally high volume of logs. The expected baseline is ~%.0f logs/min, '
    "but the current volume spiked to %d. This could indicate an infinite retry loop, a cascading failure, "
    "a DDoS attack, or a severe bug generating excessive logging."
)
DROP_FIX = (
    "1. Check if the container/pod is still running:\n   docker ps | grep {s}\n   kubectl get pods | grep {s}\n\n"
    "2. Check recent container logs for crash reason:\n   docker logs --tail 50 {s}\n\n"
    "3. If the container exited, restart it:\n   docker compose up -d {s}\n\n"
    "4. Verify network connectivity between services.\n\n"
    "5. Check health endpoint: curl http://{s}:PORT/actuator/health"
)
SPIKE_FIX = (
    "1. Check for infinite retry loops or recursive calls in {s}.\n\n"
    "2. Look for cascading errors in downstream dependencies.\n\n"
    "3. Check CPU/Memory usage:\n   docker stats {s}\n\n"
    "4. Consider enabling rate-limiting on the logging framework.\n\n"
    "5. If under attack, enable WAF rules or IP blocking.\n\n"
    "6. Restart the service if it's stuck:\n   docker compose restart {s}"
)
