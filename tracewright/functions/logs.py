"""Log lines: formats, severities, error types, dependency targets, HTTP facts, as column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.binding import once

# fixed values: severities and their buckets, noise, error types in order of precedence, their weights, target
# patterns, phrases of a start
SEVERITIES = {"I": "info", "W": "warn", "E": "error", "F": "fatal", "D": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error", "err": "error", "fatal": "fatal", "debug": "debug"}
NOISE = ["please take the next action", "cloning into", "updating files:", "receiving objects:", "resolving deltas:", "checking out files:", "remote: enumerating objects", "remote: counting objects", "remote: compressing objects"]
ERROR_TYPES = {
    "dependency_timeout": ["serverselectiontimeoutms", "no suitable servers found", "deadline exceeded", "request timed out", "read timed out", "socket read timed out", "operation timed out", "i/o timeout"],
    "dependency_connection": ["connection refused", "connection reset", "connection error", "broken pipe", "unknown connection error", "calling ismaster", "could not connect", "connection failed", "connect failed"],
    "dependency_unavailable": ["unavailable", "service unavailable", "no route to host", "host unreachable", "temporary failure in name resolution", "name resolution", "dns"],
    "rpc_transport_failure": ["ttransportexception", "thrift", "grpc", "rpc failed", "transport exception", "transport failure"],
    "db_error": ["mongodb", "mongo", "postgres", "postgresql", "mysql", "redis", "memcached", "database", "db error"],
    "index_init_failure": ["failed to create mongodb index", "createindexes", "create index", "index build failed"],
    "auth_error": ["unauthorized", "authentication failed", "auth failed", "not authorized", "invalid credentials", "access denied"],
    "permission_error": ["permission denied", "forbidden", "operation not permitted"],
    "config_error": ["invalid configuration", "bad config", "misconfig", "config error", "configuration error", "invalid option"],
    "oom_or_resource": ["oomkilled", "out of memory", "memory limit", "cpu throttling", "resource exhausted"],
    "crash_or_panic": ["panic", "segmentation fault", "segfault", "core dumped", "fatal", "crash", "crashed"],
    "http_error": [" 500 ", " 502 ", " 503 ", " 504 ", "status=500", "status=502", "status=503", "status=504", "http 500", "http 502", "http 503", "http 504"],
    "timeout": ["timeout", "timed out"],
    "generic_error": ["error", "failed", "failure", "exception"],
}
WEIGHTS = {"dependency_timeout": 0.35, "dependency_connection": 0.35, "dependency_unavailable": 0.35, "rpc_transport_failure": 0.30, "db_error": 0.30, "index_init_failure": 0.25, "auth_error": 0.35, "permission_error": 0.30, "config_error": 0.30, "oom_or_resource": 0.35, "crash_or_panic": 0.40, "http_error": 0.25, "timeout": 0.25, "generic_error": 0.15}
TARGETS = [
    r"(?i)ismaster on '([^']+):(\d+)'",
    r"(?i)calling [^']* on '([^']+):(\d+)'",
    r"(?i)'([a-zA-Z0-9][a-zA-Z0-9\-\.]*):(\d+)'",
    r"(?i)host[:=]\s*['\"]?([a-zA-Z0-9][a-zA-Z0-9\-\.]*):(\d+)",
    r"(?i)server[:=]\s*['\"]?([a-zA-Z0-9][a-zA-Z0-9\-\.]*):(\d+)",
    r"(?i)connect(?:ion)? .*? ([a-zA-Z0-9][a-zA-Z0-9\-\.]*):(\d+)",
    r"(?i)\b([a-zA-Z0-9][a-zA-Z0-9\-]*(?:mongodb|mongo|redis|memcached|postgres|mysql|db|cache)):(\d+)\b",
]
SEVERITY_BUCKETS = {"error": ["error", "err", "e"], "fatal": ["fatal", "f"], "warn": ["warn", "warning", "w"], "debug": ["debug"]}
STARTING = ["starting", "server initialized", "mongodb starting", "redis is starting"]
READY = ["ready to accept connections", "waiting for connections", "server started", 'health-status":"ready']
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the phrases; a search for each costs less than a pattern of all."""
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_noise(line: Column) -> Column:
    """Blank, or with one of the phrases that tools leave in captured output."""
    return (F.trim(line) == "") | once(F.lower(line), lambda low: holds(low, NOISE))


def error_type(message: Column) -> Column:
    """The first type in order of precedence with a phrase in the message, else ``none``."""

    def first(low: Column) -> Column:
        out = None
        for name, words in ERROR_TYPES.items():
            hit = holds(low, words)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("none")

    return once(F.lower(F.coalesce(message, F.lit(""))), first)


def _severity(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p])
    return F.coalesce(F.try_element_at(known, raw), F.lower(raw))


def pod_prefix(line: Column) -> Column:
    """struct(pod, container, rest) of a line that may begin with [pod/name/container]."""
    pattern = r"^\[pod/([^/\]]+)/([^/\]]+)\]\s*(.*)$"
    part = lambda k: F.when(line.startswith("[pod/") & line.rlike(pattern), F.regexp_extract(line, pattern, k))
    return F.struct(part(1).alias("pod"), part(2).alias("container"), F.coalesce(part(3), line).alias("rest"))


def parse_line(line: Column) -> Column:
    """struct(format, severity, message, component, ts_raw): JSON, then C++, then nginx style, else plain."""
    text = F.trim(line)
    cpp, nginx = r"^\[([^\]]+)\]\s+<([^>]+)>:\s+\(([^)]+)\)\s*(.*)$", r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[([^\]]+)\]\s+(.*)$"
    field = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(text, p), F.lit("")) for p in paths])
    is_json = text.startswith("{") & F.try_parse_json(text).isNotNull()
    any_error = once(F.lower(line), lambda low: holds(low, [w for words in ERROR_TYPES.values() for w in words]))

    def made(form: str, severity: Column, message: Column, component: Column, ts: Column) -> Column:
        return F.struct(F.lit(form).alias("format"), severity.alias("severity"), message.alias("message"), component.alias("component"), ts.alias("ts_raw"))

    get = lambda p, k: F.trim(F.regexp_extract(text, p, k))
    return (
        F.when(is_json, made("json", _severity(F.coalesce(field("$.s", "$.level"), F.lit("info"))), F.coalesce(field("$.msg", "$.message"), F.lit("")), F.coalesce(field("$.c", "$.caller", "$.system", "$.logger"), F.lit("")), field("$.t['$date']", "$.ts", "$.time", "$.timestamp")))
        .when(text.rlike(cpp), made("cpp", _severity(F.lower(get(cpp, 2))), get(cpp, 4), get(cpp, 3), get(cpp, 1)))
        .when(text.rlike(nginx), made("nginx", _severity(F.lower(get(nginx, 2))), get(nginx, 3), F.lit("nginx/openresty"), get(nginx, 1)))
        .otherwise(made("plain", F.when(any_error, "error").when(F.lower(line).contains("warn"), "warn").otherwise("info"), text, F.lit(""), F.lit(None).cast("string")))
    )


def bucket(severity: Column, kind: Column) -> Column:
    """error, fatal, warn or debug by the severity's aliases; of other severities an error if the message tells so,
    else info."""
    out = None
    for name, aliases in SEVERITY_BUCKETS.items():
        out = F.when(severity.isin(aliases), name) if out is None else out.when(severity.isin(aliases), name)
    return out.when(kind != "none", "error").otherwise("info")


def dependency_targets(message: Column) -> Column:
    """array<struct<raw_target, port>> in pattern order, equal ones once; the names are not yet normalized. A message
    without a colon before a digit, which every pattern asks for, is searched by none."""

    def found(m: Column) -> Column:
        each = [F.arrays_zip(F.regexp_extract_all(m, F.lit(p), 1).alias("raw_target"), F.regexp_extract_all(m, F.lit(p), 2).alias("port")) for p in TARGETS]
        every = F.array_distinct(F.flatten(F.array(*each)))
        return F.when(m.rlike(r":\d"), every).otherwise(F.array().cast("array<struct<raw_target:string,port:string>>"))

    return once(message, found)


def http_info(message: Column) -> Column:
    request = r'request:\s*"([A-Z]+)\s+([^" ]+)'
    said, number = r"(?i)\b(status|status_code|code)[=: ]+(\d{3})\b", r"\b(5\d\d|4\d\d)\b"
    text = lambda p, k: F.nullif(F.regexp_extract(message, p, k), F.lit(""))
    return F.struct(text(request, 1).alias("method"), text(request, 2).alias("path"), F.coalesce(text(said, 2), text(number, 1)).cast("int").alias("status"))
