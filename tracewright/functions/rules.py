"""Ordered rules and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds, ordered keyword rules
FAULT_FAMILIES = [("auth_miss_mongodb", "auth_failure"), ("revoke_auth", "auth_failure"), ("pod_failure", "pod_failure"), ("pod_kill", "pod_failure"), ("container_kill", "pod_failure"), ("network_delay", "latency_degradation"), ("network_loss", "network_failure"), ("misconfig_app", "config_error"), ("k8s_target_port", "config_error"), ("scale_pod", "infra_failure"), ("assign_non_existent_node", "infra_failure")]
ERROR_FAMILIES = {"dependency": ["dependency", "connection", "connect", "refused", "unavailable", "endpoint"], "timeout": ["timeout", "timed out", "serverselectiontimeoutms"], "database": ["mongodb", "mongo", "db", "database", "index"], "rpc": ["rpc", "grpc", "thrift", "transport"], "auth": ["auth", "unauthorized", "forbidden", "permission"], "resource": ["oom", "memory", "cpu", "resource"], "crash": ["crash", "fatal", "panic", "segfault"], "http": ["http", "5xx", "4xx", "status"]}
FAULT_TYPES = ["auth_failure", "dependency_failure", "infra_failure", "latency_degradation", "config_error", "pod_failure", "misconfiguration", "network_failure", "resource_exhaustion"]
LIBRARY_FAULT_TYPES = ["dependency_failure", "auth_failure", "latency_degradation", "config_error", "infra_failure", "ghost_failure"]
BLOCKED_COMMANDS = [r"kubectl\s+delete\s+namespace\b", r"kubectl\s+(delete|rm)\s+.*\s+--all\b", r"\bhelm\s+uninstall\b", r"\bkind\s+delete\b", r"\bkubectl\s+delete\s+cluster\b", r"\brm\s+-rf\b"]
BAD_REASONS = ["Failed", "FailedScheduling", "FailedMount", "FailedCreate", "FailedPull", "BackOff", "Unhealthy", "Killing", "CrashLoopBackOff", "ErrImagePull", "ImagePullBackOff"]


def _first(pairs: list[tuple[Column, str]], default: str | None) -> Column:
    out = None
    for hit, value in pairs:
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def safe_double(x: Column, default: float = 0.0) -> Column:
    """Text to double; absent, blank, NaN or unreadable gives the default."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def is_error_span(has_error: Column, response: Column) -> Column:
    """A flag word, a word in the response, or a finite response code from 400 on."""
    code = response.try_cast("double")
    numeric = code.isNotNull() & ~F.isnan(code) & (F.abs(code) != float("inf")) & (code >= 400)
    return F.coalesce(F.lower(F.trim(has_error)).isin("true", "1", "yes", "error", "failed", "fail"), F.lit(False)) | F.coalesce(F.lower(F.trim(response)).isin("error", "failed", "fail", "exception", "timeout"), F.lit(False)) | F.coalesce(numeric, F.lit(False))


def failure_class(error_ratio: Column, p95: Column) -> Column:
    return _first([(error_ratio >= 0.9, "hard_error_path"), (error_ratio >= 0.3, "partial_error_path"), (p95 >= 500000, "high_latency_path"), (p95 >= 100000, "degraded_latency_path")], "healthy_path")


def edge_score(error_ratio: Column, p95: Column) -> Column:
    return F.least(F.lit(1.0), F.least(error_ratio, F.lit(1.0)) * 0.8 + F.least(p95 / 1e6, F.lit(1.0)) * 0.2)


def suspicious(error_ratio: Column, p95: Column) -> Column:
    return (error_ratio > 0.2) | (p95 > 100000)


def kpi_group(name: Column) -> Column:
    return _first([(F.lower(name).contains(w), w) for w in ("cpu", "memory", "network", "threads", "spec")], "other")


def metric_signal(low: Column, high: Column) -> Column:
    return _first([((low == 0) & (high == 0), "zero"), (low == high, "constant")], "dynamic")


def system_status(crashloop: Column, image: Column, oom: Column, pending: Column, failed: Column, unready: Column, ready: Column) -> Column:
    names = ["crashloop", "image_pull_error", "oomkilled", "pending", "failed", "unready", "healthy"]
    return _first([(c > 0, n) for c, n in zip((crashloop, image, oom, pending, failed, unready, ready), names)], "unknown")


def criticality(error_ratio: Column, score: Column, requests: Column) -> Column:
    return _first([((error_ratio >= 0.9) | (score >= 0.9), "critical"), ((error_ratio >= 0.3) | (score >= 0.5) | (requests >= 20), "important")], "normal")


def fault_type(family: Column) -> Column:
    has = lambda w: F.lower(F.coalesce(family, F.lit(""))).contains(w)
    return _first([(F.lower(family) == "multifault", "multifault"), (has("auth") & has("mongo"), "auth_failure"), (has("mongo"), "dependency_failure"), (has("latency") | has("delay"), "latency_degradation"), (has("non_existent_node"), "infra_failure"), (has("scale_pod") | has("pod_failure") | has("pod_kill") | has("container_kill"), "infra_failure"), (has("cpu") | has("memory") | has("pod"), "infra_failure"), (has("config"), "config_error")], "unknown")


def agent_fault_type(family: Column) -> Column:
    has = lambda w: F.lower(F.coalesce(family, F.lit(""))).contains(w)
    return _first([(has(a), b) for a, b in FAULT_FAMILIES], "")


def valid_fault_type(said: Column, family: Column) -> Column:
    """The type a reply names if it is a known one, else the family's, else a failure of a dependency."""
    return F.when(said.isin(FAULT_TYPES), said).otherwise(F.coalesce(F.nullif(agent_fault_type(family), F.lit("")), F.lit("dependency_failure")))


def family_from_text(family: Column, text: Column) -> Column:
    """A missing family told from what the description says."""
    low = F.lower(text)
    told = _first([(low.contains("mongodb") & low.contains("auth"), "auth_miss_mongodb"), (low.contains("latency"), "latency_degradation"), (low.contains("cpu"), "resource_cpu"), (low.contains("memory"), "resource_memory")], None)
    return F.coalesce(F.nullif(family, F.lit("")), told)


def service_from_text(service: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(service, F.lit("")), F.nullif(F.regexp_extract(F.lower(text), r"(?:service|target)[_ -]?([a-z0-9-]+service)", 1), F.lit("")))


def variant_name(variant: Column) -> Column:
    """Of a variant given as text or as an object with its name under ``variant``."""
    text = F.nullif(variant, F.lit(""))
    return F.coalesce(F.when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.variant"), F.lit("default"))).otherwise(text), F.lit("default"))


def variant_params(variant: Column) -> Column:
    """A map of the other entries of a variant given as an object."""
    entries = F.from_json(F.when(variant.startswith("{"), variant), "map<string,string>")
    return F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: k != "variant")


def stamp_in_name(name: Column) -> Column:
    """A date and time, or seconds since 1970, that stand in a file's name."""
    return F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6}|\d{10}(?:\.\d+)?)", 1), F.lit(""))


def rounded(x: Column, digits: int = 4) -> Column:
    """For display: what is no finite number counts as 0."""
    return F.when(x.isNull(), None).when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.round(x, digits))


def error_family(name: Column) -> Column:
    return _first([(F.lower(name).rlike("|".join(words)), fam) for fam, words in ERROR_FAMILIES.items()], "other")


def behaviour_cluster(errors: Column, anomaly: Column, infra: Column, unready: Column, cpu_delta: Column, memory: Column) -> Column:
    return _first([((errors > 0) | (anomaly >= 0.5), "log_error_or_dependency_failure"), (infra | (unready > 0), "infra_unhealthy"), ((cpu_delta > 0) | (memory > 0), "active_but_no_errors")], "low_signal_or_no_data")


def confidence(gaps: Column) -> Column:
    return F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.lit(0.85) - gaps * 0.12))


def blocked(command: Column) -> Column:
    """The first unsafe pattern a command matches, else null."""
    return F.coalesce(*[F.when(command.rlike(f"(?i){p}"), F.lit(p)) for p in BLOCKED_COMMANDS])


def with_context(command: Column, context: str) -> Column:
    needs = command.startswith("kubectl") & ~command.contains("--context")
    return F.when(needs, F.regexp_replace(command, r"^(kubectl )", f"kubectl --context {context} ")).otherwise(command)


def command_lines(raw: Column, most: int = 15) -> Column:
    """array<string> of the commands in a reply: fences, prompts, comments and prose dropped."""
    lines = F.transform(F.split(F.regexp_replace(raw, r"```[a-zA-Z]*\n?", ""), r"\r?\n"), lambda l: F.trim(F.regexp_replace(F.regexp_replace(F.trim(l), r"^\$\s*", ""), r"^[> ]+", "")))
    return F.slice(F.filter(lines, lambda l: l.rlike(r"^(kubectl|helm|mongosh|--|')")), 1, most)


def json_in_text(text: Column) -> Column:
    """The reply itself, a fenced block, or the widest braces or brackets, whichever is JSON first; else null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    tries = [t, F.regexp_extract(t, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1), F.regexp_extract(t, r"\{[\s\S]*\}", 0), F.regexp_extract(t, r"\[[\s\S]*\]", 0)]
    return F.coalesce(*[F.when((x != "") & F.try_parse_json(x).isNotNull(), x) for x in tries])


def failure_reason(post_ready: Column, tracked: Column, run: Column, failed: Column) -> Column:
    partly = F.concat_ws("/", post_ready.cast("string"), tracked.cast("string"))
    return F.when((tracked > 0) & (post_ready < tracked), F.concat(partly, F.lit(" relevant pods ready after commands"))).when(run == 0, "no commands generated").when(failed > 0, F.concat(failed.cast("string"), F.lit(" commands failed"))).otherwise("pods not healthy after stabilization")
