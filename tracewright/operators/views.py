"""Assembled state of a scenario: compressed views, the redacted document, model features, agent inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.operators.diagnosis import edge_name
from tracewright.operators.grouping import compact

SERVICE = ["scenario_id", "service"]
FLAT_FIGURES = ["cpu_usage_delta", "cpu_load_last", "memory_working_set_last", "memory_usage_last", "network_rx_bytes_delta", "network_tx_bytes_delta", "network_tx_errors_delta", "threads_last", "latency_ms"]


def nodes(services: DataFrame, metrics: DataFrame, logs: DataFrame, system: DataFrame) -> DataFrame:
    """Each known service with what there is of it: structs metrics, logs and system, null where a source has nothing."""
    made = services.select(*SERVICE).distinct()
    for d, name in ((metrics, "metrics"), (logs, "logs"), (system, "system")):
        made = made.join(d.select(*SERVICE, F.struct(*[c for c in d.columns if c not in SERVICE]).alias(name)), SERVICE, "left")
    return made


def system_view(system: DataFrame, endpoints: DataFrame | None = None, deployments: DataFrame | None = None, events: DataFrame | None = None, most_events: int = 5) -> DataFrame:
    """(scenario_id, service, health, pods, nodes, containers, images): a struct of eleven figures and lists cut to what can be
    read; and from the other tables, if given, endpoints (ready, not ready), the deployment with its replica counts, and the first
    ``most_events`` events in order of ``no`` (type, reason, message)."""
    c = F.col
    figures = ["status", "infra_issue", "availability", "pods_total", "pods_ready", "pods_unready", "restarts", "crashloop", "oomkilled", "image_pull_error", "warnings"]
    health = F.struct(*[F.round(c(f), 4).alias(f) if f == "availability" else c(f) for f in figures])
    lists = {"pod_names": ("pods", 10), "nodes": ("nodes", 5), "containers": ("containers", 10), "images": ("images", 5)}
    made = system.select(*SERVICE, health.alias("health"), *[compact(c(k), most).alias(name) for k, (name, most) in lists.items() if k in system.columns])
    if endpoints is not None:
        made = made.join(endpoints.select(*SERVICE, F.struct("ready_endpoints", "not_ready_endpoints").alias("endpoints")), SERVICE, "left")
    if deployments is not None:
        replicas = ["deployment", "replicas", "ready_replicas", "available_replicas", "unavailable_replicas"]
        made = made.join(deployments.select(*SERVICE, F.struct(*replicas).alias("deployment")), SERVICE, "left")
    if events is not None:
        first = events.withColumn("_n", F.row_number().over(Window.partitionBy(*SERVICE).orderBy("no"))).where(c("_n") <= most_events)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "type", "reason", "message"))), lambda e: e.dropFields("_n"))
        made = made.join(first.groupBy(*SERVICE).agg(listed.alias("events")), SERVICE, "left")
    return made


def metric_view(services: DataFrame, flat: DataFrame) -> DataFrame:
    """(scenario_id, service, flat_summary): nine rounded figures, zeros for a service without samples."""
    made = services.select(*SERVICE).distinct().join(flat, SERVICE, "left")
    return made.select(*SERVICE, F.struct(*[rules.rounded(F.coalesce(n, F.lit(0.0))).alias(n) for n in FLAT_FIGURES]).alias("flat_summary"), F.coalesce("metric_signal_present", F.lit(False)).alias("metric_signal_present"))


def log_view(features: DataFrame, families: DataFrame, examples: DataFrame, most: int = 5) -> DataFrame:
    """(scenario_id, service, signal, severity_counts, error_families, dependency_counts, evidence, templates)."""
    signal = F.struct("lines", "errors", "warns", "fatals", "log_anomaly_score", "log_health_score", "dominant_error_type")
    fam = families.groupBy(*SERVICE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n")))).alias("error_families"))
    made = features.join(fam, SERVICE, "left").join(examples, SERVICE, "left")
    none = F.array().cast("array<string>")
    first = lambda c: F.slice(F.coalesce(c, none), 1, most)
    return made.select(*SERVICE, signal.alias("signal"), "severity_counts", F.coalesce("error_families", F.create_map().cast("map<string,bigint>")).alias("error_families"), "dependency_counts", first("evidence_lines").alias("evidence"), first("error_templates").alias("templates"))


def model_vector(state: DataFrame) -> DataFrame:
    """Ten rounded numeric features of each service."""
    r = lambda c: F.coalesce(rules.rounded(F.col(c).cast("double")), F.lit(0.0))
    names = {"cpu_delta": "cpu_usage_delta", "mem_usage_last": "memory_usage_last", "threads_last": "threads_last", "log_errors": "errors", "log_warnings": "warns", "log_anomaly": "anomaly", "restart_count": "restarts", "pods_unready": "pods_unready", "availability_ratio": "availability"}
    return state.select(*SERVICE, *[r(c).alias(name) for name, c in names.items()], F.when(F.col("infra_issue"), 1.0).otherwise(0.0).alias("infra_issue"))


def suspicious_edges(edges: DataFrame, most: int = 12) -> DataFrame:
    """Per scenario the edges to look at: suspicious, with any error, or with a score over 0.1; the highest by score, ratio
    and latency, ties by name."""
    order = Window.partitionBy("scenario_id").orderBy(F.desc("edge_score"), F.desc("error_ratio"), F.desc("latency_p95_us"), "src", "dst")
    hit = F.col("is_suspicious") | (F.col("error_ratio") > 0) | (F.col("edge_score") > 0.1)
    return edges.where(hit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("edge", edge_name())


def degraded_services(health: DataFrame, state: DataFrame) -> DataFrame:
    """(scenario_id, service, status, reasons) of services whose health isn't fine or whose pods aren't, with the reasons of both."""
    bad = state.where("infra_issue or pods_unready > 0 or crashloop > 0").select(*SERVICE, F.col("status").alias("pod_status"))
    sick = health.where("health <> 'healthy'").select(*SERVICE, "health", "reasons")
    made = sick.join(bad, SERVICE, "full_outer")
    own = F.coalesce("reasons", F.array().cast("array<string>"))
    every = F.when(F.col("pod_status").isNotNull(), F.array_union(own, F.array("pod_status"))).otherwise(own)
    return made.select(*SERVICE, F.coalesce("health", "pod_status").alias("status"), F.sort_array(every).alias("reasons"))


def llm_view(features: DataFrame, families: DataFrame, examples: DataFrame, most: int = 15, anomalous: float = 0.3) -> DataFrame:
    """Per scenario the services with most log errors, with families and two lines of evidence."""
    view = log_view(features, families, examples, 2).select(*SERVICE, "error_families", "dependency_counts", "evidence", F.col("signal.errors").alias("errors"), F.col("signal.dominant_error_type").alias("dominant_error_type"), F.col("signal.log_anomaly_score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("errors"), "service"))
    return view.where((F.col("errors") > 0) | (F.col("score") > anomalous)).withColumn("rank", rank).where(F.col("rank") <= most).drop("score")


def grouped_profiles(rows: DataFrame) -> DataFrame:
    """Services of one scenario whose rows are alike, together: (scenario_id, profile, services)."""
    profile = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in SERVICE)), {"ignoreNullFields": "false"})
    return rows.groupBy("scenario_id", profile.alias("profile")).agg(F.sort_array(F.collect_list("service")).alias("services"))
