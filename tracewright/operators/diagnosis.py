"""Service levels, root-cause scores, health, relevance for a twin, fault signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import rules

SERVICE = ["scenario_id", "service"]


def reasons(*pairs) -> F.Column:
    return F.filter(F.array(*[F.when(hit, text) for hit, text in pairs]), lambda x: x.isNotNull())


def three(x: F.Column) -> F.Column:
    """A number with three decimals."""
    return F.format_string("%.3f", x.cast("double"))


def edge_name() -> F.Column:
    return F.concat_ws("->", "src", "dst")


def service_sla(state: DataFrame) -> DataFrame:
    """From (scenario_id, service, latency_ms, anomaly, pods_unready, crashloop); all limits are strict. Snapshots of a
    series have a scenario id (or a further key column) of their own."""
    c = F.col
    r = reasons((c("latency_ms") > 500, F.concat(F.lit("latency_high="), c("latency_ms").cast("string"))), (c("anomaly") > 0.5, F.concat(F.lit("log_anomaly="), three(c("anomaly")))), (c("pods_unready") > 0, "pods_unready"), (c("crashloop") > 0, "crashloop"))
    return state.withColumn("reasons", r).withColumn("violated", F.size("reasons") > 0)


def edge_sla(edges: DataFrame) -> DataFrame:
    late = F.col("latency_p95_us") / 1000
    r = reasons((F.col("error_ratio") > 0.2, F.concat(F.lit("error_ratio="), three(F.col("error_ratio")))), (late > 800, F.concat(F.lit("latency_p95_ms="), three(late))))
    return edges.withColumn("reasons", r).withColumn("violated", F.size("reasons") > 0)


def workload_sla(scenarios: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario_id, total_requests, reasons): traffic that no trace shows is a gap in what is observed, not a violation."""
    made = scenarios.select("scenario_id").distinct().join(edges.groupBy("scenario_id").agg(F.sum("num_requests").alias("total_requests")), "scenario_id", "left").fillna({"total_requests": 0})
    return made.withColumn("reasons", reasons((F.col("total_requests") == 0, "no_trace_traffic_observed")))


def global_sla(services: DataFrame, edges: DataFrame, unhealthy: DataFrame, keys: tuple = ("scenario_id",)) -> DataFrame:
    """One row a scenario, or a snapshot where the keys have its time: counts, flags and reasons."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    made = services.select(*keys).union(edges.select(*keys)).union(unhealthy.select(*keys)).distinct()
    for d, name in ((services.where("violated"), "service_violations"), (edges.where("violated"), "edge_violations"), (unhealthy, "unhealthy_services")):
        made = made.join(n(d, name), [*keys], "left")
    made = made.fillna(0)
    bad, many = F.col("edge_violations") > 0, F.col("unhealthy_services") > 1
    r = reasons((bad, "dependency_failures_present"), (F.col("unhealthy_services") > 0, "unhealthy_services_present"), (many, "multiple_unhealthy_services"))
    return made.withColumn("violated", bad | (F.col("unhealthy_services") > 0)).withColumn("multiple_unhealthy", many).withColumn("reasons", r)


# what service levels read of a stored state
STATE = "metrics map<string,struct<latency:double,latency_ms:double>>, logs map<string,struct<log_anomaly_score:double>>, system map<string,struct<pods_unready:bigint,crashloop_count:bigint,service_health_status:string>>, traces map<string,struct<error_ratio:double,latency_p95_us:double>>"


def snapshot_sla(states: DataFrame) -> DataFrame:
    """``global_sla`` of each stored state of a series, from (scenario_id, path, line_no, row), row its JSON text. A service or edge
    that a state doesn't hold has no violation in it; a state without any counts as fine."""
    keys = ["scenario_id", "path", "line_no"]
    s = states.select(*keys, F.from_json("row", STATE).alias("s")).select(*keys, "s.*")
    part = lambda name: F.coalesce(name, F.create_map().cast(s.schema[name].dataType))
    own = s.withColumns({c: part(c) for c in ("metrics", "logs", "system", "traces")})
    every = F.array_distinct(F.concat(*[F.map_keys(c) for c in ("metrics", "logs", "system")]))
    one = own.select(*keys, "metrics", "logs", "system", F.explode(every).alias("service"))
    at = lambda m, f, none: F.coalesce(F.try_element_at(m, "service")[f], F.lit(none))
    late = F.coalesce(F.try_element_at("metrics", "service")["latency"], F.try_element_at("metrics", "service")["latency_ms"], F.lit(0.0))
    state = one.select(*keys, "service", late.alias("latency_ms"), at("logs", "log_anomaly_score", 0.0).alias("anomaly"), at("system", "pods_unready", 0).alias("pods_unready"), at("system", "crashloop_count", 0).alias("crashloop"), at("system", "service_health_status", "unknown").alias("status"))
    calls = own.select(*keys, F.explode("traces").alias("edge", "t")).select(*keys, F.substring_index("edge", "->", 1).alias("src"), F.substring_index("edge", "->", -1).alias("dst"), F.coalesce("t.error_ratio", F.lit(0.0)).alias("error_ratio"), F.coalesce("t.latency_p95_us", F.lit(0.0)).alias("latency_p95_us"))
    made = global_sla(service_sla(state), edge_sla(calls), state.where("status not in ('healthy', 'unknown')"), tuple(keys))
    return states.select(*keys).join(made, keys, "left").fillna({"service_violations": 0, "edge_violations": 0, "unhealthy_services": 0, "violated": False, "multiple_unhealthy": False})


def rca_evidence(state: DataFrame, edges: DataFrame, faults: DataFrame) -> DataFrame:
    """(scenario_id, service, score, reason, ord): every term of the scores and every reason, in the order they are told.

    From state (.., anomaly, dominant_error_type, latency_ms, metric_restarts, infra_issue, status), judged edges, and known fault
    instances (scenario_id, service, fault_family, variant). A reason without a score counts 0, and a score without one has no reason.
    """
    c, none = F.col, F.lit("")

    def own(d: DataFrame, hit, score, why, source: int, place=none, no: int = 0) -> DataFrame:
        ord_ = F.struct(F.lit(source).alias("source"), place.alias("place"), F.lit(no).alias("no"))
        return d.where(hit).select(*SERVICE, score.cast("double").alias("score"), why.alias("reason"), ord_.alias("ord"))

    into = edges.withColumn("service", c("dst"))
    known = faults.join(state.select(*SERVICE, "status"), SERVICE, "left")
    bad = ~F.coalesce("status", F.lit("unknown")).isin("healthy", "unknown")
    say = lambda name, x: F.concat(F.lit(f"{name}="), x)
    nothing, silent = F.lit(0.0), F.lit(None).cast("string")
    fault = F.format_string("%012d", F.col("no")) if "no" in faults.columns else F.coalesce("fault_family", none)
    # the reasons of one edge stand side by side, and so do those of one fault
    parts = [
        own(state, c("anomaly") > 0, c("anomaly"), say("log_anomaly", three(c("anomaly"))), 1),
        own(state, c("dominant_error_type") != "none", nothing, say("log_error_type", c("dominant_error_type")), 2),
        own(state, c("latency_ms") > 500, F.lit(0.25), say("high_latency_ms", three(c("latency_ms"))), 3),
        own(state, c("metric_restarts") > 0, F.lit(0.2), F.lit("container_restarts_metric"), 4),
        own(state, c("infra_issue"), F.lit(0.5), say("infra_issue", c("status")), 5),
        own(into, (c("edge_score") > 0) & (c("edge_score") <= 0.2), c("edge_score"), silent, 6, c("src"), 1),
        own(into, c("edge_score") > 0.2, c("edge_score"), say("trace_edge_issue", edge_name()), 6, c("src"), 1),
        own(into, c("edge_score") > 0.2, nothing, say("trace_failure_type", c("failure_type")), 6, c("src"), 2),
        own(into, (c("src") == c("dst")) & (c("error_ratio") > 0.3), F.lit(0.4), F.lit("self_loop_failure"), 6, c("src"), 3),
        own(known, F.lit(True), F.when(bad, 1.25).otherwise(0.35), say("scenario_fault_context", rules.fault_type(c("fault_family"))), 7, fault, 1),
        own(known, bad, nothing, say("direct_system_status", c("status")), 7, fault, 2),
        own(known, rules.variant_name(c("variant")) != "default", nothing, say("scenario_variant", rules.variant_name(c("variant"))), 7, fault, 3),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def rca_scores(state: DataFrame, edges: DataFrame, faults: DataFrame, most: int = 10) -> DataFrame:
    """(scenario_id, service, score, reasons): additive scores and the first reasons behind them, see ``rca_evidence``."""
    told = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason")))), 1, most), lambda x: x["reason"])
    return rca_evidence(state, edges, faults).groupBy(*SERVICE).agg(F.sum("score").alias("score"), told.alias("reasons"))


def observability_gaps(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario_id, gaps, confidence) from what no service of a scenario has."""
    seen = state.groupBy("scenario_id").agg(F.max(F.col("lines") > 0).alias("log"), F.max("metric_signal_present").alias("metric"), F.max(F.col("pods_total") > 0).alias("system"))
    made = seen.join(edges.select("scenario_id").distinct().withColumn("trace", F.lit(True)), "scenario_id", "full_outer").fillna(False, ["log", "metric", "system", "trace"])
    gaps = reasons((~F.col("log"), "log_pipeline_empty"), (~F.col("metric"), "resource_metric_pipeline_empty"), (~F.col("trace"), "trace_pipeline_empty"), (~F.col("system"), "system_pipeline_empty"))
    return made.select("scenario_id", gaps.alias("gaps")).withColumn("confidence", F.round(rules.confidence(F.size("gaps")), 3))


def hypotheses(faults: DataFrame) -> DataFrame:
    """(scenario_id, hypotheses): the known fault instances of a scenario in order, as structs service, fault_type, fault_family,
    variant_name, variant_params, source."""
    text = F.col("variant")
    one = F.struct("no", "service", rules.fault_type(F.col("fault_family")).alias("fault_type"), "fault_family", rules.variant_name(text).alias("variant_name"), F.to_json(rules.variant_params(F.coalesce(text, F.lit("")))).alias("variant_params"), F.lit("generated_fault_context").alias("source"))
    listed = faults.where("service is not null and service <> ''").groupBy("scenario_id").agg(F.array_sort(F.collect_list(one)).alias("h"))
    return listed.select("scenario_id", F.transform("h", lambda x: x.dropFields("no")).alias("hypotheses"))


def rca_summary(scores: DataFrame, state: DataFrame, edges: DataFrame, faults: DataFrame) -> DataFrame:
    """One row a scenario: the most suspicious service and edge, the dominant family, gaps and confidence, whether several faults
    are known, the expected services, the primary hypothesis, and all hypotheses: the known faults, else the primary one."""
    top = ranked(scores).where("rank = 1").select("scenario_id", F.col("service").alias("top_service"))
    best = edges.groupBy("scenario_id").agg(F.min_by(edge_name(), F.struct(-F.col("edge_score"), "src", "dst")).alias("top_edge"), F.max("edge_score").alias("top_edge_score"))
    expected = faults.groupBy("scenario_id").agg(F.sort_array(F.collect_set("service")).alias("expected_services"), F.count("*").alias("num_fault_instances"))
    made = observability_gaps(state, edges)
    for d in (top, best, hypotheses(faults), expected):
        made = made.join(d, "scenario_id", "left")
    first = F.get("hypotheses", F.lit(0))
    multi = F.coalesce(F.col("num_fault_instances") > 1, F.lit(False))
    told = F.when(multi, "multifault").otherwise(F.coalesce(first["fault_type"], F.lit("unknown")))
    family = F.when(told != "unknown", told).when(F.col("top_edge_score") > 0.4, "dependency_failure").otherwise("unknown")
    made = made.withColumns({"hypothesis_service": F.coalesce("top_service", first["service"]), "hypothesis_type": F.coalesce(first["fault_type"], told)})
    none = F.lit(None).cast("string")
    primary = F.struct(F.col("hypothesis_service").alias("service"), F.col("hypothesis_type").alias("fault_type"), none.alias("fault_family"), none.alias("variant_name"), none.alias("variant_params"), F.lit("ranking").alias("source"))
    every = F.coalesce("hypotheses", F.array(primary))
    return made.select("scenario_id", "top_service", "top_edge", family.alias("dominant_family"), "gaps", "confidence", multi.alias("is_multifault"), F.coalesce("expected_services", F.array().cast("array<string>")).alias("expected_services"), "hypothesis_service", "hypothesis_type", every.alias("hypotheses"))


def ranked(scores: DataFrame, most: int = 8) -> DataFrame:
    order = Window.partitionBy("scenario_id").orderBy(F.col("score").desc(), "service")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def service_health(state: DataFrame, edges: DataFrame, ranks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Dependency trouble outranks application trouble, which outranks infrastructure; a suspect without
    any is silent. ``expected`` are labelled services: leave it out to keep labels from the result."""
    hit = edges.where("is_suspicious").select("scenario_id", F.col("dst").alias("service"), edge_name().alias("edge")).groupBy("scenario_id", "service").agg(F.sort_array(F.collect_set("edge")).alias("called_badly"))
    suspects = ranks.where("rank <= 3").select(*SERVICE)
    if expected is not None:
        suspects = suspects.union(expected.select(*SERVICE))
    all_ = state.join(hit, SERVICE, "left").join(suspects.distinct().withColumn("suspect", F.lit(True)), SERVICE, "left")
    infra, app = F.col("infra_issue") & ~F.col("status").isin("healthy", "unknown"), F.col("anomaly") > 0.4
    health = F.when(F.col("called_badly").isNotNull(), "dependency_degraded").when(app, "app_degraded").when(infra, "infra_degraded").when(F.col("suspect"), "suspect_silent_failure").otherwise("healthy")
    calls = F.transform("called_badly", lambda e: F.concat(F.lit("incoming_trace_issue="), e))
    told = F.concat(reasons((infra, F.col("status")), (app, "log_anomaly")), F.coalesce(calls, F.array().cast("array<string>")), reasons((health == "suspect_silent_failure", "ranked_by_rca_context_or_weak_signals")))
    return all_.select(*SERVICE, health.alias("health"), F.slice(told, 1, 8).alias("reasons"))


def twin_membership(health: DataFrame, scores: DataFrame, clusters: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """Which services a twin needs, and why: label, candidate, health, cluster, and only without any of these a bad incoming call."""
    flag = lambda d, name: d.select(*SERVICE).distinct().withColumn(name, F.lit(True))
    top = ranked(scores, 5).where("score > 0.2 or rank = 1")
    cascade = edges.where("is_suspicious or error_ratio > 0.3").withColumn("service", F.col("dst"))
    all_ = health.join(clusters.select(*SERVICE, "cluster"), SERVICE, "left")
    for d, name in ((known, "f"), (top, "t"), (cascade, "c")):
        all_ = all_.join(flag(d, name), SERVICE, "left")
    why = reasons((F.col("f"), "known_faulty_service_from_spec"), (F.col("t"), "top_rca_candidate"), (F.col("health") != "healthy", F.concat(F.lit("service_health="), "health")), (F.col("cluster") == "log_error_or_dependency_failure", "in_log_error_cluster"), (F.col("cluster") == "infra_unhealthy", "in_infra_unhealthy_cluster"))
    why = F.when((F.size(why) == 0) & F.col("c"), F.array(F.lit("suspicious_incoming_trace_edge"))).otherwise(why)
    return all_.select(*SERVICE, why.alias("reasons")).withColumn("relevant", F.size("reasons") > 0)


def twin_pods(membership: DataFrame, pods: DataFrame, namespace: str, context: str) -> DataFrame:
    """(scenario_id, service, pod, relevant, command) of the pods of all services, with the command that would remove
    a pod of a service without relevance; commands are data here, nothing runs them."""
    command = F.format_string(f"kubectl --context {context} delete pod %s -n {namespace} --ignore-not-found", "pod")
    return membership.select(*SERVICE, "relevant").join(pods.select(*SERVICE, F.explode("pod_names").alias("pod")), SERVICE).withColumn("command", F.when(~F.col("relevant"), command))


def twin_summary(membership: DataFrame) -> DataFrame:
    names = lambda hit: F.sort_array(F.collect_list(F.when(hit, F.col("service"))))
    why = lambda r: F.array_contains("reasons", r)
    return membership.groupBy("scenario_id").agg(F.count("*").alias("total"), F.count_if("relevant").alias("relevant"), F.count_if(~F.col("relevant")).alias("bystanders"), names(why("known_faulty_service_from_spec")).alias("known_faulty"), names(why("top_rca_candidate")).alias("suspects"))


def fault_signature(edges: DataFrame, state: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """(scenario_id, service, signal, n): bad incoming edges, slow ones, bad status, anomalies, known families."""
    into = edges.withColumn("service", F.col("dst"))
    own = lambda d, hit, name: d.where(hit).select(*SERVICE, F.lit(name).alias("signal"))
    every = own(into, "error_ratio > 0.2", "trace_error_edges").union(own(into, "latency_p95_us > 100000", "latency_degradation_edges"))
    every = every.union(own(state, "status not in ('healthy', 'unknown')", "infra_issue_count")).union(own(state, "anomaly > 0.2", "log_anomaly_count"))
    every = every.union(state.where("status not in ('healthy', 'unknown')").select(*SERVICE, F.concat(F.lit("system_status:"), "status")))
    if faults is not None:
        named = rules.variant_name(F.col("variant"))
        every = every.union(faults.select(*SERVICE, F.coalesce("fault_family", F.lit("known_fault_context"))))
        every = every.union(faults.where(named != "default").select(*SERVICE, F.concat(F.lit("variant:"), named)))
    return every.groupBy(*SERVICE, "signal").agg(F.count("*").alias("n"))


def fault_library(signature: DataFrame) -> DataFrame:
    """(scenario_id, service, fault_type) by rules over the signals of a service, and a row without a service for each
    of the library's types that no service of the scenario has."""
    s = signature.groupBy(*SERVICE).agg(F.collect_set("signal").alias("s"))
    has = lambda name: F.array_contains("s", name)
    auth, variant = F.exists("s", lambda x: x.contains("auth")), F.exists("s", lambda x: x.startswith("variant:"))
    kinds = reasons((has("trace_error_edges") & ~auth, "dependency_failure"), (auth, "auth_failure"), (has("latency_degradation_edges"), "latency_degradation"), (has("infra_issue_count"), "infra_failure"), (variant, "variant_specific"))
    found = s.select(*SERVICE, F.explode(kinds).alias("fault_type"))
    every = signature.select("scenario_id").distinct().withColumn("fault_type", F.explode(F.array(*[F.lit(t) for t in rules.LIBRARY_FAULT_TYPES])))
    rest = every.join(found.select("scenario_id", "fault_type"), ["scenario_id", "fault_type"], "left_anti")
    return found.union(rest.select("scenario_id", F.lit(None).cast("string"), "fault_type"))
