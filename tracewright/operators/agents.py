"""Texts that go to agents, and what is kept of their replies, all as columns; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import rules

SERVICE = ["scenario_id", "service"]
# fixed values: actions offered for a service (template, effect, risk), those for credentials, static libraries
ACTIONS = [
    ("kubectl rollout restart deployment/{svc} -n {ns}", "restart deployment pods", "medium"),
    ("kubectl rollout status deployment/{svc} -n {ns} --timeout=120s", "verify rollout", "none"),
    ("kubectl delete pod <pod-name> -n {ns} --grace-period=0 --force", "recreate stuck pod", "low"),
    ("kubectl scale deployment/{svc} --replicas=<n> -n {ns}", "change replica count", "medium"),
    ("kubectl patch configmap <name> -n {ns} --type=merge -p '{\"data\":{\"<key>\":\"<value>\"}}'", "fix config", "medium"),
    ("helm rollback <release> <revision> -n {ns}", "rollback release", "medium"),
    ("kubectl get pod -n {ns} -o wide", "verify pod status", "none"),
]
AUTH_ACTION = ("kubectl exec -it <mongodb-pod> -n {ns} -- mongosh admin --eval \"db.updateUser('<user>', {pwd: '<password>'})\"", "repair MongoDB credentials", "high")
LIBRARY_ACTIONS = [("restart_service", "medium"), ("scale_service", "low_to_medium"), ("rollback_config", "medium"), ("disable_edge", "high"), ("wait", "low")]
GAP_MEANINGS = [("trace_pipeline_empty", "lack of traces weakens dependency RCA"), ("resource_metric_pipeline_empty", "zero metrics can mean missing telemetry"), ("log_pipeline_empty", "absence of logs is not service health")]
OBSERVED = [("auth_failure", "trace_error_ratio", "high_or_missing"), ("auth_failure", "pod_health", "healthy"), ("auth_failure", "logs", "may_be_sparse"), ("auth_failure", "resource_metrics", "normal_possible"), ("dependency_failure", "trace_error_ratio", "high"), ("dependency_failure", "pod_health", "healthy_possible"), ("infra_failure", "pod_health", "unready_or_crashloop"), ("latency_degradation", "latency", "high")]
# fixed values: texts of the prompts
RCA_HEAD = "# Root Cause Analysis Task\nScenario : %s\nNamespace: %s\nTask type: %s\n\nYou are given REDACTED telemetry only. Ground truth and generated fault labels have been removed.\nInfer the root cause from service health, logs, traces, metrics, and SLA evidence.\n"
RCA_NONE = "  No directly degraded Kubernetes service-health signal was found."
RCA_TASK = """## Your Task
Return ONLY valid JSON in this exact schema:
```json
{
  "root_cause_service": "<service_name>",
  "fault_type": "<auth_failure|dependency_failure|infra_failure|latency_degradation|config_error|pod_failure|network_failure|resource_exhaustion>",
  "explanation": "<concise explanation citing specific evidence>",
  "affected_services": ["<svc1>", "<svc2>"],
  "digital_twin_injection_spec": {
    "target_service": "<service_name>",
    "fault_type": "<normalized_fault_type>",
    "expected_symptoms": ["<symptom1>", "<symptom2>"]
  },
  "confidence": <0.0-1.0>
}
```"""
OPTIMIZER_TASK = "Generate a detailed instruction prompt for the Action Agent. The Action Agent must output only kubectl/helm commands in order. Include service names, namespace, pod/deployment details, verification commands, and a different strategy if previous attempts failed."
ACTION_TASK = "Output ONLY executable commands, one per line, in exact execution order. Use real kubectl/helm syntax. No explanations, no markdown, no comments."


def library_rules(found: DataFrame) -> DataFrame:
    """What the fixed libraries tell of each row of (scenario_id, service, fault_type, gaps): (scenario_id, service, kind, name,
    value): the meaning of each gap, and what the fault type is expected to show."""
    gaps = F.filter(F.array(*[F.when(F.array_contains("gaps", g), F.struct(F.lit("gap").alias("kind"), F.lit(g).alias("name"), F.lit(m).alias("value"))) for g, m in GAP_MEANINGS]), lambda x: x.isNotNull())
    shown = F.filter(F.array(*[F.when(F.col("fault_type") == f, F.struct(F.lit("observed").alias("kind"), F.lit(k).alias("name"), F.lit(v).alias("value"))) for f, k, v in OBSERVED]), lambda x: x.isNotNull())
    return found.select(*SERVICE, F.explode(F.concat(gaps, shown)).alias("r")).select(*SERVICE, "r.*")


def action_library(requests: DataFrame) -> DataFrame:
    """A row for each action offered for (scenario_id, service, fault_type, namespace), in order; names that are missing stand as marks."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{svc}"), F.coalesce(F.nullif("service", F.lit("")), F.lit("<service>"))), F.lit("{ns}"), F.coalesce(F.nullif("namespace", F.lit("")), F.lit("<namespace>")))
    made = [F.struct(F.lit(k).alias("no"), fill(t).alias("command"), F.lit(e).alias("effect"), F.lit(r).alias("risk")) for k, (t, e, r) in enumerate([*ACTIONS, AUTH_ACTION])]
    auth = F.lower(F.coalesce("fault_type", F.lit(""))).contains("auth")
    offered = F.when(auth, F.array(*made)).otherwise(F.array(*made[:-1]))
    return requests.select(*SERVICE, F.explode(offered).alias("a")).select(*SERVICE, "a.*")


def lines_of(rows: DataFrame, text: Column, order: list, name: str, most: int = 0) -> DataFrame:
    """(scenario_id, name): the lines of a section in order, as one text."""
    each = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], text.alias("text"))))
    each = F.slice(each, 1, most) if most else each
    return rows.groupBy("scenario_id").agg(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias(name))


def rca_prompt(scenarios: DataFrame, degraded: DataFrame, errors: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(scenario_id, prompt) for a reader of redacted telemetry: sections of degraded services, log errors with two lines of
    evidence each, calls and clusters, then the task; from scenarios (scenario_id, namespace, task) and the views of
    ``operators.views``. A section without rows but the first is left out."""
    c = F.col
    sick = lines_of(degraded, F.format_string("  - %s: %s (%s)", "service", "status", F.array_join("reasons", ", ")), [c("service")], "sick")
    seen = F.transform(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 2), lambda e: F.concat(F.lit("\n      evidence: "), F.substring(e, 1, 220)))
    bad = lines_of(errors, F.concat(F.format_string("  - %s: errors=%d dominant=%s", "service", "errors", "dominant_error_type"), F.array_join(seen, "")), [c("rank")], "bad", 8)
    calls = lines_of(edges, F.format_string("  - %s error_ratio=%.3f p95_ms=%.2f type=%s", "edge", "error_ratio", c("latency_p95_us") / 1000, "failure_type"), [c("rank")], "calls", 8)
    named = clusters.groupBy("scenario_id", "cluster").agg(F.array_join(F.sort_array(F.collect_list("service")), ", ").alias("names"))
    groups = lines_of(named, F.format_string("  %s: %s", "cluster", "names"), [c("cluster")], "groups")
    made = scenarios
    for d in (sick, bad, calls, groups):
        made = made.join(d, "scenario_id", "left")
    head = F.format_string(RCA_HEAD, "scenario_id", "namespace", "task")
    section = lambda title, body: F.when(F.col(body).isNotNull(), F.concat(F.lit(f"## {title}\n"), F.col(body), F.lit("\n")))
    first = F.concat(F.lit("## Degraded / Suspicious Services\n"), F.coalesce("sick", F.lit(RCA_NONE)), F.lit("\n"))
    return made.select("scenario_id", F.concat_ws("\n", head, first, section("Top Log Error Signals", "bad"), section("Suspicious Trace Edges", "calls"), section("Service Behaviour Clusters", "groups"), F.lit(RCA_TASK)).alias("prompt"))


def optimizer_input(results: DataFrame, system: DataFrame, attempts: DataFrame, iterations: int = 7) -> DataFrame:
    """One row a scenario: what a writer of instructions gets. From ``validated`` results with namespace and iteration, the state of
    pods (.., pod_names, status, restarts, crashloop, deployment), and earlier attempts (scenario_id, iteration, commands, result, reward,
    failure_reason)."""
    about = F.struct(F.col("root_cause_service").alias("faulty_service"), "fault_type", "explanation", "affected_services")
    named = results.select("scenario_id", F.explode(F.array_distinct(F.concat(F.array("root_cause_service"), "affected_services"))).alias("service")).where("service <> ''")
    state = named.join(system.select(*SERVICE, "pod_names", "status", "restarts", "crashloop", "deployment"), SERVICE, "left")
    none = F.array().cast("array<string>")
    one = F.struct("service", F.coalesce("pod_names", none).alias("pods"), F.coalesce("status", F.lit("unknown")).alias("health_status"), F.coalesce("restarts", F.lit(0)).alias("restart_count"), F.coalesce("crashloop", F.lit(0)).alias("crashloop_count"), "deployment")
    pods = state.groupBy("scenario_id").agg(F.array_sort(F.collect_list(one)).alias("pod_details"))
    asked = results.select("scenario_id", F.col("root_cause_service").alias("service"), "fault_type", "namespace")
    offered = action_library(asked).groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("no", "command", "effect", "risk"))).alias("action_library"))
    tried = attempts.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct("iteration", "commands", "result", "reward", "failure_reason"))).alias("previous_attempts"))
    made = results.select("scenario_id", "namespace", "iteration", F.lit(iterations).alias("max_iterations"), about.alias("fault_summary"))
    for d in (pods, offered, tried):
        made = made.join(d, "scenario_id", "left")
    return made.withColumn("task_instruction", F.lit(OPTIMIZER_TASK))


def action_prompt(requests: DataFrame, most: int = 7) -> DataFrame:
    """(scenario_id, prompt) from (scenario_id, namespace, iteration, instruction)."""
    head = F.format_string(f"# Kubernetes Fault Remediation\nScenario : %s (iteration %d / {most})\nNamespace: %s\nkubectl context: kind-kind\n\n---\n\n%s\n\n---\n\n", "scenario_id", F.col("iteration") + 1, "namespace", "instruction")
    return requests.select("scenario_id", F.concat(head, F.lit(ACTION_TASK)).alias("prompt"))


def validated(replies: DataFrame) -> DataFrame:
    """From (scenario_id, reply, hint, faulty_service, fault_family), reply a model's text: the service it names, else the hint, else the
    known one; a fault type of the known set; confidence within 0 and 1."""
    json = rules.json_in_text(F.col("reply"))
    field = lambda name: F.nullif(F.get_json_object("_j", f"$.{name}"), F.lit(""))
    made = replies.withColumn("_j", json)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field("confidence").try_cast("double"), F.lit(0.5))))
    affected = F.coalesce(F.from_json(F.get_json_object("_j", "$.affected_services"), "array<string>"), F.array().cast("array<string>"))
    return made.select("scenario_id", F.coalesce(field("root_cause_service"), F.nullif("hint", F.lit("")), F.nullif("faulty_service", F.lit("")), F.lit("unknown")).alias("root_cause_service"), rules.valid_fault_type(F.coalesce(field("fault_type"), F.lit("")), F.col("fault_family")).alias("fault_type"), F.coalesce(field("explanation"), F.lit("No explanation provided.")).alias("explanation"), affected.alias("affected_services"), sure.alias("confidence"))


def involved_pods(results: DataFrame, system: DataFrame) -> DataFrame:
    """State of the pods of the root cause and the affected services of ``validated`` results."""
    named = results.select("scenario_id", F.explode(F.array_distinct(F.concat(F.array("root_cause_service"), "affected_services"))).alias("service")).where("service <> ''")
    return named.join(system.select(*SERVICE, "pod_names", "status", "restarts", "crashloop"), SERVICE, "left").withColumn("status", F.coalesce("status", F.lit("unknown"))).fillna({"restarts": 0, "crashloop": 0})
