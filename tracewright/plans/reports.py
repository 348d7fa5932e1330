"""Queries of the assembled state: views, reports, agent texts, batch bookkeeping, readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import logs as line
from tracewright.functions import names, rules
from tracewright.functions.storage import shared_folder
from tracewright.operators import agents, diagnosis, grouping, logs, metrics, outcome, system, traces, views
from tracewright.plans import registry as base
from tracewright.plans.registry import query
from tracewright.sources import scenario

KEY = ["scenario_id", "service"]
_join = lambda c: F.array_join(c, ",")

def _one() -> Column:
    return F.lit("s").alias("scenario_id")


def services(spark: SparkSession, d: str) -> DataFrame:
    """Known services: some have logs, some don't."""
    return spark.range(50).select(_one(), F.concat(F.lit("svc"), F.col("id").cast("string")).alias("service"))


_SERVICES = "kn AS (SELECT 'svc' || i AS service FROM range(50) t(i))"


_EVIDENCE = """ev0 AS (SELECT service, line_no, trim(line) AS line, row_number() OVER (PARTITION BY service ORDER BY line_no) AS no FROM (SELECT l.*, CASE k WHEN 0 THEN '[2026-May-01] <' || CASE WHEN n = 1 THEN 'W' WHEN n = 2 THEN 'warning' WHEN n < 14 THEN 'E' ELSE 'info' END || '>: (file.h:7:f) ' || message
  WHEN 1 THEN '2026/05/01 00:00:01 [' || CASE WHEN n = 10 THEN 'fatal' WHEN n = 12 THEN 'warn' WHEN n < 14 THEN 'crit' ELSE 'notice' END || '] ' || message
  WHEN 2 THEN '{"s":"' || CASE WHEN n = 3 THEN 'WARNING' WHEN n = 10 THEN 'F' WHEN n < 14 THEN 'E' WHEN n = 15 THEN 'D' ELSE 'I' END || '","msg":' || to_json(message) || ',"c":"core"}' ELSE message END AS line FROM l WHERE error_type <> 'none')),
ev1 AS (SELECT service, substr(line, 1, 700) AS line, min(no) AS no FROM ev0 WHERE no <= 20 GROUP BY 1, 2), ev AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY no) AS place FROM ev1)"""


@query(f"""WITH {base._LINES}, e AS (SELECT service, line_no, message, CASE k WHEN 3 THEN message END AS plain, row_number() OVER (PARTITION BY service ORDER BY line_no) AS no FROM l WHERE error_type <> 'none'),
t AS (SELECT service, message, min(no) AS no FROM e WHERE no <= 20 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY no) AS rank FROM t)
SELECT service, string_agg(message, '|' ORDER BY no) AS templates FROM r WHERE rank <= 10 GROUP BY 1""")
def log_templates(spark, d):
    return logs.examples(base.parsed(spark, d)).select("service", F.array_join("error_templates", "|").alias("templates"))


@query(f"WITH {base._LINES}, {_SERVICES} SELECT service, coalesce(lines, 0) AS lines, coalesce(errors, 0) AS errors, coalesce(dominant_error_type, 'none') AS dominant_error_type, coalesce(log_health_score, 1) AS log_health_score, coalesce(type_counts, '') AS types FROM kn LEFT JOIN lf USING (service)")
def log_defaults(spark, d):
    made = logs.with_defaults(services(spark, d), base.features(spark, d))
    return made.select("service", "lines", "errors", "dominant_error_type", "log_health_score", base._text("error_type_counts").alias("types"))


@query(f"WITH {base._LINES} SELECT kind, key, sum(n)::BIGINT AS n FROM fc WHERE kind IN ('type', 'dependency') GROUP BY 1, 2")
def global_error_counts(spark, d):
    return logs.global_counts(base.facts(spark, d)).drop("scenario_id")


_HIST = lambda value, where="TRUE": f"(SELECT service, string_agg(v || '=' || n, ',' ORDER BY v) AS t FROM (SELECT service, {value} AS v, count(*) AS n FROM pd WHERE {where} GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {base._PODS}, q AS {_HIST("CASE o_orderkey % 5 WHEN 0 THEN 'BestEffort' ELSE 'Burstable' END", "o_orderkey % 5 < 2")}, n AS {_HIST("service || '-rs'")},
co AS (SELECT service, string_agg(v || '=' || n, ',' ORDER BY v) AS t FROM (SELECT service, v, count(*) AS n FROM (SELECT service, unnest([CASE WHEN own_ready THEN 'Ready=True' ELSE 'Ready=False' END, 'Initialized=True']) AS v FROM pd) GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT service, string_agg(v || '=' || n, ',' ORDER BY v) AS t FROM (SELECT service, v, count(*) AS n FROM (SELECT service, unnest(CASE WHEN crash THEN ['CrashLoopBackOff', 'unknown'] WHEN img THEN ['ErrImagePull'] ELSE [] END) AS v FROM pd) GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT service, string_agg(DISTINCT 'side' || (o_orderkey % 2), ',' ORDER BY 'side' || (o_orderkey % 2)) AS c, string_agg(DISTINCT 'img:' || (o_orderkey % 3), ',' ORDER BY 'img:' || (o_orderkey % 3)) AS i, string_agg(DISTINCT '10.0.0.' || (o_orderkey % 4), ',' ORDER BY '10.0.0.' || (o_orderkey % 4)) AS a, count(*) AS ports FROM pd GROUP BY 1)
SELECT service, coalesce(q.t, '') AS qos_classes, co.t AS condition_counts, coalesce(w.t, '') AS waiting_reasons, n.t AS owner_names, 'main,' || c AS containers, i AS images, a AS pod_ips, ports FROM x JOIN co USING (service) JOIN n USING (service) LEFT JOIN q USING (service) LEFT JOIN w USING (service)""")
def pod_histograms(spark, d):
    made = system.pod_details(base.pods(spark, d))
    return made.select("service", *[base._text(c).alias(c) for c in ("qos_classes", "condition_counts", "waiting_reasons", "owner_names")], *[_join(c).alias(c) for c in ("containers", "images", "pod_ips")], F.size("ports").cast("long").alias("ports"))


_TOP = lambda column: f"(SELECT src, dst, string_agg(v || '=' || n, ',' ORDER BY n DESC, v) AS t FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, v) AS r FROM (SELECT src, dst, {column} AS v, count(*) AS n FROM lk GROUP BY 1, 2, 3)) WHERE r <= 10 GROUP BY 1, 2)"


@query(f"""WITH {base._ONE}, o AS {_TOP("operation")}, r AS {_TOP("response")}, b AS (SELECT src, dst, trace_id || ':' || span_id AS id, seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS no FROM lk WHERE is_error),
x AS (SELECT src, dst, string_agg(id, ',' ORDER BY no) AS spans FROM b WHERE no <= 5 GROUP BY 1, 2) SELECT src, dst, o.t AS operations, r.t AS responses, coalesce(spans, '') AS error_spans FROM o JOIN r USING (src, dst) LEFT JOIN x USING (src, dst)""")
def edge_details(spark, d):
    made = traces.edge_details(base.one_file(spark, d))
    pairs = lambda c: _join(F.transform(c, lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))))
    ids = _join(F.transform("example_error_spans", lambda x: F.concat_ws(":", x["trace_id"].cast("string"), x["span_id"].cast("string"))))
    return made.select("src", "dst", pairs("top_operations").alias("operations"), pairs("responses").alias("responses"), F.coalesce(ids, F.lit("")).alias("error_spans"))


@query(f"""WITH {base._EDGES}, n AS (SELECT *, src || '->' || dst AS edge FROM ed), t AS (SELECT edge, row_number() OVER (ORDER BY round(edge_score, 4) DESC, edge) AS r FROM n)
SELECT count(*) AS num_edges, string_agg(edge, ',' ORDER BY edge) FILTER (WHERE num_errors > 0) AS failed, string_agg(edge, ',' ORDER BY edge) FILTER (WHERE latency_p95_us > 100000) AS slow, (SELECT string_agg(edge, ',' ORDER BY r) FROM t WHERE r <= 10) AS top FROM n""")
def trace_summary(spark, d):
    made = traces.summary(base.edges(spark, d))
    return made.select("num_edges", _join("failed_edges").alias("failed"), _join("slow_edges").alias("slow"), _join("top_edges").alias("top"))


@query(f"WITH {base._SPANS.format(path='CAST(year(l_shipdate) AS VARCHAR)')} SELECT path, count(*) AS rows_seen, count(DISTINCT trace_id) AS num_traces, count(DISTINCT service) AS num_services FROM sp0 GROUP BY 1")
def trace_datasets(spark, d):
    return traces.datasets(base.spans(spark, d)).drop("scenario_id")


@query(f"WITH {base._SPANS.format(path='CAST(year(l_shipdate) AS VARCHAR)')} SELECT DISTINCT src, dst FROM lk")
def observed_edges(spark, d):
    return traces.observed(base.spans(spark, d)).drop("scenario_id")


@query(f"WITH {base._EDGES} SELECT 's' AS scenario_id, sum(num_requests)::BIGINT AS total_requests, '' AS reasons FROM ed UNION ALL SELECT 'quiet', 0, 'no_trace_traffic_observed'")
def workload_sla(spark, d):
    both = spark.range(1).select(F.explode(F.array(F.lit("s"), F.lit("quiet"))).alias("scenario_id"))
    return diagnosis.workload_sla(both, base.edges(spark, d)).withColumn("reasons", _join("reasons"))


@query("""WITH s AS (SELECT (o_orderdate::DATE::VARCHAR)[1:7] AS ts, 'svc' || (o_custkey % 40) AS service, max(o_totalprice) / 300 AS latency_ms, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad FROM orders GROUP BY 1, 2),
e AS (SELECT (o_orderdate::DATE::VARCHAR)[1:7] AS ts, o_custkey % 7 AS src, o_custkey % 5 AS dst, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS er, max(o_totalprice) * 2 AS p95 FROM orders GROUP BY 1, 2, 3), v AS (SELECT ts, count(*) FILTER (WHERE er > 0.2 OR p95 / 1000 > 800) AS n FROM e GROUP BY 1)
SELECT ts, count(*) FILTER (WHERE latency_ms > 500 OR bad > 0) AS service_violations, any_value(n) AS edge_violations, count(*) FILTER (WHERE bad > 1) AS unhealthy, any_value(n) > 0 OR count(*) FILTER (WHERE bad > 1) > 0 AS violated FROM s JOIN v USING (ts) GROUP BY 1""")
def sla_snapshots(spark, d):
    t, word = base._read(spark, d, "orders"), lambda p, n: F.concat(F.lit(p), (F.col("o_custkey") % n).cast("string"))
    ts = F.date_format("o_orderdate", "yyyy-MM").alias("ts")
    rows = t.groupBy(_one(), ts, word("svc", 40).alias("service")).agg((F.max("o_totalprice") / 300).alias("latency_ms"), F.count_if(F.col("o_orderstatus") == "P").alias("pods_unready"))
    judged = diagnosis.service_sla(rows.withColumn("anomaly", F.lit(0.0)).withColumn("crashloop", F.lit(0)))
    calls = t.groupBy(_one(), ts, word("s", 7).alias("src"), word("d", 5).alias("dst")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("error_ratio"), (F.max("o_totalprice") * 2).alias("latency_p95_us"))
    made = diagnosis.global_sla(judged, diagnosis.edge_sla(calls), judged.where("pods_unready > 1"), ("scenario_id", "ts"))
    return made.select("ts", "service_violations", "edge_violations", F.col("unhealthy_services").alias("unhealthy"), "violated")


@query(f"""WITH {base._SCORES}, b AS (SELECT src || '->' || dst AS e, edge_score AS s FROM ed ORDER BY edge_score DESC, src, dst LIMIT 1)
SELECT (SELECT service FROM rk WHERE rank = 1) AS top_service, (SELECT e FROM b) AS top_edge, 'multifault' AS dominant_family, '' AS gaps, 0.85::DOUBLE AS confidence, (SELECT string_agg(DISTINCT service, ',' ORDER BY service) FROM fi) AS expected_services, (SELECT service FROM rk WHERE rank = 1) AS hypothesis_service, (SELECT {base._FAULT} FROM fi ORDER BY no LIMIT 1) AS hypothesis_type,
  TRUE AS is_multifault, (SELECT string_agg(service || ':' || {base._FAULT} || ':' || fault_family || ':' || variant || ':' || CASE variant WHEN 'wide' THEN '{{"n":"3"}}' ELSE '{{}}' END, ',' ORDER BY no) FROM fi) AS hypotheses""")
def rca_summary(spark, d):
    made = diagnosis.rca_summary(base.scores(spark, d), base.state(spark, d), base.edges(spark, d), base.faults(spark, d)).drop("scenario_id")
    told = F.transform("hypotheses", lambda h: F.concat_ws(":", h["service"], h["fault_type"], h["fault_family"], h["variant_name"], h["variant_params"]))
    return made.withColumns({c: _join(c) for c in ("gaps", "expected_services")} | {"hypotheses": _join(told)})


@query("""WITH c AS (SELECT 'c' || (c_custkey % 9) AS scenario_id, c_custkey % 9 > 2 AND c_custkey % 2 = 0 AS log, c_custkey % 9 > 4 AS metric, c_custkey % 9 > 6 AS pods FROM customer), e AS (SELECT 'c' || n_nationkey AS scenario_id FROM nation WHERE n_nationkey > 5),
s AS (SELECT scenario_id, bool_or(log) AS log, bool_or(metric) AS metric, bool_or(pods) AS pods FROM c GROUP BY 1), a AS (SELECT scenario_id, coalesce(log, FALSE) AS log, coalesce(metric, FALSE) AS metric, coalesce(pods, FALSE) AS pods, e.scenario_id IS NOT NULL AS trace FROM s FULL JOIN e USING (scenario_id))
SELECT scenario_id, concat_ws(',', CASE WHEN NOT log THEN 'log_pipeline_empty' END, CASE WHEN NOT metric THEN 'resource_metric_pipeline_empty' END, CASE WHEN NOT trace THEN 'trace_pipeline_empty' END, CASE WHEN NOT pods THEN 'system_pipeline_empty' END) AS gaps,
  round(greatest(0.2, least(0.95, 0.85 - 0.12 * (4 - log::INT - metric::INT - trace::INT - pods::INT))), 3)::DOUBLE AS confidence FROM a""")
def observability_gaps(spark, d):
    k = F.col("c_custkey") % 9
    rows = base._read(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("scenario_id"), F.when((k > 2) & (F.col("c_custkey") % 2 == 0), 1).otherwise(0).alias("lines"), (k > 4).alias("metric_signal_present"), F.when(k > 6, 2).otherwise(0).alias("pods_total"))
    edges = base._read(spark, d, "nation").where("n_nationkey > 5").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("scenario_id"))
    return diagnosis.observability_gaps(rows, edges).withColumn("gaps", _join("gaps"))


_SUSPICIOUS = "su AS (SELECT src || '->' || dst AS edge, *, row_number() OVER (ORDER BY edge_score DESC, error_ratio DESC, latency_p95_us DESC, src, dst) AS rank FROM ed WHERE is_suspicious OR error_ratio > 0 OR edge_score > 0.1)"


@query(f"WITH {base._EDGES}, {_SUSPICIOUS} SELECT rank, edge, failure_type FROM su WHERE rank <= 12")
def suspicious_edges(spark, d):
    return views.suspicious_edges(base.edges(spark, d)).select("rank", "edge", "failure_type")


_DEGRADED = """dg AS (SELECT service, CASE WHEN health <> 'healthy' THEN health ELSE status END AS status, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN health <> 'healthy' AND reasons <> '' THEN string_split(reasons, ',') ELSE [] END, CASE WHEN sick THEN [status] ELSE [] END))), ',') AS reasons
  FROM (SELECT he.*, status, infra_issue OR pods_unready > 0 OR crashloop > 0 AS sick FROM he JOIN st USING (service)) WHERE sick OR health <> 'healthy')"""


@query(f"WITH {base._HEALTH}, {_DEGRADED} SELECT * FROM dg")
def degraded_services(spark, d):
    return views.degraded_services(base.health(spark, d), base.state(spark, d)).select("service", "status", _join("reasons").alias("reasons"))


@query(f"""WITH {base._PODS}, p AS (SELECT service, list(o_orderkey::VARCHAR ORDER BY o_orderkey::VARCHAR) AS names FROM pd GROUP BY 1)
SELECT service, status || '/' || pods_ready || '/' || pods_unready || '/' || crashloop AS health, round(pods_ready / pods_total, 4) AS availability, array_to_string(names[1:10], ',') AS pods, len(names) > 10 AS truncated, len(names) AS total, nodes FROM ps JOIN p USING (service)""")
def system_view(spark, d):
    made = views.system_view(system.pod_rollup(base.pods(spark, d)).withColumn("warnings", F.lit(0)))
    h = F.col("health")
    return made.select("service", F.concat_ws("/", h["status"], *[h[c].cast("string") for c in ("pods_ready", "pods_unready", "crashloop")]).alias("health"), h["availability"].alias("availability"), _join("pods.items").alias("pods"), "pods.truncated", F.col("pods.total_count").alias("total"), _join("nodes.items").alias("nodes"))


_VIEW = [k for k in metrics.FLAT_FIELDS if k in views.FLAT_FIGURES]


@query(f"WITH {base._FLAT}, {_SERVICES} SELECT service, {', '.join(f'round(coalesce({c}, 0), 4)::DOUBLE AS {c}' for c in _VIEW)}, fl.service IS NOT NULL AS present FROM kn LEFT JOIN fl USING (service)")
def metric_view(spark, d):
    flat = metrics.flat_fields(metrics.kpi_summary(base.samples(spark, d))).withColumn("latency_ms", F.lit(0.0))
    made = views.metric_view(services(spark, d), flat)
    return made.select("service", *[f"flat_summary.{c}" for c in _VIEW], F.col("metric_signal_present").alias("present"))


@query(f"WITH {base._KPIS} SELECT service, {base._GROUP} AS kpi_group, string_agg(kpi_name || ':' || {base._SIGNAL} || ':' || n, ',' ORDER BY kpi_name) AS signals FROM kp GROUP BY 1, 2")
def metric_groups(spark, d):
    made = metrics.metric_groups(metrics.kpi_summary(base.samples(spark, d)))
    told = F.transform(F.map_entries("signals"), lambda x: F.concat_ws(":", x["key"], x["value"]["signal"], x["value"]["n"].cast("string")))
    return made.select("service", "kpi_group", _join(F.array_sort(told)).alias("signals"))


_FAM = "ft AS (SELECT service, string_agg(family || '=' || n, ',' ORDER BY family) AS families FROM fa GROUP BY 1)"


@query(f"WITH {base._LINES}, {base._FAMILIES}, {_FAM}, {_EVIDENCE} SELECT service, lines, errors, log_health_score AS score, coalesce(severity_counts, '') AS severities, coalesce(families, '') AS families, coalesce(dependency_counts, '') AS dependencies, coalesce(evidence, '') AS evidence FROM lf LEFT JOIN ft USING (service) LEFT JOIN (SELECT service, string_agg(line, '|' ORDER BY no) AS evidence FROM ev WHERE place <= 5 GROUP BY 1) USING (service)")
def log_view(spark, d):
    rows = base.parsed(spark, d)
    made = views.log_view(base.features(spark, d), logs.error_families(base.facts(spark, d)), logs.examples(rows))
    return made.select("service", "signal.lines", "signal.errors", F.col("signal.log_health_score").alias("score"), base._text("severity_counts").alias("severities"), base._text("error_families").alias("families"), base._text("dependency_counts").alias("dependencies"), F.array_join("evidence", "|").alias("evidence"))


@query(f"WITH {base._LINES}, {base._FAMILIES}, {_FAM}, r AS (SELECT *, row_number() OVER (ORDER BY errors DESC, service) AS rank FROM lf WHERE errors > 0 OR log_anomaly_score > 0.3) SELECT rank, service, errors, dominant_error_type, coalesce(families, '') AS families FROM r LEFT JOIN ft USING (service) WHERE rank <= 15")
def llm_view(spark, d):
    rows = base.parsed(spark, d)
    made = views.llm_view(base.features(spark, d), logs.error_families(base.facts(spark, d)), logs.examples(rows))
    return made.select("rank", "service", "errors", "dominant_error_type", base._text("error_families").alias("families"))


@query(f"WITH {base._STATE} SELECT service, round(cpu_usage_delta, 4)::DOUBLE AS cpu_delta, round(memory_usage_last, 4)::DOUBLE AS mem_usage_last, round(threads_last, 4)::DOUBLE AS threads_last, errors::DOUBLE AS log_errors, warns::DOUBLE AS log_warnings, round(anomaly, 4)::DOUBLE AS log_anomaly, restarts::DOUBLE AS restart_count, pods_unready::DOUBLE AS pods_unready, round(availability, 4)::DOUBLE AS availability_ratio, infra_issue::INT::DOUBLE AS infra_issue FROM st")
def model_vector(spark, d):
    return views.model_vector(base.state(spark, d)).drop("scenario_id")


@query(f"WITH {base._STATE}, {_SERVICES} SELECT service, ps.service IS NOT NULL AS has_system, lf.service IS NOT NULL AS has_logs, fl.service IS NOT NULL AS has_metrics FROM kn LEFT JOIN ps USING (service) LEFT JOIN lf USING (service) LEFT JOIN fl USING (service)")
def graph_nodes(spark, d):
    made = views.nodes(services(spark, d), metrics.flat_fields(metrics.kpi_summary(base.samples(spark, d))), base.features(spark, d), system.pod_rollup(base.pods(spark, d)).drop("pod_names"))
    return made.select("service", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("system", "logs", "metrics")])


@query(f"""WITH {base._PODS} SELECT '{{"crashloop":' || crashloop || ',"status":"' || status || '"}}' AS profile, string_agg(service, ',' ORDER BY service) AS services FROM ps GROUP BY 1""")
def grouped_profiles(spark, d):
    made = views.grouped_profiles(system.pod_rollup(base.pods(spark, d)).select(*KEY, "status", "crashloop"))
    return made.select("profile", _join("services").alias("services"))


_text = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_HEAD = _text(agents.RCA_HEAD % ("s", "shop", "diagnosis"))


@query(f"""WITH {base._HEALTH}, {base._CLUSTERS}, {_DEGRADED}, {_SUSPICIOUS}, r AS (SELECT *, row_number() OVER (ORDER BY errors DESC, service) AS rank FROM lf WHERE errors > 0 OR log_anomaly_score > 0.3), g AS (SELECT cluster, string_agg(service, ', ' ORDER BY service) AS names FROM cu GROUP BY 1),
{_EVIDENCE}, v AS (SELECT service, string_agg(chr(10) || '      evidence: ' || substr(line, 1, 220), '' ORDER BY no) AS seen FROM ev WHERE place <= 2 GROUP BY 1)
SELECT {_HEAD} || chr(10) || '## Degraded / Suspicious Services' || chr(10) || (SELECT string_agg('  - ' || service || ': ' || status || ' (' || replace(reasons, ',', ', ') || ')', chr(10) ORDER BY service) FROM dg) || chr(10) || chr(10)
  || '## Top Log Error Signals' || chr(10) || (SELECT string_agg('  - ' || service || ': errors=' || errors || ' dominant=' || dominant_error_type || coalesce(seen, ''), chr(10) ORDER BY rank) FROM r LEFT JOIN v USING (service) WHERE rank <= 8) || chr(10) || chr(10)
  || '## Suspicious Trace Edges' || chr(10) || (SELECT string_agg('  - ' || edge || printf(' error_ratio=%.3f p95_ms=%.2f type=', error_ratio::DOUBLE, latency_p95_us::DOUBLE / 1000) || failure_type, chr(10) ORDER BY rank) FROM su WHERE rank <= 8) || chr(10) || chr(10)
  || '## Service Behaviour Clusters' || chr(10) || (SELECT string_agg('  ' || cluster || ': ' || names, chr(10) ORDER BY cluster) FROM g) || chr(10) || chr(10) || {_text(agents.RCA_TASK)} AS prompt""")
def rca_prompt(spark, d):
    about = spark.range(1).select(_one(), F.lit("shop").alias("namespace"), F.lit("diagnosis").alias("task"))
    seen = logs.examples(base.parsed(spark, d)).select(*KEY, F.col("evidence_lines").alias("evidence"))
    bad = logs.top_error_services(base.features(spark, d)).select(*KEY, "rank", "errors", "dominant_error_type").join(seen, KEY, "left")
    return agents.rca_prompt(about, views.degraded_services(base.health(spark, d), base.state(spark, d)), bad, views.suspicious_edges(base.edges(spark, d)), base.clusters(spark, d)).select("prompt")


_ACT = ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}', '{e}', '{r}')" for k, (t, e, r) in enumerate([*agents.ACTIONS, agents.AUTH_ACTION]))


@query(f"WITH a(no, t, effect, risk) AS (VALUES {_ACT}) SELECT lower(n_name) AS service, no, replace(replace(t, '{{svc}}', lower(n_name)), '{{ns}}', 'ns' || n_regionkey) AS command, effect, risk FROM nation, a WHERE no < 7 OR n_nationkey % 2 = 0")
def action_library(spark, d):
    asked = base._read(spark, d, "nation").select(_one(), F.lower("n_name").alias("service"), F.when(F.col("n_nationkey") % 2 == 0, "auth_failure").otherwise("infra_failure").alias("fault_type"), F.concat(F.lit("ns"), F.col("n_regionkey").cast("string")).alias("namespace"))
    return agents.action_library(asked).drop("scenario_id")


@query("SELECT n_name AS scenario_id, '# Kubernetes Fault Remediation' || chr(10) || 'Scenario : ' || n_name || ' (iteration ' || (n_regionkey + 1) || ' / 7)' || chr(10) || 'Namespace: ns' || chr(10) || 'kubectl context: kind-kind' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Fix it.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || " + _text(agents.ACTION_TASK) + " AS prompt FROM nation")
def action_prompt(spark, d):
    asked = base._read(spark, d, "nation").select(F.col("n_name").alias("scenario_id"), F.lit("ns").alias("namespace"), F.col("n_regionkey").alias("iteration"), F.lit("Fix it.").alias("instruction"))
    return agents.action_prompt(asked).select("scenario_id", "prompt")


_REPLY = """CASE n_nationkey % 4 WHEN 0 THEN '{"root_cause_service": "' || n_name || '", "fault_type": "config_error", "confidence": 7, "affected_services": ["a", "b"]}' WHEN 1 THEN 'It is ```json' || chr(10) || '{"fault_type": "flood", "confidence": 0.25}' || chr(10) || '```' WHEN 2 THEN 'no idea' ELSE 'so: {"root_cause_service": "", "fault_type": "pod_failure", "confidence": -1} ok' END"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    return base._read(spark, d, "nation").select(F.col("n_name").alias("scenario_id"), F.expr(_REPLY.replace("chr(10)", "'\\n'")).alias("reply"), F.when(F.col("n_nationkey") % 3 == 0, "hinted").alias("hint"), F.when(F.col("n_nationkey") % 5 == 0, "known").alias("faulty_service"), F.when(F.col("n_regionkey") == 1, "network_loss").alias("fault_family"))


@query("""SELECT n_name AS scenario_id, CASE WHEN n_nationkey % 4 = 0 THEN n_name WHEN n_nationkey % 3 = 0 THEN 'hinted' WHEN n_nationkey % 5 = 0 THEN 'known' ELSE 'unknown' END AS root_cause_service, CASE n_nationkey % 4 WHEN 0 THEN 'config_error' WHEN 3 THEN 'pod_failure' ELSE CASE WHEN n_regionkey = 1 THEN 'network_failure' ELSE 'dependency_failure' END END AS fault_type,
  CASE WHEN n_nationkey % 4 = 0 THEN 'a,b' ELSE '' END AS affected, CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0.0 END AS confidence FROM nation""")
def validated_replies(spark, d):
    return agents.validated(replies(spark, d)).select("scenario_id", "root_cause_service", "fault_type", _join("affected_services").alias("affected"), "confidence")


@query(f"WITH {base._PODS}, r AS (SELECT unnest(['svc3', 'svc8', 'gone']) AS service) SELECT service, coalesce(status, 'unknown') AS status, coalesce(restarts, 0) AS restarts, coalesce(crashloop, 0) AS crashloop FROM r LEFT JOIN ps USING (service)")
def involved_pods(spark, d):
    told = spark.range(1).select(_one(), F.lit("svc3").alias("root_cause_service"), F.array(F.lit("svc8"), F.lit("gone"), F.lit("svc3")).alias("affected_services"))
    return agents.involved_pods(told, system.pod_rollup(base.pods(spark, d))).select("service", "status", "restarts", "crashloop")


_LIST = lambda c: f"'[''' || replace({c}, ',', ''', ''') || ''']'"
_YES = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


@query(f"""WITH {base._OVERLAP} SELECT scenario_id, concat_ws('  |  ', 'Verified: ' || {_YES("root_cause_degraded OR raw >= 0.5")}, 'Root cause service ''' || coalesce(root_cause, '') || ''' degraded in twin: ' || {_YES("root_cause_degraded")}, 'Symptom overlap: ' || matched || '/' || original || ' originally-unhealthy services appear degraded in twin (score=' || printf('%.2f', raw::DOUBLE) || ')',
  CASE WHEN missing <> '' THEN 'Missing from twin: ' || {_LIST("missing")} END, CASE WHEN extra <> '' THEN 'Extra degraded in twin (not in original): ' || {_LIST("array_to_string(string_split(extra, ',')[1:5], ',')")} END) AS reasoning FROM ov""")
def verification_text(spark, d):
    return outcome.reasoning(base.overlaps(spark, d))


@query(f"WITH {base._MEMBERS} SELECT service, o_orderkey::VARCHAR AS pod, relevant, CASE WHEN NOT relevant THEN 'kubectl --context twin delete pod ' || o_orderkey || ' -n shop --ignore-not-found' END AS command FROM mem JOIN pd USING (service)")
def twin_pods(spark, d):
    return diagnosis.twin_pods(base.membership(spark, d), system.pod_rollup(base.pods(spark, d)), "shop", "twin").drop("scenario_id")


@query(f"WITH {base._MEMBERS} SELECT count(*) AS total, count(*) FILTER (WHERE relevant) AS relevant, count(*) FILTER (WHERE NOT relevant) AS bystanders, coalesce(string_agg(service, ',' ORDER BY service) FILTER (WHERE reasons LIKE '%known_faulty%'), '') AS known_faulty, coalesce(string_agg(service, ',' ORDER BY service) FILTER (WHERE reasons LIKE '%top_rca%'), '') AS suspects FROM mem")
def twin_summary(spark, d):
    return diagnosis.twin_summary(base.membership(spark, d)).drop("scenario_id").withColumns({c: _join(c) for c in ("known_faulty", "suspects")})


_RULES = "r(kind, name, value, fault) AS (VALUES " + ", ".join([f"('gap', '{g}', '{m}', NULL)" for g, m in agents.GAP_MEANINGS] + [f"('observed', '{k}', '{v}', '{f}')" for f, k, v in agents.OBSERVED]) + ")"


@query(f"""WITH {_RULES}, f AS (SELECT n_nationkey AS k, 'svc' || n_nationkey AS service, CASE n_regionkey WHEN 0 THEN 'auth_failure' WHEN 1 THEN 'latency_degradation' ELSE 'other' END AS fault FROM nation)
SELECT service, kind, name, value FROM f, r WHERE r.fault = f.fault OR (kind = 'gap' AND ((name = 'log_pipeline_empty' AND k % 2 = 0) OR (name = 'trace_pipeline_empty' AND k % 3 = 0)))""")
def static_rules(spark, d):
    """What the fixed libraries tell of each finding; findings come from ``nation``."""
    k = F.col("n_nationkey")
    gaps = F.filter(F.array(F.when(k % 2 == 0, "log_pipeline_empty"), F.when(k % 3 == 0, "trace_pipeline_empty")), lambda g: g.isNotNull())
    found = base._read(spark, d, "nation").select(_one(), F.concat(F.lit("svc"), k.cast("string")).alias("service"), F.when(F.col("n_regionkey") == 0, "auth_failure").when(F.col("n_regionkey") == 1, "latency_degradation").otherwise("other").alias("fault_type"), gaps.alias("gaps"))
    return agents.library_rules(found).drop("scenario_id")


@query(f"WITH {base._EDGES}, c AS (SELECT dst, CASE WHEN error_ratio >= 0.9 OR edge_score >= 0.9 THEN 'critical' WHEN error_ratio >= 0.3 OR edge_score >= 0.5 OR num_requests >= 20 THEN 'important' ELSE 'normal' END AS k FROM ed) SELECT count(DISTINCT dst) AS num_called, count(*) AS num_edges, count(*) FILTER (WHERE k = 'critical') AS num_critical_edges, count(*) FILTER (WHERE k = 'important') AS num_important_edges FROM c")
def complexity_report(spark, d):
    judged = base.edges(spark, d).withColumn("criticality", rules.criticality(F.col("error_ratio"), F.col("edge_score"), F.col("num_requests")))
    return grouping.complexity(judged).drop("scenario_id")


@query("SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def value_statistics(spark, d):
    return base._rounded(metrics.statistics(base._read(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"]), "mean", "p50", "p95")


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return base._read(spark, d, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("scenario_id"), F.concat(F.lit("kubectl get "), "event_type").alias("command"), F.repeat("event_type", (e % 200).cast("int")).alias("stdout"), F.lit("").alias("stderr"), F.when((e % 3 == 0) & (F.col("user_id") % 2 == 0), 1).otherwise(0).alias("returncode"), (F.col("value") * 3 + 0.25).alias("elapsed_ms"))


@query("SELECT 'c' || (user_id % 40) AS scenario_id, 'kubectl get ' || event_type AS command, substr(repeat(event_type, (event_id % 200)::INT), 1, 500) AS stdout, event_id % 3 <> 0 OR user_id % 2 <> 0 AS ok FROM events")
def command_rows(spark, d):
    return outcome.command_rows(_results(spark, d)).select("scenario_id", "command", "stdout", "ok")


@query(f"WITH {base._REWARD}, c AS (SELECT 'c' || (user_id % 40) AS scenario_id, count(*) AS run, count(*) FILTER (WHERE event_id % 3 <> 0 OR user_id % 2 <> 0) AS ok FROM events GROUP BY 1), h AS (SELECT scenario_id, count(*) FILTER (WHERE pre) AS pre, count(*) FILTER (WHERE post) AS post FROM p GROUP BY 1) SELECT scenario_id, coalesce(run, 0) AS commands_run, coalesce(ok, 0) AS commands_ok, coalesce(pre, 0) AS pre_healthy, coalesce(post, 0) AS post_healthy FROM c FULL JOIN h USING (scenario_id)")
def execution_rollup(spark, d):
    return outcome.execution(_results(spark, d), base._snapshots(spark, d))


@query(f"""WITH {base._REWARD}, c AS (SELECT 'c' || (user_id % 40) AS scenario_id, count(*) AS run, count(*) FILTER (WHERE event_id % 3 = 0 AND user_id % 2 = 0) AS bad FROM events GROUP BY 1)
SELECT scenario_id, CASE WHEN tracked > 0 AND ready < tracked THEN ready || '/' || tracked || ' relevant pods ready after commands' WHEN coalesce(run, 0) = 0 THEN 'no commands generated' WHEN bad > 0 THEN bad || ' commands failed' ELSE 'pods not healthy after stabilization' END AS reason FROM r LEFT JOIN c USING (scenario_id)""")
def failure_reasons(spark, d):
    ran = outcome.execution(_results(spark, d))
    made = outcome.rewards(base._snapshots(spark, d)).join(ran, "scenario_id", "left").fillna(0, ["commands_run", "commands_ok"])
    return made.select("scenario_id", rules.failure_reason(F.col("ready"), F.col("tracked"), F.col("commands_run"), F.col("commands_run") - F.col("commands_ok")).alias("reason"))


@query("SELECT 'u' || user_id AS scenario_id, bool_or(value > 400) AS passed, round(greatest(0, max(value) / 500), 4)::DOUBLE AS best_reward, count(*) AS n_iterations FROM events GROUP BY 1")
def scenario_rows(spark, d):
    rows = base._read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scenario_id"), F.col("event_id").alias("iteration"), (F.col("value") / 500).alias("reward"), (F.col("value") > 400).alias("passed"), F.lit(1.0).alias("elapsed"))
    return outcome.scenario_rows(rows).drop("elapsed_seconds")


@query(f"""WITH {base._OVERLAP}, n AS (SELECT scenario_id, string_agg(service, ',' ORDER BY service) AS original_unhealthy, coalesce(string_agg(service, ',' ORDER BY service) FILTER (WHERE hit), '') AS overlap FROM om GROUP BY 1), w AS (SELECT scenario_id, string_agg(other, ',' ORDER BY other) AS twin_degraded_services FROM x GROUP BY 1)
SELECT scenario_id, root_cause_degraded OR raw >= 0.5 AS verified, round(raw, 3)::DOUBLE AS match_score, root_cause_degraded, coalesce(original_unhealthy, '') AS original_unhealthy, coalesce(twin_degraded_services, '') AS twin_degraded_services, coalesce(overlap, '') AS overlap, CASE WHEN scenario_id = 's1' THEN 30.0 ELSE 0.0 END::DOUBLE AS wait_seconds FROM ov LEFT JOIN n USING (scenario_id) LEFT JOIN w USING (scenario_id)""")
def verification_rows(spark, d):
    original, observed, _ = base.overlap_sides(spark, d)
    waits = original.where("scenario_id = 's1'").select("scenario_id", F.lit(30.0).alias("wait_seconds")).distinct()
    made = outcome.verification_rows(base.overlaps(spark, d), original, observed, waits)
    return made.drop("reasoning").withColumns({c: F.array_join(c, ",") for c in ("original_unhealthy", "twin_degraded_services", "overlap")})


_TRIES = "e AS (SELECT 'u' || (user_id % 50) AS scenario_id, user_id % 50 AS u, event_id % 5 AS iteration, event_id AS no, 'kubectl get ' || event_type AS command, event_id % 3 = 0 AS ok, value FROM events)"
_TRIED = f"{_TRIES}, it AS (SELECT scenario_id, u, iteration, max(value) / 500 AS reward, max(value) > 400 AS passed, max(value) * 3 AS elapsed, string_agg(command || '=' || CASE WHEN ok THEN 'true' ELSE 'false' END, ';' ORDER BY no) FILTER (WHERE no % 7 <> 0) AS told, string_agg(command, ';' ORDER BY no) FILTER (WHERE no % 7 <> 0) AS commands FROM e GROUP BY 1, 2, 3)"


def _tried(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Iterations, and results of their commands, of 50 scenarios that ``events`` are dealt to."""
    e = base._read(spark, d, "events").withColumns({"scenario_id": F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")), "iteration": F.col("event_id") % 5})
    iterations = e.groupBy("scenario_id", "iteration").agg(F.max("value").alias("v")).select("scenario_id", "iteration", (F.col("v") / 500).alias("reward"), (F.col("v") > 400).alias("passed"), (F.col("v") * 3).alias("elapsed"))
    ran = e.where("event_id % 7 <> 0").select("scenario_id", "iteration", F.col("event_id").alias("no"), F.concat(F.lit("kubectl get "), "event_type").alias("command"), F.lit("").alias("stdout"), F.lit("").alias("stderr"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("returncode"), "value")
    return iterations, ran.withColumnRenamed("value", "elapsed_ms")


def _told(c: str) -> Column:
    return F.array_join(F.transform(c, lambda r: F.concat(r["command"], F.lit("="), r["ok"].cast("string"))), ";")


@query(f"WITH {_TRIED} SELECT scenario_id, iteration, coalesce(commands, '') AS commands, round(reward, 4)::DOUBLE AS reward, passed, round(elapsed, 2)::DOUBLE AS elapsed_seconds, coalesce(told, '') AS command_results FROM it")
def iteration_rows(spark, d):
    return outcome.iteration_rows(*_tried(spark, d)).withColumns({"commands": F.array_join("commands", ";"), "command_results": _told("command_results")})


@query(f"""WITH {_TRIED}, b AS (SELECT scenario_id, arg_max(coalesce(commands, ''), (reward, -iteration)) AS best_commands FROM it WHERE reward > 0 GROUP BY 1),
s AS (SELECT scenario_id, u, bool_or(passed) AS passed, greatest(0, max(reward)) AS best, count(*) AS n, string_agg(iteration || ':' || coalesce(told, ''), '/' ORDER BY iteration) AS its FROM it GROUP BY 1, 2)
SELECT scenario_id, u % 11 <> 0 AND passed AS passed, CASE WHEN u % 11 = 0 THEN 0 ELSE round(best, 4) END::DOUBLE AS best_reward, CASE WHEN u % 11 = 0 THEN 0 ELSE n END AS n_iterations, u % 11 <> 0 AND u % 2 = 0 AS rca_verified, CASE WHEN u % 11 = 0 THEN '' ELSE coalesce(best_commands, '') END AS best_commands, CASE WHEN u % 11 = 0 THEN '' ELSE its END AS iterations, CASE WHEN u % 11 = 0 THEN 'no state' ELSE '' END AS error FROM s LEFT JOIN b USING (scenario_id)""")
def scenario_results(spark, d):
    iterations, ran = _tried(spark, d)
    u = F.substring("scenario_id", 2, 9).cast("int")
    known = iterations.select("scenario_id").distinct()
    verified = known.where(u % 2 == 0).withColumn("verified", F.lit(True))
    errors = known.where(u % 11 == 0).select("scenario_id", F.lit("no state").alias("error"), F.lit(1.5).alias("elapsed"))
    made = outcome.scenario_results(known, outcome.iteration_rows(iterations, ran), iterations, verified, errors)
    one = lambda r: F.concat(r["iteration"].cast("string"), F.lit(":"), F.array_join(F.transform(r["command_results"], lambda x: F.concat(x["command"], F.lit("="), x["ok"].cast("string"))), ";"))
    return made.drop("elapsed_seconds").withColumns({"best_commands": F.array_join("best_commands", ";"), "iterations": F.array_join(F.transform("iterations", one), "/")})


@query(f"""WITH {base._EDGES}, c AS (SELECT src, dst, CASE WHEN error_ratio >= 0.9 OR edge_score >= 0.9 THEN 'critical' WHEN error_ratio >= 0.3 OR edge_score >= 0.5 OR num_requests >= 20 THEN 'important' ELSE 'normal' END AS k FROM ed), s AS (SELECT src AS v FROM ed UNION SELECT dst FROM ed UNION SELECT 'svc' || s_nationkey FROM supplier)
SELECT (SELECT count(*) FROM s) AS num_services, (SELECT count(*) FROM c) AS num_edges, (SELECT count(*) FROM c WHERE k = 'critical') AS num_critical_edges, (SELECT count(*) FROM c WHERE k = 'important') AS num_important_edges, (SELECT count(DISTINCT ts::DATE) FROM events) AS num_snapshots, (SELECT count(DISTINCT ts::DATE) > 1 FROM events) AS state_is_time_series""")
def topology_complexity(spark, d):
    judged = base.edges(spark, d).withColumn("criticality", rules.criticality(F.col("error_ratio"), F.col("edge_score"), F.col("num_requests")))
    services = base._read(spark, d, "supplier").select(_one(), F.concat(F.lit("svc"), F.col("s_nationkey").cast("string")).alias("service"))
    snapshots = base._read(spark, d, "events").select(_one(), F.to_date("ts").alias("snapshot"))
    return grouping.complexity_report(judged, services, snapshots).drop("scenario_id")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    n, k = base._read(spark, d, "nation"), F.col("n_nationkey")
    sid = F.col("n_name").alias("scenario_id")
    return outcome.outcome_rows(n.select(sid), n.where(k % 7 == 3).select(sid, F.concat(F.lit("broken "), F.repeat(F.lit("x"), 90)).alias("error")), n.where(k % 2 == 0).select(sid, F.lit("svc").alias("top_service")), n.where(k % 3 == 0).select(sid, F.lit(True).alias("violated")))


_OUTCOMES = "oc AS (SELECT n_name AS scenario_id, n_nationkey % 7 <> 3 AS ok, CASE WHEN n_nationkey % 7 = 3 THEN 'broken ' || repeat('x', 90) END AS error, CASE WHEN n_nationkey % 7 <> 3 AND n_nationkey % 2 = 0 THEN 'svc' END AS top_service, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey % 3 = 0 END AS sla_violated FROM nation)"


@query(f"WITH {_OUTCOMES} SELECT * FROM oc")
def outcome_rows(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {_OUTCOMES}, x AS (SELECT ok, CASE WHEN ok THEN '[PASS] ' || scenario_id || '  rca=' || coalesce(top_service, 'None') || '  sla_violated=' || sla_violated ELSE '[FAIL] ' || scenario_id || '  error=' || substr(error, 1, 80) END AS line FROM oc) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, string_agg(line, '|' ORDER BY line) AS lines FROM x")
def run_log(spark, d):
    return outcome.run_log(_outcomes(spark, d)).withColumn("lines", F.array_join("lines", "|"))


@query("""SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'fam' WHEN contains(t, 'mongodb') AND contains(t, 'auth') THEN 'auth_miss_mongodb' WHEN contains(t, 'latency') THEN 'latency_degradation' WHEN contains(t, 'cpu') THEN 'resource_cpu' WHEN contains(t, 'memory') THEN 'resource_memory' END AS family, CASE WHEN n_nationkey % 4 = 0 THEN 'user-service' END AS service, CASE n_nationkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'wide' ELSE 'default' END AS variant, CASE n_nationkey % 3 WHEN 1 THEN 'n=3' ELSE '' END AS params, CASE WHEN n_nationkey % 2 = 0 THEN '20260501_101112' END AS stamp
FROM (SELECT *, CASE n_nationkey % 5 WHEN 0 THEN 'mongodb lost auth' WHEN 1 THEN 'high latency' WHEN 2 THEN 'cpu is full' WHEN 3 THEN 'memory is full' ELSE 'odd' END AS t FROM nation)""")
def fault_text(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.when(k % 5 == 0, "MongoDB lost auth").when(k % 5 == 1, "high latency").when(k % 5 == 2, "cpu is full").when(k % 5 == 3, "memory is full").otherwise("odd"), F.when(k % 4 == 0, ", target user-service").otherwise(""))
    variant = F.when(k % 3 == 0, "v1").when(k % 3 == 1, '{"variant": "wide", "n": 3}').otherwise("")
    return base._read(spark, d, "nation").select("n_name", rules.family_from_text(F.when(k % 3 == 0, "fam").otherwise(""), text).alias("family"), rules.service_from_text(F.lit(None).cast("string"), text).alias("service"), rules.variant_name(variant).alias("variant"), _join(F.transform(F.map_entries(rules.variant_params(variant)), lambda x: F.concat_ws("=", x["key"], x["value"]))).alias("params"), rules.stamp_in_name(F.when(k % 2 == 0, "run_20260501_101112.csv").otherwise("run.csv")).alias("stamp"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' END AS found FROM events")
def json_extract(spark, d):
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("  "), "props", F.lit("\n"))).when(k == 1, "as a list [1, 2] of numbers").otherwise("nothing {here")
    return base._read(spark, d, "events").select("event_id", rules.json_in_text(reply).alias("found"))


@query("SELECT s_suppkey, 'compose-post-service' AS class_name, CASE s_suppkey % 3 WHEN 0 THEN 'user-timeline-service' WHEN 1 THEN 'cart-service' ELSE 'front' END AS client, CASE WHEN s_suppkey % 2 = 0 THEN 500 END AS status, CASE WHEN s_suppkey % 2 = 0 THEN '/a/' || s_suppkey END AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'POST' END AS method FROM supplier")
def small_functions(spark, d):
    k = F.col("s_suppkey")
    target = F.when(k % 3 == 0, "user-timeline-redis").when(k % 3 == 1, "cart-mongodb").otherwise("front")
    said = F.when(k % 2 == 0, F.concat(F.lit('status: 500 request: "POST /a/'), k.cast("string"), F.lit(' HTTP/1.1"'))).otherwise("quiet")
    return base._read(spark, d, "supplier").select("s_suppkey", names.class_service(F.lit("src/ComposePostServiceHandler.cpp")).alias("class_name"), names.client_of_store(target).alias("client"), line.http_info(said)["status"].alias("status"), line.http_info(said)["path"].alias("path"), line.http_info(said)["method"].alias("method"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'user-timeline' WHEN 2 THEN 'geo' WHEN 3 THEN 'cart-service' ELSE 'unknown' END AS service FROM supplier")
def service_of_output(spark, d):
    k = F.col("s_suppkey") % 5
    text = F.when(k == 0, "x\n[pod/web-1/web] hi\n").when(k == 1, "[t] <info>: (src/UserTimelineHandler.cpp:12:run) ok").when(k == 2, '{"s":"I","attr":{"host":"geo"}}').when(k == 3, "lost 'cart-redis:6379'").otherwise("nothing")
    return base._read(spark, d, "supplier").select("s_suppkey", names.service_of_output(text, F.lit("/a/logs/step_1_get_logs.txt")).alias("service"))


def _file(spark: SparkSession, d: str, table: str, path: str, entry: Column, head: str, tail: str) -> DataFrame:
    """One file a region or so, as (scenario_id, path, content), from the rows of a table as entries of a list."""
    t = base._read(spark, d, table)
    k = [c for c in t.columns if c.endswith("key")][0]
    rows = t.groupBy((F.col(k) % 3).alias("g")).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, entry.alias("e")))), lambda x: x["e"]), ","), F.lit(tail)).alias("content"))
    return rows.select(F.concat(F.lit("r"), F.col("g").cast("string")).alias("scenario_id"), F.lit(path).alias("path"), "content")


@query("""SELECT 'r' || (s_suppkey % 3) AS scenario_id, 'svc' || s_suppkey AS service, 'pod' || s_suppkey AS pod, s_nationkey % 4 <> 0 AS ready, s_suppkey % 5 + 1 AS restarts, CASE WHEN s_nationkey % 3 = 0 THEN 'CrashLoopBackOff,unknown' ELSE '' END AS waiting, CASE WHEN s_nationkey % 3 = 1 THEN 'OOMKilled' ELSE '' END AS terminated, 'Ready=True,ContainersReady=True' AS conditions, 'img:' || s_suppkey AS images, 'run,-v' AS commands, '80/TCP/http' AS ports FROM supplier""")
def pods_parsed(spark, d):
    k = F.col("s_suppkey").cast("string")
    phase = F.when(F.col("s_nationkey") % 4 == 0, "Failed").otherwise("Running")
    waiting = F.when(F.col("s_nationkey") % 3 == 0, ',{"name":"b","state":{"waiting":{"reason":"CrashLoopBackOff"}}},{"name":"c","state":{"waiting":{}}}').when(F.col("s_nationkey") % 3 == 1, ',{"name":"b","state":{"terminated":{"reason":"OOMKilled","exitCode":137}}}').otherwise("")
    entry = F.format_string('{"metadata":{"name":"pod%s","labels":{"app":"svc%s"}},"spec":{"nodeName":"n","containers":[{"name":"a","image":"img:%s","command":["run","-v"],"ports":[{"containerPort":80,"protocol":"TCP","name":"http"}]}]},"status":{"phase":"%s","conditions":[{"type":"Ready","status":"True"},{"type":"ContainersReady","status":"True"}],"containerStatuses":[{"name":"a","restartCount":%s,"state":{"running":{"startedAt":"t"}}}%s]}}', k, k, k, phase, (F.col("s_suppkey") % 5 + 1).cast("string"), waiting)
    made = scenario.pods_of(_file(spark, d, "supplier", "pods.json", entry, '{"items":[', "]}"))
    port = F.transform("ports", lambda p: F.concat_ws("/", p["container_port"].cast("string"), p["protocol"], p["name"]))
    return made.select("scenario_id", "service", "pod", "ready", "restarts", _join("waiting_reasons").alias("waiting"), _join("terminated_reasons").alias("terminated"), _join("conditions").alias("conditions"), _join("images").alias("images"), _join("commands").alias("commands"), _join(port).alias("ports"))


@query("""SELECT 'r' || (s_suppkey % 3) AS scenario_id, 'svc' || s_suppkey AS service, s_nationkey AS replicas, s_nationkey % 2 AS ready_replicas, 0 AS updated_replicas, 'Available:True:ok' AS conditions, 'main:img' || s_suppkey AS containers FROM supplier""")
def deployments_parsed(spark, d):
    k = F.col("s_suppkey").cast("string")
    entry = F.format_string('{"metadata":{"name":"x","generation":2,"labels":{"service":"svc%s"}},"spec":{"replicas":%s,"selector":{"a":"b"},"template":{"spec":{"containers":[{"name":"main","image":"img%s","args":["-x"]}]}}},"status":{"readyReplicas":%s,"conditions":[{"type":"Available","status":"False"},{"type":"Available","status":"True","reason":"ok"}]}}', k, F.col("s_nationkey").cast("string"), k, (F.col("s_nationkey") % 2).cast("string"))
    made = scenario.deployments_of(_file(spark, d, "supplier", "deployments.json", entry, "[", "]"))
    told = F.transform(F.map_entries("conditions"), lambda x: F.concat_ws(":", x["key"], x["value"]["status"], x["value"]["reason"]))
    return made.select("scenario_id", "service", "replicas", "ready_replicas", "updated_replicas", _join(told).alias("conditions"), _join(F.transform("containers", lambda c: F.concat_ws(":", c["name"], c["image"]))).alias("containers"))


@query("""SELECT 'r' || (s_suppkey % 3) AS scenario_id, 'svc' || s_suppkey AS service, s_nationkey % 3 AS ready_endpoints, 1 AS not_ready_endpoints, array_to_string(list_transform(range(s_nationkey % 3), lambda x: '10.0.0.' || x || '/p'), ',') AS addresses, 'http:80' AS ports FROM supplier""")
def endpoints_parsed(spark, d):
    address = F.array_join(F.transform(F.when(F.col("s_nationkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.col("s_nationkey") % 3 - 1).cast("int"))), lambda x: F.format_string('{"ip":"10.0.0.%d","targetRef":{"kind":"Pod","name":"p"}}', x)), ",")
    entry = F.format_string('{"metadata":{"name":"svc%d"},"subsets":[{"addresses":[%s],"ports":[{"name":"http","port":80,"protocol":"TCP"}]},{"notReadyAddresses":[{"ip":"1"}]}]}', "s_suppkey", address)
    made = scenario.endpoints_of(_file(spark, d, "supplier", "endpoints.json", entry, '{"items":[', "]}"))
    return made.select("scenario_id", "service", "ready_endpoints", "not_ready_endpoints", _join(F.transform("addresses", lambda a: F.concat_ws("/", a["ip"], a["pod"]))).alias("addresses"), _join(F.transform("ports", lambda p: F.concat_ws(":", p["name"], p["port"].cast("string")))).alias("ports"))


@query("""SELECT 'r' || (s_suppkey % 3) AS scenario_id, 'web' AS service, CASE s_suppkey % 3 WHEN 0 THEN 'Warning' ELSE 'Normal' END AS type, CASE s_suppkey % 5 WHEN 0 THEN 'BackOff' ELSE 'Pulled' END AS reason, 'pod ' || s_suppkey || ' of it' AS message, s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 AS is_warning FROM supplier""")
def events_parsed(spark, d):
    k = F.col("s_suppkey")
    entry = F.format_string("5m   %s  %s   pod/web-9f655fc76-cvsfn   pod %d of it", F.when(k % 3 == 0, "Warning").otherwise("Normal"), F.when(k % 5 == 0, "BackOff").otherwise("Pulled"), k)
    files = _file(spark, d, "supplier", "events.txt", entry, "LAST SEEN   TYPE   REASON   OBJECT   MESSAGE,", "").withColumn("content", F.replace("content", F.lit(","), F.lit("\n")))
    return scenario.events_of(files).select("scenario_id", "service", "type", "reason", "message", "is_warning")


@query("""SELECT 'r' || (n_nationkey % 3) AS scenario_id, CASE n_nationkey % 4 WHEN 0 THEN 'a' || n_nationkey WHEN 1 THEN 'b' || n_nationkey WHEN 2 THEN 'c' || n_nationkey ELSE 'd' || n_nationkey END AS src, 'z' AS dst FROM nation""")
def topology_parsed(spark, d):
    k = F.col("n_nationkey")
    entry = F.when(k % 4 == 0, F.format_string('{"src":"a%d","dst":"z"}', k)).when(k % 4 == 1, F.format_string('{"source":"b%d","target":"z"}', k)).when(k % 4 == 2, F.format_string('{"from":"c%d","to":"z"}', k)).otherwise(F.format_string('["d%d","z"]', k))
    return scenario.topology_edges_of(_file(spark, d, "nation", "topology.json", entry, '{"edges":[', "]}"))


@query("""SELECT 'r' || (n_nationkey % 3) AS scenario_id, CASE WHEN n_nationkey % 2 = 0 THEN 'svc' || n_nationkey ELSE 'app' || n_nationkey END AS service, 'pod_kill' AS fault_family, CASE n_nationkey % 4 WHEN 0 THEN 'wide' WHEN 1 THEN 'v' ELSE 'default' END AS variant FROM nation""")
def fault_instances_parsed(spark, d):
    k = F.col("n_nationkey")
    entry = F.concat(F.lit('{"fault_family":"pod_kill"'), F.when(k % 4 == 0, ',"variant":{"variant":"wide","n":1}').when(k % 4 == 1, ',"variant":"v"').when(k % 4 == 2, ',"variant":{"n":1}').otherwise(""), F.when(k % 2 == 0, F.format_string(',"faulty_service":"svc%d"}', k)).otherwise(F.format_string(',"faulty_service":"","service":"","app_name":"app%d"}', k)))
    return scenario.fault_instances_of(_file(spark, d, "nation", "spec.json", entry, '{"is_multifault":true,"subproblems":[', "]}")).drop("no")


@query("SELECT 'r' || (n_nationkey % 3) AS scenario_id, 'get_' || lower(n_name) AS api, 'x=1, \"y\"' AS args_text FROM nation WHERE n_nationkey % 5 <> 0 AND NOT contains(n_name, ' ')")
def actions_parsed(spark, d):
    said = F.when((F.col("n_nationkey") % 5 != 0) & ~F.contains("n_name", F.lit(" ")), F.format_string('I call get_%s(x=1, \\"y\\") now', F.lower("n_name"))).otherwise("nothing to do")
    entry = F.when(F.col("n_nationkey") % 2 == 0, F.format_string('{"content":"%s"}', said)).otherwise(F.format_string('"%s"', said))
    return scenario.actions_of(_file(spark, d, "nation", "agent_transcript.json", entry, '{"trace":[', "]}")).select("scenario_id", "api", "args_text")


@query("SELECT 'r' || (s_suppkey % 3) AS scenario_id, 'web' AS service, count(*) AS lines, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS failed FROM supplier GROUP BY 1")
def log_files_parsed(spark, d):
    entry = F.when(F.col("s_suppkey") % 2 == 0, "it failed").otherwise("fine")
    files = _file(spark, d, "supplier", "/x/pod_logs/web-9f655fc76-cvsfn.log", entry, "", "\n").withColumn("content", F.replace("content", F.lit(","), F.lit("\x0b")))
    rows = logs.parsed(scenario.log_lines_of(files))
    return rows.groupBy("scenario_id", "service").agg(F.count("*").alias("lines"), F.count_if(F.col("bucket") == "error").alias("failed"))


def _written(spark: SparkSession, d: str) -> str:
    """Metric files of two scenarios with permuted headers."""
    root = shared_folder(spark)
    t = base._read(spark, d, "events").withColumns({"pod": F.concat(F.lit("n.web-"), (F.col("user_id") % 9).cast("string")), "v": F.col("value").cast("string")})
    one = t.where("event_id % 2 = 0").select(F.col("ts").cast("string").alias("timestamp"), F.col("pod").alias("cmdb_id"), F.col("event_type").alias("kpi_name"), F.col("v").alias("value"))
    two = t.where("event_id % 2 = 1").select(F.col("v").alias("val"), F.col("event_type").alias("Metric"), F.concat(F.lit('a "note", '), F.col("v"), F.lit("\nmore")).alias("note"), F.col("pod").alias("Pod"))
    one.coalesce(2).write.option("header", True).csv(f"{root}/a/metrics")
    two.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{root}/b/metrics")
    return root


@query("SELECT CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS scenario_id, 'web-' || (user_id % 9) AS service, event_type AS kpi_name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def metric_header_align(spark, d):
    rows = scenario.metric_samples(spark, _written(spark, d))
    return rows.groupBy("scenario_id", "service", "kpi_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS scenario_id, 'web-' || (user_id % 9) AS service, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS failed, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def trace_header_align(spark, d):
    root, e = shared_folder(spark), F.col("event_id")
    t = base._read(spark, d, "events").withColumns({"who": F.concat(F.lit("web-"), (F.col("user_id") % 9).cast("string")), "v": F.col("value").cast("string")})
    one = t.where(e % 2 == 0).select((e % 7).alias("trace_id"), e.alias("span_id"), F.lit("").alias("parent_span"), F.col("who").alias("service_name"), F.lit("op").alias("operation_name"), F.col("v").alias("duration"), F.when(e % 4 == 0, "503").otherwise("200").alias("response"))
    two = t.where(e % 2 == 1).select(F.col("who").alias("Service"), e.alias("SpanID"), F.lit("p, q").alias("Operation"), (e % 7).alias("TraceID"), F.col("v").alias("duration_us"), F.lit("no").alias("error"))
    one.coalesce(2).write.option("header", True).csv(f"{root}/a/traces/spans.csv")
    two.coalesce(1).write.option("header", True).csv(f"{root}/b/traces/jaeger_export")
    rows = scenario.spans(spark, root)
    return rows.groupBy("scenario_id", "service").agg(F.count("*").alias("n"), F.count_if("is_error").alias("failed"), F.round(F.sum("duration_us"), 4).alias("total"))


@query(f"""WITH {base._ONE}, c AS (SELECT service, operation, count(*) AS n FROM sp0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY n DESC, operation) AS rank FROM c) SELECT service, string_agg(operation || '=' || n, ',' ORDER BY rank) AS operations FROM r WHERE rank <= 10 GROUP BY 1""")
def service_operations(spark, d):
    tops = traces.top_of(base.one_file(spark, d), ["scenario_id", "service"], "operation")
    return tops.groupBy("service").agg(_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "operation", "n"))), lambda x: F.concat_ws("=", x["operation"], x["n"].cast("string")))).alias("operations"))
