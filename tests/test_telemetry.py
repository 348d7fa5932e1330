"""Operators of the telemetry engine on small rows with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import logs, names, rules
from tracewright.operators import agents, diagnosis, grouping, metrics, outcome, system, traces
from tracewright.sources import scenario, sinks


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("f", "text", "name"), [
    (names.shared_service, "kind-control-plane.compose-post-service-9f655fc76-cvsfn", "compose-post-service"),
    (names.log_service, "pod_logs/post-storage-service-59479466b5-9nxxw.log", "post-storage-service"),
    (names.metric_service, "node.user-service-9f655fc76-cvsfn", "user-service"),
    (names.class_service, "ComposePostService.cpp", "compose-post-service"),
    (names.client_of_store, "user-timeline-redis", "user-timeline-service"),
    (names.file_service, "a/step_1_get_logs.txt", "unknown"),
    (names.shared_service, "", "unknown"),
])
def test_names(spark, f, text, name):
    assert one(spark, f, text) == name


@pytest.mark.parametrize(("text", "kind"), [("Connection refused by redis", "dependency_connection"), ("redis is slow", "db_error"), ("all well", "none"), ("it failed", "generic_error"), (None, "none")])
def test_error_types(spark, text, kind):
    assert one(spark, logs.error_type, text) == kind


def test_log_formats(spark):
    rows = ["[2026] <error>: (a.h:1:f) boom", "2026/05/01 00:00:01 [warn] slow", '{"s":"E","msg":"m","c":"q"}', "plain failed", ""]
    found = spark.createDataFrame([(r,) for r in rows], "x string").select(logs.parse_line(F.col("x")).alias("p")).select("p.*").collect()
    assert [(r["format"], r["severity"], r["message"]) for r in found] == [("cpp", "error", "boom"), ("nginx", "warn", "slow"), ("json", "error", "m"), ("plain", "error", "plain failed"), ("plain", "info", "")]


def test_error_spans_guard_against_odd_numbers(spark):
    rows = [("false", "503"), ("true", ""), ("", "nan"), ("", "inf"), ("", "timeout"), (None, None), ("", "200")]
    found = spark.createDataFrame(rows, "a string, b string").select(rules.is_error_span(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [True, True, False, False, True, False, False]


def test_edges_take_the_last_of_equal_spans(spark):
    rows = [("s", "f", 1, "t", "1", None, "a", "o", 10.0, "", False), ("s", "f", 2, "t", "1", None, "b", "o", 10.0, "", False), ("s", "f", 3, "t", "2", "1", "c", "o", 20.0, "", True), ("z", "f", 1, "t", "2", "1", "c", "o", 5.0, "", False)]
    spans = spark.createDataFrame(rows, "scenario_id string, path string, row_no int, trace_id string, span_id string, parent_span string, service string, operation string, duration_us double, response string, is_error boolean")
    found = {(r["scenario_id"], r["src"], r["dst"]): (r["num_requests"], r["error_ratio"]) for r in traces.call_edges(spans).collect()}
    assert found == {("s", "ROOT", "a"): (1, 0.0), ("s", "ROOT", "b"): (1, 0.0), ("s", "b", "c"): (1, 1.0), ("z", "ROOT", "c"): (1, 0.0)}


def test_kpis_in_read_order(spark):
    rows = [("s", "b", 1, "x", "cpu", 5.0), ("s", "a", 2, "x", "cpu", 2.0), ("s", "a", 1, "x", "cpu", 9.0)]
    r = metrics.kpi_summary(spark.createDataFrame(rows, "scenario_id string, path string, row_no int, service string, kpi_name string, value double")).first()
    assert (r["first_value"], r["last_value"], r["delta"], r["kpi_group"]) == (9.0, 5.0, -4.0, "cpu")


def test_advantages(spark):
    rows = [("g", 1.0), ("g", 3.0), ("one", 7.0), ("same", 2.0), ("same", 2.0)]
    found = sorted((r["group_id"], round(r["advantage"], 6)) for r in outcome.advantages(spark.createDataFrame(rows, "group_id string, reward double")).collect())
    assert found == [("g", -1.0), ("g", 1.0), ("one", 0.0), ("same", 0.0), ("same", 0.0)]


def test_commands(spark):
    assert one(spark, rules.command_lines, "Do:\n```bash\n$ kubectl get pods\n# no\n> helm list\n```") == ["kubectl get pods", "helm list"]
    assert one(spark, rules.blocked, "KUBECTL delete namespace x") is not None
    assert json.loads(one(spark, rules.json_in_text, 'so: {"a": 1} ok')) == {"a": 1}
    assert one(spark, rules.json_in_text, "none") is None


def test_scenario_folder(spark, tmp_path):
    root = tmp_path / "runs"
    for sid in ("a", "b"):
        (root / sid / "metrics").mkdir(parents=True)
        (root / sid / "direct_k8s_outputs" / "pod_logs").mkdir(parents=True)
    (root / "a" / "DONE.json").write_text("{}")
    (root / "a" / "metrics" / "kpi_1.csv").write_text("timestamp,cmdb_id,kpi_name,value\n1,n.web-9f655fc76-cvsfn,cpu,2\n2,n.web-9f655fc76-cvsfn,cpu,NaN\n")
    (root / "b" / "metrics" / "kpi_2.csv").write_text('value,metric,pod\n7,mem,"db"\n,mem,db\n')
    (root / "a" / "direct_k8s_outputs" / "pod_logs" / "web-9f655fc76-cvsfn.log").write_text("one\n\ntwo failed\n")
    (root / "a" / "direct_k8s_outputs" / "pods.json").write_text(json.dumps({"items": [{"metadata": {"name": "web-1", "labels": {"app": "web"}}, "status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}], "containerStatuses": [{"restartCount": 2, "state": {"running": {"startedAt": "t"}}}, {"restartCount": 1, "state": {"waiting": {"reason": "CrashLoopBackOff"}}}]}}, {"metadata": {"name": "web-2", "labels": {"app": "web"}}, "status": {"phase": "Failed", "conditions": [{"type": "Ready", "status": "True"}, {"type": "ContainersReady", "status": "True"}]}}]}))
    (root / "b" / "direct_k8s_outputs" / "pods.json").write_text("not json")
    got = {(r["scenario_id"], r["service"], r["kpi_name"], r["value"]) for r in scenario.metric_samples(spark, str(root)).collect()}
    assert got == {("a", "web", "cpu", 2.0), ("a", "web", "cpu", 0.0), ("b", "db", "mem", 7.0)}
    assert [(r["service"], r["line"]) for r in scenario.log_lines(spark, str(root)).orderBy("line_no").collect()] == [("web", "one"), ("web", ""), ("web", "two failed")]
    pod = scenario.pods(spark, str(root)).collect()
    assert sorted((p["scenario_id"], p["service"], p["pod"], p["ready"], p["restarts"], p["waiting_reasons"]) for p in pod) == [("a", "web", "web-1", False, 3, ["CrashLoopBackOff"]), ("a", "web", "web-2", False, 0, [])]
    rolled = system.pod_rollup(scenario.pods(spark, str(root))).first()
    assert (rolled["pods_ready"], rolled["failed"], rolled["crashloop"], rolled["waiting"], rolled["status"]) == (0, 1, 1, 1, "crashloop")
    assert [r[0] for r in scenario.finished(spark, str(root)).collect()] == ["a"]
    sinks.write_documents(spark.createDataFrame([("a/b c", 1)], "scenario_id string, n int"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "scenario_id=a_b_c").is_dir()


def test_readers_take_all_files_of_a_kind(spark, tmp_path):
    """The scenario is the folder behind the root, also where a folder above bears the root's name; files are known by
    name or header, quoted fields hold commas, quotes and line ends."""
    root = tmp_path / "runs" / "a b" / "runs"
    logs_dir = root / "one" / "builtin_api_outputs" / "logs"
    for folder in (logs_dir, root / "one" / "out", root / "two" / "out", root / "two" / "topology"):
        folder.mkdir(parents=True)
    (logs_dir / "step_3_get_logs.txt").write_text("[pod/web-1/web-front] one\ntwo\n")
    (root / "one" / "out" / "numbers.csv").write_text('note,Metric,val,pod\n"say ""hi"",\nnow",cpu,4,x.web\n')
    (root / "two" / "out" / "calls.csv").write_text("span_id,trace_id,service,duration,status\n1,t,web,5,500\n")
    (root / "two" / "out" / "other.csv").write_text("a,b\n1,2\n")
    (root / "two" / "rows.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    (root / "two" / "ground_truth.json").write_text('{"service": "web"}')
    (root / "two" / "topology" / "topology.json").write_text('{"services": ["web", {"name": "db"}], "nodes": [{"id": "cache"}]}')
    (root / "two" / "run_result.json").write_text('{"history": [{"content": "get_logs(web)"}]}')
    got = scenario.metric_samples(spark, str(root)).collect()
    assert [(r["scenario_id"], r["service"], r["kpi_name"], r["value"]) for r in got] == [("one", "web", "cpu", 4.0)]
    assert [(r["scenario_id"], r["service"], r["is_error"]) for r in scenario.spans(spark, str(root)).collect()] == [("two", "web", True)]
    assert [(r["scenario_id"], r["service"], r["line"]) for r in scenario.log_lines(spark, str(root)).orderBy("line_no").collect()] == [("one", "web-front", "[pod/web-1/web-front] one"), ("one", "web-front", "two")]
    assert [r["row"] for r in scenario.json_lines(spark, str(root)).collect()] == ['{"a": 1}', '{"a": 2}']
    assert [tuple(r) for r in scenario.documents(spark, str(root)).collect()] == [("two", "ground_truth", '{"service": "web"}')]
    assert sorted(r["service"] for r in scenario.topology_services(spark, str(root)).collect()) == ["cache", "db", "web"]
    assert [(r["scenario_id"], r["api"]) for r in scenario.actions(spark, str(root)).collect()] == [("two", "get_logs")]


def test_severities_by_alias(spark):
    rows = ["[t] <E>: (a.h:1:f) x", "[t] <W>: (a.h:1:f) x", '{"level":"WARNING","msg":"x"}', "2026/05/01 00:00:01 [crit] timeout", "2026/05/01 00:00:01 [notice] fine"]
    found = spark.createDataFrame([(r,) for r in rows], "x string").select(logs.parse_line(F.col("x")).alias("p")).select(logs.bucket(F.col("p.severity"), logs.error_type(F.col("p.message"))))
    assert [r[0] for r in found.collect()] == ["error", "warn", "warn", "error", "info"]


def test_rewards_of_pods_that_are_gone(spark):
    rows = [("gone", "a", True, True, None), ("gone", "b", False, True, True), ("null", "a", None, True, True), ("null", "b", None, True, False), ("part", "a", True, False, True), ("part", "b", True, True, False), ("all", "a", True, False, True), ("none", "a", False, True, None)]
    found = {r["scenario_id"]: r["reward"] for r in outcome.rewards(spark.createDataFrame(rows, "scenario_id string, pod string, relevant boolean, pre boolean, post boolean")).collect()}
    assert found == {"gone": 0.0, "null": 0.5, "part": 0.55, "all": 1.0, "none": 0.0}


def test_variants_and_defaults_in_the_library(spark):
    empty = spark.createDataFrame([], "scenario_id string, src string, dst string, error_ratio double, latency_p95_us double")
    state = spark.createDataFrame([("s", "a", "healthy", 0.0)], "scenario_id string, service string, status string, anomaly double")
    faults = spark.createDataFrame([("s", "a", "revoke_auth", '{"variant": "wide"}')], "scenario_id string, service string, fault_family string, variant string")
    made = {(r["service"], r["fault_type"]) for r in diagnosis.fault_library(diagnosis.fault_signature(empty, state, faults)).collect()}
    assert made == {("a", "auth_failure"), ("a", "variant_specific"), (None, "dependency_failure"), (None, "latency_degradation"), (None, "config_error"), (None, "infra_failure"), (None, "ghost_failure")}


def test_replies_fall_back(spark):
    rows = [("a", 'x {"root_cause_service": "web", "fault_type": "config_error", "confidence": 3} y', None, None, None), ("b", "none", None, "known", "network_delay"), ("c", None, "hint", "known", None)]
    made = agents.validated(spark.createDataFrame(rows, "scenario_id string, reply string, hint string, faulty_service string, fault_family string")).orderBy("scenario_id").collect()
    assert [(r["root_cause_service"], r["fault_type"], r["confidence"]) for r in made] == [("web", "config_error", 1.0), ("known", "latency_degradation", 0.5), ("hint", "dependency_failure", 0.5)]


def test_running_figures(spark, tmp_path):
    from tracewright.streaming import windows

    rows = [(f"2026-05-01 00:{m:02d}:00", "web", "cpu", float(m)) for m in (0, 1, 2, 7, 30)]
    spark.createDataFrame(rows, "ts string, service string, kpi_name string, value double").selectExpr("cast(ts as timestamp) as ts", "service", "kpi_name", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, service string, kpi_name string, value double").parquet(str(tmp_path / "in"))
    for name, made in (("kpis", windows.windowed_kpis(stream)), ("sessions", windows.activity(stream))):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert sorted((r["n"], r["mean_value"]) for r in spark.table("kpis").collect()) == [(1, 7.0), (3, 1.0)]
    assert [r["n"] for r in spark.table("sessions").collect()] == [4]


def test_breakdown_and_buffer(spark):
    rows = [("s", "a", True, None, True), ("s", "b", True, True, False), ("s", "c", False, True, True), ("s", "d", True, True, None)]
    r = outcome.breakdown(spark.createDataFrame(rows, "scenario_id string, pod string, relevant boolean, pre boolean, post boolean")).first()
    assert (r["tracked"], r["pre_ready"], r["post_ready"], r["recovered"], r["regressed"]) == (["a", "b"], ["b"], ["a"], ["a"], ["b"])
    samples = spark.createDataFrame([(1, None, "p" * 300), (1, "g", "q"), (2, "g", "q")], "batch_id int, group_id string, prompt string")
    assert sorted(x["group_id"] for x in outcome.buffered(samples).collect()) == ["g", "p" * 200]


def test_compact_lists(spark):
    r = spark.createDataFrame([(["a", "b", "c"],), (None,)], "x array<string>").select(grouping.compact(F.col("x"), 2).alias("c")).collect()
    assert [(x["c"]["items"], x["c"]["truncated"], x["c"]["total_count"]) for x in r] == [(["a", "b"], True, 3), ([], False, 0)]


def test_iterations_and_scenarios_as_they_are_kept(spark):
    iterations = spark.createDataFrame([("a", 0, 0.4, False, 1.236), ("a", 1, 0.90004, True, 2.0), ("a", 2, 0.90004, True, 1.0), ("b", 0, 0.0, False, 1.0), ("e", 0, 1.0, True, 9.0)], "scenario_id string, iteration int, reward double, passed boolean, elapsed double")
    results = spark.createDataFrame([("a", 1, 2, "second", "x" * 600, "", 1, 3.14), ("a", 1, 1, "first", "", "", 0, 1.0), ("a", 2, 1, "late", "", "", 0, 1.0), ("z", 0, 1, "stray", "", "", 0, 1.0)], "scenario_id string, iteration int, no int, command string, stdout string, stderr string, returncode int, elapsed_ms double")
    rows = outcome.iteration_rows(iterations, results)
    kept = {(r["scenario_id"], r["iteration"]): r for r in rows.collect()}
    assert len(kept) == 5 and kept["a", 1]["commands"] == ["first", "second"] and kept["a", 0]["commands"] == [] and kept["a", 0]["elapsed_seconds"] == 1.24
    assert [(x["ok"], len(x["stdout"])) for x in kept["a", 1]["command_results"]] == [(True, 0), (False, 500)] and kept["a", 1]["reward"] == 0.9
    scenarios = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "scenario_id string")
    verified = spark.createDataFrame([("a", True), ("e", True)], "scenario_id string, verified boolean")
    errors = spark.createDataFrame([("e", "no state", 0.126)], "scenario_id string, error string, elapsed double")
    made = {r["scenario_id"]: r for r in outcome.scenario_results(scenarios, rows, iterations, verified, errors).collect()}
    assert (made["a"]["best_commands"], made["a"]["best_reward"], made["a"]["n_iterations"], made["a"]["passed"], made["a"]["rca_verified"], made["a"]["elapsed_seconds"]) == (["first", "second"], 0.9, 3, True, True, 4.24)
    assert [x["iteration"] for x in made["a"]["iterations"]] == [0, 1, 2] and made["b"]["best_commands"] == [] and made["b"]["best_reward"] == 0.0 and made["b"]["n_iterations"] == 1
    assert (made["c"]["n_iterations"], made["c"]["iterations"], made["c"]["error"]) == (0, [], "")
    assert (made["e"]["passed"], made["e"]["rca_verified"], made["e"]["iterations"], made["e"]["elapsed_seconds"], made["e"]["error"]) == (False, False, [], 0.13, "no state")


def test_verification_as_it_is_kept(spark):
    names = "scenario_id string, service string"
    original = spark.createDataFrame([("a", "user"), ("a", "cart"), ("a", "post"), ("b", "x")], names)
    observed = spark.createDataFrame([("a", "user-service"), ("a", "unknown"), ("a", "geo"), ("c", "geo")], names)
    waits = spark.createDataFrame([("a", 12.5)], "scenario_id string, wait_seconds double")
    made = {r["scenario_id"]: r for r in outcome.verification_rows(outcome.overlap(original, observed), original, observed, waits).collect()}
    a = made["a"]
    assert (a["match_score"], a["verified"], a["original_unhealthy"], a["twin_degraded_services"], a["overlap"], a["wait_seconds"]) == (0.333, False, ["cart", "post", "user"], ["geo", "user-service"], ["user"], 12.5)
    assert "Symptom overlap: 1/3" in a["reasoning"] and made["b"]["overlap"] == [] and made["c"]["original_unhealthy"] == [] and made["c"]["wait_seconds"] == 0


def test_complexity_counts_services_that_nobody_calls(spark):
    edges = spark.createDataFrame([("a", "u", "v", "critical"), ("a", "v", "w", "important")], "scenario_id string, src string, dst string, criticality string")
    services = spark.createDataFrame([("a", "lone"), ("a", "u"), ("b", "x"), ("b", None)], "scenario_id string, service string")
    snapshots = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1)], "scenario_id string, snapshot int")
    made = {r["scenario_id"]: tuple(r)[1:] for r in grouping.complexity_report(edges, services, snapshots).collect()}
    assert made == {"a": (4, 2, 1, 1, 2, True), "b": (1, 0, 0, 0, 1, False)}
