"""Readers over files of several splits, sinks that are written again, documents of any depth, evidence in order."""

import json
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import names
from tracewright.functions.logs import LINE_ENDS
from tracewright.operators import diagnosis, documents, grouping, logs, matching, system, traces, views  # noqa: F401
from tracewright.sources import scenario, sinks
from tracewright.sources.text_lines import first_lines, numbered_lines, settings


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"newline": ""})) as f:
        f.write(text)


def whole(text):
    lines = re.split(LINE_ENDS, text)
    return lines[:-1] if lines and lines[-1] == "" else lines


def test_line_numbers_over_splits_equal_a_whole_read(spark, tmp_path):
    rng, want = random.Random(3), {}
    ends = ["\n", "\r\n", "\n", "\x0b", " ", "\n\n"]
    for k in range(4):
        text = "".join(f"{k} line {i} {'é' * rng.randint(0, 40)}{rng.choice(ends)}" for i in range(800)) + "the end\n" * (k % 2)
        put(f"{tmp_path}/sc{k}/pod_logs/web-{k}.log", text)
        want[f"web-{k}.log"] = whole(text)
    put(f"{tmp_path}/sc0/pod_logs/empty.log", "")
    with settings(spark, spark__sql__files__maxPartitionBytes="4k", spark__sql__files__openCostInBytes="1"):
        lines = numbered_lines(spark, str(tmp_path), "*.log", F.lit(True))
        tasks = lines.select(F.regexp_extract("path", "([^/]*)$", 1).alias("f"), "line_no", "line", F.spark_partition_id().alias("p")).collect()
        own = scenario.log_lines(spark, str(tmp_path)).groupBy("scenario_id", "service").count().collect()
    got = {}
    for r in tasks:
        got.setdefault(r["f"], {})[r["line_no"]] = r["line"]
    for name, rows in want.items():
        assert [got[name][i] for i in range(len(rows))] == rows and len(got[name]) >= len(rows)
        assert len(got[name]) - len(rows) <= 1  # a last line that ends in another mark than a line feed
    assert len({r["p"] for r in tasks if r["f"] == "web-1.log"}) > 1
    assert {r["scenario_id"] for r in own} == {f"sc{k}" for k in range(4)} and {r["service"] for r in own} == {f"web-{k}" for k in range(4)}


def test_first_lines_of_every_file(spark, tmp_path):
    for k in range(30):
        put(f"{tmp_path}/d{k % 3}/f {k}.csv", f"head{k},x\n" + "1,2\n" * (k * 400))
    put(f"{tmp_path}/d0/empty.csv", "")
    for extra in ({}, {"spark__sql__files__maxPartitionBytes": "2k"}):
        with settings(spark, **extra):
            found = dict(first_lines(spark, str(tmp_path), "*.csv"))
        assert sorted(found.values()) == sorted(f"head{k},x" for k in range(30))


def test_exports_outside_the_folder(spark, tmp_path):
    root, away = f"{tmp_path}/runs", f"{tmp_path}/else where"
    put(f"{root}/a/metrics/kpi_x.csv", "time,pod,metric,val\n1,n.web,cpu,2\n")
    put(f"{away}/m/deep/k.csv", "time,pod,metric,val\n1,n.cart,cpu,5\n")
    put(f"{away}/m/notes.csv", "who,what\n1,2\n")
    put(f"{away}/lone.csv", '"val","metric","pod"\n7,mem,n.db\n')
    put(f"{root}/b/builtin_api_outputs/metrics/step_1.txt", f'ok\nExported metrics to directory: "{away}/m"\nexported to: {away}/nowhere\n')
    put(f"{root}/c/builtin_api_outputs/metrics/step_9.txt", f"exported to: {away}/lone.csv\n")
    put(f"{root}/d/builtin_api_outputs/metrics/step_9.txt", f"exported to: {away}/lone.csv\nexported to: {root}/a/metrics\n")
    got = sorted((r["scenario_id"], r["service"], r["kpi_name"], r["value"]) for r in scenario.metric_samples(spark, root).collect())
    assert got == [("a", "web", "cpu", 2.0), ("b", "cart", "cpu", 5.0), ("c", "db", "mem", 7.0), ("d", "db", "mem", 7.0)]


def test_states_end_at_the_first_bad_line(spark, tmp_path):
    good = json.dumps({"metrics": {"web": {"latency": 900.0}}, "system": {"web": {"service_health_status": "crashloop"}}, "traces": {"a->web": {"error_ratio": 0.5}}})
    put(f"{tmp_path}/s/states.jsonl", good + "\n{}\n{bad\n" + good + "\n")
    rows = scenario.state_lines(spark, str(tmp_path))
    got = sorted((r["line_no"], r["service_violations"], r["edge_violations"], r["unhealthy_services"], r["violated"]) for r in diagnosis.snapshot_sla(rows).collect())
    assert got == [(0, 1, 1, 1, True), (1, 0, 0, 0, False)]


def test_a_line_counts_for_its_container(spark):
    text = ["[pod/web-1/cart] connection refused", "[pod/web-1/user] ok", "[pod/web-1/user] Cloning into x", "plain"]
    lines = spark.createDataFrame([("s", "f", i, "unknown", t) for i, t in enumerate(text)], "scenario_id string, path string, line_no long, service string, line string")
    got = {r["service"]: (r["lines"], r["errors"], r["noise_lines"]) for r in logs.rollup(logs.facts(logs.parsed(lines))).collect()}
    assert got == {"cart": (1, 1, 0), "user": (1, 0, 0), "unknown": (1, 0, 1)}


def test_first_dependency_errors_of_a_service(spark):
    said = "connection refused calling ismaster on 'a-redis:6379' and 'a-redis:6379' or 'b-db:5432'"
    lines = spark.range(100).select(F.lit("s").alias("scenario_id"), F.lit("f").alias("path"), F.col("id").alias("line_no"), F.lit("web").alias("service"), F.lit(said).alias("line"))
    rows = logs.dependency_errors(logs.parsed(lines)).orderBy("no").collect()
    assert [r["no"] for r in rows] == list(range(1, 51)) and [r["target"] for r in rows[:4]] == ["a-redis", "b-db"] * 2
    assert logs.dependency_edges(logs.dependency_errors(logs.parsed(lines))).columns == ["scenario_id", "source", "target", "port", "error_type", "message"]


def test_sinks_replace_their_scenarios_only(spark, tmp_path):
    own = lambda s, v: spark.createDataFrame([(s, v)], "scenario_id string, v int")
    for write, read in ((sinks.write_documents, None), (lambda d, p: sinks.write_tables({"t": d}, p), "t"), (sinks.write_scenario_lines, None)):
        path = str(tmp_path / f"sink{id(write)}")
        write(own("a", 1), path)
        write(own("b", 2), path)
        write(own("b", 3), path)
        files = [os.path.join(d, f) for d, _, names_ in os.walk(path) for f in names_ if f.startswith("part-")]
        assert sorted({re.search("scenario_id=([ab])", f)[1] for f in files}) == ["a", "b"] and len(files) == 2
        if read:
            assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/{read}").select("scenario_id", "v").collect()) == [("a", 1), ("b", 3)]


def test_reasons_of_an_edge_stand_side_by_side(spark):
    state = spark.createDataFrame([("s", "web", 0.0, "none", 0.0, 0.0, False, "crashloop")], "scenario_id string, service string, anomaly double, dominant_error_type string, latency_ms double, metric_restarts double, infra_issue boolean, status string")
    edges = spark.createDataFrame([("s", f"a{k:02}", "web", 0.5, 0.5, "partial_error_path") for k in range(11)], "scenario_id string, src string, dst string, edge_score double, error_ratio double, failure_type string")
    faults = spark.createDataFrame([("s", 1, "web", "pod_failure", '{"variant": "wide", "n": 2}'), ("s", 0, "web", "auth_miss_mongodb", None)], "scenario_id string, no int, service string, fault_family string, variant string")
    row = diagnosis.rca_scores(state, edges, faults).first()
    assert row["reasons"] == [x for k in range(5) for x in (f"trace_edge_issue=a{k:02}->web", "trace_failure_type=partial_error_path")]
    told = diagnosis.rca_scores(state, edges.limit(0), faults).first()["reasons"]
    assert told == ["scenario_fault_context=auth_failure", "direct_system_status=crashloop", "scenario_fault_context=infra_failure", "direct_system_status=crashloop", "scenario_variant=wide"]
    found = diagnosis.hypotheses(faults).first()["hypotheses"]
    assert [(h["fault_type"], h["variant_name"], h["variant_params"]) for h in found] == [("auth_failure", "default", "{}"), ("infra_failure", "wide", '{"n":"2"}')]


def test_faults_with_blank_names(spark):
    spec = ['{"faulty_service": "", "service": "web", "variant": {"n": 1}}', '{"app_name": "x", "variant": ""}', '{"fault_service": "y", "variant": "v"}']
    files = spark.createDataFrame([(f"s{k}", "spec.json", t) for k, t in enumerate(spec)], "scenario_id string, path string, content string")
    got = sorted((r["scenario_id"], r["service"], r["variant"]) for r in scenario.fault_instances_of(files).collect())
    assert got == [("s0", "web", "default"), ("s1", "x", "default"), ("s2", "y", "v")]


def test_longest_known_name(spark):
    rng = random.Random(5)
    known = ["a", "db", "cart", "cart-db", "user-service", "user-timeline-service", "é日本", ""]
    texts = ["".join(rng.choice(["cart", "-db", "user-", "timeline-", "service", "x", " ", "é日本", "a"]) for _ in range(6)) for _ in range(200)] + ["", None]
    rows = spark.createDataFrame([("s", t) for t in texts] + [("other", "cart")], "scope string, text string")
    made = matching.longest_known(rows, spark.createDataFrame([("s", k) for k in known], "scope string, name string"), ["scope"]).collect()
    assert len(made) == len(texts) + 1
    for r in made:
        hits = [k for k in known if k and r["text"] and k in r["text"]] if r["scope"] == "s" else []
        assert r["match"] == (min(hits, key=lambda k: (-len(k), k)) if hits else None)


def test_groups_of_nested_objects(spark):
    rows = spark.createDataFrame([("p", '{"x":1,"y":{"b":[{"q":1,"p":2}],"a":2}}', 1.0), ("q", '{"y":{"a":2.0,"b":[{"p":2,"q":1}]},"x":1}', 1.0), ("r", "{broken", None), ("t", None, None)], "name string, o string, v double")
    got = sorted(tuple(r["names"]) for r in grouping.identical(rows, "name", "o", "v").collect())
    assert got == [("p", "q"), ("r",), ("t",)]
    assert sorted((r["name"], r["n"]) for r in grouping.members(rows, "name", "o", "v").collect()) == [("p", 2), ("q", 2), ("r", 1), ("t", 1)]


def test_rounding_and_rendering_at_any_depth(spark):
    df = spark.sql("""SELECT named_struct('a', named_struct('x', double(1) / 3, 'n', double('NaN')), 'l', array(double('Infinity'), 2.00004D), 'm', map('b', array(named_struct('v', 1.23456D)), 'a', array()), 'e', array(), 't', 'q"é', 'z', int(null)) AS d, cast(null AS struct<x:double>) AS none""")
    made = documents.round_columns(df)
    row = made.first()
    assert row["d"]["a"]["x"] == 0.3333 and row["d"]["a"]["n"] == 0.0 and row["d"]["l"] == [0.0, 2.0] and row["d"]["m"]["b"][0]["v"] == 1.2346 and row["none"] is None
    text = made.select(documents.render_rows(made, "d", "none").alias("t")).first()["t"]
    assert text == '{\n  "d": {\n    "a": {\n      "x": 0.3333,\n      "n": 0.0\n    },\n    "l": [0.0, 2.0],\n    "m": {\n      "a": [],\n      "b": [\n        {\n          "v": 1.2346\n        }\n      ]\n    },\n    "e": [],\n    "t": "q\\"é",\n    "z": null\n  },\n  "none": null\n}'
    assert json.loads(text)["d"]["m"]["b"] == [{"v": 1.2346}]


def test_every_key_with_a_label_is_redacted(spark):
    labels = ["fault_context", "ground_truth", "fault_timing", "rca_features", "history", "run_dir", "timestamp", "state_type", "unheard_of"]
    one = spark.range(1).select(F.lit("s").alias("scenario_id"))
    doc = documents.state(one, {"metrics": (one.limit(0).withColumn("service", F.lit("w")), "service")}, {"services": one.limit(0).withColumn("service", F.lit("w"))}, {}, {k: F.lit("secret") for k in labels})
    made = doc.select(F.to_json(documents.redacted(F.col("document"))).alias("t")).first()["t"]
    assert "secret" not in made and json.loads(made) == {"scenario_id": "s", "metrics": {}, "services": []}
    kept = doc.select(F.to_json(documents.replaced(F.col("document"), metrics=F.parse_json(F.lit("[1]")))).alias("t")).first()["t"]
    assert json.loads(kept)["metrics"] == [1] and json.loads(kept)["unheard_of"] == "secret"
    assert documents.summary(doc).first()["categories_present"] == ["history"]


@pytest.mark.parametrize("accuracy", [50, 2000])
def test_quantiles_equal_percentile(spark, accuracy):
    rng = random.Random(9)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(6000)] + [("ties", float(rng.randint(0, 3))) for _ in range(3000)] + [("few", float(k)) for k in range(7)] + [("one", 5.0), ("none", None), ("same", 1.0), ("same", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {r["k"]: r for r in traces.quantiles(df, ["k"], "v", probs, accuracy).collect()}
    for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("p")).collect():
        assert r["p"] is None and r["k"] not in got or all(math.isclose(got[r["k"]][f"q{i}"], x, rel_tol=1e-12) for i, x in enumerate(r["p"]))


def test_hot_edges_get_the_same_figures(spark):
    spans = spark.range(4000).select(F.lit("s").alias("scenario_id"), F.lit("f").alias("path"), F.col("id").alias("row_no"), (F.col("id") % 40).alias("trace_id"), F.col("id").alias("span_id"), F.when(F.col("id") > 39, F.col("id") - 40).alias("parent_span"), F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("service"), F.lit("o").alias("operation"), ((F.col("id") * 7919) % 1009).cast("double").alias("duration_us"), F.lit("").alias("response"), (F.col("id") % 5 == 0).alias("is_error"))
    plain, hot = (sorted(map(tuple, traces.call_edges(spans, whole=n).select("src", "dst", "num_requests", "num_traces", F.round("latency_p50_us", 6), F.round("latency_p95_us", 6), F.round("latency_p99_us", 6)).collect())) for n in (10**6, 100))
    assert plain == hot and len(plain) > 3


def test_system_view_with_all_tables(spark):
    one = lambda **c: spark.range(1).select(F.lit("s").alias("scenario_id"), F.lit("web").alias("service"), *[F.lit(v).alias(k) for k, v in c.items()])
    own = one(status="crashloop", infra_issue=True, availability=0.33333, pods_total=3, pods_ready=1, pods_unready=2, restarts=4, crashloop=1, oomkilled=0, image_pull_error=0, warnings=1)
    events = spark.range(9).select(F.lit("s").alias("scenario_id"), F.lit("web").alias("service"), F.col("id").alias("no"), F.lit("Warning").alias("type"), F.lit("BackOff").alias("reason"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"))
    row = views.system_view(own, one(ready_endpoints=1, not_ready_endpoints=2), one(deployment="web", replicas=3, ready_replicas=1, available_replicas=1, unavailable_replicas=2), events).first()
    assert row["health"]["availability"] == 0.3333 and row["endpoints"]["not_ready_endpoints"] == 2 and row["deployment"]["replicas"] == 3 and [e["message"] for e in row["events"]] == [f"m{k}" for k in range(5)]


def test_hints_of_outputs_over_lines(spark, tmp_path):
    put(f"{tmp_path}/s/logs/step_3_get_logs.txt", "hello\n(src/UserTimelineHandler.cpp:7:run) x\n[pod/web-1/cart-9f655fc76-cvsfn] y\n")
    put(f"{tmp_path}/s/logs/step_4_get_logs.txt", "x 'cart-mongodb:27017' y\n{\"attr\":{\"host\":\"geo\"}}\n")
    put(f"{tmp_path}/s/logs/step_5_get_logs.txt", "nothing\n")
    got = {r["path"][-14:]: r["service"] for r in scenario.log_lines(spark, str(tmp_path)).select("path", "service").distinct().collect()}
    assert got == {"3_get_logs.txt": "cart", "4_get_logs.txt": "geo", "5_get_logs.txt": "unknown"}
    files = scenario.whole_files(spark, str(tmp_path), "*.txt").select(F.substring("path", -14, 14).alias("p"), names.service_of_output(F.col("content"), F.col("path")).alias("s")).collect()
    assert {r["p"]: r["s"] for r in files} == got
