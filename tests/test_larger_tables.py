"""What showed on larger tables only, on small rows."""

from tracewright.operators import logs, traces
from tracewright.plans import registry, reports


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id bigint, user_id bigint").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_item_numbers_are_no_http_statuses(spark, tmp_path):
    d = _events(spark, tmp_path, [(16, 452), (33, 512), (14, 452), (11, 452)])
    (row,) = registry.log_rollup(spark, d).where("service = 'svc2'").collect()
    assert (row["lines"], row["http_status_counts"]) == (4, "404=1,503=1")
    parsed = {r["message"] for r in registry.log_parse_synthetic(spark, d).where("line_no in (16, 33)").collect()}
    assert parsed == {"served item 452", "served item 512"}


def _aggregate_over(node, plan):
    """The aggregate that takes a node's rows first."""
    above = plan[: next(i for i, line in enumerate(plan) if node in line)]
    return next(line.lstrip(" +-:") for line in reversed(above) if "Aggregate" in line)


def test_facts_of_lines_are_counted_without_a_sort(spark):
    rows = [("s", "b", 1, "web", "connection refused"), ("s", "a", 7, "web", "connection refused"), ("s", "a", 9, "web", "connection refused"), ("s", "a", 8, "web", "out of memory")]
    facts = logs.facts(logs.parsed(spark.createDataFrame(rows, "scenario_id string, path string, line_no bigint, service string, line string")))
    assert _aggregate_over("Generate", facts._jdf.queryExecution().sparkPlan().toString().splitlines()).startswith("HashAggregate")
    got = {r["key"]: (r["n"], tuple(r["first_at"])) for r in facts.where("kind = 'type'").collect()}
    assert got == {"dependency_connection": (3, ("a", 7)), "oom_or_resource": (1, ("a", 8))}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_not_sorted_ahead_of_their_shuffle(spark):
    rows = [("s", "f", 1, 7, 1, 0, "a"), ("s", "f", 2, 7, 1, 0, "b"), ("s", "f", 3, 7, 2, 1, "c"), ("s", "f", 4, None, None, None, "d"), ("s", "f", 5, None, 2, None, "e")]
    spans = spark.createDataFrame(rows, "scenario_id string, path string, row_no int, trace_id int, span_id int, parent_span int, service string")
    made = traces.linked(spans)
    assert "WindowGroupLimit" not in _plan(made)
    assert {(r["src"], r["dst"]) for r in made.collect()} == {("ROOT", "a"), ("ROOT", "b"), ("b", "c"), ("ROOT", "d"), ("ROOT", "e")}


def test_edges_are_read_from_files(spark):
    rows = [("s", "f", n, n, 1, 0, "a", "op", float(n), "", False) for n in range(50)]
    spans = spark.createDataFrame(rows, "scenario_id string, path string, row_no int, trace_id int, span_id int, parent_span int, service string, operation string, duration_us double, response string, is_error boolean")
    for whole in (10, 100):
        made = traces.call_edges(spans, whole=whole)
        assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
        (row,) = made.collect()
        assert (row["num_requests"], row["num_traces"], row["latency_p50_us"]) == (50, 50, 24.5)


def test_views_read_stored_lines_and_no_pod_names(spark):
    d = "/root/testdata/sf0.001"
    assert "Repartition" not in _plan(reports.log_view(spark, d))
    assert "collect_set(pod#" not in _plan(reports.graph_nodes(spark, d))
    assert "pod_names" not in registry.state(spark, d).columns
