"""Queries of whole documents, prompts, matching and readers over files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.storage import shared_folder, stored
from tracewright.operators import agents, diagnosis, documents, grouping, logs, matching, metrics, system, traces, views
from tracewright.plans import registry as base
from tracewright.plans import reports
from tracewright.plans.registry import query
from tracewright.sources import scenario

KEY = ["scenario_id", "service"]


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Part names as known names: the second words, every third name as a whole, and two letters."""
    p = base._read(spark, d, "part")
    own = p.select(F.substring_index("p_name", " ", -1).alias("name")).union(p.where("p_partkey % 3 = 0").select("p_name")).union(p.where("p_partkey = 1").select(F.lit("re")))
    return own.select(F.lit("s").alias("scenario_id"), "name")


@query("""WITH k AS (SELECT DISTINCT name FROM (SELECT split_part(p_name, ' ', -1) AS name FROM part UNION ALL SELECT p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 're')),
t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x-' || p_name || ' ' || lower(p_brand) WHEN 1 THEN lower(p_type) WHEN 2 THEN p_name || '-9f655fc76-cvsfn' ELSE '' END AS text FROM part),
m AS (SELECT text, arg_min(name, (-length(name), name)) AS name FROM (SELECT DISTINCT text FROM t) x JOIN k ON contains(text, name) GROUP BY 1)
SELECT p_partkey, coalesce(name, nullif(text, '')) AS service FROM t LEFT JOIN m USING (text)""")
def known_name_match(spark, d):
    k = F.col("p_partkey") % 4
    labels = F.when(k == 0, F.create_map(F.lit("pod"), F.lower("p_brand"), F.lit("service"), F.concat(F.lit("x-"), "p_name"))).when(k == 1, F.create_map(F.lit("app"), F.lower("p_type"))).when(k == 2, F.create_map(F.lit("container"), F.concat("p_name", F.lit("-9f655fc76-cvsfn")), F.lit("tier"), F.lit("re"))).otherwise(F.create_map(F.lit("tier"), F.lit("red")))
    rows = base._read(spark, d, "part").select("p_partkey", F.lit("s").alias("scenario_id"), labels.alias("labels"))
    return matching.service_of_labels(rows, _words(spark, d), ["scenario_id"]).select("p_partkey", "service")


@query(f"WITH {base._ONE} SELECT service, round(quantile_cont(duration_us, 0.5), 4) AS p50, round(quantile_cont(duration_us, 0.95), 4) AS p95, round(quantile_cont(duration_us, 0.99), 4) AS p99 FROM sp0 GROUP BY 1")
def edge_quantiles(spark, d):
    made = traces.quantiles(base.one_file(spark, d), ["service"], "duration_us", [0.5, 0.95, 0.99], 200)
    return made.select("service", *[F.round(f"q{k}", 4).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


@query("SELECT key, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"props\":{\"a\":{\"k\":' || (event_id % 3) || ',\"z\":[1,{\"p\":' || (user_id % 2) || ',\"q\":null}]},\"b\":true}}' AS key FROM events) GROUP BY 1")
def nested_groups(spark, d):
    """Objects whose keys stand in two orders at each depth."""
    x, y, odd = (F.col("event_id") % 3).cast("string"), (F.col("user_id") % 2).cast("string"), F.col("event_id") % 2 == 1
    a = F.when(odd, F.concat(F.lit('{"z": [1, {"q": null, "p": '), y, F.lit('}], "k": '), x, F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), x, F.lit(',"z":[1,{"p":'), y, F.lit(',"q":null}]}')))
    props = F.when(F.col("event_id") % 5 < 2, F.concat(F.lit('{"b": true, "a": '), a, F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), a, F.lit(',"b":true}')))
    rows = base._read(spark, d, "events").select("event_id", "event_type", props.alias("props"))
    return grouping.members(rows, "event_id", "props", "event_type").groupBy("key").agg(F.max("n").alias("n"), F.min("event_id").alias("first_id"))


def _deep(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("s_acctbal") / 3
    inner = F.struct(third.alias("x"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("nan").cast("double")).otherwise(F.lit(0.5)).alias("y"), F.col("s_name").alias("name"))
    return base._read(spark, d, "supplier").select("s_suppkey", F.struct(F.struct(inner.alias("c"), F.array(third, F.lit(1.0)).alias("l")).alias("b"), F.create_map(F.lit("k"), third).alias("m"), F.array(F.struct(third.alias("v"))).alias("s"), F.lit(None).cast("int").alias("none")).alias("a"))


_R3, _Y = "round(s_acctbal / 3, 4)::DOUBLE", "CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE 0.5 END"


@query(f"SELECT s_suppkey, {_R3} AS x, {_Y}::DOUBLE AS y, {_R3} AS l, {_R3} AS m, {_R3} AS v, s_name AS name FROM supplier")
def rounded_document(spark, d):
    made = documents.round_columns(_deep(spark, d))
    return made.select("s_suppkey", "a.b.c.x", "a.b.c.y", F.col("a.b.l")[0].alias("l"), F.col("a.m")["k"].alias("m"), F.col("a.s")[0]["v"].alias("v"), "a.b.c.name")


@query(f"""WITH t AS (SELECT *, ({_R3})::VARCHAR AS r, ({_Y})::DOUBLE::VARCHAR AS y FROM supplier)
SELECT s_suppkey, replace(replace('{{"a": {{"b": {{"c": {{"x": R,|        "y": Y,|        "name": "N"|      }},|      "l": [R, 1.0]|    }},|    "m": {{|      "k": R|    }},|    "s": [|      {{|        "v": R|      }}|    ],|    "none": null|  }}|}}', '"a": {{"b": {{"c": {{"x"', '|  "a": {{|    "b": {{|      "c": {{|        "x"'), '|', chr(10)).replace('R', r).replace('Y', y).replace('"N"', '"' || s_name || '"') AS text FROM t""")
def compact_document(spark, d):
    made = documents.round_columns(_deep(spark, d))
    return made.select("s_suppkey", documents.render_rows(made, "a").alias("text"))


@query(f"WITH {base._LINES}, q AS (SELECT service, row_number() OVER (PARTITION BY service ORDER BY line_no) AS no, target, target AS raw_target, port, error_type, substr(message, 1, 500) AS message FROM la0 WHERE NOT noise AND target IS NOT NULL) SELECT service, no, target, raw_target, port, error_type, message FROM q WHERE no <= 50")
def dependency_errors(spark, d):
    return logs.dependency_errors(logs.parsed(base.lines(spark, d))).drop("scenario_id")


@query("""SELECT service, count(*) FILTER (WHERE NOT noise) AS lines, count(*) FILTER (WHERE noise) AS noise, count(*) FILTER (WHERE NOT noise AND value > 100) AS errors FROM (
  SELECT *, event_id % 7 = 3 AS noise, CASE WHEN event_id % 7 = 3 OR event_id % 3 = 0 THEN 'file' || (user_id % 5) ELSE 'c' || (event_id % 4) END AS service FROM events) GROUP BY 1""")
def log_routing(spark, d):
    """Lines of several containers in one file."""
    e, own = F.col("event_id"), F.concat(F.lit("file"), (F.col("user_id") % 5).cast("string"))
    said = F.when(F.col("value") > 100, "connection refused").otherwise("ok")
    prefix = F.when(e % 3 != 0, F.concat(F.lit("[pod/web-1/c"), (e % 4).cast("string"), F.lit("-9f655fc76-cvsfn] "))).otherwise("")
    line = F.concat(prefix, F.when(e % 7 == 3, F.concat(F.lit("Cloning into repo "), said)).otherwise(said))
    rows = base._read(spark, d, "events").select(F.lit("s").alias("scenario_id"), F.lit("f").alias("path"), e.alias("line_no"), own.alias("service"), line.alias("line"))
    p = logs.parsed(rows)
    return p.groupBy("service").agg(F.count_if(~F.col("noise")).alias("lines"), F.count_if("noise").alias("noise"), F.count_if(~F.col("noise") & (F.col("bucket") == "error")).alias("errors"))


@query("SELECT p AS path, row_number() OVER (PARTITION BY p ORDER BY event_id, k) - 1 AS line_no, CASE WHEN k = 0 THEN 'event ' || event_id || ' ' || event_type ELSE 'more of ' || event_id END AS line FROM (SELECT *, event_id % 2 AS p, unnest(CASE WHEN event_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS k FROM events)")
def log_splits(spark, d):
    """Two log files of all events, read in splits of a few kilobytes; every fifth event is two lines in one row of the file."""
    root, e = shared_folder(spark), F.col("event_id")
    said = F.concat(F.lit("event "), e.cast("string"), F.lit(" "), "event_type", F.when(e % 5 == 0, F.concat(F.lit("\x0bmore of "), e.cast("string"))).otherwise(""))
    t = base._read(spark, d, "events").select((e % 2).alias("p"), e, said.alias("value"))
    for k in (0, 1):
        t.where(f"p = {k}").coalesce(1).sortWithinPartitions("event_id").select("value").write.text(f"{root}/sc/pod_logs/f{k}.log")
    with scenario.settings(spark, spark__sql__files__maxPartitionBytes="16k", spark__sql__files__openCostInBytes="1k"):
        lines = scenario.numbered_lines(spark, root, "*.txt", F.col("path").contains("/pod_logs/")).select(F.regexp_extract("path", r"/f(\d)\.log/", 1).cast("bigint").alias("path"), "line_no", "line")
        return stored(lines)


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS scenario_id, 'web-' || (user_id % 9) AS service, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def metric_exports(spark, d):
    """Metrics of three scenarios: one has them in its folder, one in a folder elsewhere that an output names, one in a file."""
    root, away, t = shared_folder(spark), shared_folder(spark), base._read(spark, d, "events")
    own = t.select("event_id", F.col("ts").cast("string").alias("time"), F.concat(F.lit("n.web-"), (F.col("user_id") % 9).cast("string")).alias("instance"), F.col("event_type").alias("metric"), F.col("value").alias("val"))
    for k, path in enumerate((f"{root}/a/metrics", f"{away}/export b", f"{away}/lone")):
        own.where(F.col("event_id") % 3 == k).drop("event_id").repartition(1 + k % 2).write.option("header", True).csv(path)
    gone = F.concat(F.lit("Exported metrics to directory: "), F.lit(f"{away}/missing"))
    spark.range(1).select(F.explode(F.array(F.lit(f'Exported metrics to directory: "{away}/export b"'), gone)).alias("value")).write.text(f"{root}/b/builtin_api_outputs/metrics/step_1")
    spark.range(1).select(F.lit(f"done; exported to: {away}/lone").alias("value")).write.text(f"{root}/c/builtin_api_outputs/metrics/step_2")
    rows = scenario.metric_samples(spark, root)
    return rows.groupBy("scenario_id", "service").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH f AS (SELECT event_id, user_id % 6 AS p, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) AS no, event_id % 50 = 7 AND user_id % 2 = 0 AS bad, value FROM events),
b AS (SELECT p, coalesce(min(no) FILTER (WHERE bad), 1e9) AS stop FROM f GROUP BY 1)
SELECT p AS path, count(*) AS snapshots, count(*) FILTER (WHERE value > 50) AS violated FROM f JOIN b USING (p) WHERE no < stop GROUP BY 1""")
def state_series(spark, d):
    """Line-wise states that end at the first line that isn't JSON, each judged by itself."""
    root, e = shared_folder(spark), F.col("event_id")
    doc = F.when((e % 50 == 7) & (F.col("user_id") % 2 == 0), "{broken").otherwise(F.format_string('{"metrics":{"web":{"latency_ms":%s}},"logs":{"web":{"log_anomaly_score":0.1}},"traces":{"a->web":{"error_ratio":0.0,"latency_p95_us":1.0}}}', (F.col("value") * 10).cast("string")))
    t = base._read(spark, d, "events").select((F.col("user_id") % 6).alias("p"), e, doc.alias("value"))
    t.repartition("p").sortWithinPartitions("p", "event_id").select("p", "value").write.partitionBy("p").text(f"{root}/s")
    judged = diagnosis.snapshot_sla(scenario.state_lines(spark, root, "*.txt"))
    made = judged.groupBy(F.regexp_extract("path", r"/p=(\d)/", 1).cast("bigint").alias("path")).agg(F.count("*").alias("snapshots"), F.count_if(F.col("service_violations") > 0).alias("violated"))
    return made


@query(f"""WITH {base._KPIS}, i AS (SELECT service, {base._GROUP} AS kpi_group, kpi_name, {base._SIGNAL} AS signal, n FROM kp),
s AS (SELECT service, kpi_group, signal, n, string_agg(kpi_name, '+' ORDER BY kpi_name) AS names FROM i GROUP BY ALL)
SELECT service, kpi_group, string_agg(names || '=' || signal || ':' || n, ',' ORDER BY names) AS items FROM s GROUP BY 1, 2""")
def metric_blocks(spark, d):
    items = metrics.kpi_summary(base.samples(spark, d)).select("service", "kpi_group", "kpi_name", "signal", "n")
    made = grouping.metric_block(items, ["service", "kpi_group"], "kpi_name", "signal", "n")
    told = F.transform("items_grouped", lambda x: F.concat(F.array_join(x["names"], "+"), F.lit("="), x["value"]["signal"], F.lit(":"), x["value"]["n"].cast("string")))
    return made.select("service", "kpi_group", F.array_join(told, ",").alias("items"))


@query("SELECT l_suppkey, string_agg(proto || '/' || name || '=' || ports, ',' ORDER BY proto, name) AS ports FROM (SELECT l_suppkey, proto, name, string_agg(DISTINCT port::VARCHAR, '+' ORDER BY port::VARCHAR) AS ports FROM (SELECT l_suppkey, l_shipmode AS proto, 'p' || (l_partkey % 3) AS name, 100 + l_quantity::BIGINT AS port FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1".replace("l_shipmode", "l_returnflag"))
def system_profiles(spark, d):
    t = base._read(spark, d, "lineitem")
    port = F.struct((F.col("l_quantity").cast("bigint") + 100).alias("port"), F.col("l_returnflag").alias("protocol"), F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("name"))
    rows = t.groupBy("l_suppkey").agg(F.collect_set(port).alias("ports"))
    made = grouping.normalized_profiles(rows, "ports")
    told = F.transform("ports", lambda p: F.concat(p["protocol"], F.lit("/"), p["name"], F.lit("="), F.array_join(F.array_sort(F.transform(p["ports"], lambda x: x.cast("string"))), "+")))
    return made.select("l_suppkey", F.array_join(told, ",").alias("ports"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of the one scenario of the driver's tables, with a key that no reader knows."""
    s, e = base.state(spark, d), base.edges(spark, d)
    one = lambda *cols: spark.range(1).select(F.lit("s").alias("scenario_id"), *cols)
    rca = diagnosis.rca_summary(base.scores(spark, d), s, e, base.faults(spark, d))
    sla = diagnosis.global_sla(diagnosis.service_sla(s), diagnosis.edge_sla(e), s.where("status not in ('healthy', 'unknown')"))
    cases = base.faults(spark, d).select("scenario_id", "service", "fault_family", "no")
    known = cases.groupBy("scenario_id").agg((F.count("*") > 1).alias("is_multifault"), F.sort_array(F.collect_set("service")).alias("expected_faulty_services"), F.array_sort(F.collect_list(F.struct("no", "service", "fault_family"))).alias("fault_instances"), F.lit("detection").alias("task"))
    graph = e.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.concat_ws("->", "src", "dst"))).alias("edges")).join(s.groupBy("scenario_id").agg(F.sort_array(F.collect_list("service")).alias("services")), "scenario_id")
    told = base._read(spark, d, "nation").where("n_regionkey = 2").select(F.lit("s").alias("scenario_id"), F.col("n_nationkey").alias("no"), F.lower("n_name").alias("api"))
    seen = F.struct(F.lit(2).alias("files_parsed"))
    meta = e.groupBy("scenario_id").agg(F.struct(F.count("*").alias("edges_found")).alias("traces")).select("scenario_id", seen.alias("logs"), F.struct(F.lit(3).alias("files_seen")).alias("metrics"), "traces")
    keyed = {
        "metrics": (s.select(*KEY, F.col("metric_signal_present").alias("present"), F.round("threads_last").cast("bigint").alias("threads")), "service"),
        "logs": (s.select(*KEY, "dominant_error_type", "errors", "lines"), "service"),
        "traces": (e.select("scenario_id", F.concat_ws("->", "src", "dst").alias("edge"), "failure_type", "num_errors", "num_requests"), "edge"),
        "system": (s.select(*KEY, "crashloop", "pods_total", "status"), "service"),
        "workload": (traces.workload(e), "service"),
        "service_health": (base.health(spark, d).select(*KEY, "health", "reasons"), "service"),
    }
    single = {
        "fault_context": known,
        "ground_truth": one(F.array(F.lit("svc8")).alias("answer")),
        "fault_timing": one(F.lit(20).alias("wait_seconds")),
        "graph": graph,
        "rca_features": rca.select("scenario_id", "confidence", F.col("dominant_family").alias("dominant_error_family"), "hypotheses", F.col("top_service").alias("most_suspicious_service"), F.col("gaps").alias("observability_gaps")),
        "observability_metadata": meta,
        "sla": sla.select("scenario_id", "violated", F.struct(F.col("unhealthy_services").alias("num_unhealthy_services"), "reasons").alias("global_sla")),
    }
    listed = {"services": s.select(*KEY), "history": told}
    constants = {"timestamp": F.lit("2026-05-01T00:00:00Z"), "run_dir": F.lit("/runs/s"), "state_type": F.lit("full"), "x_custom": F.lit(7)}
    return documents.state(s.select("scenario_id"), keyed, listed, single, constants)


_OBJ = lambda table, key, fields: f"(SELECT '{{' || string_agg('\"' || {key} || '\":{{' || {' || chr(44) || '.join(fields)} || '}}', ',' ORDER BY {key}) || '}}' FROM {table})"
_TEXT = lambda name, c: f"'\"{name}\":\"' || {c} || '\"'"
_NUM = lambda name, c: f"'\"{name}\":' || ({c})::VARCHAR"
_NAMES = lambda c, table, order: f"(SELECT '[' || string_agg('\"' || {c} || '\"', ',' ORDER BY {order}) || ']' FROM {table})"
_VIOLATED = "(SELECT count(*) FROM ed WHERE error_ratio > 0.2 OR latency_p95_us / 1000 > 800)"
_SICK = "(SELECT count(*) FROM st WHERE status NOT IN ('healthy', 'unknown'))"
_HYPOTHESES = f"""(SELECT '[' || string_agg('{{"fault_family":"' || fault_family || '","fault_type":"' || {base._FAULT} || '","service":"' || service || '","source":"generated_fault_context","variant_name":"' || variant || '","variant_params":"' || CASE variant WHEN 'wide' THEN '{{\\"n\\":\\"3\\"}}' ELSE '{{}}' END || '"}}', ',' ORDER BY no) || ']' FROM fi)"""
_ENTRIES = f"""{base._HEALTH}, wl AS (SELECT service, sum(i) AS incoming, sum(o) AS outgoing FROM (SELECT dst AS service, num_requests AS i, 0 AS o FROM ed UNION ALL SELECT src, 0, num_requests FROM ed) GROUP BY 1), kv(key, value) AS (SELECT unnest([
  {{'key': 'scenario_id', 'value': '"s"'}}, {{'key': 'timestamp', 'value': '"2026-05-01T00:00:00Z"'}}, {{'key': 'run_dir', 'value': '"/runs/s"'}}, {{'key': 'state_type', 'value': '"full"'}}, {{'key': 'x_custom', 'value': '7'}}, {{'key': 'ground_truth', 'value': '{{"answer":["svc8"]}}'}}, {{'key': 'fault_timing', 'value': '{{"wait_seconds":20}}'}},
  {{'key': 'metrics', 'value': {_OBJ("st", "service", [_NUM("present", "metric_signal_present"), _NUM("threads", "round(threads_last)::BIGINT")])}}},
  {{'key': 'logs', 'value': {_OBJ("st", "service", [_TEXT("dominant_error_type", "dominant_error_type"), _NUM("errors", "errors"), _NUM("lines", "lines")])}}},
  {{'key': 'traces', 'value': {_OBJ("ed", "(src || '->' || dst)", [_TEXT("failure_type", "failure_type"), _NUM("num_errors", "num_errors"), _NUM("num_requests", "num_requests")])}}},
  {{'key': 'system', 'value': {_OBJ("st", "service", [_NUM("crashloop", "crashloop"), _NUM("pods_total", "pods_total"), _TEXT("status", "status")])}}},
  {{'key': 'workload', 'value': {_OBJ("wl", "service", [_NUM("incoming", "incoming"), _NUM("outgoing", "outgoing"), _NUM("total", "incoming + outgoing")])}}},
  {{'key': 'service_health', 'value': {_OBJ("he", "service", [_TEXT("health", "health"), "'\"reasons\":' || CASE reasons WHEN '' THEN '[]' ELSE '[\"' || replace(reasons, ',', '\",\"') || '\"]' END"])}}},
  {{'key': 'services', 'value': {_NAMES("service", "st", "service")}}},
  {{'key': 'graph', 'value': '{{"edges":' || {_NAMES("src || '->' || dst", "ed", "src || '->' || dst")} || ',"services":' || {_NAMES("service", "st", "service")} || '}}'}},
  {{'key': 'history', 'value': (SELECT '[' || string_agg('{{"api":"' || lower(n_name) || '","no":' || n_nationkey || '}}', ',' ORDER BY n_nationkey) || ']' FROM nation WHERE n_regionkey = 2)}},
  {{'key': 'fault_context', 'value': '{{"expected_faulty_services":' || {_NAMES("service", "fi", "service")} || ',"fault_instances":' || (SELECT '[' || string_agg('{{"fault_family":"' || fault_family || '","no":' || no || ',"service":"' || service || '"}}', ',' ORDER BY no) || ']' FROM fi) || ',"is_multifault":true,"task":"detection"}}'}},
  {{'key': 'rca_features', 'value': '{{"confidence":0.85,"dominant_error_family":"multifault","hypotheses":' || {_HYPOTHESES} || ',"most_suspicious_service":"' || (SELECT service FROM rk WHERE rank = 1) || '","observability_gaps":[]}}'}},
  {{'key': 'observability_metadata', 'value': '{{"logs":{{"files_parsed":2}},"metrics":{{"files_seen":3}},"traces":{{"edges_found":' || (SELECT count(*) FROM ed) || '}}}}'}},
  {{'key': 'sla', 'value': '{{"global_sla":{{"num_unhealthy_services":' || {_SICK} || ',"reasons":[' || concat_ws(',', CASE WHEN {_VIOLATED} > 0 THEN '"dependency_failures_present"' END, CASE WHEN {_SICK} > 0 THEN '"unhealthy_services_present"' END, CASE WHEN {_SICK} > 1 THEN '"multiple_unhealthy_services"' END) || ']}},"violated":' || ({_VIOLATED} > 0 OR {_SICK} > 0) || '}}'}}
], recursive := true))"""
_LISTED = lambda d: d.select("scenario_id", F.explode("m").alias("key", "v")).select("scenario_id", "key", F.to_json("v").alias("value"))


@query(f"WITH {_ENTRIES} SELECT 's' AS scenario_id, key, value FROM kv")
def state_document(spark, d):
    """Every key of the state with its whole value."""
    return _LISTED(_documents(spark, d).select("scenario_id", documents.entries(F.col("document")).alias("m")))


@query(f"WITH {_ENTRIES} SELECT 's' AS scenario_id, key, CASE key WHEN 'system' THEN '{{\"cut\":true}}' ELSE value END AS value FROM kv WHERE key NOT IN ('timestamp', 'run_dir', 'state_type', 'x_custom', 'ground_truth', 'fault_timing', 'history', 'fault_context', 'rca_features')")
def redacted_view(spark, d):
    """What a reader without labels gets of a state in which one part was replaced."""
    doc = documents.replaced(F.col("document"), system=F.parse_json(F.lit('{"cut": true}')))
    return _LISTED(_documents(spark, d).select("scenario_id", documents.entries(documents.redacted(doc)).alias("m")))


@query(f"""WITH {_ENTRIES} SELECT 's' AS scenario_id, 1 AS num_snapshots, (SELECT string_agg(service, ',' ORDER BY service) FROM st) AS services, (SELECT count(*) FROM st) AS num_services, 'detection' AS task, (SELECT string_agg(service, ',' ORDER BY service) FROM fi) AS expected, TRUE AS is_multifault, (SELECT count(*) FROM fi) AS num_fault_instances, '["svc8"]' AS ground_truth_answer,
  'metrics,logs,traces,system,workload,graph,history' AS categories, (SELECT service FROM rk WHERE rank = 1) AS most_suspicious_service, {_HYPOTHESES} AS rca_hypotheses, 0.85::DOUBLE AS rca_confidence, 'multifault' AS dominant_error_family, '' AS gaps, {_VIOLATED} > 0 OR {_SICK} > 0 AS sla_violated, {_SICK} AS num_unhealthy_services, 2 AS log_files_parsed, 3 AS metric_files_parsed, (SELECT count(*) FROM ed) AS trace_edges_found""")
def state_summary(spark, d):
    made, text = documents.summary(_documents(spark, d)), lambda c: F.array_join(c, ",")
    return made.select("scenario_id", "num_snapshots", text("services").alias("services"), "num_services", "task", text("expected_faulty_services").alias("expected"), "is_multifault", "num_fault_instances", "ground_truth_answer", text("categories_present").alias("categories"), "most_suspicious_service", "rca_hypotheses", "rca_confidence", "dominant_error_family", text("observability_gaps").alias("gaps"), "sla_violated", "num_unhealthy_services", "log_files_parsed", "metric_files_parsed", "trace_edges_found")


@query(f"""WITH {base._PODS}, r AS (SELECT n_name AS scenario_id, n_nationkey AS k, 'svc' || n_nationkey AS svc, CASE WHEN n_regionkey = 0 THEN 'auth_failure' ELSE 'infra_failure' END AS kind, n_regionkey AS it FROM nation),
p AS (SELECT service, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey::VARCHAR)[1:3], '+') AS names FROM pd GROUP BY 1),
q AS (SELECT scenario_id, string_agg(service || '/' || coalesce(names, '') || '/' || coalesce(status, 'unknown') || '/' || coalesce(restarts, 0) || '/' || coalesce(crashloop, 0), ',' ORDER BY service) AS pods FROM (SELECT scenario_id, svc AS service FROM r UNION SELECT scenario_id, 'gone' FROM r) LEFT JOIN ps USING (service) LEFT JOIN p USING (service) GROUP BY 1)
SELECT scenario_id, 'ns' || it AS namespace, it AS iteration, 7 AS max_iterations, svc || '|' || kind || '|why|gone' AS fault, pods, CASE WHEN it = 0 THEN 8 ELSE 7 END AS actions, 'kubectl rollout restart deployment/' || svc || ' -n ns' || it AS first_action, CASE WHEN it = 0 THEN '' ELSE array_to_string(list_transform(range(it), lambda i: i || ':a' || k || ':failed'), ',') END AS tried, {reports._text(agents.OPTIMIZER_TASK)} AS task FROM r JOIN q USING (scenario_id)""")
def optimizer_input(spark, d):
    n, k, it = base._read(spark, d, "nation"), F.col("n_nationkey").cast("string"), F.col("n_regionkey")
    sid = F.col("n_name").alias("scenario_id")
    results = n.select(sid, F.concat(F.lit("svc"), k).alias("root_cause_service"), F.when(it == 0, "auth_failure").otherwise("infra_failure").alias("fault_type"), F.lit("why").alias("explanation"), F.array(F.lit("gone")).alias("affected_services"), F.concat(F.lit("ns"), it.cast("string")).alias("namespace"), it.alias("iteration"))
    own = system.pod_rollup(base.pods(spark, d)).drop("scenario_id").withColumns({"pod_names": F.slice("pod_names", 1, 3), "deployment": F.lit(None).cast("string")})
    pods = results.select("scenario_id", F.col("root_cause_service").alias("service")).join(own, "service")
    tried = n.where(it > 0).select(sid, F.explode(F.sequence(F.lit(0), it - 1)).alias("iteration"), F.array(F.concat(F.lit("a"), k)).alias("commands"), F.lit("failed").alias("result"), F.lit(0.0).alias("reward"), F.lit("why").alias("failure_reason"))
    made = agents.optimizer_input(results, pods, tried)
    told = F.transform("pod_details", lambda x: F.concat_ws("/", x["service"], F.array_join(x["pods"], "+"), x["health_status"], x["restart_count"].cast("string"), x["crashloop_count"].cast("string")))
    attempts = F.transform(F.coalesce("previous_attempts", F.array().cast(made.schema["previous_attempts"].dataType)), lambda a: F.concat_ws(":", a["iteration"].cast("string"), F.array_join(a["commands"], "+"), a["result"]))
    about = F.concat_ws("|", "fault_summary.faulty_service", "fault_summary.fault_type", "fault_summary.explanation", F.array_join("fault_summary.affected_services", "+"))
    return made.select("scenario_id", "namespace", "iteration", "max_iterations", about.alias("fault"), F.array_join(told, ",").alias("pods"), F.size("action_library").alias("actions"), F.col("action_library")[0]["command"].alias("first_action"), F.array_join(attempts, ",").alias("tried"), F.col("task_instruction").alias("task"))
