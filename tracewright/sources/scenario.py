"""Readers for scenario folders: any number of them at a time, one row source for each kind of file.

All readers take the root of the scenario folders; the first folder below the root is the scenario id. Files
may be absent: a reader without a file gives no rows. Reading is Spark's own, so the root may lie in any
store that Spark reads.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.logs import LINE_ENDS
from tracewright.functions.names import OUTPUT_HINTS, file_service, hinted_service, line_hints, log_service, metric_service, service_of_output, shared_service
from tracewright.sources.text_lines import first_lines, numbered_lines, settings  # noqa: F401  (settings for callers)

# fixed values: column aliases of the two CSV kinds
METRIC_COLUMNS = {"ts_raw": ["timestamp", "time", "ts"], "cmdb_id": ["cmdb_id", "pod", "pod_name", "instance", "container"], "kpi_name": ["kpi_name", "metric", "metric_name", "__name__"], "value": ["value", "val"]}
TRACE_COLUMNS = {"trace_id": ["trace_id", "traceid", "traceID"], "span_id": ["span_id", "spanid", "spanID"], "parent_span": ["parent_span", "parent_span_id", "parent_id"], "service": ["service_name", "service"], "operation": ["operation_name", "operation"], "duration": ["duration", "duration_us"], "response": ["response", "status_code", "status"], "has_error": ["has_error", "error"]}


EXPORTS = {"metric": (r"/builtin_api_outputs/metrics/", r"(?i)exported\s+(?:metrics\s+)?(?:to\s+directory|to):\s*(.+)$"), "trace": (r"/builtin_api_outputs/traces/", r"(?i)exported\s+(?:traces\s+)?(?:to\s+file|to):\s*(.+)$")}
STEP_FILE = r"/step_[^/]*get_logs[^/]*$|get_logs[^/]*\.txt$"
LOG_FILE = r"/pod_logs/[^/]*\.(log|stderr)$|/logs/step_[^/]*_get_logs\.txt$|get_logs[^/]*\.txt$"


def decoded(path: Column) -> Column:
    """A path as Spark reports it, encoded, in the form in which it can be read."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


SCHEME, SLASHES = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/+", "/+"


def plain_path(path: Column) -> Column:
    """A path as Spark reports it, decoded, without its scheme."""
    return F.regexp_replace(F.regexp_replace(decoded(path), SCHEME, "/"), SLASHES, "/")


def _plain(path: str) -> str:
    return re.sub(SLASHES, "/", re.sub(SCHEME, "/", unquote(path)))


def scenario_of(path: Column, root: str) -> Column:
    """The first folder behind the root. Paths come back with a scheme and encoded, a root may be given without."""
    own = re.sub(SLASHES, "/", re.sub(SCHEME, "/", root.rstrip("/") + "/"))
    behind = F.transform(F.array(plain_path(path)), lambda p: F.when(F.startswith(p, F.lit(own)), F.substr(p, F.lit(len(own) + 1))).otherwise(F.regexp_extract(p, "([^/]+/[^/]+)$", 1)))
    return F.regexp_extract(F.get(behind, F.lit(0)), "^([^/]+)/", 1)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(scenario_id, path, kind) of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    p = F.col("path")
    kind = F.when(p.rlike(LOG_FILE), "log").when(p.rlike(r"/kpi_[^/]*\.csv$|/metrics/.*\.csv$"), "metric").when(p.rlike(r"(?i)/traces/.*\.csv$|/[^/]*(trace|span|jaeger)[^/]*\.csv$"), "trace").when(p.rlike(r"/direct_k8s_outputs/[^/]*\.json$"), "k8s_json").when(p.rlike(r"/direct_k8s_outputs/[^/]*\.txt$"), "k8s_text").when(p.rlike(r"/topology/[^/]*\.json$"), "topology").when(p.endswith("/DONE.json"), "done").when(p.endswith("/spec.json"), "spec")
    return files.select(scenario_of(p, root).alias("scenario_id"), "path", kind.otherwise("other").alias("kind"))


def whole_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(scenario_id, path, content) of files whose name matches; undecodable bytes become replacement marks."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(scenario_of(path, root).alias("scenario_id"), path.alias("path"), F.col("value").alias("content"))


def finished(spark: SparkSession, root: str) -> DataFrame:
    return inventory(spark, root).where("kind = 'done'").select("scenario_id").distinct()


def _header_names(header: str) -> list[str]:
    """Names of a header line without quotes, blanks and byte order mark."""
    return [c.strip().strip('"') for c in header.removeprefix("\ufeff").split(",")]


def _kind_of_csv(path: str, header: str) -> str | None:
    """metric, trace or None: by the file's name, else by the columns that its header has."""
    name, own = path.rpartition("/")[2].lower(), {c.lower() for c in _header_names(header)}
    has = lambda *sets: all(own & {n.lower() for n in s} for s in sets)
    if re.search(r"^kpi_.*\.csv$", name) or has(METRIC_COLUMNS["cmdb_id"], METRIC_COLUMNS["kpi_name"], METRIC_COLUMNS["value"]):
        return "metric"
    if re.search("trace|span|jaeger", name) or has(TRACE_COLUMNS["trace_id"], TRACE_COLUMNS["span_id"], ["service_name", "service", "process.servicename"]):
        return "trace"
    return None


def csv_rows(spark: SparkSession, root: str, kind: str, columns: dict[str, list[str]]) -> DataFrame:
    """(scenario_id, path, row_no, one string for each canonical column) of the CSV files of a kind: those below the
    root, and those that outputs of a collector name as their export, wherever these lie.

    Header columns may stand in any order. Files of one header are read together by Spark's CSV reader, so quoted
    fields may hold commas, doubled quotes and line ends; an alias counts only where it isn't blank, exact names before
    names in another case. Row numbers grow in read order. An export named by several scenarios belongs to each.
    """
    own = first_lines(spark, root, "*.csv")
    away = exported_files(spark, root, kind, {_plain(p) for p, _ in own})
    groups: dict[str, list[str]] = {}
    for path, header in [*own, *[(p, h) for p, h, _ in away]]:
        if _kind_of_csv(path, header) == kind:
            groups.setdefault(header, []).append(unquote(path))
    owners = spark.createDataFrame(sorted({(_plain(p), s) for p, _, ids in away for s in ids}), "plain string, owner string")
    out = None
    for header, paths in groups.items():
        names = _header_names(header)
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(sorted(set(paths)))

        def pick(aliases: list[str], names: list[str] = names) -> Column:
            exact = [k for a in aliases for k, n in enumerate(names) if n == a]
            loose = [k for a in aliases for k, n in enumerate(names) if n.lower() == a.lower() and k not in exact]
            return F.coalesce(*[F.nullif(F.trim(f"c{k}"), F.lit("")) for k in exact + loose], F.lit(None).cast("string"))

        path = F.col("_metadata.file_path")
        made = rows.select(path.alias("path"), F.monotonically_increasing_id().alias("row_no"), *[pick(a).alias(c) for c, a in columns.items()])
        out = made if out is None else out.unionByName(made)
    if out is None:
        return spark.createDataFrame([], ", ".join(["scenario_id string", "path string", "row_no bigint", *[f"{c} string" for c in columns]]))
    named = lambda d, owner: d.select(owner.alias("scenario_id"), "path", "row_no", *columns)
    if not away:
        return named(out, scenario_of(F.col("path"), root))
    outside = out.join(owners, plain_path(F.col("path")) == F.col("plain"))
    inside = out.where(F.startswith(plain_path(F.col("path")), F.lit(_plain(root.rstrip("/") + "/"))))
    return named(inside, scenario_of(F.col("path"), root)).unionByName(named(outside, F.col("owner")))


def exported_files(spark: SparkSession, root: str, kind: str, known: set[str]) -> list[tuple[str, str, list[str]]]:
    """(path, first line, scenarios) of the CSV files at the places that outputs name, without the ``known`` ones. A place is a
    file or a folder; one that doesn't exist gives nothing. There are a few places a scenario."""
    told: dict[str, list[str]] = {}
    for r in exported_paths(spark, root).where(F.col("kind") == kind).collect():
        told.setdefault(r["target"], []).append(r["scenario_id"])
    found = []
    for target, owners in told.items():
        try:
            lines = first_lines(spark, target)
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found += [(p, h, owners) for p, h in lines if p.lower().endswith(".csv") and _plain(p) not in known]
    return found


def exported_paths(spark: SparkSession, root: str) -> DataFrame:
    """(scenario_id, kind, target): places that outputs of a collector name as those of an export."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    out = None
    for kind, (place, said) in EXPORTS.items():
        target = F.regexp_replace(F.trim(F.regexp_extract("value", said, 1)), "^[\"']+|[\"']+$", "")
        made = files.where(F.col("path").rlike(place) & F.col("value").rlike(said)).select(scenario_of(F.col("path"), root).alias("scenario_id"), F.lit(kind).alias("kind"), target.alias("target"))
        out = made if out is None else out.union(made)
    return out.distinct()


def metric_samples(spark: SparkSession, root: str) -> DataFrame:
    """Rows without entity, KPI or value are dropped; unreadable values count as 0. Row numbers grow in read order."""
    rows = csv_rows(spark, root, "metric", METRIC_COLUMNS).where("cmdb_id is not null and kpi_name is not null and value is not null")
    return rows.select("scenario_id", "path", "row_no", "ts_raw", F.try_to_timestamp("ts_raw").alias("ts"), metric_service(F.col("cmdb_id")).alias("service"), "cmdb_id", "kpi_name", rules.kpi_group(F.col("kpi_name")).alias("kpi_group"), rules.safe_double(F.col("value")).alias("value"))


def spans(spark: SparkSession, root: str) -> DataFrame:
    rows = csv_rows(spark, root, "trace", TRACE_COLUMNS).where("trace_id is not null and span_id is not null")
    return rows.select("scenario_id", "path", "row_no", "trace_id", "span_id", "parent_span", F.coalesce("service", F.lit("unknown")).alias("service"), F.coalesce("operation", F.lit("")).alias("operation"), rules.safe_double(F.col("duration")).alias("duration_us"), "response", rules.is_error_span(F.col("has_error"), F.col("response")).alias("is_error"))


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """(scenario_id, path, line_no, service, line) of all log files: pod logs, error streams and the outputs of log
    queries, read in splits, see ``numbered_lines``. The service is the file's own, for a query's output the one that the first of
    its lines with a hint tells; a pod prefix may override it later."""
    lines = numbered_lines(spark, root, "*.{log,stderr,txt}", F.col("path").rlike(LOG_FILE))
    step = F.col("path").rlike(STEP_FILE)
    told = lines.where(step).select(F.col("path").alias("of_path"), "line_no", F.explode(F.array(line_hints(F.col("line")))).alias("h"))
    first = lambda name: F.min_by(f"h.{name}", F.when(F.col(f"h.{name}").isNotNull(), F.col("line_no"))).alias(name)
    hints = told.groupBy("of_path").agg(*[first(n) for n in (*OUTPUT_HINTS, "host")])  # a row for each output
    hints = hints.select("of_path", hinted_service(F.struct(*OUTPUT_HINTS, "host"), F.col("of_path")).alias("service"))
    outputs = lines.where(step).join(hints, F.col("path") == F.col("of_path")).drop("of_path")
    own = lines.where(~step).withColumn("service", file_service(F.col("path")))
    return outputs.unionByName(own).select(scenario_of(F.col("path"), root).alias("scenario_id"), "path", "line_no", "service", "line")


def log_lines_of(files: DataFrame) -> DataFrame:
    """Lines of (scenario_id, path, content) log files."""
    step = F.col("path").rlike(STEP_FILE)
    service = F.when(step, service_of_output(F.col("content"), F.col("path"))).otherwise(file_service(F.col("path")))
    lines = files.select("scenario_id", "path", service.alias("service"), F.split("content", LINE_ENDS).alias("_l"))
    lines = lines.withColumn("_l", F.when(F.element_at("_l", -1) == "", F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0)))).otherwise(F.col("_l")))
    return lines.select("scenario_id", "path", "service", F.posexplode("_l").alias("line_no", "line"))


def json_lines(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """(scenario_id, path, row) of line-wise JSON, each row as text; a line that isn't JSON is left out, those behind it
    are read."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    path = F.col("_metadata.file_path")
    return rows.where(F.try_parse_json("value").isNotNull()).select(scenario_of(path, root).alias("scenario_id"), path.alias("path"), F.col("value").alias("row"))


def state_lines(spark: SparkSession, root: str, glob: str = "states*.jsonl") -> DataFrame:
    """(scenario_id, path, line_no, row) of a series of states, one JSON text a line: of each file the lines before the first that is
    neither blank nor JSON. Blank lines give no row."""
    lines = numbered_lines(spark, root, glob, F.lit(True)).where("trim(line) <> ''")
    broken = lines.where(F.try_parse_json("line").isNull()).groupBy(F.col("path").alias("of_path")).agg(F.min("line_no").alias("stop"))  # a row a file
    kept = lines.join(broken, F.col("path") == F.col("of_path"), "left").where("stop is null or line_no < stop")
    return kept.select(scenario_of(F.col("path"), root).alias("scenario_id"), "path", "line_no", F.col("line").alias("row"))


def documents(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(scenario_id, name, document) of JSON files passed on as they are, such as ground truth and fault timing."""
    files = whole_files(spark, root, "{" + ",".join(names or ("ground_truth.json", "fault_timing.json", "api_action_plan.json")) + "}")
    return files.where(F.try_parse_json("content").isNotNull()).select("scenario_id", F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), F.col("content").alias("document"))


def k8s_items(files: DataFrame, item: str) -> DataFrame:
    """(scenario_id, path, no, item) of list dumps in (scenario_id, path, content): an object with ``items`` or a bare list. ``item`` is
    the DDL of one entry; text that isn't JSON gives no rows."""
    both = F.coalesce(F.from_json("content", f"struct<items:array<{item}>>")["items"], F.from_json("content", f"array<{item}>"))
    return files.select("scenario_id", "path", F.posexplode(both).alias("no", "item"))


CONTAINER_STATE = "struct<waiting:struct<reason:string,message:string>,terminated:struct<reason:string,exitCode:bigint,message:string>,running:struct<startedAt:string>>"
POD = f"struct<metadata:struct<name:string,namespace:string,labels:map<string,string>,ownerReferences:array<struct<kind:string,name:string>>>,spec:struct<hostname:string,nodeName:string,containers:array<struct<name:string,image:string,command:array<string>,ports:array<struct<containerPort:bigint,protocol:string,name:string>>>>>,status:struct<phase:string,podIP:string,hostIP:string,qosClass:string,startTime:string,conditions:array<struct<type:string,status:string>>,containerStatuses:array<struct<name:string,restartCount:bigint,state:{CONTAINER_STATE}>>>>"
CONTAINER = "struct<name:string,image:string,command:array<string>,args:array<string>,ports:string,resources:string,volumeMounts:string>"
DEPLOYMENT = f"struct<metadata:struct<name:string,namespace:string,generation:bigint,labels:map<string,string>>,spec:struct<replicas:bigint,selector:string,strategy:string,template:struct<spec:struct<containers:array<{CONTAINER}>,volumes:string>>>,status:struct<replicas:bigint,readyReplicas:bigint,availableReplicas:bigint,unavailableReplicas:bigint,updatedReplicas:bigint,observedGeneration:bigint,conditions:array<struct<type:string,status:string,reason:string,message:string>>>>"
REPLICA_SET = "struct<metadata:struct<name:string,namespace:string,labels:map<string,string>,ownerReferences:string>,spec:struct<replicas:bigint,selector:string>,status:struct<replicas:bigint,readyReplicas:bigint,availableReplicas:bigint,fullyLabeledReplicas:bigint>>"
ADDRESS = "array<struct<ip:string,nodeName:string,targetRef:struct<kind:string,name:string>>>"
ENDPOINTS = f"struct<metadata:struct<name:string,namespace:string>,subsets:array<struct<addresses:{ADDRESS},notReadyAddresses:{ADDRESS},ports:array<struct<name:string,port:bigint,protocol:string>>>>>"
SERVICE = "struct<metadata:struct<name:string,namespace:string>,spec:struct<type:string,clusterIP:string,clusterIPs:array<string>,selector:map<string,string>,sessionAffinity:string,internalTrafficPolicy:string,ports:array<struct<name:string,port:bigint,targetPort:string,protocol:string>>>>"


def pods(spark: SparkSession, root: str) -> DataFrame:
    return pods_of(whole_files(spark, root, "pods.json"))


def pods_of(files: DataFrame) -> DataFrame:
    """One row a pod, as operators.system takes it. The service is a label, else the host name. A pod is ready
    while it runs, is ready itself and has ready containers; each container's state counts."""
    rows = k8s_items(files, POD)
    i, label = F.col("item"), lambda k: F.nullif(F.try_element_at(F.col("item.metadata.labels"), F.lit(k)), F.lit(""))
    conditions, states = F.coalesce("item.status.conditions", F.array()), F.coalesce("item.status.containerStatuses", F.array())
    true = lambda kind: F.exists(conditions, lambda c: (c["type"] == kind) & (F.lower(c["status"]) == "true"))
    held = lambda kind: F.filter(states, lambda s: s["state"][kind].isNotNull())
    reasons = lambda kind: F.transform(held(kind), lambda s: F.coalesce(F.nullif(s["state"][kind]["reason"], F.lit("")), F.lit("unknown")))
    containers = F.coalesce("item.spec.containers", F.array())
    of = lambda field: F.transform(containers, lambda c: F.nullif(c[field], F.lit("")))
    owners = F.coalesce("item.metadata.ownerReferences", F.array())
    phase = F.coalesce(i["status"]["phase"], F.lit("Unknown"))
    return rows.select(
        "scenario_id",
        shared_service(F.coalesce(label("service"), label("app"), F.nullif(i["spec"]["hostname"], F.lit("")), i["metadata"]["name"])).alias("service"),
        F.coalesce(i["metadata"]["name"], F.lit("unknown")).alias("pod"),
        i["metadata"]["namespace"].alias("namespace"),
        i["spec"]["nodeName"].alias("node"),
        phase.alias("phase"),
        ((phase == "Running") & true("Ready") & true("ContainersReady")).alias("ready"),
        F.aggregate(F.transform(states, lambda s: F.coalesce(s["restartCount"], F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("restarts"),
        reasons("waiting").alias("waiting_reasons"),
        reasons("terminated").alias("terminated_reasons"),
        F.transform(held("running"), lambda s: F.struct(s["name"].alias("container"), s["state"]["running"]["startedAt"].alias("started_at"))).alias("running"),
        F.transform(conditions, lambda c: F.concat_ws("=", c["type"], c["status"])).alias("conditions"),
        i["status"]["qosClass"].alias("qos_class"),
        i["status"]["podIP"].alias("pod_ip"),
        i["status"]["hostIP"].alias("host_ip"),
        i["status"]["startTime"].alias("start_time"),
        F.transform(owners, lambda o: o["kind"]).alias("owner_kinds"),
        F.transform(owners, lambda o: o["name"]).alias("owner_names"),
        of("name").alias("containers"),
        of("image").alias("images"),
        F.flatten(F.transform(containers, lambda c: F.coalesce(c["command"], F.array().cast("array<string>")))).alias("commands"),
        F.flatten(F.transform(containers, lambda c: F.transform(F.coalesce(c["ports"], F.array()), lambda p: F.struct(p["containerPort"].alias("container_port"), p["protocol"].alias("protocol"), p["name"].alias("name"))))).alias("ports"),
    )


def _last(rows: DataFrame) -> DataFrame:
    """Of the entries of one service the last stays."""
    return rows.groupBy("scenario_id", "service").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("scenario_id", "service", "path", "no")]), F.struct("path", "no")).alias("r")).select("scenario_id", "service", "r.*")


def endpoints(spark: SparkSession, root: str) -> DataFrame:
    return endpoints_of(whole_files(spark, root, "endpoints.json"))


def endpoints_of(files: DataFrame) -> DataFrame:
    """One row a service: the addresses that are ready and those that aren't, with pod and node, the ports, and counts."""
    rows = k8s_items(files, ENDPOINTS)
    subsets = F.coalesce("item.subsets", F.array())
    every = lambda name: F.flatten(F.transform(subsets, lambda s: F.transform(F.coalesce(s[name], F.array()), lambda a: F.struct(a["ip"].alias("ip"), a["nodeName"].alias("node"), a["targetRef"]["name"].alias("pod"), a["targetRef"]["kind"].alias("kind")))))
    ports = F.flatten(F.transform(subsets, lambda s: F.coalesce(s["ports"], F.array())))
    made = rows.select("scenario_id", "path", "no", shared_service(F.col("item.metadata.name")).alias("service"), F.col("item.metadata.namespace").alias("namespace"), every("addresses").alias("addresses"), every("notReadyAddresses").alias("not_ready_addresses"), ports.alias("ports"))
    return _last(made.withColumns({"ready_endpoints": F.size("addresses"), "not_ready_endpoints": F.size("not_ready_addresses")}))


def _labelled(item: Column) -> Column:
    """The service an object belongs to: a label, else its name."""
    label = lambda k: F.nullif(F.try_element_at(item["metadata"]["labels"], F.lit(k)), F.lit(""))
    return shared_service(F.coalesce(label("service"), label("app"), item["metadata"]["name"]))


def deployments(spark: SparkSession, root: str) -> DataFrame:
    return deployments_of(whole_files(spark, root, "deployments.json"))


def deployments_of(files: DataFrame) -> DataFrame:
    """One row a service: replica counts, conditions by type, containers; selector, strategy and volumes stay JSON text."""
    i = F.col("item")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    status, spec = i["status"], i["spec"]
    entries = F.coalesce(status["conditions"], F.array())
    # of conditions of one type the last counts
    kinds = F.array_distinct(F.transform(entries, lambda c: c["type"]))
    conditions = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda c: c["type"] == k), -1))))
    made = k8s_items(files, DEPLOYMENT).select(
        "scenario_id", "path", "no", _labelled(i).alias("service"), i["metadata"]["name"].alias("deployment"), i["metadata"]["namespace"].alias("namespace"), count(spec["replicas"]).alias("replicas"), count(status["replicas"]).alias("current_replicas"), count(status["readyReplicas"]).alias("ready_replicas"), count(status["availableReplicas"]).alias("available_replicas"), count(status["unavailableReplicas"]).alias("unavailable_replicas"), count(status["updatedReplicas"]).alias("updated_replicas"),
        i["metadata"]["generation"].alias("generation"), status["observedGeneration"].alias("observed_generation"), spec["selector"].alias("selector"), spec["strategy"].alias("strategy"), conditions.alias("conditions"), F.coalesce(spec["template"]["spec"]["containers"], F.array()).alias("containers"), spec["template"]["spec"]["volumes"].alias("volumes"),
    )
    return _last(made)


def replica_sets(spark: SparkSession, root: str) -> DataFrame:
    return replica_sets_of(whole_files(spark, root, "replicasets.json"))


def replica_sets_of(files: DataFrame) -> DataFrame:
    """One row a service with all its replica sets in order."""
    i = F.col("item")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    rows = k8s_items(files, REPLICA_SET).select("scenario_id", _labelled(i).alias("service"), F.struct("path", "no", i["metadata"]["name"].alias("name"), count(i["spec"]["replicas"]).alias("replicas"), count(i["status"]["replicas"]).alias("current_replicas"), count(i["status"]["readyReplicas"]).alias("ready_replicas"), count(i["status"]["availableReplicas"]).alias("available_replicas"), count(i["status"]["fullyLabeledReplicas"]).alias("labelled_replicas"), i["metadata"]["ownerReferences"].alias("owners"), i["spec"]["selector"].alias("selector")).alias("r"))
    return rows.groupBy("scenario_id", "service").agg(F.array_sort(F.collect_list("r")).alias("replica_sets"))


def services(spark: SparkSession, root: str) -> DataFrame:
    return services_of(whole_files(spark, root, "services.json"))


def services_of(files: DataFrame) -> DataFrame:
    spec = F.col("item.spec")
    return _last(k8s_items(files, SERVICE).select("scenario_id", "path", "no", F.col("item.metadata.name").alias("service"), F.col("item.metadata.namespace").alias("namespace"), spec["type"].alias("type"), spec["clusterIP"].alias("cluster_ip"), spec["clusterIPs"].alias("cluster_ips"), F.to_json(spec["selector"]).alias("selector"), spec["ports"].alias("ports"), spec["sessionAffinity"].alias("session_affinity"), spec["internalTrafficPolicy"].alias("internal_traffic_policy")))


def text_table(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(scenario_id, path, row_no, header, parts) of white-space tables; the header is the first line."""
    files = whole_files(spark, root, glob).withColumn("_l", F.split(F.trim("content"), r"\r?\n"))
    rows = files.select("scenario_id", "path", F.split(F.trim(F.get("_l", F.lit(0))), r"\s+").alias("header"), F.posexplode("_l").alias("row_no", "line"))
    return rows.where("row_no > 0 and trim(line) <> ''").select("scenario_id", "path", "row_no", "header", F.split(F.trim("line"), r"\s+").alias("parts"))


def top_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of ``top`` outputs as maps; rows shorter than the header are skipped."""
    return text_table(spark, root, "top_*.txt").where("size(parts) >= size(header)").select("scenario_id", "path", "row_no", F.map_from_arrays("header", F.slice("parts", F.lit(1), F.size("header"))).alias("row"))


def pods_wide(spark: SparkSession, root: str) -> DataFrame:
    """Positional; a restart column with an age in brackets is one column here."""
    files = whole_files(spark, root, "pods_wide.txt").withColumn("content", F.regexp_replace("content", r"(\d+) \([^)]*\)", "$1"))
    rows = files.select("scenario_id", "path", F.posexplode(F.split("content", r"\r?\n")).alias("no", "line")).where("no > 0 and trim(line) <> ''").withColumn("p", F.split(F.trim("line"), r"\s+"))
    at = lambda k: F.get("p", F.lit(k))
    return _last(rows.select("scenario_id", "path", "no", shared_service(at(0)).alias("service"), at(0).alias("pod"), F.split(at(1), "/")[0].try_cast("int").alias("ready"), F.get(F.split(at(1), "/"), F.lit(1)).try_cast("int").alias("wanted"), at(2).alias("status"), at(3).try_cast("int").alias("restarts"), at(5).alias("ip"), at(6).alias("node")))


def events(spark: SparkSession, root: str) -> DataFrame:
    return events_of(whole_files(spark, root, "events.txt"))


def events_of(files: DataFrame) -> DataFrame:
    """A row for each event of the text table; a warning by type, or by a reason that tells of trouble."""
    rows = files.select("scenario_id", F.posexplode(F.split("content", r"\r?\n")).alias("no", "line")).withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, 'LAST SEEN')").withColumn("p", F.split("line", r"\s+", 5)).where("size(p) = 5")
    return rows.select("scenario_id", "no", log_service(F.regexp_extract(F.col("p")[3], r"([^/]*)$", 1)).alias("service"), F.col("p")[0].alias("last_seen"), F.col("p")[1].alias("type"), F.col("p")[2].alias("reason"), F.col("p")[3].alias("object"), F.col("p")[4].alias("message"), ((F.lower(F.col("p")[1]) == "warning") | F.col("p")[2].isin(rules.BAD_REASONS)).alias("is_warning"))


def collection_status(spark: SparkSession, root: str) -> DataFrame:
    return collection_status_of(whole_files(spark, root, "collection_status.json"))


def collection_status_of(files: DataFrame) -> DataFrame:
    rows = files.select("scenario_id", F.explode(F.from_json("content", "map<string,struct<returncode:int,cmd:string,stderr:string>>")).alias("name", "s"))
    return rows.select("scenario_id", "name", "s.*", (F.col("s.returncode") == 0).alias("ok"))


def topology_edges(spark: SparkSession, root: str) -> DataFrame:
    return topology_edges_of(whole_files(spark, root, "{topology,graph}.json"))


def topology_edges_of(files: DataFrame) -> DataFrame:
    """Edges given as objects, under any of the three pairs of names, or as pairs."""
    entry = F.explode(F.coalesce(*[F.from_json(F.get_json_object("content", f"$.{k}"), "array<string>") for k in ("edges", "dependencies")], F.array().cast("array<string>")))
    rows = files.select("scenario_id", entry.alias("e"))
    got = lambda *names: F.coalesce(*[F.get_json_object("e", f"$.{n}") for n in names])
    return rows.select("scenario_id", F.coalesce(got("src", "source", "from"), F.get_json_object("e", "$[0]")).alias("src"), F.coalesce(got("dst", "target", "to"), F.get_json_object("e", "$[1]")).alias("dst")).where("src is not null and dst is not null")


def topology_services(spark: SparkSession, root: str) -> DataFrame:
    """(scenario_id, service) from the lists of services and nodes of a topology, given as names or as objects."""
    files = whole_files(spark, root, "{topology,graph}.json")
    entry = F.concat(*[F.coalesce(F.from_json(F.get_json_object("content", f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in ("services", "nodes")])
    rows = files.select("scenario_id", F.explode(entry).alias("e"))
    named = F.coalesce(*[F.nullif(F.get_json_object("e", f"$.{n}"), F.lit("")) for n in ("name", "service", "id")])
    return rows.select("scenario_id", F.when(F.col("e").startswith("{"), named).otherwise(F.col("e")).alias("service")).where("service is not null and service <> ''").distinct()


def fault_instances(spark: SparkSession, root: str) -> DataFrame:
    return fault_instances_of(whole_files(spark, root, "spec.json"))


def fault_instances_of(files: DataFrame) -> DataFrame:
    """(scenario_id, no, service, fault_family, variant) of single and multiple faults; a blank name counts as absent."""
    one = "faulty_service string, fault_service string, service string, app_name string, fault_family string, variant string, is_multifault boolean"
    spec = files.select("scenario_id", F.from_json("content", f"{one}, subproblems array<struct<{', '.join(c.replace(' ', ':') for c in one.split(', '))}>>").alias("s"))
    parts = F.when(F.size(F.coalesce("s.subproblems", F.array())) > 0, F.col("s.subproblems")).otherwise(F.array(F.struct(*[F.col(f"s.{c.split()[0]}") for c in one.split(", ")])))
    rows = spec.select("scenario_id", F.posexplode(parts).alias("no", "f"))
    return rows.select("scenario_id", "no", F.coalesce(*[F.nullif(f"f.{c}", F.lit("")) for c in ("faulty_service", "fault_service", "service", "app_name")]).alias("service"), "f.fault_family", rules.variant_name(F.col("f.variant")).alias("variant"))


def actions(spark: SparkSession, root: str) -> DataFrame:
    """(scenario_id, no, api, args_text): the first call in each message of a transcript."""
    return actions_of(whole_files(spark, root, "{agent_transcript,run_result}.json"))


def actions_of(files: DataFrame) -> DataFrame:
    """(scenario_id, no, api, args_text) from transcripts with a list of messages under trace or history."""
    files = files.where(F.try_parse_json("content").isNotNull())
    first = Window.partitionBy("scenario_id").orderBy("path")  # the transcript stands before the run's result
    files = files.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    entry = F.coalesce(*[F.from_json(F.get_json_object("content", f"$.{k}"), "array<string>") for k in ("trace", "history")])
    rows = files.select("scenario_id", F.posexplode(entry).alias("no", "m")).withColumn("m", F.coalesce(F.get_json_object("m", "$.content"), "m"))
    call = r"([a-zA-Z_][a-zA-Z0-9_]*)\((.*?)\)"
    return rows.where(F.col("m").rlike(call)).select("scenario_id", "no", F.regexp_extract("m", call, 1).alias("api"), F.regexp_extract("m", call, 2).alias("args_text"))


def discovered_services(spark: SparkSession, root: str) -> DataFrame:
    """Distinct names from cluster services, pods, topology and pod log files."""
    own = services(spark, root).select("scenario_id", "service").union(pods(spark, root).select("scenario_id", "service"))
    edges = topology_edges(spark, root)
    own = own.union(edges.select("scenario_id", "src")).union(edges.select("scenario_id", "dst")).union(topology_services(spark, root))
    logs = inventory(spark, root).where("kind = 'log'").select("scenario_id", file_service(F.col("path")))
    return own.union(logs).where("service <> '' and service <> 'unknown'").distinct()


def problem_texts(spark: SparkSession, root: str, most: int = 5000) -> DataFrame:
    """(scenario_id, text): the beginning of each problem description."""
    return whole_files(spark, root, "problem_desc.txt").select("scenario_id", F.substring("content", 1, most).alias("text"))


def definition_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, definition) of an inventory in the form path:line:text."""
    form = r"^(.*?):(\d+):\s*(.*)$"
    return spark.read.text(path).where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).alias("file"), F.regexp_extract("value", form, 2).cast("int").alias("line_no"), F.regexp_extract("value", form, 3).alias("definition"))


def coverage_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the JSON form of the coverage inventory."""
    return spark.read.schema("app string, task string, fault_family string, base_folder string").option("multiLine", True).json(path)


def coverage_tuples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("app string, task string, fault_family string").csv(path)
