"""Log lines (scenario_id, path, line_no, service, line) to parsed rows and service features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import logs, names, rules
from tracewright.functions.binding import once

SERVICE = ["scenario_id", "service"]


def parsed(lines: DataFrame) -> DataFrame:
    """Noise, pod prefix, format, severity bucket, error type, targets and HTTP facts of every line.

    A line with a pod prefix counts for its container's service, not for the file's; noise, and a container that gives no name, stay
    with the file's.
    """
    p = lines.withColumn("noise", logs.is_noise(F.col("line"))).withColumn("_p", once(F.col("line"), logs.pod_prefix)).select(*lines.columns, "noise", "_p.*")
    told = F.when(F.col("container").isNotNull() & ~F.col("noise"), F.nullif(once(F.col("container"), names.log_service), F.lit("unknown")))
    p = p.withColumn("service", F.coalesce(told, "service"))
    p = p.withColumn("_l", once(F.col("rest"), logs.parse_line)).select(*p.columns, "_l.*").withColumn("error_type", once(F.col("message"), logs.error_type))
    return p.withColumn("bucket", logs.bucket(F.col("severity"), F.col("error_type"))).drop("rest")


def _targets(message) -> F.Column:
    """array<struct<target, port, raw_target>> of a message, one target and port once, in order."""
    named = F.transform(logs.dependency_targets(message), lambda t: F.struct(once(t["raw_target"], names.log_service).alias("target"), t["port"].alias("port"), t["raw_target"].alias("raw_target")))
    key = lambda t: F.struct(t["target"], t["port"])
    return once(named, lambda a: F.filter(a, lambda t, i: F.array_position(F.transform(a, key), key(t)) == i + 1))


def dependencies(rows: DataFrame) -> DataFrame:
    """A row for each target of each line that isn't noise."""
    found = rows.where("not noise").select(*SERVICE, "path", "line_no", "error_type", "message", F.posexplode(_targets(F.col("message"))).alias("dep_no", "t"))
    return found.select(*SERVICE, "path", "line_no", "dep_no", "error_type", "message", "t.*")


def dependency_errors(rows: DataFrame, most: int = 50) -> DataFrame:
    """(scenario_id, service, no, target, raw_target, port, error_type, message): of each service the first ``most`` targets that its
    lines name, in the order of files and lines; messages cut to 500 characters. Each task keeps the first ``most`` of a service, so
    a service with very many lines hands over few."""
    first = Window.partitionBy(*SERVICE).orderBy("path", "line_no", "dep_no")
    own = dependencies(rows).withColumn("no", F.row_number().over(first)).where(F.col("no") <= most)
    return own.select(*SERVICE, "no", "target", "raw_target", "port", "error_type", F.substring("message", 1, 500).alias("message"))


def dependency_edges(errors: DataFrame) -> DataFrame:
    """(scenario_id, source, target, port, error_type, message) of ``dependency_errors``."""
    return errors.select("scenario_id", F.col("service").alias("source"), "target", "port", "error_type", "message")


def facts(rows: DataFrame) -> DataFrame:
    """(scenario_id, service, kind, key, n, first_at): everything that is counted of a service's lines, in one pass.

    Kinds: line, noise, format, bucket, severity, type, component, http, operation, dependency, startup, ready.
    The facts of a file are counted by a hash first, which the smallest of a number allows and that of a struct doesn't: that sorts.
    A noise line counts as noise only. Every line has a fact; the outer explode spares a filter on their number, which
    Spark would push down and for which it would work them out twice.
    """
    low = F.lower("message")
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    when = lambda hit, kind, key: F.when(F.coalesce(hit, F.lit(False)), fact(kind, key))
    c, none = F.col, F.lit("")
    http = F.col("_http")
    each = [
        fact("line", none), fact("format", c("format")), fact("bucket", c("bucket")), fact("severity", c("severity")),
        when(c("error_type") != "none", "type", c("error_type")), when(c("component") != "", "component", c("component")),
        when(http["status"].isNotNull(), "http", http["status"]), when(http["path"].isNotNull(), "operation", http["path"]),
        when(logs.holds(low, logs.STARTING), "startup", none), when(logs.holds(low, logs.READY), "ready", none),
    ]
    targets = F.array_distinct(F.transform(logs.dependency_targets(c("message")), lambda t: F.struct(once(t["raw_target"], names.log_service).alias("name"), t["port"].alias("port"))))
    own = F.concat(F.filter(F.array(*each), lambda f: f.isNotNull()), F.transform(targets, lambda t: fact("dependency", t["name"])))
    told = rows.withColumn("_http", once(c("message"), logs.http_info)).withColumn("_f", F.when(c("noise"), F.array(fact("noise", none))).otherwise(own))
    each_file = told.select(*SERVICE, "path", "line_no", F.explode_outer("_f").alias("f")).groupBy(*SERVICE, "path", "f.kind", "f.key").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    return each_file.groupBy(*SERVICE, "kind", "key").agg(F.sum("n").alias("n"), F.min(F.struct("path", "line_no")).alias("first_at"))


def rollup(counts: DataFrame) -> DataFrame:
    """One row a service from ``facts``: line counts by bucket, format and signal, the histograms as maps (of
    components and operations the 30 most frequent, ties by first place), the dominant error type (of equals the one
    seen first), and the two scores."""
    n = lambda kind, key=None: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.lit(True) if key is None else F.col("key") == key), F.col("n"))), F.lit(0))
    weights = F.create_map(*[F.lit(x) for p in logs.WEIGHTS.items() for x in p])
    own = F.when(F.col("kind") == "type", weights[F.col("key")])
    listed = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("order"), "first_at", "key", "n")))
    as_map = lambda e: F.map_from_entries(F.transform(e, lambda x: F.struct(x["key"], x["n"])))
    maps = {"severity": "severity_counts", "type": "error_type_counts", "component": "component_counts", "http": "http_status_counts", "operation": "operation_counts", "dependency": "dependency_counts"}
    made = counts.groupBy(*SERVICE).agg(
        n("line").alias("lines"), *[n("bucket", b).alias(f"{b}s" if b != "info" else "infos") for b in ("info", "warn", "error", "fatal", "debug")], *[n("format", f).alias(f"{f}_lines") for f in ("json", "cpp", "nginx", "plain")],
        n("noise").alias("noise_lines"), n("startup").alias("startup_signals"), n("ready").alias("ready_signals"), n("dependency").alias("deps"),
        F.coalesce(F.sum(F.least(F.col("n") * own * 0.05, own)), F.lit(0.0)).alias("by_type"), *[listed(kind).alias(name) for kind, name in maps.items()],
    )
    made = made.withColumn("signal_present", F.col("lines") > 0).withColumn("dominant_error_type", F.coalesce(F.get(F.array_sort("error_type_counts"), F.lit(0))["key"], F.lit("none")))
    most = lambda name: F.slice(F.array_sort(name), 1, 30) if name in ("component_counts", "operation_counts") else F.array_sort(name)
    return scored(made.withColumns({name: as_map(most(name)) for name in maps.values()})).drop("by_type")


def scored(features: DataFrame) -> DataFrame:
    """Append log_anomaly_score, a capped sum over errors, fatals, warnings, targets and types, and log_health_score."""
    c = F.col
    raw = F.least(c("errors") * 0.04, F.lit(0.5)) + F.least(c("fatals") * 0.2, F.lit(0.4)) + F.least(c("warns") * 0.008, F.lit(0.12)) + F.least(c("deps") * 0.04, F.lit(0.45)) + c("by_type") + F.when(c("deps") > 0, 0.15).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return features.withColumn("log_anomaly_score", F.round(raw, 4)).withColumn("log_health_score", F.round(1 - raw, 4))


def examples(rows: DataFrame, most: int = 20, templates: int = 10) -> DataFrame:
    """(scenario_id, service, evidence_lines, error_templates): of the first ``most`` lines with an error type the
    distinct lines and messages in order, cut to 700 and 500 characters."""
    first = Window.partitionBy(*SERVICE).orderBy("path", "line_no")
    own = rows.where("not noise and error_type <> 'none'").select(*SERVICE, "path", "line_no", F.substring(F.trim("line"), 1, 700).alias("line"), F.substring("message", 1, 500).alias("message"))
    own = own.withColumn("no", F.row_number().over(first)).where(F.col("no") <= most)
    made = own.groupBy(*SERVICE).agg(F.array_sort(F.collect_list(F.struct("no", "line", "message"))).alias("e"))
    return made.select(*SERVICE, F.array_distinct("e.line").alias("evidence_lines"), F.slice(F.array_distinct("e.message"), 1, templates).alias("error_templates"))


def with_defaults(services: DataFrame, features: DataFrame) -> DataFrame:
    """Each known service with its features; one without logs has zeros, empty maps, no error type and full health."""
    made = services.select(*SERVICE).distinct().join(features, SERVICE, "left")
    fill = {"lines": 0, "infos": 0, "warns": 0, "errors": 0, "fatals": 0, "debugs": 0, "json_lines": 0, "cpp_lines": 0, "nginx_lines": 0, "plain_lines": 0, "noise_lines": 0, "startup_signals": 0, "ready_signals": 0, "deps": 0, "signal_present": False, "dominant_error_type": "none", "log_anomaly_score": 0.0, "log_health_score": 1.0}
    made = made.fillna({k: v for k, v in fill.items() if k in made.columns})
    return made.withColumns({f.name: F.coalesce(f.name, F.create_map().cast(f.dataType)) for f in made.schema.fields if f.name.endswith("_counts")})


def global_counts(counts: DataFrame) -> DataFrame:
    """(scenario_id, kind, key, n) of error types and dependency targets over all services."""
    return counts.where("kind in ('type', 'dependency')").groupBy("scenario_id", "kind", "key").agg(F.sum("n").alias("n"))


def type_counts(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'type'").select(*SERVICE, F.col("key").alias("error_type"), "n", "first_at")


def error_families(counts: DataFrame) -> DataFrame:
    """Counts by family; a dependency target counts as dependency, and as database if its name tells so."""
    kind, key = F.col("kind"), F.col("key")
    families = F.when(kind == "type", F.array(rules.error_family(key))).when(F.lower(key).rlike("mongo|db"), F.array(F.lit("dependency"), F.lit("database"))).otherwise(F.array(F.lit("dependency")))
    return counts.where("kind in ('type', 'dependency')").select(*SERVICE, F.explode(families).alias("family"), "n").groupBy(*SERVICE, "family").agg(F.sum("n").alias("n"))


def first_distinct(rows: DataFrame, keys: list[str], order: list[str], value: str, most: int = 20) -> DataFrame:
    """The first ``most`` rows of a key, of which repeats are dropped; with their first place."""
    own = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= most)
    return first.groupBy(*keys, value).agg(F.min("place").alias("place"))


def top_error_services(features: DataFrame, most: int = 15, anomalous: float = 0.3) -> DataFrame:
    """Per scenario the services with most error lines, among those with an error or a high anomaly score; ties
    by name. From ``rollup``."""
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("errors"), "service"))
    return features.where((F.col("errors") > 0) | (F.col("log_anomaly_score") > anomalous)).withColumn("rank", rank).where(F.col("rank") <= most)
