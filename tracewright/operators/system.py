"""Pods, endpoints, events and workload objects to the state of each service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import rules

SERVICE = ["scenario_id", "service"]
PHASES = {"Running": "running", "Pending": "pending", "Failed": "failed", "Succeeded": "succeeded"}
HISTOGRAMS = {"qos": "qos_classes", "condition": "condition_counts", "waiting": "waiting_reasons", "terminated": "terminated_reasons", "owner_kind": "owner_kinds", "owner": "owner_names"}


def pod_rollup(pods: DataFrame) -> DataFrame:
    """One row a service from (scenario_id, service, pod, node, phase, ready, restarts, waiting_reasons, terminated_reasons), the
    last two an array with an entry for each container in that state. A pod counts as ready only while it runs."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    c = F.col
    ready = F.coalesce(c("ready") & (c("phase") == "Running"), F.lit(False))
    held = lambda column, *reasons: F.coalesce(F.sum(F.size(F.filter(column, lambda r: r.isin(*reasons)))), F.lit(0)).alias
    many = lambda column: F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0))), F.lit(0)).alias
    made = pods.groupBy(*SERVICE).agg(
        F.count("*").alias("pods_total"), n(ready, "pods_ready"), n(~ready, "pods_unready"), F.coalesce(F.sum("restarts"), F.lit(0)).alias("restarts"),
        *[n(c("phase") == phase, name) for phase, name in PHASES.items()], n(~F.coalesce("phase", F.lit("")).isin(*PHASES), "unknown_phase"),
        many("waiting_reasons")("waiting"), many("terminated_reasons")("terminated"), held("waiting_reasons", "CrashLoopBackOff")("crashloop"),
        held("waiting_reasons", "ImagePullBackOff", "ErrImagePull")("image_pull_error"), held("terminated_reasons", "OOMKilled")("oomkilled"),
        F.sort_array(F.collect_set("node")).alias("nodes"), F.sort_array(F.collect_set("pod")).alias("pod_names"),
    )
    return judged(made)


def judged(rolled: DataFrame) -> DataFrame:
    c = F.col
    made = rolled.withColumn("status", rules.system_status(c("crashloop"), c("image_pull_error"), c("oomkilled"), c("pending"), c("failed"), c("pods_unready"), c("pods_ready")))
    return made.withColumn("infra_issue", ~c("status").isin("healthy", "unknown")).withColumn("availability", F.coalesce(F.try_divide("pods_ready", "pods_total"), F.lit(0.0)))


def pod_details(pods: DataFrame) -> DataFrame:
    """(scenario_id, service, six histograms as maps, sorted distinct containers, images, commands and addresses, ports), from
    pods that also have the arrays conditions (type=status), owner_kinds, owner_names, containers, images,
    commands, ports (container_port, protocol, name), and qos_class and pod_ip. All histograms come from one pass; a container that gives no
    reason counts as unknown."""
    fact = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), F.coalesce(v, F.lit("unknown")).alias("value")))
    single = lambda column: F.filter(F.array(F.col(column)), lambda v: v.isNotNull())
    present = lambda column: F.filter(column, lambda v: v.isNotNull())
    every = F.concat(
        fact("qos", single("qos_class")), fact("condition", F.col("conditions")), fact("waiting", F.col("waiting_reasons")), fact("terminated", F.col("terminated_reasons")),
        fact("owner_kind", present("owner_kinds")), fact("owner", present("owner_names")),
    )
    counted = pods.select(*SERVICE, F.explode(every).alias("f")).groupBy(*SERVICE, "f.kind", "f.value").agg(F.count("*").alias("n"))
    as_map = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n")))))
    maps = counted.groupBy(*SERVICE).agg(*[as_map(kind).alias(name) for kind, name in HISTOGRAMS.items()])
    joined = lambda column: F.sort_array(F.array_distinct(F.flatten(F.collect_list(present(column))))).alias(column)
    lists = pods.groupBy(*SERVICE).agg(*[joined(column) for column in ("containers", "images", "commands")], F.sort_array(F.collect_set("pod_ip")).alias("pod_ips"), F.sort_array(F.flatten(F.collect_list("ports"))).alias("ports"))
    made = lists.join(maps, SERVICE, "left")
    return made.withColumns({name: F.coalesce(name, F.create_map().cast("map<string,bigint>")) for name in HISTOGRAMS.values()})


def counter(rows: DataFrame, column: str) -> DataFrame:
    """A map from value to count for each service."""
    n = rows.where(F.col(column).isNotNull()).groupBy(*SERVICE, column).agg(F.count("*").alias("n"))
    return n.groupBy(*SERVICE).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{column}_counts"))


def merged(pods: DataFrame, endpoints: DataFrame, events: DataFrame, *objects: DataFrame) -> DataFrame:
    """Services of any of the tables. No ready endpoint outranks one that isn't ready, which outranks the
    pods' status; warnings raise the flag only. ``objects`` are further tables with a row a service
    (deployments, replica sets, cluster services), whose columns are added."""
    ends = endpoints.groupBy(*SERVICE).agg(F.sum("ready_endpoints").alias("ready_endpoints"), F.sum("not_ready_endpoints").alias("not_ready_endpoints"))
    warn = events.where("is_warning").groupBy(*SERVICE).agg(F.count("*").alias("warnings"))
    keys = pods.select(*SERVICE).union(endpoints.select(*SERVICE)).union(events.select(*SERVICE))
    for d in objects:
        keys = keys.union(d.select(*SERVICE))
    all_ = keys.distinct().join(pods, SERVICE, "left").join(ends, SERVICE, "left").join(warn, SERVICE, "left").fillna({"warnings": 0})
    for d in objects:
        all_ = all_.join(d, SERVICE, "left")
    none, some = F.coalesce(F.col("ready_endpoints") == 0, F.lit(False)), F.coalesce(F.col("not_ready_endpoints") > 0, F.lit(False))
    flag = none | some | (F.col("warnings") > 0) | F.coalesce("infra_issue", F.lit(False))
    return all_.withColumn("status", F.when(none, "no_ready_endpoints").when(some, "endpoint_not_ready").otherwise(F.coalesce("status", F.lit("unknown")))).withColumn("infra_issue", flag)
