"""Metric samples (scenario_id, path, row_no, service, kpi_name, value) to KPI and service summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import rules

# fixed values: flat fields, the KPI behind each and whether its last value or its change counts
FLAT_FIELDS = {
    "cpu_usage_delta": ("container_cpu_usage_seconds_total", "delta"),
    "cpu_load_last": ("container_cpu_load_average_10s", "last"),
    "memory_working_set_last": ("container_memory_working_set_bytes", "last"),
    "memory_usage_last": ("container_memory_usage_bytes", "last"),
    "network_rx_bytes_delta": ("container_network_receive_bytes_total", "delta"),
    "network_tx_bytes_delta": ("container_network_transmit_bytes_total", "delta"),
    "network_tx_errors_delta": ("container_network_transmit_errors_total", "delta"),
    "network_rx_drops_delta": ("container_network_receive_packets_dropped_total", "delta"),
    "network_tx_drops_delta": ("container_network_transmit_packets_dropped_total", "delta"),
    "threads_last": ("container_threads", "last"),
}


def kpi_summary(samples: DataFrame) -> DataFrame:
    """Count, first, last, extremes, mean and delta of every KPI of a service, in read order."""
    at = F.struct("path", "row_no")
    made = samples.groupBy("scenario_id", "service", "kpi_name").agg(F.count("*").alias("n"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))
    return made.withColumn("delta", F.col("last_value") - F.col("first_value")).withColumn("kpi_group", rules.kpi_group(F.col("kpi_name"))).withColumn("signal", rules.metric_signal(F.col("min_value"), F.col("max_value")))


def flat_fields(kpis: DataFrame) -> DataFrame:
    """One row a service with the ten flat fields: each the delta or last value of the KPI of that very name, with or
    without its prefix, else of the first (by name) that contains the name's core; 0 without one."""
    out, name = [], F.col("kpi_name")
    for field, (kpi, what) in FLAT_FIELDS.items():
        value = F.col("delta" if what == "delta" else "last_value")
        rank = F.when(name == f"kpi_{kpi}", 0).when(name == kpi, 1).when(F.lower(name).contains(kpi.removeprefix("container_")), 2)
        out.append(F.coalesce(F.min_by(F.when(rank.isNotNull(), value), F.when(rank.isNotNull(), F.struct(rank, name))), F.lit(0.0)).alias(field))
    return kpis.groupBy("scenario_id", "service").agg(*out, (F.count("*") > 0).alias("metric_signal_present"))


def metric_groups(kpis: DataFrame) -> DataFrame:
    """(scenario_id, service, kpi_group, signals): a map from KPI to what a reader needs of it, the figures rounded; a constant has
    its value, a series that is zero only its count."""
    r = lambda c: F.round(c, 4)
    none = F.lit(None).cast("double")
    dynamic = F.col("signal") == "dynamic"
    figures = [F.when(dynamic, r(c)).otherwise(none).alias(c) for c in ("first_value", "min_value", "max_value", "mean_value", "delta")]
    told = F.struct("signal", "n", F.when(F.col("signal") != "zero", r("last_value")).otherwise(none).alias("value"), *figures)
    return kpis.groupBy("scenario_id", "service", "kpi_group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kpi_name", told.alias("told"))))).alias("signals"))


def statistics(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """count, min, max, mean, p50, p95 and last of a value by key."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    made = values.groupBy(*keys).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), p.alias("_p"), F.max_by(value, F.struct(*order)).alias("last"))
    return made.withColumn("p50", F.col("_p")[0]).withColumn("p95", F.col("_p")[1]).drop("_p")


def latency_back_fill(services: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario_id, service, latency_ms): the largest p95 of the incoming edges, also of services without metrics."""
    worst = edges.groupBy("scenario_id", F.col("dst").alias("service")).agg((F.max("latency_p95_us") / 1000).alias("latency_ms"))
    return services.select("scenario_id", "service").distinct().join(worst, ["scenario_id", "service"], "full_outer")
