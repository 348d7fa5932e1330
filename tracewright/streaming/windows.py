"""Running figures over streams of spans, samples and lines; the source engine has none, these extend it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_kpis(samples: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """From (ts, service, kpi_name, value): approximate percentiles need bounded state only."""
    grouped = samples.withWatermark("ts", late).groupBy(F.window("ts", width), "service", "kpi_name")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.percentile_approx("value", 0.95).alias("p95")).select(F.col("window.start").alias("start"), "service", "kpi_name", "n", "mean_value", "p95")


def activity(samples: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity of each service."""
    grouped = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "service")
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "service", "n")
