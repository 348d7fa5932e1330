"""Telemetry analytics on Spark: logs, metrics, traces and cluster objects to states, scores and views."""
