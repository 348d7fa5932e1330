"""Sinks: state documents, line-wise JSON, and one folder a scenario.

What is written by scenario replaces the folders of the scenarios it holds and leaves all others, so a batch may write
one scenario after the other, and a rerun replaces its own results only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def by_scenario(df: DataFrame, mode: str = "overwrite") -> DataFrameWriter:
    writer = df.write.mode(mode).partitionBy("scenario_id")
    return writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One readable JSON text a row, in a folder for each scenario."""
    keys = [c for c in df.columns if c != "scenario_id"]
    by_scenario(df.select(F.regexp_replace("scenario_id", r"[/ ]", "_").alias("scenario_id"), F.to_json(F.struct(*keys), {"pretty": "true"}).alias("value")), mode).text(path)


def write_texts(df: DataFrame, column: str, path: str) -> None:
    """A column of texts as they are, such as rendered documents, in a folder for each scenario."""
    by_scenario(df.select(F.regexp_replace("scenario_id", r"[/ ]", "_").alias("scenario_id"), F.col(column).alias("value"))).text(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """Line-wise JSON. Appending is for new rows only: a rerun that must not repeat its rows writes by scenario."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_scenario_lines(df: DataFrame, path: str) -> None:
    """Line-wise JSON in a folder for each scenario."""
    by_scenario(df).json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A bundle: each table as Parquet in a folder of its name, by scenario where it has one; a table without scenarios
    is replaced as a whole."""
    for name, df in tables.items():
        (by_scenario(df) if "scenario_id" in df.columns else df.write.mode("overwrite")).parquet(f"{path}/{name}")
