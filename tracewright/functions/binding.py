"""Evaluate an argument once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row, however often f mentions it; keeps the plan small, too."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
