"""Handing solutions over one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def for_each(solutions: DataFrame, callback: Callable[[dict[str, int]], bool]) -> bool:
    """Calls ``callback`` with each solution, a partition at a time, until it returns False; whether all were handed over."""
    return all(callback(row.asDict()) is not False for row in solutions.toLocalIterator())
