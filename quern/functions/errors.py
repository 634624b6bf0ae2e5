"""The four error functions over an estimate and its half-width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the error functions, and the columns that estimators make for an aggregate x.
FUNCTIONS = ("absolute_error", "relative_error", "lower_bound", "upper_bound")


def column(function: str, alias: str) -> str:
    return f"{alias}__{function}"


def display_name(function: str, alias: str) -> str:
    """The name of an error function's column that the query does not alias."""
    return "_".join(w.capitalize() for w in function.split("_")) + f"({alias})"


def from_bound(estimate: Column, bound: Column) -> dict[str, Column]:
    """Of a symmetric interval. A relative error is taken of |estimate|, plus one up to one."""
    size = F.abs(estimate)
    return {
        "absolute_error": F.abs(bound),
        "relative_error": F.when(size > 1, F.abs(bound / F.nullif(estimate, F.lit(0.0)))).otherwise(F.abs(bound) / (size + 1)),
        "lower_bound": estimate - bound,
        "upper_bound": estimate + bound,
    }


def from_interval(estimate: Column, low: Column, high: Column) -> dict[str, Column]:
    """Of quantiles."""
    safe = F.when(F.abs(estimate) > 1, estimate).when(estimate >= 0, estimate + 1).otherwise(estimate - 1)
    return {"absolute_error": (high - low) / 2, "relative_error": F.abs((high - low) / (2 * safe)), "lower_bound": low, "upper_bound": high}


def exact() -> dict[str, Column]:
    """Of a value that was not estimated."""
    none = F.lit(None).cast("double")
    return {"absolute_error": F.lit(0.0), "relative_error": F.lit(0.0), "lower_bound": none, "upper_bound": none}
