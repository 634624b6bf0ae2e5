"""The accuracy contract: what happens where an estimate's relative error is over the limit.

A group violates the contract if the relative error of any estimate is null or over the limit.
Groups answered from the base table have errors of zero and never violate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import errors
from ._tables import settle
from .estimators import Agg

BEHAVIORS = ("DO_NOTHING", "LOCAL_OMIT", "STRICT", "RUN_ON_FULL_TABLE", "PARTIAL_RUN_ON_BASE_TABLE")


class ErrorLimitExceededError(RuntimeError):
    """STRICT: a row has an error over the limit."""


def estimated(aggs: list[Agg]) -> list[Agg]:
    return [a for a in aggs if not a.plain and a.kind not in ("min", "max")]


def violates(aggs: list[Agg], limit: float) -> Column:
    over = [F.coalesce(F.col(errors.column("relative_error", a.alias)) > limit, F.lit(True)) for a in estimated(aggs)]
    return reduce(lambda a, b: a | b, over, F.lit(False))


def local_omit(groups: DataFrame, aggs: list[Agg], limit: float, count_as_minus_one: bool = False) -> DataFrame:
    """Estimates over the limit, and their errors, become null."""
    out = {}
    for a in estimated(aggs):
        over = F.coalesce(F.col(errors.column("relative_error", a.alias)) > limit, F.lit(True))
        for name in (a.alias, *[errors.column(f, a.alias) for f in errors.FUNCTIONS]):
            gone = F.lit(-1.0) if count_as_minus_one and name == a.alias and a.kind == "count" else F.lit(None)
            out[name] = F.when(over, gone).otherwise(F.col(name))
    return groups.withColumns(out) if out else groups


def strict(groups: DataFrame, aggs: list[Agg], limit: float) -> DataFrame:
    """groups, or an error. Checked at once, over the rows the query returns."""
    groups = settle(groups)
    bad = groups.filter(violates(aggs, limit)).limit(1).collect()
    if bad:
        raise ErrorLimitExceededError(f"at least one row in the result has an error greater than the limit {limit}, for example {bad[0]}")
    return groups


def run_on_full_table(groups: DataFrame, aggs: list[Agg], limit: float, exact: Callable[[], DataFrame]) -> DataFrame:
    """groups, or exact() in their place if any violates."""
    groups = settle(groups)
    return exact() if not groups.filter(violates(aggs, limit)).isEmpty() else groups


def partial_run(groups: DataFrame, keys: list[str], aggs: list[Agg], limit: float, exact: Callable[[DataFrame], DataFrame], whole: Callable[[], DataFrame]) -> DataFrame:
    """Groups that hold, and exact(failing keys) for the rest; whole() where nothing is grouped.

    exact gets the key tuples of the failing groups and computes those groups alone.
    """
    groups = settle(groups)
    bad = groups.filter(violates(aggs, limit))
    if bad.isEmpty():
        return groups
    if not keys:
        return whole()
    return groups.filter(~violates(aggs, limit)).unionByName(exact(bad.select(*keys)))


def rows_of(df: DataFrame, by: dict[str, Column], keys: DataFrame) -> DataFrame:
    """The rows of df in the groups that keys names; null keys match null keys."""
    wanted = keys.select(*[F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(by)])
    on = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by.values())])
    return df.join(wanted, on, "left_semi")
