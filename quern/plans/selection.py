"""Which sample answers a query, and how its error is found. Pure functions."""

from __future__ import annotations

from dataclasses import dataclass


def normal(expression: str) -> str:
    """An expression for comparison: lower case, no spaces, no qualifier before a lone column."""
    text = "".join(expression.lower().split()).replace("`", "")
    head, _, last = text.rpartition(".")
    return last if head.isidentifier() and last.isidentifier() else text


@dataclass(frozen=True)
class Candidate:
    name: str
    qcs: frozenset[str]
    fraction: float
    bypass: bool = False


def select_sample(candidates: list[Candidate], group: set[str], where: set[str], required: set[str] = frozenset()) -> Candidate | None:
    """The sample for a query that groups by `group`, filters on `where`, and takes extremes of `required`.

    A sample must contain what extremes are taken of. One whose columns are exactly the grouping
    wins, then one whose columns are exactly all the query's; then supersets of the query's
    columns, then those with the fewest missing. Among equals a bypass sample, then the larger
    fraction, then the name decides.
    """
    usable = sorted((c for c in candidates if required <= c.qcs), key=lambda c: c.name)
    query = group | where
    for exact in (group, query):
        for c in usable:
            if exact and c.qcs == exact:
                return c
    if not usable:
        return None
    covering = [c for c in usable if query < c.qcs] or [c for c in usable if len(query - c.qcs) == min(len(query - d.qcs) for d in usable)]
    return min(covering, key=lambda c: (not c.bypass, -c.fraction, c.name))


CLOSED_FORM, BOOTSTRAP, BYPASS, EXACT = "closed_form", "bootstrap", "bypass", "exact"


def choose_analysis(
    kinds: set[str], *, filtered: bool = False, having_on_group: bool = False, closed_form: bool = True, joins: bool = False, inner_only: bool = True,
    other_distributed: bool = False, unregistered: bool = False, unsupported: bool = False, error_functions: bool = False, behavior: str = "DO_NOTHING",
) -> str:
    """kinds: of the query's aggregates. filtered: rows are dropped below the aggregate."""
    if unsupported or not kinds:
        return EXACT
    if kinds <= {"min", "max"}:
        return BYPASS
    if behavior == "DO_NOTHING" and not error_functions:
        return BYPASS
    if not closed_form or "avg" in kinds and (filtered or having_on_group):
        return BOOTSTRAP
    if unregistered or joins and (not inner_only or other_distributed or kinds & {"count", "avg"}):
        return BOOTSTRAP
    return CLOSED_FORM
