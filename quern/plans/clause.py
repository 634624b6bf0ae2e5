"""The error clause: WITH ERROR e CONFIDENCE c BEHAVIOR 'b', at any SELECT level."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..operators.contract import BEHAVIORS
from .text import masked

_NUMBER = r"(-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_CLAUSE = re.compile(
    rf"\bwith\s+error\b(?:\s*{_NUMBER})?(?:\s+confidence\s*{_NUMBER})?(?:\s+behaviou?r\s+(\x01+|\w+))?|\bconfidence\s*{_NUMBER}(?:\s+behaviou?r\s+(\x01+|\w+))?|\bbehaviou?r\s+(\x01+)",
    re.I,
)

DEFAULT_ERROR, DEFAULT_CONFIDENCE = 0.2, 0.95


@dataclass(frozen=True)
class Clause:
    """What a query asks for. error: None if neither the query nor the session sets one."""

    error: float | None = None
    confidence: float | None = None
    behavior: str | None = None
    bare: bool = False  # WITH ERROR without a number


def check_error(error: float) -> float:
    """Negative turns approximation off."""
    if error == 0 or error >= 1:
        raise ValueError(f"the error must lie between 0 and 1; it is {error}")
    return error


def check_confidence(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError(f"the confidence must lie between 0 and 1; it is {confidence}")
    return confidence


def check_behavior(behavior: str) -> str:
    name = behavior.upper()
    if name not in BEHAVIORS:
        raise ValueError(f"unknown behavior {behavior}; there are {', '.join(BEHAVIORS)}")
    return name


def strip(sql: str) -> tuple[str, Clause | None]:
    """sql without its error clauses, and the first of them."""
    found, out, at = None, "", 0
    for m in _CLAUSE.finditer(masked(sql)):
        error, c1, b1, c2, b2, b3 = (sql[m.start(i) : m.end(i)].strip("'\"") if m[i] else None for i in range(1, 7))
        confidence, behavior = c1 or c2, b1 or b2 or b3
        bare = error is None and bool(re.match(r"with", m[0], re.I))
        clause = Clause(
            check_error(float(error)) if error else None,
            check_confidence(float(confidence)) if confidence else None,
            check_behavior(behavior) if behavior else None,
            bare,
        )
        found = found or clause
        out += sql[at : m.start()]
        at = m.end()
    return out + sql[at:], found


@dataclass(frozen=True)
class Settings:
    error: float
    confidence: float
    behavior: str


def resolve(clause: Clause | None, conf: dict) -> Settings | None:
    """Query before session before defaults; None where the query is to run exactly.

    An error in the query defaults to RUN_ON_FULL_TABLE; a bare clause and an error of the
    session default to DO_NOTHING.
    """
    session = conf.get("error")
    if clause is None or (clause.error is None and not clause.bare):
        if session is None:
            return None
        error, behavior = check_error(float(session)), "DO_NOTHING"
    elif clause.bare:
        error, behavior = check_error(float(session)) if session is not None else DEFAULT_ERROR, "DO_NOTHING"
    else:
        error, behavior = clause.error, "RUN_ON_FULL_TABLE"
    if error < 0:
        return None
    confidence = (clause and clause.confidence) or check_confidence(float(conf.get("confidence", DEFAULT_CONFIDENCE)))
    behavior = (clause and clause.behavior) or check_behavior(conf.get("behavior", behavior))
    return Settings(error, confidence, behavior)
