"""A SELECT with aggregates over a sampled table, taken apart into estimator calls.

The aggregate's input is read by Spark from the query's own FROM and WHERE with the sample in
place of the base, so names resolve as in the query. The result of the estimator is then put
under the query's select list, HAVING, ORDER BY and LIMIT. What is not understood runs exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..functions import errors
from ..operators.estimators import Agg
from ..operators.sampling import CARRIED, split_list
from . import text
from .selection import normal
from .text import Block, NotUnderstoodError

SUPPORTED = "sum|avg|mean|count|min|max"
#: Aggregates that only run exactly.
UNSUPPORTED = (
    r"stddev\w*|std|var\w*|first\w*|last\w*|collect_\w+|array_agg|corr|covar_\w+|skewness|kurtosis|percentile\w*|approx_\w+|median|mode|any_value|any|some|every|bool_\w+|"
    r"bit_(?:and|or|xor)|max_by|min_by|grouping\w*|regr_\w+|histogram_numeric|hll_\w+|count_min_sketch|count_if|listagg|string_agg|try_sum|try_avg|product"
)
ERRORS = "|".join(errors.FUNCTIONS)


class UnresolvedError(ValueError):
    """An error function names no aggregate of the select list."""


@dataclass
class Plan:
    """An aggregate query in parts. Columns of the estimator's result: g0, … and the aggs' aliases."""

    block: Block
    groups: list[str]
    aggs: list[Agg] = field(default_factory=list)
    args: dict[str, str] = field(default_factory=dict)  # input columns of the aggregates
    items: list[tuple[str, str]] = field(default_factory=list)  # (expression over the result, name)
    having: str = ""
    order: str = ""
    uses_errors: bool = False

    def input_sql(self, source: str, hidden: bool) -> str:
        columns = [f"{g} AS g{i}" for i, g in enumerate(self.groups)] + [f"{e} AS {n}" for n, e in self.args.items()]
        columns += list(CARRIED) if hidden else []
        return f"SELECT {', '.join(columns or ['1 AS one'])} FROM {source}" + f" WHERE {self.block.where}" * bool(self.block.where)


def has_aggregate(block: Block) -> bool:
    whole = ", ".join(block.items) + " " + block.having
    return bool(block.group) or bool(text.calls(whole, f"{SUPPORTED}|{UNSUPPORTED}"))


def plan(block: Block) -> Plan:
    put = lambda sql: text.unfiltered(sql, SUPPORTED)
    block = replace(block, items=[put(i) for i in block.items], having=put(block.having), order=put(block.order))
    pairs = [text.aliased(i) for i in block.items]
    by_alias = {a.lower(): e for e, a in pairs if a}
    whole = ", ".join(block.items) + " " + block.having + " " + block.order
    if text.calls(whole, UNSUPPORTED) or block.distinct or re.search(r"\bover\s*\(", text.masked(whole), re.I) or re.search(r"\(\s*select\b", text.masked(whole), re.I):
        raise NotUnderstoodError("an aggregate that only runs exactly")
    groups = []
    for g in block.group:
        if g.isdigit():
            g = pairs[int(g) - 1][0]
        elif g.lower() in by_alias and not text.calls(by_alias[g.lower()], SUPPORTED):
            g = by_alias[g.lower()]
        groups.append(g)
    made = Plan(block, groups)
    known: dict[tuple[str, str, bool], Agg] = {}

    def agg(call: text.Call, alias: str | None) -> Agg:
        if re.match(r"(distinct|all)\b", call.arg, re.I) or call.name == "count" and re.search(r"\bif\s*\(", text.masked(call.arg), re.I):
            raise NotUnderstoodError("a distinct or conditional count only runs exactly")
        kind = "avg" if call.name == "mean" else call.name
        plain = bool(alias) and alias.lower().startswith("sample_")
        key = (kind, normal(call.arg), plain)
        if key not in known:
            n = len(known)
            args = ["*"] if call.arg == "*" or re.fullmatch(r"\d+", call.arg) and kind == "count" else split_list(call.arg)
            columns = []
            for j, a in enumerate(args):
                if a == "*":
                    columns.append("*")
                else:
                    columns.append(f"a{n}_{j}")
                    made.args[f"a{n}_{j}"] = a
            known[key] = Agg(kind, ", ".join(columns), f"{'sample_' * plain}x{n}")
            made.aggs.append(known[key])
        return known[key]

    of_alias: dict[str, Agg] = {}
    for e, a in pairs:
        found = text.calls(e, SUPPORTED)
        if a and len(found) == 1 and (found[0].start, found[0].end) == (0, len(e)):
            of_alias[a.lower()] = agg(found[0], a)

    def rewritten(sql: str, alias: str | None = None, resolve: bool = False) -> str:
        out, at = "", 0
        for c in text.calls(sql, f"{SUPPORTED}|{ERRORS}"):
            out += grouped(sql[at : c.start], resolve)
            at = c.end
            if c.name in errors.FUNCTIONS:
                made.uses_errors = True
                inner = text.calls(c.arg, SUPPORTED)
                a = of_alias.get(c.arg.strip("`").lower()) or (agg(inner[0], None) if inner and inner[0].start == 0 and inner[0].end == len(c.arg) else None)
                if a is None:
                    raise UnresolvedError(f"{c.name}({c.arg}): there is no aggregate of that name in the select list")
                out += errors.column(c.name, a.alias)
            else:
                out += agg(c, alias).alias
        return out + grouped(sql[at:], resolve)

    def grouped(part: str, resolve: bool) -> str:
        """Grouping expressions, and aliases of the select list in HAVING, by their columns."""
        for i, g in sorted(enumerate(made.groups), key=lambda x: -len(x[1])):
            bare = re.escape(g) if not re.fullmatch(r"[\w.`]+", g) else rf"(?<![\w.`]){re.escape(g)}(?![\w.`(])"
            if not re.fullmatch(r"[\w.`]+", g) and g[:1].isalnum():
                bare = rf"\b{bare}"
            part = _outside(part, re.compile(bare, re.I), f"g{i}")
            if "." in g and re.fullmatch(r"[\w.`]+", g):
                last = g.rpartition(".")[2]
                part = _outside(part, re.compile(rf"(?<![\w.`]){re.escape(last)}(?![\w.`(])", re.I), f"g{i}")
        if resolve:
            for a, x in of_alias.items():
                part = _outside(part, re.compile(rf"`{re.escape(a)}`|(?<![\w.`]){re.escape(a)}(?![\w.`(])", re.I), x.alias)
        return part

    for e, a in pairs:
        name = a
        if name is None:
            c = text.calls(e, ERRORS)
            whole_call = len(c) == 1 and (c[0].start, c[0].end) == (0, len(e))
            name = errors.display_name(c[0].name, c[0].arg) if whole_call else e if text.calls(e, SUPPORTED) else e.rpartition(".")[2].strip("`")
        made.items.append((rewritten(e, a), name))
    made.having = rewritten(block.having, resolve=True) if block.having else ""
    order = []
    for o in text.split_top(block.order):
        m = re.match(r"(.*?)(\s+(?:asc|desc))?(\s+nulls\s+(?:first|last))?$", o, re.I | re.S)
        key = m[1].strip()
        if key.isdigit() or key.lower() in by_alias:
            order.append(o)
        else:
            order.append(rewritten(key) + (m[2] or "") + (m[3] or ""))
    made.order = ", ".join(order)
    return made


def _outside(part: str, pattern: re.Pattern, put: str) -> str:
    """Replace matches that are not in literals."""
    mask, out, at = text.masked(part), "", 0
    for m in pattern.finditer(part):
        if "\x01" in mask[m.start() : m.end()] and not "'" in m[0]:
            continue
        out += part[at : m.start()] + put
        at = m.end()
    return out + part[at:]


def where_columns(where: str) -> set[str]:
    """Both sides of the comparisons of a filter, literals aside."""
    out = set()
    if not where:
        return out
    for part in re.split(r"\b(?:and|or|not)\b", text.masked(where), flags=re.I):
        for side in re.split(r"<=>|<=|>=|<>|!=|=|<|>|\bbetween\b|\bin\b|\blike\b|\bis\b", part, flags=re.I):
            side = side.strip()
            while side.startswith("(") and side.endswith(")"):
                side = side[1:-1].strip()
            side = side.strip("()") if side.count("(") != side.count(")") else side
            if side and re.search(r"[A-Za-z_]", side) and "\x01" not in side and not re.fullmatch(r"(?:null|true|false|date|timestamp|interval).*", side, re.I):
                out.add(normal(side))
    return out
