"""Reading SQL text without a grammar: what is quoted, what is nested, where clauses begin."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_HIDE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)


def masked(sql: str) -> str:
    """sql with literals and comments blanked out, of the same length."""
    return _HIDE.sub(lambda m: "\x01" * len(m[0]) if m[0][0] in "'\"" else " " * len(m[0]), sql)


def depths(mask: str) -> list[int]:
    out, d = [], 0
    for c in mask:
        if c == ")":
            d -= 1
        out.append(d)
        if c == "(":
            d += 1
    return out


def closing(mask: str, start: int) -> int:
    """Where the parenthesis that opens at start closes."""
    d = 0
    for i in range(start, len(mask)):
        d += (mask[i] == "(") - (mask[i] == ")")
        if not d:
            return i
    raise ValueError("unbalanced parentheses")


def split_top(sql: str, separator: str = ",") -> list[str]:
    """Parts between separators that are neither nested nor quoted."""
    mask = masked(sql)
    at, depth = [-1], depths(mask)
    at += [i for i, c in enumerate(mask) if c == separator and not depth[i]]
    at.append(len(sql))
    return [sql[a + 1 : b].strip() for a, b in zip(at, at[1:]) if sql[a + 1 : b].strip()]


_CLAUSES = ("select", "from", "where", "group by", "having", "order by", "limit")
_KEYWORD = re.compile(r"\b(select|from|where|group\s+by|having|order\s+by|limit|union|intersect|except|minus|lateral|window|qualify|cluster\s+by|distribute\s+by|sort\s+by)\b", re.I)


class NotUnderstoodError(ValueError):
    """The query has a shape that is not rewritten; it runs exactly."""


@dataclass
class Block:
    """One SELECT: its clauses as text."""

    items: list[str]
    source: str
    where: str = ""
    group: list[str] = field(default_factory=list)
    having: str = ""
    order: str = ""
    limit: str = ""
    distinct: bool = False

    def sql(self, items: list[str] | None = None, source: str | None = None) -> str:
        out = f"SELECT {'DISTINCT ' * self.distinct}{', '.join(items or self.items)} FROM {source or self.source}"
        for word, text in (("WHERE", self.where), ("GROUP BY", ", ".join(self.group)), ("HAVING", self.having), ("ORDER BY", self.order), ("LIMIT", self.limit)):
            out += f" {word} {text}" * bool(text)
        return out


def block(sql: str) -> Block:
    mask = masked(sql)
    depth = depths(mask)
    found = [(re.sub(r"\s+", " ", m[1].lower()), m.start(), m.end()) for m in _KEYWORD.finditer(mask) if not depth[m.start()]]
    names = [f[0] for f in found]
    if not names or names[0] != "select" or "from" not in names or len(set(names)) < len(names) or any(n not in _CLAUSES for n in names):
        raise NotUnderstoodError(sql)
    parts = {n: sql[e : found[i + 1][1] if i + 1 < len(found) else len(sql)].strip() for i, (n, _, e) in enumerate(found)}
    select, distinct = parts["select"], False
    if m := re.match(r"distinct\b", select, re.I):
        select, distinct = select[m.end() :], True
    if re.search(r"\b(rollup|cube|grouping\s+sets)\b", masked(parts.get("group by", "")), re.I):
        raise NotUnderstoodError(sql)
    return Block(split_top(select), parts["from"], parts.get("where", ""), split_top(parts.get("group by", "")), parts.get("having", ""), parts.get("order by", ""), parts.get("limit", ""), distinct)


_ALIAS = re.compile(r"^(?P<expr>.*?)(?:\s+AS\s+|\s+)(?P<alias>`[^`]+`|[A-Za-z_]\w*)\s*$", re.I | re.S)


def aliased(item: str) -> tuple[str, str | None]:
    """An item of a select list: expression and alias."""
    mask = masked(item)
    m = _ALIAS.match(mask)
    if not m or depths(mask)[m.start("alias")] or re.fullmatch(r"end|desc|asc|null|true|false", m["alias"], re.I) or not m["expr"].strip():
        return item.strip(), None
    expr = item[: m.end("expr")].strip()
    if re.search(r"(\b(and|or|not|is|in|like|between|then|else|when|distinct)|[-+*/%<>=|,(])\s*$", masked(expr), re.I):
        return item.strip(), None
    return expr, item[m.start("alias") : m.end("alias")].strip("`")


@dataclass
class Call:
    name: str
    arg: str
    start: int
    end: int


def calls(sql: str, names: str) -> list[Call]:
    """Calls of functions whose name matches `names`, outermost first, none inside another."""
    mask, out, at = masked(sql), [], 0
    for m in re.finditer(rf"\b({names})\s*\(", mask, re.I):
        if m.start() < at:
            continue
        end = closing(mask, m.end() - 1)
        out.append(Call(m[1].lower(), sql[m.end() : end].strip(), m.start(), end + 1))
        at = end + 1
    return out


def unfiltered(sql: str, names: str) -> str:
    """Calls followed by FILTER (WHERE c) as calls whose argument is null where c does not hold."""
    for c in reversed(calls(sql, names)):
        m = re.compile(r"\s*filter\s*(\()\s*where\b", re.I).match(masked(sql), c.end)
        if not m or re.match(r"(distinct|all)\b", c.arg, re.I):
            continue
        end = closing(masked(sql), m.start(1))
        arg = "1" if c.arg == "*" else c.arg
        sql = f"{sql[: c.start]}{c.name}(CASE WHEN {sql[m.end() : end].strip()} THEN {arg} END){sql[end + 1 :]}"
    return sql


@dataclass
class TableRef:
    """A table or derived table in a FROM clause; span of the whole reference."""

    name: str | None
    query: str | None
    alias: str | None
    start: int
    end: int
    join: str  # how it joins what stands before it; empty for the first


_JOIN = re.compile(r"(?:\b(?P<kind>(?:natural\s+)?(?:inner|cross|(?:left|right|full)(?:\s+outer)?|(?:left\s+)?(?:semi|anti)))\s+)?\bjoin\b|,", re.I)
_AFTER = re.compile(r"\s+(?:as\s+)?(?!(?:on|using|join|inner|left|right|full|cross|semi|anti|natural|tablesample)\b)(`?\w+`?)", re.I)


def tables(source: str) -> list[TableRef]:
    mask = masked(source)
    depth = depths(mask)
    starts = [(0, "")] + [(m.end(), re.sub(r"\s+", " ", (m["kind"] or "inner").lower())) for m in _JOIN.finditer(mask) if not depth[m.start()]]
    out = []
    for at, join in starts:
        while mask[at : at + 1].isspace():
            at += 1
        if mask[at : at + 1] == "(":
            end = closing(mask, at) + 1
            name, query = None, source[at + 1 : end - 1]
        else:
            m = re.match(r"[`\w.]+", mask[at:])
            if not m:
                raise NotUnderstoodError(source)
            end = at + m.end()
            name, query = source[at:end].strip("`").lower(), None
            if mask[end : end + 1] == "(":
                raise NotUnderstoodError(source)
        a = _AFTER.match(mask, end)
        out.append(TableRef(name, query, source[a.start(1) : a.end(1)].strip("`") if a else None, at, a.end() if a else end, join))
    return out


def ctes(sql: str) -> tuple[dict[str, str], str]:
    """The named queries of a leading WITH, and the rest."""
    mask = masked(sql)
    m = re.match(r"\s*with\s+(?!error\b)", mask, re.I)
    if not m:
        return {}, sql
    at, out = m.end(), {}
    while n := re.compile(r"\s*(`?\w+`?)\s+as\s*(\()", re.I).match(mask, at):
        end = closing(mask, n.start(2))
        out[n[1].strip("`").lower()] = sql[n.end() : end]
        at = end + 1
        if not (c := re.compile(r"\s*,").match(mask, at)):
            break
        at = c.end()
    return out, sql[at:]
