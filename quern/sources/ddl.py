"""CREATE, DROP and TRUNCATE for sample and top-K tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_NAME = r"`?(?P<name>[\w.]+)`?"
_CREATE = re.compile(
    rf"^\s*CREATE\s+(?P<kind>SAMPLE|TOPK)\s+TABLE\s+(?P<if>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(?:ON\s+`?(?P<base>[\w.]+)`?|\((?P<schema>[^)]*(?:\([^)]*\)[^)]*)*)\))?\s*"
    r"(?:OPTIONS\s*\((?P<options>(?:[^()']|'(?:[^']|'')*'|\([^)]*\))*)\))?\s*(?:AS\s+(?P<query>.*))?$",
    re.I | re.S,
)
_USING = re.compile(rf"^\s*CREATE\s+TABLE\s+(?P<if>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*(?:\((?P<schema>.*)\))?\s*USING\s+(?P<kind>column_sample|topk)\s+OPTIONS\s*\((?P<options>.*)\)\s*(?:AS\s+(?P<query>.*))?$", re.I | re.S)
_DROP = re.compile(rf"^\s*(?P<verb>DROP|TRUNCATE)\s+(?P<kind>SAMPLE|TOPK)?\s*TABLE\s+(?P<if>IF\s+EXISTS\s+)?{_NAME}\s*$", re.I)
_OPTION = re.compile(r"`?(\w+)`?\s*=?\s*'((?:[^']|'')*)'")


@dataclass
class Statement:
    verb: str
    kind: str | None
    name: str
    base: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    query: str | None = None
    lenient: bool = False


def parse(sql: str) -> Statement | None:
    """The statement, or None if sql is something else."""
    sql = sql.strip().rstrip(";")
    for pattern in (_CREATE, _USING):
        if m := pattern.match(sql):
            g = m.groupdict()
            options = {k: v.replace("''", "'") for k, v in _OPTION.findall(g["options"] or "")}
            kind = "TOPK" if g["kind"].upper() == "TOPK" else "SAMPLE"
            return Statement("CREATE", kind, g["name"], g.get("base"), options, g.get("schema"), g.get("query"), bool(g["if"]))
    if m := _DROP.match(sql):
        return Statement(m["verb"].upper(), m["kind"].upper() if m["kind"] else None, m["name"], lenient=bool(m["if"]))
    return None
