"""Tabular environments: rows, cells and spans."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from paperlake.functions import lexing

from .macros import Input

if TYPE_CHECKING:
    from .kernel import Parser

_RULES = re.compile(
    r"\\(?:hline|toprule|midrule|bottomrule|hdashline|endhead|endfoot|endfirsthead|endlastfoot|noalign\s*\{[^{}]*\}|Xhline\s*\{[^{}]*\}|addlinespace(?:\s*\[[^\]]*\])?|specialrule(?:\s*\{[^{}]*\}){3}"
    r"|(?:cline|cdashline)\s*\{[^{}]*\}|cmidrule\s*(?:\[[^\]]*\])?\s*(?:\([^)]*\))?\s*\{[^{}]*\}|(?:rowcolor|columncolor|cellcolor)\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}(?:\s*\[[^\]]*\]){0,2})(?![a-zA-Z])\s*"
)
_CUT = re.compile(r"\\(begin|end)\s*\{[^{}]*\}|\\\\(?:\*|\s*\[[^\]]*\])?|\\tabularnewline(?![a-zA-Z])|\\.|[{}&]", re.S)


def rows(body: str) -> list[list[str]]:
    """Raw cells of each row: cut at unescaped \\\\ and & outside braces and inner environments."""
    out, row, at, depth = [], [], 0, 0
    for m in _CUT.finditer(body):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif m[1]:
            depth += 1 if m[1] == "begin" else -1
        elif depth == 0 and c == "&":
            row.append(body[at : m.start()])
            at = m.end()
        elif depth == 0 and (c.startswith("\\\\") or c == "\\tabularnewline"):
            out.append([*row, body[at : m.start()]])
            row, at = [], m.end()
    out.append([*row, body[at:]])
    return [[_RULES.sub("", c).strip() for c in r] for r in out]


def span(cell: str) -> tuple[str, int, int]:
    """Content, rowspan and colspan of a cell, spans within spans included."""
    across = down = 1
    while m := re.match(r"\\(multicolumn|multirow)\s*(?:\[[^\]]*\])?\s*\{\s*(-?\d+|\*)\s*\}", cell):
        source = Input(cell[m.end() :])
        source.block("[")
        width = source.block()
        if width is None:
            source.match(re.compile(r"\s*\*"))
        source.block("[")
        content = source.block()
        if content is None:
            break
        n = abs(int(m[2])) if m[2] != "*" else 1
        across, down = (n, down) if m[1] == "multicolumn" else (across, n)
        cell = _RULES.sub("", content).strip()
    return cell, down, across


def cell_value(parser: Parser, raw: str):
    raw, down, across = span(raw)
    if m := re.fullmatch(r"\\(?:makecell|shortstack)\s*(?:\[[^\]]*\]\s*)?\{(.*)\}", raw, re.S):
        raw = m[1]
    found = parser.parse(raw)
    if not found:
        value = None
    elif len(found) == 1 and found[0]["type"] == "text" and "styles" not in found[0]:
        value = found[0]["content"].strip()
    else:
        value = found
    if down > 1 or across > 1:
        return {"content": value, "rowspan": down, "colspan": across}
    return value


def tabular(parser: Parser, name: str, body: str) -> dict | None:
    source = Input(body)
    if name.rstrip("*") in ("tabularx", "tabulary") or name == "tabular*":
        source.block()
    source.block("[")
    columns = source.block() or ""
    found = [[cell_value(parser, c) for c in r] for r in rows(source.text[source.at :]) if any(r) or len(r) > 1]
    empty = lambda r: all(c is None for c in r)
    if found and empty(found[0]):
        found = found[1:]
    if found and empty(found[-1]):
        found = found[:-1]
    return {"type": "tabular", "environment": name, "column_spec": lexing.one_line(columns), "content": found} if found else None
