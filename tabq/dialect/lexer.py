"""Tokens of the embedded-database dialect."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import SqlError


class Token(NamedTuple):
    kind: str  # id, qid (double-quoted), str, int, real, blob, op, end
    text: str
    start: int
    end: int


_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))
  |(?P<blob>[xX]'[0-9A-Fa-f]*')
  |(?P<str>'(?:[^']|'')*')
  |(?P<qid>"(?:[^"]|"")*")
  |(?P<bid>\[[^\]]*\]|`(?:[^`]|``)*`)
  |(?P<int>0[xX][0-9A-Fa-f]+)
  |(?P<real>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
  |(?P<int2>\d+)
  |(?P<id>[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*)
  |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|==|!=|[-+*/%&|~<>=(),.;?])""",
    re.X | re.S,
)


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            raise SqlError(f'unrecognized token: "{sql[at : at + 10]}"')
        kind, text = m.lastgroup, m.group()
        if kind == "int2":
            kind = "int"
        elif kind == "str":
            text = text[1:-1].replace("''", "'")
        elif kind == "qid":
            text = text[1:-1].replace('""', '"')
        elif kind == "bid":
            kind, text = "bid", text[1:-1].replace("``", "`") if text[0] == "`" else text[1:-1]
        if kind != "space":
            out.append(Token(kind, text, m.start(), m.end()))
        at = m.end()
    out.append(Token("end", "", len(sql), len(sql)))
    return out
