"""Header rules and column types from the first records."""

from __future__ import annotations

import re

from ..errors import CsvError, SqlError

SAMPLE = 100
INTEGER = r"^[+-]?[0-9]+$"
REAL = r"^[+-]?(?:(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]|0[xX][0-9A-Fa-f]+)$"
_INTEGER, _REAL = re.compile(INTEGER, re.A), re.compile(REAL, re.A)


def header_names(cells: list[str]) -> list[str]:
    """Names without a BOM and outer blanks; repeated ones get _2, _3, ...; names that differ in case only are refused."""
    if cells:
        cells = [cells[0].removeprefix("﻿"), *cells[1:]]
    out, seen = [], {}
    for c in cells:
        name = c.strip(" \t\r")
        if not name:
            raise CsvError("row 1: empty column name in header")
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    if len({n.lower() for n in out}) < len(out):
        raise SqlError(f"duplicate column name: {next(n for i, n in enumerate(out) if n.lower() in {x.lower() for x in out[:i]})}")
    return out


def is_integer(s: str) -> bool:
    return bool(_INTEGER.match(s)) and not s.endswith("\n")


def is_real(s: str) -> bool:
    return bool(_REAL.match(s)) and not s.endswith("\n")


def infer(rows: list[list[str]], width: int) -> list[str]:
    """int, real or text for each column; empty cells do not count, and a column without any other is text."""
    out = []
    for j in range(width):
        cells = [r[j] for r in rows[:SAMPLE] if j < len(r) and r[j] != ""]
        if not cells or not all(is_integer(c) or is_real(c) for c in cells):
            out.append("text")
        else:
            out.append("int" if all(map(is_integer, cells)) else "real")
    return out
