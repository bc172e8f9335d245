"""Typed SQL fragments and the dialect's coercions, written as Spark SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from ..errors import SqlError

NUMERIC = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_WHOLE = re.compile(rf"\s*{NUMERIC}\s*$", re.A)
_PREFIX = re.compile(rf"\s*({NUMERIC})", re.A)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class E:
    """sql, its type (int real text blob null bool json), its affinity (int real text or None), a literal value, a collation."""

    sql: str
    type: str
    aff: str | None = None
    lit: Any = None
    coll: str | None = None


def string(s: str) -> str:
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0")
    return f"'{out}'"


def name(s: str) -> str:
    return "`" + s.replace("`", "``") + "`"


def literal(v) -> E:
    if v is None:
        return NULL
    if isinstance(v, bool):
        v = int(v)
    if isinstance(v, int):
        if -(1 << 63) <= v < 1 << 63:
            return E(f"{v}L" if v >= 0 else "(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"(-{-v}L)", "int", lit=v)
        v = float(v)
    if isinstance(v, float):
        if v != v:
            return NULL
        if v in (float("inf"), float("-inf")):
            return E(f"double('{'-' if v < 0 else ''}Infinity')", "real", lit=v)
        return E(f"{v!r}D" if v >= 0 else f"(-{-v!r}D)", "real", lit=v)
    return E(string(v), "text", lit=v)


NULL = E("NULL", "null")


def number_of(s: str) -> int | float | None:
    """The number a text fully spells, or None."""
    if not _WHOLE.match(s):
        return None
    s = s.strip()
    if re.fullmatch(r"[+-]?\d+", s, re.A) and -(1 << 63) <= int(s) < 1 << 63:
        return int(s)
    return float(s)


def prefix_number(s: str) -> int | float:
    m = _PREFIX.match(s)
    return number_of(m[1]) if m else 0


def real_text(x: str) -> str:
    """A double as text: 15 significant digits, always with a point (12.5, 3.0, 1.0e+15)."""
    m = f"format_string('%.14e', {x})"
    exponent = f"cast(substring_index({m}, 'e', -1) as int)"
    trim = lambda s: f"regexp_replace(regexp_replace({s}, '0+$', ''), '[.]$', '.0')"
    fixed = f"if({x} = 0, '0.0', {trim(f'format_string(concat(\'%.\', cast(14 - {exponent} as string), \'f\'), {x})')})"
    whole = f"concat(format_string('%.0f', {x}), '.0')"
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} = double('Infinity') THEN 'Inf' WHEN {x} = double('-Infinity') THEN '-Inf' WHEN {x} = 0 THEN '0.0' "
        f"WHEN {exponent} BETWEEN -5 AND 13 THEN {fixed} WHEN {exponent} = 14 THEN {whole} "
        f"ELSE concat({trim(f'substring_index({m}, \'e\', 1)')}, 'e', substring_index({m}, 'e', -1)) END"
    )


def value(e: E) -> E:
    """Predicates are the integers 0 and 1 when they are used as values."""
    return replace(e, sql=f"cast({e.sql} as bigint)", type="int") if e.type == "bool" else e


def text(e: E) -> E:
    e = value(e)
    if e.type in ("text", "json"):
        return replace(e, type="text")
    if e.type == "null":
        return E("cast(NULL as string)", "text")
    if e.type == "real":
        if isinstance(e.lit, float):
            from ..sinks import real_to_text

            return literal(real_to_text(e.lit))
        return E(real_text(e.sql), "text")
    if e.type == "blob":
        return E(f"decode({e.sql}, 'UTF-8')", "text")
    return E(f"cast({e.sql} as string)", "text")


def number(e: E) -> E:
    """The numeric value; texts count by their numeric prefix."""
    e = value(e)
    if e.type in ("int", "real"):
        return e
    if e.type == "null":
        return E("cast(NULL as bigint)", "int")
    if isinstance(e.lit, str):
        return literal(prefix_number(e.lit))
    t = text(e).sql
    return E(f"nvl2({t}, coalesce(try_cast(regexp_extract({t}, {string('^\\s*(' + NUMERIC + ')')}, 1) as double), 0D), cast(NULL as double))", "real")


def integer(e: E) -> E:
    """CAST AS INTEGER: prefixes of texts, reals cut and saturated."""
    e = value(e)
    if e.type == "int":
        return e
    if e.type == "null":
        return E("cast(NULL as bigint)", "int")
    if e.type == "real":
        x = e.sql
        return E(f"CASE WHEN {x} >= 9.2233720368547758e18D THEN 9223372036854775807L WHEN {x} <= -9.2233720368547758e18D THEN -9223372036854775807L - 1L ELSE cast({x} as bigint) END", "int")
    if isinstance(e.lit, str):
        m = re.match(r"\s*([+-]?\d+)", e.lit, re.A)
        return literal(max(-(1 << 63), min((1 << 63) - 1, int(m[1]))) if m else 0)
    t = text(e).sql
    digits = f"regexp_extract({t}, '^\\\\s*([+-]?[0-9]+)', 1)"
    return E(f"nvl2({t}, coalesce(try_cast({digits} as bigint), if({digits} = '', 0L, if({digits} like '-%', -9223372036854775807L - 1L, 9223372036854775807L))), cast(NULL as bigint))", "int")


def real(e: E) -> E:
    n = number(e)
    return n if n.type == "real" else E(f"{float(n.lit)!r}D" if isinstance(n.lit, int) and n.lit >= 0 else f"cast({n.sql} as double)", "real")


def truth(e: E) -> str:
    if e.type == "bool":
        return e.sql
    if e.type == "null":
        return "cast(NULL as boolean)"
    return f"({number(e).sql} <> 0)"


def typed(e: E) -> E:
    """A value with a definite Spark type."""
    e = value(e)
    return replace(e, sql="cast(NULL as string)") if e.type == "null" else e


def lower_ascii(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def collated(e: E, coll: str | None) -> str:
    if e.type not in ("text", "json") or not coll or coll == "binary":
        return e.sql
    if coll == "nocase":
        return lower_ascii(e.sql)
    if coll == "rtrim":
        return f"rtrim({e.sql})"
    raise SqlError(f"no such collation sequence: {coll}")


_CLASS = {"int": "number", "real": "number", "text": "text", "json": "json", "blob": "blob"}
#: Outcome of comparing any number with any text: numbers come first.
_NUMBER_FIRST = {"<": True, "<=": True, "<>": True, "=": False, ">": False, ">=": False}
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "<>": "<>"}
_ORDER = {"number": 0, "text": 1, "json": 1, "blob": 2}


def compare(op: str, left: E, right: E) -> E:
    """A comparison with the dialect's affinities; texts and numbers that stay apart compare by class."""
    a, b = value(left), value(right)
    if a.type == "null" or b.type == "null":
        return E("cast(NULL as boolean)", "bool")
    coll = left.coll or right.coll
    ca, cb = _CLASS[a.type], _CLASS[b.type]
    if {ca, cb} == {"number", "text"}:
        if cb == "number":
            return compare(_MIRROR[op], right, left)
        # a is the number, b the text
        if a.aff is None and b.aff == "text":
            a, ca = text(a), "text"
        elif a.aff in ("int", "real"):
            if isinstance(b.lit, str):
                n = number_of(b.lit)
                if n is not None:
                    b, cb = literal(n), "number"
            else:
                t = b.sql
                d = f"if({t} rlike {string('^\\s*' + NUMERIC + '\\s*$')}, try_cast(trim({t}) as double), cast(NULL as double))"
                return E(f"CASE WHEN {a.sql} IS NULL OR {t} IS NULL THEN NULL WHEN {d} IS NOT NULL THEN {a.sql} {op} {d} ELSE {str(_NUMBER_FIRST[op]).lower()} END", "bool")
    if "json" in (ca, cb) and "number" in (ca, cb):
        n, j, o = (a, b, op) if ca == "number" else (b, a, _MIRROR[op])
        d = f"try_cast({j.sql} as double)"
        return E(f"CASE WHEN {n.sql} IS NULL OR {j.sql} IS NULL THEN NULL WHEN {d} IS NOT NULL THEN {n.sql} {o} {d} ELSE {str(_NUMBER_FIRST[o]).lower()} END", "bool")
    if _ORDER[ca] != _ORDER[cb]:
        first = _NUMBER_FIRST[op] if _ORDER[ca] < _ORDER[cb] else _NUMBER_FIRST[_MIRROR[op]]
        return E(f"CASE WHEN {a.sql} IS NOT NULL AND {b.sql} IS NOT NULL THEN {str(first).lower()} END", "bool")
    return E(f"({collated(a, coll)} {op} {collated(b, coll)})", "bool")


def same(left: E, right: E) -> E:
    """IS: equality where NULLs are equal."""
    a, b = value(left), value(right)
    if b.type == "null":
        return E(f"({a.sql} IS NULL)", "bool")
    if a.type == "null":
        return E(f"({b.sql} IS NULL)", "bool")
    if _CLASS[a.type] == _CLASS[b.type]:
        coll = left.coll or right.coll
        return E(f"({collated(a, coll)} <=> {collated(b, coll)})", "bool")
    return E(f"(coalesce({compare('=', left, right).sql}, false) OR ({a.sql} IS NULL AND {b.sql} IS NULL))", "bool")


def common_type(kinds: list[str]) -> str:
    """The type that values of several kinds share: texts win over numbers, reals over integers."""
    kinds = ["int" if k == "bool" else "text" if k == "json" else k for k in kinds if k != "null"]
    if not kinds:
        return "text"
    if "text" in kinds:
        return "text"
    if "blob" in kinds:
        return "blob" if set(kinds) == {"blob"} else "text"
    return "real" if "real" in kinds else "int"


def cast_to(e: E, kind: str) -> E:
    e = value(e)
    if e.type == "null":
        return E(f"cast(NULL as {SPARK[kind]})", kind)
    if e.type == kind:
        return e
    return {"text": text, "real": real, "int": integer, "blob": lambda x: E(f"encode({text(x).sql}, 'UTF-8')", "blob")}[kind](e)


SPARK = {"int": "bigint", "real": "double", "text": "string", "json": "string", "blob": "binary", "null": "string", "bool": "boolean"}
