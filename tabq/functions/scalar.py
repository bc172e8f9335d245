"""Scalar functions of the dialect as Spark SQL expressions over typed fragments."""

from __future__ import annotations

import re

from ..dialect import values as V
from ..dialect.values import E, integer, literal, number, real, string, text, value
from ..errors import SqlError
from . import python

UDF_PREFIX = "tabq_"


def _nan_null(sql: str) -> E:
    return E(f"CASE WHEN NOT isnan({sql}) THEN {sql} END", "real")


def _unary_math(fn: str, domain: str | None = None):
    def make(a):
        x = real(a[0]).sql
        return E(f"CASE WHEN {domain.format(x=x)} THEN {fn}({x}) END", "real") if domain else _nan_null(f"{fn}({x})")

    return make


def _coalesce(args):
    args = [value(a) for a in args]
    kind = V.common_type([a.type for a in args])
    return E(f"coalesce({', '.join(V.cast_to(a, kind).sql for a in args)})", kind)


def _choose(c, a, b):
    kind = V.common_type([value(a).type, value(b).type])
    return E(f"if({V.truth(c)}, {V.cast_to(a, kind).sql}, {V.cast_to(b, kind).sql})", kind)


def _extreme(fn: str):
    def make(args):
        args = [value(a) for a in args]
        kind = V.common_type([a.type for a in args])
        if any(a.type == "null" for a in args):
            return V.NULL
        xs = [V.cast_to(a, kind).sql for a in args]
        return E(f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in xs)} THEN {fn}({', '.join(xs)}) END", kind)

    return make


def _substr(args):
    x, p = text(args[0]).sql, integer(args[1])
    if len(args) == 2:
        if isinstance(p.lit, int) and p.lit > 0:
            return E(f"substring({x}, {p.lit})", "text")
        q, n = f"cast({p.sql} as int)", f"char_length({x})"
        return E(f"CASE WHEN {q} > 0 THEN substring({x}, {q}) WHEN {q} = 0 THEN {x} ELSE substring({x}, greatest({n} + {q}, 0) + 1) END", "text")
    n = integer(args[2])
    if isinstance(p.lit, int) and p.lit > 0 and isinstance(n.lit, int) and n.lit >= 0:
        return E(f"substring({x}, {p.lit}, {n.lit})", "text")
    # first and end are zero-based bounds; a negative length takes the characters before the start
    q, k, size = p.sql, n.sql, f"cast(char_length({x}) as bigint)"
    start = f"if({q} > 0, {q} - 1L, if({q} < 0, {size} + {q}, -1L))"
    lo, hi = f"if({k} < 0, {start} + {k}, {start})", f"if({k} < 0, {start}, {start} + {k})"
    return E(f"CASE WHEN {x} IS NULL OR {q} IS NULL OR {k} IS NULL THEN NULL WHEN least({hi}, {size}) <= greatest({lo}, 0L) THEN '' ELSE substring({x}, cast(greatest({lo}, 0L) + 1 as int), cast(least({hi}, {size}) - greatest({lo}, 0L) as int)) END", "text")


def _length(args):
    a = value(args[0])
    return E(f"cast({'octet_length' if a.type == 'blob' else 'char_length'}({a.sql if a.type == 'blob' else text(a).sql}) as bigint)", "int")


def _trim(fn: str):
    def make(args):
        x = text(args[0]).sql
        if len(args) == 1:
            return E(f"{fn}({x})" if fn != "btrim" else f"trim({x})", "text")
        c = text(args[1]).sql
        side = {"btrim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[fn]
        return E(f"trim({side} {c} FROM {x})", "text")

    return make


def _round(args):
    x = real(args[0]).sql
    n = integer(args[1]).lit if len(args) > 1 else 0
    if n is None:
        raise SqlError("round() needs a constant number of digits")
    return E(f"round({x}, {max(0, n)})", "real")


def _abs(args):
    a = number(args[0])
    return E(f"abs({a.sql})", a.type)


def _sign(args):
    a = value(args[0])
    if a.type in ("text", "json"):
        x = f"try_cast({a.sql} as double)"
    else:
        x = number(a).sql
    return E(f"cast(sign({x}) as bigint)", "int")


def _whole(fn: str):
    def make(args):
        a = number(args[0])
        return a if a.type == "int" else E(f"{fn}({a.sql})", "real")

    return make


def _rounding(mode: str):
    def make(args):
        a = number(args[0])
        if a.type == "int":
            return a
        x = a.sql
        # beyond 2**53 a double is whole already
        return E(f"if(abs({x}) < 9.0e15D, cast({mode.format(x=x)} as double), {x})", "real")

    return make


def _log(args):
    if len(args) == 1:
        x = real(args[0]).sql
        return E(f"CASE WHEN {x} > 0 THEN log10({x}) END", "real")
    b, x = real(args[0]).sql, real(args[1]).sql
    return E(f"CASE WHEN {b} > 0 AND {b} <> 1 AND {x} > 0 THEN log({b}, {x}) END", "real")


def _mod(args):
    x, y = real(args[0]).sql, real(args[1]).sql
    return E(f"CASE WHEN {y} <> 0 THEN {x} % {y} END", "real")


def _quote(args):
    a = value(args[0])
    if a.type in ("text", "json"):
        return E(f"nvl2({a.sql}, concat('\\'', replace({a.sql}, '\\'', '\\'\\''), '\\''), 'NULL')", "text")
    if a.type == "blob":
        return E(f"nvl2({a.sql}, concat('X\\'', hex({a.sql}), '\\''), 'NULL')", "text")
    if a.type == "null":
        return literal("NULL")
    return E(f"coalesce({text(a).sql}, 'NULL')", "text")


def _typeof(args):
    a = value(args[0])
    if a.type == "null":
        return literal("null")
    kind = {"int": "integer", "real": "real", "text": "text", "json": "text", "blob": "blob"}[a.type]
    return E(f"nvl2({a.sql}, '{kind}', 'null')", "text")


def _hex(args):
    a = value(args[0])
    return E(f"coalesce(hex({a.sql if a.type == 'blob' else f'encode({text(a).sql}, \"UTF-8\")'.replace(chr(34), chr(39))}), '')", "text")


def _concat(args):
    return E(f"concat({', '.join(f'coalesce({text(a).sql}, \'\')' for a in args)})", "text")


def _concat_ws(args):
    return E(f"concat_ws({', '.join(text(a).sql for a in args)})", "text")


def _char(args):
    if all(isinstance(a.lit, int) for a in args):
        return literal("".join(chr(a.lit) if 0 <= a.lit <= 0x10FFFF else "�" for a in args))
    one = lambda x: f"CASE WHEN {x} BETWEEN 1 AND 127 THEN chr({x}) WHEN {x} IS NULL THEN '' ELSE {UDF_PREFIX}char({x}) END"
    return E(f"concat({', '.join(one(integer(a).sql) for a in args)})", "text")


def _soundex(args):
    """The first letter and three digits; unlike Spark's own, any letter without a digit parts equal ones."""
    x = f"regexp_replace({text(args[0]).sql}, '^[^A-Za-z]+', '')"
    out = f"translate(regexp_replace(upper({x}), '[^A-Z]', 'A'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for d in range(7):
        out = f"regexp_replace({out}, '{d}+', '{d}')"
    return E(f"if(coalesce({x}, '') = '', '?000', concat(upper(substring({x}, 1, 1)), rpad(substring(replace(substring({out}, 2), '0', ''), 1, 3), 3, '0')))", "text")


def glob_regex(pattern: str) -> str:
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))) > 0:
            body = pattern[i + 1 : j]
            neg, body = body[:1] == "^", body[1:] if body[:1] == "^" else body
            out.append("[" + "^" * neg + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = j
        else:
            out.append(re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", c))
        i += 1
    return "".join(out) + "$"


def glob(p: E, x: E) -> E:
    if isinstance(p.lit, str):
        return E(f"({text(x).sql} rlike {string(glob_regex(p.lit))})", "bool")
    return E(f"({text(x).sql} rlike {UDF_PREFIX}glob({text(p).sql}))", "bool")


def like(p: E, x: E, esc: E | None = None) -> E:
    """ASCII case-insensitive match."""
    escape = "\\u0001"
    if esc is not None:
        if not isinstance(esc.lit, str) or len(esc.lit) != 1:
            raise SqlError("ESCAPE expression must be a single character")
        escape = {"\\": "\\\\", "'": "\\'"}.get(esc.lit, esc.lit)
    if isinstance(p.lit, str):
        pattern = string(p.lit.translate(str.maketrans(V.UPPER, V.LOWER)))
    else:
        pattern = V.lower_ascii(text(p).sql)
    return E(f"({V.lower_ascii(text(x).sql)} LIKE {pattern} ESCAPE '{escape}')", "bool")


def _udf(name: str, kind: str = "text", convert=text):
    return lambda args: E(f"{UDF_PREFIX}{name}({', '.join(convert(a).sql for a in args)})", kind)


# -- JSON


def json_quote(a: E) -> str:
    """JSON text of a value; NULL gives null."""
    a = value(a)
    if a.type == "null":
        return "'null'"
    if a.type == "text":
        j = f"to_json(array({a.sql}))"
        return f"nvl2({a.sql}, substring({j}, 2, char_length({j}) - 2), 'null')"
    if a.type == "json":
        return f"coalesce({a.sql}, 'null')"
    return f"coalesce({text(a).sql}, 'null')"


def _constant(j: E, path: str) -> E | None:
    """What a constant document has at a path, as the value it is; None if it has to be found when the query runs."""
    try:
        v = python.find(python._load(j.lit), path)
    except ValueError:
        return None
    if v is None or v is python._MISSING:
        return V.NULL
    return literal(int(v) if isinstance(v, bool) else v) if isinstance(v, (bool, int, float, str)) else E(string(python._dump(v)), "json")


def _json_extract(args):
    if len(args) == 2 and isinstance(args[0].lit, str) and isinstance(args[1].lit, str) and (found := _constant(args[0], args[1].lit)) is not None:
        return found
    if len(args) == 2:
        return E(f"get_json_object({text(args[0]).sql}, {text(args[1]).sql})", "json")
    parts = [f"coalesce({UDF_PREFIX}json_arrow({text(args[0]).sql}, {text(p).sql}), 'null')" for p in args[1:]]
    return E(f"concat('[', {', \',\', '.join(parts)}, ']')", "text")


def _path(p: E) -> str:
    if isinstance(p.lit, str) and p.lit.startswith("$"):
        return string(p.lit)
    if isinstance(p.lit, int):
        return string(f"$[{p.lit}]" if p.lit >= 0 else f"$[#{p.lit}]")
    if isinstance(p.lit, str):
        return string("$." + p.lit)
    t = text(p).sql
    return f"if({t} like '$%', {t}, concat('$.', {t}))"


def arrow(j: E, p: E, quoted: bool) -> E:
    if quoted:
        return E(f"{UDF_PREFIX}json_arrow({text(j).sql}, {_path(p)})", "text")
    if isinstance(j.lit, str) and isinstance(p.lit, (str, int)) and (found := _constant(j, p.lit if isinstance(p.lit, str) and p.lit.startswith("$") else f"$[{p.lit}]" if isinstance(p.lit, int) and p.lit >= 0 else f"$.{p.lit}")) is not None:
        return found
    return E(f"get_json_object({text(j).sql}, {_path(p)})", "json")


def _json_array(args):
    return E(f"concat('[', {', \',\', '.join(json_quote(a) for a in args)}, ']')" if args else "'[]'", "text")


def _json_object(args):
    if len(args) % 2:
        raise SqlError("json_object() requires an even number of arguments")
    pairs = [f"concat({json_quote(text(k))}, ':', {json_quote(v)})" for k, v in zip(args[::2], args[1::2])]
    return E(f"concat('{{', {', \',\', '.join(pairs)}, '}}')" if pairs else "'{}'", "text")


def _json_edit(name: str):
    def make(args):
        rest = []
        for p, v in zip(args[1::2], args[2::2]):
            rest += [text(p).sql, json_quote(v)]
        return E(f"{UDF_PREFIX}json_edit('{name}', {text(args[0]).sql}, array({', '.join(rest)}))", "text")

    return make


def _json_length(args):
    path = text(args[1]).sql if len(args) > 1 else "'$'"
    return E(f"{UDF_PREFIX}json_length({text(args[0]).sql}, {path})" if len(args) > 1 else f"cast(CASE WHEN {text(args[0]).sql} IS NULL THEN NULL ELSE coalesce(json_array_length({text(args[0]).sql}), 0) END as bigint)", "int")


def _json_type(args):
    path = text(args[1]).sql if len(args) > 1 else "'$'"
    return E(f"{UDF_PREFIX}json_type({text(args[0]).sql}, {path})", "text")


# -- dates


def _moment(a: E) -> str:
    """A timestamp from ISO text, 'now', or a Julian day number."""
    if isinstance(a.lit, str):
        if a.lit.lower() == "now":
            return "current_timestamp()"
        if (n := V.number_of(a.lit)) is not None:
            a = literal(n)
    a = value(a)
    if a.type in ("int", "real"):
        return f"timestamp_millis(cast(round(({number(a).sql} - 2440587.5D) * 86400000D) as bigint))"
    t = text(a).sql
    # day 29 to 31 of a shorter month runs into the next one
    over = f"if({t} rlike '^[0-9]{{4}}-[0-9]{{2}}-(29|30|31)', timestampadd(DAY, cast(substring({t}, 9, 2) as int) - 1, try_cast(concat(substring({t}, 1, 8), '01', substring({t}, 11)) as timestamp)), NULL)"
    return f"coalesce(try_cast(if({t} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', {t}, if({t} rlike '^[0-9]{{2}}:[0-9]{{2}}', concat('2000-01-01 ', {t}), NULL)) as timestamp), {over})"


def _months(ts: str, n: int) -> str:
    """Whole months on; days past a month's end run into the next one."""
    k = f"(year({ts}) * 12 + month({ts}) - 1 + {n})"
    first = f"make_date(cast(floor({k} / 12) as int), cast(pmod({k}, 12) as int) + 1, 1)"
    return f"timestampadd(MICROSECOND, unix_micros({ts}) - unix_micros(date_trunc('DAY', {ts})), cast(date_add({first}, day({ts}) - 1) as timestamp))"


def moment(args: list[E]) -> str:
    if not args:
        return "current_timestamp()"
    mods = []
    for m in args[1:]:
        if not isinstance(m.lit, str):
            raise SqlError("date modifiers must be constant texts")
        mods.append(m.lit.strip().lower())
    if mods and mods[0] in ("unixepoch", "auto"):
        x = number(args[0]).sql
        ts = f"timestamp_micros(cast(round({x} * 1000000) as bigint))"
        mods = mods[1:]
    elif mods and mods[0] == "julianday":
        ts, mods = _moment(number(args[0])), mods[1:]
    else:
        ts = _moment(args[0])
    for m in mods:
        if g := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) *(second|minute|hour|day|month|year)s?", m):
            n = float(g[1])
            if g[2] in ("month", "year"):
                ts = _months(ts, int(n) * (12 if g[2] == "year" else 1))
            else:
                us = round(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[g[2]] * 1_000_000)
                ts = f"timestampadd(MICROSECOND, {us}L, {ts})"
        elif g := re.fullmatch(r"start of (day|month|year)", m):
            ts = f"date_trunc('{g[1].upper()}', {ts})"
        elif g := re.fullmatch(r"weekday ([0-6])(?:\.0)?", m):
            ts = f"timestampadd(DAY, cast(pmod({g[1]} - (dayofweek({ts}) - 1), 7) as int), {ts})"
        elif m in ("utc", "localtime", "subsec", "subsecond", "ceiling"):
            pass
        else:
            return "cast(NULL as timestamp)"
    return ts


def _dated(pattern: str) -> str:
    """Text that begins with a year; Spark writes a sign before years beyond 9999."""
    return f"trim(LEADING '+' FROM date_format({{t}}, '{pattern}'))"


_DAY = "cast(unix_micros({t}) as double) / 86400000000D + 2440587.5D"
_DIRECTIVES = {
    "Y": _dated("yyyy"),
    "m": "lpad(cast(month({t}) as string), 2, '0')",
    "d": "lpad(cast(day({t}) as string), 2, '0')",
    "e": "lpad(cast(day({t}) as string), 2, ' ')",
    "H": "lpad(cast(hour({t}) as string), 2, '0')",
    "k": "lpad(cast(hour({t}) as string), 2, ' ')",
    "I": "date_format({t}, 'hh')",
    "l": "lpad(date_format({t}, 'h'), 2, ' ')",
    "M": "lpad(cast(minute({t}) as string), 2, '0')",
    "S": "lpad(cast(second({t}) as string), 2, '0')",
    "f": "date_format({t}, 'ss.SSS')",
    "j": "lpad(cast(dayofyear({t}) as string), 3, '0')",
    "w": "cast(dayofweek({t}) - 1 as string)",
    "u": "cast(pmod(dayofweek({t}) + 5, 7) + 1 as string)",
    "s": "cast(unix_timestamp({t}) as string)",
    "p": "date_format({t}, 'a')",
    "P": "lower(date_format({t}, 'a'))",
    "F": _dated("yyyy-MM-dd"),
    "R": "date_format({t}, 'HH:mm')",
    "T": "date_format({t}, 'HH:mm:ss')",
    "W": "lpad(cast((dayofyear({t}) + 6 - pmod(dayofweek({t}) + 5, 7)) div 7 as string), 2, '0')",
    "U": "lpad(cast((dayofyear({t}) + 6 - (dayofweek({t}) - 1)) div 7 as string), 2, '0')",
    "V": "lpad(cast(weekofyear({t}) as string), 2, '0')",
    "G": "cast(extract(YEAROFWEEK FROM {t}) as string)",
    "g": "lpad(cast(extract(YEAROFWEEK FROM {t}) % 100 as string), 2, '0')",
}


def _strftime(args):
    f = args[0].lit
    if not isinstance(f, str):
        raise SqlError("strftime() needs a constant format")
    t, parts, i = moment(args[1:]), [], 0
    while i < len(f):
        if f[i] != "%":
            j = f.find("%", i)
            j = len(f) if j < 0 else j
            parts.append(string(f[i:j]))
            i = j
            continue
        c = f[i + 1 : i + 2]
        if c == "%":
            parts.append("'%'")
        elif c == "J":
            parts.append(V.real_text(_DAY.format(t=t)))
        elif c in _DIRECTIVES:
            parts.append(_DIRECTIVES[c].format(t=t))
        else:
            return V.NULL
        i += 2
    return E(f"nvl2({t}, concat({', '.join(parts)}), NULL)" if parts else "''", "text")


def _formatted(pattern: str):
    return lambda args: E(_dated(pattern).format(t=moment(args)), "text")


FUNCTIONS = {
    "length": _length,
    "octet_length": lambda a: E(f"cast(octet_length({text(a[0]).sql}) as bigint)", "int"),
    "lower": lambda a: E(V.lower_ascii(text(a[0]).sql), "text"),
    "upper": lambda a: E(f"translate({text(a[0]).sql}, '{V.LOWER}', '{V.UPPER}')", "text"),
    "substr": _substr,
    "substring": _substr,
    "instr": lambda a: E(f"cast(instr({text(a[0]).sql}, {text(a[1]).sql}) as bigint)", "int"),
    "replace": lambda a: E(f"if({text(a[1]).sql} = '', {text(a[0]).sql}, replace({text(a[0]).sql}, {text(a[1]).sql}, {text(a[2]).sql}))", "text"),
    "trim": _trim("btrim"),
    "ltrim": _trim("ltrim"),
    "rtrim": _trim("rtrim"),
    "concat": _concat,
    "concat_ws": _concat_ws,
    "printf": lambda a: E(f"{UDF_PREFIX}printf({text(a[0]).sql}, array({', '.join(json_quote(x) for x in a[1:])}))" if len(a) > 1 else f"{UDF_PREFIX}printf({text(a[0]).sql}, cast(array() as array<string>))", "text"),
    "char": _char,
    "unicode": lambda a: E(f"cast(if({text(a[0]).sql} = '', NULL, ascii({text(a[0]).sql})) as bigint)", "int"),
    "hex": _hex,
    "unhex": lambda a: E(f"try_to_binary({text(a[0]).sql}, 'hex')", "blob"),
    "quote": _quote,
    "zeroblob": lambda a: E(f"unhex(repeat('00', cast({integer(a[0]).sql} as int)))", "blob"),
    "randomblob": lambda a: E(f"substring(unhex(repeat(replace(uuid(), '-', ''), cast({integer(a[0]).sql} as int) div 16 + 1)), 1, cast({integer(a[0]).sql} as int))", "blob"),
    "soundex": _soundex,
    "like": lambda a: like(a[0], a[1], a[2] if len(a) > 2 else None),
    "glob": lambda a: glob(a[0], a[1]),
    "typeof": _typeof,
    "coalesce": _coalesce,
    "ifnull": _coalesce,
    "nullif": lambda a: E(f"CASE WHEN NOT coalesce({V.compare('=', a[0], a[1]).sql}, false) THEN {V.typed(a[0]).sql} END", V.typed(a[0]).type),
    "iif": lambda a: _choose(a[0], a[1], a[2] if len(a) > 2 else V.NULL),
    "if": lambda a: _choose(a[0], a[1], a[2] if len(a) > 2 else V.NULL),
    "max": _extreme("greatest"),
    "min": _extreme("least"),
    "likely": lambda a: a[0],
    "unlikely": lambda a: a[0],
    "likelihood": lambda a: a[0],
    "random": lambda a: E("xxhash64(uuid())", "int"),
    "changes": lambda a: literal(0),
    "total_changes": lambda a: literal(0),
    "last_insert_rowid": lambda a: literal(0),
    "sqlite_version": lambda a: literal("3.49.1"),
    "sqlite_source_id": lambda a: literal("tabq"),
    "sqlite_compileoption_used": lambda a: literal(0),
    "sqlite_compileoption_get": lambda a: V.NULL,
    "abs": _abs,
    "round": _round,
    "sign": _sign,
    "ceil": _rounding("ceil({x})"),
    "ceiling": _rounding("ceil({x})"),
    "floor": _rounding("floor({x})"),
    "trunc": _rounding("if({x} < 0, ceil({x}), floor({x}))"),
    "sqrt": _unary_math("sqrt", "{x} >= 0"),
    "exp": _unary_math("exp"),
    "ln": _unary_math("ln", "{x} > 0"),
    "log": _log,
    "log10": _unary_math("log10", "{x} > 0"),
    "log2": _unary_math("log2", "{x} > 0"),
    "pow": lambda a: _nan_null(f"power({real(a[0]).sql}, {real(a[1]).sql})"),
    "power": lambda a: _nan_null(f"power({real(a[0]).sql}, {real(a[1]).sql})"),
    "mod": _mod,
    "pi": lambda a: E("pi()", "real"),
    **{f: _unary_math(f) for f in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians", "atan")},
    "asin": _unary_math("asin", "abs({x}) <= 1"),
    "acos": _unary_math("acos", "abs({x}) <= 1"),
    "acosh": _unary_math("acosh", "{x} >= 1"),
    "atanh": _unary_math("atanh", "abs({x}) < 1"),
    "atan2": lambda a: E(f"atan2({real(a[0]).sql}, {real(a[1]).sql})", "real"),
    "date": _formatted("yyyy-MM-dd"),
    "time": _formatted("HH:mm:ss"),
    "datetime": _formatted("yyyy-MM-dd HH:mm:ss"),
    "julianday": lambda a: E(f"({_DAY.format(t=moment(a))})", "real"),
    "unixepoch": lambda a: E(f"unix_timestamp({moment(a)})", "int"),
    "strftime": _strftime,
    "timediff": lambda a: E(f"{UDF_PREFIX}timediff(date_format({moment(a[:1])}, 'yyyy-MM-dd HH:mm:ss.SSS'), date_format({moment(a[1:2])}, 'yyyy-MM-dd HH:mm:ss.SSS'))", "text"),
    "current_date": lambda a: E("date_format(current_timestamp(), 'yyyy-MM-dd')", "text"),
    "current_time": lambda a: E("date_format(current_timestamp(), 'HH:mm:ss')", "text"),
    "current_timestamp": lambda a: E("date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')", "text"),
    "json": _udf("json"),
    "json_valid": lambda a: E(f"cast({UDF_PREFIX}json_valid({text(a[0]).sql}) as bigint)", "int"),
    "json_quote": lambda a: E(json_quote(a[0]), "text"),
    "json_pretty": _udf("json_pretty"),
    "json_error_position": _udf("json_error_position", "int"),
    "json_extract": _json_extract,
    "json_array": _json_array,
    "json_object": _json_object,
    "json_array_length": _json_length,
    "json_type": _json_type,
    "json_set": _json_edit("set"),
    "json_insert": _json_edit("insert"),
    "json_replace": _json_edit("replace"),
    "json_remove": lambda a: E(f"{UDF_PREFIX}json_edit('remove', {text(a[0]).sql}, array({', '.join(text(p).sql for p in a[1:])}))", "text"),
    "json_patch": _udf("json_patch"),
}
FUNCTIONS["format"] = FUNCTIONS["printf"]
for _name in ("array", "object", "set", "insert", "replace", "remove", "patch", "extract"):
    FUNCTIONS[f"jsonb_{_name}"] = FUNCTIONS[f"json_{_name}"]
FUNCTIONS["jsonb"] = FUNCTIONS["json"]

#: Accepted numbers of arguments where they are fixed.
ARITY = {
    "length": (1,), "lower": (1,), "upper": (1,), "instr": (2,), "replace": (3,), "substr": (2, 3), "trim": (1, 2), "nullif": (2,), "ifnull": (2,), "abs": (1,), "round": (1, 2), "hex": (1,),
    "typeof": (1,), "sign": (1,), "sqrt": (1,), "pow": (2,), "power": (2,), "mod": (2,), "atan2": (2,), "log": (1, 2), "unicode": (1,), "quote": (1,), "json_valid": (1,), "json_quote": (1,), "json_patch": (2,), "glob": (2,), "like": (2, 3),
}


def call(name: str, args: list[E]) -> E:
    make = FUNCTIONS.get(name)
    if make is None:
        raise SqlError(f"no such function: {name}")
    if name in ARITY and len(args) not in ARITY[name]:
        raise SqlError(f"wrong number of arguments to function {name}()")
    try:
        return make(args)
    except IndexError:
        raise SqlError(f"wrong number of arguments to function {name}()") from None
