"""Writers: CSV rows, a JSON array of objects, and distributed CSV files."""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def real_to_text(x: float) -> str | None:
    """15 significant digits, always with a point or exponent: 12.5, 3.0, 1.0e+15, Inf. NaN is NULL."""
    if math.isnan(x):
        return None
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0.0"
    s = f"{x:.15g}"
    if "e" in s:
        m, e = s.split("e")
        return f"{m if '.' in m else m + '.0'}e{e[0]}{e[1:].zfill(2)}"
    return s if "." in s else s + ".0"


def quote_cell(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if re.search('[",\r\n]', s) else s


def cell_text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        t = real_to_text(v)
        return "NULL" if t is None else t
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    return str(v)


def csv_lines(columns: list[str], rows: Iterable, header: bool = False, raw_cells: bool = False) -> Iterator[str]:
    """Comma-separated lines; cells are quoted where needed unless raw_cells."""
    if header:
        yield ",".join(map(quote_cell, columns)) + "\n"
    q = (lambda s: s) if raw_cells else quote_cell
    for r in rows:
        yield ",".join("NULL" if v is None else q(cell_text(v)) for v in r) + "\n"


_ESCAPES = {'"': '\\"', "\\": "\\\\", "/": "\\/", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(s: str) -> str:
    return '"' + re.sub(r'["\\/\x00-\x1f]', lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def json_number(x: float) -> str:
    """Integral reals as integers, others as the shortest decimal without an exponent; infinities and NaN are null."""
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1 << 63:
        return str(int(x))
    s = repr(x)
    if "e" not in s:
        return s[:-2] if s.endswith(".0") else s
    from decimal import Decimal

    return format(Decimal(s), "f")


def json_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return json_number(v)
    return json_string(cell_text(v))


def json_array(columns: list[str], rows: Iterable) -> Iterator[str]:
    """Pieces of one line: an array of objects with the keys in column order (equal names repeat)."""
    keys = [json_string(c) for c in columns]
    yield "["
    for k, r in enumerate(rows):
        yield ("," if k else "") + "{" + ",".join(f"{a}:{json_value(v)}" for a, v in zip(keys, r)) + "}"
    yield "]\n"


def to_csv(df: DataFrame, out: io.TextIOBase, header: bool = False, raw_cells: bool = False) -> None:
    for line in csv_lines(df.columns, df.toLocalIterator(prefetchPartitions=True), header, raw_cells):
        out.write(line)


def to_json(df: DataFrame, out: io.TextIOBase) -> None:
    for piece in json_array(df.columns, df.toLocalIterator(prefetchPartitions=True)):
        out.write(piece)


def rendered(df: DataFrame) -> DataFrame:
    """All columns as the text that the CSV writer prints, NULL as null; JVM-side, for distributed files."""
    from .dialect.values import E, SPARK, name, text

    kinds = {v: k for k, v in SPARK.items() if k != "json" and k != "null"}
    cols = []
    for n, t in df.dtypes:
        kind = kinds.get(t, "int" if t in ("int", "smallint", "tinyint") else "real" if t.startswith(("float", "decimal")) else "text")
        x = f"cast({name(n)} as double)" if kind == "real" else name(n)
        cols.append(F.expr(text(E(x, kind)).sql).alias(n))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """One CSV file a partition, written by the executors."""
    rendered(df).write.mode("overwrite").option("header", header).option("nullValue", "NULL").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def line_frame(df: DataFrame) -> DataFrame:
    """One column `line` with the CSV line of each row."""
    from functools import reduce

    cells = [F.coalesce(F.when(F.col(f"`{c}`").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(f"`{c}`")), F.lit("NULL")) for c in df.columns]
    out = rendered(df)
    return out.select(reduce(lambda a, b: F.concat(a, F.lit(","), b), cells).alias("line"))


def json_frame(df: DataFrame) -> DataFrame:
    """One column `line` with the JSON object of each row, written by the executors."""
    keys = [json_string(c) for c in df.columns]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(["{" + ",".join(f"{k}:{json_value(v)}" for k, v in zip(keys, row)) + "}" for row in rows], pa.string())], ["line"])

    return df.mapInArrow(run, "line string")
