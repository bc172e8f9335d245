"""Delimited text as a typed DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CsvError, UsageError
from ..session import shared_dir
from . import infer as I
from .scanner import block_records, ends_both, ends_inside, records

ROWID = "__rowid"
#: Characters of a record over block edges, which is put together by the driver; beyond that a quote is taken to be unterminated.
MAX_OPEN = 256 << 20


@dataclass
class Loaded:
    df: DataFrame
    columns: list[tuple[str, str]]  # (name, int | real | text)


def check_delimiter(d: str) -> str:
    d = "\t" if d == "\\t" else d
    if len(d.encode()) != 1 or d in "\r\n":
        raise UsageError("delimiter must be a single byte other than a line break")
    return d


def with_rowid(df: DataFrame, name: str = ROWID) -> DataFrame:
    """A dense 1-based number in partition order; a row a partition comes to the driver."""
    marked = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if len(offsets) <= 1:
        return marked.withColumn(name, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m")
    o = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p long, __o long"))
    out = marked.join(o, part == F.col("__p")).withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return out.drop("__m", "__p", "__o")


def with_file_rowid(df: DataFrame, normal, name: str = ROWID) -> DataFrame:
    """A dense 1-based number by file name and place in the file, for a frame of Parquet files, after `normal`; a row a file comes to the driver."""
    meta = df.metadataColumn("_metadata")
    marked = normal(df.select("*", meta["file_path"].alias("__f"), meta["row_index"].alias("__m")))
    offsets, total = [], 0
    for f, n in sorted((r[0], r[1]) for r in marked.groupBy("__f").count().collect()):
        offsets.append((f, total))
        total += n
    if len(offsets) <= 1:
        return marked.withColumn(name, F.col("__m") + 1).drop("__f", "__m")
    o = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p string, __o long"))
    return marked.join(o, F.col("__f") == F.col("__p")).withColumn(name, F.col("__o") + F.col("__m") + 1).drop("__f", "__m", "__p", "__o")


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _blocks(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of each file block of a partition; a block's lines come one after another."""
    key, held = None, []
    for b in batches:
        for v, f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if key != (f, s):
                if key is not None:
                    yield (*key, held)
                key, held = (f, s), []
            held.append(v)
    if key is not None:
        yield (*key, held)


def _quoted_cells(spark: SparkSession, path, delimiter: str) -> DataFrame:
    """file, start, n, cells for each record of text with quotes; exact for quotes over line and block ends.

    Records are parsed once, into Parquet in the shared folder: header, sample, type check and queries read them there.
    """
    blocks = _blocks(_lines(spark, path))

    def states(batches):
        for f, s, lines in _grouped(batches):
            a, b = ends_both(lines, delimiter)
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([s], pa.int64()), pa.array([a]), pa.array([b])], ["file", "start", "a", "b"])

    inside: dict[tuple[str, int], bool] = {}
    files: dict[str, bool] = {}
    for r in sorted(blocks.mapInArrow(states, "file string, start long, a boolean, b boolean").collect()):  # a row a block
        now = files.get(r.file, False)
        inside[r.file, r.start] = now
        files[r.file] = r.b if now else r.a
    begins = spark.sparkContext.broadcast(inside)

    def read(batches):
        for f, s, lines in _grouped(batches):
            head, rows, tail = block_records(lines, delimiter, begins.value[f, s])
            n = len(rows)
            kinds = [0] * n + [1] * (head is not None) + [2] * (tail is not None)
            cells = rows + [[x] for x in (head, tail) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(cells)), pa.array([s] * len(cells), pa.int64()), pa.array(list(range(1, len(cells) + 1)), pa.int64()), pa.array(kinds, pa.int32()), pa.array(cells, pa.list_(pa.string()))], ["file", "start", "n", "kind", "cells"])

    there = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    blocks.mapInArrow(read, "file string, start long, n long, kind int, cells array<string>").write.parquet(there)
    parsed = spark.read.parquet(there)
    whole = parsed.filter("kind = 0").drop("kind")
    if not any(inside.values()) and not any(files.values()):
        return whole
    pieces = sorted(parsed.filter("kind > 0").collect(), key=lambda r: (r.file, r.start, r.kind))  # two a block at most
    extra, open_ = [], {}
    for r in pieces:
        if r.kind == 1:
            at, text = open_.pop(r.file, (None, ""))
            text += r.cells[0]
            if len(text) > MAX_OPEN:
                raise CsvError(f"a quoted field is open for over {MAX_OPEN} characters: unterminated quoted field")
            if ends_inside(text.split("\n")[:-1], delimiter, False):
                open_[r.file] = (at, text)
            else:
                extra += [(r.file, at, 1 << 40, c) for c in records(text, delimiter)]
        else:
            open_[r.file] = (r.start, r.cells[0])
    if open_:
        f = min(open_)
        before = whole.filter((F.col("file") == f)).count() + sum(x[0] == f for x in extra)
        raise CsvError(f"row {before + 1}: unterminated quoted field")
    return whole.unionByName(spark.createDataFrame(extra, whole.schema)) if extra else whole


def _plain_cells(spark: SparkSession, path, delimiter: str) -> DataFrame:
    """The same for text without quotes: a split, JVM-side."""
    line = F.translate("value", "\r", "")
    quoted = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in delimiter)
    blocks = _blocks(_lines(spark, path))
    return blocks.select("file", "start", F.monotonically_increasing_id().alias("n"), F.split(line, quoted, -1).alias("cells"))


def _typed(cell: Column, kind: str) -> Column:
    """A cell as its column's type; a cell that does not fit is null."""
    c = F.nullif(cell, F.lit(""))
    if kind == "text":
        return c
    bare = F.regexp_replace(c, "_", "")
    if kind == "int":
        return F.when(c.rlike(r"^[+-]?[0-9](?:_?[0-9])*$"), bare.try_cast("bigint"))
    hexed = F.when(c.rlike("(?i)^[+-]?0x[0-9a-f]{1,15}$"), F.conv(F.regexp_extract(c, "(?i)0x(.*)", 1), 16, 10).try_cast("double") * F.when(c.startswith("-"), -1).otherwise(1))
    named = F.when(c.rlike("(?i)^[+-]?inf(inity)?$"), F.when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.coalesce(hexed, named, F.when(c.rlike(I.REAL), bare.try_cast("double")))


def read_delimited(spark: SparkSession, path, delimiter: str = ",", infer: bool = True, dirty: str = "promote", quotes: bool | None = None) -> Loaded:
    """Columns named by the header and typed by the first 100 records.

    Short records are padded with NULL, long ones cut; empty cells are NULL; a blank line is a record of NULLs. A cell
    later than the sample that does not fit its column is handled by `dirty`: "promote" makes the column real or text,
    "strict" raises, "null" drops the cell's value without the extra pass over the data. `quotes` says whether the
    text has quotes at all (None: look). Each file of a directory starts with the header.
    """
    delimiter = check_delimiter(delimiter)
    if dirty not in ("promote", "strict", "null"):
        raise UsageError(f"no such policy: {dirty}")
    lines = _lines(spark, path)
    if quotes is None:
        quotes = delimiter != '"' and bool(lines.filter(F.col("value").contains('"')).take(1))
    cells = _quoted_cells(spark, path, delimiter) if quotes else _plain_cells(spark, path, delimiter)
    heads = cells.filter("start = 0").groupBy("file").agg(F.min_by(F.struct("n", "cells"), "n").alias("h")).orderBy("file")
    first = [(r.file, r.h.n, r.h.cells) for r in heads.collect()]  # a row a file
    if not first:
        raise CsvError("empty input (no header row)")
    names = I.header_names(first[0][2])
    if len(first) == 1:
        body = cells.filter((F.col("start") != 0) | (F.col("n") != first[0][1]))
    else:
        h = F.broadcast(spark.createDataFrame([(f, n) for f, n, _ in first], "file string, __h long"))
        body = cells.join(h, "file").filter((F.col("start") != 0) | (F.col("n") != F.col("__h"))).drop("__h")
    cell = [F.try_element_at("cells", F.lit(j + 1)) for j in range(len(names))]
    kinds = ["text"] * len(names)
    if infer:
        kinds = I.infer([r.cells for r in body.select("cells").limit(I.SAMPLE).collect()], len(names))
        if dirty != "null" and set(kinds) != {"text"}:
            bad = []
            for j, k in enumerate(kinds):
                full = F.nullif(cell[j], F.lit(""))
                bad.append(F.count_if(full.isNotNull() & _typed(cell[j], k).isNull() & ~full.rlike("(?i)^[+-]?nan$")).alias(f"a{j}"))
                bad.append(F.count_if(full.isNotNull() & ~full.rlike(I.REAL)).alias(f"b{j}"))
            found = body.agg(*bad).first()
            for j, k in enumerate(kinds):
                if k != "text" and found[f"a{j}"]:
                    if dirty == "strict":
                        raise CsvError(f"column {names[j]}: {found[f'a{j}']} cells are not of type {k}")
                    kinds[j] = "real" if not found[f"b{j}"] else "text"
    df = body.select(*[_typed(c, k).alias(n) for c, k, n in zip(cell, kinds, names)])
    return Loaded(df, list(zip(names, kinds)))
