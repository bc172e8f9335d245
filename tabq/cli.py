"""Command line: delimited text on stdin, one query, CSV or JSON on stdout."""

from __future__ import annotations

import shutil
import sys
import tempfile
from dataclasses import dataclass

from . import __version__
from .errors import SqlError, TabqError, UsageError

USAGE = """Usage: tabq [OPTIONS] <query>

Reads delimited text with a header row from stdin into table t and prints the query's result.

  -d, --delimiter <char>   input delimiter, one byte or \\t (default ,)
      --tsv                same as --delimiter '\\t'
      --no-type-inference  all columns are text
  -H, --header             print a header row
      --json               print a JSON array of objects
  -h, --help               this text
  -V, --version            version

Exit codes: 0 success, 1 usage, 2 input, 3 SQL.
"""


@dataclass
class Options:
    query: str = ""
    delimiter: str = ","
    infer: bool = True
    header: bool = False
    json: bool = False
    show: str = ""  # help or version


def parse_args(argv: list[str]) -> Options:
    o, query, delimited, i = Options(), None, False, 0
    while i < len(argv):
        a = argv[i]
        if a in ("-h", "--help", "-V", "--version"):
            return Options(show="help" if a in ("-h", "--help") else "version")
        if a == "--tsv":
            o.delimiter, delimited = "\t", True
        elif a in ("-d", "--delimiter") or a.startswith("--delimiter="):
            if "=" in a and a.startswith("--"):
                d = a.split("=", 1)[1]
            else:
                i += 1
                if i >= len(argv):
                    raise UsageError("--delimiter needs a value")
                d = argv[i]
            from .sources.delimited import check_delimiter

            o.delimiter, delimited = check_delimiter(d), True
        elif a == "--no-type-inference":
            o.infer = False
        elif a in ("-H", "--header"):
            o.header = True
        elif a == "--json":
            o.json = True
        elif a.startswith("-") and len(a) > 1 and query is None and not a[1:2].isspace() and not a.startswith("-- "):
            raise UsageError(f"unknown option: {a}")
        elif query is None:
            query = a
        i += 1
    if o.json and (delimited or o.header):
        raise UsageError("--json cannot be combined with --delimiter, --tsv or --header")
    if query is None:
        raise UsageError("missing query")
    o.query = query
    return o


def run(o: Options, source, out, spark=None) -> None:
    from . import session, sinks
    from .engine import Engine

    with tempfile.NamedTemporaryFile(suffix=".csv") as spool:
        shutil.copyfileobj(source, spool)
        spool.flush()
        engine = Engine(spark or session.build(cores="2", **{"spark.sql.shuffle.partitions": "4", "spark.log.level": "OFF"}))
        engine.load(f"file://{spool.name}", delimiter=o.delimiter, infer=o.infer)
        df = engine.sql(o.query)
        try:
            if o.json:
                sinks.to_json(df, out) if df is not None else out.write("[]\n")
            elif df is not None:
                sinks.to_csv(df, out, o.header)
        except TabqError:
            raise
        except Exception as e:
            raise SqlError(str(e).splitlines()[0]) from e


def main(argv: list[str] | None = None, source=None, out=None, err=None, spark=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        o = parse_args(sys.argv[1:] if argv is None else argv)
        if o.show:
            err.write(USAGE if o.show == "help" else f"tabq {__version__}\n")
            return 0
        run(o, source or sys.stdin.buffer, out, spark)
    except UsageError as e:
        err.write(f"error: {e}\n{USAGE}")
        return e.code
    except TabqError as e:
        err.write(f"error: {e}\n")
        return e.code
    return 0
