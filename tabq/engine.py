"""The engine: relations, statements in the compat dialect or Spark SQL, pipelines."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import values as V
from .dialect.parser import N, parse, walk
from .dialect.translate import ROWIDS, Col, Query, Scope, Source, Table, Translator
from .errors import SqlError, TabqError
from .functions import python
from .session import checkpointed, pin
from .sources.delimited import read_delimited, with_file_rowid, with_rowid

_fresh = itertools.count()
MAX_ROUNDS, COMPACT = 100_000, 12


#: Aggregates that follow the order of rows where none is given.
ORDER_AWARE = {"group_concat", "string_agg", "json_group_array", "json_group_object", "jsonb_group_array", "jsonb_group_object"}


def needs_rowid(tree: N) -> bool:
    """Whether a statement names row numbers, or depends on the order of rows without an order of its own."""
    nodes = list(walk(tree))
    named = {k.lower(): w for x in nodes if x.kind == "core" for k, w in x.windows.items()}
    nodes += [y for w in named.values() for y in walk(w)]

    def ordered(w: N) -> bool:
        seen = set()
        while not w.order and w.base is not None and w.base.lower() in named and w.base.lower() not in seen:
            seen.add(w.base.lower())
            w = named[w.base.lower()]
        return bool(w.order)

    for x in nodes:
        if x.kind == "col" and x.name.lower() in ROWIDS:
            return True
        if x.kind == "func" and x.over is None and x.name in ORDER_AWARE and not x.order:
            return True
        if x.kind == "func" and x.over is not None and x.name in ("row_number", "ntile", "lag", "lead") and not ordered(x.over):
            return True
    return False


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "int"
    if isinstance(t, T.NumericType):
        return "real"
    return "blob" if isinstance(t, T.BinaryType) else "text"


def _moment_text(c: Column, pattern: str) -> Column:
    """ISO text; Spark writes a sign before years beyond 9999."""
    return F.ltrim(F.date_format(c, pattern), F.lit("+"))


def _normal(df: DataFrame) -> DataFrame:
    """bigint, double, string and binary columns: the dialect's types. Moments become ISO text, nested values JSON."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name.replace('`', '``')}`"), f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = _moment_text(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = _moment_text(c, "yyyy-MM-dd")
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif not isinstance(t, (T.LongType, T.DoubleType, T.StringType, T.BinaryType)):
            c = c.cast({"int": "bigint", "real": "double", "text": "string"}[_kind(t)])
        cols.append(c.alias(f.name))
    return df.select(*cols)


class Engine:
    """Relations by name; `t` is the one that loaders fill by default."""

    def __init__(self, spark: SparkSession):
        self.spark = pin(spark)
        self.frames: dict[str, DataFrame] = {}
        self._views: dict[tuple[str, bool], Table] = {}
        #: relations read from files that number their rows, as read
        self._files: dict[str, DataFrame] = {}
        if not getattr(spark, "_tabq_functions", False):
            python.register(spark)
            spark._tabq_functions = True

    # -- relations

    def register(self, name: str, df: DataFrame) -> "Engine":
        key = name.lower()
        self.frames[key] = _normal(df)
        self._files.pop(key, None)
        self._views = {k: v for k, v in self._views.items() if k[0] != key}
        return self

    def load(self, path, name: str = "t", delimiter: str = ",", infer: bool = True, dirty: str = "promote", quotes: bool | None = None) -> "Engine":
        return self.register(name, read_delimited(self.spark, path, delimiter, infer, dirty, quotes).df)

    def parquet(self, path, name: str = "t") -> "Engine":
        df = self.spark.read.parquet(path)
        self.register(name, df)._files[name.lower()] = df
        return self

    def _table(self, name: str, rowid: bool) -> Table:
        if (name, rowid) not in self._views:
            df = self.frames[name]
            view = f"tabq_{next(_fresh)}"
            if rowid:
                numbered = with_file_rowid(self._files[name], _normal) if name in self._files else with_rowid(df)
            (numbered if rowid else df).createOrReplaceTempView(view)
            self._views[name, rowid] = Table(view, [(f.name, _kind(f.dataType)) for f in df.schema.fields], rowid)
        return self._views[name, rowid]

    # -- statements

    def sql(self, query: str, mode: str = "compat") -> DataFrame | None:
        """The result of the first statement; None for statements that give no rows."""
        if mode == "spark":
            for name, df in self.frames.items():
                df.createOrReplaceTempView(name)
            return self.spark.sql(query)
        try:
            return self._compat(query)
        except TabqError:
            raise
        except RecursionError:
            raise SqlError("parser stack overflow") from None
        except PySparkException as e:
            raise SqlError(str(e).splitlines()[0]) from e

    def explain(self, query: str) -> str:
        df = self.sql(query)
        return "" if df is None else df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    def _translator(self, tree: N, rowid: bool = False) -> Translator:
        # row numbers cost a count of rows a partition, so only queries that may need them get them
        rowid = rowid or needs_rowid(tree)
        return Translator({n: self._table(n, rowid) for n in self.frames}, self._recurse)

    def _compat(self, query: str) -> DataFrame | None:
        tree = parse(query)
        if tree is None or tree.kind == "noop":
            return None
        if tree.kind == "explain":
            text = self._explained(tree, query)
            return self.spark.createDataFrame([(x,) for x in text.splitlines()], "detail string")
        tr = self._translator(tree)
        if tree.kind == "pragma":
            if tree.name != "table_info":
                return None
            return self._frame(tr.table_info(tree.arg or ""))
        if tree.kind == "select":
            q = tr.query(tree)
            return self._frame(self._translator(tree, rowid=True).query(tree) if tr.open_ties else q)
        q = self._changed(tree, tr)
        return None if q is None else self._frame(q)

    def _explained(self, tree: N, query: str) -> str:
        inner = re.sub(r"^\s*explain\s+(query\s+plan\s+)?", "", query, flags=re.I)
        return self.explain(inner)

    def _frame(self, q: Query) -> DataFrame:
        df = self.spark.sql(q.sql)
        return df.toDF(*[c.name for c in q.cols])

    def _recurse(self, first: str, step, distinct: bool, limit: int | None) -> str:
        """Rounds of a recursive query: each works on the rows the last one added, until none are new."""
        seen = self.spark.sql(first)
        seen = checkpointed(seen.distinct() if distinct else seen)
        fresh, total = seen, seen.count()
        for k in range(MAX_ROUNDS):
            if limit is not None and total >= limit:
                break
            view = f"tabq_work_{next(_fresh)}"
            fresh.createOrReplaceTempView(view)
            new = self.spark.sql(step(view)).toDF(*seen.columns)
            if distinct:
                on = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in seen.columns]
                new = new.distinct().alias("n").join(seen.alias("s"), on, "left_anti")
            fresh = checkpointed(new)
            self.spark.catalog.dropTempView(view)
            n = fresh.count()
            if n == 0:
                break
            seen, total = seen.unionByName(fresh), total + n
            if k % COMPACT == COMPACT - 1:
                seen = checkpointed(seen)  # one scan again, in place of one a round
        else:
            raise SqlError(f"recursion did not end after {MAX_ROUNDS} rounds")
        if limit is not None:
            seen = seen.limit(limit)
        out = f"tabq_rec_{next(_fresh)}"
        seen.createOrReplaceTempView(out)
        return out

    def _changed(self, n: N, tr: Translator) -> Query | None:
        """Rows that a data-changing statement would return; the relation itself stays as it is."""
        key = n.table.lower()
        if key not in self.frames:
            raise SqlError(f"no such table: {n.table}")
        t = tr.tables[key]
        for c in n.ctes:
            tr.cte(c)
        if n.kind == "insert":
            names = n.cols or [c for c, _ in t.cols]
            known = {c.lower(): i for i, (c, _) in enumerate(t.cols)}
            for c in names:
                if c.lower() not in known:
                    raise SqlError(f"table {n.table} has no column named {c}")
            if n.body is None:
                body, n_values = None, 0
            else:
                body = tr.query(n.body)
                if len(body.cols) != len(names):
                    raise SqlError(f"{len(body.cols)} values for {len(names)} columns" if n.cols else f"table {n.table} has {len(names)} columns but {len(body.cols)} values were supplied")
            items = []
            for i, (c, k) in enumerate(t.cols):
                at = next((j for j, x in enumerate(names) if x.lower() == c.lower()), None) if body is not None else None
                items.append(f"{_with_affinity(body.cols[at].e, f'_c{at}', k) if at is not None else f'cast(NULL as {V.SPARK[k]})'} AS {V.name(c)}")
            base = f"(SELECT {', '.join(items)}{f' FROM ({body.sql})' if body is not None else ''}) AS `x`"
            where = None
        else:
            scope = Scope()
            source = tr.from_(N("table", name=n.table, alias=n.get("alias")), scope)
            where = V.truth(tr.expr(n.where, scope)) if n.where is not None else None
            if n.kind == "update":
                known = {c.name.lower() for c in scope.sources[0].cols}
                new = {}
                for c, e in n.sets:
                    if c.lower() not in known:
                        raise SqlError(f"no such column: {c}")
                    new[c.lower()] = tr.expr(e, scope)
                items = []
                for c, k in zip(scope.sources[0].cols, (k for _, k in t.cols)):
                    e = new.get(c.name.lower())
                    items.append(f"{_with_affinity(V.typed(e), V.typed(e).sql, k) if e is not None else c.e.sql} AS {V.name(c.name)}")
                base = f"(SELECT {', '.join(items)} FROM {source}{f' WHERE {where}' if where else ''}) AS `x`"
            else:
                items = [f"{c.e.sql} AS {V.name(c.name)}" for c in scope.sources[0].cols]
                base = f"(SELECT {', '.join(items)} FROM {source}{f' WHERE {where}' if where else ''}) AS `x`"
        if n.returning is None:
            return None
        scope = Scope()
        scope.sources = [Source((n.get("alias") or n.table).lower(), [Col(c, V.E(f"`x`.{V.name(c)}", k, k)) for c, k in t.cols])]
        out, cols = [], []
        for it in n.returning:
            picks = [(c.name, c.e) for c in scope.sources[0].cols] if it.kind == "star" else [(it.alias or (it.expr.name if it.expr.kind == "col" else it.text), V.typed(tr.expr(it.expr, scope)))]
            for name, e in picks:
                cols.append(Col(name, V.replace(e, sql=f"_c{len(out)}")))
                out.append(f"{e.sql} AS _c{len(out)}")
        return Query(f"SELECT {', '.join(out)} FROM {base}", cols)

    # -- pipelines

    def pipe(self, queries: Sequence[str], name: str = "t", mode: str = "compat", reparse: bool = False) -> DataFrame | None:
        """Each query's result is the next one's `name`: one lazy plan. `reparse` infers types anew from the printed text, as a chain of processes would."""
        inner, out = Engine(self.spark), None
        inner.frames, inner._files = dict(self.frames), dict(self._files)
        for k, q in enumerate(queries):
            if k:
                inner.register(name, _reparsed(out) if reparse else out)
            out = inner.sql(q, mode)
            if out is None:
                return None
        return out


def _with_affinity(e: V.E, sql: str, kind: str) -> str:
    """A value stored in a column of a kind: numeric texts become numbers; what does not fit a number column is NULL here."""
    x = V.replace(e, sql=sql)
    if x.type == kind or kind == "text":
        return V.cast_to(x, kind).sql
    if x.type in ("text", "json"):
        return f"try_cast(trim({x.sql}) as {V.SPARK[kind]})"
    return V.cast_to(x, kind).sql


def _reparsed(df: DataFrame) -> DataFrame:
    from .sinks import rendered
    from .sources import infer as I
    from .sources.delimited import _typed

    text = rendered(df)
    text = text.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("NULL")).alias(c) for c in text.columns])
    kinds = I.infer([list(r) for r in text.limit(I.SAMPLE).collect()], len(text.columns))
    return text.select(*[_typed(F.col(f"`{c}`"), k).alias(c) for c, k in zip(text.columns, kinds)])
