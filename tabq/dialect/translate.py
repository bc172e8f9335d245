"""From the dialect's tree to Spark SQL text. Every output column of a query is named _c0, _c1, ...; names are put on at the end."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from ..errors import SqlError
from ..functions import python, scalar
from . import values as V
from .parser import N, walk
from .values import E, literal

AGGREGATES = {"count", "sum", "total", "avg", "group_concat", "string_agg", "json_group_array", "json_group_object", "jsonb_group_array", "jsonb_group_object"}
RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
ROWIDS = {"rowid", "oid", "_rowid_"}
ROWID = "__rowid"


@dataclass
class Col:
    name: str
    e: E


@dataclass
class Source:
    alias: str
    cols: list[Col]
    rowid: str | None = None
    hidden: set[str] = field(default_factory=set)  # dropped from * by USING
    table: bool = False  # a registered relation


@dataclass
class Table:
    """A registered relation: its view and columns (name, type)."""

    view: str
    cols: list[tuple[str, str]]
    rowid: bool = False


@dataclass
class Query:
    sql: str
    cols: list[Col]  # names and types; the sql of each is its _c name
    ordered: bool = False
    keyed: tuple[str, list[str]] | None = None  # the rows before ORDER BY and LIMIT, and their keys


class Scope:
    def __init__(self, parent: "Scope | None" = None):
        self.parent, self.sources, self.merged, self.aliases, self.busy = parent, [], {}, {}, set()


def is_aggregate(n: N) -> bool:
    return n.kind == "func" and n.over is None and (n.name in AGGREGATES or (n.name in ("min", "max") and len(n.args) == 1))


def has_aggregate(x) -> bool:
    """Whether an aggregate occurs outside of subqueries."""
    if isinstance(x, N):
        if x.kind == "select":
            return False
        return is_aggregate(x) or any(has_aggregate(v) for v in x.__dict__.values())
    return isinstance(x, (list, tuple)) and any(has_aggregate(v) for v in x)


class Translator:
    def __init__(self, tables: dict[str, Table], recurse=None):
        self.tables, self.recurse = tables, recurse
        self.ctes: list[dict[str, Query | N]] = [{}]
        #: whether a row was picked by min() or max() without row numbers, which decide between equal ones
        self.open_ties = False
        self.names = itertools.count()
        self.plain_in = False  # where NULL and false are alike: in the conjuncts and disjuncts of a condition
        self.agg = None  # in an aggregating core: (group expressions, how a bare column is read)

    # -- queries

    def query(self, n: N, parent: Scope | None = None) -> Query:
        self.ctes.append(dict(self.ctes[-1]))
        held, self.agg = self.agg, None
        try:
            for c in n.ctes:
                self.cte(c)
            return self.compound(n, parent)
        finally:
            self.ctes.pop()
            self.agg = held

    def cte(self, c: N) -> None:
        key = c.name.lower()
        uses_itself = any(x.kind == "table" and x.name.lower() == key for x in walk(c.body))
        if uses_itself and len(c.body.cores) > 1:
            q = self.recursive(c)
        else:
            q = self.query(c.body)
        if c.cols is not None:
            if len(c.cols) != len(q.cols):
                raise SqlError(f"table {c.name} has {len(q.cols)} values for {len(c.cols)} columns")
            q = Query(q.sql, [Col(a, k.e) for a, k in zip(c.cols, q.cols)])
        self.ctes[-1][key] = q

    def recursive(self, c: N) -> Query:
        """UNION ALL recursion is Spark's own; UNION and LIMIT inside go round by round through the engine."""
        body = c.body
        split = next((i for i, core in enumerate(body.cores) if any(x.kind == "table" and x.name.lower() == c.name.lower() for x in walk(core))), None)
        if not split:
            raise SqlError(f"circular reference: {c.name}")
        part = lambda cores, ops: N("select", ctes=body.ctes, cores=cores, ops=ops, order=[], limit=None, offset=None)
        start = self.query(part(body.cores[:split], body.ops[: split - 1]))
        names = c.cols or [k.name for k in start.cols]
        kinds = [V.common_type([k.e.type]) for k in start.cols]
        steps, kind = body.cores[split:], body.ops[split - 1]
        if body.order and body.limit is not None:  # without a limit the rows are the same in any order
            raise SqlError("ORDER BY with LIMIT inside a recursive query is not supported")
        # the types that settle when the step is applied once
        for _ in range(3):
            cols = [Col(a, E(f"_c{i}", k)) for i, (a, k) in enumerate(zip(names, kinds))]
            self.ctes[-1][c.name.lower()] = Query(f"SELECT {', '.join(f'cast(NULL as {V.SPARK[k]}) AS _c{i}' for i, k in enumerate(kinds))}", cols)
            probe = self.query(part(steps, body.ops[split:]))
            if len(probe.cols) != len(kinds):
                raise SqlError(f"SELECTs to the left and right of {kind.upper()} do not have the same number of result columns")
            wider = [V.common_type([a, b.e.type]) for a, b in zip(kinds, probe.cols)]
            if wider == kinds:
                break
            kinds = wider
        cols = [Col(a, E(f"_c{i}", k)) for i, (a, k) in enumerate(zip(names, kinds))]
        first = self.fitted(start, kinds)
        if kind == "union all" and body.limit is None and len(steps) == 1:
            view = f"__r{next(self.names)}"
            self.ctes[-1][c.name.lower()] = Query(f"SELECT * FROM {view}", cols)
            step = self.fitted(self.query(part(steps, [])), kinds)
            heads = ", ".join(f"_c{i}" for i in range(len(cols)))
            return Query(f"WITH RECURSIVE {view}({heads}) MAX RECURSION LEVEL 100000 AS ({first} UNION ALL {step}) SELECT * FROM {view}", cols)
        if self.recurse is None:
            raise SqlError("this recursive query needs an engine")
        limit = None
        if body.limit is not None:
            limit = self.expr(body.limit, Scope()).lit
            if not isinstance(limit, int):
                raise SqlError("LIMIT inside a recursive query must be a constant")

        def step(view: str) -> str:
            self.ctes.append(dict(self.ctes[-1]))
            try:
                self.ctes[-1][c.name.lower()] = Query(f"SELECT * FROM {view}", cols)
                return self.fitted(self.query(part(steps, body.ops[split:])), kinds)
            finally:
                self.ctes.pop()

        view = self.recurse(first, step, distinct=kind == "union", limit=limit if limit is not None and limit >= 0 else None)
        return Query(f"SELECT * FROM {view}", cols)

    def fitted(self, q: Query, kinds: list[str]) -> str:
        """A query with its columns cast to the given types."""
        if all(k.e.type == t for k, t in zip(q.cols, kinds)):
            return q.sql if q.sql.startswith("SELECT") and not q.ordered else f"SELECT * FROM ({q.sql})"
        items = ", ".join(f"{V.cast_to(replace(k.e, sql=f'_c{i}'), t).sql} AS _c{i}" for i, (k, t) in enumerate(zip(q.cols, kinds)))
        return f"SELECT {items} FROM ({q.sql})"

    def compound(self, n: N, parent: Scope | None) -> Query:
        if len(n.cores) == 1:
            return self.simple(n, parent)
        parts = [self.core(c, parent)[0] for c in n.cores]
        for p, op in zip(parts[1:], n.ops):
            if len(p.cols) != len(parts[0].cols):
                raise SqlError(f"SELECTs to the left and right of {op.upper()} do not have the same number of result columns")
        kinds = [V.common_type([p.cols[i].e.type for p in parts]) for i in range(len(parts[0].cols))]
        sql = self.fitted(parts[0], kinds)
        for p, op in zip(parts[1:], n.ops):  # all have one precedence, from the left
            sql = f"({sql}) {op.upper()} ({self.fitted(p, kinds)})"
        cols = [Col(k.name, E(f"_c{i}", t, t)) for i, (k, t) in enumerate(zip(parts[0].cols, kinds))]
        if n.order or n.limit is not None:
            scope = Scope()
            scope.sources = [Source("", cols)]
            keys = []
            for t in n.order:
                e = self.order_key(t, scope, cols, lambda x: self.expr(x, scope))
                keys.append(self.direction(t, e))
            sql = f"SELECT * FROM ({sql})" + (f" ORDER BY {', '.join(keys)}" if keys else "") + self.limits(n)
        return Query(sql, cols, bool(n.order))

    def direction(self, t: N, key: str) -> str:
        nulls = t.nulls or ("last" if t.desc else "first")  # NULL is the least value
        return f"{key} {'DESC' if t.desc else 'ASC'} NULLS {nulls.upper()}"

    def order_key(self, t: N, scope: Scope, cols: list[Col], make) -> str:
        e, coll = t.expr, None
        if e.kind == "collate":
            e, coll = e.e, e.name
        if e.kind == "int":
            if not 1 <= e.v <= len(cols):
                raise SqlError(f"ORDER BY term out of range - should be between 1 and {len(cols)}")
            return V.collated(replace(cols[e.v - 1].e, sql=f"_c{e.v - 1}"), coll)
        if e.kind == "col" and e.table is None:
            for i, c in enumerate(cols):
                if c.name.lower() == e.name.lower():
                    return V.collated(replace(c.e, sql=f"_c{i}"), coll)
        x = V.typed(make(e))
        return V.collated(x, coll or x.coll)

    def limits(self, n: N) -> str:
        out = ""
        if n.limit is not None:
            k = V.integer(self.expr(n.limit, Scope()))
            if k.lit is None or k.lit >= 0:
                out += f" LIMIT {min(k.lit, (1 << 31) - 1) if k.lit is not None else f'cast({k.sql} as int)'}"
        if n.offset is not None:
            k = V.integer(self.expr(n.offset, Scope()))
            if k.lit is None or k.lit > 0:
                out += f" OFFSET {k.lit if k.lit is not None else f'cast({k.sql} as int)'}"
        return out

    def simple(self, n: N, parent: Scope | None) -> Query:
        q, keys = self.core(n.cores[0], parent, n.order)
        if not n.order and n.limit is None:
            return q
        if not keys:
            return Query(q.sql + self.limits(n) if n.cores[0].kind == "core" else f"SELECT * FROM ({q.sql}){self.limits(n)}", q.cols)
        cols = ", ".join(f"_c{i}" for i in range(len(q.cols)))
        bare = [k.rsplit(" ", 3)[0] for k in keys]  # without direction and NULLS
        return Query(f"SELECT {cols} FROM ({q.sql}) ORDER BY {', '.join(keys)}{self.limits(n)}", q.cols, True, (q.sql, bare))

    # -- one SELECT

    def core(self, n: N, parent: Scope | None, order: list[N] = ()) -> tuple[Query, list[str]]:
        if n.kind == "values":
            rows = [[self.expr(e, Scope(parent)) for e in r] for r in n.rows]
            kinds = [V.common_type([V.value(r[i]).type for r in rows]) for i in range(len(rows[0]))]
            sql = f"SELECT * FROM VALUES {', '.join('(' + ', '.join(V.cast_to(e, k).sql for e, k in zip(r, kinds)) + ')' for r in rows)} AS v({', '.join(f'_c{i}' for i in range(len(kinds)))})"
            q = Query(sql, [Col(f"column{i + 1}", E(f"_c{i}", k)) for i, k in enumerate(kinds)])
            return q, [self.direction(t, self.order_key(t, Scope(), q.cols, lambda x: self.expr(x, Scope()))) for t in order]
        scope = Scope(parent)
        source = self.from_(n.source, scope) if n.source is not None else None
        windows = {k: self.chained(w, n.windows) for k, w in n.windows.items()}
        items: list[tuple[str, N | E]] = []
        for it in n.items:
            if it.kind == "star":
                found = [s for s in scope.sources if it.table is None or s.alias == it.table.lower()]
                if not found:
                    raise SqlError(f"no such table: {it.table}" if it.table else "no tables specified")
                for s in found:
                    for c in s.cols:
                        if it.table is None and c.name.lower() in s.hidden:
                            continue
                        items.append((c.name, N("frag", col=c, merged=c.name.lower() if it.table is None else None)))
            else:
                label = it.alias or (it.expr.name if it.expr.kind == "col" else it.text)
                items.append((label, it.expr))
                if it.alias:
                    scope.aliases.setdefault(it.alias.lower(), it.expr)
        where = self.condition(n.where, scope) if n.where is not None else None
        exprs = [e for _, e in items] + [t.expr for t in order] + ([n.having] if n.having is not None else [])
        special = [x for x in walk(exprs) if x.kind == "func" and x.over is not None and (w := self.window_of(x.over, windows)).frame is not None and (w.frame.unit == "groups" or w.frame.exclude)]
        if special:
            source, where = self.layered(special, windows, scope, source, where)
        grouped = bool(n.group) or any(has_aggregate(e) for e in exprs)
        groups = []
        if grouped:
            for g in n.group:
                if g.kind == "int" and 1 <= g.v <= len(items):
                    g = items[g.v - 1][1]
                groups.append(V.typed(self.expr(g, scope)))
        self.windows = windows
        held = self.agg
        if grouped:
            self.agg = ({g.sql: g for g in groups}, self.bare_reader(exprs, scope))
        try:
            out = [V.typed(self.expr(e, scope)) for _, e in items]
            having = self.condition(n.having, scope) if n.having is not None else None
            cols = [Col(name, replace(e, sql=f"_c{i}", lit=None)) for i, ((name, _), e) in enumerate(zip(items, out))]
            keys, extra = [], []
            for t in order:
                k = self.order_key(t, scope, cols, lambda e: self.expr(e, scope))
                if not (k.startswith("_c") and k[2:].isdigit()) and not k.startswith(("translate(_c", "rtrim(_c")):
                    extra.append(k)
                    k = f"_k{len(extra) - 1}"
                keys.append(self.direction(t, k))
        finally:
            self.agg = held
        select = ", ".join([f"{e.sql} AS _c{i}" for i, e in enumerate(out)] + [f"{k} AS _k{i}" for i, k in enumerate(extra)])
        tail = (f" FROM {source}" if source else "") + (f" WHERE {where}" if where else "")
        if groups:
            tail += f" GROUP BY {', '.join(g.sql for g in groups)}"
        if having:
            tail += f" HAVING {having}"
        if n.distinct and extra:
            # a key outside the list: the least one of each distinct row orders it
            named = ", ".join(f"_c{i}" for i in range(len(out)))
            mins = ", ".join(f"min(_k{i}) AS _k{i}" for i in range(len(extra)))
            return Query(f"SELECT {named}, {mins} FROM (SELECT {select}{tail}) GROUP BY {named}", cols), keys
        return Query(f"SELECT {'DISTINCT ' if n.distinct else ''}{select}{tail}", cols), keys

    def bare_reader(self, exprs, scope: Scope):
        """How a column outside GROUP BY is read: with one min() or max() from its row, else from the first row."""
        extremes = [x for x in walk(exprs) if is_aggregate(x) and x.name in ("min", "max")]
        kinds = {(x.name, repr(x.args)) for x in extremes}
        if len(kinds) == 1:
            x = extremes[0]

            def read(e: E) -> E:
                held, self.agg = self.agg, None
                by = V.typed(self.expr(x.args[0], scope)).sql
                self.agg = held
                ids = [s.rowid for s in scope.sources if s.rowid]
                if not ids:
                    self.open_ties |= any(s.table for s in scope.sources)
                    return replace(e, sql=f"if(count({by}) = 0, any_value({e.sql}), {x.name}_by({e.sql}, {by}))")
                # the first row of equal ones; the last where the argument is NULL in all
                sign, rows = "-" if x.name == "max" else "", f"struct({', '.join(ids)})"
                key = f"if({by} IS NULL, NULL, struct({', '.join([by] + [sign + i for i in ids])}))"
                return replace(e, sql=f"if(count({by}) = 0, max_by({e.sql}, {rows}), {x.name}_by({e.sql}, {key}))")

            return read
        rowid = next((s.rowid for s in scope.sources if s.rowid), None)
        return lambda e: replace(e, sql=f"min_by({e.sql}, {rowid})" if rowid else f"any_value({e.sql})")

    def chained(self, w: N, windows: dict[str, N]) -> N:
        if w.base is None or w.base not in windows:
            return w
        base = self.chained(windows[w.base], windows)
        return N("window", base=None, partition=w.partition or base.partition, order=w.order or base.order, frame=w.frame or base.frame)

    def window_of(self, over: N, windows: dict[str, N]) -> N:
        if over.base is None:
            return over
        if over.base not in windows:
            raise SqlError(f"no such window: {over.base}")
        return self.chained(N("window", base=over.base, partition=over.partition, order=over.order, frame=over.frame), windows)

    def layered(self, special: list[N], windows, scope: Scope, source: str | None, where: str | None):
        """Numbers peers and rows below, for GROUPS frames and EXCLUDE, which Spark lacks.

        The columns are renamed beneath the numbering, so that both windows ask for the same partitioning.
        """
        inner, at = [], 0
        for s in scope.sources:
            for c in s.cols:
                inner.append(f"{c.e.sql} AS _s{at}")
                c.e = replace(c.e, sql=f"_s{at}")
                at += 1
            if s.rowid:
                inner.append(f"{s.rowid} AS _s{at}")
                s.rowid = f"_s{at}"
                at += 1
        for k, e in scope.merged.items():
            inner.append(f"{e.sql} AS _s{at}")
            scope.merged[k] = replace(e, sql=f"_s{at}")
            at += 1
        specs: dict[str, tuple[str, str]] = {}
        adds = []
        for f in special:
            w = self.window_of(f.over, windows)
            spec = self.partition_order(w, scope)
            if spec not in specs:
                k = len(specs)
                specs[spec] = (f"__g{k}", f"__n{k}")
                ordered = spec if w.order else f"{spec} ORDER BY 1"
                adds += [f"dense_rank() OVER ({ordered}) AS __g{k}" if w.order else f"1 AS __g{k}", f"row_number() OVER ({ordered}) AS __n{k}"]
            f.over = N("window", base=None, partition=w.partition, order=w.order, frame=w.frame, marks=specs[spec])
        return f"(SELECT *, {', '.join(adds)} FROM (SELECT {', '.join(inner)} FROM {source}{f' WHERE {where}' if where else ''}))", None

    # -- FROM

    def from_(self, n: N, scope: Scope) -> str:
        if n.kind == "join":
            left = self.from_(n.left, scope)
            before = list(scope.sources)
            right = self.from_(n.right, scope)
            added = scope.sources[len(before) :]
            using = n.using
            if n.natural:
                mine = {c.name.lower() for s in before for c in s.cols}
                using = [c.name for s in added for c in s.cols if c.name.lower() in mine]
            how = {"inner": "INNER", "left": "LEFT OUTER", "right": "RIGHT OUTER", "full": "FULL OUTER"}[n.how]
            if using:
                conds = []
                for u in using:
                    k = u.lower()
                    a = scope.merged.get(k) or next((c.e for s in before for c in s.cols if c.name.lower() == k), None)
                    b = next((c.e for s in added for c in s.cols if c.name.lower() == k), None)
                    if a is None or b is None:
                        raise SqlError(f"cannot join using column {u} - column not present in both tables")
                    conds.append(V.compare("=", a, b).sql)
                    if n.how in ("right", "full"):
                        t = V.common_type([a.type, b.type])
                        scope.merged[k] = E(f"coalesce({V.cast_to(a, t).sql}, {V.cast_to(b, t).sql})", t, a.aff)
                    else:
                        scope.merged[k] = a
                    for s in added:
                        s.hidden.add(k)
                on = " AND ".join(conds)
            else:
                on = self.condition(n.on, scope) if n.on is not None else None
            if on is None:
                if n.how == "inner":
                    return f"{left} CROSS JOIN {right}"
                on = "true"
            return f"{left} {how} JOIN {right} ON {on}"
        if n.kind == "derived":
            q = self.query(n.body, scope.parent)
            return self.placed(q, n.alias or f"__d{next(self.names)}", scope)
        if n.kind == "tvf":
            return self.table_function(n, scope)
        key = n.name.lower()
        if key in self.ctes[-1]:
            return self.placed(self.ctes[-1][key], n.alias or n.name, scope)
        if key in ("sqlite_schema", "sqlite_master"):
            rows = ", ".join(f"('table', {V.string(k)}, {V.string(k)}, 0L, {V.string(self.ddl(k))})" for k in self.tables) or "(NULL, NULL, NULL, NULL, NULL)"
            cols = [Col(c, E(f"_c{i}", "int" if c == "rootpage" else "text")) for i, c in enumerate(("type", "name", "tbl_name", "rootpage", "sql"))]
            return self.placed(Query(f"SELECT * FROM VALUES {rows} AS v(_c0, _c1, _c2, _c3, _c4)" + ("" if self.tables else " WHERE false"), cols), n.alias or n.name, scope)
        t = self.tables.get(key)
        if t is None:
            raise SqlError(f"no such table: {n.name}")
        alias = (n.alias or n.name).lower()
        own = f"{alias}__{next(self.names)}"
        cols = [Col(c, E(f"{V.name(own)}.{V.name(c)}", k, k)) for c, k in t.cols]
        scope.sources.append(Source(alias, cols, f"{V.name(own)}.{ROWID}" if t.rowid else None, table=True))
        return f"{V.name(t.view)} AS {V.name(own)}"

    def ddl(self, table: str) -> str:
        kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
        return f"CREATE TABLE {table} ({', '.join(chr(34) + c.replace(chr(34), chr(34) * 2) + chr(34) + ' ' + kinds[k] for c, k in self.tables[table].cols)})"

    def placed(self, q: Query, alias: str, scope: Scope) -> str:
        own = f"{alias.lower()}__{next(self.names)}"
        cols = [Col(c.name, E(f"{V.name(own)}._c{i}", c.e.type, c.e.aff, coll=c.e.coll)) for i, c in enumerate(q.cols)]
        scope.sources.append(Source(alias.lower(), cols))
        return f"({q.sql}) AS {V.name(own)}"

    def table_function(self, n: N, scope: Scope) -> str:
        if n.name in ("json_each", "json_tree"):
            kinds = dict(key="text", value="json", type="text", atom="json", id="int", parent="int", fullkey="text", path="text")
            given = [self.expr(a, scope) for a in n.args]
            if all(isinstance(a.lit, str) for a in given):
                return self.placed(self.json_values(n.name, *(a.lit for a in given)), n.alias or n.name, scope)
            doc, root = V.text(given[0]).sql, V.text(given[1]).sql if len(given) > 1 else "'$'"
            alias = (n.alias or n.name).lower()
            own = f"{alias}__{next(self.names)}"
            cols = [Col(c, E(f"{V.name(own)}.{V.name(c)}", k)) for c, k in kinds.items()]
            scope.sources.append(Source(alias, cols))
            lateral = "LATERAL " if len(scope.sources) > 1 else ""
            return f"{lateral}{scalar.UDF_PREFIX}{n.name}({doc}, {root}) AS {V.name(own)}"
        if n.name == "pragma_table_info":
            q = self.table_info(str(self.expr(n.args[0], scope).lit))
            return self.placed(q, n.alias or n.name, scope)
        if n.name == "generate_series":
            a = [V.integer(self.expr(x, scope)).sql for x in n.args]
            q = Query(f"SELECT explode(sequence({', '.join(a)})) AS _c0", [Col("value", E("_c0", "int", "int"))])
            return self.placed(q, n.alias or n.name, scope)
        raise SqlError(f"no such table-valued function: {n.name}")

    def json_values(self, name: str, doc: str, root: str = "$") -> Query:
        """The rows of a constant document; keys, values and atoms have their own type where all rows share it."""
        try:
            rows = list(python.json_rows(doc, root, name == "json_tree"))
        except ValueError as e:
            raise SqlError(str(e)) from None
        heads, cols = ("key", "value", "type", "atom", "id", "parent", "fullkey", "path"), []
        for i, c in enumerate(heads):
            kinds = {type(r[i]) for r in rows if r[i] is not None}
            kind = "int" if c in ("id", "parent") or kinds and kinds <= {int, bool} else "real" if kinds == {float} else "json" if c in ("value", "atom") and kinds != {str} else "text"
            cols.append(Col(c, E(f"_c{i}", kind)))
        cell = lambda v, k: f"cast(NULL as {V.SPARK[k]})" if v is None else V.cast_to(literal(int(v) if isinstance(v, bool) else v), k).sql if k in ("int", "real") else V.string(python.json_text(v))
        body = ", ".join("(" + ", ".join(cell(v, c.e.type) for v, c in zip(r, cols)) + ")" for r in rows or [(None,) * 8])
        return Query(f"SELECT * FROM VALUES {body} AS v({', '.join(f'_c{i}' for i in range(8))})" + ("" if rows else " WHERE false"), cols)

    def table_info(self, table: str) -> Query:
        t = self.tables.get(table.lower())
        kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
        rows = ", ".join(f"({i}L, {V.string(c)}, '{kinds[k]}', 0L, cast(NULL as string), 0L)" for i, (c, k) in enumerate(t.cols if t else []))
        cols = [Col(c, E(f"_c{i}", k)) for i, (c, k) in enumerate((("cid", "int"), ("name", "text"), ("type", "text"), ("notnull", "int"), ("dflt_value", "text"), ("pk", "int")))]
        heads = ", ".join(f"_c{i}" for i in range(6))
        if not rows:
            return Query(f"SELECT * FROM VALUES (0L, '', '', 0L, cast(NULL as string), 0L) AS v({heads}) WHERE false", cols)
        return Query(f"SELECT * FROM VALUES {rows} AS v({heads})", cols)

    # -- expressions

    def column(self, n: N, scope: Scope) -> E:
        s, key = scope, n.name.lower()
        while s is not None:
            if n.table is not None:
                for src in s.sources:
                    if src.alias == n.table.lower():
                        for c in src.cols:
                            if c.name.lower() == key:
                                return c.e
                        if key in ROWIDS and src.rowid:
                            return E(src.rowid, "int", "int")
                        raise SqlError(f"no such column: {n.table}.{n.name}")
            else:
                if key in s.merged:
                    return s.merged[key]
                found = [c for src in s.sources for c in src.cols if c.name.lower() == key and key not in src.hidden]
                if len(found) > 1:
                    raise SqlError(f"ambiguous column name: {n.name}")
                if found:
                    return found[0].e
                if key in ROWIDS and not n.quoted:
                    ids = [src.rowid for src in s.sources if src.rowid]
                    if ids:
                        return E(ids[0], "int", "int")
                if key in s.aliases and key not in s.busy:
                    s.busy.add(key)
                    try:
                        return self.expr(s.aliases[key], s)
                    finally:
                        s.busy.discard(key)
            s = s.parent
        if n.quoted:
            return literal(n.name)
        raise SqlError(f"no such column: {n.table + '.' if n.table else ''}{n.name}")

    def condition(self, n: N, scope: Scope) -> str:
        """A condition that rows pass if it is true."""
        held, self.plain_in = self.plain_in, True
        try:
            return V.truth(self.expr(n, scope))
        finally:
            self.plain_in = held

    def expr(self, n: N, scope: Scope) -> E:
        if self.plain_in and n.kind not in ("and", "or", "insub"):
            self.plain_in = False
            try:
                return self.expr(n, scope)
            finally:
                self.plain_in = True
        if self.agg is not None and n.kind not in ("int", "real", "str", "null", "blob"):
            groups, bare = self.agg
            if not is_aggregate(n) and not (n.kind == "func" and n.over is not None) and n.kind not in ("scalar", "exists", "insub"):
                held, self.agg = self.agg, None
                try:
                    plain = self.expr(n, scope)
                finally:
                    self.agg = held
                t = V.typed(plain)
                if t.sql in groups:
                    return replace(plain, sql=t.sql, type=t.type)
                if n.kind in ("col", "frag"):
                    return plain if plain.lit is not None or has_aggregate(scope.aliases.get(n.get("name", "").lower())) else bare(plain)
        return getattr(self, f"e_{n.kind}")(n, scope)

    def e_frag(self, n, scope):
        # a column of *, as its source has it now
        return scope.merged.get(n.merged, n.col.e)

    def e_int(self, n, scope):
        return literal(n.v)

    e_real = e_str = e_int

    def e_null(self, n, scope):
        return V.NULL

    def e_blob(self, n, scope):
        return E(f"unhex('{n.v}')", "blob")

    def e_col(self, n, scope):
        return self.column(n, scope)

    def e_collate(self, n, scope):
        return replace(self.expr(n.e, scope), coll=n.name)

    def e_or(self, n, scope):
        return E(f"({V.truth(self.expr(n.l, scope))} OR {V.truth(self.expr(n.r, scope))})", "bool")

    def e_and(self, n, scope):
        return E(f"({V.truth(self.expr(n.l, scope))} AND {V.truth(self.expr(n.r, scope))})", "bool")

    def e_not(self, n, scope):
        return E(f"(NOT {V.truth(self.expr(n.e, scope))})", "bool")

    def e_cmp(self, n, scope):
        if n.l.kind == "row" or n.r.kind == "row":
            return self.rows(n.op, n.l, n.r, scope)
        return V.compare(n.op, self.expr(n.l, scope), self.expr(n.r, scope))

    def rows(self, op: str, l: N, r: N, scope) -> E:
        if l.kind != "row" or r.kind != "row" or len(l.items) != len(r.items):
            raise SqlError("row value misused")
        a, b = [self.expr(x, scope) for x in l.items], [self.expr(x, scope) for x in r.items]
        if op in ("=", "<>"):
            eq = "(" + " AND ".join(V.compare("=", x, y).sql for x, y in zip(a, b)) + ")"
            return E(eq if op == "=" else f"(NOT {eq})", "bool")
        out = V.compare(op, a[-1], b[-1]).sql
        for x, y in reversed(list(zip(a[:-1], b[:-1]))):
            out = f"({V.compare(op[0], x, y).sql} OR ({V.compare('=', x, y).sql} AND {out}))"
        return E(out, "bool")

    def e_is(self, n, scope):
        s = V.same(self.expr(n.l, scope), self.expr(n.r, scope))
        return E(f"(NOT {s.sql})", "bool") if n.neg else s

    def e_istrue(self, n, scope):
        t = V.truth(self.expr(n.e, scope))
        return E(f"({t} IS {'NOT ' if n.neg else ''}{'TRUE' if n.want else 'FALSE'})", "bool")

    def e_between(self, n, scope):
        x = self.expr(n.e, scope)
        s = f"({V.compare('>=', x, self.expr(n.lo, scope)).sql} AND {V.compare('<=', x, self.expr(n.hi, scope)).sql})"
        return E(f"(NOT {s})" if n.neg else s, "bool")

    def e_in(self, n, scope):
        if not n.items:
            return E("true" if n.neg else "false", "bool")
        if n.e.kind == "row":
            s = "(" + " OR ".join(self.rows("=", n.e, i, scope).sql for i in n.items) + ")"
            return E(f"(NOT {s})" if n.neg else s, "bool")
        x = self.expr(n.e, scope)
        items = [self.expr(i, scope) for i in n.items]
        v = V.value(x)
        if all(V.value(i).type in ("null", v.type) or {V.value(i).type, v.type} <= {"int", "real"} for i in items) and not x.coll and v.type != "null":
            s = f"({v.sql} IN ({', '.join(V.value(i).sql for i in items)}))"
        else:
            s = "(" + " OR ".join(V.compare("=", x, replace(i, aff=None)).sql for i in items) + ")"
        return E(f"(NOT {s})" if n.neg else s, "bool")

    def e_insub(self, n, scope):
        plain_in, self.plain_in = self.plain_in, False
        try:
            return self.in_query(n, scope, plain_in)
        finally:
            self.plain_in = plain_in

    def in_query(self, n, scope, plain_in: bool) -> E:
        q = self.query(n.body, scope)
        left = n.e.items if n.e.kind == "row" else [n.e]
        if len(left) != len(q.cols):
            raise SqlError(f"sub-select returns {len(q.cols)} columns - expected {len(left)}")
        xs, items, keys = [], [], []
        for i, (a, c) in enumerate(zip(left, q.cols)):
            x, y = V.typed(self.expr(a, scope)), replace(c.e, sql=f"_c{i}")
            if x.type != y.type and {x.type, y.type} != {"int", "real"}:
                kind = "text" if x.aff == "text" or (x.aff is None and y.aff == "text") else V.common_type([x.type, y.type])
                x, y = V.cast_to(x, kind), V.cast_to(y, kind)
            coll = x.coll
            xs.append(V.collated(x, coll))
            items.append(f"{V.collated(y, coll)} AS _i{i}")
            keys.append(y)
        head = xs[0] if len(xs) == 1 else f"({', '.join(xs)})"
        plain = all(i == f"_c{k} AS _i{k}" for k, i in enumerate(items))
        body = q.sql if plain else f"SELECT {', '.join(items)} FROM ({q.sql})"
        if plain_in or len(xs) > 1:
            return E(f"({head} {'NOT ' if n.neg else ''}IN ({body}))", "bool")
        # as a value it is NULL where a NULL among the rows, or on the left, leaves it open
        null = f"SELECT 1 FROM (SELECT {items[0]} FROM ({q.sql})) WHERE _i0 IS NULL"
        open_ = f"EXISTS ({null}) OR {head} IS NULL AND EXISTS ({body})"
        return E(f"(CASE WHEN {head} IN ({body}) THEN {'false' if n.neg else 'true'} WHEN {open_} THEN NULL ELSE {'true' if n.neg else 'false'} END)", "bool")

    def e_exists(self, n, scope):
        return E(f"({'NOT ' if n.neg else ''}EXISTS ({self.query(n.body, scope).sql}))", "bool")

    def e_scalar(self, n, scope):
        q = self.query(n.body, scope)
        if len(q.cols) != 1:
            raise SqlError(f"sub-select returns {len(q.cols)} columns - expected 1")
        core = n.body.cores[0]
        one = len(n.body.cores) == 1 and core.kind == "core" and not core.group and any(has_aggregate(i) for i in core.items)
        first_only = n.body.limit is not None and n.body.limit.kind == "int" and n.body.limit.v == 1 and n.body.offset is None
        if one:
            sql = q.sql
        elif n.body.limit is None:
            sql = f"SELECT first(_c0) FROM ({q.sql})"  # the first of several rows
        elif first_only and n.body.order and q.keyed and len({t.desc for t in n.body.order}) == 1 and not any(t.nulls for t in n.body.order):
            # an aggregate is decorrelated for any condition, a limit is not
            sql = f"SELECT {'max' if n.body.order[0].desc else 'min'}_by(_c0, struct({', '.join(q.keyed[1])})) FROM ({q.keyed[0]})"
        else:
            sql = q.sql
        return E(f"({sql})", q.cols[0].e.type, q.cols[0].e.aff)

    def e_row(self, n, scope):
        raise SqlError("row value misused")

    def e_match(self, n, scope):
        x, p = self.expr(n.e, scope), self.expr(n.p, scope)
        if n.how == "like":
            e = scalar.like(p, x, self.expr(n.esc, scope) if n.esc is not None else None)
        elif n.how == "glob":
            e = scalar.glob(p, x)
        elif n.how == "regexp":
            e = E(f"({V.text(x).sql} rlike {V.text(p).sql})", "bool")
        else:
            raise SqlError("unable to use function MATCH in the requested context")
        return E(f"(NOT {e.sql})", "bool") if n.neg else e

    def e_case(self, n, scope):
        base = self.expr(n.base, scope) if n.base is not None else None
        conds, outs = [], []
        for c, v in n.whens:
            conds.append(V.compare("=", base, self.expr(c, scope)).sql if base is not None else V.truth(self.expr(c, scope)))
            outs.append(self.expr(v, scope))
        other = self.expr(n.other, scope) if n.other is not None else None
        kind = V.common_type([V.value(e).type for e in [*outs, *([other] if other else [])]])
        whens = " ".join(f"WHEN {c} THEN {V.cast_to(v, kind).sql}" for c, v in zip(conds, outs))
        tail = f" ELSE {V.cast_to(other, kind).sql}" if other is not None else ""
        return E(f"CASE {whens}{tail} END", kind)

    def e_cast(self, n, scope):
        x, t = self.expr(n.e, scope), n.type
        if "INT" in t:
            return replace(V.integer(x), aff="int")
        if "CHAR" in t or "CLOB" in t or "TEXT" in t:
            return replace(V.text(x), aff="text")
        if "BLOB" in t or not t:
            return V.cast_to(x, "blob")
        if "REAL" in t or "FLOA" in t or "DOUB" in t:
            return replace(V.real(x), aff="real")
        return replace(V.number(x), aff="real")

    def e_unary(self, n, scope):
        x = self.expr(n.e, scope)
        if n.op == "+":
            return replace(V.value(x), aff=None)
        if n.op == "~":
            return E(f"(~ {V.integer(x).sql})", "int")
        a = V.number(x)
        return literal(-a.lit) if a.lit is not None else E(f"(- {a.sql})", a.type)

    def e_bin(self, n, scope):
        l, r, op = self.expr(n.l, scope), self.expr(n.r, scope), n.op
        if op == "||":
            return E(f"concat({V.text(l).sql}, {V.text(r).sql})", "text")
        if op in ("->", "->>"):
            return scalar.arrow(l, r, op == "->")
        if op in ("&", "|"):
            return E(f"({V.integer(l).sql} {op} {V.integer(r).sql})", "int")
        if op in ("<<", ">>"):
            a, b = V.integer(l).sql, V.integer(r).sql
            up, down = f"if(abs({b}) > 63, 0L, shiftleft({a}, cast(abs({b}) as int)))", f"if(abs({b}) > 63, if({a} < 0, -1L, 0L), shiftright({a}, cast(abs({b}) as int)))"
            return E(f"if({b} >= 0, {up}, {down})" if op == "<<" else f"if({b} >= 0, {down}, {up})", "int")
        a, b = V.number(l), V.number(r)
        both = a.type == b.type == "int"
        if op == "/":
            if both:
                return E(f"({a.sql} div nullif({b.sql}, 0L))", "int")
            x, y = V.real(a).sql, V.real(b).sql
            return E(f"({x} / nullif({y}, 0D))", "real")
        if op == "%":
            x, y = V.integer(a).sql, V.integer(b).sql
            return E(f"({x} % nullif({y}, 0L))", "int") if both else E(f"cast({x} % nullif({y}, 0L) as double)", "real")
        if a.lit is not None and b.lit is not None:
            v = {"+": a.lit + b.lit, "-": a.lit - b.lit, "*": a.lit * b.lit}[op]
            return literal(v)
        return E(f"({a.sql} {op} {b.sql})", "int" if both else "real")

    # -- functions

    def e_func(self, n, scope):
        if n.over is not None:
            return self.windowed(n, scope)
        if is_aggregate(n):
            return self.aggregate(n, scope)
        if n.filter is not None or n.star:
            raise SqlError(f"wrong use of function {n.name}()")
        if n.name in RANKING:
            raise SqlError(f"misuse of window function {n.name}()")
        return scalar.call(n.name, [self.expr(a, scope) for a in n.args])

    def arguments(self, n, scope) -> list[E]:
        held, self.agg = self.agg, None if n.over is None else self.agg
        try:
            return [self.expr(a, scope) for a in n.args]
        finally:
            self.agg = held

    def order_terms(self, order: list[N], scope) -> str:
        held, out = self.agg, []
        for t in order:
            e = V.typed(self.expr(t.expr, scope))
            out.append(self.direction(t, V.collated(e, e.coll)))
        self.agg = held
        return ", ".join(out)

    def aggregate(self, n, scope) -> E:
        held, self.agg = self.agg, None
        try:
            e = self.aggregate_call(n, [self.expr(a, scope) for a in n.args], scope)
            if n.filter is None:
                return replace(e, sql=e.sql.replace("\x01", ""))
            cond = V.truth(self.expr(n.filter, scope))
        finally:
            self.agg = held
        return replace(e, sql=e.sql.replace("\x01", f" FILTER (WHERE {cond})"))

    def aggregate_call(self, n, args: list[E], scope) -> E:
        """The call; \\x01 marks where FILTER or OVER goes."""
        d = "DISTINCT " if n.distinct else ""
        name = n.name
        if name == "count":
            if n.star or not args:
                return E("count(1)\x01", "int")
            return E(f"count({d}{V.typed(args[0]).sql})\x01", "int")
        if not args:
            raise SqlError(f"wrong number of arguments to function {name}()")
        if name in ("min", "max"):
            x = V.typed(args[0])
            return replace(x, sql=f"{name}({x.sql})\x01", lit=None, aff=x.aff)
        if name == "sum":
            x = V.number(args[0])
            return E(f"sum({d}{x.sql})\x01", x.type)
        if name == "total":
            return E(f"coalesce(sum({d}{V.real(args[0]).sql})\x01, 0D)", "real")
        if name == "avg":
            return E(f"avg({d}{V.real(args[0]).sql})\x01", "real")
        order = self.order_terms(n.order, scope) if n.order else None
        rowid = next((s.rowid for s in scope.sources if s.rowid), None)
        if name in ("group_concat", "string_agg"):
            x, sep = V.text(args[0]).sql, V.text(args[1]).sql if len(args) > 1 else "','"
            if n.distinct and rowid and not n.order:
                # in the order of first occurrence
                rows = f"collect_list(if({x} IS NULL, NULL, named_struct('i', {rowid}, 'x', {x})))\x01"
                return E(f"if(count({x})\x01 = 0, NULL, array_join(array_distinct(transform(array_sort({rows}), e -> e.x)), {sep}))", "text")
            if n.distinct:
                return E(f"listagg(DISTINCT {x}, {sep}) WITHIN GROUP (ORDER BY {x})\x01", "text")
            order = order or (f"{rowid} ASC" if rowid and n.over is None else None)
            return E(f"listagg({x}, {sep}){f' WITHIN GROUP (ORDER BY {order})' if order else ''}\x01", "text")
        if name.endswith("group_array"):
            within = order or (rowid if n.over is None else None)
            body = f"listagg({scalar.json_quote(args[0])}, ','){f' WITHIN GROUP (ORDER BY {within})' if within else ''}\x01"
            return E(f"concat('[', coalesce({body}, ''), ']')", "text")
        within = order or (rowid if n.over is None else None)
        pair = f"concat({scalar.json_quote(V.text(args[0]))}, ':', {scalar.json_quote(args[1])})"
        body = f"listagg({pair}, ','){f' WITHIN GROUP (ORDER BY {within})' if within else ''}\x01"
        return E(f"concat('{{', coalesce({body}, ''), '}}')", "text")

    def partition_order(self, w: N, scope) -> str:
        parts = []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(V.typed(self.expr(p, scope)).sql for p in w.partition))
        if w.order:
            parts.append("ORDER BY " + self.order_terms(w.order, scope))
        return " ".join(parts)

    def bound(self, b, scope, unit: str) -> str:
        kind, e = b
        if kind.startswith("unbounded"):
            return kind.upper()
        if kind == "current":
            return "CURRENT ROW"
        x = self.expr(e, scope)
        if x.lit is None:
            raise SqlError("frame offsets must be constants")
        if x.lit < 0:
            raise SqlError("frame offsets must be non-negative")
        return f"{x.lit} {kind.upper()}"

    def windowed(self, n, scope) -> E:
        w = self.window_of(n.over, getattr(self, "windows", {}))
        args = self.arguments(n, scope)
        if n.filter is not None:
            if n.name in RANKING:
                raise SqlError("FILTER clause may only be used with aggregate window functions")
            cond = V.truth(self.expr(n.filter, scope))
            if n.star or not args:
                args = [E(f"CASE WHEN {cond} THEN 1L END", "int")]
            else:
                args = [replace(a, sql=f"CASE WHEN {cond} THEN {a.sql} END", lit=None) if i == 0 else a for i, a in enumerate(map(V.typed, args))]
            n = N("func", name=n.name, args=n.args, distinct=n.distinct, star=False, order=n.order, filter=None, over=n.over)
        spec = self.partition_order(w, scope)
        frame, marks = w.frame, w.get("marks")
        if n.name in RANKING:
            call, kind = self.ranking(n, args)
        else:
            if n.distinct:
                raise SqlError("DISTINCT is not supported for window functions")
            if n.name not in AGGREGATES | {"min", "max"}:
                raise SqlError(f"{n.name}() may not be used as a window function")
            e = self.aggregate_call(n, args, scope)
            call, kind = e.sql, e.type
        text = ""
        if frame is not None and n.name not in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
            lo, hi = self.bound(frame.lo, scope, frame.unit), self.bound(frame.hi, scope, frame.unit)
            if frame.unit == "groups":
                part = spec.split("ORDER BY")[0].strip()
                spec = f"{part} ORDER BY {marks[0]}".strip()
                text = f" RANGE BETWEEN {lo} AND {hi}"
            else:
                text = f" {frame.unit.upper()} BETWEEN {lo} AND {hi}"
            if frame.exclude:
                peers = f"{self.partition_order(N('window', base=None, partition=w.partition, order=[], frame=None), scope)}, {marks[0]}" if w.partition else f"PARTITION BY {marks[0]}"
                less = self.subtracting(n, args, spec + text, frame, peers, marks, kind)
                return less or self.excluding(n, args, spec + text, frame.exclude, marks, kind)
        elif n.name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead") and not w.order:
            spec = f"{spec} ORDER BY {self.row_order(scope)}".strip() if n.name in ("row_number", "ntile", "lag", "lead") else f"{spec} ORDER BY 1".strip()
        over = f" OVER ({spec}{text})"
        if "\x01" in call:
            return E(call.replace("\x01", over), kind)
        return E(f"cast({call}{over} as bigint)" if kind == "int" and n.name in ("row_number", "rank", "dense_rank", "ntile") else f"{call}{over}", kind)

    def row_order(self, scope) -> str:
        return next((s.rowid for s in scope.sources if s.rowid), "1")

    def ranking(self, n, args: list[E]) -> tuple[str, str]:
        name = n.name
        if name in ("row_number", "rank", "dense_rank"):
            return f"{name}()", "int"
        if name in ("percent_rank", "cume_dist"):
            return f"{name}()", "real"
        if name == "ntile":
            return f"ntile({V.integer(args[0]).lit})", "int"
        x = V.typed(args[0])
        if name in ("lag", "lead"):
            k = V.integer(args[1]).lit if len(args) > 1 else 1
            if len(args) > 2:
                d = V.cast_to(args[2], x.type).sql
                return f"{name}({x.sql}, {k}, {d})", x.type
            return f"{name}({x.sql}, {k})", x.type
        if name == "nth_value":
            return f"nth_value({x.sql}, {V.integer(args[1]).lit})", x.type
        return f"{name}({x.sql})", x.type

    def subtracting(self, n, args: list[E], window: str, frame: N, peers: str, marks: tuple[str, str], kind: str) -> E | None:
        """Frames with EXCLUDE for counts, and for sums of integers: the whole frame less what is excluded, in constant space a row."""
        x = V.typed(args[0]) if args else E("1L", "int")
        if n.name not in ("count", "sum", "avg", "total") or (n.name != "count" and x.type != "int"):
            return None
        place = {"unbounded preceding": -1, "unbounded following": 1, "current": 0}
        at = lambda b: place[b[0]] if b[1] is None else (-1 if b[0] == "preceding" else 1) * self.expr(b[1], Scope()).lit
        here = at(frame.lo) <= 0 <= at(frame.hi)  # the current row, and but for ROWS its peers, lie in the frame
        near = f"{peers} ORDER BY {marks[1]} ROWS {window.rsplit(' ROWS ', 1)[1]}" if frame.unit == "rows" else peers

        def less(over, own: str) -> str:
            out = over(window)
            if frame.exclude != "current" and (here or frame.unit == "rows"):
                out += f" - {over(near)}"
            if frame.exclude != "group" and here:
                out += f" {'+' if frame.exclude == 'ties' else '-'} {own}"
            return f"({out})"

        if n.name == "count" and (n.star or not args):
            return E(less(lambda spec: f"count(1) OVER ({spec})", "1L"), "int")
        count = less(lambda spec: f"count({x.sql}) OVER ({spec})", f"if({x.sql} IS NULL, 0L, 1L)")
        if n.name == "count":
            return E(count, "int")
        total = less(lambda spec: f"coalesce(sum({x.sql}) OVER ({spec}), 0L)", f"coalesce({x.sql}, 0L)")
        if n.name == "sum":
            return E(f"if({count} > 0, {total}, NULL)", "int")
        return E(f"cast({total} as double)" if n.name == "total" else f"if({count} > 0, cast({total} as double) / {count}, NULL)", "real")

    def excluding(self, n, args: list[E], window: str, exclude: str, marks: tuple[str, str], kind: str) -> E:
        """Frames with EXCLUDE: the frame's rows are gathered with their peer and row numbers and filtered."""
        g, r = marks
        x = V.typed(args[0]).sql if args else "1L"
        rows = f"collect_list(named_struct('g', {g}, 'r', {r}, 'x', {x})) OVER ({window})"
        keep = {"current": f"e.r <> {r}", "group": f"e.g <> {g}", "ties": f"(e.g <> {g} OR e.r = {r})"}[exclude]
        kept = f"transform(array_sort(filter({rows}, e -> {keep}), (a, b) -> int(sign(a.r - b.r))), e -> e.x)"
        solid = f"filter({kept}, v -> v IS NOT NULL)"
        add = lambda zero: f"aggregate({solid}, {zero}, (a, v) -> a + v)"
        if n.name == "count":
            return E(f"cast(size({kept if n.star or not args else solid}) as bigint)", "int")
        if n.name == "sum":
            zero = "0L" if kind == "int" else "0D"
            return E(f"CASE WHEN size({solid}) > 0 THEN {add(zero)} END", kind)
        if n.name in ("avg", "total"):
            real = f"transform({solid}, v -> cast(v as double))"
            total = f"aggregate({real}, 0D, (a, v) -> a + v)"
            return E(total if n.name == "total" else f"CASE WHEN size({solid}) > 0 THEN {total} / size({solid}) END", "real")
        if n.name in ("min", "max"):
            return E(f"array_{n.name}({solid})", kind)
        if n.name in ("group_concat", "string_agg"):
            sep = V.text(args[1]).sql if len(args) > 1 else "','"
            return E(f"CASE WHEN size({solid}) > 0 THEN array_join(transform({solid}, v -> cast(v as string)), {sep}) END", "text")
        if n.name == "first_value":
            return E(f"try_element_at({kept}, 1)", kind)
        if n.name == "last_value":
            return E(f"if(size({kept}) = 0, NULL, try_element_at({kept}, -1))", kind)
        if n.name == "nth_value":
            return E(f"try_element_at({kept}, {V.integer(args[1]).lit})", kind)
        raise SqlError(f"EXCLUDE is not supported for {n.name}()")
