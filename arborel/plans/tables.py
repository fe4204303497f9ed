"""Relational lane over tables as virtual documents.

A table T is the document <T><row>..one child for each column..</row>..</T>. A path over it is a
projection and filters, a comparison with another table's path a semi join, a ``for`` over several
paths a join, and an aggregate over a path that depends on a ``for`` variable a grouped join.
Results come out in no order of their own unless the expression sorts or counts positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError, error
from ..functions.library import atom
from ..functions.values import NUMERIC, Val, common, convert, items, many, of_type, truth
from .ast import Ex
from .operators import GENERAL, compare
from .parser import StaticContext, parse
from .row import RowCompiler, output

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass
class Rows:
    """Rows of tables bound to names: a DataFrame with each column renamed, and the values by binding."""

    df: DataFrame
    bound: dict[str, dict[str, Val]]
    item: Val | None = None
    name: str | None = None
    table: str | None = None


@dataclass
class Tables:
    """Compiles expressions over named DataFrames. keys: the columns that order each table's rows."""

    frames: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)
    static: StaticContext = field(default_factory=StaticContext)
    _count: int = 0

    def query(self, text: str) -> DataFrame:
        return self.compile(parse(text, self.static))

    # rows

    def _fresh(self) -> str:
        self._count += 1
        return f"_{self._count}"

    def scan(self, table: str, needed: set[str] | None = None) -> Rows:
        if table not in self.frames:
            raise error("FODC0002", f"unknown table {table}")
        df, tag = self.frames[table], self._fresh()
        named = df.select(*[F.col(f"`{f.name}`").alias(f"{f.name}{tag}") for f in df.schema.fields])
        values = {f.name: of_type(f.dataType, F.col(f"{f.name}{tag}")) for f in df.schema.fields}
        return Rows(named, {"": values}, name="", table=table)

    def order(self, rows: Rows) -> list[Column]:
        """Document order: the key columns of the focus table, else all its columns that can be sorted."""
        values = rows.bound[rows.name]
        names = self.keys.get(rows.table) or [n for n, v in values.items() if v.type not in ("map", "array", "json")]
        return [values[n].col for n in names]

    def row_compiler(self, rows: Rows, extra: dict[str, Val] | None = None) -> RowCompiler:
        columns = rows.bound.get(rows.name, {}) if rows.name is not None else {}
        return RowCompiler(self.static, focus=rows.item, columns={} if rows.item is not None else columns, variables=extra or {}, outer=self._outer(rows))

    def _outer(self, rows: Rows):
        def resolve(e: Ex, c: RowCompiler) -> Val | None:
            # $x/column and $x
            if e.op == "path" and e.val == "" and e.args[0].op == "var" and e.args[0].val in rows.bound and e.args[0].val not in c.variables:
                columns = rows.bound[e.args[0].val]
                inner = replace(c, columns=columns, outer=None, focus=None)
                out = inner(e.args[1])
                for step in e.args[2:]:
                    out = inner.focused(out)(step)
                return out
            if e.op == "gcmp" and any(_absolute(x) for x in e.args):
                return self._scalar_compare(e, c)
            if e.op == "call" and e.val in (*AGGREGATES, "exists", "empty") and len(e.args) == 1 and _absolute(e.args[0]):
                return self._scalar(e)
            return None

        return resolve

    def _scalar(self, e: Ex) -> Val:
        """An aggregate over a table that depends on nothing here: a scalar subquery."""
        inner = self.path(e.args[0])
        v = self._aggregate(e.val, inner)
        return Val(inner.df.agg(v.col.alias("v")).scalar(), v.type)

    def _aggregate(self, name: str, rows: Rows) -> Val:
        if rows.item is None or name in ("exists", "empty"):
            n = F.count(F.lit(1)) if rows.item is None else F.count(rows.item.col)
            return {"count": Val(n, "integer"), "exists": Val(n > 0, "boolean"), "empty": Val(n == 0, "boolean")}[name]
        v = atom(rows.item)
        if name == "count":
            return Val(F.count(v.col) if not v.many else F.sum(F.size(v.col)), "integer")
        if v.type in ("string", "untypedAtomic", "json") and name in ("sum", "avg"):
            v = convert(Val(v.col.cast("string"), "untypedAtomic"), "double")
        if name == "sum":
            return Val(F.coalesce(F.sum(v.col), F.lit(0).cast("double" if v.type == "double" else "bigint")), v.type)
        if name == "avg" and v.type in ("integer", "decimal"):
            return Val(F.avg(v.col.cast("decimal(28,9)")).cast("decimal(38,18)"), "decimal")
        col = AGGREGATES[name](v.col)
        if v.type == "double" and name in ("min", "max"):
            col = F.when(F.bool_or(F.isnan(v.col)), F.lit(float("nan"))).otherwise(col)
        return Val(col, v.type)

    def _scalar_compare(self, e: Ex, c: RowCompiler) -> Val:
        """col < /path and the like: against the least or greatest of the path."""
        flip = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
        op, (a, b) = e.val, e.args
        if _absolute(a):
            op, a, b = flip[op], b, a
        if op in ("=", "!="):
            raise UnsupportedError("XPTY0004", "a comparison for equality with a path stands alone in a predicate")
        inner = self.path(b)
        name = "max" if op in ("<", "<=") else "min"
        bound = inner.df.agg(AGGREGATES[name](inner.item.col).alias("v")).scalar()
        return Val(c.general(GENERAL[op], atom(c(a)), Val(bound, inner.item.type)), "boolean")

    # predicates

    def filtered(self, rows: Rows, predicates, extra: dict[str, Val] | None = None) -> Rows:
        for p in predicates:
            for part in _conjuncts(p) if not _positional(p) else [p]:
                rows = self._filter(rows, part, extra)
        return rows

    def _filter(self, rows: Rows, p: Ex, extra) -> Rows:
        keep, test = True, p
        while test.op == "call" and test.val == "not" and len(test.args) == 1:
            keep, test = not keep, test.args[0]
        if test.op == "gcmp" and test.val == "=" and sum(map(_absolute, test.args)) == 1:
            own, other = sorted(test.args, key=_absolute)
            return self._semi(rows, own, other, keep)
        if test.op == "call" and test.val in ("exists", "empty") and _absolute(test.args[0]) and _correlation(test.args[0], rows):
            return self._correlated(rows, test.args[0], keep == (test.val == "exists"))
        if test.op in ("some", "every") and all(map(_absolute, test.args[:-1])):
            return self._quantified(rows, test, keep)
        if _positional(p):
            return self._position(rows, p)
        c = self.row_compiler(rows, extra)
        if p.op in ("gcmp", "vcmp") and not any(map(_absolute, p.args)):
            a, b = (atom(c(x)) for x in p.args)
            if not a.many and not b.many and not self.static.compatible and self.static.number >= 20:
                # a filter drops null as it drops false, and a bare comparison reaches the scan
                op = p.val if p.op == "vcmp" else GENERAL[p.val]
                return replace(rows, df=rows.df.where(compare(op, a, b, self.static, p.op == "gcmp")))
        value = c(p)
        if value.type in NUMERIC:
            return self._position(rows, p)
        return replace(rows, df=rows.df.where(value.col if value.type == "boolean" and not value.many else truth(value)))

    def _semi(self, rows: Rows, own: Ex, other: Ex, keep: bool) -> Rows:
        inner = self.path(other)
        a, b = atom(self.row_compiler(rows)(own)), inner.item
        if b is None:
            raise UnsupportedError("XPTY0004", "rows have no typed value")
        kind = common([a, b])
        right = inner.df.select(convert(b, kind).col.alias("_k")).where("_k is not null")
        tag = self._fresh()
        right = right.withColumnRenamed("_k", f"_k{tag}")
        return replace(rows, df=rows.df.join(right, convert(a, kind).col == F.col(f"_k{tag}"), "left_semi" if keep else "left_anti"))

    def _correlated(self, rows: Rows, path: Ex, keep: bool) -> Rows:
        inner, pairs = self._split(rows, path)
        if not pairs:
            raise UnsupportedError("XPTY0004", "no equality joins a path to what is outside")
        on = _all([x == y for x, y in pairs])
        return replace(rows, df=rows.df.join(inner.df, on, "left_semi" if keep else "left_anti"))

    def _quantified(self, rows: Rows, e: Ex, keep: bool) -> Rows:
        """some: a semi join on the condition; every: an anti join on its negation."""
        if len(e.val) != 1:
            raise UnsupportedError("XPTY0004", "one variable at a time")
        every = e.op == "every"
        inner, pairs = self._split(rows, e.args[0])
        if not pairs:
            return self._quantified_by_bound(rows, e, inner, keep)
        inner = replace(inner, bound={**inner.bound, e.val[0]: inner.bound[inner.name]})
        both = Rows(rows.df, {**rows.bound, e.val[0]: inner.bound[inner.name]}, rows.item, rows.name, rows.table)
        test = truth(self.row_compiler(both)(e.args[-1]))
        on = _all([x == y for x, y in pairs] + [~test if every else test])
        return replace(rows, df=rows.df.join(inner.df, on, "left_semi" if keep != every else "left_anti"))

    def _quantified_by_bound(self, rows: Rows, e: Ex, inner: Rows, keep: bool) -> Rows:
        """Without an equality to join on, a comparison in order is one with the least or the greatest of the path.

        some x in S satisfies x < y is min(S) < y, and every x in S satisfies x < y is max(S) < y or S empty.
        """
        test, name, every = e.args[-1], e.val[0], e.op == "every"
        op = GENERAL.get(test.val, test.val) if test.op in ("gcmp", "vcmp") else None
        mine = [any(x.op == "var" and x.val == name for x in a.walk()) for a in test.args]
        if op not in ("lt", "le", "gt", "ge") or sum(mine) != 1:
            raise UnsupportedError("XPTY0004", f"no equality joins ${name} to what is outside")
        own, other = test.args if mine[0] else test.args[::-1]
        op = op if mine[0] else {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}[op]
        both = replace(inner, bound={**inner.bound, name: inner.bound[inner.name]}, item=None)
        value = inner.item if own.op == "var" and inner.item is not None else atom(self.row_compiler(both)(own))
        least = (op in ("lt", "le")) != every
        nan = F.isnan(value.col) if value.type in ("double", "float") else F.lit(False)
        bound = Val(inner.df.agg((F.min if least else F.max)(F.when(~nan, value.col)).alias("v")).scalar(), value.type)
        found = F.coalesce(compare(op, bound, atom(self.row_compiler(rows)(other)), self.static, test.op == "gcmp"), F.lit(False))
        if every:  # no item at all, or none that is null or NaN and thus compares false
            all_there = inner.df.agg(F.bool_and(value.col.isNotNull() & ~nan).alias("v")).scalar()
            found = F.when(all_there.isNull(), True).otherwise(all_there & found)
        return replace(rows, df=rows.df.where(found if keep else ~found))

    def _split(self, rows: Rows, path: Ex) -> tuple[Rows, list[tuple[Column, Column]]]:
        """A path over a table whose equalities with outer values become join keys."""
        (table, row), rest = path.args[:2], path.args[2:]
        inner = self.scan(table.val[1].local)
        pairs, own = [], []
        for p in (c for x in row.args for c in _conjuncts(x)):
            if p.op in ("gcmp", "vcmp") and p.val in ("=", "eq") and sum(_outside(x, rows) for x in p.args) == 1:
                out, mine = sorted(p.args, key=lambda x: not _outside(x, rows))
                a, b = atom(self.row_compiler(rows)(out)), atom(self.row_compiler(inner)(mine))
                kind = common([a, b])
                pairs.append((convert(a, kind).col, convert(b, kind).col))
            elif _outside(p, rows):
                raise UnsupportedError("XPTY0004", "a path is joined to what is outside by equalities")
            else:
                own.append(p)
        inner = self.filtered(inner, own)
        return self._cells(inner, rest), pairs

    def _position(self, rows: Rows, p: Ex) -> Rows:
        order = self.order(rows)
        if p.op == "call" and p.val == "last":
            return replace(rows, df=rows.df.orderBy(*[c.desc() for c in order]).limit(1))
        if p.op in ("gcmp", "vcmp") and p.args[0].op == "call" and p.args[0].val == "position" and p.args[1].op == "lit":
            n, op = int(float(p.args[1].val[1])), GENERAL.get(p.val, p.val)
            ordered = rows.df.orderBy(*order)
            if op in ("lt", "le"):
                return replace(rows, df=ordered.limit(n if op == "le" else n - 1))
            if op in ("gt", "ge"):
                return replace(rows, df=ordered.offset(n if op == "gt" else n - 1))
            if op == "eq":
                return replace(rows, df=ordered.offset(n - 1).limit(1))
        if p.op == "lit":
            return replace(rows, df=rows.df.orderBy(*order).offset(int(float(p.val[1])) - 1).limit(1))
        raise UnsupportedError("XPTY0004", "a position over a table is compared with a literal")

    # paths

    def path(self, e: Ex) -> Rows:
        if e.op == "filter":
            rows = self.path(e.args[0])
            return self.filtered(rows, e.args[1:])
        if e.op in ("union", "intersect", "except"):
            return self._set(e)
        if not _absolute(e):
            raise UnsupportedError("XPTY0004", f"no relation for {e.op}")
        steps = list(e.args)
        if steps[0].val[0] == "descendant-or-self":
            steps = steps[1:]
        table = steps[0].val[1].local
        if len(steps) == 1:
            raise UnsupportedError("XPTY0004", "a whole table is one node")
        row = steps[1]
        if row.val[0] not in ("child", "descendant") or row.val[1].local not in ("row", None):
            raise UnsupportedError("XPTY0004", "a table has rows")
        return self._cells(self.filtered(self.scan(table), row.args), steps[2:])

    def _cells(self, rows: Rows, steps) -> Rows:
        for step in steps:
            value = self.row_compiler(rows)(replace(step, args=()) if step.op == "step" else step)
            if value.many or value.type == "array":
                flat = many(atom(value))
                tag = self._fresh()
                df = rows.df.withColumn(f"_item{tag}", F.explode(flat.col))
                value = flat.with_col(F.col(f"_item{tag}"), False)
                rows = replace(rows, df=df)
            else:
                rows = replace(rows, df=rows.df.where(value.col.isNotNull()))
            rows = replace(rows, item=value)
            if step.op == "step" and step.args:
                rows = self.filtered(rows, step.args)
        return rows

    def _set(self, e: Ex) -> Rows:
        """Set operators over nodes of one table: a node is in the result by where it stands, so each operand is a condition on the row.

        Rows are told apart by their identity, never by their values: equal rows are separate nodes.
        """
        leaves = _operands(e)
        if any(not _absolute(p) for p in leaves):
            raise UnsupportedError("XPTY0004", "set operators over paths")
        paths = [p if p.op == "path" else p.args[0] for p in leaves]
        tables, cells = {p.args[0].val[1].local for p in paths}, {p.args[2:] for p in paths}
        if len(tables) > 1 or len(cells) > 1:
            raise UnsupportedError("XPTY0004", "set operators over nodes of one table and column")
        rows = self.scan(tables.pop())
        by_row = all(p.op == "path" and not any(map(_positional, p.args[1].args)) and not any(x.op == "step" and x.args for x in p.args[2:]) for p in leaves)
        if by_row:
            rows, member = self._member(rows, e)
        else:
            tag = self._fresh()
            rows = replace(rows, df=rows.df.withColumn(f"_row{tag}", F.monotonically_increasing_id()))
            rows, member = self._by_identity(rows, rows, e, f"_row{tag}")
        return self._cells(replace(rows, df=rows.df.where(member)), cells.pop())

    def _member(self, rows: Rows, e: Ex) -> tuple[Rows, Column]:
        """Whether a row is in the result of set operators over predicates."""
        if e.op == "path":
            member = F.lit(True)
            for p in (c for x in e.args[1].args for c in _conjuncts(x)):
                rows, holds = self._holds(rows, p)
                member = member & holds
            return rows, member
        rows, a = self._member(rows, e.args[0])
        rows, b = self._member(rows, e.args[1])
        return rows, {"union": a | b, "intersect": a & b, "except": a & ~b}[e.op]

    def _holds(self, rows: Rows, p: Ex) -> tuple[Rows, Column]:
        """A predicate as a column; one that asks another table is marked by a join with its distinct keys."""
        keep, test = True, p
        while test.op == "call" and test.val == "not" and len(test.args) == 1:
            keep, test = not keep, test.args[0]
        if test.op == "gcmp" and test.val == "=" and sum(map(_absolute, test.args)) == 1:
            own, other = sorted(test.args, key=_absolute)
            inner, a = self.path(other), atom(self.row_compiler(rows)(own))
            kind, tag = common([a, inner.item]), self._fresh()
            right = inner.df.select(convert(inner.item, kind).col.alias(f"_k{tag}")).where(F.col(f"_k{tag}").isNotNull()).distinct().withColumn(f"_m{tag}", F.lit(True))
            rows = replace(rows, df=rows.df.join(right, convert(a, kind).col == F.col(f"_k{tag}"), "left"))
            found = F.coalesce(F.col(f"_m{tag}"), F.lit(False))
        else:
            v = self.row_compiler(rows)(test)
            if v.type in NUMERIC:
                raise UnsupportedError("XPTY0004", "a computed position in a set operator")
            found = F.coalesce(truth(v), F.lit(False))
        return rows, found if keep else ~found

    def _by_identity(self, rows: Rows, base: Rows, e: Ex, mark: str) -> tuple[Rows, Column]:
        """The same for operands with positions: the rows of the scan that each gives, by a number that the scan gives to each row."""
        if e.op in ("union", "intersect", "except"):
            rows, a = self._by_identity(rows, base, e.args[0], mark)
            rows, b = self._by_identity(rows, base, e.args[1], mark)
            return rows, {"union": a | b, "intersect": a & b, "except": a & ~b}[e.op]
        path = e if e.op == "path" else e.args[0]
        own = self._cells(self.filtered(base, path.args[1].args), path.args[2:])
        if e.op == "filter":
            own = self.filtered(own, e.args[1:])
        tag = self._fresh()
        right = own.df.select(F.col(mark).alias(f"_k{tag}")).distinct().withColumn(f"_m{tag}", F.lit(True))
        df = rows.df.join(right, F.col(mark) == F.col(f"_k{tag}"), "left")
        return replace(rows, df=df), F.coalesce(F.col(f"_m{tag}"), F.lit(False))

    # whole expressions

    def compile(self, e: Ex) -> DataFrame:
        """The result as a DataFrame: one row for each item, columns by the map or row that an item is, else `value`."""
        if e.op == "for":
            return self._for(e)
        if e.op == "let":
            for i, name in enumerate(e.val):
                x = e.args[i]
                e = replace(e, args=tuple(_replace(a, name, x) if k > i else a for k, a in enumerate(e.args)))
            return self.compile(e.args[-1])
        if e.op == "map":
            return self._for(Ex("for", ("_it",), (e.args[0], _with_focus(e.args[1]))))
        if e.op == "call" and e.val in (*AGGREGATES, "exists", "empty") and len(e.args) == 1 and _relational(e.args[0]):
            rows = self.path(e.args[0])
            v = self._aggregate(e.val, rows)
            return rows.df.agg(v.col.alias("value"))
        if e.op == "call" and e.val == "distinct-values" and _relational(e.args[0]):
            rows = self.path(e.args[0])
            return rows.df.select(output(rows.item, "value")).distinct()
        if e.op == "call" and e.val == "string-join" and _relational(e.args[0]):
            rows = self.path(e.args[0])
            sep = e.args[1].val[1] if len(e.args) > 1 else ""
            order = self.order(rows)
            pairs = F.array_sort(F.collect_list(F.struct(*order, rows.item.col.alias("_v"))))
            return rows.df.agg(F.array_join(F.transform(pairs, lambda s: s["_v"].cast("string")), sep).alias("value"))
        if e.op == "call" and e.val in ("subsequence", "head", "tail", "sort", "reverse") and _relational(e.args[0]):
            return self._ordered(e)
        if e.op == "seq":
            parts = [self.compile(a) for a in e.args]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        if e.op == "path" and _relational(e) and not _absolute(e):
            return self._ordered(e)
        return self._emit(self.path(e))

    def _emit(self, rows: Rows) -> DataFrame:
        if rows.item is not None:
            return rows.df.select(output(rows.item, "value"))
        return rows.df.select(*[output(v, n) for n, v in rows.bound[rows.name].items()])

    def _ordered(self, e: Ex) -> DataFrame:
        inner, window = e, []
        while inner.op == "call" and inner.val in ("subsequence", "head", "tail"):
            window.append(inner)
            inner = inner.args[0]
        cells: tuple[Ex, ...] = ()
        if inner.op == "path" and inner.args[0].op == "call":
            cells, inner = inner.args[1:], inner.args[0]
        down = False
        while inner.op == "call" and inner.val == "reverse":
            down, inner = not down, inner.args[0]
        keyed = inner.args[2] if inner.op == "call" and inner.val == "sort" and len(inner.args) == 3 else None
        rows = self.path(inner.args[0] if inner.op == "call" and inner.val == "sort" else inner)
        order = self.order(rows)
        if inner.op == "call" and inner.val == "sort":
            if keyed is not None:
                name = keyed.val[0][0]
                c = self.row_compiler(replace(rows, bound={**rows.bound, name: rows.bound[rows.name]}), {name: rows.item} if rows.item is not None else None)
                body = keyed.args[0]
                keys = [c(x).col for x in (body.args if body.op == "seq" else (body,))]
                order = [*keys, *order]
            else:
                order = [rows.item.col, *order]
        df = rows.df.orderBy(*[c.desc() if down else c.asc() for c in order])
        for w in reversed(window):
            if w.val == "head":
                df = df.limit(1)
            elif w.val == "tail":
                df = df.offset(1)
            else:
                start = round(float(w.args[1].val[1]))
                df = df.offset(max(start - 1, 0)) if start > 1 else df
                if len(w.args) > 2:
                    df = df.limit(max(round(float(w.args[2].val[1])) + min(start - 1, 0), 0))
        return self._emit(self._cells(replace(rows, df=df), cells))

    def _for(self, e: Ex) -> DataFrame:
        rows: Rows | None = None
        extra: dict[str, Val] = {}
        for name, source in zip(e.val, e.args):
            if rows is None:
                first = self.path(source)
                rows = Rows(first.df, {name: first.bound[first.name]}, None, None, first.table)
                if first.item is not None:
                    extra[name] = first.item
                continue
            if _relational(source):
                inner, pairs = self._split(rows, source)
                if not pairs:
                    raise UnsupportedError("XPTY0004", f"no equality joins ${name} to the variables before it")
                df = rows.df.join(inner.df, _all([x == y for x, y in pairs]))
                rows = Rows(df, {**rows.bound, name: inner.bound[inner.name]}, None, None, None)
                if inner.item is not None:
                    extra[name] = inner.item
            else:
                v = many(self.row_compiler(rows, extra)(source))
                tag = self._fresh()
                rows = replace(rows, df=rows.df.withColumn(f"_item{tag}", F.explode(v.col)))
                extra[name] = v.with_col(F.col(f"_item{tag}"), False)
        body = e.args[-1]
        if body.op == "let":
            for i, n in enumerate(body.val):
                x = body.args[i]
                body = replace(body, args=tuple(_replace(a, n, x) if k > i else a for k, a in enumerate(body.args)))
            body = body.args[-1]
        while body.op == "if" and body.args[2] == Ex("seq", None, ()):
            rows = self.filtered(rows, [body.args[0]], extra)
            body = body.args[1]
        rows, body, extra = self._aggregated(rows, body, extra)
        c = self.row_compiler(rows, extra)
        if body.op == "mapctor":
            return rows.df.select(*[output(c(v), k.val[1]) for k, v in zip(body.args[::2], body.args[1::2])])
        if body.op == "var" and body.val in rows.bound and body.val not in extra:
            return rows.df.select(*[output(v, n) for n, v in rows.bound[body.val].items()])
        v = c(body)
        if v.many:
            return rows.df.select(F.explode(items(v)).alias("value"))
        return rows.df.where(v.col.isNotNull()).select(output(v, "value"))

    def _aggregated(self, rows: Rows, body: Ex, extra) -> tuple[Rows, Ex, dict[str, Val]]:
        """Aggregates over paths that depend on the variables: grouped by the join keys, and joined."""
        found = {x for x in body.walk() if x.op == "call" and x.val in (*AGGREGATES, "exists", "empty") and len(x.args) == 1 and _absolute(x.args[0]) and _correlation(x.args[0], rows)}
        for k, x in enumerate(sorted(found, key=repr)):
            inner, pairs = self._split(rows, x.args[0])
            tag = self._fresh()
            v = self._aggregate(x.val, inner)
            side = inner.df.groupBy(*[b.alias(f"_g{i}{tag}") for i, (_, b) in enumerate(pairs)]).agg(v.col.alias(f"_v{tag}"))
            df = rows.df.join(side, _all([a == F.col(f"_g{i}{tag}") for i, (a, _) in enumerate(pairs)]), "left")
            col = F.col(f"_v{tag}")
            none = {"count": F.lit(0), "sum": F.lit(0), "exists": F.lit(False), "empty": F.lit(True)}.get(x.val)
            out = Val(F.coalesce(col, none) if none is not None else col, v.type)
            rows, name = replace(rows, df=df), f"_agg{k}{tag}"
            extra = extra | {name: out}
            body = _swap(body, x, Ex("var", name))
        return rows, body, extra


def _all(conditions: list[Column]) -> Column:
    out = conditions[0] if conditions else F.lit(True)
    for c in conditions[1:]:
        out = out & c
    return out


def _absolute(e: Ex) -> bool:
    return e.op == "path" and e.val == "/" or e.op == "filter" and _absolute(e.args[0])


def _relational(e: Ex) -> bool:
    if e.op in ("union", "intersect", "except"):
        return all(map(_relational, e.args))
    if e.op == "call" and e.val in ("sort", "subsequence", "reverse", "head", "tail") or e.op == "path" and e.val == "" and e.args[0].op == "call":
        return _relational(e.args[0])
    return _absolute(e)


def _operands(e: Ex) -> list[Ex]:
    """The paths under set operators."""
    return [x for a in e.args for x in _operands(a)] if e.op in ("union", "intersect", "except") else [e]


def _conjuncts(p: Ex) -> list[Ex]:
    return [x for a in p.args for x in _conjuncts(a)] if p.op == "and" else [p]


def _positional(p: Ex) -> bool:
    return p.op == "lit" and p.val[0] != "string" or p.op == "call" and p.val == "last" or p.op in ("gcmp", "vcmp") and p.args[0].op == "call" and p.args[0].val == "position"


def _outside(e: Ex, rows: Rows) -> bool:
    return any(x.op == "var" for x in e.walk())


def _correlation(e: Ex, rows: Rows) -> bool:
    return any(x.op == "var" for x in e.walk())


def _swap(e: Ex, old: Ex, new: Ex) -> Ex:
    return new if e == old else replace(e, args=tuple(_swap(a, old, new) for a in e.args))


def _replace(e: Ex, name: str, value: Ex) -> Ex:
    return value if e.op == "var" and e.val == name else replace(e, args=tuple(_replace(a, name, value) for a in e.args))


def _with_focus(e: Ex) -> Ex:
    """Child steps and the context item of a mapped expression, as those of the variable _it."""
    if e.op == "ctx":
        return Ex("var", "_it")
    if e.op == "step" and e.val[0] == "child":
        return Ex("path", "", (Ex("var", "_it"), e))
    if e.op == "path" and e.val == "":
        first = e.args[0]
        return Ex("path", "", (Ex("var", "_it"), *e.args)) if first.op == "step" else replace(e, args=(_with_focus(first), *e.args[1:]))
    if e.op in ("filter", "map"):
        return replace(e, args=(_with_focus(e.args[0]), *e.args[1:]))
    return replace(e, args=tuple(_with_focus(a) for a in e.args))


def query(frames: dict[str, DataFrame], text: str, static: StaticContext | None = None, keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Runs an expression over tables as virtual documents."""
    return Tables(frames, keys or {}, static or StaticContext()).query(text)


Builder = Callable[..., DataFrame]
