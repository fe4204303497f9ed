"""Row-local lane: an expression over the columns of one row becomes one Column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError, error
from ..functions import library
from ..functions.library import array_get, atom, json_get, map_get, one, over
from ..functions.values import (
    ATOMIC, BOUNDS, LISTS, NUMERIC, SPARK, STRINGS, Val, base_of, cast_to, common, convert, empty, full_type, items,
    many, number, parse_string, raise_, single, spark_type, to_string, truth,
)
from .ast import Ex, SeqType
from .operators import GENERAL, arithmetic, compare
from .parser import NAMESPACES, StaticContext

#: Functions of the context item when they have no argument.
OF_CONTEXT = ("string", "number", "string-length", "normalize-space", "data", "tokenize", "name", "local-name", "namespace-uri", "node-name", "root", "path", "has-children", "generate-id", "lang", "nilled", "base-uri", "document-uri")


@dataclass
class RowCompiler:
    """Compiles under a focus, variables, and a resolver for paths that leave the row."""

    static: StaticContext = field(default_factory=StaticContext)
    focus: Val | None = None
    position: Column | None = None
    last: Column | None = None
    variables: dict[str, Val] = field(default_factory=dict)
    columns: dict[str, Val] = field(default_factory=dict)
    outer: Callable[[Ex, RowCompiler], Val | None] | None = None
    functions: dict[tuple[str, int], Callable] = field(default_factory=dict)

    def focused(self, item: Val, position: Column | None = None, last: Column | None = None) -> RowCompiler:
        return replace(self, focus=item, position=position, last=last, columns={})

    def bound(self, **values: Val) -> RowCompiler:
        return replace(self, variables=self.variables | values)

    def __call__(self, e: Ex) -> Val:
        if self.outer is not None and (found := self.outer(e, self)) is not None:
            return found
        return getattr(self, "_" + e.op.replace("-", "_"))(e)

    # primaries

    def _lit(self, e: Ex) -> Val:
        kind, value = e.val
        if kind == "integer":
            return Val(F.lit(int(value)).cast("bigint"), "integer", name=f"={value}")
        if kind == "double":
            return Val(F.lit(float(value)), "double", name=f"={value}")
        if kind == "decimal":
            return Val(F.lit(value).cast("decimal(38,18)"), "decimal", name=f"={value}")
        return Val(F.lit(value), "string", name=f"={value}")

    def _var(self, e: Ex) -> Val:
        if e.val not in self.variables:
            raise error("XPST0008", f"unknown variable ${e.val}")
        return self.variables[e.val]

    def _ctx(self, e: Ex) -> Val:
        if self.focus is None:
            raise error("XPDY0002", "no context item")
        return self.focus

    def _seq(self, e: Ex) -> Val:
        if not e.args:
            return empty()
        vals = [v for v in map(self, e.args) if v.type != "empty"]
        if not vals:
            return empty()
        if len(vals) == 1:
            return vals[0]
        if vals[0].type in ("map", "array"):
            return replace(vals[0], col=F.concat(*(items(v) for v in vals)), many=True, name=None, call=None)
        # items of several plain types are held as VARIANT, which keeps the type of each
        plain = {v.type for v in vals} <= {*NUMERIC, *STRINGS, "boolean", "json"}
        try:
            kind = common(vals)
        except UnsupportedError:
            if not plain:
                raise
            kind = "json"
        return Val(F.concat(*(items(convert(v, kind)) for v in vals)), kind, True)

    def _step(self, e: Ex) -> Val:
        axis, test = e.val
        if axis == "self" and test.kind in ("node", "item"):
            return self._ctx(e)
        if axis == "child" and test.kind == "name" and test.local in self.columns:
            out = self.columns[test.local]
            return self._filtered(out, e.args)
        if axis == "child" and test.kind == "name" and self.focus is not None and self.focus.type in ("map", "json"):
            raise error("XPTY0020", "a path step needs a node")
        raise UnsupportedError("XPTY0020", f"no column for step {axis}::{test.local or test.kind}")

    def _path(self, e: Ex) -> Val:
        if e.val == "/" or not e.args:
            raise UnsupportedError("XPDY0050", "an absolute path inside a row needs a relation")
        out, inner = self(e.args[0]), self
        for step in e.args[1:]:
            out = over(inner, out, lambda x, s=step: self.focused(x)(s))
        return out

    # operators

    def _or(self, e: Ex) -> Val:
        return Val(truth(self(e.args[0])) | truth(self(e.args[1])), "boolean")

    def _and(self, e: Ex) -> Val:
        return Val(truth(self(e.args[0])) & truth(self(e.args[1])), "boolean")

    def _vcmp(self, e: Ex) -> Val:
        a, b = (one(self(x)) for x in e.args)
        return Val(compare(e.val, a, b, self.static), "boolean")

    def _gcmp(self, e: Ex) -> Val:
        a, b = (atom(self(x)) for x in e.args)
        return Val(self.general(GENERAL[e.val], a, b), "boolean")

    def general(self, op: str, a: Val, b: Val) -> Column:
        """Whether some pair of items compares true."""
        if "empty" in (a.type, b.type):
            return F.lit(False)
        if self.static.number < 20 or self.static.compatible:
            if "boolean" in (a.type, b.type):
                a, b = Val(truth(a), "boolean"), Val(truth(b), "boolean")
            elif op in ("lt", "le", "gt", "ge") or {a.type, b.type} & set(NUMERIC):
                a, b = (v if v.type in NUMERIC else Val(F.transform(v.col, lambda x, v=v: number(Val(x, v.type)).col), "double", True) if v.many else number(v) for v in (a, b))
        if not a.many and not b.many:
            return F.coalesce(compare(op, a, b, self.static, True), F.lit(False))
        if op == "eq" and a.many and b.many and a.type == b.type and a.type not in ("double", "float", "dateTime", "date", "time"):
            return F.coalesce(F.arrays_overlap(a.col, b.col), F.lit(False))
        inner = lambda x: F.coalesce(compare(op, x, b, self.static, True), F.lit(False)) if not b.many else F.exists(b.col, lambda y: F.coalesce(compare(op, x, Val(y, b.type), self.static, True), F.lit(False)))
        return F.coalesce(F.exists(items(a), lambda x: inner(Val(x, a.type))), F.lit(False))

    def _arith(self, e: Ex) -> Val:
        a, b = (one(self(x)) for x in e.args)
        return arithmetic(e.val, a, b, self.static)

    def _neg(self, e: Ex) -> Val:
        v = one(self(e.args[0]))
        v = cast_to(v, "double") if v.type in ("untypedAtomic", "string") else v
        return v.with_col(-v.col) if v.name is None else Val(-v.col, v.type, name=f"=-{v.name[1:]}")

    def _pos(self, e: Ex) -> Val:
        return one(self(e.args[0]))

    def _concat(self, e: Ex) -> Val:
        return Val(F.concat(*(F.coalesce(to_string(one(self(x))), F.lit("")) for x in e.args)), "string")

    def _range(self, e: Ex) -> Val:
        a, b = (cast_to(one(self(x)), "integer").col for x in e.args)
        none = F.array().cast("array<bigint>")
        return Val(F.when((a <= b), F.sequence(a, F.greatest(a, b))).otherwise(none), "integer", True)

    def _union(self, e: Ex) -> Val:
        raise UnsupportedError("XPTY0004", "set operators need nodes")

    _intersect = _except = _ncmp = _union

    def _if(self, e: Ex) -> Val:
        test = truth(self(e.args[0]))
        a, b = self(e.args[1]), self(e.args[2])
        if a.type in ("map", "array", "json") or b.type in ("map", "array", "json"):
            full = a if a.type != "empty" else b
            return replace(full, col=F.when(test, a.col if a.type != "empty" else F.lit(None)).otherwise(b.col if b.type != "empty" else F.lit(None)), name=None, call=None)
        kind = common([a, b])
        a, b = convert(a, kind), convert(b, kind)
        if a.many or b.many:
            return Val(F.when(test, items(a)).otherwise(items(b)), kind, True)
        return Val(F.when(test, a.col).otherwise(b.col), kind)

    def _let(self, e: Ex) -> Val:
        inner = self
        for name, x in zip(e.val, e.args):
            inner = inner.bound(**{name: inner(x)})
        return inner(e.args[-1])

    def _for(self, e: Ex) -> Val:
        def level(k: int, c: RowCompiler) -> Val:
            if k == len(e.val):
                return c(e.args[-1])
            source = c(e.args[k])
            return over(c, source, lambda x: level(k + 1, c.bound(**{e.val[k]: x})))

        return level(0, self)

    def _quantified(self, e: Ex, test, start: int = 0) -> Val:
        def level(k: int, c: RowCompiler) -> Column:
            if k == len(e.val):
                return truth(c(e.args[-1]))
            v = many(c(e.args[k]))
            return test(v.col, lambda x: level(k + 1, c.bound(**{e.val[k]: v.with_col(x, False)})))

        return Val(level(0, self), "boolean")

    def _some(self, e: Ex) -> Val:
        return self._quantified(e, F.exists)

    def _every(self, e: Ex) -> Val:
        return self._quantified(e, F.forall)

    def _map(self, e: Ex) -> Val:
        out = self(e.args[0])
        return over(self, out, lambda x: self.focused(x)(e.args[1])) if out.many else self.focused(out)(e.args[1])

    def _filter(self, e: Ex) -> Val:
        return self._filtered(self(e.args[0]), e.args[1:])

    def _filtered(self, v: Val, predicates) -> Val:
        for p in predicates:
            v = many(v)
            size = F.size(v.col)
            probe = self.focused(v.with_col(F.lit(None).cast(spark_type(v)), False), F.lit(1).cast("bigint"), size)(p)
            numeric = probe.type in NUMERIC and not probe.many
            if numeric and p.op == "lit":
                v = v.with_col(F.filter(F.array(F.try_element_at(v.col, F.lit(int(float(p.val[1]))))), lambda x: x.isNotNull()))
            else:
                v = v.with_col(F.filter(v.col, self._keeps(v, p, size, numeric)))
        return v

    def _keeps(self, v: Val, p: Ex, size: Column, numeric: bool):
        def keep(x: Column, i: Column) -> Column:
            got = self.focused(v.with_col(x, False), (i + 1).cast("bigint"), size)(p)
            return got.col == i + 1 if numeric else truth(got)

        return keep

    # types

    def matches(self, v: Val, t: SeqType) -> Column:
        """Whether a value is of a sequence type; decided statically as far as the type goes."""
        name = t.name.removeprefix("xs:")
        size = F.coalesce(F.size(v.col), F.lit(0)) if v.many else (F.lit(0) if v.type == "empty" else F.when(v.col.isNull() if v.type != "function" else F.lit(False), 0).otherwise(1))
        if t.name == "empty-sequence":
            return size == 0
        right = {"": size == 1, "?": size <= 1, "*": F.lit(True), "+": size >= 1}[t.occurs]
        if v.type == "empty":
            return right
        if name == "item" or name == "anyAtomicType" and v.type in SPARK:
            good = True
        elif t.name in ("map", "array", "function"):
            good = v.type == t.name or t.name == "function" and v.type in ("map", "array")
        elif name == "numeric":
            good = v.type in NUMERIC
        else:
            good = v.type == name or (name == "decimal" and v.type == "integer") or (name == "duration" and v.type in ("yearMonthDuration", "dayTimeDuration"))
            if not good and name in BOUNDS and v.type == "integer":
                return F.lit(False)
        return right if good else (size == 0) & right

    def _instance(self, e: Ex) -> Val:
        return Val(self.matches(self(e.args[0]), e.val), "boolean")

    def _treat(self, e: Ex) -> Val:
        v = self(e.args[0])
        if v.type in ("empty", "function"):
            return v
        return v.with_col(F.when(self.matches(v, e.val), v.col).otherwise(raise_("XPDY0050", f"not of type {e.val}", full_type(v))))

    def _type_name(self, t: SeqType) -> str:
        name = t.name.removeprefix("xs:")
        if name not in ATOMIC:
            raise error("XPST0051", f"unknown type {t.name}")
        return name

    def qname(self, v: Val, strict: bool = True) -> Val:
        """A string as a QName, its prefix by the namespaces of the static context; none is the default one for elements."""
        out = cast_to(v, "QName", strict)
        known = [(p, u) for p, u in (NAMESPACES | dict(self.static.namespaces)).items()]
        uris = F.create_map(*[F.lit(x) for pair in [("", self.static.default_namespace), *known] for x in pair])
        uri = F.try_element_at(uris, out.col["prefix"])
        bound = F.coalesce(uri, raise_("FONS0004", "no namespace for a prefix", "string")) if strict else uri
        full = F.struct(bound.alias("ns"), out.col["prefix"].alias("prefix"), out.col["local"].alias("local"))
        return out.with_col(F.when(out.col.isNotNull() if strict else out.col.isNotNull() & uri.isNotNull(), full))

    def typed(self, v: Val, kind: str, strict: bool = True) -> Val:
        """One item cast to an atomic type."""
        return self.qname(v, strict) if base_of(kind) == "QName" and v.type in STRINGS else cast_to(v, kind, strict)

    def _cast(self, e: Ex) -> Val:
        v, kind = one(self(e.args[0])), self._type_name(e.val)
        out = self.typed(v, kind)
        if e.val.occurs != "?":
            if v.type == "empty":
                raise error("XPTY0004", "an empty sequence cannot be cast")
            out = out.with_col(F.when(v.col.isNull(), raise_("XPTY0004", "an empty sequence cannot be cast", spark_type(out))).otherwise(out.col))
        return out

    def _castable(self, e: Ex) -> Val:
        v, kind = one(self(e.args[0])), self._type_name(e.val)
        if v.type == "empty":
            return Val(F.lit(e.val.occurs == "?"), "boolean")
        try:
            out = self.typed(v, kind, strict=False)
        except Exception:  # noqa: BLE001  no cast between these types
            return Val(F.lit(False), "boolean")
        return Val(F.when(v.col.isNull(), F.lit(e.val.occurs == "?")).otherwise(out.col.isNotNull()), "boolean")

    # functions

    def function_item(self, name: str, arity: int, missing: bool = False) -> Val:
        if self._known(name, arity) is None:
            if missing:
                return empty()
            raise error("XPST0017", f"unknown function {name}#{arity}")
        names = [f"arg{k}" for k in range(arity)]
        call = lambda *vs: self.bound(**dict(zip(names, vs)))(Ex("call", name, tuple(Ex("var", n) for n in names)))
        return Val(None, "function", call=call, arity=arity, name=name)

    def _known(self, name: str, arity: int):
        if name.startswith("xs:") and arity == 1:
            return name
        return self.functions.get((name, arity)) or library.lookup(name, arity, self.static.number) or (name in ("position", "last") and arity == 0) or None

    def _funcref(self, e: Ex) -> Val:
        return self.function_item(*e.val)

    def _inline(self, e: Ex) -> Val:
        names, types, result = e.val

        def call(*vs: Val) -> Val:
            vs = tuple(self.promoted(v, t) if t is not None else v for v, t in zip(vs, types))
            out = replace(self, focus=None).bound(**dict(zip(names, vs)))(e.args[0])
            return self.promoted(out, result) if result is not None else out

        return Val(None, "function", call=call, arity=len(names))

    def promoted(self, v: Val, t: SeqType) -> Val:
        """The function conversion rules: atomization, untyped casts and numeric promotion."""
        name = t.name.removeprefix("xs:")
        if name not in SPARK or v.type in ("empty", "function"):
            return v
        v = atom(v)
        if v.type == "untypedAtomic" or v.type == "json" or v.type in NUMERIC and name in ("double", "float", "decimal"):
            return convert(v, name) if v.type != name else v
        if v.type == name or name == "string" and v.type in STRINGS or name == "anyAtomicType":
            return v
        if name == "decimal" and v.type == "integer":
            return v
        raise error("XPTY0004", f"{v.type} where {t} is asked for")

    def _call(self, e: Ex) -> Val:
        name, args = e.val, e.args
        if any(a.op == "placeholder" for a in args):
            fixed = [None if a.op == "placeholder" else self(a) for a in args]
            return self._partial(self.function_item(name, len(args)), fixed)
        if name.startswith("xs:") and len(args) == 1:
            return self.constructor(name[3:], self(args[0]))
        if name == "position" and not args:
            if self.position is None:
                raise error("XPDY0002", "no position")
            return Val(self.position, "integer")
        if name == "last" and not args:
            if self.last is None:
                raise error("XPDY0002", "no context size")
            return Val(self.last.cast("bigint"), "integer")
        if not args and name in OF_CONTEXT:
            args = (Ex("ctx"),)
        own = self.functions.get((name, len(args)))
        if own is not None:
            return own(*(self(a) for a in args))
        f = library.lookup(name, len(args), self.static.number)
        if f is None:
            raise error("XPST0017", f"unknown function {name}#{len(args)}")
        values = [self(a) for a in args]
        if name == "apply":
            values[1] = replace(values[1], call=tuple(self(x) for x in args[1].args), name="") if args[1].op == "sqarray" else values[1]
        return f(self, *values)

    def constructor(self, kind: str, v: Val) -> Val:
        if kind in LISTS:
            parts = F.split(F.trim(F.regexp_replace(to_string(one(v)), r"\s+", " ")), " ")
            return Val(F.transform(parts, lambda x: parse_string(x, LISTS[kind])), "string", True)
        if kind == "error":
            return Val(raise_("FORG0001", "xs:error has no values"), "string")
        if kind not in ATOMIC:
            raise error("XPST0017", f"unknown constructor xs:{kind}")
        v = one(v)
        return Val(self.typed(v, kind).col, base_of(kind))

    def _partial(self, f: Val, fixed: list) -> Val:
        def call(*vs: Val) -> Val:
            rest = iter(vs)
            return f.call(*(next(rest) if x is None else x for x in fixed))

        return Val(None, "function", call=call, arity=sum(x is None for x in fixed))

    def _dyncall(self, e: Ex) -> Val:
        f = self(e.args[0])
        if any(a.op == "placeholder" for a in e.args[1:]):
            return self._partial(f, [None if a.op == "placeholder" else self(a) for a in e.args[1:]])
        return library._result(self, f, *(self(a) for a in e.args[1:]))

    # maps and arrays

    def _mapctor(self, e: Ex) -> Val:
        keys, values = [one(self(k)) for k in e.args[::2]], [self(v) for v in e.args[1::2]]
        if not keys:
            return Val(F.create_map().cast("map<string,string>"), "map", part=Val(None, "string"), key="string", call={})
        names = [k.name for k in keys]
        if None not in names and len(set(names)) < len(names):
            raise error("XQDY0137", "duplicate key")
        key = common(keys)
        known = dict(zip((n[1:] if n else n for n in names), values))
        try:
            part, cols = self._uniform(values)
        except UnsupportedError:
            part = Val(None, "string")
            # a function item has no column: it is found by its key alone
            cols = [F.lit(None).cast("string") if v.type == "function" else to_string(one(v)) if v.type not in ("map", "array") else F.to_json(v.col) for v in values]
        flat = [x for k, c in zip(keys, cols) for x in (convert(k, key).col, c)]
        return Val(F.create_map(*flat), "map", part=part, key=key, call=known)

    def _uniform(self, values: list[Val]) -> tuple[Val, list[Column]]:
        full = [v for v in values if v.type != "empty"]
        if not full:
            return Val(None, "string"), [F.lit(None).cast("string")] * len(values)
        if any(v.type == "function" for v in full):
            raise UnsupportedError("XPTY0004", "function items have no native column")
        if full[0].type in ("map", "array", "json"):
            if any(spark_type(v) != spark_type(full[0]) for v in full):
                raise UnsupportedError("XPTY0004", "members of different types")
            wide = any(v.many for v in full)
            return replace(full[0], col=None, many=wide, call=None, name=None), [items(v) if wide else v.col for v in values]
        kind, wide = common(values), any(v.many for v in values)
        out = [convert(v, kind) for v in values]
        return Val(None, kind, wide), [items(v) if wide else v.col for v in out]

    def _sqarray(self, e: Ex) -> Val:
        values = [self(a) for a in e.args]
        if not values:
            return Val(F.array().cast("array<string>"), "array", part=Val(None, "string"))
        part, cols = self._uniform(values)
        return Val(F.array(*cols), "array", part=part)

    def _cuarray(self, e: Ex) -> Val:
        v = many(self(e.args[0])) if e.args else Val(F.array().cast("array<string>"), "string", True)
        return Val(v.col, "array", part=replace(v, col=None, many=False))

    def _key_of(self, e: Ex, offset: int) -> Val | None:
        kind, value = e.val
        if kind == "name":
            return Val(F.lit(value), "string", name=f"={value}")
        if kind == "int":
            return Val(F.lit(value).cast("bigint"), "integer", name=f"={value}")
        return None if kind == "all" else self(e.args[offset])

    def find(self, v: Val, key: Val | None) -> Val:
        """The lookup operator on one map, array or JSON value."""
        if v.many:
            return over(self, v, lambda x: self.find(x, key))
        if v.type == "map":
            if key is None:
                vals = F.map_values(v.col)
                return replace(v.part, col=F.flatten(vals) if v.part.many else vals, many=True)
            if isinstance(v.call, dict) and key.name is not None and key.name[1:] in v.call:
                return v.call[key.name[1:]]
            return map_get(v, key)
        if v.type == "array":
            if key is None:
                return replace(v.part, col=F.flatten(v.col) if v.part.many else v.col, many=True)
            return array_get(v, key)
        if v.type == "json":
            if key is None:
                each = F.coalesce(F.try_variant_get(v.col, "$", "array<variant>"), F.map_values(F.try_variant_get(v.col, "$", "map<string,variant>")))
                return Val(each, "json", True)
            return json_get(v, key)
        raise error("XPTY0004", f"no lookup in {v.type}")

    def _lookup(self, e: Ex) -> Val:
        return self.find(self(e.args[0]), self._key_of(e, 1))

    def _ulookup(self, e: Ex) -> Val:
        return self.find(self._ctx(e), self._key_of(e, 0))


def output(v: Val, name: str) -> Column:
    """A result column: numbers, strings and booleans as they are, other atomics as their string values."""
    plain = (*NUMERIC, "boolean", "string", "untypedAtomic", "anyURI")
    if v.type in (*plain, "map", "array", "empty") or v.type not in SPARK:
        return v.col.alias(name)
    if v.many:
        return F.transform(v.col, lambda x: to_string(Val(x, v.type))).alias(name)
    return to_string(v).alias(name)


def single_item(v: Val) -> Val:
    return single(v)
