"""Comparison and arithmetic of single typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import error
from ..functions.values import NUMERIC, SPARK, STRINGS, Val, cast_to, dated, moment, parse_string, raise_

_OPS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}
GENERAL = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
DATES, DURATIONS = ("dateTime", "date", "time"), ("yearMonthDuration", "dayTimeDuration", "duration")
ZERO = 0.0


def _untyped(a: Val, b: Val, general: bool) -> tuple[Val, Val]:
    """An untyped operand takes the other's type: double beside numbers, else string or the type itself."""
    for k, (x, y) in enumerate(((a, b), (b, a))):
        if x.type == "json":
            x = Val(x.col.cast("string"), "untypedAtomic")
        if x.type == "untypedAtomic":
            if y.type in ("untypedAtomic", *STRINGS, "json") or not general:
                x = Val(x.col, "string")
            else:
                x = cast_to(x, "double" if y.type in NUMERIC else y.type)
        a, b = (x, b) if k == 0 else (a, x)
    return a, b


def compare(op: str, a: Val, b: Val, static, general: bool = False) -> Column:
    """A value comparison of two single items; null where one is ()."""
    f = _OPS[op]
    if "empty" in (a.type, b.type):
        return F.lit(None).cast("boolean")
    a, b = _untyped(a, b, general)
    s, t = a.type, b.type
    if s in NUMERIC and t in NUMERIC:
        x, y = a.col, b.col
        if {s, t} & {"double", "float"}:
            # NaN equals nothing, and Spark orders it above all numbers
            nan = F.lit(False)
            for v, k in ((x, s), (y, t)):
                if k in ("double", "float"):
                    nan = nan | F.isnan(v)
            return F.when(nan, F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "ne"))).otherwise(f(x, y)) if op in ("ne", "gt", "ge", "eq", "le", "lt") and not _literal(a, b) else f(x, y) & (~F.isnan(x if s in ("double", "float") else y))
        return f(x, y)
    if s in STRINGS and t in STRINGS or s == t and s in ("boolean", "hexBinary", "base64Binary"):
        return f(a.col, b.col)
    if s == t and s in DATES:
        return f(moment(a, static.timezone), moment(b, static.timezone))
    if s in DURATIONS and t in DURATIONS:
        if s == t != "duration":
            return f(a.col, b.col)
        if op in ("eq", "ne"):
            x, y = cast_to(a, "duration").col, cast_to(b, "duration").col
            return f(F.struct(x["months"], x["secs"]), F.struct(y["months"], y["secs"]))
    if s == t == "QName" and op in ("eq", "ne"):
        return f(F.struct(a.col["ns"], a.col["local"]), F.struct(b.col["ns"], b.col["local"]))
    raise error("XPTY0004", f"{s} {op} {t}")


def _literal(a: Val, b: Val) -> bool:
    """One side is a number written in the expression, which is no NaN: the test stays a plain predicate that scans can take."""
    return any(v.name is not None and v.name.startswith("=") for v in (a, b))


def arithmetic(op: str, a: Val, b: Val, static) -> Val:
    """An arithmetic operator on two single items; () gives ()."""
    if "empty" in (a.type, b.type):
        return Val(F.lit(None).cast("string"), "empty")
    a, b = (cast_to(Val(v.col.cast("string"), "untypedAtomic"), "double") if v.type in ("untypedAtomic", "json") or v.type in STRINGS and static.compatible else v for v in (a, b))
    s, t = a.type, b.type
    if s in NUMERIC and t in NUMERIC:
        return _numbers(op, a, b)
    if s in DATES and t in DURATIONS and op in "+-":
        return _shift(a, b, 1 if op == "+" else -1)
    if op == "+" and s in DURATIONS and t in DATES:
        return _shift(b, a, 1)
    if op == "-" and s == t and s in DATES:
        x, y = moment(a, static.timezone), moment(b, static.timezone)
        secs = (x - y) / 1_000_000 if s == "time" else F.expr("1") * (F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))).cast("decimal(26,0)") / F.lit(1_000_000).cast("decimal(8,0)")
        return Val(secs.cast(SPARK["dayTimeDuration"]), "dayTimeDuration")
    if s == t and s in DURATIONS[:2]:
        if op in ("+", "-"):
            return Val((a.col + b.col if op == "+" else a.col - b.col).cast(SPARK[s]), s)
        if op == "div":
            return Val((a.col.cast("decimal(20,6)") / b.col.cast("decimal(18,6)")).cast(SPARK["decimal"]), "decimal")
    if s in DURATIONS[:2] and t in NUMERIC and op in ("*", "div"):
        n = b.col.cast("double")
        raw = a.col * n if op == "*" else F.when(n == 0, raise_("FODT0002", "duration divided by zero", "double")).otherwise(a.col / n)
        return Val((F.floor(raw + 0.5) if s == "yearMonthDuration" else raw).cast(SPARK[s]), s)
    if t in DURATIONS[:2] and s in NUMERIC and op == "*":
        return arithmetic(op, b, a, static)
    raise error("XPTY0004", f"{s} {op} {t}")


def _numbers(op: str, a: Val, b: Val) -> Val:
    kind = max(a.type, b.type, key=NUMERIC.index)
    if op in ("+", "-", "*"):
        x, y = (v.col.cast(SPARK[kind]) if v.type != kind else v.col for v in (a, b))
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op]()
        return Val(out.cast(SPARK[kind]) if kind in ("float", "decimal") else out, kind)
    floating = kind in ("double", "float")
    if floating:
        x, y = (v.col.cast(SPARK[kind]) for v in (a, b))
    elif kind == "integer":
        x, y = a.col, b.col
    else:
        x, y = a.col.cast("decimal(28,9)"), b.col.cast("decimal(18,9)")
    zero = raise_("FOAR0001", "division by zero", "double")
    if op == "div":
        if floating:
            # Spark refuses 0 as a divisor: IEEE results by the signs
            inf = F.lit(float("inf"))
            by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when((x > 0) == ~F.coalesce(y.cast("string").startswith("-"), F.lit(False)), inf).otherwise(-inf)
            return Val(F.when(y == 0, by_zero).otherwise(F.try_divide(x, y)).cast(SPARK[kind]), kind)
        if kind == "integer":
            x, y = x.cast("decimal(18,0)"), y.cast("decimal(18,0)")
        return Val(F.when(y == 0, zero.cast(SPARK["decimal"])).otherwise(F.try_divide(x, y).cast(SPARK["decimal"])), "decimal")
    if op == "idiv":
        if kind == "integer":
            q = F.try_divide(x.cast("decimal(19,0)") - F.try_mod(x, y).cast("decimal(19,0)"), y.cast("decimal(19,0)"))
        else:
            q = F.try_divide(x, y)
            q = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
        return Val(F.when(y == 0, zero.cast("bigint")).otherwise(q.cast("bigint")), "integer")
    m = F.try_mod(x, y)
    if floating:
        return Val(F.when(y == 0, F.lit(float("nan"))).when(F.abs(y) == float("inf"), x).otherwise(m).cast(SPARK[kind]), kind)
    return Val(F.when(y == 0, zero.cast(SPARK[kind])).otherwise(m.cast(SPARK[kind])), kind)


def _shift(d: Val, by: Val, sign: int) -> Val:
    v, tz = d.col["v"], d.col["tz"]
    span = cast_to(by, "duration").col
    months, secs = span["months"] * sign, span["secs"] * sign
    if d.type == "time":
        return Val(dated(F.pmod(v + (secs * 1_000_000).cast("bigint"), F.lit(86_400_000_000)), tz), "time")
    moved = v.cast("timestamp_ntz")
    if by.type != "dayTimeDuration":
        moved = moved + F.make_ym_interval(months=months)
    if by.type != "yearMonthDuration":
        moved = moved + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
    return Val(F.when(d.col.isNotNull(), dated(moved.cast("date") if d.type == "date" else moved, tz)), d.type)


def cast_untyped(v: Val, kind: str) -> Val:
    return Val(parse_string(v.col, kind), kind)
