"""The function library: each function builds a Column expression from typed values."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable
from dataclasses import replace
from urllib.parse import urljoin

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedError, error
from . import pictures, regex, udfs
from .values import (
    NUMERIC, SPARK, STRINGS, Val, cast_to, common, convert, dated, empty, full_type, items, many, moment, number, once,
    parse_string, raise_, single, spark_type, to_string, truth,
)

#: name -> [(least arity, most arity or None, first version, builder)]
FUNCTIONS: dict[str, list[tuple[int, int | None, int, Callable]]] = {}
COLLATIONS = {
    "http://www.w3.org/2005/xpath-functions/collation/codepoint": "UTF8_BINARY",
    "http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive": "UTF8_LCASE",
    "http://www.w3.org/2013/collation/UCA": "UNICODE",
}


def fn(names: str, least: int, most: int | None = -1, since: int = 20):
    """Registers a builder called with the compiler and its argument values."""

    def add(f):
        for name in names.split():
            FUNCTIONS.setdefault(name, []).append((least, least if most == -1 else most, since, f))
        return f

    return add


def lookup(name: str, arity: int, version: int) -> Callable | None:
    for least, most, since, f in FUNCTIONS.get(name.removeprefix("fn:"), ()):
        if version >= since and arity >= least and (most is None or arity <= most):
            return f
    return None


def atom(v: Val) -> Val:
    """Atomization: members of arrays; maps and functions have no atomic value."""
    if v.type == "array":
        part = v.part
        inner = lambda a: F.flatten(a) if part.many else a
        col = F.flatten(F.transform(v.col, inner)) if v.many else inner(v.col)
        return atom(replace(part, col=col, many=True))
    if v.type in ("map", "function"):
        raise error("FOTY0013", f"a {v.type} has no typed value")
    return v


def one(v: Val) -> Val:
    return single(atom(v))


def text(v: Val) -> Column:
    """A string argument: '' where it is ()."""
    return F.coalesce(to_string(one(v)), F.lit(""))


def literal(v: Val, what: str) -> str:
    """The value of a constant string argument."""
    if v.name is None or not v.name.startswith("="):
        raise UnsupportedError("XPST0017", f"{what} must be a literal")
    return v.name[1:]


def string(col: Column) -> Val:
    return Val(col, "string")


def integer(col: Column) -> Val:
    return Val(col.cast("bigint"), "integer")


def boolean(col: Column) -> Val:
    return Val(col, "boolean")


def double(v: Val) -> Column:
    return cast_to(one(v), "double").col


def collate(col: Column, name: str | None) -> Column:
    if name is None or name == next(iter(COLLATIONS)):
        return col
    base = name.split("?")[0]
    if base not in COLLATIONS:
        raise error("FOCH0002", f"unknown collation {name}")
    return F.collate(col, COLLATIONS[base])


def each(v: Val, f: Callable[[Column], Column], kind: str | None = None) -> Val:
    """Applies a column function to the item or to each item."""
    return Val(F.transform(v.col, f) if v.many else f(v.col), kind or v.type, v.many)


# booleans, errors


@fn("true", 0, since=10)
def _(c):
    return boolean(F.lit(True))


@fn("false", 0, since=10)
def _(c):
    return boolean(F.lit(False))


@fn("boolean", 1, since=10)
def _(c, v):
    return boolean(truth(v))


@fn("not", 1, since=10)
def _(c, v):
    return boolean(~truth(v))


@fn("error", 0, 3)
def _(c, code=None, message=None, items=None):
    label = F.coalesce(to_string(one(code)), F.lit("FOER0000")) if code else F.lit("FOER0000")
    label = F.regexp_replace(label, "^.*:", "")
    return string(F.raise_error(F.concat(F.lit("[err:"), label, F.lit("] "), text(message) if message else F.lit(""))).cast("string"))


@fn("trace", 1, 2)
def _(c, v, label=None):
    return v


# strings


@fn("string", 1, since=10)
def _(c, v):
    if v.type in ("map", "function", "array"):
        raise error("FOTY0014", f"a {v.type} has no string value")
    return string(text(v))


@fn("concat", 2, None, since=10)
def _(c, *vs):
    return string(F.concat(*(text(v) for v in vs)))


def _compares(name, f):
    @fn(name, 2, 3, since=10 if name != "ends-with" else 20)
    def _(c, a, b, collation=None):
        how = literal(collation, "a collation") if collation else c.static.collation
        return boolean(f(collate(text(a), how), collate(text(b), how)))


_compares("contains", lambda a, b: F.contains(a, b))
_compares("starts-with", lambda a, b: F.startswith(a, b))
_compares("ends-with", lambda a, b: F.endswith(a, b))


@fn("substring-before", 2, 3, since=10)
def _(c, a, b, collation=None):
    a, b = text(a), text(b)
    at = F.locate_(b, a) if hasattr(F, "locate_") else F.position(b, a)
    return string(F.when((at > 0) & (b != ""), F.substr(a, F.lit(1), at - 1)).otherwise(""))


@fn("substring-after", 2, 3, since=10)
def _(c, a, b, collation=None):
    a, b = text(a), text(b)
    at = F.position(b, a)
    return string(F.when(b == "", a).when(at > 0, F.substr(a, at + F.char_length(b))).otherwise(""))


def _rounded(d: Column) -> Column:
    return F.floor(d + 0.5).cast("double")


@fn("substring", 2, 3, since=10)
def _(c, v, start, length=None):
    s = text(v)
    begin, size = double(start), F.char_length(s)
    big = float(1 << 40)
    tame = lambda d: F.when(d > big, F.lit(big)).when(d < -big, F.lit(-big)).otherwise(d)
    first = _rounded(tame(begin))
    last = first + _rounded(tame(double(length))) if length else F.lit(big)
    bad = F.isnan(begin) | (F.isnan(double(length)) if length else F.lit(False)) | (F.isnan(begin + double(length)) if length else F.lit(False))
    low = F.greatest(first, F.lit(1.0)).cast("int")
    high = F.least(last, size.cast("double") + 1).cast("int")
    return string(F.when(bad | (first > size) | (high <= low), "").otherwise(F.substr(s, low, high - low)))


@fn("string-length", 1, since=10)
def _(c, v):
    return integer(F.char_length(text(v)))


@fn("normalize-space", 1, since=10)
def _(c, v):
    return string(F.trim(F.regexp_replace(text(v), r"[ \t\r\n]+", " ")))


@fn("translate", 3, since=10)
def _(c, v, a, b):
    source, target = literal(a, "the map string"), literal(b, "the translate string")
    seen: dict[str, str] = {}
    for k, ch in enumerate(source):
        seen.setdefault(ch, target[k] if k < len(target) else "")
    kept = [ch for ch in seen if seen[ch]]
    order = kept + [ch for ch in seen if not seen[ch]]
    return string(F.translate(text(v), "".join(order), "".join(seen[ch] for ch in kept)))


@fn("upper-case", 1)
def _(c, v):
    return string(F.upper(text(v)))


@fn("lower-case", 1)
def _(c, v):
    return string(F.lower(text(v)))


@fn("string-join", 1, 2)
def _(c, v, sep=None):
    v = many(atom(v))
    parts = F.transform(v.col, lambda x: to_string(Val(x, v.type))) if v.type not in STRINGS else v.col
    return string(F.array_join(parts, "", "") if sep is None else F.call_function("array_join", parts, text(sep)))


@fn("compare", 2, 3)
def _(c, a, b, collation=None):
    how = literal(collation, "a collation") if collation else c.static.collation
    a, b = collate(to_string(one(a)), how), collate(to_string(one(b)), how)
    return integer(F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0))


@fn("codepoint-equal", 2)
def _(c, a, b):
    return boolean(to_string(one(a)) == to_string(one(b)))


@fn("codepoints-to-string", 1)
def _(c, v):
    return string(udfs.call(pictures.codepoints_to_string, "string", items(atom(v))))


@fn("string-to-codepoints", 1)
def _(c, v):
    utf = F.transform(F.filter(F.split(text(v), ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("bigint"))
    return Val(utf, "integer", True)


@fn("normalize-unicode", 1, 2)
def _(c, v, form=None):
    return string(udfs.call(pictures.normalize_unicode, "string", text(v), text(form) if form else F.lit("NFC")))


@fn("encode-for-uri", 1)
def _(c, v):
    # Java's form encoding differs in four characters
    s = F.url_encode(text(v))
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        s = F.regexp_replace(s, a, b)
    return string(s)


@fn("iri-to-uri", 1)
def _(c, v):
    return string(udfs.call(pictures.iri_to_uri, "string", text(v)))


@fn("escape-html-uri", 1)
def _(c, v):
    return string(udfs.call(pictures.escape_html_uri, "string", text(v)))


@fn("resolve-uri", 1, 2)
def _(c, v, base=None):
    root = text(base) if base else F.lit(c.static.base_uri or "")
    return Val(udfs.call(pictures.resolve_uri, "string", to_string(one(v)), root), "anyURI")


def _flags(flags):
    return literal(flags, "flags") if flags else ""


@fn("matches", 2, 3)
def _(c, v, pattern, flags=None):
    return boolean(text(v).rlike(regex.translate(literal(pattern, "a pattern"), _flags(flags))))


@fn("replace", 3, 4)
def _(c, v, pattern, to, flags=None):
    p, f = literal(pattern, "a pattern"), _flags(flags)
    if regex.matches_empty(p, f):
        raise error("FORX0003", "the pattern matches the empty string")
    return string(F.regexp_replace(text(v), regex.translate(p, f), regex.replacement(literal(to, "a replacement"), f)))


@fn("tokenize", 2, 3)
def _(c, v, pattern, flags=None):
    p, f = literal(pattern, "a pattern"), _flags(flags)
    if regex.matches_empty(p, f):
        raise error("FORX0003", "the pattern matches the empty string")
    s = text(v)
    return Val(F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, regex.translate(p, f), -1)), "string", True)


@fn("tokenize", 1, since=31)
def _(c, v):
    s = F.trim(F.regexp_replace(text(v), r"[ \t\r\n]+", " "))
    return Val(F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")), "string", True)


@fn("contains-token", 2, 3, since=31)
def _(c, v, token, collation=None):
    how = literal(collation, "a collation") if collation else None
    t = F.trim(text(token))
    found = lambda x: F.exists(F.split(F.regexp_replace(x, r"[ \t\r\n]+", " "), " "), lambda y: collate(y, how) == collate(t, how))
    return boolean((t != "") & F.exists(items(atom(v)), found))


@fn("collation-key", 1, 2, since=31)
def _(c, v, collation=None):
    how = COLLATIONS.get((literal(collation, "a collation") if collation else c.static.collation).split("?")[0], "UTF8_BINARY")
    s = text(v)
    return Val((F.lower(s) if how != "UTF8_BINARY" else s).cast("binary"), "base64Binary")


@fn("analyze-string", 2, 3, since=30)
def _(c, v, pattern, flags=None):
    """The result as an array of maps: kind (match or non-match), text, and the groups of a match."""
    java = regex.translate(literal(pattern, "a pattern"), _flags(flags))
    s = text(v)
    found = F.regexp_extract_all(s, F.lit(f"(?s)({java})"), F.lit(1))
    between = F.split(s, java, -1)
    pair = lambda k, t: F.create_map(F.lit("kind"), F.lit(k), F.lit("text"), t)
    mixed = F.flatten(F.zip_with(between, found, lambda a, b: F.array(pair("non-match", a), pair("match", b))))
    kept = F.filter(mixed, lambda m: m["text"].isNotNull() & (m["text"] != ""))
    return Val(kept, "map", True, part=string(None), key="string")


# numbers


@fn("number", 1, since=10)
def _(c, v):
    return number(one(v))


def _numeric(v: Val) -> Val:
    v = one(v)
    if v.type in (*STRINGS, "empty", "json"):
        return cast_to(Val(v.col.cast("string"), "untypedAtomic"), "double")
    if v.type not in NUMERIC:
        raise error("XPTY0004", f"{v.type} is no number")
    return v


@fn("abs", 1)
def _(c, v):
    v = _numeric(v)
    return v.with_col(F.abs(v.col).cast(SPARK[v.type]))


def _steps(name, f):
    @fn(name, 1, since=10)
    def _(c, v):
        v = _numeric(v)
        if v.type in ("double", "float"):
            odd = F.isnan(v.col) | (F.abs(v.col) >= 1e15)
            return v.with_col(F.when(odd, v.col).otherwise(f(v.col).cast(SPARK[v.type])))
        return v.with_col(f(v.col).cast(SPARK[v.type]))


_steps("ceiling", F.ceil)
_steps("floor", F.floor)


@fn("round", 1, 2, since=10)
def _(c, v, places=None):
    v = _numeric(v)
    if v.type == "integer" and places is None:
        return v
    p = F.lit(0) if places is None else one(places).col
    if v.type in ("double", "float"):
        scale = F.pow(F.lit(10.0), p)
        out = F.floor(v.col * scale + 0.5) / scale
        odd = F.isnan(v.col) | (F.abs(v.col) >= 1e15)
        return v.with_col(F.when(odd, v.col).otherwise(out.cast(SPARK[v.type])))
    scale = F.pow(F.lit(10.0), p).cast("decimal(20,6)")
    half = F.lit(0.5).cast("decimal(2,1)")
    if places is None:
        return v.with_col(F.floor(v.col + half).cast(SPARK[v.type]))
    d = v.col.cast("decimal(28,9)")
    return v.with_col((F.floor(d * scale + half).cast("decimal(28,6)") / scale).cast(SPARK[v.type]))


@fn("round-half-to-even", 1, 2)
def _(c, v, places=None):
    v = _numeric(v)
    p = int(literal(places, "the precision")) if places is not None else 0
    if v.type in ("double", "float"):
        odd = F.isnan(v.col) | (F.abs(v.col) >= 1e15)
        return v.with_col(F.when(odd, v.col).otherwise(F.bround(F.when(odd, 0.0).otherwise(v.col).cast("decimal(38,15)"), p).cast(SPARK[v.type])))
    return v.with_col(F.bround(v.col.cast("decimal(38,15)"), p).cast(SPARK[v.type]))


@fn("format-integer", 2, 3, since=30)
def _(c, n, picture, lang=None):
    digits = picture.name[1:] if (picture.name or "").startswith("=") else ""
    if digits and set(digits) <= {"0", "1"} and "1" not in digits[:-1]:  # so many digits at least
        i = one(n).col.cast("bigint")
        size = F.abs(i).cast("string")
        return string(F.coalesce(F.concat(F.when(i < 0, "-").otherwise(""), F.repeat(F.lit("0"), F.greatest(F.lit(len(digits)) - F.length(size), F.lit(0))), size), F.lit("")))
    return string(udfs.call(udfs.format_integer, "string", one(n).col.cast("bigint"), text(picture), to_string(one(lang)) if lang else F.lit(c.static.language)))


@fn("format-number", 2, 3, since=30)
def _(c, n, picture, name=None):
    v = _numeric(n)
    if v.type in ("double", "float"):
        s = F.when(F.isnan(v.col), "NaN").otherwise(v.col.cast("string"))
        return string(udfs.call(udfs.format_double, "string", s, text(picture)))
    return string(udfs.call(udfs.format_text_number, "string", v.col.cast("string"), text(picture)))


@fn("random-number-generator", 0, 1, since=31)
def _(c, seed=None):
    base = F.xxhash64(text(seed)) if seed else F.xxhash64(F.lit("0"))
    draw = F.pmod(base, F.lit(1 << 53)).cast("double") / float(1 << 53)
    return Val(F.create_map(F.lit("number"), draw), "map", part=Val(None, "double"), key="string")


def _math(name, f, arity=1):
    @fn(f"math:{name}", arity, since=30)
    def _(c, *vs):
        return Val(f(*(double(v) for v in vs)), "double")


_INF, _NAN = float("inf"), float("nan")
_math("pi", lambda: F.lit(math.pi), 0)
_math("exp", F.exp)
_math("exp10", lambda x: F.pow(F.lit(10.0), x))
_math("log", lambda x: F.when(x == 0, -_INF).when(x < 0, _NAN).otherwise(F.ln(x)))
_math("log10", lambda x: F.when(x == 0, -_INF).when(x < 0, _NAN).otherwise(F.log10(x)))
_math("sqrt", F.sqrt)
_math("sin", F.sin)
_math("cos", F.cos)
_math("tan", F.tan)
_math("asin", F.asin)
_math("acos", F.acos)
_math("atan", F.atan)
_math("atan2", F.atan2, 2)
_math("pow", lambda x, y: F.when((x == 1) | (y == 0), 1.0).when((x == -1) & (F.abs(y) == _INF), 1.0).otherwise(F.pow(x, y)), 2)


# aggregates and sequences


@fn("count", 1, since=10)
def _(c, v):
    if v.many:
        return integer(F.coalesce(F.size(v.col), F.lit(0)))
    return integer(F.lit(0) if v.type == "empty" else F.when(v.col.isNull(), 0).otherwise(1))


def _numbers(v: Val) -> Val:
    v = many(atom(v))
    if v.type in ("untypedAtomic", "json", "string"):
        return Val(F.transform(v.col, lambda x: parse_string(x.cast("string"), "double")), "double", True)
    if v.type == "empty":
        return Val(v.col.cast("array<bigint>"), "integer", True)
    return v


def fold(v: Val) -> Column:
    """The sum of an array; 0 where it is empty."""
    kind = "decimal(38,18)" if v.type == "decimal" else SPARK[v.type]
    return F.aggregate(v.col, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


@fn("sum", 1, 2, since=10)
def _(c, v, zero=None):
    v = _numbers(v)
    if v.type not in (*NUMERIC, "yearMonthDuration", "dayTimeDuration"):
        raise error("FORG0006", f"no sum of {v.type}")
    total = Val(fold(v), v.type)
    if zero is None:
        return total
    other = convert(one(zero), v.type)
    return Val(F.when(F.size(v.col) == 0, other.col).otherwise(total.col), v.type)


@fn("avg", 1)
def _(c, v):
    v = _numbers(v)
    n = F.nullif(F.size(v.col), F.lit(0))
    if v.type in ("integer", "decimal"):
        return Val((fold(v).cast("decimal(28,9)") / n.cast("decimal(18,0)")).cast("decimal(38,18)"), "decimal")
    return Val((fold(v) / n).cast(SPARK[v.type]), v.type)


def _extreme(name, sign):
    @fn(name, 1, 2)
    def _(c, v, collation=None):
        v = atom(v)
        v = _numbers(v) if v.type in ("untypedAtomic", "json") else many(v)
        if v.type == "empty":
            return empty()
        if v.type in ("dateTime", "date", "time"):
            keyed = F.transform(v.col, lambda x: F.struct(moment(Val(x, v.type), c.static.timezone).alias("k"), x.alias("x")))
            return Val(sign(keyed)["x"], v.type)
        if v.type in ("double", "float"):
            nan = F.exists(v.col, F.isnan)
            return Val(F.when(nan, F.lit(_NAN).cast(SPARK[v.type])).otherwise(sign(v.col)), v.type)
        return Val(sign(v.col), v.type)


_extreme("max", F.array_max)
_extreme("min", F.array_min)


@fn("empty", 1)
def _(c, v):
    return boolean(F.coalesce(F.size(v.col) == 0, F.lit(True)) if v.many else v.col.isNull())


@fn("exists", 1)
def _(c, v):
    return boolean(F.coalesce(F.size(v.col) > 0, F.lit(False)) if v.many else v.col.isNotNull())


@fn("distinct-values", 1, 2)
def _(c, v, collation=None):
    v = many(atom(v))
    if v.type in ("dateTime", "date", "time", "map"):
        keyed = F.transform(v.col, lambda x: moment(Val(x, v.type), c.static.timezone))
        return v.with_col(F.filter(v.col, lambda x, i: F.array_position(keyed, moment(Val(x, v.type), c.static.timezone)) == i + 1))
    if v.type == "json":  # by the kind of each item and its string value
        name = lambda x: F.concat(F.when(F.schema_of_variant(x) == "STRING", "s").otherwise("n"), x.cast("string"))
        names = F.transform(v.col, name)
        return v.with_col(F.filter(v.col, lambda x, i: F.array_position(names, name(x)) == i + 1))
    if collation is not None:
        how = literal(collation, "a collation")
        low = F.transform(v.col, lambda x: F.lower(x) if COLLATIONS.get(how.split("?")[0]) != "UTF8_BINARY" else x)
        return v.with_col(F.filter(v.col, lambda x, i: F.array_position(low, low[i]) == i + 1))
    return v.with_col(F.array_distinct(v.col))


@fn("insert-before", 3)
def _(c, v, at, more):
    kind = common([v, more])
    a, b = items(convert(v, kind)), items(convert(more, kind))
    p = F.least(F.greatest(one(at).col, F.lit(1)), F.size(a) + 1).cast("int")
    head = F.when(p > 1, F.slice(a, F.lit(1), F.greatest(p - 1, F.lit(0)))).otherwise(F.array().cast(f"array<{SPARK[kind]}>"))
    return Val(F.concat(head, b, F.slice(a, p, F.size(a))), kind, True)


def general_equal(a: Val, b: Val, static) -> Column:
    """eq of two single atoms of comparable types."""
    from ..plans.operators import compare

    return F.coalesce(compare("eq", a, b, static), F.lit(False))


@fn("index-of", 2, 3)
def _(c, v, what, collation=None):
    v, w = many(atom(v)), one(what)
    found = F.transform(v.col, lambda x, i: F.when(general_equal(Val(x, v.type), w, c.static), i + 1))
    return Val(F.filter(found, lambda x: x.isNotNull()).cast("array<bigint>"), "integer", True)


@fn("remove", 2)
def _(c, v, at):
    v, p = many(v), one(at).col
    return v.with_col(F.filter(v.col, lambda x, i: (i + 1) != p))


@fn("reverse", 1)
def _(c, v):
    return many(v).with_col(F.reverse(items(v)))


@fn("subsequence", 2, 3)
def _(c, v, start, length=None):
    v = many(v)
    first = _rounded(double(start))
    keep = lambda i: ((i + 1) >= first) & (((i + 1) < first + _rounded(double(length))) if length else F.lit(True))
    return v.with_col(F.filter(v.col, lambda x, i: keep(i)))


@fn("head", 1, since=30)
def _(c, v):
    return v.with_col(F.try_element_at(v.col, F.lit(1)), False) if v.many else v


@fn("tail", 1, since=30)
def _(c, v):
    v = many(v)
    return v.with_col(F.filter(v.col, lambda x, i: i > 0))


@fn("unordered", 1)
def _(c, v):
    return v


def _cardinality(name, code, good, result_many):
    @fn(name, 1)
    def _(c, v):
        v = many(v)
        checked = F.when(good(F.size(v.col)), v.col).otherwise(raise_(code, f"{name} does not hold", full_type(v)))
        return v.with_col(checked) if result_many else v.with_col(F.try_element_at(checked, F.lit(1)), False)


_cardinality("zero-or-one", "FORG0003", lambda n: n <= 1, False)
_cardinality("one-or-more", "FORG0004", lambda n: n >= 1, True)
_cardinality("exactly-one", "FORG0005", lambda n: n == 1, False)


@fn("deep-equal", 2, 3)
def _(c, a, b, collation=None):
    if a.type == "empty" or b.type == "empty":
        other = b if a.type == "empty" else a
        return boolean(F.lit(True) if other.type == "empty" else F.size(items(other)) == 0)
    if "map" in (a.type, b.type):
        if a.type != b.type or a.key != b.key:
            return boolean(F.lit(False))
        plain = lambda v: F.transform(items(v), lambda m: F.array_sort(F.map_entries(m)))
        return boolean(plain(a) == plain(b))
    if a.type != b.type:
        if not (a.type in NUMERIC and b.type in NUMERIC or a.type in STRINGS and b.type in STRINGS):
            return boolean(F.lit(False))
        kind = common([a, b])
        a, b = convert(a, kind), convert(b, kind)
    return boolean(items(a).eqNullSafe(items(b)))


def _sorted(c, v: Val, key=None, collation=None) -> Val:
    v = many(v)

    def of(x: Column) -> Column:
        k = one(key.call(v.with_col(x, False))) if key is not None else one(v.with_col(x, False))
        if k.type in ("dateTime", "date", "time"):
            return moment(k, c.static.timezone)
        if k.type in ("double", "float"):
            return F.struct(~F.isnan(k.col), k.col)
        return collate(k.col, collation)

    order = lambda a, b: F.when(of(a).isNull() & of(b).isNull(), 0).when(of(a).isNull() | (of(a) < of(b)), -1).when(of(b).isNull() | (of(a) > of(b)), 1).otherwise(0)
    # the sort is stable by position
    numbered = F.transform(v.col, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    full = F.array_sort(numbered, lambda a, b: F.when(order(a["x"], b["x"]) != 0, order(a["x"], b["x"])).otherwise(a["i"] - b["i"]))
    return v.with_col(F.transform(full, lambda s: s["x"]))


@fn("sort", 1, 3, since=31)
def _(c, v, collation=None, key=None):
    how = None if collation is None or collation.type == "empty" else literal(collation, "a collation")
    return _sorted(c, v, key, how)


# QNames and context


@fn("QName", 2)
def _(c, uri, name):
    s = text(name)
    return Val(F.struct(text(uri).alias("ns"), F.regexp_extract(s, "^(.*):", 1).alias("prefix"), F.regexp_replace(s, "^.*:", "").alias("local")), "QName")


@fn("prefix-from-QName", 1)
def _(c, v):
    return string(F.nullif(one(v).col["prefix"], F.lit("")))


@fn("local-name-from-QName", 1)
def _(c, v):
    return string(one(v).col["local"])


@fn("namespace-uri-from-QName", 1)
def _(c, v):
    return Val(one(v).col["ns"], "anyURI")


@fn("default-collation", 0)
def _(c):
    return string(F.lit(c.static.collation))


@fn("default-language", 0, since=31)
def _(c):
    return string(F.lit(c.static.language))


@fn("static-base-uri", 0)
def _(c):
    return Val(F.lit(c.static.base_uri).cast("string"), "anyURI")


@fn("environment-variable", 1, since=30)
def _(c, name):
    known = dict(c.static.environment or ())
    return string(F.lit(known.get(literal(name, "a name"))).cast("string"))


@fn("available-environment-variables", 0, since=30)
def _(c):
    return Val(F.array(*(F.lit(n) for n, _ in c.static.environment or ())).cast("array<string>"), "string", True)


# dates, times, durations


def _parts(kind, table):
    for name, f in table.items():

        def build(c, v, f=f):
            v = cast_to(one(v), kind) if v.type in ("untypedAtomic", "empty") else one(v)
            return f(v.col)

        fn(f"{name}-from-{kind}", 1)(build)


_ts = lambda f: lambda s: integer(f(s["v"]))
_zone = lambda s: Val((s["tz"] * 60).cast(SPARK["dayTimeDuration"]), "dayTimeDuration")
_parts("dateTime", {
    "year": _ts(F.year), "month": _ts(F.month), "day": _ts(F.day), "hours": _ts(F.hour), "minutes": _ts(F.minute),
    "seconds": lambda s: Val(F.extract(F.lit("SECOND"), s["v"]).cast("decimal(38,18)"), "decimal"), "timezone": _zone,
})
_parts("date", {"year": _ts(F.year), "month": _ts(F.month), "day": _ts(F.day), "timezone": _zone})
_parts("time", {
    "hours": lambda s: integer(F.floor(s["v"] / 3_600_000_000)), "minutes": lambda s: integer(F.floor(s["v"] / 60_000_000) % 60),
    "seconds": lambda s: Val(((s["v"] % 60_000_000).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(38,18)"), "decimal"), "timezone": _zone,
})


def _duration_parts(name, of_months, f, kind="integer"):
    @fn(f"{name}-from-duration", 1)
    def _(c, v):
        v = one(v)
        v = cast_to(v, "duration")
        x = v.col["months" if of_months else "secs"]
        toward_zero = lambda q: F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
        out = f(x, toward_zero)
        return Val(out.cast(SPARK[kind]), kind)


_duration_parts("years", True, lambda x, z: z(x / 12))
_duration_parts("months", True, lambda x, z: x % 12)
_duration_parts("days", False, lambda x, z: z(x / 86400))
_duration_parts("hours", False, lambda x, z: z((x % 86400) / 3600))
_duration_parts("minutes", False, lambda x, z: z((x % 3600) / 60))
_duration_parts("seconds", False, lambda x, z: x % 60, "decimal")


def _adjust(kind):
    @fn(f"adjust-{kind}-to-timezone", 1, 2)
    def _(c, v, tz=None):
        v = one(v)
        v = cast_to(v, kind) if v.type != kind else v
        new = F.lit(c.static.timezone) if tz is None else (F.lit(None).cast("int") if tz.type == "empty" else (one(tz).col / 60).cast("int"))

        def adjusted(col):
            have, shift = col["tz"], new - col["tz"]
            if kind == "dateTime":
                moved = col["v"] + F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))
            elif kind == "date":
                moved = (col["v"].cast("timestamp_ntz") + F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))).cast("date")
            else:
                moved = F.pmod(col["v"] + F.coalesce(shift, F.lit(0)).cast("bigint") * 60_000_000, F.lit(86_400_000_000))
            return F.when(col.isNotNull(), dated(F.when(have.isNull() | new.isNull(), col["v"]).otherwise(moved), new))

        return Val(once(v.col, adjusted), kind)


for _kind in ("dateTime", "date", "time"):
    _adjust(_kind)


@fn("dateTime", 2)
def _(c, d, t):
    d, t = cast_to(one(d), "date"), cast_to(one(t), "time")
    a, b = d.col["tz"], t.col["tz"]
    ts = d.col["v"].cast("timestamp_ntz") + F.make_dt_interval(secs=(t.col["v"].cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))
    clash = a.isNotNull() & b.isNotNull() & (a != b)
    return Val(F.when(d.col.isNull() | t.col.isNull(), None).when(clash, raise_("FORG0008", "timezones differ", SPARK["dateTime"])).otherwise(dated(ts, F.coalesce(a, b))), "dateTime")


def _now(c):
    return F.current_timestamp().cast("timestamp_ntz")


@fn("current-dateTime", 0)
def _(c):
    return Val(dated(_now(c), F.lit(c.static.timezone)), "dateTime")


@fn("current-date", 0)
def _(c):
    return Val(dated(_now(c).cast("date"), F.lit(c.static.timezone)), "date")


@fn("current-time", 0)
def _(c):
    from .values import micros_of_day

    return Val(dated(micros_of_day(_now(c)), F.lit(c.static.timezone)), "time")


@fn("implicit-timezone", 0)
def _(c):
    return Val(F.lit(c.static.timezone * 60).cast(SPARK["dayTimeDuration"]), "dayTimeDuration")


# Picture components that are plain digits, as Java patterns, by what they need.
PLAIN_PARTS = {"date": {"Y0001": "yyyy", "M01": "MM", "D01": "dd"}, "time": {"H01": "HH", "m01": "mm", "s01": "ss"}}


def plain_picture(kind: str, picture: str) -> str | None:
    """The Java pattern of a picture of digits and other text, or None for any other."""
    known = (PLAIN_PARTS["date"] if kind != "time" else {}) | (PLAIN_PARTS["time"] if kind != "date" else {})
    out = []
    for k, part in enumerate(re.split(r"\[([^\[\]]*)\]", picture)):
        if k % 2 and part not in known or not k % 2 and ("[" in part or "]" in part):
            return None
        out.append(known[part] if k % 2 else "'" + part.replace("'", "''") + "'" if part else "")
    return "".join(out)


def _format_moment(kind):
    @fn(f"format-{kind}", 2, 5, since=30)
    def _(c, v, picture, lang=None, calendar=None, place=None):
        v = cast_to(one(v), kind)
        plain = plain_picture(kind, picture.name[1:]) if picture.name and picture.name.startswith("=") and calendar is None else None
        if plain and kind != "time":
            return string(once(v.col, lambda x: F.date_format(x["v"], plain)))
        local = v.col["v"] if kind == "dateTime" else v.col["v"].cast("timestamp_ntz") if kind == "date" else F.timestamp_micros(v.col["v"] + F.lit(946_684_800_000_000)).cast("timestamp_ntz")
        return string(udfs.call(udfs.FORMAT[kind], "string", local, v.col["tz"].cast("double"), text(picture), to_string(one(lang)) if lang else F.lit(c.static.language)))


for _kind in ("dateTime", "date", "time"):
    _format_moment(_kind)


@fn("parse-ietf-date", 1, since=31)
def _(c, v):
    return Val(parse_string(udfs.call(pictures.parse_ietf_date, "string", to_string(one(v))), "dateTime"), "dateTime")


# higher-order functions


def _result(c, f: Val, *args: Val) -> Val:
    if f.type != "function":
        if f.type == "map":
            return map_get(f, args[0])
        if f.type == "array":
            return array_get(f, args[0])
        raise error("XPTY0004", f"{f.type} is no function")
    if f.arity != len(args):
        raise error("XPTY0004", f"a function of {f.arity} arguments got {len(args)}")
    return f.call(*args)


def over(c, v: Val, f: Callable[[Val], Val]) -> Val:
    """The concatenated results of a function on each item."""
    v = many(v)
    if v.type == "empty":
        return Val(v.col, "string", True)
    probe = f(v.with_col(F.lit(None).cast(spark_type(v)), False))
    if probe.type == "empty":
        return empty()
    mapped = F.transform(v.col, lambda x: items(f(v.with_col(x, False))))
    return replace(probe, col=F.flatten(mapped), many=True)


@fn("for-each", 2, since=30)
def _(c, v, f):
    return over(c, v, lambda x: _result(c, f, x))


@fn("filter", 2, since=30)
def _(c, v, f):
    v = many(v)
    return v.with_col(F.filter(v.col, lambda x: truth(_result(c, f, v.with_col(x, False)))))


def _fold(c, v: Val, zero: Val, f, right: bool) -> Val:
    v = many(v)
    step = (lambda a, x: _result(c, f, x, a)) if right else (lambda a, x: _result(c, f, a, x))
    state = zero
    for _ in range(3):  # widen the state until it holds its successor
        after = step(state, v.with_col(F.lit(None).cast(spark_type(v)), False))
        if after.type == state.type and after.many == state.many:
            break
        if after.type in NUMERIC and state.type in NUMERIC and not after.many:
            state = convert(state, max(after.type, state.type, key=NUMERIC.index))
        elif state.type == "empty" or after.many and not state.many:
            state = replace(after, col=items(convert(state, after.type)) if after.many else convert(state, after.type).col)
        else:
            break
    kind = full_type(state)
    shape = replace(state, col=None)

    def merge(a: Column, x: Column) -> Column:
        out = step(replace(shape, col=a), v.with_col(x, False))
        out = convert(out, state.type) if out.type != state.type else out
        return (items(out) if state.many else single(out).col).cast(kind)

    source = F.reverse(v.col) if right else v.col
    return replace(shape, col=F.aggregate(source, (state.col if not state.many else items(state)).cast(kind), merge))


@fn("fold-left", 3, since=30)
def _(c, v, zero, f):
    return _fold(c, v, zero, f, False)


@fn("fold-right", 3, since=30)
def _(c, v, zero, f):
    return _fold(c, v, zero, f, True)


def _pairs(c, a: Val, b: Val, f) -> tuple[Val, Column]:
    a, b = many(a), many(b)
    probe = _result(c, f, a.with_col(F.lit(None).cast(spark_type(a)), False), b.with_col(F.lit(None).cast(spark_type(b)), False))
    n = F.least(F.size(a.col), F.size(b.col))
    return probe, F.slice(F.zip_with(a.col, b.col, lambda x, y: items(_result(c, f, a.with_col(x, False), b.with_col(y, False)))), F.lit(1), n)


@fn("for-each-pair", 3, since=30)
def _(c, a, b, f):
    probe, col = _pairs(c, a, b, f)
    return replace(probe, col=F.flatten(col), many=True)


@fn("apply", 2, since=31)
def _(c, f, args):
    if args.name is None or not isinstance(args.call, tuple):
        raise UnsupportedError("FOAP0001", "apply needs an array constructor")
    return _result(c, f, *args.call)


@fn("function-name", 1, since=30)
def _(c, f):
    if f.name is None:
        return empty()
    return Val(F.struct(F.lit("").alias("ns"), F.lit("").alias("prefix"), F.lit(f.name).alias("local")), "QName")


@fn("function-arity", 1, since=30)
def _(c, f):
    return integer(F.lit(f.arity))


@fn("function-lookup", 2, since=30)
def _(c, name, arity):
    return c.function_item(literal(name, "a name"), int(literal(arity, "an arity")), missing=True)


@fn("load-xquery-module", 1, 2, since=31)
def _(c, *vs):
    raise error("FOQM0006", "no XQuery processor")


@fn("transform", 1, since=31)
def _(c, *vs):
    raise error("FOXT0004", "no XSLT processor")


# maps


def _key(m: Val, k: Val) -> Column:
    k = one(k)
    return k.col if k.type == m.key else cast_to(k, m.key).col


def member(v: Val, col: Column) -> Val:
    return replace(v.part, col=col)


def map_get(m: Val, k: Val) -> Val:
    if m.type == "json":
        return json_get(m, k)
    kk = one(k)
    comparable = kk.type == m.key or kk.type in NUMERIC and m.key in NUMERIC or kk.type in STRINGS and m.key in STRINGS
    if not comparable:
        return empty()
    return member(m, F.try_element_at(m.col, _key(m, k)))


def json_get(v: Val, k: Val) -> Val:
    if k.name is not None and k.name.startswith("="):
        name = k.name[1:]
        path = f"$[{int(name) - 1}]" if one(k).type == "integer" else "$." + name if name.isidentifier() else f"$['{name}']"
        got = F.try_variant_get(v.col, path, "variant")
        return Val(F.when(~F.is_variant_null(got), got), "json")
    raise UnsupportedError("XPST0017", "a key of a JSON value must be a literal")


@fn("map:size", 1, since=31)
def _(c, m):
    return integer(F.size(m.col))


@fn("map:keys", 1, since=31)
def _(c, m):
    return Val(F.map_keys(m.col), m.key, True)


@fn("map:contains", 2, since=31)
def _(c, m, k):
    kk = one(k)
    if not (kk.type == m.key or kk.type in NUMERIC and m.key in NUMERIC or kk.type in STRINGS and m.key in STRINGS):
        return boolean(F.lit(False))
    return boolean(F.map_contains_key(m.col, _key(m, k)))


@fn("map:get", 2, since=31)
def _(c, m, k):
    return map_get(m, k)


def _fit(v: Val, part: Val) -> Column:
    """A value as a member of a map or array."""
    v = convert(v, part.type) if v.type != part.type else v
    return items(v) if part.many else single(v).col


@fn("map:put", 3, since=31)
def _(c, m, k, v):
    key = _key(m, k)
    return m.with_col(F.map_concat(F.map_filter(m.col, lambda a, b: a != key), F.create_map(key, _fit(v, m.part))))


@fn("map:remove", 2, since=31)
def _(c, m, ks):
    gone = convert(many(atom(ks)), m.key).col
    return m.with_col(F.map_filter(m.col, lambda a, b: ~F.array_contains(gone, a)))


@fn("map:entry", 2, since=31)
def _(c, k, v):
    k = one(k)
    return Val(F.create_map(k.col, v.col), "map", part=replace(v, col=None, name=None), key=k.type)


@fn("map:merge", 1, 2, since=31)
def _(c, ms, options=None):
    how = "use-first"
    if options is not None and isinstance(options.call, dict) and "duplicates" in options.call:
        how = literal(options.call["duplicates"], "duplicates")
    ms = many(ms)
    entries = F.flatten(F.transform(ms.col, F.map_entries))
    keys = F.transform(entries, lambda e: e["key"])
    distinct = F.array_distinct(keys)
    values = lambda k: F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"])
    if how == "reject":
        col = F.when(F.size(distinct) == F.size(keys), F.map_from_entries(entries)).otherwise(raise_("FOJS0003", "duplicate key", spark_type(ms)))
        return replace(ms, col=col, many=False)
    if how == "combine":
        merge = (lambda k: F.flatten(values(k))) if ms.part.many else values
        return replace(ms, col=F.map_from_arrays(distinct, F.transform(distinct, merge)), many=False, part=replace(ms.part, many=True))
    if how not in ("use-first", "use-last", "use-any"):
        raise error("FOJS0005", f"unknown option {how}")
    at = -1 if how == "use-last" else 1
    return replace(ms, col=F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(values(k), at))), many=False)


@fn("map:find", 2, since=31)
def _(c, v, k):
    """The values of a key in maps and arrays of them, at any static depth."""

    def search(v: Val) -> list[Val]:
        if v.many:
            shape = v.with_col(F.lit(None).cast(spark_type(v)), False)
            found = search(shape)
            nth = lambda i: lambda x: items(search(v.with_col(x, False))[i])
            return [replace(s, col=F.flatten(F.transform(v.col, nth(i))), many=True) for i, s in enumerate(found)]
        if v.type == "map":
            return [map_get(v, k), *search(replace(v.part, col=F.map_values(v.col) if not v.part.many else F.flatten(F.map_values(v.col)), many=True))]
        if v.type == "array":
            return search(replace(v.part, col=F.flatten(v.col) if v.part.many else v.col, many=True))
        return []

    found = [x for x in search(v) if x.type != "empty"]
    if not found:
        return Val(F.array().cast("array<string>"), "array", part=string(None))
    kind = common(found)
    return Val(F.concat(*(items(convert(x, kind)) for x in found)), "array", part=Val(None, kind))


@fn("map:for-each", 2, since=31)
def _(c, m, f):
    probe = _result(c, f, Val(F.lit(None).cast(SPARK[m.key]), m.key), member(m, F.lit(None).cast(full_type(m.part))))
    col = F.flatten(F.transform(F.map_entries(m.col), lambda e: items(_result(c, f, Val(e["key"], m.key), member(m, e["value"])))))
    return replace(probe, col=col, many=True)


# arrays


def _index(a: Val, p: Column, most: Column) -> Column:
    return F.when((p >= 1) & (p <= most), p.cast("int")).otherwise(raise_("FOAY0001", "array index out of bounds", "int"))


def array_get(a: Val, p: Val) -> Val:
    return member(a, F.element_at(a.col, _index(a, one(p).col, F.size(a.col))))


@fn("array:size", 1, since=31)
def _(c, a):
    return integer(F.size(a.col))


@fn("array:get", 2, since=31)
def _(c, a, p):
    return array_get(a, p)


@fn("array:put", 3, since=31)
def _(c, a, p, v):
    at, new = _index(a, one(p).col, F.size(a.col)), _fit(v, a.part)
    return a.with_col(F.transform(a.col, lambda x, i: F.when(i + 1 == at, new).otherwise(x)))


@fn("array:insert-before", 3, since=31)
def _(c, a, p, v):
    return a.with_col(F.array_insert(a.col, _index(a, one(p).col, F.size(a.col) + 1), _fit(v, a.part)))


@fn("array:append", 2, since=31)
def _(c, a, v):
    return a.with_col(F.concat(a.col, F.array(_fit(v, a.part))))


@fn("array:remove", 2, since=31)
def _(c, a, ps):
    gone = F.transform(items(atom(ps)), lambda p: _index(a, p, F.size(a.col)))
    return a.with_col(F.filter(a.col, lambda x, i: ~F.array_contains(gone, i + 1)))


@fn("array:subarray", 2, 3, since=31)
def _(c, a, start, length=None):
    size = F.size(a.col)
    first = _index(a, one(start).col, size + 1)
    n = one(length).col if length else size - first + 1
    n = F.when((n >= 0) & (first + n <= size + 1), n.cast("int")).otherwise(raise_("FOAY0001", "subarray out of bounds", "int"))
    return a.with_col(F.when(n == 0, F.array().cast(spark_type(a))).otherwise(F.slice(a.col, first, F.greatest(n, F.lit(1)))))


@fn("array:head", 1, since=31)
def _(c, a):
    return array_get(a, integer(F.lit(1)))


@fn("array:tail", 1, since=31)
def _(c, a):
    checked = F.when(F.size(a.col) > 0, a.col).otherwise(raise_("FOAY0001", "empty array", spark_type(a)))
    return a.with_col(F.filter(checked, lambda x, i: i > 0))


@fn("array:reverse", 1, since=31)
def _(c, a):
    return a.with_col(F.reverse(a.col))


@fn("array:join", 1, since=31)
def _(c, arrays):
    return replace(arrays, col=F.flatten(items(arrays)), many=False)


@fn("array:flatten", 1, since=31)
def _(c, v):
    return many(atom(v)) if v.type == "array" else many(v)


def _members(a: Val) -> Val:
    return a.part


@fn("array:for-each", 2, since=31)
def _(c, a, f):
    probe = _result(c, f, member(a, F.lit(None).cast(full_type(a.part))))
    return Val(F.transform(a.col, lambda x: _result(c, f, member(a, x)).col), "array", part=replace(probe, col=None))


@fn("array:for-each-pair", 3, since=31)
def _(c, a, b, f):
    null = lambda v: member(v, F.lit(None).cast(full_type(v.part)))
    probe = _result(c, f, null(a), null(b))
    col = F.slice(F.zip_with(a.col, b.col, lambda x, y: _result(c, f, member(a, x), member(b, y)).col), F.lit(1), F.least(F.size(a.col), F.size(b.col)))
    return Val(col, "array", part=replace(probe, col=None))


@fn("array:filter", 2, since=31)
def _(c, a, f):
    return a.with_col(F.filter(a.col, lambda x: truth(_result(c, f, member(a, x)))))


def _array_fold(c, a, zero, f, right):
    if a.part.many:
        raise UnsupportedError("XPTY0004", "a fold over members that are sequences")
    return _fold(c, replace(a.part, col=a.col, many=True), zero, f, right)


@fn("array:fold-left", 3, since=31)
def _(c, a, zero, f):
    return _array_fold(c, a, zero, f, False)


@fn("array:fold-right", 3, since=31)
def _(c, a, zero, f):
    return _array_fold(c, a, zero, f, True)


@fn("array:sort", 1, 3, since=31)
def _(c, a, collation=None, key=None):
    inner = _sorted(c, replace(a.part, col=a.col, many=True), key)
    return a.with_col(inner.col)


# JSON


@fn("parse-json", 1, 2, since=31)
def _(c, v, options=None):
    s = to_string(one(v))
    parsed = F.try_parse_json(s)
    bad = s.isNotNull() & parsed.isNull()
    out = F.when(bad, raise_("FOJS0001", "invalid JSON", "variant")).otherwise(parsed)
    return Val(F.when(~F.is_variant_null(out), out), "json")


# resources

#: Bytes of a file that an expression can hold, and files of a folder; larger ones are relations of sources/files.py.
RESOURCE_BYTES, RESOURCE_FILES = 16 << 20, 100_000


def _resource(c, uri: Val) -> Column:
    """The text of the file at a literal URI, as a constant of the plan."""
    place, spark = _place(c, uri), SparkSession.getActiveSession()
    if not _there(spark, place):
        raise error("FOUT1170", f"no resource {place}")
    found = spark.read.format("binaryFile").load(place).select("length").first()
    if found is None or found[0] > RESOURCE_BYTES:
        raise UnsupportedError("FOUT1170", f"{place} is no file of at most {RESOURCE_BYTES} bytes")
    return F.lit(spark.read.text(place, wholetext=True).first()[0])


def _place(c, uri: Val) -> str:
    name = literal(uri, "a URI")
    return urljoin(c.static.base_uri, name) if c.static.base_uri else name


def _there(spark: SparkSession, place: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(place)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


@fn("unparsed-text", 1, 2, since=30)
def _(c, uri, encoding=None):
    return string(_resource(c, uri))


@fn("unparsed-text-lines", 1, 2, since=30)
def _(c, uri, encoding=None):
    found = F.split(_resource(c, uri), r"\r\n|\r|\n", -1)
    whole = F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
    return Val(whole, "string", True)


@fn("unparsed-text-available", 1, 2, since=30)
def _(c, uri, encoding=None):
    return boolean(F.lit(_there(SparkSession.getActiveSession(), _place(c, uri))))


@fn("json-doc", 1, 2, since=31)
def _(c, uri, options=None):
    parsed = F.try_parse_json(_resource(c, uri))
    return Val(F.coalesce(parsed, raise_("FOJS0001", "invalid JSON", "variant")), "json")


@fn("uri-collection", 1, since=30)
def _(c, uri):
    spark, place = SparkSession.getActiveSession(), _place(c, uri)
    if not _there(spark, place):
        raise error("FODC0002", f"no collection {place}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(place).select("path")
    names = sorted(r["path"] for r in files.limit(RESOURCE_FILES + 1).collect())
    if len(names) > RESOURCE_FILES:
        raise UnsupportedError("FODC0002", f"{place} has over {RESOURCE_FILES} files")
    return Val(F.array(*map(F.lit, names)).cast("array<string>"), "anyURI", True)


@fn("serialize", 1, 2, since=30)
def _(c, v, options=None):
    if v.type in ("map", "array", "json"):
        return string(F.to_json(v.col))
    v = many(atom(v))
    return string(F.array_join(F.transform(v.col, lambda x: to_string(Val(x, v.type))), " "))


@fn("json-to-xml", 1, since=31)
def _(c, v):
    """The document as its text, to be shredded."""
    from ..sources.shred import json_to_xml

    return string(udfs.call(json_to_xml, "string", to_string(one(v))))


@fn("xml-to-json", 1, since=31)
def _(c, v):
    from ..sources.shred import xml_to_json

    return string(udfs.call(xml_to_json, "string", to_string(one(v))))


@fn("data", 1)
def _(c, v):
    return atom(v)


def environment() -> tuple[tuple[str, str], ...]:
    """The process environment, for static contexts that allow it."""
    return tuple(sorted(os.environ.items()))
