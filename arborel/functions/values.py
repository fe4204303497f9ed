"""Typed columns: an XDM value of one row as a Spark column with its static type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedError, error

#: Spark types of the atomic types. Date and time types are structs of a local value and an optional offset in minutes.
SPARK = {
    "string": "string", "untypedAtomic": "string", "anyURI": "string", "boolean": "boolean", "integer": "bigint",
    "decimal": "decimal(38,18)", "float": "float", "double": "double", "dateTime": "struct<v:timestamp_ntz,tz:int>",
    "date": "struct<v:date,tz:int>", "time": "struct<v:bigint,tz:int>", "yearMonthDuration": "int",
    "dayTimeDuration": "decimal(20,6)", "duration": "struct<months:int,secs:decimal(20,6)>", "hexBinary": "binary",
    "base64Binary": "binary", "QName": "struct<ns:string,prefix:string,local:string>", "json": "variant",
}
NUMERIC = ("integer", "decimal", "float", "double")
STRINGS = ("string", "untypedAtomic", "anyURI")


@dataclass(frozen=True)
class Val:
    """A column and its type. many: an array with the items of a sequence; else null stands for ().

    type is an atomic type, 'map', 'array' or 'function'. part: member type of an array or value
    type of a map, as a Val without column; key: key type of a map; call: what a function item does.
    """

    col: Column | None
    type: str
    many: bool = False
    part: Val | None = None
    key: str | None = None
    call: Callable[..., Val] | None = None
    arity: int = 0
    name: str | None = None

    def with_col(self, col: Column, many: bool | None = None) -> Val:
        return replace(self, col=col, many=self.many if many is None else many)


def spark_type(v: Val) -> str:
    """The Spark type of one item of the value."""
    if v.type == "array":
        return f"array<{full_type(v.part)}>"
    if v.type == "map":
        return f"map<{SPARK[v.key]},{full_type(v.part)}>"
    return SPARK[v.type]


def full_type(v: Val) -> str:
    return f"array<{spark_type(v)}>" if v.many else spark_type(v)


def empty() -> Val:
    return Val(F.lit(None).cast("string"), "empty")


def raise_(code: str, message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(f"[err:{code}] {message}")).cast(kind)


def items(v: Val) -> Column:
    """The value as an array of its items."""
    if v.many:
        return F.coalesce(v.col, F.array().cast(full_type(v)))
    if v.type == "empty":
        return F.array().cast("array<string>")
    kind = f"array<{spark_type(v)}>"
    return F.when(v.col.isNull(), F.array().cast(kind)).otherwise(F.array(v.col).cast(kind))


def many(v: Val) -> Val:
    return v if v.many else v.with_col(items(v), True)


def single(v: Val, code: str = "XPTY0004") -> Val:
    """The only item, or null where there is none; more raise an error."""
    if not v.many:
        return v
    a = v.col
    return v.with_col(F.when(F.size(a) <= 1, F.try_element_at(a, F.lit(1))).otherwise(raise_(code, "more than one item", spark_type(v))), False)


def of_type(spark: T.DataType, col: Column) -> Val:
    """A column of a table as a value."""
    if isinstance(spark, (T.StringType, T.CharType, T.VarcharType)):
        return Val(col, "string")
    if isinstance(spark, T.BooleanType):
        return Val(col, "boolean")
    if isinstance(spark, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Val(col.cast("bigint") if not isinstance(spark, T.LongType) else col, "integer")
    if isinstance(spark, T.DecimalType):
        return Val(col, "decimal")
    if isinstance(spark, T.FloatType):
        return Val(col, "float")
    if isinstance(spark, T.DoubleType):
        return Val(col, "double")
    if isinstance(spark, (T.TimestampType, T.TimestampNTZType)):
        return Val(dated(col.cast("timestamp_ntz")), "dateTime")
    if isinstance(spark, T.DateType):
        return Val(dated(col), "date")
    if isinstance(spark, T.BinaryType):
        return Val(col, "base64Binary")
    if isinstance(spark, T.ArrayType):
        return Val(col, "array", part=of_type(spark.elementType, col))
    if isinstance(spark, T.MapType):
        return Val(col, "map", part=of_type(spark.valueType, col), key=of_type(spark.keyType, col).type)
    if isinstance(spark, T.VariantType):
        return Val(col, "json")
    raise UnsupportedError("XPTY0004", f"no item type for {spark.simpleString()}")


def dated(v: Column, tz: Column | None = None) -> Column:
    s = F.struct(v.alias("v"), (F.lit(None) if tz is None else tz).cast("int").alias("tz"))
    return F.when(v.isNotNull(), s)


def moment(v: Val, implicit: int = 0) -> Column:
    """A date or time value as one that orders by time: shifted to UTC."""
    shift = F.coalesce(v.col["tz"], F.lit(implicit))
    if v.type == "dateTime":
        return v.col["v"] - F.make_dt_interval(mins=shift)
    if v.type == "date":
        return v.col["v"].cast("timestamp_ntz") - F.make_dt_interval(mins=shift)
    return v.col["v"] - shift.cast("bigint") * 60_000_000


# formatting and casts

#: Characters of an expression from which a function that uses it many times gets it computed once.
LARGE = 160


def once(col: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that it names many times: nested, such functions would make expressions of exponential size."""
    if len(str(col)) < LARGE:
        return f(col)
    return F.get(F.transform(F.array(col), f), F.lit(0))


def double_string(d: Column, single_precision: bool = False) -> Column:
    """A double as XPath writes it: plain from 1e-6 up to 1e6, else with an exponent."""
    raw = d.cast("string")
    plain = F.regexp_replace(raw, r"\.0$", "")
    size = F.abs(d)
    mantissa = F.regexp_extract(raw, r"^-?([\d.]+)", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"0+$", "")
    sign = F.when(d < 0, "-").otherwise("")
    long = F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.when(F.length(digits) > 1, F.substr(digits, F.lit(2))).otherwise("0"), F.lit("E6"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -F.regexp_extract(raw, r"E(-?\d+)", 1).cast("int") - 1), digits)
    return (
        F.when(d.isNull(), None).when(F.isnan(d), "NaN").when(d == float("inf"), "INF").when(d == float("-inf"), "-INF")
        .when(d == 0, F.when(raw.startswith("-"), "-0").otherwise("0"))
        .when((size >= 1e6) & (size < 1e7), long).when((size < 1e-3) & (size >= 1e-6), small).otherwise(F.when(raw.contains("E"), raw).otherwise(plain))
    )


def decimal_string(d: Column) -> Column:
    raw = d.cast("decimal(38,18)").cast("string")
    raw = F.when(raw.contains("E"), F.format_string("%.18f", d)).otherwise(raw)
    return F.when(raw.contains("."), F.regexp_replace(F.regexp_replace(raw, "0+$", ""), r"\.$", "")).otherwise(raw)


def zone(tz: Column) -> Column:
    size = F.abs(tz)
    text = F.concat(F.when(tz < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.when(tz.isNull(), "").when(tz == 0, "Z").otherwise(text)


def seconds_string(micros: Column) -> Column:
    """hh:mm:ss with a fraction where there is one, from microseconds of the day."""
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    rest = F.regexp_replace(F.concat(F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0")), r"\.?0+$", "")
    return F.concat(two(F.floor(micros / 3_600_000_000)), F.lit(":"), two(F.floor(micros / 60_000_000) % 60), F.lit(":"), two(F.floor(micros / 1_000_000) % 60), rest)


def duration_string(months: Column, secs: Column) -> Column:
    down = (months < 0) | (secs < 0)
    m, s = F.abs(months).cast("bigint"), F.abs(secs)
    piece = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    whole = F.floor(s)
    date = F.concat(piece(F.floor(m / 12), "Y"), piece(m % 12, "M"), piece(F.floor(whole / 86400), "D"))
    left = s % 60
    clock = F.concat(piece(F.floor(whole / 3600) % 24, "H"), piece(F.floor(whole / 60) % 60, "M"), F.when(left != 0, F.concat(decimal_string(left), F.lit("S"))).otherwise(""))
    body = F.concat(date, F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.concat(F.when(down, "-").otherwise(""), F.lit("P"), body)


def to_string(v: Val) -> Column:
    """The string value of one item; null for ()."""
    if v.type in ("string", "untypedAtomic", "anyURI", "empty"):
        return v.col
    if v.type in ("map", "array", "function"):
        raise error("FOTY0014", f"{v.type} has no string value")
    return once(v.col, lambda c: _to_string(c, v.type))


def _to_string(c: Column, kind: str) -> Column:
    match kind:
        case "boolean" | "integer":
            return c.cast("string")
        case "decimal":
            return decimal_string(c)
        case "double" | "float":
            return double_string(c)
        case "dateTime":
            text = F.concat(F.date_format(c["v"], "yyyy-MM-dd"), F.lit("T"), seconds_string(micros_of_day(c["v"])), zone(c["tz"]))
            return F.when(c.isNotNull(), text)
        case "date":
            return F.when(c.isNotNull(), F.concat(F.date_format(c["v"], "yyyy-MM-dd"), zone(c["tz"])))
        case "time":
            return F.when(c.isNotNull(), F.concat(seconds_string(c["v"]), zone(c["tz"])))
        case "yearMonthDuration":
            return F.when(c == 0, "P0M").otherwise(duration_string(c, F.lit(0)))
        case "dayTimeDuration":
            return F.when(c == 0, "PT0S").otherwise(duration_string(F.lit(0), c))
        case "duration":
            return F.when((c["months"] == 0) & (c["secs"] == 0), "PT0S").otherwise(duration_string(c["months"], c["secs"]))
        case "hexBinary":
            return F.hex(c)
        case "base64Binary":
            return F.regexp_replace(F.base64(c), r"\s", "")
        case "QName":
            return F.when(c.isNotNull(), F.when(c["prefix"] != "", F.concat(c["prefix"], F.lit(":"), c["local"])).otherwise(c["local"]))
        case "json":
            return c.cast("string")
    raise error("FORG0006", f"{kind} has no string value")


def micros_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("bigint") * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


# Lexical forms of the XSD types.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)$",
    "boolean": r"^(true|false|1|0)$",
    "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "time": r"^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "duration": r"^-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?$",
    "yearMonthDuration": r"^-?P(?=[0-9])([0-9]+Y)?([0-9]+M)?$",
    "dayTimeDuration": r"^-?P(?=[0-9T])([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?$",
    "hexBinary": r"^([0-9a-fA-F]{2})*$",
    "base64Binary": r"^[A-Za-z0-9+/]*={0,2}$",
    "gYear": r"^-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "gYearMonth": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "gMonth": r"^--(0[1-9]|1[0-2])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "gMonthDay": r"^--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "gDay": r"^---(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "language": r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$",
    "NMTOKEN": r"^[\w.\-:]+$",
    "Name": r"^[^\W\d][\w.\-:]*$|^:[\w.\-:]*$",
    "NCName": r"^[^\W\d][\w.\-]*$",
    "QName": r"^([^\W\d][\w.\-]*:)?[^\W\d][\w.\-]*$",
}
LEXICAL |= {"ID": LEXICAL["NCName"], "IDREF": LEXICAL["NCName"], "ENTITY": LEXICAL["NCName"], "dateTimeStamp": LEXICAL["dateTime"].replace(")?$", ")$"), "float": LEXICAL["double"], "NOTATION": LEXICAL["QName"]}
# Bounds of the types derived from xs:integer.
BOUNDS = {
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "long": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "short": (-32768, 32767), "byte": (-128, 127),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
STRING_KINDS = ("normalizedString", "token", "language", "NMTOKEN", "Name", "NCName", "ID", "IDREF", "ENTITY")
PARTIAL_DATES = ("gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay")
LISTS = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}
ATOMIC = (*SPARK, *BOUNDS, *STRING_KINDS, *PARTIAL_DATES, "dateTimeStamp", "NOTATION", "numeric", "anyAtomicType", "error")


def base_of(kind: str) -> str:
    """The type that holds the values of a derived type."""
    if kind in BOUNDS:
        return "integer"
    if kind in STRING_KINDS or kind in PARTIAL_DATES:
        return "string"
    return {"dateTimeStamp": "dateTime", "NOTATION": "QName", "numeric": "double", "anyAtomicType": "string"}.get(kind, kind)


def _zone_minutes(s: Column) -> Column:
    sign = F.when(F.regexp_extract(s, r"([+-])[0-9]{2}:[0-9]{2}$", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(s, r"[+-]([0-9]{2}):[0-9]{2}$", 1)
    minutes = F.regexp_extract(s, r"[+-][0-9]{2}:([0-9]{2})$", 1)
    return F.when(s.endswith("Z"), F.lit(0)).when(hours != "", sign * (hours.cast("int") * 60 + minutes.cast("int")))


def parse_string(s: Column, kind: str, strict: bool = True) -> Column:
    """The value of a string in a type; where it is none an error, or null if not strict."""
    if kind in ("string", "untypedAtomic", "anyAtomicType"):
        return s
    return once(s, lambda x: _parse(x, kind, strict))


def _parse(s: Column, kind: str, strict: bool) -> Column:
    trimmed = F.trim(F.regexp_replace(s, r"[\t\r\n ]+", " "))
    base = base_of(kind)
    if kind == "anyURI":
        return trimmed
    if kind == "normalizedString":
        return F.regexp_replace(s, r"[\t\r\n]", " ")
    if kind == "token":
        return trimmed
    good = trimmed.rlike(LEXICAL.get(kind, LEXICAL.get(base)))
    zoneless = F.regexp_replace(trimmed, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    if base == "string":
        out = trimmed
    elif kind == "boolean":
        out = trimmed.isin("true", "1")
    elif base == "integer":
        out = trimmed.try_cast("bigint")
        low, high = BOUNDS.get(kind, (None, None))
        if low is not None and low >= -(1 << 63):
            good = good & (out >= low)
        if high is not None and high < 1 << 63:
            good = good & (out <= high)
    elif base == "decimal":
        out = trimmed.try_cast("decimal(38,18)")
    elif base in ("double", "float"):
        out = F.regexp_replace(trimmed, "INF", "Infinity").try_cast(base)
    elif base == "dateTime":
        late = zoneless.contains("T24:00:00")
        value = F.regexp_replace(zoneless, "T24:00:00", "T00:00:00").try_cast("timestamp_ntz")
        out = dated(F.when(late, value + F.make_dt_interval(days=F.lit(1))).otherwise(value), _zone_minutes(trimmed))
    elif base == "date":
        out = dated(zoneless.try_cast("date"), _zone_minutes(F.regexp_replace(trimmed, r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}", "")))
    elif base == "time":
        value = F.concat(F.lit("2000-01-01T"), F.regexp_replace(zoneless, "^24:00:00", "00:00:00")).try_cast("timestamp_ntz")
        out = dated(micros_of_day(value), _zone_minutes(trimmed))
    elif base in ("yearMonthDuration", "dayTimeDuration", "duration"):
        sign = F.when(trimmed.startswith("-"), -1).otherwise(1)
        day, clock = F.split(trimmed, "T")[0], F.coalesce(F.get(F.split(trimmed, "T"), F.lit(1)), F.lit(""))
        n = lambda part, unit: F.coalesce(F.regexp_extract(part, rf"([0-9.]+){unit}", 1).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
        months = ((n(day, "Y") * 12 + n(day, "M")) * sign).cast("int")
        secs = ((n(day, "D") * 86400 + n(clock, "H") * 3600 + n(clock, "M") * 60 + n(clock, "S")) * sign).cast("decimal(20,6)")
        out = {"yearMonthDuration": months, "dayTimeDuration": secs}.get(base, F.struct(months.alias("months"), secs.alias("secs")))
    elif base == "hexBinary":
        out = F.unhex(F.when(good, trimmed))
    elif base == "base64Binary":
        out = F.unbase64(F.when(good & (F.length(trimmed) % 4 == 0), trimmed))
    elif base == "QName":
        prefix = F.regexp_extract(trimmed, "^(.*):", 1)
        out = F.struct(F.lit("").alias("ns"), prefix.alias("prefix"), F.regexp_replace(trimmed, "^.*:", "").alias("local"))
    else:
        raise error("XPST0051", f"unknown type xs:{kind}")
    spark = SPARK[base]
    fine = F.when(s.isNotNull() & good & out.isNotNull(), out.cast(spark))
    if not strict:
        return fine
    bad = raise_("FORG0001", f"not a value of xs:{kind}", spark)
    return F.when(s.isNull(), F.lit(None).cast(spark)).when(good & out.isNotNull(), out.cast(spark)).otherwise(bad)


def cast_to(v: Val, kind: str, strict: bool = True) -> Val:
    """Casts one item to an atomic type, with the XPath rules for values."""
    base, t = base_of(kind), v.type
    if t == "empty":
        return Val(F.lit(None).cast(SPARK[base]), base)
    if t == "json":
        v, t = Val(v.col.cast("string"), "untypedAtomic"), "untypedAtomic"
    if kind == t or kind == base == t:
        return v
    if kind == "json" and t in (*NUMERIC, *STRINGS, "boolean"):
        return Val(v.col.cast("variant"), "json")
    if kind in PARTIAL_DATES and t in ("date", "dateTime"):
        form = {"gYear": "yyyy", "gYearMonth": "yyyy-MM", "gMonth": "'--'MM", "gMonthDay": "'--'MM-dd", "gDay": "'---'dd"}[kind]
        return Val(once(v.col, lambda c: F.concat(F.date_format(c["v"], form), zone(c["tz"]))), "string")
    if base in ("string", "untypedAtomic", "anyURI"):
        text = to_string(v)
        return Val(parse_string(text, kind, strict) if kind not in ("string", "untypedAtomic") else text, base)
    if t in STRINGS:
        return Val(parse_string(v.col, kind, strict), base)
    return Val(once(v.col, lambda c: _cast(c, t, kind, strict)), base)


def _cast(c: Column, t: str, kind: str, strict: bool) -> Column:
    base = base_of(kind)
    if base in NUMERIC and t in (*NUMERIC, "boolean"):
        spark = SPARK[base]
        number = c.cast("int") if t == "boolean" else c
        if base in ("integer", "decimal") and t in ("double", "float"):
            odd = F.isnan(c) | (F.abs(c) == float("inf"))
            whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)) if base == "integer" else c
            out = F.when(odd, raise_("FOCA0002", f"no xs:{kind}", spark) if strict else F.lit(None).cast(spark)).otherwise(whole.cast(spark))
        elif base == "integer" and t == "decimal":
            out = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast(spark)
        else:
            out = number.cast(spark)
        low, high = BOUNDS.get(kind, (None, None))
        if low is not None or high is not None:
            inside = F.lit(True)
            if low is not None:
                inside = inside & (out >= low if low >= -(1 << 63) else F.lit(True))
            if high is not None and high < 1 << 63:
                inside = inside & (out <= high)
            out = F.when(out.isNull() | inside, out).otherwise(raise_("FORG0001", f"out of xs:{kind}", spark) if strict else F.lit(None).cast(spark))
        return out
    if base == "boolean" and t in NUMERIC:
        zero = (c == 0) | (F.isnan(c) if t in ("double", "float") else F.lit(False))
        return F.when(c.isNotNull(), ~zero)
    if t == "dateTime" and base == "date":
        return F.when(c.isNotNull(), dated(c["v"].cast("date"), c["tz"]))
    if t == "date" and base == "dateTime":
        return F.when(c.isNotNull(), dated(c["v"].cast("timestamp_ntz"), c["tz"]))
    if t == "dateTime" and base == "time":
        return F.when(c.isNotNull(), dated(micros_of_day(c["v"]), c["tz"]))
    if base == "duration" and t in ("yearMonthDuration", "dayTimeDuration"):
        months, secs = (c, F.lit(0)) if t == "yearMonthDuration" else (F.lit(0), c)
        return F.when(c.isNotNull(), F.struct(months.cast("int").alias("months"), secs.cast("decimal(20,6)").alias("secs")))
    if t == "duration" and base in ("yearMonthDuration", "dayTimeDuration"):
        return c["months" if base == "yearMonthDuration" else "secs"]
    if {t, base} == {"yearMonthDuration", "dayTimeDuration"}:
        return F.when(c.isNotNull(), F.lit(0)).cast(SPARK[base])
    if {t, base} == {"hexBinary", "base64Binary"}:
        return c
    raise error("XPTY0004", f"xs:{t} cannot be cast to xs:{kind}")


def common(vals: list[Val]) -> str:
    """The type that holds the items of all these values."""
    kinds = [v.type for v in vals if v.type != "empty"]
    if not kinds:
        return "string"
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(k in NUMERIC for k in kinds):
        return max(kinds, key=NUMERIC.index)
    if all(k in STRINGS for k in kinds):
        return "string"
    raise UnsupportedError("XPTY0004", f"a sequence of {' and '.join(sorted(set(kinds)))} has no native column")


def convert(v: Val, kind: str) -> Val:
    """Each item in another type."""
    if v.type == kind:
        return v
    if v.type == "empty":
        return Val(F.array().cast(f"array<{SPARK[kind]}>"), kind, True) if v.many else Val(F.lit(None).cast(SPARK[kind]), kind)
    if v.many:
        return Val(F.transform(v.col, lambda x: cast_to(Val(x, v.type), kind).col), base_of(kind), True)
    return cast_to(v, kind)


def number(v: Val) -> Val:
    """fn:number of one item: NaN where there is none."""
    nan = F.lit(float("nan"))
    if v.type in NUMERIC or v.type == "boolean":
        return Val(F.coalesce(v.col.cast("double"), nan), "double")
    if v.type in (*STRINGS, "json"):
        return Val(F.coalesce(parse_string(v.col.cast("string"), "double", False), nan), "double")
    return Val(nan, "double")


def truth(v: Val) -> Column:
    """The effective boolean value."""
    if v.type == "empty":
        return F.lit(False)
    if v.many:
        first = truth(v.with_col(F.try_element_at(v.col, F.lit(1)), False))
        if v.type in ("map", "array"):
            return first
        return F.when(F.size(v.col) > 1, raise_("FORG0006", "no boolean value of more than one item", "boolean")).otherwise(F.coalesce((F.size(v.col) > 0) & first, F.lit(False)))
    c = v.col
    if v.type == "boolean":
        return F.coalesce(c, F.lit(False))
    if v.type in STRINGS:
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if v.type in ("double", "float"):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if v.type in NUMERIC:
        return F.coalesce(c != 0, F.lit(False))
    if v.type == "json":
        return F.coalesce(~F.is_variant_null(c) & (c.cast("string") != "false"), F.lit(False))
    raise error("FORG0006", f"{v.type} has no boolean value")
