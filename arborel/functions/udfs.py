"""Arrow UDFs for the functions that have no native expression."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import pictures


@cache
def _batched(f: Callable, kind: str, n: int):
    """A vectorised UDF of so many arguments; nulls come in as None."""

    def clean(x):
        return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x and kind != "number") else x

    if n == 1:

        def run1(a: pd.Series) -> pd.Series:
            return pd.Series([f(clean(x)) for x in a], dtype=object)

        return F.pandas_udf(run1, kind)
    if n == 2:

        def run2(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(clean(x), clean(y)) for x, y in zip(a, b)], dtype=object)

        return F.pandas_udf(run2, kind)
    if n == 3:

        def run3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series([f(clean(x), clean(y), clean(z)) for x, y, z in zip(a, b, c)], dtype=object)

        return F.pandas_udf(run3, kind)

    def run4(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([f(clean(w), clean(x), clean(y), clean(z)) for w, x, y, z in zip(a, b, c, d)], dtype=object)

    return F.pandas_udf(run4, kind)


def call(f: Callable, kind: str, *columns: Column) -> Column:
    """The UDF of a function on columns."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return _batched(f, kind, len(columns))(*columns)


def format_integer(n, picture, lang):
    return pictures.format_integer(None if n is None else int(n), picture, lang)


def format_double(n, picture):
    return pictures.format_number(None if n is None else float(n), picture)


def format_text_number(n, picture):
    """A decimal or integer comes as text, so that no digit is lost."""
    from decimal import Decimal

    return pictures.format_number(None if n is None else Decimal(n), picture)


def _format(kind):
    def run(value, tz, picture, lang):
        if value is None:
            return None
        value = value.to_pydatetime() if hasattr(value, "to_pydatetime") else value
        return pictures.format_moment(value, None if tz is None else int(tz), picture, lang, kind)

    run.__name__ = f"format_{kind}"
    return run


FORMAT = {kind: _format(kind) for kind in ("dateTime", "date", "time")}
EPOCH = dt.datetime(2000, 1, 1)
