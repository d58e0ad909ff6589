"""Exact decimals: 28 significant digits, half-even, whatever the ambient context.

Spark's own decimal division keeps far fewer digits, so divisions and roots of
this tier run in Arrow UDFs.  Results are DECIMAL(38,30), which holds 28
digits of magnitudes from about 0.001 to 10^8; :func:`text` keeps any magnitude.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS, RESULT = 28, T.DecimalType(38, 30)
CONTEXT = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN)


def change(now: Decimal | None, before: Decimal | None) -> Decimal | None:
    """(now - before) / before; None where undefined."""
    if now is None or not before:
        return None
    with localcontext(CONTEXT):
        return (now - before) / before


def deviation(closes: list[Decimal]) -> Decimal | None:
    """Population deviation of the returns between neighbours."""
    changes = [change(b, a) for a, b in zip(closes, closes[1:])]
    if not changes or None in changes:
        return None
    with localcontext(CONTEXT):
        mean = sum(changes, Decimal(0)) / len(changes)
        return (sum(((c - mean) ** 2 for c in changes), Decimal(0)) / len(changes)).sqrt()


def _udf(function: Callable, kind) -> Callable:
    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns)], dtype=object)

    return apply


def returns(now: Column, before: Column) -> Column:
    return _udf(change, RESULT)(now.cast("decimal(38,18)"), before.cast("decimal(38,18)"))


def return_text(now: Column, before: Column) -> Column:
    """The return's digits as text, at any magnitude."""
    def text(a, b):
        value = change(a, b)
        return None if value is None else str(value)

    return _udf(text, T.StringType())(now.cast("decimal(38,18)"), before.cast("decimal(38,18)"))


def volatility(closed: DataFrame, by: list[str], window: int) -> DataFrame:
    """``volatility_exact`` over the last ``window`` closed candles, null where undefined."""
    if window < 3:
        raise ValueError("window must be 3 or more")
    from wickline.operators.features import ordered

    inside = ordered(by).rowsBetween(-(window - 1), 0)
    closes = F.collect_list(F.col("close").cast("decimal(38,18)")).over(inside)
    exact = _udf(lambda x: deviation(list(x)) if x is not None and len(x) == window else None, RESULT)
    return closed.withColumn("_closes", closes).withColumn("volatility_exact", exact(F.col("_closes"))).drop("_closes")


def within_range(high: Column, low: Column, first: Column, limit: Decimal) -> Column:
    """(high - low) / |first| <= limit, dividing before comparing; null for a first close of 0."""
    def inside(h, lo, f):
        if h is None or lo is None or not f:
            return None
        with localcontext(CONTEXT):
            return bool((h - lo) / abs(f) <= limit)

    return _udf(inside, T.BooleanType())(*[c.cast("decimal(38,18)") for c in (high, low, first)])


def plain_text(value: Column) -> Column:
    """A decimal column without trailing zeros."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
