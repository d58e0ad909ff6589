"""Numbers as text: the shortest digits that read back as the same double, laid out as evidence tokens have them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exponents within which a number is written without one.
LEAST, BEHIND = -4, 16
#: Gives a double's shortest digits, in Java's layout and two of them at least.  It is of the JSON library that Spark itself
#: writes with; the cast to a string has more digits than needed for some numbers, as the JDK before 19.
SHORTEST = "com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def float_text(value: Column) -> Column:
    """A double's shortest text: ``0.1``, ``100.0``, ``1e-05``, ``1.5e+16``, ``nan``, ``-inf``; null stays null."""
    shown = _let(_let(F.abs(value), _parts), lambda p: _layout(p["digits"], p["exponent"]))
    negative = F.substring(value.cast("string"), 1, 1) == "-"
    text = F.when(value == 0, "0.0").when(F.abs(value) == float("inf"), "inf").otherwise(shown)
    return F.when(F.isnan(value), "nan").when(value.isNotNull(), F.concat(F.when(negative, "-").otherwise(""), text))


def _parts(number: Column) -> Column:
    """Digits and exponent of a number above 0: 1.25e-7 gives "125" and -7."""
    one = F.format_string("%.0e", number)
    shortest = F.reflect(F.lit(SHORTEST), F.lit("toString"), number)

    def split(text: Column) -> Column:
        mantissa, raised = F.substring_index(text, "E", 1), F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        before, plain = F.instr(mantissa, ".") - 1, F.replace(mantissa, F.lit("."), F.lit(""))
        digits = F.regexp_replace(plain, "^0+|0+$", "")
        return F.struct(digits.alias("digits"), (before - 1 - F.length(F.regexp_extract(plain, "^0+", 0)) + raised).alias("exponent"))

    few = F.struct(F.substring(one, 1, 1).alias("digits"), F.substring_index(one, "e", -1).cast("int").alias("exponent"))
    return F.when(one.cast("double") == number, few).otherwise(_let(shortest, split))


def _layout(digits: Column, exponent: Column) -> Column:
    behind, size = F.substring(digits, 2, 20), F.abs(exponent).cast("string")
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(behind != "", F.concat(F.lit("."), behind)).otherwise(""), F.lit("e"), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole, rest = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.substring(digits, exponent + 2, F.lit(20))
    large = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    return F.when((exponent < LEAST) | (exponent >= BEHIND), scientific).when(exponent < 0, small).otherwise(large)


def number_text(value: Column) -> Column:
    """The text of a number of any type; decimals keep their digits."""
    return F.when(F.typeof(value).isin("double", "float"), float_text(value.cast("double"))).otherwise(value.cast("string"))
