"""Reading numbers out of text, and printing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.missing import strip

# Spark's cast also takes Java suffixes ('1d', '2f') and hex floats, which are not numbers here.
NUMBER_PATTERN = (
    r"^[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"
)


def parse_number(c: Column) -> Column:
    """Text to double; NULL when the trimmed text is not a number."""
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def is_integral(x: Column) -> Column:
    """True for a double without a fraction. Infinities are not integral."""
    return (x % F.lit(1.0)) == F.lit(0.0)


def token_kind(c: Column) -> Column:
    """Kind of one non-missing text value: ``int``, ``float`` or ``string``."""
    x = parse_number(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(x.isNull(), "string")
        .when(is_integral(x), "int")
        .otherwise("float")
    )


def render_number(c: Column, missing: str = "?") -> Column:
    """Print a cell: integral numbers without a fraction, missing as ``?``, other text as it is.

    Doubles go through decimal so that large ones do not print in E notation; magnitudes that do
    not fit fall back to Spark's own form.
    """
    text = c.cast("string")
    x = parse_number(text)
    blank = text.isNull() | strip(text).isin("", "None", "nan", "NaN")
    whole = x.try_cast("decimal(38,0)").cast("string")
    plain = F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), r"0+$", "")
    exact = F.when(plain.try_cast("double") == x, plain)
    return (
        F.when(blank, missing)
        .when(x.isNull(), text)
        .when(is_integral(x), F.coalesce(whole, x.cast("string")))
        .otherwise(F.coalesce(exact, x.cast("string")))
    )
