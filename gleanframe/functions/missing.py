"""What counts as a missing cell, and turning every such cell into NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" after trimming. Case-sensitive.
DEFAULT_TOKENS = ("?", "", "None", "nan", "NaN")

# Further missing marks that a CSV file may use.
CSV_TOKENS = DEFAULT_TOKENS + (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "n/a", "null", ".", "~",
)

MARK = "missing_is_null"
WHITESPACE = " \t\n\r\f\v"

CONTINUOUS_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def column(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_continuous(data_type: T.DataType) -> bool:
    return isinstance(data_type, CONTINUOUS_TYPES)


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, NESTED_TYPES)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing(c: Column, data_type: T.DataType, tokens: Sequence[str] = DEFAULT_TOKENS) -> Column:
    """True where the cell is NULL, NaN or one of the missing tokens."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    if isinstance(data_type, T.StringType):
        return c.isNull() | strip(c).isin(*tokens)
    return c.isNull()


def normalise_missing(df: DataFrame, tokens: Sequence[str] = DEFAULT_TOKENS) -> DataFrame:
    """Every missing cell becomes NULL. Column names and types stay; one narrow projection.

    Columns done once carry a mark in their metadata and are not tested again.
    """
    mark = {MARK: list(tokens)}
    out = []
    for f in df.schema.fields:
        c = column(f.name)
        testable = isinstance(f.dataType, (T.FloatType, T.DoubleType, T.StringType))
        if testable and f.metadata.get(MARK) != mark[MARK]:
            c = F.when(~is_missing(c, f.dataType, tokens), c).alias(f.name, metadata={**f.metadata, **mark})
        out.append(c)
    return df.select(*out)
