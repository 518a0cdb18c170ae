"""Reading columns of a table by what its profile says about them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gleanframe.functions.missing import column, is_continuous, is_nested
from gleanframe.functions.numbers import parse_number

NUMERIC = ("int", "float", "date")


def supported_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    wanted = list(columns) if columns is not None else df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if not is_nested(fields[c])]


def skipped_columns(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Columns that no operator reads, with the reason."""
    wanted = set(columns) if columns is not None else set(df.columns)
    return {
        f.name: f"nested type {f.dataType.simpleString()}"
        for f in df.schema.fields
        if f.name in wanted and is_nested(f.dataType)
    }


def text_of(name: str) -> Column:
    return column(name).cast("string")


def number_of(row: Row) -> Column:
    """The feature of a normalised table as double: the column itself, or the number in its text."""
    if row["storage"] == "continuous":
        return column(row["feature"]).cast("double")
    return parse_number(text_of(row["feature"]))


def raw_number(df: DataFrame, name: str) -> Column:
    """Any column of a normalised table coerced to double; NULL where that fails."""
    if is_continuous(df.schema[name].dataType):
        return column(name).cast("double")
    return parse_number(text_of(name))


def load(profile_df: DataFrame) -> list[Row]:
    """The profile's rows in column order: one per feature, so bounded by the schema."""
    return sorted(profile_df.collect(), key=lambda r: r["ordinal"])


def emit_cells(
    df: DataFrame, key: Sequence[str], cells: Iterable[tuple[str, Column, Column, Column]]
) -> DataFrame:
    """Long table ``(key, feature, value, status)`` of the cells whose predicate holds.

    ``cells`` holds (feature, predicate, value, status). Rows without any such cell are dropped
    before the cells are spread out, so the common case costs one filter per row.
    """
    cells = list(cells)
    spread_type = "struct<feature:string,value:string,status:string>"
    if not cells:
        empty = F.lit(None).cast(spread_type)
        return df.filter(F.lit(False)).select(*map(column, key), empty.alias("c")).select(*map(column, key), "c.*")
    some = cells[0][1]
    for _, predicate, _, _ in cells[1:]:
        some = some | predicate
    spread = F.explode(F.array(*[
        F.when(p, F.struct(F.lit(f).alias("feature"), v.cast("string").alias("value"),
                           s.cast("string").alias("status"))) for f, p, v, s in cells
    ])).alias("_cell")
    return (
        df.filter(some)
        .select(*map(column, key), spread)
        .filter("_cell IS NOT NULL")
        .select(*map(column, key), "_cell.feature", "_cell.value", "_cell.status")
    )
