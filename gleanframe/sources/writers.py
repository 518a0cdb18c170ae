"""Writing the results of a curation as datasets."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import column, is_nested
from gleanframe.functions.numbers import render_number

#: Tables with a row per row or cell of the input; their rows are counted while they are written.
ROW_TABLES = ("cells", "curated", "clean")
TABLES = ("evaluation", "profile", "values", "summary", "cells", "curated", "clean", "corr_pairs", "lex_pairs")


def flat(df: DataFrame, missing: str = "?") -> DataFrame:
    """For CSV: nested columns as JSON text, cells printed with ``?`` for missing."""
    return df.select(*[
        (F.to_json(column(f.name)) if is_nested(f.dataType) else render_number(column(f.name), missing)).alias(f.name)
        for f in df.schema.fields
    ])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "csv":
        flat(df).write.mode(mode).option("escape", '"').csv(path, header=True)
    elif fmt in ("parquet", "json"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"unsupported report format {fmt!r}")


def write_reports(result, path: str, fmt: str = "parquet", name: str = "dataset", mode: str = "errorifexists") -> None:
    """Each table under ``<path>/<name>_<table>``, and the combined ``<path>/<name>_results`` JSON.

    The combined document holds what is bounded by the number of columns; the row-level tables and the whole
    domains (``values``) are datasets beside it, of which it has the numbers of rows.
    """
    rows = {}
    for table in TABLES:
        df = getattr(result, table)
        if table in ROW_TABLES:
            rows[table] = Observation()
            df = df.observe(rows[table], F.count(F.lit(1)).alias("rows"))
        write_table(df, f"{path}/{name}_{table}", fmt, mode)
    document = {"timestamp": datetime.now(timezone.utc).isoformat(), "rows": {t: o.get["rows"] for t, o in rows.items()}}
    for table in ("summary", "profile", "corr_pairs", "lex_pairs"):
        document[table] = [r.asDict(recursive=True) for r in getattr(result, table).collect()]
    document["skipped"] = dict(result.skipped)
    document["tables"] = {t: f"{name}_{t}" for t in TABLES}
    line = json.dumps(document, allow_nan=True)
    spark = result.profile.sparkSession
    spark.createDataFrame([(line,)], T.StructType([T.StructField("value", T.StringType())])) \
        .coalesce(1).write.mode(mode).text(f"{path}/{name}_results")
