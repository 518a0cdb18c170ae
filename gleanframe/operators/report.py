"""The evaluation report: one printable row per feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.numbers import render_number
from gleanframe.functions.text import display_name

# Fixed values of the printed report.
RANGE_LIMIT = 100
RANGE_TOO_LARGE = "Too large to display!!"
NO_CENTER = "-"


def evaluation_report(profile_df: DataFrame, values: DataFrame) -> DataFrame:
    """Range, types, missing cells, centre, state, outliers and incompatibilities as text.

    ``values`` are the ``feature_values`` of the table. A text column with fewer than ``RANGE_LIMIT`` values gets all of
    them, one with more the note that the report has always printed.
    """
    few = values.join(
        F.broadcast(profile_df.filter(F.col("domain_size") < RANGE_LIMIT).select("feature")), "feature", "left_semi")
    listed_values = few.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("listed"))

    def printed(name: str):
        return render_number(F.col(name))

    textual = F.col("var_type").isin("string", "unknown")
    listed = F.when(F.coalesce("domain_size", F.lit(0)) >= RANGE_LIMIT, RANGE_TOO_LARGE).otherwise(
        F.concat(F.lit("["), F.array_join(F.coalesce("listed", F.array().cast("array<string>")), ", "), F.lit("]")))
    interval = F.concat(F.lit("["), printed("min"), F.lit(", "), printed("max"), F.lit("]"))
    return profile_df.join(listed_values, "feature", "left").orderBy("ordinal").select(
        display_name(F.col("feature")).alias("feature"),
        F.when(textual, listed).otherwise(interval).alias("value_range"),
        F.col("measure_type").alias("type"),
        F.col("var_type").alias("variable_type"),
        F.col("n_missing").alias("missing_values"),
        F.when(textual, NO_CENTER).otherwise(printed("center")).alias("center"),
        "state",
        F.col("outlier_verdict").alias("outliers"),
        F.col("incompatibility").alias("incompatibilities"),
    )
