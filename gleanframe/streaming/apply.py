"""Applying a saved profile to a stream: status and filling are row-wise, so they run unchanged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from gleanframe.functions.missing import DEFAULT_TOKENS
from gleanframe.operators import impute
from gleanframe.operators.outliers import Rule
from gleanframe.operators.status import cell_status, curated


def curate_stream(
    stream: DataFrame, profile_df: DataFrame, rules: Mapping[str, Rule],
    imputation: str | int | None = "mean_mode", tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """The curated rows of a stream, with ``_status``. A stateless projection.

    The profile and the rules come from a batch run; the profile must carry its outlier verdicts.
    Random filling and forest flags need the whole table and are refused.
    """
    if impute.method_name(imputation) == "random":
        raise ValueError("random imputation needs the whole table")
    return curated(stream, profile_df, rules, (), imputation, tokens=tokens)


def flag_stream(
    stream: DataFrame, profile_df: DataFrame, rules: Mapping[str, Rule], key: Sequence[str],
    imputation: str | int | None = "none", tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """The cells of a stream that are not ok, as ``(key, feature, value, status)``."""
    return cell_status(stream, profile_df, rules, key, long=True, imputation=imputation, tokens=tokens)
