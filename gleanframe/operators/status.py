"""A status for every cell, and the curated and clean tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.missing import DEFAULT_TOKENS, column, normalise_missing
from gleanframe.functions.numbers import token_kind
from gleanframe.operators.features import emit_cells, load, number_of, text_of
from gleanframe.operators.impute import filled_features, impute
from gleanframe.operators.outliers import Rule, cell_verdicts, rule_verdicts

STATUS = "_status"
_FLAGGED = "_flagged"


def _status_columns(
    clean: DataFrame, profile_df: DataFrame, outliers: Mapping[str, Rule] | DataFrame,
    key: Sequence[str], imputation: str | int | None,
) -> tuple[DataFrame, dict[str, Column]]:
    """The table (joined with forest flags if there are any) and one status expression per feature."""
    rows = load(profile_df)
    filled = filled_features(profile_df, imputation)
    by_rule = not isinstance(outliers, DataFrame)
    known = {r["feature"]: r["n_outliers"] for r in rows}
    if any(v is None for v in known.values()) and any(r["var_type"] == "unknown" for r in rows):
        # A column with outliers loses its incompatibility marks, so the counts are needed.
        verdicts = rule_verdicts(clean, profile_df, outliers) if by_rule else cell_verdicts(profile_df, outliers)
        known = {r["feature"]: r["n_outliers"] for r in verdicts.collect()}
    if not by_rule:
        # At most one entry per feature and row; only flagged rows appear on this side.
        flags = outliers.groupBy(*map(column, key)).agg(F.collect_set("feature").alias(_FLAGGED))
        clean = clean.join(flags, list(key), "left")
    out = {}
    for r in rows:
        n = r["feature"]
        if by_rule:
            flagged = outliers[n].flags(number_of(r))
        else:
            flagged = F.coalesce(F.array_contains(F.col(_FLAGGED), n), F.lit(False))
        status = F.when(flagged, "outlier").when(
            column(n).isNull(), "imputed" if n in filled else "missing")
        if r["var_type"] == "unknown" and not known[n]:
            status = status.when(token_kind(text_of(n)) == "string", "incompatible")
        out[n] = status.otherwise("ok")
    return clean, out


def cell_status(
    df: DataFrame, profile_df: DataFrame, outliers: Mapping[str, Rule] | DataFrame, key: Sequence[str],
    long: bool = False, imputation: str | int | None = "none", tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """Status per cell: outlier, then imputed or missing, then incompatible, then ok.

    ``outliers`` is either fitted rules (then this is one narrow pass) or a table of flagged cells.
    Wide form adds ``_status`` (map from feature to status); long form lists the cells that are not ok.
    """
    clean, status = _status_columns(normalise_missing(df, tokens), profile_df, outliers, key, imputation)
    if long:
        return emit_cells(clean, key, [(n, s != "ok", text_of(n), s) for n, s in status.items()])
    pairs = F.create_map(*[x for n, s in status.items() for x in (F.lit(n), s)])
    return clean.select(*map(column, df.columns), pairs.alias(STATUS))


def curated(
    df: DataFrame, profile_df: DataFrame, outliers: Mapping[str, Rule] | DataFrame, key: Sequence[str],
    imputation: str | int | None = "mean_mode", seed: int = 0, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """All columns, filled, with the status map of the cells as they were before filling."""
    marked = cell_status(df, profile_df, outliers, key, imputation=imputation, tokens=tokens)
    return impute(marked, profile_df, key, imputation, seed, tokens)


def bad_features(profile_df: DataFrame) -> list[str]:
    return [r["feature"] for r in load(profile_df) if r["state"] == "bad"]


def clean(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str] = (), imputed: bool = False,
    imputation: str | int | None = "mean_mode", seed: int = 0, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """The table without its bad columns. Missing cells stay missing unless ``imputed`` is set."""
    kept = [c for c in df.columns if c not in set(bad_features(profile_df))]
    table = normalise_missing(df, tokens).select(*map(column, kept))
    return impute(table, profile_df, key, imputation, seed, tokens) if imputed else table
