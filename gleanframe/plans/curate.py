"""The whole curation of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, normalise_missing
from gleanframe.operators import correlation, impute, outliers
from gleanframe.operators.features import skipped_columns
from gleanframe.operators.materialise import spread_out, staged
from gleanframe.operators.names import similar_names
from gleanframe.operators.profile import feature_values, profile, summarise
from gleanframe.operators.report import evaluation_report
from gleanframe.operators.status import cell_status, clean, curated
from gleanframe.sources.readers import read_dataset


@dataclass
class CurationResult:
    """``profile``, ``summary`` and the pair tables are computed; the row-level tables are lazy."""

    profile: DataFrame
    values: DataFrame
    summary: DataFrame
    cells: DataFrame
    curated: DataFrame
    clean: DataFrame
    corr_pairs: DataFrame
    lex_pairs: DataFrame
    skipped: dict[str, str] = field(default_factory=dict)

    @property
    def evaluation(self) -> DataFrame:
        return evaluation_report(self.profile, self.values)


def curate(
    df: DataFrame,
    key: Sequence[str],
    imputation: str | int | None = None,
    outlier_method: str | int | None = None,
    similarity: str | int | None = None,
    threshold: float = 1 / 3,
    seed: int = 0,
    tokens: Sequence[str] = DEFAULT_TOKENS,
    strict_null_typing: bool = False,
    stage: bool | None = None,
) -> CurationResult:
    """Annotate, assess, flag, relate and fill. ``key`` names the columns that identify a row.

    Methods go by name or by number; without one, nothing is filled, outliers go by z-score and
    similarity (values and names alike) is skipped. Nested columns are passed through and listed in
    ``skipped``. With ``stage`` the table is written once to the checkpoint folder, spread over the cores, and every step reads only its
    columns of that; without, every one of some dozen passes makes the whole table again, in as many tasks as its files have splits.
    None: as far as all columns can be written.
    """
    key = list(key)
    features = [c for c in df.columns if c not in key]
    skipped = skipped_columns(df, features)
    features = [c for c in features if c not in skipped]
    base = normalise_missing(df, tokens)
    if stage is None:
        stage = not any(isinstance(f.dataType, T.NullType) for f in base.schema)
    if stage:
        base = staged(spread_out(base))
    facts = profile(base, threshold, features, tokens=tokens, strict_null_typing=strict_null_typing)

    method = outliers.method_name(outlier_method)
    if method in outliers.FOREST_METHODS:
        found = outliers.flag_outliers(base, facts, key, method, seed, tokens)
        verdicts = outliers.cell_verdicts(facts, found)
    else:
        found = outliers.fit_rules(base, facts, method, tokens)
        verdicts = outliers.rule_verdicts(base, facts, found, tokens)
    facts = outliers.with_verdicts(facts, verdicts)

    relation = correlation.method_name(similarity)
    fill = impute.method_name(imputation)
    corr = correlation.correlated_pairs(base, relation, features, key=key, tokens=tokens)
    if relation == "none":
        lex = df.sparkSession.createDataFrame([], correlation.PAIR_SCHEMA)
    else:
        lex = similar_names(base.select(*map(column, features)))
    return CurationResult(
        profile=facts,
        values=feature_values(base, features, tokens),
        summary=summarise(facts),
        cells=cell_status(base, facts, found, key, long=True, imputation=fill, tokens=tokens),
        curated=curated(base, facts, found, key, fill, seed, tokens),
        clean=clean(base, facts, key, tokens=tokens),
        corr_pairs=corr,
        lex_pairs=lex,
        skipped=skipped,
    )


def curate_file(spark: SparkSession, path: str, key: Sequence[str], fmt: str | None = None, **methods) -> CurationResult:
    """``curate`` on a file. Formats that every step would parse again (CSV, JSON) are staged: a CSV file is read for its header,
    for its types and for the staged table, and not again."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    return curate(read_dataset(spark, path, fmt), key, stage=fmt != "parquet", **methods)
