"""Flagging outlier cells.

Each threshold method is fitted once into one small rule per feature; a rule is a predicate over the
column, so flagging is a projection and filter without a shuffle. The isolation forest methods are in
``forest``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, normalise_missing
from gleanframe.operators import forest
from gleanframe.operators.features import NUMERIC, emit_cells, load, number_of, text_of
from gleanframe.operators.grubbs import grubbs_cuts
from gleanframe.operators.profile import PROFILE_SCHEMA
from gleanframe.operators.quantiles import exact_quantiles

RULE_METHODS = ("zscore", "modified_z", "iqr", "grubbs", "mad", "none")
FOREST_METHODS = ("forest_joint", "forest_each")
METHOD_IDS = {1: "zscore", 2: "modified_z", 3: "iqr", 4: "grubbs", 5: "none",
              6: "forest_joint", 7: "forest_each", 8: "none"}

# Fixed values of the tests.
Z_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5
MAD_FACTOR = 1.486
MEAN_DEVIATION_FACTOR = 1.253314
IQR_FACTOR = 1.5
MAD_RULE_FACTOR = 3.0

VERDICT_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("outlier_verdict", T.StringType()),
    T.StructField("n_outliers", T.LongType()),
])


@dataclass(frozen=True)
class Rule:
    """Flag x when |x - center| / scale > limit, or when x lies outside [low, high].

    ``applicable=False`` means the feature is not tested at all; a rule without numbers flags nothing.
    """

    applicable: bool = True
    center: float | None = None
    scale: float | None = None
    limit: float | None = None
    low: float | None = None
    high: float | None = None

    @property
    def silent(self) -> bool:
        if not self.applicable:
            return True
        if self.scale is not None:
            # Every score is then undefined or zero.
            return self.scale == 0 or not (math.isfinite(self.center) and math.isfinite(self.scale))
        return not any(v is not None and not math.isnan(v) for v in (self.low, self.high))

    def flags(self, x: Column) -> Column:
        """Never NULL; x is NULL or a number, never NaN."""
        if self.silent:
            return F.lit(False)
        if self.scale is not None:
            hit = F.abs((x - F.lit(self.center)) / F.lit(self.scale)) > F.lit(self.limit)
        elif self.low is not None and self.high is not None:
            hit = ~x.between(self.low, self.high)
        else:
            hit = x < F.lit(self.low) if self.low is not None else x > F.lit(self.high)
        return F.coalesce(hit, F.lit(False))

    def coarse_bounds(self) -> tuple[float | None, float | None]:
        """Every flagged x lies below the first or above the second number."""
        if self.scale is None:
            return self.low, self.high
        reach = self.limit * self.scale
        slack = 1e-9 * (abs(self.center) + reach)
        return self.center - reach + slack, self.center + reach - slack


def method_name(method: str | int | None) -> str:
    if method is None:
        return "zscore"
    if isinstance(method, int):
        return METHOD_IDS.get(method, "none")
    if method not in RULE_METHODS + FOREST_METHODS:
        raise ValueError(f"unknown outlier method {method!r}")
    return method


def fit_rules(
    df: DataFrame, profile_df: DataFrame, method: str | int = "modified_z",
    tokens: Sequence[str] = DEFAULT_TOKENS, alpha: float = 0.05,
) -> dict[str, Rule]:
    """One rule per feature. ``zscore`` needs no scan: the profile has mean and deviation already."""
    method = method_name(method)
    rows = load(profile_df)
    if method == "none":
        return {r["feature"]: Rule() for r in rows}
    rules = {
        r["feature"]: Rule(applicable=r["var_type"] in NUMERIC and r["n_missing"] < r["n_rows"])
        for r in rows
    }
    tested = [
        r for r in rows
        if rules[r["feature"]].applicable
        # 0/1 columns keep the verdict "no" whatever the test would say.
        and not (r["var_type"] == "int" and r["min"] == 0 and r["max"] == 1)
    ]
    if not tested:
        return rules
    clean = normalise_missing(df, tokens)
    x = {r["feature"]: number_of(r) for r in tested}
    if method == "zscore":
        fitted = {r["feature"]: Rule(center=r["mean"], scale=r["stddev"], limit=Z_LIMIT) for r in tested}
    elif method == "iqr":
        fitted = {}
        for n, (q1, q3) in exact_quantiles(clean, x, [0.25, 0.75]).items():
            reach = IQR_FACTOR * (q3 - q1)
            fitted[n] = Rule(low=q1 - reach, high=q3 + reach)
    elif method == "grubbs":
        cuts = grubbs_cuts(clean, {r["feature"]: (x[r["feature"]], r["n_rows"] - r["n_missing"]) for r in tested}, alpha)
        fitted = {n: Rule(low=low, high=high) for n, (low, high) in cuts.items()}
    else:
        fitted = _median_rules(clean, tested, x, method)
    rules.update(fitted)
    return rules


def _median_rules(clean: DataFrame, tested, x: Mapping[str, Column], method: str) -> dict[str, Rule]:
    medians = {n: v[0] for n, v in exact_quantiles(clean, x, [0.5]).items()}
    deviations = {n: F.abs(x[n] - F.lit(medians[n])) for n in x}
    mads = {n: v[0] for n, v in exact_quantiles(clean, deviations, [0.5]).items()}
    if method == "mad":
        # Subtracts the MAD itself, not the median: |x - MAD| > 3 * MAD.
        return {n: Rule(center=mads[n], scale=1.0, limit=MAD_RULE_FACTOR * mads[n]) for n in x}
    means = {r["feature"]: r["mean"] for r in tested}
    flat = [n for n in x if mads[n] == 0]
    scales = {n: MAD_FACTOR * mads[n] for n in x}
    if flat:
        row = clean.agg(*[F.avg(F.abs(x[n] - F.lit(means[n]))).alias(f"d{i}") for i, n in enumerate(flat)]).first()
        scales.update({n: MEAN_DEVIATION_FACTOR * row[f"d{i}"] for i, n in enumerate(flat)})
    return {n: Rule(center=medians[n], scale=scales[n], limit=MODIFIED_Z_LIMIT) for n in x}


def rule_cells(
    df: DataFrame, profile_df: DataFrame, rules: Mapping[str, Rule], key: Sequence[str],
    tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """The cells that the fitted rules flag. One narrow pass."""
    rows = [r for r in load(profile_df) if not rules[r["feature"]].silent]
    if rows and all(r["storage"] == "continuous" for r in rows):
        # Plain comparisons on stored columns reach the file scan and skip blocks without outliers.
        some = None
        for r in rows:
            low, high = rules[r["feature"]].coarse_bounds()
            for beyond in ([column(r["feature"]) < F.lit(low)] if low is not None else []) + (
                    [column(r["feature"]) > F.lit(high)] if high is not None else []):
                some = beyond if some is None else some | beyond
        df = df.filter(some)
    clean = normalise_missing(df, tokens)
    cells = []
    for r in rows:
        x = number_of(r)
        cells.append((r["feature"], rules[r["feature"]].flags(x), text_of(r["feature"]), F.lit("outlier")))
    return emit_cells(clean, key, cells)


def flag_outliers(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str], method: str | int = "modified_z",
    seed: int = 0, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """Outlier cells as ``(key, feature, value, status)``."""
    method = method_name(method)
    if method in FOREST_METHODS:
        return forest.forest_cells(df, profile_df, key, method, seed, tokens)
    return rule_cells(df, profile_df, fit_rules(df, profile_df, method, tokens), key, tokens)


def rule_verdicts(
    df: DataFrame, profile_df: DataFrame, rules: Mapping[str, Rule],
    tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """``(feature, outlier_verdict, n_outliers)`` from one aggregate over the flagged columns."""
    rows = load(profile_df)
    counted = [r for r in rows if not rules[r["feature"]].silent]
    counts: dict[str, int] = {}
    if counted:
        clean = normalise_missing(df, tokens)
        for at in range(0, len(counted), 100):
            batch = counted[at : at + 100]
            got = clean.agg(*[
                F.count_if(rules[r["feature"]].flags(number_of(r))).alias(f"c{i}") for i, r in enumerate(batch)
            ]).first()
            counts.update({r["feature"]: got[f"c{i}"] for i, r in enumerate(batch)})
    return _verdicts(df, rows, {r["feature"]: rules[r["feature"]].applicable for r in rows}, counts)


def cell_verdicts(profile_df: DataFrame, cells_df: DataFrame) -> DataFrame:
    """The same for forest cells: only good features were tested."""
    rows = load(profile_df)
    counts = {r["feature"]: r["count"] for r in cells_df.groupBy("feature").count().collect()}
    return _verdicts(profile_df, rows, {r["feature"]: r["state"] == "good" for r in rows}, counts)


def _verdicts(df, rows, applicable: Mapping[str, bool], counts: Mapping[str, int]) -> DataFrame:
    out = []
    for r in rows:
        n = counts.get(r["feature"], 0)
        verdict = ("yes" if n else "no") if applicable[r["feature"]] else "not-applicable"
        out.append((r["feature"], verdict, n))
    return df.sparkSession.createDataFrame(out, VERDICT_SCHEMA)


def outlier_verdicts(
    df: DataFrame, profile_df: DataFrame, method: str | int = "modified_z", seed: int = 0,
    key: Sequence[str] = (), tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    method = method_name(method)
    if method in FOREST_METHODS:
        return cell_verdicts(profile_df, flag_outliers(df, profile_df, key, method, seed, tokens))
    return rule_verdicts(df, profile_df, fit_rules(df, profile_df, method, tokens), tokens)


def with_verdicts(profile_df: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The profile with its outlier columns filled in."""
    found = {r["feature"]: r for r in verdicts.collect()}
    rows = []
    for r in load(profile_df):
        d = r.asDict()
        d.update(outlier_verdict=found[r["feature"]]["outlier_verdict"], n_outliers=found[r["feature"]]["n_outliers"])
        rows.append(tuple(d[c] for c in PROFILE_SCHEMA.names))
    return profile_df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
