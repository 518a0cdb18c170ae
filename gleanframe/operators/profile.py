"""One row of facts per column: types, missing cells, range, centre, state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, is_continuous, normalise_missing
from gleanframe.functions.numbers import is_integral, parse_number, token_kind
from gleanframe.functions.text import display_name
from gleanframe.operators.features import emit_cells, load, supported_columns, text_of
from gleanframe.operators.quantiles import exact_quantiles

# Columns per aggregate. Ten columns keep the aggregate's buffers within one generated function; the
# aggregates of all batches run side by side in one job, each reading only its own columns.
COLUMNS_PER_PASS = 10

# Characters up to which a text value is grouped as it is; longer ones go by digest.
SHORT = 32

# Name parts that mark a numeric column as a date. Case-sensitive.
DATE_NAME_PARTS = ("year", "Year", "Date", "date", "Dates", "yr")
# This one counts only in names without the veto part.
DATE_NAME_PART_VETOED = ("YEAR", "Age")

# Texts of the printed report.
UNKNOWN_TYPE = "yes, unknown type of data"
BAD_FEATURE = "yes, bad feature"

PROFILE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("storage", T.StringType()),
    T.StructField("var_type", T.StringType()),
    T.StructField("measure_type", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_missing", T.LongType()),
    T.StructField("state", T.StringType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("domain_size", T.LongType()),
    T.StructField("center", T.DoubleType()),
    T.StructField("mode", T.StringType()),
    T.StructField("incompatibility", T.StringType()),
    T.StructField("n_incompatible", T.LongType()),
    T.StructField("outlier_verdict", T.StringType()),
    T.StructField("n_outliers", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
])


def named_like_date(name: str) -> bool:
    part, veto = DATE_NAME_PART_VETOED
    return any(p in name for p in DATE_NAME_PARTS) or (part in name and veto not in name)


def state_of(n_missing: int, n_rows: int, threshold: float) -> str:
    if n_missing >= n_rows * threshold:
        return "bad"
    return "fair" if n_missing > 0 else "good"


def feature_state(
    df: DataFrame, threshold: float = 1 / 3, columns: Sequence[str] | None = None,
    tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """Only ``(feature, n_rows, n_missing, state)``: one aggregate, no shuffle of data."""
    names = supported_columns(df, columns)
    clean = normalise_missing(df.select(*map(column, names)), tokens)
    parts = []
    for at in range(0, len(names), COLUMNS_PER_PASS):
        batch = list(enumerate(names))[at : at + COLUMNS_PER_PASS]
        wide = clean.agg(F.count(F.lit(1)).alias("n"), *[F.count(column(n)).alias(f"c{i}") for i, n in batch])
        parts.append(wide.select("n", F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature"), F.lit(i).alias("ordinal"), F.col(f"c{i}").alias("c"))
            for i, n in batch])).alias("f")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    missing = F.col("n") - F.col("f.c")
    return rows.select(
        F.col("f.feature").alias("feature"),
        F.col("f.ordinal").alias("ordinal"),
        F.col("n").alias("n_rows"),
        missing.alias("n_missing"),
        F.when(missing >= F.col("n") * F.lit(threshold), "bad")
        .when(missing > 0, "fair").otherwise("good").alias("state"),
    )


def column_statistics(clean: DataFrame, names: Sequence[str], continuous: set[str]) -> DataFrame:
    """The wide aggregate behind the profile as one row per feature."""
    out = None
    for at in range(0, len(names), COLUMNS_PER_PASS):
        batch = names[at : at + COLUMNS_PER_PASS]
        cells, aggregates = [], [F.count(F.lit(1)).alias("n_rows")]
        for i, n in enumerate(batch):
            if n in continuous:
                cells.append(column(n).cast("double").alias(f"x{i}"))
                present = F.col(f"x{i}")
            else:
                cells += [text_of(n).alias(f"t{i}"), parse_number(text_of(n)).alias(f"x{i}")]
                present = F.col(f"t{i}")
            x = F.col(f"x{i}")
            aggregates += [
                F.count(present).alias(f"n_present_{i}"),
                F.count(x).alias(f"n_number_{i}"),
                F.count_if(is_integral(x)).alias(f"n_integral_{i}"),
                F.min(x).alias(f"min_{i}"),
                F.max(x).alias(f"max_{i}"),
                F.sum(x).alias(f"sum_{i}"),
                F.stddev_pop(x).alias(f"stddev_{i}"),
            ]
        facts = ("n_present", "n_number", "n_integral", "min", "max", "sum", "stddev")
        rows = clean.select(*cells).agg(*aggregates).select("n_rows", F.explode(F.array(*[
            F.struct(F.lit(n).alias("feature"), *[F.col(f"{k}_{i}").alias(k) for k in facts])
            for i, n in enumerate(batch)])).alias("f")).select("n_rows", "f.*")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("mean", F.try_divide(F.col("sum"), F.col("n_number")))


def distinct_values(clean: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, value, n)``: every distinct non-missing text value with its row count."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), text_of(n).alias("value")) for n in names
    ])).alias("p")
    return (
        clean.select(pairs).select("p.feature", "p.value").filter("value IS NOT NULL")
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def feature_values(
    df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """``(feature, value, n)``: the whole domain of every text column, a row per value."""
    names = [n for n in supported_columns(df, columns) if not is_continuous(df.schema[n].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint")
    return distinct_values(normalise_missing(df.select(*map(column, names)), tokens), names)


def domain_facts(clean: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, str, float | None]]:
    """``{feature: (domain_size, mode, distinct_mean)}`` of text columns; the values themselves are ``feature_values``.

    Values of more than SHORT characters are counted by digest, with their first characters beside it, so long texts are not
    shuffled. The mode is the smallest of the most frequent values; where it is a long one, its text is fetched among the values
    that begin as the smallest beginning does.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), text_of(n).alias("value")) for n in names])).alias("p")
    long = F.length("value") > SHORT
    cells = clean.select(pairs).select("p.feature", "p.value").filter("value IS NOT NULL").select(
        "feature", "value", F.when(long, F.md5("value")).alias("digest"), F.when(long, F.substring("value", 1, SHORT // 2)).otherwise(F.col("value")).alias("head"))
    groups = cells.groupBy("feature", "digest", "head").agg(F.count(F.lit(1)).alias("n"), F.min(parse_number(F.col("value"))).alias("x"))
    first = F.struct((-F.col("n")).alias("k"), F.col("head").alias("v"))
    facts = groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("mean"),
        F.min(F.when(F.col("digest").isNull(), first)).alias("short"), F.min(F.when(F.col("digest").isNotNull(), first)).alias("long")).collect()
    texts: dict[str, str] = {}
    sought = [r for r in facts if r["long"] and not (r["short"] and r["short"]["k"] < r["long"]["k"])]
    for once in (True, False):
        own = [r for r in sought if (r["long"]["k"] == -1) == once]
        if not own:
            continue
        fits = [(F.col("feature") == r["feature"]) & F.col("digest").isNotNull() & (F.col("head") == r["long"]["v"]) for r in own]
        some = cells.filter(reduce(lambda a, b: a | b, fits))
        if not once:  # where every value occurs once, all that begin so are as frequent
            top = [f & (F.col("n") == -r["long"]["k"]) for f, r in zip(fits, own)]
            some = some.join(groups.filter(reduce(lambda a, b: a | b, top)), ["feature", "digest"], "left_semi")
        texts |= {r["feature"]: r["v"] for r in some.groupBy("feature").agg(F.min("value").alias("v")).collect()}
    out = {}
    for r in facts:
        short, long = r["short"], r["long"]
        top = min(x["k"] for x in (short, long) if x)
        ties = [short["v"]] if short and short["k"] == top else []
        if long and long["k"] == top:
            ties.append(texts[r["feature"]])
        out[r["feature"]] = r["size"], min(ties, key=str.encode), r["mean"]
    return out


def profile(
    df: DataFrame,
    threshold: float = 1 / 3,
    columns: Sequence[str] | None = None,
    tokens: Sequence[str] = DEFAULT_TOKENS,
    strict_null_typing: bool = False,
) -> DataFrame:
    """Annotate and assess every column. One row per feature, computed eagerly.

    Scans: one aggregate over all columns; one over the text columns for their domains; and a
    selection of medians for date-like and one-digit columns only. ``strict_null_typing`` lets a
    missing cell of a text column count as a float token, as a CSV text column does in pandas.
    """
    spark = df.sparkSession
    names = supported_columns(df, columns)
    clean = normalise_missing(df.select(*map(column, names)), tokens)
    continuous = {n for n in names if is_continuous(df.schema[n].dataType)}
    stats = {r["feature"]: r for r in column_statistics(clean, names, continuous).collect()} if names else {}

    rows: list[dict] = []
    for i, n in enumerate(names):
        s = stats[n]
        n_rows = s["n_rows"]
        n_missing = n_rows - s["n_present"]
        row = dict.fromkeys(PROFILE_SCHEMA.names)
        row.update(
            feature=n, ordinal=i, n_rows=n_rows, n_missing=n_missing,
            storage="continuous" if n in continuous else "discrete",
            state=state_of(n_missing, n_rows, threshold), n_incompatible=0,
        )
        text = s["n_present"] - s["n_number"]
        fractions = s["n_number"] - s["n_integral"]
        numbers = s["n_number"]
        if strict_null_typing and n not in continuous and n_missing:
            numbers, fractions = numbers + 1, fractions + 1
        if n not in continuous and numbers == 0:
            row.update(var_type="string", measure_type="categorical")
        elif text > 0:
            row.update(var_type="unknown", measure_type="unknown", n_incompatible=text)
        else:
            row.update(min=s["min"], max=s["max"], mean=s["mean"], stddev=s["stddev"])
            if named_like_date(n):
                row.update(var_type="date", measure_type="numeric")
            else:
                kind = "float" if fractions else "int"
                digits = s["min"] is not None and all(
                    v % 1 == 0 and 0 <= v <= 9 for v in (s["min"], s["max"]))
                categorical = digits and (kind == "int" or n in continuous)
                row.update(var_type=kind, measure_type="categorical" if categorical else "numeric")
        if row["var_type"] == "unknown":
            row["incompatibility"] = UNKNOWN_TYPE
        else:
            row["incompatibility"] = BAD_FEATURE if row["state"] == "bad" else "no"
        rows.append(row)

    text_names = [n for n in names if n not in continuous]
    distinct_mean: dict[str, float | None] = {}
    if text_names:
        for n, (size, mode, mean) in domain_facts(clean, text_names).items():
            rows[names.index(n)].update(domain_size=size, mode=mode)
            distinct_mean[n] = mean

    by_median = [r for r in rows if r["min"] is not None
                 and (r["var_type"] == "date" or r["measure_type"] == "categorical")]
    medians: dict[str, float | None] = {}
    over_rows = [r["feature"] for r in by_median if r["feature"] in continuous]
    over_domain = [r["feature"] for r in by_median if r["feature"] not in continuous]
    if over_rows:
        cells = {n: column(n).cast("double") for n in over_rows}
        medians.update({n: v[0] for n, v in exact_quantiles(clean, cells, [0.5]).items()})
    if over_domain:
        number = parse_number(F.col("value"))
        cells = {n: F.when(F.col("feature") == n, number) for n in over_domain}
        values = distinct_values(clean, over_domain)
        medians.update({n: v[0] for n, v in exact_quantiles(values, cells, [0.5]).items()})
    for row in rows:
        if row["min"] is None:
            continue
        n = row["feature"]
        if n in medians:
            row["center"] = float(np.around(medians[n]))
        else:
            mean = row["mean"] if n in continuous else distinct_mean[n]
            row["center"] = float(np.around(mean, 2))
    return spark.createDataFrame([tuple(r[c] for c in PROFILE_SCHEMA.names) for r in rows], PROFILE_SCHEMA)


def summarise(profile_df: DataFrame) -> DataFrame:
    """The one-row dataset summary, computed from the profile alone."""

    def share(part, whole, digits):
        return F.bround(F.try_divide(F.lit(100.0) * part, whole), digits)

    n = F.col("n_features")
    cells = n * F.col("n_instances")
    counted = profile_df.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_instances"),
        F.count_if(F.col("measure_type") == "categorical").alias("n_discrete"),
        F.count_if(F.col("measure_type") == "numeric").alias("n_continuous"),
        F.count_if(F.col("measure_type") == "unknown").alias("n_unknown"),
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("good", "fair", "bad")],
        F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_outliers"),
    )
    return counted.select(
        "n_features", "n_instances", "n_discrete", "n_continuous", "n_unknown",
        "n_missing", share(F.col("n_missing"), cells, 2).alias("pct_missing"),
        "n_good", share(F.col("n_good"), n, 1).alias("pct_good"),
        "n_fair", share(F.col("n_fair"), n, 1).alias("pct_fair"),
        "n_bad", share(F.col("n_bad"), n, 1).alias("pct_bad"),
        "n_outliers", share(F.col("n_outliers"), cells, 2).alias("pct_outliers"),
    )


def features_by_state(profile_df: DataFrame) -> DataFrame:
    """``(state, features)``: display names per state, in column order."""
    named = F.struct("ordinal", display_name(F.col("feature")).alias("name"))
    return profile_df.groupBy("state").agg(F.array_sort(F.collect_list(named))["name"].alias("features"))


def describe_feature(df: DataFrame, name: str, tokens: Sequence[str] = DEFAULT_TOKENS) -> DataFrame:
    """Mean, median, population deviation, biased skewness and excess kurtosis, to 2 decimals."""
    clean = normalise_missing(df.select(column(name)), tokens)
    x = column(name).cast("double") if is_continuous(df.schema[name].dataType) else parse_number(text_of(name))
    median = exact_quantiles(clean, {name: x}, [0.5])[name][0]
    return clean.select(x.alias("x")).agg(
        F.bround(F.avg("x"), 2).alias("mean"),
        F.bround(F.lit(median).cast("double"), 2).alias("median"),
        F.bround(F.stddev_pop("x"), 2).alias("std"),
        F.bround(F.skewness("x"), 2).alias("skewness"),
        F.bround(F.kurtosis("x"), 2).alias("kurtosis"),
    ).select(F.lit(name).alias("feature"), "*")


def incompatible_cells(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str], tokens: Sequence[str] = DEFAULT_TOKENS
) -> DataFrame:
    """Cells of ``unknown`` columns that are not numbers: ``(key, feature, value, status)``."""
    clean = normalise_missing(df, tokens)
    return emit_cells(clean, key, [
        (r["feature"], token_kind(text_of(r["feature"])) == "string", text_of(r["feature"]),
         F.lit("incompatible"))
        for r in load(profile_df) if r["var_type"] == "unknown"
    ])
