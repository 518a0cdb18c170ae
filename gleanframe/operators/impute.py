"""Filling missing cells. Observed cells are never changed, bad or incompatible columns never filled."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, is_continuous, normalise_missing
from gleanframe.operators.features import NUMERIC, load, text_of
from gleanframe.operators.running import running_totals

METHODS = ("mean_mode", "random", "zeros", "none")
METHOD_IDS = {0: "none", 1: "mean_mode", 2: "random", 3: "zeros"}


def method_name(method: str | int | None) -> str:
    if method is None:
        return "none"
    if isinstance(method, int):
        return METHOD_IDS.get(method, "none")
    if method not in METHODS:
        raise ValueError(f"unknown imputation method {method!r}")
    return method


def fillable(row: Row) -> bool:
    return row["state"] != "bad" and row["n_incompatible"] == 0 and row["n_missing"] > 0


def fill_value(row: Row, method: str) -> float | str | None:
    """The constant that replaces a missing cell of this feature; None = no fill."""
    if not fillable(row):
        return None
    number = row["storage"] == "continuous"
    if method == "zeros":
        return (0.0 if number else "0") if row["var_type"] in NUMERIC else None
    if method != "mean_mode":
        return None
    if not number:
        return row["mode"]
    mean = row["mean"]
    if mean is not None and row["measure_type"] == "categorical":
        rounded = float(np.around(mean))
        return float(math.floor(mean)) if rounded > row["max"] else rounded
    return mean


def drawable(row: Row) -> bool:
    """Random filling draws without replacement, so it needs enough observed values."""
    return fillable(row) and row["n_missing"] <= row["n_rows"] - row["n_missing"]


def filled_features(profile_df: DataFrame, method: str | int | None) -> set[str]:
    method = method_name(method)
    rows = load(profile_df)
    if method == "random":
        return {r["feature"] for r in rows if drawable(r)}
    return {r["feature"] for r in rows if fill_value(r, method) is not None}


def filled_type(stored: T.DataType, whole: bool) -> T.DataType:
    """The type of a filled numeric column that no observed value loses a digit in."""
    if isinstance(stored, T.IntegralType):
        return stored if whole else T.DecimalType(38, 6)
    return stored if isinstance(stored, T.DecimalType) else T.DoubleType()


def impute(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str] = (), method: str | int | None = "mean_mode",
    seed: int = 0, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """The same rows and columns with missing cells filled (or NULL where they are not).

    A filled whole-number column keeps its type where the fill is a whole number too; otherwise it comes back as
    ``decimal(38, 6)``, which holds every observed value. Other filled numeric columns come back as double. Only ``random``
    needs ``key`` and a shuffle.
    """
    method = method_name(method)
    clean = normalise_missing(df, tokens)
    rows = load(profile_df)
    if method == "random":
        return _draw(clean, [r for r in rows if drawable(r)], list(key), seed)
    fills = {r["feature"]: fill_value(r, method) for r in rows}
    storage = {r["feature"]: r["storage"] for r in rows}
    out = []
    for name in df.columns:
        fill = fills.get(name)
        if fill is None:
            out.append(column(name))
        elif storage[name] == "continuous":
            kind = filled_type(df.schema[name].dataType, float(fill).is_integer())
            out.append(F.coalesce(column(name).cast(kind), F.lit(fill).cast(kind)).alias(name))
        else:
            out.append(F.coalesce(text_of(name), F.lit(fill)).alias(name))
    return clean.select(*out)


def draw_order(seed: int, feature, key: Sequence[str]):
    """md5 of ``seed|feature|key``: a fixed random order of the rows for each feature."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), feature, *[column(k).cast("string") for k in key]))


def random_fills(clean: DataFrame, rows: Sequence[Row], key: Sequence[str], seed: int) -> DataFrame:
    """``(key, feature, text)``: a drawn value, as text, for every missing cell.

    Per feature, the missing cells and the observed values are numbered in hash order and matched by
    number. Only as many observed values as there are holes are wanted, so a hash threshold keeps
    most of them out of the shuffle.
    """
    key = list(key)

    shares = {}
    for r in rows:
        holes, observed = r["n_missing"], r["n_rows"] - r["n_missing"]
        shares[r["feature"]] = (holes + 10 * math.sqrt(holes) + 10) / observed
    orders = {r["feature"]: draw_order(seed, F.lit(r["feature"]), key) for r in rows}
    early = {f: orders[f] < f"{int(share * 2**48):012x}" for f, share in shares.items() if share < 1}
    if early:
        got = clean.agg(*[F.count_if(column(f).isNotNull() & c).alias(f"c{i}")
                          for i, (f, c) in enumerate(early.items())]).first()
        enough = {f: got[f"c{i}"] for i, f in enumerate(early)}
        early = {r["feature"]: early[r["feature"]] for r in rows if enough.get(r["feature"], -1) >= r["n_missing"]}

    slots = []
    for r in rows:
        f = r["feature"]
        present = column(f).isNotNull()
        cell = F.struct(
            F.lit(f).alias("feature"),
            F.when(present, "observed").otherwise("hole").alias("part"),
            orders[f].alias("h"),
            text_of(f).alias("text"),
        )
        slots.append(F.when(~present | early[f], cell) if f in early else cell)
    spread = (
        clean.select(*map(column, key), F.explode(F.array(*slots)).alias("s"))
        .filter("s IS NOT NULL").select(*map(column, key), "s.*", F.lit(1).cast("bigint").alias("one"))
    )
    numbered = running_totals(spread, ["feature", "part"], ["h"], ["one"], at_most=max(r["n_rows"] for r in rows))
    # A hole and the observed value of the same number form a group of two.
    hole, seen = F.col("part") == "hole", F.col("part") == "observed"
    met = numbered.groupBy("feature", "one_before").agg(
        F.max(hole).alias("wanted"),
        *[F.first(F.when(hole, column(k)), ignorenulls=True).alias(k) for k in key],
        F.first(F.when(seen, F.col("text")), ignorenulls=True).alias("text"),
    )
    return met.filter("wanted").select(*map(column, key), "feature", "text")


def _draw(clean: DataFrame, rows: list[Row], key: list[str], seed: int) -> DataFrame:
    if not rows:
        return clean
    if not key:
        raise ValueError("random imputation needs the row key")
    fills = random_fills(clean, rows, key, seed)
    per_row = fills.groupBy(*map(column, key)).agg(*[
        F.max(F.when(F.col("feature") == r["feature"], F.col("text"))).alias(f"_f{i}") for i, r in enumerate(rows)
    ])
    at = {r["feature"]: i for i, r in enumerate(rows)}
    holes = None
    for r in rows:
        hole = column(r["feature"]).isNull()
        holes = hole if holes is None else holes | hole

    def projected(filled: bool):
        out = []
        for name in clean.columns:
            if name not in at:
                out.append(column(name))
                continue
            kind = clean.schema[name].dataType
            kind = kind if is_continuous(kind) else T.StringType()
            c = column(name).cast(kind)
            out.append((F.coalesce(c, F.col(f"_f{at[name]}").cast(kind)) if filled else c).alias(name))
        return out

    # Rows without holes skip the join.
    whole = clean.filter(~holes).select(*projected(False))
    mended = clean.filter(holes).join(per_row, key, "left").select(*projected(True))
    return whole.unionByName(mended)
