"""Iterated one-sided Grubbs tests as a distributed scan over distinct values.

The test removes the extreme value while G = (extreme - mean) / deviation exceeds a critical value.
Only extremes of one side leave, so after any number of removals the sample is {x <= v} for some v,
and its size, mean and deviation are running totals in the order of v. Copies of one value go
together: taking a copy away raises G for the next copy and lowers the critical value. So it is
enough to test each distinct value once, on the sample that still holds all its copies; the side is
cut at the largest value that fails.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.functions.student import grubbs_critical
from gleanframe.operators.running import running_totals

# A side with at most this many values is scanned whole; a larger one starts from its tail.
WHOLE_SIDE = 1_000_000
# Tails to try in turn: values beyond mean + share * critical G * deviation; None is everything.
TAIL_SHARES = (0.75, 0.5, 0.25, None)


def grubbs_cuts(
    df: DataFrame, columns: Mapping[str, tuple[Column, int]], alpha: float = 0.05,
    whole_side: int = WHOLE_SIDE,
) -> dict[str, tuple[float | None, float | None]]:
    """``{feature: (low, high)}``: values below ``low`` or above ``high`` are outliers; None = none.

    ``columns`` gives each feature's expression and its number of non-missing values.
    """
    names = list(columns)
    if not names:
        return {}
    # Both sides become maximum tests: the minimum side is the maximum side of -x.
    sides = {(n, s): (columns[n][0] if s > 0 else -columns[n][0]) for n in names for s in (1, -1)}
    row = df.agg(*[f(columns[n][0]).alias(f"{k}{i}") for i, n in enumerate(names)
                   for k, f in (("m", F.avg), ("d", F.stddev_samp), ("lo", F.min), ("hi", F.max))]).first()
    moments = {}
    for i, n in enumerate(names):
        mean, dev = row[f"m{i}"], row[f"d{i}"]
        if columns[n][1] <= 2 or not dev or not np.isfinite(dev):
            continue
        for s, top in ((1, row[f"hi{i}"]), (-1, -row[f"lo{i}"])):
            # The first test decides whether this side needs any further work.
            if (top - s * mean) / dev > grubbs_critical(columns[n][1], alpha):
                moments[(n, s)] = (s * mean, dev)

    cuts: dict[tuple[str, int], float] = {}
    pending = list(moments)
    for share in TAIL_SHARES:
        if not pending:
            break
        starts = {}
        for n, s in pending:
            mean, dev = moments[(n, s)]
            size = columns[n][1]
            whole = share is None or size <= whole_side
            starts[(n, s)] = None if whole else mean + share * grubbs_critical(size, alpha) * dev
        found = _scan_tails(df, {k: sides[k] for k in pending}, starts, moments, alpha)
        cuts.update(found)
        # No value of this tail failed: the cut lies further in.
        pending = [k for k in pending if k not in found]

    out = {}
    for n in names:
        low, high = cuts.get((n, -1)), cuts.get((n, 1))
        out[n] = (None if low is None else -low, high)
    return out


def first_step(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``(feature, n, g_max, g_min)``: the statistics of the first test on each side."""
    names = list(columns)
    wide = df.select(*[columns[n].alias(f"x{i}") for i, n in enumerate(names)]).agg(*[
        F.struct(
            F.lit(n).alias("feature"), F.count(f"x{i}").alias("n"),
            F.try_divide(F.max(f"x{i}") - F.avg(f"x{i}"), F.stddev_samp(f"x{i}")).alias("g_max"),
            F.try_divide(F.avg(f"x{i}") - F.min(f"x{i}"), F.stddev_samp(f"x{i}")).alias("g_min"),
        ).alias(f"s{i}") for i, n in enumerate(names)
    ])
    return wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("s")).select("s.*")


def tail_samples(
    df: DataFrame, sides: Mapping[tuple, Column], starts: Mapping[tuple, float | None],
    moments: Mapping[tuple, tuple[float, float]],
) -> DataFrame:
    """``(side, v, n, g)``: for each distinct tail value v, size and G of the sample {x <= v}."""
    keys = list(sides)
    slots = []
    for i, k in enumerate(keys):
        v = sides[k]
        # Everything inside the start collapses to one group with v = NULL.
        tail = v if starts[k] is None else F.when(v > F.lit(starts[k]), v)
        d = v - F.lit(moments[k][0])
        slots.append(F.when(v.isNotNull(), F.struct(
            F.lit(i).alias("side"), tail.alias("v"), F.when(tail.isNull(), d).alias("d"))))
    grouped = (
        df.select(F.explode(F.array(*slots)).alias("s")).filter("s IS NOT NULL")
        .groupBy(F.col("s.side").alias("side"), F.col("s.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("s.d").alias("d1"),
             F.sum(F.col("s.d") * F.col("s.d")).alias("d2"))
    )
    center = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(i), F.lit(moments[k][0]))])
    d = F.col("v") - center[F.col("side")]
    values = grouped.select(
        "side",
        F.coalesce("v", F.lit(float("-inf"))).alias("v"),
        F.col("v").isNull().alias("inner"),
        "n",
        F.coalesce(F.col("n") * d, F.col("d1")).alias("s1"),
        F.coalesce(F.col("n") * d * d, F.col("d2")).alias("s2"),
    )
    totals = running_totals(values, ["side"], ["v"], ["n", "s1", "s2"])
    n = F.col("n") + F.col("n_before")
    mean = (F.col("s1") + F.col("s1_before")) / n
    variance = ((F.col("s2") + F.col("s2_before")) - n * mean * mean) / F.nullif(n - 1, F.lit(0))
    g = F.try_divide(F.col("v") - center[F.col("side")] - mean, F.sqrt(F.greatest(variance, F.lit(0.0))))
    return totals.select("side", "v", "inner", n.alias("n"), g.alias("g"))


def _scan_tails(df, sides, starts, moments, alpha) -> dict[tuple, float]:
    keys = list(sides)
    samples = tail_samples(df, sides, starts, moments).filter("NOT inner")

    def failing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The last failing value per side of each batch; rows come in ascending order of v."""
        for pdf in batches:
            rows = []
            for side, part in pdf.groupby("side"):
                v, n = part["v"].to_numpy(), part["n"].to_numpy()
                i = _last_failing(n, part["g"].to_numpy(float, na_value=0.0), alpha)
                if i is not None:
                    rows.append((int(side), float(v[i])))
            yield pd.DataFrame(rows, columns=["side", "v"]).astype({"side": "int32", "v": "float64"})

    cut = samples.select("side", "v", "n", "g").mapInPandas(failing, "side int, v double")
    return {keys[r["side"]]: r["v"] for r in cut.groupBy("side").agg(F.max("v").alias("v")).collect()}


def _last_failing(n: np.ndarray, g: np.ndarray, alpha: float) -> int | None:
    """Index of the last score that does not exceed its critical value; sizes are ascending.

    The critical value grows with n, so the one of a stretch's largest sample settles most of the
    stretch at once.
    """
    end, stretch = len(n), 16
    while end > 0:
        start = max(0, end - stretch)
        top = grubbs_critical(int(n[end - 1]), alpha)
        for i in np.flatnonzero(~(g[start:end] > top))[::-1] + start:
            if not g[i] > grubbs_critical(int(n[i]), alpha):
                return int(i)
        end, stretch = start, stretch * 4
    return None
