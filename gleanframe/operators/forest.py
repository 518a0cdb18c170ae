"""Isolation forest outliers (Liu, Ting, Zhou 2008), trained on a small sample and scored in place.

Training: at most trees x 256 rows, taken by hash order of the row key, so the sample does not depend
on the layout of the data. Trees grow in parallel, one small group per tree. The forest has a fixed
maximum size and travels to the tasks with the scoring function. Scores are written once; the
contamination threshold is an exact quantile of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, normalise_missing
from gleanframe.operators.features import NUMERIC, emit_cells, load, number_of, text_of
from gleanframe.operators.materialise import materialise, spread_out, staged
from gleanframe.operators.profile import distinct_values
from gleanframe.operators.quantiles import exact_quantiles
from gleanframe.operators.running import hot_lookup, running_totals

TREES = 100
SAMPLE_PER_TREE = 256
JOINT_CONTAMINATION = 0.02
EACH_CONTAMINATION = 0.01
# Text columns whose distinct values have at most this many bytes get their codes by broadcast.
BROADCAST_BYTES = 16 << 20


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes ``(node, split_on, split_at, left, right, path)``; leaves have split_on = -1."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple[int, int, float, int, int, float]] = []
    todo = [(0, x, 0)]
    free = 1
    while todo:
        node, points, depth = todo.pop()
        low, high = points.min(axis=0), points.max(axis=0)
        splittable = np.flatnonzero(low < high)
        if depth >= limit or len(splittable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(points))))
            continue
        on = int(rng.choice(splittable))
        at = float(rng.uniform(low[on], high[on]))
        goes_left = points[:, on] <= at
        left, right = free, free + 1
        free += 2
        nodes.append((node, on, at, left, right, 0.0))
        todo += [(left, points[goes_left], depth + 1), (right, points[~goes_left], depth + 1)]
    return nodes


def forest_depths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean path length of every row of x over the trees; ``nodes`` is (tree, node, field)."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree in nodes:
        at = np.zeros(len(x), np.int64)
        while True:
            on = tree[at, 0].astype(np.int64)
            inner = on >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(on, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return total / len(nodes)


def grow_forest(x: np.ndarray, trees: Sequence[int], seed: Sequence[int]) -> np.ndarray:
    """The given trees as one (tree, node, field) array; tree t depends on (seed, t) only."""
    grown = []
    for t in trees:
        rng = np.random.default_rng([*seed, t])
        grown.append(grow_tree(x[rng.choice(len(x), size=min(SAMPLE_PER_TREE, len(x)), replace=False)], rng))
    out = np.zeros((len(grown), max(n[0] for tree in grown for n in tree) + 1, 5))
    out[:, :, 0] = -1
    for i, tree in enumerate(grown):
        for n in tree:
            out[i, n[0]] = n[1:]
    return out


def _step_function(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A one-column forest as sorted split points and the mean path length between them."""
    cuts = np.unique(nodes[:, :, 1][nodes[:, :, 0] >= 0])
    # One probe per interval (.., c0], (c0, c1], .., (ck, ..): the right ends, then beyond the last.
    probes = np.append(cuts, np.inf)
    return cuts, forest_depths(nodes, probes[:, None])


def training_sample(df: DataFrame, key: Sequence[str], n_rows: int, seed: int, size: int) -> DataFrame:
    """The ``size`` rows that come first in hash order of (seed, key).

    A hash threshold passes only a little more than ``size`` rows on to the sort.
    """
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), *[column(k).cast("string") for k in key]))
    hashed = df.withColumn("_hash", tag)
    wanted = min(size, n_rows)
    share = (wanted + 10 * math.sqrt(wanted) + 10) / max(n_rows, 1)
    while share < 1.0:
        candidates = hashed.filter(F.col("_hash") < f"{int(share * 2**48):012x}")
        if candidates.count() >= wanted:
            return candidates.orderBy("_hash").limit(size)
        share *= 2
    return hashed.orderBy("_hash").limit(size)


def text_codes(df: DataFrame, features: Sequence[str]) -> DataFrame | None:
    """``(feature, value, n, code)``: the position of each text value among the sorted values."""
    if not features:
        return None
    values = distinct_values(df, features).withColumn("one", F.lit(1).cast("bigint"))
    return staged(running_totals(values, ["feature"], ["value"], ["one"]).select(
        "feature", "value", "n", F.col("one_before").cast("double").alias("code")))


def numeric_columns(df: DataFrame, rows: Sequence[Row], codes: DataFrame | None) -> DataFrame:
    """Columns ``x0, x1, ..`` for the given features: numbers as they are, text by its code.

    Small domains are looked up by broadcast. All large ones together are one table of (row, feature, value), looked up once and
    turned back, so the table is read as often for one such column as for many.
    """
    name = {r["feature"]: f"x{i}" for i, r in enumerate(rows)}
    # One row per text feature.
    sizes = {} if codes is None else {r["feature"]: r["size"] for r in codes.groupBy("feature").agg(
        F.sum(F.octet_length("value") + 16).alias("size")).collect()}
    out = df.select("*", *[number_of(r).alias(name[r["feature"]]) for r in rows if r["var_type"] in NUMERIC])
    large = [f for f, size in sorted(sizes.items()) if size > BROADCAST_BYTES]
    for r in rows:
        if r["var_type"] in NUMERIC or r["feature"] in large:
            continue
        x, v = name[r["feature"]], f"_v{name[r['feature']]}"
        own = codes.filter(F.col("feature") == r["feature"]).select(F.col("value").alias(v), F.col("code").alias(x), "n")
        out = out.withColumn(v, text_of(r["feature"])).join(F.broadcast(own.drop("n")), v).drop(v)
    if not large:
        return out
    out = staged(out.withColumn("_row", F.monotonically_increasing_id()))
    cells = out.select("_row", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), text_of(f).alias("value")) for f in large])).alias("c"))
    found = hot_lookup(cells.select("_row", "c.*"), codes.filter(F.col("feature").isin(large)), ["feature", "value"], "n", ["feature"], n_groups=len(large))
    wide = found.groupBy("_row").agg(*[F.max(F.when(F.col("feature") == f, F.col("code"))).alias(name[f]) for f in large])
    return out.join(wide, "_row").drop("_row")


def _in_parallel(spark, count: int, work, schema: str) -> pa.Table:
    """``work(i)`` for i in range(count), one small task each; the results are small and come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield work(int(i))

    slices = min(count, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, count, 1, slices).mapInPandas(run, schema).toArrow()


def grow_joint(spark, x: np.ndarray, seed: int) -> np.ndarray:
    """``TREES`` trees over all columns, grown tree by tree in parallel."""
    shared = spark.sparkContext.broadcast(x)

    def one(t: int) -> pd.DataFrame:
        nodes = grow_forest(shared.value, [t], [seed, 0])[0]
        return pd.DataFrame({"tree": [t], "width": [len(nodes)], "nodes": [nodes.ravel()]})

    got = _in_parallel(spark, TREES, one, "tree int, width int, nodes array<double>").to_pylist()
    shared.unpersist()
    out = np.zeros((TREES, max(r["width"] for r in got), 5))
    out[:, :, 0] = -1
    for r in got:
        out[r["tree"], : r["width"]] = np.reshape(r["nodes"], (r["width"], 5))
    return out


def grow_each(spark, x: np.ndarray, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A forest per column, each reduced to a step function of the value."""
    shared = spark.sparkContext.broadcast(x)

    def one(i: int) -> pd.DataFrame:
        cuts, depths = _step_function(grow_forest(shared.value[:, i : i + 1], range(TREES), [seed, i]))
        return pd.DataFrame({"i": [i], "cuts": [cuts], "depths": [depths]})

    got = _in_parallel(spark, x.shape[1], one, "i int, cuts array<double>, depths array<double>").to_pylist()
    shared.unpersist()
    return {r["i"]: (np.asarray(r["cuts"], float), np.asarray(r["depths"], float)) for r in got}


def forest_scores(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str], method: str, seed: int = 0,
    tokens: Sequence[str] = DEFAULT_TOKENS, numeric_only: bool = False,
) -> tuple[DataFrame, list[str], list[str]]:
    """``(key, x0.., s0..)`` materialised, with the feature names and the score columns.

    ``forest_joint`` has one score column for all good features, ``forest_each`` one per feature.
    """
    good = [r for r in load(profile_df) if r["state"] == "good" and r["n_rows"] > 0]
    clean = normalise_missing(df, tokens)
    if numeric_only:
        good = [r for r in good if r["var_type"] in NUMERIC]
    if not good:
        return df.select(*map(column, key)).filter(F.lit(False)), [], []
    features = [r["feature"] for r in good]
    xs = [f"x{i}" for i in range(len(features))]
    codes = text_codes(clean, [r["feature"] for r in good if r["var_type"] not in NUMERIC])
    # The cell's own text goes along; x is what the trees see.
    texts = [text_of(f).alias(f"t{i}") for i, f in enumerate(features)]
    table = numeric_columns(clean, good, codes).select(*map(column, key), *texts, *xs)
    n_rows = good[0]["n_rows"]
    size = TREES * SAMPLE_PER_TREE
    sample = numeric_columns(training_sample(clean, key, n_rows, seed, size), good, codes).orderBy("_hash").select(*xs).toArrow()
    x = np.column_stack([sample.column(c).to_numpy().astype(float) for c in xs])
    spark = df.sparkSession
    joint = grow_joint(spark, x, seed) if method == "forest_joint" else None
    steps = {} if method == "forest_joint" else grow_each(spark, x, seed)
    norm = average_path(min(SAMPLE_PER_TREE, n_rows)) or 1.0
    scores = ["s0"] if method == "forest_joint" else [f"s{i}" for i in range(len(xs))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if joint is not None:
                depth = forest_depths(joint, pdf[xs].to_numpy(float))
                pdf = pdf.assign(s0=np.power(2.0, -depth / norm))
            else:
                new = {}
                for g, (cuts, depths) in steps.items():
                    depth = depths[np.searchsorted(cuts, pdf[f"x{g}"].to_numpy(float), side="left")]
                    new[f"s{g}"] = np.power(2.0, -depth / norm)
                pdf = pdf.assign(**new)
            yield pdf

    schema = T.StructType(list(table.schema.fields) + [T.StructField(s, T.DoubleType()) for s in scores])
    return materialise(spread_out(table).mapInPandas(score, schema)), features, scores


def forest_cells(
    df: DataFrame, profile_df: DataFrame, key: Sequence[str], method: str, seed: int = 0,
    tokens: Sequence[str] = DEFAULT_TOKENS, numeric_only: bool = False,
) -> DataFrame:
    """Outlier cells ``(key, feature, value, status)``.

    ``forest_joint`` marks every good feature of a flagged row; ``forest_each`` the flagged cells.
    """
    scored, features, scores = forest_scores(df, profile_df, key, method, seed, tokens, numeric_only)
    if not features:
        return emit_cells(df, key, [])
    share = JOINT_CONTAMINATION if method == "forest_joint" else EACH_CONTAMINATION
    # A row is flagged when -score lies strictly below the quantile of -score.
    cuts = exact_quantiles(scored, {s: -F.col(s) for s in scores}, [share])
    hits: dict[str, Column] = {s: -F.col(s) < F.lit(cuts[s][0]) for s in scores}
    return emit_cells(scored, key, [
        (f, hits["s0" if method == "forest_joint" else f"s{i}"], F.col(f"t{i}"), F.lit("outlier"))
        for i, f in enumerate(features)
    ])
