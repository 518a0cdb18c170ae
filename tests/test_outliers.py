import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PROBE_NAMES
from gleanframe.functions.student import grubbs_critical
from gleanframe.operators import forest, grubbs
from gleanframe.operators.forest import _step_function, average_path, forest_depths, grow_forest
from gleanframe.operators.outliers import (
    fit_rules, flag_outliers, method_name, outlier_verdicts, with_verdicts,
)
from gleanframe.operators.profile import profile, summarise
from gleanframe.operators.quantiles import exact_quantiles
from gleanframe.operators import running
from gleanframe.operators.running import hot_lookup, running_totals

FAR = {("sonar_depth_cm", 4), ("sonar_depth_cm", 9), ("sonar_depth_mm", 4), ("sonar_depth_mm", 9), ("salinity", 6)}
PROBE_FLAGS = {
    "zscore": {("sonar_depth_mm", 4)},
    "modified_z": FAR,
    "iqr": FAR,
    "grubbs": FAR,
    "none": set(),
}


@pytest.mark.parametrize("method", PROBE_FLAGS)
def test_probe_cells(probe, probe_profile, method):
    cells = flag_outliers(probe, probe_profile, ["row"], method).collect()
    assert {(r["feature"], r["row"]) for r in cells} == PROBE_FLAGS[method]


def test_probe_verdicts(probe, probe_profile):
    v = {r["feature"]: r for r in outlier_verdicts(probe, probe_profile, "modified_z").collect()}
    assert v["sonar_depth_cm"]["outlier_verdict"] == "yes" and v["berths"]["outlier_verdict"] == "no"
    for f in ("unused", "pier", "log_entry"):
        assert v[f]["outlier_verdict"] == "not-applicable"
    filled = with_verdicts(probe_profile, outlier_verdicts(probe, probe_profile, "modified_z"))
    s = summarise(filled).first()
    assert (s["n_outliers"], s["pct_outliers"]) == (5, 3.47)


def test_mad_rule(spark):
    x = np.array([1.0, 2, 3, 4, 50])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, x double")
    mad = np.median(np.abs(x - np.median(x)))
    want = set(np.flatnonzero(np.abs(x - mad) > 3 * mad))
    got = {r["k"] for r in flag_outliers(df, profile(df, columns=["x"]), ["k"], "mad").collect()}
    assert got == want


def test_binary_guard_and_zero_deviation(spark):
    df = spark.createDataFrame([(i, int(i == 0), 7.0) for i in range(100)], "k int, b int, c double")
    p = profile(df, columns=["b", "c"])
    for m in ("zscore", "modified_z", "iqr", "grubbs"):
        assert {r["outlier_verdict"] for r in outlier_verdicts(df, p, m).collect()} == {"no"}


def test_infinities_do_not_flag_everything(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(20, math.inf)], "k int, x double")
    p = profile(df, columns=["x"])
    assert flag_outliers(df, p, ["k"], "zscore").count() == 0
    assert [r["k"] for r in flag_outliers(df, p, ["k"], "iqr").collect()] == [20]


def test_zscore_survives_shift_and_scale(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(500) ** 3
    df = spark.createDataFrame([(i, float(v), float(8 * v + 5)) for i, v in enumerate(x)], "k int, a double, b double")
    cells = flag_outliers(df, profile(df, columns=["a", "b"]), ["k"], "zscore").collect()
    a, b = ({r["k"] for r in cells if r["feature"] == f} for f in "ab")
    assert a == b and a


def test_method_names():
    assert method_name(4) == "grubbs" and method_name(5) == "none" and method_name(None) == "zscore"
    with pytest.raises(ValueError):
        method_name("lof")


def brute_grubbs(x, sign):
    """Remove one extreme at a time, literally."""
    left, removed = list(sign * np.asarray(x, float)), []
    while len(left) > 2:
        v = np.asarray(left)
        dev = v.std(ddof=1)
        if dev == 0 or not (v.max() - v.mean()) / dev > grubbs_critical(len(v)):
            break
        removed.append(sign * v.max())
        left.remove(v.max())
    return sorted(removed)


@pytest.mark.parametrize("whole_side", [1_000_000, 10])
def test_grubbs_equals_one_by_one_removal(spark, whole_side):
    rng = np.random.default_rng(11)
    data = {
        "heavy": np.round(rng.standard_cauchy(300), 1),
        "tied": np.concatenate([np.round(rng.normal(0, 1, 280), 2), np.repeat(40.0, 12), np.repeat(-9.0, 8)]),
        "calm": rng.uniform(0, 1, 300),
        "mass": np.concatenate([np.repeat(1.0, 290), np.arange(2.0, 12.0)]),
    }
    cols = list(data)
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in cols) for i in range(300)],
                               ", ".join(f"{c} double" for c in cols))
    cuts = grubbs.grubbs_cuts(df, {c: (F.col(c), 300) for c in cols}, whole_side=whole_side)
    for c in cols:
        low, high = cuts[c]
        above = sorted(v for v in data[c] if high is not None and v > high)
        below = sorted(v for v in data[c] if low is not None and v < low)
        assert above == brute_grubbs(data[c], 1), c
        assert below == brute_grubbs(data[c], -1), c


def test_grubbs_critical_values():
    for n, g in ((10, 2.17607), (7, 1.93813), (5, 1.67139)):
        assert abs(grubbs_critical(n) - g) < 1e-5
    near = [grubbs_critical(n) for n in (1_000_001, 1_000_002, 1_000_003)]
    assert near == sorted(near) and near[-1] - near[0] < 1e-6


@pytest.mark.parametrize("accuracy,limit", [(10_000, 200_000), (40, 10), (1000, 50)])
def test_exact_quantiles(spark, accuracy, limit):
    rng = np.random.default_rng(5)
    data = {
        "smooth": rng.normal(0, 1, 4000),
        "hot": np.where(rng.random(4000) < 0.4, 3.0, rng.integers(0, 500, 4000)).astype(float),
        "wide": rng.lognormal(0, 5, 4000),
    }
    cols = list(data)
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in cols) for i in range(4000)],
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in cols}, probs, accuracy, limit)
    for c in cols:
        assert np.allclose(got[c], np.quantile(data[c], probs), rtol=1e-12, atol=0), c


@pytest.mark.parametrize("slice_rows", [1 << 20, 50, 7])
def test_running_totals_over_a_hot_group(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(running, "SLICE_ROWS", slice_rows)
    text = [(f"{v * 7919 % 997:04d}é", v) for v in range(400)]
    words = spark.createDataFrame([("a", *t) for t in text], "g string, v string, n long").repartition(3)
    got = {r["v"]: r["n_before"] for r in running_totals(words, ["g"], ["v"], ["n"]).collect()}
    assert got == {w: sum(n for x, n in text if x < w) for w, _ in text}
    rows = [(g, float(v), int(v) % 7 + 1) for g in ("a", "b", "c") for v in range(900 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(7)
    got = {(r["g"], r["v"]): r["n_before"] for r in running_totals(df, ["g"], ["v"], ["n"]).collect()}
    seen: dict = {}
    for g, v, n in sorted(rows):
        assert got[(g, v)] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + n
    assert len(got) == len(rows)


def test_hot_lookup(spark):
    rows = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("v"), "id")
    table = rows.groupBy("g", "v").agg(F.count("*").alias("n")).withColumn("out", F.col("v") * 2)
    got = hot_lookup(rows, table, ["g", "v"], "n", ["g"])
    assert got.count() == 3000 and got.filter("out <> 2 * v").count() == 0


def test_tree_isolates_the_outlier():
    rng = np.random.default_rng(0)
    x = np.append(rng.normal(0, 1, 255), 50.0)[:, None]
    nodes = grow_forest(x, range(20), [0])
    depth = forest_depths(nodes, x)
    assert depth.argmin() == 255
    assert abs(average_path(256) - 10.244770920) < 1e-6
    cuts, depths = _step_function(nodes)
    assert np.allclose(depths[np.searchsorted(cuts, x[:, 0], side="left")], depth)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), "xyz"[i % 3], None if i % 2 else 1.0)
            for i, (a, b) in enumerate(rng.normal(0, 1, (1000, 2)))]
    rows[17] = (17, 60.0, -60.0, "x", None)
    return spark.createDataFrame(rows, "k int, a double, b double, t string, holes double").repartition(4)


@pytest.mark.parametrize("method", ["forest_joint", "forest_each"])
def test_forest(cloud, method):
    p = profile(cloud, columns=["a", "b", "t", "holes"])
    cells = flag_outliers(cloud, p, ["k"], method, seed=1).collect()
    assert {(r["feature"], r["k"]) for r in cells} >= {("a", 17), ("b", 17)}
    assert "holes" not in {r["feature"] for r in cells}
    stored = {r["k"]: r for r in cloud.collect()}
    assert all(r["value"] == str(stored[r["k"]][r["feature"]]) for r in cells)
    rows = {r["k"] for r in cells}
    if method == "forest_joint":
        assert len(rows) <= 20 and len(cells) == 3 * len(rows)
    else:
        assert all(sum(r["feature"] == f for r in cells) <= 10 for f in ("a", "b", "t"))
    again = flag_outliers(cloud.repartition(3), p, ["k"], method, seed=1).collect()
    assert {(r["feature"], r["k"]) for r in again} == {(r["feature"], r["k"]) for r in cells}


def test_forest_without_good_columns(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, a double")
    assert flag_outliers(df, profile(df, columns=["a"]), ["k"], "forest_joint").count() == 0


def test_codes_of_large_text_columns(spark, monkeypatch):
    """Looked up all at once: the same codes as by broadcast, and as many scans for three columns as for one."""
    rng = np.random.default_rng(6)
    rows = [(k, f"a{rng.integers(0, 40)}", f"b{rng.integers(0, 7)}", f"é{rng.integers(0, 300)}", float(k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, x double").repartition(3)
    facts = {r["feature"]: r for r in profile(df, columns=["a", "b", "c", "x"]).collect()}
    scans = []
    for names in (["a"], ["a", "b", "c"]):
        wanted = [facts[n] for n in [*names, "x"]]
        codes = forest.text_codes(df, names)
        columns = ["k", *[f"x{i}" for i in range(len(wanted))]]
        small = {tuple(r) for r in forest.numeric_columns(df, wanted, codes).select(*columns).collect()}
        monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
        large = forest.numeric_columns(df, wanted, codes).select(*columns)
        assert {tuple(r) for r in large.collect()} == small and len(small) == 400
        scans.append(large._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        monkeypatch.undo()
    assert scans[0] == scans[1]
    order = {v: i for i, v in enumerate(sorted({r[1] for r in rows}))}
    assert {(r[0], r[1]) for r in small} == {(r[0], float(order[r[1]])) for r in rows}
