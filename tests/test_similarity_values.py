from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import oracles
from conftest import PROBE_NAMES
from gleanframe.operators import correlation, kendall, moments
from gleanframe.operators.correlation import correlated_pairs, pair_values
from gleanframe.operators.moments import pair_moments

PROBE = {
    "spearman": {("sonar_depth_mm", "sonar_depth_cm"): 0.993007},
    "pearson": {("sonar_depth_mm", "sonar_depth_cm"): 0.999355},
    "kendall": {("sonar_depth_mm", "sonar_depth_cm"): 0.969697},
    "covariance": {("sonar_depth_mm", "sonar_depth_cm"): 647.644886, ("salinity", "sonar_depth_cm"): -48.769444,
                   ("salinity", "sonar_depth_mm"): -45.893056},
    "none": {},
}
UNREPORTED = {"spearman": (-0.10303, -0.139394), "pearson": (-0.196268, -0.191437), "kendall": (0.022222, -0.022222)}


@pytest.mark.parametrize("method", PROBE)
def test_probe_pairs(probe, method):
    got = {(r["f1"], r["f2"]): round(r["value"], 6) for r in correlated_pairs(probe, method, PROBE_NAMES).collect()}
    assert got == PROBE[method]
    if method in UNREPORTED:
        values = pair_values(probe, method, PROBE_NAMES)
        assert "berths" not in {n for p in values for n in p}
        for f, v in zip(("sonar_depth_cm", "sonar_depth_mm"), UNREPORTED[method]):
            assert abs(values[(f, "salinity")] - v) < 1e-6


def ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def brute(method, a, b):
    ok = ~np.isnan(a) & ~np.isnan(b)
    a, b = a[ok], b[ok]
    if method == "covariance":
        return np.cov(a, b)[0, 1]
    if a.min() == a.max() or b.min() == b.max():
        return 0.0
    if method == "pearson":
        return np.corrcoef(a, b)[0, 1]
    if method == "spearman":
        return np.corrcoef(ranks(a), ranks(b))[0, 1]
    sa, sb = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
    return (sa * sb).sum() / np.sqrt((sa**2).sum() * (sb**2).sum())


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(21)
    n = 180
    a = np.round(rng.normal(0, 1, n), 1)
    data = {
        "a": a,
        "b": a + np.round(rng.normal(0, 0.2, n), 1),
        "hot": np.where(rng.random(n) < 0.5, 3.0, np.round(rng.normal(0, 5, n), 2)),
        "gap1": np.where(rng.random(n) < 0.3, np.nan, a * 2),
        "gap2": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 4, n)),
        "big": 1e9 + np.round(rng.normal(0, 1, n), 2),
        "flat": np.full(n, 2.0),
        # Constant wherever gap1 is present.
        "split": np.nan_to_num(np.zeros(n)),
    }
    data["split"] = np.where(np.isnan(data["gap1"]), 1.0, 7.0)
    cols = list(data)
    rows = [(i, *[None if np.isnan(data[c][i]) else float(data[c][i]) for c in cols]) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    return df, data


@pytest.mark.parametrize("method,limit", [
    ("pearson", None), ("covariance", None), ("kendall", None), ("spearman", 50_000), ("spearman", 5), ("spearman", 0),
])
def test_values_equal_brute_force(mixed, method, limit, monkeypatch):
    df, data = mixed
    if limit is not None:
        monkeypatch.setattr(correlation, "BROADCAST_RANKS", limit)
    cols = list(data)
    got = pair_values(df, method, cols, key=["k"] if limit == 0 else None)
    for p in combinations([c for c in cols if c != "flat"], 2):
        want = brute(method, data[p[0]], data[p[1]])
        assert abs(got[p] - want) < 1e-9 * max(1, abs(want)), (p, got[p], want)
    assert not any("flat" in p for p in got)


def test_quadrant_bound_is_never_too_low():
    rng = np.random.default_rng(6)
    pruned = 0
    for trial in range(3000):
        n = int(rng.integers(2, 60))
        a = rng.integers(0, rng.integers(2, 40), n).astype(float)
        b = a + rng.normal(0, rng.choice([0.1, 2, 30]), n) if trial % 2 else rng.integers(0, rng.integers(2, 40), n)
        b = np.round(b)
        if a.min() == a.max() or b.min() == b.max():
            continue
        sa, sb = rng.choice(a), rng.choice(b)
        bound = correlation.quadrant_bound(n, (a > sa).sum(), (b > sb).sum(), ((a > sa) & (b > sb)).sum())
        assert brute("spearman", a, b) <= bound + 1e-9
        pruned += bound < 0.9
    assert pruned > 300


def test_pruned_report_equals_full_report(mixed):
    df, data = mixed
    for columns in (list(data), ["a", "b", "gap1", "hot"]):
        full = {(q, p): v for (p, q), v in pair_values(df, "spearman", columns).items() if v >= 0.9}
        got = {(r["f1"], r["f2"]): r["value"] for r in correlated_pairs(df, "spearman", columns).collect()}
        assert got.keys() == full.keys() and full
        assert all(abs(got[p] - full[p]) < 1e-12 for p in full)


def test_products_equal_aggregates(mixed):
    df, data = mixed
    cols = [c for c in data if c != "flat"]
    spec = {c: (F.col(c), 0.5, True) for c in cols}
    pairs = list(combinations(cols, 2))
    one, two = pair_moments(df, spec, pairs), pair_moments(df, spec, pairs, max_aggregates=0)
    for p in pairs:
        assert np.allclose([getattr(one[p], f) for f in ("n", "a", "b", "aa", "bb", "ab")],
                           [getattr(two[p], f) for f in ("n", "a", "b", "aa", "bb", "ab")], rtol=1e-12)


def test_half_missing_is_gated(spark):
    df = spark.createDataFrame([(float(i), float(i) if i % 2 else None) for i in range(10)], "a double, b double")
    assert correlated_pairs(df, "pearson").count() == 0
    assert correlated_pairs(df.filter("a > 0"), "pearson").count() == 1


def test_negative_pairs_and_text_numbers(spark):
    df = spark.createDataFrame([(float(i), -float(i), str(2 * i)) for i in range(20)], "a double, b double, c string")
    got = [(r["f1"], r["f2"]) for r in correlated_pairs(df, "pearson").collect()]
    assert got == [("c", "a")]
    assert correlated_pairs(df, "pearson", abs_value=True).count() == 3
    assert correlated_pairs(df, "covariance").count() == 3


def test_kendall_on_many_distinct_values(spark):
    rng = np.random.default_rng(2)
    a = rng.permutation(700).astype(float)
    b = np.where(rng.random(700) < 0.3, 0.0, a // 3)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    assert abs(pair_values(df, "kendall")[("a", "b")] - brute("kendall", a, b)) < 1e-12


def test_registered_kendall_reads_every_derived_column(spark, tmp_path):
    rng = np.random.default_rng(17)
    n = 150
    rows = [(int(k), int(k) % 997, int(line), float(q), float(p) / 100, float(d) / 100, "ANR"[int(f)]) for k, line, q, p, d, f in zip(
        rng.integers(1, 60_000, n), rng.integers(1, 8, n), rng.integers(1, 51, n), rng.integers(90_000, 10_000_000, n), rng.integers(0, 11, n), rng.integers(0, 3, n))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    df = registry.derived(spark, str(tmp_path)).select(*oracles.DERIVED_COLUMNS).toPandas()
    data = {c: np.array([np.nan if v is None or v != v else float(v) for v in df[c]]) for c in oracles.DERIVED_COLUMNS if df[c].dtype != object}
    usable = [c for c in data if np.isfinite(data[c]).mean() > 0.5]
    want = {(q, p): round(v, 6) for p, q in combinations(usable, 2) if (v := brute("kendall", data[p], data[q])) >= 0.9}
    got = {(r["f1"], r["f2"]): r["value"] for r in registry.queries()["corr_kendall_all"](spark, str(tmp_path)).collect()}
    assert ("price_net", "price") in want and {k: v for k, v in got.items() if k[0] in data and k[1] in data} == want


def test_tau_bound_is_never_too_low():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n = int(rng.integers(2, 80))
        a = rng.integers(0, rng.integers(2, 60), n).astype(float)
        b = np.round(a * rng.normal() + rng.normal(size=n) * rng.choice([0.1, 3, 30]))
        cuts = [np.unique(np.quantile(v, np.arange(1, kendall.GRID) / kendall.GRID)) for v in (a, b)]
        code = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, (a, b))]
        grid = np.zeros((1, kendall.GRID, kendall.GRID))
        np.add.at(grid[0], tuple(code), 1)
        x, y = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        plain = (np.greater.outer(code[0], code[0]) & np.less.outer(code[1], code[1])).sum()
        assert kendall.discordant(grid)[0] == plain <= (x * y < 0).sum() / 2
        assert kendall.tau_bound(grid)[0] >= brute("kendall", a, b) - 1e-9


def test_pruned_kendall_keeps_what_is_reported(spark, monkeypatch):
    monkeypatch.setattr(kendall, "PAIRS_A_SCAN", 4)
    monkeypatch.setattr(kendall, "PAIRS_AT_ONCE", 2)
    rng = np.random.default_rng(12)
    x = rng.normal(size=600)
    data = {"a": x, "b": x + rng.normal(size=600) * 0.02, "c": x + rng.normal(size=600), "d": rng.normal(size=600), "e": -x, "f": np.round(x * 2)}
    rows = [[None if k in (1, 3) and i % 5 == 0 else float(v[i]) for k, v in enumerate(data.values())] for i in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in data)).repartition(5)
    columns, pairs = {n: F.col(n) for n in data}, list(combinations(data, 2))
    whole = kendall.kendall_tau(df, columns, pairs)
    pruned = kendall.kendall_tau(df, columns, pairs, 600, 0.9)
    assert {p: v for p, v in whole.items() if v >= 0.9} == {p: v for p, v in pruned.items() if v >= 0.9} and ("a", "b") in pruned
    assert len(pruned) < len(pairs) / 2


def test_concordance():
    rng = np.random.default_rng(13)
    for _ in range(60):
        k = int(rng.integers(1, 60))
        x, y = rng.integers(0, rng.integers(1, 40), k).astype(float), rng.integers(0, rng.integers(1, 40), k).astype(float)
        n = rng.integers(1, rng.choice([2, 1 << 40]), k)
        want = sum(int(n[i]) * int(n[j]) * int(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(k) for j in range(i))
        assert kendall.concordance(x, y, n) == want


def test_slices_add_up(spark, monkeypatch):
    monkeypatch.setattr(kendall, "SLICE_CELLS", 20)
    rng = np.random.default_rng(14)
    a = np.where(rng.random(700) < 0.4, 5.0, np.round(rng.normal(size=700) * 30))
    data = {"a": a, "b": np.round(a + rng.normal(size=700) * 9), "c": rng.normal(size=700)}
    df = spark.createDataFrame(np.column_stack(list(data.values())).tolist(), "a double, b double, c double").repartition(3)
    got = kendall.kendall_tau(df, {n: F.col(n) for n in data}, list(combinations(data, 2)))
    assert all(abs(v - brute("kendall", data[p], data[q])) < 1e-12 for (p, q), v in got.items()) and len(got) == 3


@pytest.mark.parametrize("block,tile_bytes", [(500, 64 << 20), (3, 64 << 20), (2, 1)])
def test_blocks_give_every_pair_once(mixed, monkeypatch, block, tile_bytes):
    monkeypatch.setattr(moments, "BLOCK", block)
    monkeypatch.setattr(moments, "TILE_BYTES", tile_bytes)
    df, data = mixed
    spec = {c: (F.col(c), 0.5, True) for c in data if c != "flat"}
    pairs = list(combinations(spec, 2))
    want = pair_moments(df, spec, pairs)
    for p, m in pair_moments(df, spec, [(q, p) for p, q in pairs], max_aggregates=0).items():
        one = want[p[::-1]]
        assert np.allclose([m.n, m.a, m.b, m.aa, m.bb, m.ab], [one.n, one.b, one.a, one.bb, one.aa, one.ab], rtol=1e-12)
    for method, least in (("pearson", 0.3), ("covariance", 0.2)):
        value = {p: m.correlation() if method == "pearson" else m.covariance() for p, m in want.items()}
        strong = moments.strong_pairs(df, spec, method, least)
        # What is undefined or rounds up may come along.
        assert {p for p in strong if abs(value[p]) >= least} == {p for p, v in value.items() if abs(v) >= least} and 0 < len(strong) < len(pairs)


def test_wide_tables_bring_reported_pairs_only(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 40)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(60, 150))
    x[:, 149] = 3 * x[:, 0] + rng.normal(size=60) * 0.01
    x[:, 77] = -x[:, 12]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(150))).repartition(3)
    values = pair_values(df, "pearson", at_least=0.9)
    assert set(values) == {("c0", "c149"), ("c12", "c77")}
    got = [(r["f1"], r["f2"]) for r in correlated_pairs(df, "pearson").collect()]
    assert got == [("c149", "c0")]
    assert [(r["f1"], r["f2"]) for r in correlated_pairs(df, "pearson", abs_value=True).collect()] == [("c77", "c12"), ("c149", "c0")]


def test_grid_concordance():
    rng = np.random.default_rng(23)
    for most in (2, 1 << 33):
        g = rng.integers(0, most, (4, 5))
        cells = [(i, j) for i in range(4) for j in range(5)]
        want = sum(int(g[a]) * int(g[b]) * int(np.sign((a[0] - b[0]) * (a[1] - b[1]))) for a, b in combinations(cells, 2))
        assert kendall.grid_concordance(g) == want


def test_sliced_kendall_forms_no_wide_rows(spark, monkeypatch):
    """Cells of different slices are neither expanded nor put into generated expressions whose size grows with the slices."""
    monkeypatch.setattr(kendall, "SLICE_CELLS", 10)
    rng = np.random.default_rng(24)
    x = np.where(rng.random(400) < 0.3, 2.0, rng.normal(size=400))
    y = np.where(rng.random(400) < 0.3, -1.0, x + rng.normal(size=400))
    cells = spark.createDataFrame([(0, float(a), float(b), 1) for a, b in zip(x, y)], "p int, x double, y double, n long")
    parts = kendall._sliced(cells, 400)
    assert sum(r["s"] for part in parts for r in part.collect()) == int((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum()) // 2
    plans = "".join(part._jdf.queryExecution().optimizedPlan().toString() for part in parts)
    assert "Window" not in plans and "CASE" not in plans


def test_few_ranked_pairs_are_not_joined_by_row(spark, mixed, monkeypatch):
    df, data = mixed
    monkeypatch.setattr(correlation, "PAIRS_AT_ONCE", 1)
    seen = []
    monkeypatch.setattr(correlation, "pair_moments", lambda *a, **k: seen.append(a) or pair_moments(*a, **k))
    for pair in (("a", "b"), ("hot", "gap1"), ("gap1", "gap2"), ("gap1", "split"), ("a", "big")):
        assert abs(pair_values(df, "spearman", list(pair)).get(pair, 0.0) - brute("spearman", *[data[c] for c in pair])) < 1e-9
    assert not seen  # the wide way adds up moments of the rows
