from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PROBE_NAMES
from gleanframe.functions.numbers import parse_number, render_number, token_kind
from gleanframe.operators.profile import (
    describe_feature, feature_state, feature_values, features_by_state, incompatible_cells, named_like_date,
    profile, summarise,
)
from gleanframe.operators.report import evaluation_report

# feature: var_type, measure, missing, state, min, max, centre, incompatible
EXPECTED = {
    "sonar_depth_cm": ("float", "numeric", 0, "good", 3.5, 90.0, 16.04, 0),
    "sonar_depth_mm": ("float", "numeric", 0, "good", 3.0, 88.0, 15.56, 0),
    "sky": ("string", "categorical", 0, "good", None, None, None, 0),
    "pier": ("string", "categorical", 0, "good", None, None, None, 0),
    "tide": ("string", "categorical", 0, "good", None, None, None, 0),
    "salinity": ("float", "numeric", 2, "fair", 30.5, 60.0, 35.02, 0),
    "berths": ("int", "categorical", 6, "bad", 3.0, 7.0, 4.0, 0),
    "cargo": ("string", "categorical", 5, "bad", None, None, None, 0),
    "remark": ("string", "categorical", 8, "bad", None, None, None, 0),
    "signal": ("string", "categorical", 9, "bad", None, None, None, 0),
    "log_entry": ("unknown", "unknown", 8, "bad", None, None, None, 3),
    "unused": ("int", "numeric", 12, "bad", None, None, None, 0),
}


def test_probe_profile(probe_profile):
    got = {
        r["feature"]: (r["var_type"], r["measure_type"], r["n_missing"], r["state"], r["min"], r["max"],
                       r["center"], r["n_incompatible"])
        for r in probe_profile.collect()
    }
    assert got == EXPECTED


def test_probe_summary(probe_profile):
    s = summarise(probe_profile).first()
    assert (s["n_features"], s["n_instances"], s["n_discrete"], s["n_continuous"], s["n_unknown"]) == (12, 12, 7, 4, 1)
    assert (s["n_missing"], s["pct_missing"]) == (50, 34.72)
    assert (s["n_good"], s["pct_good"], s["n_fair"], s["pct_fair"], s["n_bad"], s["pct_bad"]) == (5, 41.7, 1, 8.3, 6, 50.0)


def test_states_and_lists(probe, probe_profile):
    quick = {r["feature"]: (r["n_missing"], r["state"]) for r in feature_state(probe, columns=PROBE_NAMES).collect()}
    assert quick == {f: (v[2], v[3]) for f, v in EXPECTED.items()}
    lists = {r["state"]: r["features"] for r in features_by_state(probe_profile).collect()}
    assert lists["good"] == PROBE_NAMES[:5] and lists["fair"] == ["salinity"] and len(lists["bad"]) == 6


def test_incompatible(probe, probe_profile):
    rows = incompatible_cells(probe, probe_profile, ["row"]).collect()
    assert sorted((r["row"], r["value"]) for r in rows) == [(2, "#"), (4, "12/31"), (10, "wind NE")]
    reported = {r["feature"]: r["incompatibility"] for r in probe_profile.collect()}
    assert reported["log_entry"] == "yes, unknown type of data"
    assert reported["unused"] == "yes, bad feature" and reported["sonar_depth_cm"] == "no"


def test_strict_null_typing(probe):
    p = {r["feature"]: r for r in profile(probe, columns=PROBE_NAMES, strict_null_typing=True).collect()}
    for name, n in (("cargo", 7), ("remark", 4), ("signal", 3)):
        assert p[name]["var_type"] == "unknown" and p[name]["n_incompatible"] == n
    assert p["pier"]["var_type"] == "string"


def test_domain(probe, probe_profile):
    p = {r["feature"]: r for r in probe_profile.collect()}
    assert (p["sky"]["domain_size"], p["sky"]["mode"]) == (3, "clear") and (p["pier"]["domain_size"], p["pier"]["mode"]) == (6, "north")
    values = {(r["feature"], r["value"]): r["n"] for r in feature_values(probe, PROBE_NAMES).collect()}
    assert {v: n for (f, v), n in values.items() if f == "sky"} == {"clear": 6, "cloudy": 3, "rain": 3}
    assert sum(f == "log_entry" for f, _ in values) == 4 and not any(f in ("unused", "berths") for f, _ in values)


def test_domain_is_whole(spark):
    df = spark.range(1000).select(F.format_string("v%04d", F.col("id") % 250).alias("t"))
    assert profile(df).first()["domain_size"] == 250
    assert sorted(r["value"] for r in feature_values(df).collect()) == [f"v{i:04d}" for i in range(250)]


@pytest.mark.parametrize("size", [1, 99, 100, 250])
def test_report_lists_all_values_or_says_so(spark, size):
    df = spark.range(500).select(F.format_string("v%03d", F.col("id") % size).alias("t"))
    (row,) = evaluation_report(profile(df), feature_values(df)).collect()
    listed = "[" + ", ".join(f"v{i:03d}" for i in range(size)) + "]"
    assert row["value_range"] == (listed if size < 100 else "Too large to display!!")


@pytest.mark.parametrize("text,kind", [
    ("1d", "string"), ("2f", "string"), ("1_000", "string"), (" 7 ", "int"), ("7.0", "int"), ("-.5", "float"),
    ("1e3", "int"), ("inf", "float"), ("-Infinity", "float"), ("0x10", "string"), ("none", "string"), ("+", "string"),
])
def test_token_kind(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(token_kind(F.col("t"))).first()[0] == kind


def test_missing_tokens(spark):
    texts = ["?", " ", "None", "nan", "NaN", None, "none", "NAN?", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert feature_state(df).first()["n_missing"] == 6
    doubles = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "d double")
    assert feature_state(doubles).first()["n_missing"] == 2


def test_edges(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert [r["state"] for r in profile(empty).collect()] == ["bad", "bad"]
    one = profile(spark.createDataFrame([(1.5, "x")], "a double, b string")).collect()
    assert one[0]["center"] == 1.5 and (one[1]["domain_size"], one[1]["mode"]) == (1, "x")
    with_inf = profile(spark.createDataFrame([(1.0,), (float("inf"),)], "a double")).first()
    assert with_inf["var_type"] == "float" and with_inf["max"] == float("inf")


@pytest.mark.parametrize("lo,hi,measure", [(0, 10, "numeric"), (0, 9, "categorical"), (-1, 5, "numeric")])
def test_one_digit_range(spark, lo, hi, measure):
    df = spark.createDataFrame([(lo, str(lo)), (hi, str(hi))], "a int, b string")
    assert [r["measure_type"] for r in profile(df).collect()] == [measure, measure]


def test_center_of_text_numbers_is_over_distinct_values(spark):
    df = spark.createDataFrame([("10",)] * 9 + [("20",)], "t string")
    assert profile(df).first()["center"] == 15.0


def test_date_names():
    assert named_like_date("birth_year") and named_like_date("update_count") and named_like_date("YEAR_IN")
    assert not named_like_date("YEAR_Age") and named_like_date("Age_year") and not named_like_date("month")


def test_describe(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10, 0)], "x double")
    r = describe_feature(df, "x").first()
    assert (r["mean"], r["median"], r["std"]) == (3.33, 2.5, 3.25)
    x = np.array([1, 2, 3, 4, 10, 0], float)
    m2, m3, m4 = (np.mean((x - x.mean()) ** k) for k in (2, 3, 4))
    assert r["skewness"] == round(m3 / m2**1.5, 2) and r["kurtosis"] == round(m4 / m2**2 - 3, 2)


def test_render_number(spark):
    given = ["12345678.5", "7.0", "nan", "", None, "abc", "0.1", "-3", "?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r[1] for r in df.select("i", render_number(F.col("t"))).orderBy("i").collect()]
    assert got == ["12345678.5", "7", "?", "?", "?", "abc", "0.1", "-3", "?"]


def test_parse_number_of_big_values(spark):
    df = spark.createDataFrame([("1e300",), ("1.",), (".",)], "t string")
    assert [r[0] for r in df.select(parse_number(F.col("t"))).collect()] == [1e300, 1.0, None]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a")], "`a.b` double, `x (mg)` string")
    assert [r["feature"] for r in profile(df).collect()] == ["a.b", "x (mg)"]


def test_domains_by_digest(spark):
    """Short and long values, ties between them, equal beginnings, and columns where every value occurs once."""
    stem = "the same beginning of all values "
    columns = {
        "long_twice": [stem + "b", stem + "b", stem + "a", stem + "a", "zz", "zz", "y"],
        "long_once": [stem + x for x in "gfedcba"],
        "short_wins": ["a", "a", "a", stem + "a", stem + "a", "b", None],
        "tie": ["the same", "the same", stem + "x", stem + "x", "zz", "q", ""],
        "accents": ["é" * 40, "é" * 40, "z" * 40, "z" * 40, "1", None, "2"],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} string" for n in columns)).repartition(3)
    got = {r["feature"]: (r["domain_size"], r["mode"]) for r in profile(df).collect()}
    for n, values in columns.items():
        seen = Counter(v for v in values if v)
        assert got[n] == (len(seen), min(seen, key=lambda v: (-seen[v], v.encode()))), n
