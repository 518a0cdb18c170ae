import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import PROBE_NAMES, PROBE_ROWS
from gleanframe import curate, curate_file, profile, read_dataset, write_reports
from gleanframe.operators.impute import impute
from gleanframe.operators.outliers import fit_rules, flag_outliers
from gleanframe.operators.status import cell_status, clean, curated
from gleanframe.sources.writers import write_table
from gleanframe.sources.readers import dedup_names, read_csv, rows_from_lines


def test_probe_mean_mode(probe, probe_profile):
    got = impute(probe, probe_profile, method="mean_mode").orderBy("row").collect()
    for i, r in enumerate(got):
        for j, n in enumerate(PROBE_NAMES):
            if n == "salinity" and i in (2, 8):
                assert abs(r[n] - 35.025) < 1e-9
            else:
                assert r[n] == PROBE_ROWS[i][j]


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(i, None if i % 5 == 0 else float(i), None if i % 4 == 0 else i % 10, None if i % 10 == 3 else "ab"[i % 3 == 0],
             None if i % 2 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double, digit int, t string, bad double").repartition(3)
    return df, profile(df, columns=["x", "digit", "t", "bad"])


def test_rounding_and_mode(holes):
    df, p = holes
    got = impute(df, p, method="mean_mode").collect()
    observed = [r["digit"] for r in df.collect() if r["digit"] is not None]
    assert {r["digit"] for r in got if r["k"] % 4 == 0} == {float(round(sum(observed) / len(observed)))}
    assert {r["t"] for r in got if r["k"] % 10 == 3} == {"a"}
    assert sum(r["bad"] is None for r in got) == 100


def test_zeros_and_none(holes):
    df, p = holes
    got = impute(df, p, method="zeros").collect()
    assert {r["x"] for r in got if r["k"] % 5 == 0} == {0.0} and {r["digit"] for r in got if r["k"] % 4 == 0} == {0.0}
    assert all(r["t"] is None for r in got if r["k"] % 10 == 3)
    none = impute(df, p, method="none")
    assert sorted(none.collect(), key=lambda r: r["k"]) == sorted(df.collect(), key=lambda r: r["k"])


def test_random_draws_without_replacement(holes):
    df, p = holes
    got = {r["k"]: r for r in impute(df, p, ["k"], "random", seed=5).collect()}
    again = {r["k"]: r for r in impute(df.repartition(7), p, ["k"], "random", seed=5).collect()}
    other = {r["k"]: r for r in impute(df, p, ["k"], "random", seed=6).collect()}
    assert got == again and got != other and len(got) == 200
    for n in ("x", "digit", "t"):
        original = {r["k"]: r[n] for r in df.collect()}
        fills = Counter(r[n] for k, r in got.items() if original[k] is None)
        observed = Counter(v for v in original.values() if v is not None)
        assert None not in fills and not fills - observed
        assert all(r[n] == original[k] for k, r in got.items() if original[k] is not None)
    with pytest.raises(ValueError):
        impute(df, p, (), "random")


def test_random_leaves_columns_with_too_few_values(spark):
    df = spark.createDataFrame([(i, float(i) if i < 4 else None) for i in range(10)], "k int, x double")
    p = profile(df, threshold=0.9, columns=["x"])
    assert impute(df, p, ["k"], "random").filter("x IS NULL").count() == 6


def test_probe_status(probe, probe_profile):
    rules = fit_rules(probe, probe_profile, "iqr")
    rows = cell_status(probe, probe_profile, rules, ["row"], long=True, imputation="mean_mode").collect()
    got = {(r["feature"], r["row"]): r["status"] for r in rows}
    assert got[("sonar_depth_cm", 4)] == "outlier" and got[("salinity", 8)] == "imputed"
    assert got[("log_entry", 10)] == "incompatible" and got[("log_entry", 0)] == "missing"
    assert ("log_entry", 7) not in got and got[("unused", 0)] == "missing"
    assert Counter(got.values()) == {"outlier": 5, "imputed": 2, "missing": 48, "incompatible": 3}
    wide = cell_status(probe, probe_profile, rules, ["row"], imputation="mean_mode").collect()
    assert all(r["_status"][n] == got.get((n, r["row"]), "ok") for r in wide for n in PROBE_NAMES)


def test_status_from_forest_cells(probe, probe_profile):
    cells = flag_outliers(probe, probe_profile, ["row"], "forest_each", seed=2)
    rows = cell_status(probe, probe_profile, cells, ["row"], long=True).collect()
    flagged = {(r["feature"], r["row"]) for r in cells.collect()}
    assert {(r["feature"], r["row"]) for r in rows if r["status"] == "outlier"} == flagged


def test_clean_and_curated(probe, probe_profile):
    rules = fit_rules(probe, probe_profile, "zscore")
    table = curated(probe, probe_profile, rules, ["row"])
    kept = clean(probe, probe_profile)
    assert kept.columns == ["row", *PROBE_NAMES[:6]] and set(kept.columns) <= set(table.columns)
    assert [r["row"] for r in kept.filter("salinity IS NULL").orderBy("row").collect()] == [2, 8]
    assert clean(probe, probe_profile, imputed=True).filter("salinity IS NULL").count() == 0
    third = table.filter("row = 2").first()
    assert third["_status"]["salinity"] == "imputed" and third["salinity"] > 35


def write_probe(folder: Path) -> tuple[str, str]:
    def cell(v):
        if v is None:
            return ""
        s = str(v)
        return '"' + s.replace('"', '""') + '"' if '"' in s else s

    csv_path, json_path = folder / "t.csv", folder / "t.json"
    csv_path.write_text(",".join(PROBE_NAMES) + "\n" + "".join(",".join(cell(v) for v in r) + "\n" for r in PROBE_ROWS))
    json_path.write_text(json.dumps({"features": PROBE_NAMES, "data": [list(r) for r in PROBE_ROWS]}, indent=1))
    return str(csv_path), str(json_path)


def test_csv_and_json_give_the_same_profile(spark, probe_profile, tmp_path):
    csv_path, json_path = write_probe(tmp_path)
    facts = ("feature", "var_type", "measure_type", "n_missing", "state", "min", "max", "center", "n_incompatible", "domain_size", "mode")
    want = probe_profile.select(*facts).collect()
    assert profile(read_dataset(spark, csv_path)).select(*facts).collect() == want
    assert profile(read_dataset(spark, json_path)).select(*facts).collect() == want


def test_readers(spark, tmp_path):
    assert dedup_names(["a", "b", "a"]) == ["a1", "b", "a2"]
    p = tmp_path / "d.csv"
    p.write_text('a,b,a\n1,"line\nbreak",x\n2,"quote "" here",NA\n')
    df = read_csv(spark, str(p), multi_line=True)
    assert df.columns == ["a1", "b", "a2"] and df.schema["a1"].dataType.simpleString() == "double"
    rows = df.orderBy("a1").collect()
    assert rows[0]["b"] == "line\nbreak" and rows[1]["b"] == 'quote " here' and rows[1]["a2"] is None
    j = tmp_path / "d.json"
    j.write_text(json.dumps({"features": ["n", "t"], "data": [[1, "7"], [2.5, None], [None, "x"]]}))
    df = read_dataset(spark, str(j))
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string"]
    lines = tmp_path / "d.jsonl"
    lines.write_text('{"n": 1, "t": "7"}\n{"n": 2, "t": "8"}\n')
    assert [f.dataType.simpleString() for f in read_dataset(spark, str(lines)).schema] == ["bigint", "string"]
    with pytest.raises(ValueError):
        read_dataset(spark, "table.xls")


def test_lines_that_don_t_fit_the_header(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,x\n2,y,EXTRA\n")
    with pytest.raises(Exception, match="more cells"):
        read_dataset(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "short.csv").write_text("a,b\n1,x\n2\n")
    assert sorted(map(tuple, read_dataset(spark, str(tmp_path / "short.csv")).collect())) == [(1.0, "x"), (2.0, None)]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("b,a\ny,2\n")
    with pytest.raises(Exception):
        read_dataset(spark, str(folder), "csv").collect()
    lines = spark.createDataFrame([('1,"x, y",p',), ("2,NA,q",)], "value string")
    df = rows_from_lines(lines, "a,b,a")
    assert df.columns == ["a1", "b", "a2"] and sorted(map(tuple, df.collect())) == [(1.0, "x, y", "p"), (2.0, None, "q")]


def test_documents_with_other_orders_and_lengths(spark, tmp_path):
    def read(*documents):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for i, d in enumerate(documents):
            (folder / f"{i}.json").write_text(json.dumps(d))
        return read_dataset(spark, str(folder), "json")

    df = read({"features": ["a", "b"], "data": [[1, "x"], [2]]}, {"features": ["b", "a"], "data": [["y", 3]]})
    assert sorted(map(tuple, df.select("a", "b").collect())) == [(1.0, "x"), (2.0, None), (3.0, "y")]
    for other in ({"features": ["a", "c"], "data": [[1, 2]]}, {"features": ["a", "b"], "data": [[1, "x", 5]]}):
        with pytest.raises(Exception):
            read({"features": ["a", "b"], "data": [[1, "x"]]}, other).collect()


def test_filled_whole_numbers_keep_every_digit(spark):
    big = [9007199254740993, 9007199254740995, None, 9007199254740997, 9007199254740999]
    df = spark.createDataFrame(list(enumerate(big)), "k int, x long")
    p = profile(df, columns=["x"])
    for method in ("mean_mode", "zeros", "random"):
        got = {r["k"]: r["x"] for r in impute(df, p, ["k"], method).collect()}
        assert all(got[k] == v for k, v in enumerate(big) if v is not None) and got[2] is not None
    assert impute(df, p, ["k"], "random").schema["x"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_curate_and_reports(spark, probe, tmp_path, fmt):
    nested = probe.withColumn("tags", F.array(F.lit(1)))
    result = curate(nested, ["row"], imputation=1, outlier_method=2, similarity=2)
    assert result.skipped == {"tags": "nested type array<int>"}
    assert result.summary.first()["n_outliers"] == 5
    assert [r["f1"] for r in result.corr_pairs.collect()] == ["sonar_depth_mm"]
    assert [r["f1"] for r in result.lex_pairs.collect()] == ["sonar_depth_mm"]
    write_reports(result, str(tmp_path), fmt, name="probe")
    report = {r["feature"]: r for r in result.evaluation.collect()}
    assert report["sonar_depth_cm"]["value_range"] == "[3.5, 90]" and report["sonar_depth_cm"]["center"] == "16.04"
    assert report["sky"]["value_range"] == "[clear, cloudy, rain]" and report["sky"]["center"] == "-"
    assert report["unused"]["value_range"] == "[?, ?]" and report["sonar_depth_cm"]["outliers"] == "yes"
    document = json.loads(spark.read.text(f"{tmp_path}/probe_results").first()[0])
    assert document["summary"][0]["n_features"] == 12 and len(document["profile"]) == 12
    back = spark.read.format(fmt).option("header", True).load(f"{tmp_path}/probe_curated")
    assert back.count() == 12 and {"row", "salinity", "_status"} <= set(back.columns)


def test_curate_file_stages_what_has_to_be_parsed(spark, probe, tmp_path):
    write_table(probe, f"{tmp_path}/probe.csv", "csv")
    result = curate_file(spark, f"{tmp_path}/probe.csv", ["row"], outlier_method="iqr")
    for df in (result.curated, result.clean, result.cells):
        files = df.inputFiles()
        assert files and not any(str(tmp_path) in f for f in files)
    assert result.summary.first()["n_instances"] == 12
    write_reports(result, f"{tmp_path}/out", "json", name="probe")
    document = json.loads(spark.read.text(f"{tmp_path}/out/probe_results").first()[0])
    assert document["rows"] == {t: spark.read.json(f"{tmp_path}/out/probe_{t}").count() for t in ("cells", "curated", "clean")}


def test_defaults(probe):
    result = curate(probe, ["row"])
    assert result.corr_pairs.count() == 0 and result.lex_pairs.count() == 0
    assert result.summary.first()["n_outliers"] == 1
    assert result.curated.filter("salinity IS NULL").count() == 2


def rounded(rows):
    """Sums of doubles may differ in their last digits with the order of the rows."""
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def test_layout_does_not_matter(probe):
    one, two = (curate(d, ["row"], "random", "iqr", "spearman", seed=4) for d in (probe.coalesce(1), probe.repartition(6)))
    for t in ("profile", "summary", "corr_pairs", "lex_pairs"):
        assert rounded(getattr(one, t).collect()) == rounded(getattr(two, t).collect())
    for t in ("cells", "curated", "clean"):
        a, b = (sorted(map(str, getattr(r, t).collect())) for r in (one, two))
        assert a == b


def test_passes_read_what_was_computed_once(spark):
    """Every pass of a curation reads a stored table, spread over the cores, not the plan that made it."""
    df = spark.range(200).coalesce(1).selectExpr("id", "cast(id % 7 as double) * 1.25 as x", "concat('slowly-made-', id % 3) as t")
    result = curate(df, ["id"], similarity="none")
    for rows in (result.curated, result.clean, result.cells):
        assert "slowly-made-" not in rows._jdf.queryExecution().analyzed().toString()
    void = df.withColumn("v", F.lit(None))  # cannot be written
    assert curate(void, ["id"], similarity="none").curated.count() == 200
