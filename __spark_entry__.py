"""Registered queries: every operator over the given tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import gleanframe as gf  # noqa: E402
import oracles  # noqa: E402
from gleanframe.functions.numbers import render_number, token_kind  # noqa: E402
from gleanframe.operators.features import text_of  # noqa: E402
from gleanframe.operators.grubbs import first_step  # noqa: E402
from gleanframe.functions.text import clean_name  # noqa: E402
from gleanframe.operators.materialise import fresh_path  # noqa: E402
from gleanframe.sources.readers import read_dataset, rows_from_features, rows_from_lines  # noqa: E402
from gleanframe.sources.writers import write_table  # noqa: E402

try:  # the training-data operators are optional, and so is what only they need
    import corpus_pipeline
    from gleanframe.llm import registered as llm
except ModuleNotFoundError as missing:
    if missing.name.startswith("gleanframe.") and missing.name != "gleanframe.llm":
        raise
    llm = None

KEY = ["event_id"]
FEATURES = [c for c, _ in oracles.MESSY_COLUMNS]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messy(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(oracles.EVENTS_MESSY, events=table(spark, folder, "events"))


def derived(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(oracles.LINEITEM_DERIVED, lineitem=table(spark, folder, "lineitem"))


def messy_profile(spark: SparkSession, folder: str, columns=FEATURES) -> DataFrame:
    return gf.profile(messy(spark, folder), columns=columns)


def missing_normalised(spark, folder):
    return gf.normalise_missing(messy(spark, folder)).select("event_id", "type_fair", "value_fair")


def token_kinds(spark, folder):
    df = gf.normalise_missing(messy(spark, folder))
    text = [c for c, stored in oracles.MESSY_COLUMNS if not stored]
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), token_kind(text_of(c)).alias("kind")) for c in text]))
    return df.select(kinds.alias("k")).select("k.*").filter("kind IS NOT NULL").groupBy("feature", "kind").agg(
        F.count(F.lit(1)).alias("n"))


def feature_state(spark, folder):
    return gf.feature_state(messy(spark, folder), columns=FEATURES).select("feature", "n_rows", "n_missing", "state")


def feature_types(spark, folder):
    return messy_profile(spark, folder).select("feature", "storage", "var_type", "measure_type")


def _three_profiles(spark, folder, *columns):
    parts = [
        ("events_messy", messy_profile(spark, folder)),
        ("part", gf.profile(table(spark, folder, "part"), columns=[c for c, _ in oracles.PART_COLUMNS])),
        ("lineitem", gf.profile(table(spark, folder, "lineitem"))),
    ]
    out = None
    for name, p in parts:
        rows = p.select(F.lit(name).alias("tbl"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def feature_range(spark, folder):
    return _three_profiles(spark, folder, "feature", "min", "max")


def feature_center(spark, folder):
    return _three_profiles(spark, folder, "feature", "center")


def feature_domain(spark, folder):
    """Every value of every text column with its count, and the column's size and mode beside it."""
    df, columns = table(spark, folder, "part"), [c for c, stored in oracles.PART_COLUMNS if not stored]
    facts = gf.profile(df, columns=columns).select("feature", "domain_size", "mode")
    return gf.feature_values(df, columns).join(facts, "feature")


def domain_of_texts(spark, folder):
    """Size and mode of the domains of whole documents, whose texts are counted by digest."""
    facts = gf.profile(table(spark, folder, "documents"), columns=["text", "lang", "source"])
    return facts.select("feature", "domain_size", F.md5("mode").alias("mode_md5"), "n_missing", "state")


def incompatible_cells(spark, folder):
    cells = gf.incompatible_cells(messy(spark, folder), messy_profile(spark, folder), KEY)
    return cells.select("event_id", "feature", "value")


def incompatibility_report(spark, folder):
    return messy_profile(spark, folder).select("feature", "incompatibility", "n_incompatible")


def features_by_state(spark, folder):
    return gf.features_by_state(messy_profile(spark, folder)).select("state", F.array_join("features", ",").alias("features"))


def dataset_summary(spark, folder):
    df, p = messy(spark, folder), messy_profile(spark, folder)
    return gf.summarise(gf.with_verdicts(p, gf.outlier_verdicts(df, p, "zscore")))


def evaluation_report(spark, folder):
    df, p = messy(spark, folder), messy_profile(spark, folder)
    return gf.evaluation_report(gf.with_verdicts(p, gf.outlier_verdicts(df, p, "iqr")), gf.feature_values(df, FEATURES))


def describe_feature(spark, folder):
    parts = [gf.describe_feature(table(spark, folder, t), c).withColumn("feature", F.lit(f"{t}.{c}"))
             for t, c in (("events", "value"), ("documents", "n_chars"))]
    return parts[0].unionByName(parts[1])


def _two_column_outliers(method):
    def run(spark, folder):
        parts = []
        for t, key, c in (("events", "event_id", "value"), ("documents", "doc_id", "n_chars")):
            df = table(spark, folder, t)
            cells = gf.flag_outliers(df, gf.profile(df, columns=[c]), [key], method)
            parts.append(cells.select(F.lit(f"{t}.{c}").alias("feature"), F.col(key).alias("id"),
                                      F.col("value").cast("double").alias("value")))
        return parts[0].unionByName(parts[1])

    return run


def outlier_cells(spark, folder):
    """The flagged cells of every column of the whole table."""
    df = messy(spark, folder)
    cells = gf.flag_outliers(df, messy_profile(spark, folder), KEY, "iqr")
    return cells.select("event_id", "feature", F.col("value").cast("double").alias("value"))


def _label_verdicts(method):
    def run(spark, folder):
        df = table(spark, folder, "labels")
        return gf.outlier_verdicts(df, gf.profile(df, columns=["quality", "toxic"]), method)

    return run


def outliers_verdicts(spark, folder):
    df = messy(spark, folder)
    return gf.outlier_verdicts(df, messy_profile(spark, folder), "modified_z")


def outliers_grubbs_step(spark, folder):
    parts = [first_step(table(spark, folder, t), {f"{t}.{c}": F.col(c).cast("double")})
             for t, c in (("documents", "n_chars"), ("events", "value"))]
    return parts[0].unionByName(parts[1]).select(
        "feature", "n", F.round("g_max", 6).alias("g_max"), F.round("g_min", 6).alias("g_min"))


def outliers_grubbs(spark, folder):
    df = table(spark, folder, "documents")
    cells = gf.flag_outliers(df, gf.profile(df, columns=["n_chars"]), ["doc_id"], "grubbs")
    return cells.select("doc_id", F.col("value").cast("double").alias("value"))


def _forest(method):
    def run(spark, folder):
        return gf.flag_outliers(messy(spark, folder), messy_profile(spark, folder), KEY, method, seed=oracles.SEED)

    return run


def _imputed(method, columns=tuple(c for c, _ in oracles.IMPUTED_COLUMNS)):
    def run(spark, folder):
        df = messy(spark, folder).select("event_id", *columns)
        out = gf.impute(df, gf.profile(df, columns=list(columns)), KEY, method, seed=oracles.SEED)
        return out.select("event_id", *[
            F.round(F.col(c).cast("double"), 6).alias(c) if stored and method != "none" else F.col(c)
            for c, stored in oracles.IMPUTED_COLUMNS if c in columns])

    return run


def cell_status(spark, folder):
    df, p = messy(spark, folder), messy_profile(spark, folder)
    rules = gf.fit_rules(df, p, "zscore")
    return gf.cell_status(df, p, rules, KEY, long=True, imputation="mean_mode").select("event_id", "feature", "status")


def curated_table(spark, folder):
    df, p = messy(spark, folder), messy_profile(spark, folder)
    out = gf.curated(df, p, gf.fit_rules(df, p, "zscore"), KEY, "mean_mode")
    return out.select(
        "event_id", F.round("value_fair", 6).alias("value_fair"), F.col("digit_fair").cast("double").alias("digit_fair"),
        "type_fair", "value_bad", "value_good", *[F.col("_status")[c].alias(f"st_{c}") for c in FEATURES])


def clean_table(spark, folder):
    out = gf.clean(messy(spark, folder), messy_profile(spark, folder), KEY)
    return out.withColumn("float_text", F.col("float_text").cast("double"))


def _pairs(method, columns=None, digits=6):
    def run(spark, folder):
        pairs = gf.correlated_pairs(derived(spark, folder), method, columns)
        return pairs.select("f1", "f2", F.round("value", digits).alias("value"))

    return run


def similar_strings(spark, folder):
    pairs = gf.similar_strings(table(spark, folder, "part"), "p_name")
    return pairs.select("f1", "f2", F.round("value", 6).alias("value"))


def similar_lines(spark, folder):
    """The same over the lines of all documents, of up to tens of thousands of characters."""
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    pairs = gf.similar_strings(lines, "line")
    return pairs.select("f1", "f2", F.round("value", 6).alias("value"))


def features_json_read(spark, folder):
    names = ["event_id", "value_fair", "event_type", "code_text"]
    documents = messy(spark, folder).select(
        F.array(*[F.lit(n) for n in names]).alias("features"),
        F.array(F.array(*[F.col(n).cast("variant") for n in names])).alias("data"))
    return rows_from_features(documents)


def csv_read(spark, folder):
    """Lines with quotes, missing tokens and repeated headers, made from the events and parsed as a file's lines are."""
    quoted = F.concat(F.lit('"'), F.concat(F.col("event_type"), F.lit(' ""'), F.col("event_id").cast("string"), F.lit('"", x')), F.lit('"'))
    lines = messy(spark, folder).select(F.concat_ws(
        ",", F.col("event_id").cast("string"), F.coalesce(F.col("value_fair").cast("string"), F.lit("NA")), quoted,
        F.when(F.col("event_id") % 3 == 0, "").otherwise("7")).alias("value"))
    return rows_from_lines(lines, "id,value,note,value")


def csv_files(spark, folder):
    """Every column written as CSV files and read again by the file's extension."""
    path = fresh_path(spark, ".csv")
    write_table(messy(spark, folder), path, "csv", "overwrite")
    return read_dataset(spark, path)


def jsonl_files(spark, folder):
    path = fresh_path(spark, ".jsonl")
    messy(spark, folder).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return read_dataset(spark, path).withColumn("empty_col", F.col("empty_col").cast("double"))


def json_files(spark, folder):
    """Every column in JSON documents of up to 5000 rows, a document a file, as text."""
    df, path = messy(spark, folder), fresh_path(spark, ".json")
    names = F.lit(f"[{','.join(f'"{c}"' for c in df.columns)}]")

    def cell(name):  # the JSON text of one cell
        whole = F.to_json(F.array(F.col(name)), {"ignoreNullFields": "false"})
        return F.substring(whole, F.lit(2), F.length(whole) - 2)

    rows = df.select((F.col("event_id") / 5000).cast("long").alias("part"), F.concat(F.lit("["), F.concat_ws(",", *map(cell, df.columns)), F.lit("]")).alias("row"))
    documents = rows.groupBy("part").agg(F.array_join(F.collect_list("row"), ",").alias("rows")).select(
        "part", F.concat(F.lit('{"features":'), names, F.lit(',"data":['), "rows", F.lit("]}")).alias("value"))
    documents.write.mode("overwrite").partitionBy("part").text(path)
    return read_dataset(spark, path)


def dedup_headers(spark, folder):
    lines = table(spark, folder, "events").select(
        F.concat_ws(",", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("z")).alias("value"))
    return rows_from_lines(lines, "a,b,a")


def bracketed_values(spark, folder):
    """Names with a bracketed unit, as the values of a column."""
    named = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") (cm) ")).alias("name"))
    return named.select("p_partkey", clean_name("name").alias("name"))


def similarity_none(spark, folder):
    """Without a similarity method the pair reports of a curation are empty."""
    result = gf.curate(messy(spark, folder), KEY, similarity=5)
    return result.corr_pairs.select("f1", "f2", "value").unionByName(result.lex_pairs.select("f1", "f2", "value"))


def similarity_by_numbers(spark, folder):
    """The pair reports of methods 5 (none), 2 (Pearson) and 4 (covariance)."""
    out = None
    for number, digits in ((5, 6), (2, 6), (4, 2)):
        pairs = gf.correlated_pairs(derived(spark, folder), number)
        pairs = pairs.select(F.lit(number).alias("method"), "f1", "f2", F.round("value", digits).alias("value"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def impute_by_numbers(spark, folder):
    out = None
    for number, name in sorted(oracles.IMPUTE_NUMBERS.items()):
        rows = _imputed(number if number else None)(spark, folder).withColumn("method", F.lit(number))
        rows = rows.withColumn("value_fair", F.col("value_fair").cast("double")).withColumn("digit_fair", F.col("digit_fair").cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return out


def curate_by_numbers(spark, folder):
    """Verdicts of curations whose methods go by number, and of one without any, which takes the z-score."""
    out = None
    for number in (None, 2, 3):
        facts = gf.curate(messy(spark, folder), KEY, outlier_method=number, imputation=1, similarity=5).profile
        facts = facts.select(F.lit(number or 0).alias("method"), "feature", "outlier_verdict", "n_outliers")
        out = facts if out is None else out.unionByName(facts)
    return out


def written_report(spark, folder):
    """The report of a curation as it is read again from what was written: its table, and the combined document."""
    path = fresh_path(spark)
    result = gf.curate(messy(spark, folder), KEY, outlier_method="iqr", imputation="mean_mode", stage=True)
    gf.write_reports(result, path, "parquet", name="events")
    fields = "rows struct<curated:bigint,clean:bigint>, profile array<struct<feature:string,n_missing:bigint,state:string>>"
    document = spark.read.text(f"{path}/events_results").select(F.from_json("value", fields).alias("d"))
    listed = document.select("d.rows", F.explode("d.profile").alias("p")).select(
        "p.feature", F.col("p.n_missing").alias("json_missing"), F.col("p.state").alias("json_state"),
        F.col("rows.curated").alias("n_curated"), F.col("rows.clean").alias("n_clean"))
    rows = spark.read.parquet(f"{path}/events_curated").agg(F.count(F.lit(1)).alias("n_read"))
    return spark.read.parquet(f"{path}/events_evaluation").join(listed, "feature").crossJoin(rows)


def number_render(spark, folder):
    return messy(spark, folder).select("event_id", render_number(F.col("value_fair")).alias("value_fair"),
                                       render_number(F.col("event_type")).alias("event_type"))


def curate_events(spark, folder):
    result = gf.curate(messy(spark, folder), KEY, imputation="mean_mode", outlier_method="modified_z", similarity="none")
    return result.profile.select(
        "feature", "storage", "var_type", "measure_type", "n_missing", "state", "min", "max",
        "incompatibility", "n_incompatible", "outlier_verdict", "n_outliers")


def curate_events_table(spark, folder):
    """The curated rows of a full curation with similarity, statuses included."""
    result = gf.curate(messy(spark, folder), KEY, imputation="random", outlier_method="iqr", similarity="pearson",
                       seed=oracles.SEED)
    return result.curated.select(
        "event_id", *[F.col(c).cast("double") if stored else F.col(c) for c, stored in oracles.MESSY_COLUMNS],
        F.to_json("_status").alias("status"))


def entry(spark: SparkSession) -> DataFrame:
    """Curate the small events table; the result is its evaluation report."""
    return curate_events(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        missing_normalised, token_kinds, feature_state, feature_types, feature_range, feature_center, feature_domain, domain_of_texts,
        incompatible_cells, incompatibility_report, features_by_state, dataset_summary, evaluation_report, describe_feature,
        outlier_cells, outliers_verdicts, outliers_grubbs_step, outliers_grubbs, cell_status, curated_table, clean_table,
        similar_strings, similar_lines, features_json_read, csv_read, bracketed_values, similarity_none, dedup_headers, number_render, curate_events,
        curate_events_table, csv_files, jsonl_files, json_files, similarity_by_numbers, impute_by_numbers, curate_by_numbers, written_report,
    ]
    return {
        **{f.__name__: f for f in plain},
        **{f"outliers_{m}": _two_column_outliers(m) for m in ("zscore", "modified_z", "iqr", "mad")},
        "outliers_binary_guard": _label_verdicts("iqr"),
        "outliers_none": _label_verdicts("none"),
        "outliers_forest_joint": _forest("forest_joint"),
        "outliers_forest_each": _forest("forest_each"),
        **{f"impute_{m}": _imputed(m) for m in ("mean_mode", "zeros", "random", "none")},
        "impute_categorical_round": _imputed("mean_mode", ("digit_fair",)),
        "corr_pearson": _pairs("pearson"),
        "corr_spearman": _pairs("spearman"),
        "corr_kendall": _pairs("kendall", oracles.KENDALL_COLUMNS),
        "corr_kendall_all": _pairs("kendall"),  # every derived column
        "covariance_pairs": _pairs("covariance", digits=2),
        **(llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    extra = {}
    if llm:
        extra = llm.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return oracles.oracle_sql() | extra
