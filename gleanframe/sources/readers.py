"""Reading a table from CSV, JSON or parquet."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import CSV_TOKENS, column, is_missing
from gleanframe.functions.numbers import parse_number

FORMATS = ("csv", "json", "jsonl", "parquet")
COLUMNS_PER_PASS = 100
SPARE = "_beyond_the_header"


def dedup_names(names: Sequence[str]) -> list[str]:
    """A repeated name gets the suffixes 1..n, the first occurrence included."""
    total = Counter(names)
    seen: Counter = Counter()
    out = []
    for n in names:
        seen[n] += 1
        out.append(f"{n}{seen[n]}" if total[n] > 1 else n)
    return out


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format, or by the file's extension."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "json":
        return read_features_json(spark, path)
    if fmt == "jsonl":
        return infer_storage(spark.read.json(path, primitivesAsString=False), numbers_only_from_text=False)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format {fmt!r}; expected one of {', '.join(FORMATS)}")


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, tokens: Sequence[str] = CSV_TOKENS) -> DataFrame:
    """CSV with a header line. Every column is read as text; a column whose cells are all numbers
    becomes double.

    Spark splits large files; ``multi_line=True`` allows quoted line breaks and reads each file in one task. A line with
    more cells than the header and a file with another header raise an error; shorter lines end in missing cells.
    """
    # Spark would rename repeated headers its own way, so the names come from the header line.
    options = {"quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": multi_line}
    head = spark.read.options(header=False, inferSchema=False, **options).csv(path).first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = dedup_names([v if v is not None else f"Unnamed: {i}" for i, v in enumerate(head)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if len(set(names)) == len(set(head)) and len(spark.read.text(path).inputFiles()) > 1:
        named = spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path)
        named.write.format("noop").mode("overwrite").save()  # compares the header of every file
    # The spare column is filled by lines that are too long.
    wide = T.StructType([*schema.fields, T.StructField(SPARE, T.StringType())])
    text = spark.read.schema(wide).options(header=True, enforceSchema=True, **options).csv(path)
    return infer_storage(within_header(text), tokens)


def within_header(text: DataFrame) -> DataFrame:
    """The table without its spare last column; the query fails where that column holds something."""
    *names, spare = text.columns
    line = F.concat_ws(",", *[F.coalesce(column(n), F.lit("")) for n in text.columns])
    problem = F.raise_error(F.concat(F.lit("more cells than the header has names: "), line))
    whole = column(spare).isNull()
    first = column(names[0])
    return text.select(F.when(whole, first).otherwise(problem.cast("string")).alias(names[0]), *map(column, names[1:]))


def rows_from_lines(lines: DataFrame, header: str, tokens: Sequence[str] = CSV_TOKENS) -> DataFrame:
    """The table of CSV lines (``value``) that are already in a DataFrame, by the rules of ``read_csv``."""
    options = {"quote": '"', "escape": '"'}
    many = header.count(",") + 1
    parsed = lines.sparkSession.range(1).select(
        F.from_csv(F.lit(header), ", ".join(f"c{i} string" for i in range(many)), options).alias("h")).first()["h"]
    names = dedup_names([v if v is not None else f"Unnamed: {i}" for i, v in enumerate(parsed) if v is not None or i == 0])
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names) + 1)), options).alias("c")
    return infer_storage(within_header(lines.select(cells).select("c.*").toDF(*names, SPARE)), tokens)


def infer_storage(df: DataFrame, tokens: Sequence[str] = CSV_TOKENS, numbers_only_from_text: bool = True) -> DataFrame:
    """Text columns without a non-numeric cell become double, missing cells become NULL.

    One aggregate over the text columns. A column without any value counts as numeric.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numeric: set[str] = set()
    for at in range(0, len(texts), COLUMNS_PER_PASS):
        batch = texts[at : at + COLUMNS_PER_PASS]
        row = df.agg(*[
            F.count_if(~is_missing(column(n), T.StringType(), tokens)
                       & (parse_number(column(n)).isNull() if numbers_only_from_text else F.lit(True))).alias(f"c{i}")
            for i, n in enumerate(batch)
        ]).first()
        numeric.update(n for i, n in enumerate(batch) if row[f"c{i}"] == 0)
    out = []
    for f in df.schema.fields:
        c = column(f.name)
        if f.name in texts:
            present = F.when(~is_missing(c, T.StringType(), tokens), c)
            c = (parse_number(present) if f.name in numeric else present).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_features_json(spark: SparkSession, path: str) -> DataFrame:
    """One document ``{"features": [names], "data": [[cells], ..]}``.

    Cells keep their JSON type: a column of numbers is double, anything else text. One document is
    read by one task; for large data use JSON lines, which ``read_dataset(.., "jsonl")`` splits.
    """
    schema = "features array<string>, data array<array<variant>>"
    return rows_from_features(spark.read.schema(schema).json(path, multiLine=True))


def rows_from_features(documents: DataFrame) -> DataFrame:
    """Rows of ``(features array<string>, data array<array<variant>>)`` documents as one table.

    Each document's cells go by its own names: documents may list the columns in another order. All must have the
    names of the first one. Short rows end in missing cells, longer ones raise an error.
    """
    head = documents.select("features").first()
    names = dedup_names(head["features"] if head else [])
    raw = head["features"] if head else []
    # A name's n-th occurrence in the first document stands where it occurs the n-th time in the others.
    occurrence = {i: raw[:i].count(n) for i, n in enumerate(raw)}
    where = F.array(*[F.get(F.filter(
        F.transform("features", lambda x, i: F.when(x == F.lit(n), i)), lambda i: i.isNotNull()), F.lit(occurrence[k]))
        for k, n in enumerate(raw)]) if raw else F.array().cast("array<int>")
    strange = (F.size("features") != len(raw)) | F.exists("where", lambda i: i.isNull())
    checked = F.when(strange, F.raise_error(F.lit("a document has other columns than the first one")).cast("array<int>")).otherwise(F.col("where"))
    cells = documents.withColumn("where", where).select(checked.alias("where"), F.explode("data").alias("cells"))
    too_long = F.raise_error(F.lit("a row has more cells than there are columns")).cast("array<variant>")
    cells = cells.select("where", F.when(F.size("cells") > len(raw), too_long).otherwise(F.col("cells")).alias("cells"))
    at = [F.get("cells", F.get("where", F.lit(i))) for i in range(len(names))]
    kinds = ("STRING", "BOOLEAN", "OBJECT", "ARRAY")

    def other(v):
        kind = F.schema_of_variant(v)
        known = F.lit(False)
        for k in kinds:
            known = known | kind.startswith(k)
        return known

    text: set[str] = set()
    for start in range(0, len(names), COLUMNS_PER_PASS):
        batch = list(enumerate(names))[start : start + COLUMNS_PER_PASS]
        row = cells.agg(*[F.count_if(other(at[i])).alias(f"c{i}") for i, _ in batch]).first()
        text.update(n for i, n in batch if row[f"c{i}"])
    return cells.select(*[
        F.try_variant_get(at[i], "$", "string" if n in text else "double").alias(n) for i, n in enumerate(names)
    ])
