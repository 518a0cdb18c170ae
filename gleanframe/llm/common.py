"""What the operators share: the shared folder, written intermediate tables, the held-out fold, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one (as in tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gleanframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Hadoop's own clean-up: the folder goes when the driver ends, also if later queries still read it until then."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/gleanframe-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: computed once, and a lost executor costs only the reading."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 5, is 0. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is one node of its component.

    Randomised contraction: each round every node is replaced by the node of its closed neighbourhood that comes first in an
    order that changes by round, and the edges are rewritten. The first order is the id's own, which finishes stars at once;
    later orders are hashes, so the number of rounds is logarithmic whatever the ids are. Nothing but a count reaches the
    driver; each round's table is written to the shared folder. Nulls are no nodes.
    """
    rest = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    rest = stage(rest, "edges")
    maps: list[DataFrame] = []
    while rest.filter("u != v").take(1) or not maps:
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = (lambda c: F.col(c)) if not maps else (lambda c, n=len(maps): F.xxhash64(F.lit(n), F.col(c)))
        first = F.min(F.least(F.struct(order("u").alias("o"), F.col("u").alias("r")),
                              F.struct(order("v").alias("o"), F.col("v").alias("r"))))
        step = stage(both.groupBy("u").agg(first.alias("m")).select(F.col("u").alias("node"), F.col("m.r").alias("root")), "roots")
        maps.append(step)
        left, right = step.toDF("u", "ru"), step.toDF("v", "rv")
        rest = rest.filter("u != v").join(left, "u").join(right, "v").filter("ru != rv").select(
            F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        rest = stage(rest, "edges")
    # What a round left as a root may have been replaced in a later one. Written, as callers read it several times: else each of
    # their plans repeats the joins of all rounds, and the driver builds as many broadcast tables.
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage(out, "components") if maps[1:] else out
