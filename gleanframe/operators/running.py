"""Running totals over groups of any size, and joins against tables with hot keys.

``Window.partitionBy(g).orderBy(v)`` puts a whole group into one task. Here a large group is cut into slices of the order, whose
bounds are literals of the plan: a slice is a pure function of the value, so a lost task finds the same rows again and nothing
has to be written in between. One small table supplies what came before a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a group that one task numbers; a larger group is cut into slices of about half as many.
SLICE_ROWS = 1 << 20
# Slices of one group at most; beyond, they grow.
MOST_SLICES = 4096
# Keys looked up by broadcast, over all groups together. With n rows in g groups, no other key has more
# than n * g / HOT_KEYS rows.
HOT_KEYS = 200_000


def _code(c: Column, kind: T.DataType) -> Column:
    """A number that never falls as c rises: the first seven bytes of text, else the value itself."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return c.cast("double")


def _slice_bounds(df: DataFrame, group: list[str], code: Column) -> DataFrame | None:
    """(group, bounds) of the groups with more than SLICE_ROWS rows, of which a table of n rows has at most n / SLICE_ROWS."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SLICE_ROWS)
    large = sizes.collect()
    if not large:
        return None
    spark, fields = df.sparkSession, [df.schema[g] for g in group]
    names = spark.createDataFrame([tuple(r[g] for g in group) for r in large], T.StructType(fields))
    n = min(MOST_SLICES, -(-2 * max(r["_n"] for r in large) // SLICE_ROWS))
    marks = [k / n for k in range(1, n)]
    rows = df.join(F.broadcast(names), group).groupBy(*group).agg(F.array_distinct(F.percentile_approx(code, marks, 20 * n)).alias("_bounds")).collect()
    return spark.createDataFrame([tuple(r) for r in rows], T.StructType([*fields, T.StructField("_bounds", T.ArrayType(T.DoubleType()))]))


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Sequence[str], at_most: int | None = None,
) -> DataFrame:
    """Add ``<s>_before`` for every column in ``sums``: its total over the earlier rows of the group.

    (group, order) must identify a row and not be NULL. Columns in ``sums`` are bigint or double and not NULL. A caller that
    knows how many rows a group has ``at_most`` spares the count that finds large groups. Rows come out in order within a slice.
    """
    group, order, sums = list(group), list(order), list(sums)
    code = _code(F.col(order[0]), df.schema[order[0]].dataType)
    bounds = None if at_most is not None and at_most <= SLICE_ROWS else _slice_bounds(df, group, code)

    def before(s: str, *within: str) -> Column:
        earlier = Window.partitionBy(*group, *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(s).over(earlier), F.lit(0)).cast(df.schema[s].dataType)

    if bounds is None:
        return df.select("*", *[before(s).alias(f"{s}_before") for s in sums])
    number = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= code)), F.lit(0))
    sliced = df.join(F.broadcast(bounds), group, "left").withColumn("_slice", F.when(F.col("_bounds").isNotNull(), number).otherwise(0))
    totals = sliced.filter("_bounds IS NOT NULL").groupBy(*group, "_slice").agg(*[F.sum(s).alias(s) for s in sums])
    ahead = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # A row per slice: the table's rows over SLICE_ROWS / 2.
    offsets = totals.select(*group, "_slice", *[F.sum(s).over(ahead).alias(f"_o_{s}") for s in sums])
    rows = sliced.drop("_bounds").select("*", *[before(s, "_slice").alias(f"{s}_before") for s in sums])
    joined = rows.join(F.broadcast(offsets), [*group, "_slice"], "left")
    return joined.select(*df.columns, *[
        (F.col(f"{s}_before") + F.coalesce(f"_o_{s}", F.lit(0))).cast(df.schema[s].dataType).alias(f"{s}_before") for s in sums])


def hot_lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, group: Sequence[str] = (),
    n_groups: int = 1, hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Inner join of many ``rows`` against a ``table`` with one row per key, safe when keys are hot.

    ``weight`` is the table's column with the number of matching rows. The heaviest keys of each
    group, at most ``hot_keys`` in all, are looked up by broadcast; the rest is an ordinary shuffle
    join in which no key is large.
    """
    keys, group = list(keys), list(group)
    if not group:
        group = ["_all"]
        table = table.withColumn("_all", F.lit(0))
    totals = table.groupBy(*group).agg(F.sum(weight).alias("_total"))
    share = n_groups / hot_keys
    joined = table.join(F.broadcast(totals), group)
    marked = joined.withColumn("_hot", (F.col(weight) > 1) & (F.col(weight) >= F.col("_total") * F.lit(share)))
    payload = [c for c in table.columns if c not in keys and c not in (weight, "_all")]
    hot = marked.filter("_hot").select(*keys, *payload, F.lit(True).alias("_is_hot"))
    cold = marked.filter("NOT _hot").select(*keys, *payload)
    probed = rows.join(F.broadcast(hot), keys, "left")
    kept = list(rows.columns)
    found = probed.filter("_is_hot").select(*kept, *payload)
    rest = probed.filter("_is_hot IS NULL").select(*kept)
    return found.unionByName(rest.join(cold, keys).select(*kept, *payload))
