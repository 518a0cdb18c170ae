"""Exact duplicates, with heavy hitters split from the shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import stage


class MisraGries:
    """At most k counters. A key that occurs more than n / (k + 1) times among n keys has one; counts are lower bounds."""

    def __init__(self, k: int):
        self.k, self.counts = k, Counter()

    def update(self, more: Counter) -> None:
        """Adds counts, or another summary's: the (k + 1)-th largest is taken off all, which keeps the guarantee."""
        self.counts.update(more)
        if len(self.counts) > self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = Counter({key: n - cut for key, n in self.counts.items() if n > cut})


def heavy_keys(df: DataFrame, column: str, k: int = 1000) -> DataFrame:
    """At most k candidates for the heaviest values of a binary column: (key). One summary a task, added up by key."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = MisraGries(k)
        for batch in batches:
            own.update(Counter(batch.column(0).to_pylist()))
        heavy = [(key, n) for key, n in own.counts.items() if key is not None and n > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in heavy], pa.binary()), pa.array([n for _, n in heavy], pa.int64())], ["key", "n"])

    local = df.select(column).mapInArrow(summarise, "key binary, n long")
    return local.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(k).select("key")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1000) -> DataFrame:
    """One row per input row: the id under its own name, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (by SHA-256); null counts as the empty text. Of equal texts the row with the largest
    id stays; a null id is smaller than any other. Rows that are repeated with their id count in group_size, and exactly one row
    of them keeps kept = true. Other columns are not looked at. An empty table gives an empty result.

    One pass hashes the texts. Misra-Gries summaries of k counters per task nominate frequent digests; an exact count verifies
    them, and the verified winners (at most k rows of about 60 bytes, so a broadcast of bounded size) resolve their copies
    where they lie. Only the other digests are shuffled: none of them is frequent enough to make a task large.
    """
    row = F.monotonically_increasing_id()
    digests = stage(docs.select(
        F.col(id_col).alias("id"), row.alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest")),
        "digests")
    best = F.max(F.struct(F.col("id"), F.col("row")))
    verdict = [best.alias("best"), F.count(F.lit(1)).alias("n")]
    nominated = heavy_keys(digests, "digest", k)
    heavy = stage(digests.join(F.broadcast(nominated), F.col("digest") == F.col("key"), "left_semi").groupBy("digest").agg(*verdict)
                  .filter("n > 1"), "heavy")
    split = digests.join(F.broadcast(heavy), "digest", "left")
    hot = split.filter("n IS NOT NULL")
    rest = split.filter("n IS NULL").select("id", "row", "digest")
    cold = rest.join(rest.groupBy("digest").agg(*verdict), "digest")
    return hot.select("id", "row", "digest", "best", "n").unionByName(cold.select("id", "row", "digest", "best", "n")).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
