"""Conversations in reply order, by linking quoted passages to the messages they come from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gleanframe.llm.common import stage
from gleanframe.llm.words import as_bytes

QUOTED = re.compile(r"\s{0,3}((?:>\s?)+)(.*)", re.DOTALL)
#: A line that announces a quotation; it goes with the quotation that follows it.
ANNOUNCES = re.compile(r"\s*(?:on\b.{0,200}\bwrote|.{1,200}\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$", re.IGNORECASE)
WORD = re.compile(r"\w+")


def normalised(line: str) -> str:
    """Words in lower case with single spaces: line breaks, spacing and signs don't matter."""
    return " ".join(WORD.findall(line.lower()))


def parse(text: str) -> tuple[str, list[str], list[tuple[int, list[str]]]]:
    """(text without quotations, its lines, passages): a passage is (level, lines), a longest run of lines of one quote level."""
    levels: list[tuple[int, str]] = []
    for line in text.splitlines():
        m = QUOTED.match(line)
        levels.append((m[1].count(">"), m[2]) if m else (0, line))
    own, passages = [], []
    for i, (level, line) in enumerate(levels):
        if level:
            if not passages or i == 0 or levels[i - 1][0] != level:
                passages.append((level, []))
            passages[-1][1].append(line)
        elif not (ANNOUNCES.match(line) and i + 1 < len(levels) and levels[i + 1][0]):
            own.append(line)
    return "\n".join(own).strip("\n"), own, passages


def units(lines: list[str]) -> dict[bytes, int]:
    """Hashes of the normalised lines, paragraphs and the whole, with their lengths. Nothing without words."""
    paragraphs, run = [], []
    for line in [*lines, ""]:
        if normalised(line):
            run.append(line)
        elif run:
            paragraphs.append(" ".join(run))
            run = []
    found = {normalised(x) for x in (*lines, *paragraphs, " ".join(lines))} - {""}
    return {hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=16).digest(): len(x) for x in found}


def _parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, own, quotes, n_quotes, levels) per row; own: hashes, quotes: (level, hash, chars)."""
    fields = [StructField("conv", messages.schema[conv].dataType), StructField("turn", messages.schema[turn].dataType)]
    schema = StructType([*fields, *StructType.fromDDL(
        "role string, text string, own array<binary>, quotes array<struct<level int, hash binary, chars int>>, n_quotes int, levels int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                texts, owns, quotes, counts, levels = [], [], [], [], []
                for raw in as_bytes(part.column(3)):
                    own, lines, passages = parse((raw or b"").decode("utf-8", "replace"))
                    texts.append(own)
                    owns.append(list(units(lines)))
                    quotes.append([{"level": level, "hash": h, "chars": n} for level, own_lines in passages for h, n in units(own_lines).items()])
                    counts.append(len(passages))
                    levels.append(max((level for level, _ in passages), default=0))
                unit = pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("chars", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(texts), pa.array(owns, pa.list_(pa.binary())),
                     pa.array(quotes, pa.list_(unit)), pa.array(counts, pa.int32()), pa.array(levels, pa.int32())], schema.names)

    source = messages.select(F.col(conv), F.col(turn), F.col(role).cast("string"), F.col(text).cast("string").cast("binary"))
    return source.mapInArrow(run, schema)


def _threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) for every reply of (conv, turn, up), by pointer doubling: as many rounds as the logarithm of the
    longest chain. A parent has an earlier turn, so there are no rings."""
    step = stage(parents.withColumn("depth", F.lit(1)), "replies")
    while True:
        above = step.toDF("conv", "up", "next", "more")
        longer = step.join(above, ["conv", "up"])
        if not longer.take(1):
            return step.withColumnRenamed("up", "thread")
        step = stage(step.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, turn and role under their names, text without quotations, n_quotes (passages), levels (deepest),
    n_linked (levels with a source), reply_to, thread, depth, position.

    The source of a quote level is the earlier message of the conversation that has most of its characters in its own words; of
    equals the latest one. A passage, line or paragraph belongs to the first message of the conversation with it in its own words.
    reply_to is the source of level 1; thread is the message at the start of the chain of replies, depth the number of steps. A
    conversation is ordered by thread, depth, turn, so a reply follows what it replies to; position counts from 1.

    Null texts are empty, and so are texts of quotations only. Null conversation ids are one conversation without links; null turns come first and neither
    reply nor are replied to. Repeated rows stay, next to one another. Other columns are not looked at; an empty table gives no
    rows.

    Hashes meet by an equi-join; a common line of a large conversation is one row on the message side. Nothing needs the messages
    of a conversation in one task: positions are counted in ranges of the order, and the ranges' counts are added up.
    """
    own = stage(_parsed(messages, conv, turn, role, text).withColumn("row", F.monotonically_increasing_id()), "messages")
    first = own.select("conv", "turn", F.explode("own").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("source"))
    asked = own.filter("n_quotes > 0").select("row", "conv", "turn", F.explode("quotes").alias("q")).select("row", "conv", "turn", "q.*")
    linked = asked.join(first, ["conv", "hash"]).filter("source < turn").groupBy("row", "conv", "turn", "level", "source").agg(
        F.sum("chars").alias("chars")).groupBy("row", "conv", "turn", "level").agg(
        F.max(F.struct("chars", "source"))["source"].alias("source"))
    linked = stage(linked, "links")
    counts = linked.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("source"))).alias("reply_to"))
    parents = linked.filter("level = 1").groupBy("conv", "turn").agg(F.max("source").alias("up"))
    threads = _threads(parents)

    placed = own.drop("own", "quotes").join(counts, "row", "left").join(threads, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "text", "n_quotes", "levels", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread", F.col("turn")).alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "row")
    order = ["thread", "depth", "turn", "row"]
    ranged = stage(placed.repartitionByRange("conv", *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).select(F.col("conv").alias("c"), F.col("range").alias("r"), "before")
    within = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order))
    return ranged.withColumn("k", within).join(sizes, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "n_quotes", "levels", "n_linked",
        "reply_to", "thread", "depth", (F.col("k") + F.col("before")).alias("position"))
