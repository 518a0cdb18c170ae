"""Benchmark passages inside documents: a prefix-filtered set join of item windows with document shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.common import stage
from gleanframe.llm.words import as_bytes, shingles, word_groups

#: Bits of the map-side filter (16 MB), whatever the size of the benchmark.
FILTER_BITS = 1 << 27
SALTS = 16
LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, width: int) -> DataFrame:
    """(item, size, words, at, shingles): every window of an item with its shingles of min(width, size) words.

    An item with fewer words than a window, but not none, is one window of its size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for group in word_groups(as_bytes(batch.column(1))):
                data = group.data.decode("utf-8", "replace") if group.data.isascii() else None
                spans = zip(group.starts.tolist(), group.ends.tolist())
                words = [(data[s:e] if data else group.data[s:e].decode("utf-8", "replace")) for s, e in spans]
                words = [w.translate(_LOWER) for w in words]
                by_width = {}
                for i in range(len(group.bounds) - 1):
                    lo, hi = group.bounds[i : i + 2]
                    size = min(window, hi - lo)
                    if not size:
                        continue
                    w = min(width, size)
                    if w not in by_width:
                        at, hashes = shingles(group, w)
                        by_width[w] = dict(zip(at.tolist(), hashes.view(np.int64).tolist()))
                    for p in range(lo, hi - size + 1):
                        rows.append((group.first + i, size, words[p : p + size], w, [by_width[w][q] for q in range(p, p + size - w + 1)]))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), *(pa.array([r[k] for r in rows], t) for k, t in (
                    (1, pa.int32()), (2, pa.list_(pa.string())), (3, pa.int32()), (4, pa.list_(pa.int64()))))],
                ["item", "size", "words", "width", "shingles"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(
        run, f"item {kind}, size int, words array<string>, width int, shingles array<long>")


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit for each of FILTER_BITS hash ranges, set where a hash lies. Bits are gathered in words of 64 by the executors, so
    the driver gets at most FILTER_BITS / 64 rows, and a filter of that many bits, however many hashes there are."""
    slot = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS.bit_length() + 1)
    rows = hashes.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int))) AS bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for batch in rows.toArrow().to_batches():  # 16 bytes a row, no Python object for each
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _corpus_counts(texts: DataFrame, bits, widths: list[int]) -> DataFrame:
    """(shingle, n) over all documents, for the shingles that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_groups(as_bytes(batch.column(0))):
                found = [h[passes(bits.value, h)] for _, h in (shingles(group, w) for w in widths)]
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    return texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(texts: DataFrame, bits, widths: list[int], window: int, kind: str) -> DataFrame:
    """A row per document: id, row, n_words, and found: (shingle, at, lead, context) for shingles that pass the filter.

    The context holds the up to window - width words on either side, so a window with the shingle anywhere lies in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_groups(as_bytes(batch.column(1))):
                n = len(group.bounds) - 1
                text = np.repeat(np.arange(n), np.diff(group.bounds))
                owner, hashes, ats, leads, contexts = [], [], [], [], []
                for width in widths:
                    at, h = shingles(group, width)
                    keep = passes(bits.value, h)
                    for p, value in zip(at[keep].tolist(), h[keep].view(np.int64).tolist()):
                        i = text[p]
                        lo = max(group.bounds[i], p - window + width)
                        hi = min(group.bounds[i + 1], p + window)
                        owner.append(i)
                        hashes.append(value)
                        ats.append(p - group.bounds[i])
                        leads.append(p - lo)
                        contexts.append(b" ".join(group.data[s:e] for s, e in zip(group.starts[lo:hi], group.ends[lo:hi])))
                order = np.argsort(np.asarray(owner, dtype=np.int64), kind="stable")
                offsets = np.searchsorted(np.asarray(owner, dtype=np.int64)[order], np.arange(n + 1)).astype(np.int32)
                fields = [pa.array(hashes, pa.int64()), pa.array(ats, pa.int32()), pa.array(leads, pa.int32()),
                          pa.array([c.decode("utf-8", "replace") for c in contexts], pa.string())]
                found = pa.StructArray.from_arrays([f.take(pa.array(order)) for f in fields], ["shingle", "at", "lead", "context"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, n), pa.array(np.diff(group.bounds), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), found)], ["id", "n_words", "found"])

    return texts.mapInArrow(
        run, f"id {kind}, n_words long, found array<struct<shingle long, at int, lead int, context string>>")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, width: int = 4) -> DataFrame:
    """One row per document row: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item (a shorter item that has words is one window). A document word inside any
    occurrence of a window is hit. Null and word-free texts have no words; without items with words nothing is hit. Documents
    that are repeated, id and all, are judged each; a null id is kept. Items with one id count once; items without an id hit words but are
    not counted. Other columns are not looked at.

    Exact containment needs every shingle of a window, so its prefix is one shingle: the rarest by the corpus's counts (ties: the
    smaller hash). Documents send only the shingles that pass a bit filter of fixed size built from those prefixes, with the words
    around them. They meet the windows by an equi-join on the shingle (the document side is salted, so a passage in a third of
    all documents is spread over SALTS tasks), must have room for the window before and after (length and position), and the
    window's words are compared one by one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    windows = stage(item_windows(items, item_id, item_text, window, width), "windows")
    widths = [r.width for r in windows.select("width").distinct().collect()]  # at most `width` rows

    each = windows.select("item", "size", "words", F.posexplode("shingles").alias("at", "shingle"))
    bits = spark.sparkContext.broadcast(bit_filter(each, "shingle"))
    counts = _corpus_counts(texts.select("text"), bits, widths or [width])
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at"))
    prefixes = stage(each.select("words", "size", "at", "shingle", "item").join(counts, "shingle", "left")
                     .groupBy("item", "size", "words").agg(rarest.alias("p"))
                     .select("item", "size", "words", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("offset")), "prefixes")
    rare = spark.sparkContext.broadcast(bit_filter(prefixes, "shingle"))
    judged = stage(_candidates(texts, rare, widths or [width], window, kind)
                   .withColumn("row", F.monotonically_increasing_id()), "candidates")

    found = judged.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*").withColumn(
        "salt", F.pmod("row", F.lit(SALTS)))
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    start = F.col("at") - F.col("offset")
    words = F.split(F.expr(LOWER_AZ.format("context")), " ")
    hits = found.join(salted, ["shingle", "salt"]).filter(
        (start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("offset"))
    ).filter(F.slice(words, F.col("lead") - F.col("offset") + 1, F.col("size")) == F.col("words")).select(
        "row", "item", start.alias("start"), (start + F.col("size")).alias("end"))
    hits = stage(hits, "hits")

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", "end").distinct().withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    names = hits.filter("item IS NOT NULL").select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(
        F.array_sort(F.collect_list("item")).alias("items"))  # at most the benchmark's items
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return judged.select("row", "id", "n_words").join(n_hit, "row", "left").join(names, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
