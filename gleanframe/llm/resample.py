"""Importance resampling towards a target: hashed word runs, log ratios of bucket counts, Gumbel noise, the highest scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanframe.llm.common import stage
from gleanframe.llm.words import BASE, LOWER, Words, as_bytes, word_groups

BUCKETS = 10_000
#: Beyond this length a feature has a matrix nearly to itself; the library's crc32 takes it in one call.
LONGEST = 256
#: Words hashed at a time.
STEP = 1 << 18
#: Slices that the drawn scores are ranked in.
SLICES = 512

_table = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _table = np.where(_table & 1, (_table >> np.uint32(1)) ^ np.uint32(0xEDB88320), _table >> np.uint32(1))


def crc_columns(rows: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every column of a uint8 matrix that holds one byte string per column: all are updated byte by byte."""
    crc = np.full(rows.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    for byte in rows:
        crc = _table[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings data[start : start + size], in their order. Equal strings have equal marks.

    Strings of one length form a matrix; each distinct string enters it once. A mark that two strings share is found by comparing
    bytes, and both are then hashed.
    """
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, firsts = np.unique(sizes[order], return_index=True)
    for size, own in zip(lengths.tolist(), np.split(order, firsts[1:])):
        if size > LONGEST:
            for i in own:
                out[i] = zlib.crc32(data[starts[i] : starts[i] + size])
            continue
        rows = data[starts[own] + np.arange(size)[:, None]]
        _, chosen, back = np.unique(marks[own], return_index=True, return_inverse=True)
        values = crc_columns(rows[:, chosen])[back]
        other = np.flatnonzero((rows != rows[:, chosen[back]]).any(axis=0))
        if len(other):
            values[other] = crc_columns(rows[:, other])
        out[own] = values
    return out


def spaced(words: Words, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words at to end in lower case with one space after each, their starts there, and their sizes: a run of words is then one slice."""
    first, sizes = words.starts[at:end], words.ends[at:end] - words.starts[at:end]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    whence = np.repeat(first - starts[:-1], sizes + 1) + np.arange(starts[-1])
    data = LOWER[np.frombuffer(words.data, dtype=np.uint8)[whence]]
    data[starts[1:] - 1] = 32
    return data, starts[:-1], sizes


def features(words: Words, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of 1 to runs words that lies in one text, in steps; text counts the group's texts."""
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    for at in range(0, len(text), STEP):
        end = min(at + STEP, len(text))
        data, starts, sizes = spaced(words, at, min(end + runs - 1, len(text)))
        marks = np.zeros(end - at, dtype=np.uint64)
        for width in range(1, runs + 1):
            n = min(end - at, len(starts) - width + 1)
            if n <= 0:
                break
            marks = marks[:n] * np.uint64(BASE) + words.hashes[at + width - 1 : at + width - 1 + n]
            own = np.flatnonzero(text[at : at + n] == text[at + width - 1 : at + width - 1 + n])
            last = own + width - 1
            yield text[at + own], (crcs(data, starts[own], starts[last] + sizes[last] - starts[own], marks[own]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, runs: int, buckets: int) -> list[int]:
    """How many features of all texts each bucket holds. A vector a task, added up by bucket; the driver gets as many rows as buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for words in word_groups(as_bytes(batch.column(0))):
                for _, bucket in features(words, runs, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    got = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in got.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))) of each of the b buckets, in doubles."""
    b, all_raw, all_target = len(raw), sum(raw), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw + b) / (float(s + 1) * float(all_target + b)))) for s, t in zip(raw, target)]


def weighed(docs: DataFrame, gain: list[int], id_col: str, text_col: str, runs: int) -> DataFrame:
    """(id, n_words, n_features, weight) per row; weight is the sum of its features' gains."""
    kind, table = docs.schema[id_col].dataType.simpleString(), np.array(gain, dtype=np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for words in word_groups(as_bytes(batch.column(1))):
                own = slice(words.first, words.first + len(words.bounds) - 1)
                n_words[own] = np.diff(words.bounds)
                for text, bucket in features(words, runs, len(table)):
                    n_features[own] += np.bincount(text, minlength=len(words.bounds) - 1)
                    np.add.at(weight[own], text, table[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary")).mapInArrow(
        weigh, f"id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = BUCKETS, least_words: int = 20,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of docs: the id under its own name, n_features, weight, score, rank, n_words.

    Words are longest runs of the bytes 0-9, A-Z, a-z and 0x80 to 0xFF of whole texts, A-Z as a-z; features are all runs of 1 to
    runs of them, joined by one space, repeats counted; a feature's bucket is its CRC-32 modulo buckets. A bucket's gain compares
    its share of target with its share of docs; weight is the sum of gains over a row's features, score adds Gumbel noise drawn
    from sha256("<seed>:<id>"). Of the N rows with at least least_words words, those with the floor(percent * N / 100) highest
    scores are drawn and ranked from 1; ties go to the smaller id (a null id first). All other ranks are null.

    Null and empty texts have no features, weight 0. Repeated rows count and are ranked each (their noise is the same, as it
    depends on the id alone; a null id counts as the empty text). Texts of any length are read whole, in steps. An empty docs
    gives an empty result; an empty target leaves every gain to the counts of docs. Other columns are not looked at.

    Two narrow passes read docs: one for the counts (a vector a task; the driver gets one number a bucket), one for the weights.
    Scores are written once. What is ranked is the drawn share alone, in slices of the score with bounds from one sketch; noise
    spreads equal weights over the slices. The driver sees a count per slice.
    """
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = stage(weighed(docs, gain, id_col, text_col, runs).withColumn("score", F.col("weight") + noise), "scores")

    fit = F.col("n_words") >= least_words
    n = scored.filter(fit).count()
    drawn = percent * n // 100
    out = ["id", "n_features", "weight", "score", "rank", "n_words"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return scored.withColumn("rank", none).select(F.col("id").alias(id_col), *out[1:])
    share = drawn / n
    # Somewhat more slices than the share needs, as the sketch is near, not exact; then a few wide ones.
    marks = [min(share * k / SLICES, 1.0) for k in range(1, SLICES + SLICES // 16)]
    marks += [marks[-1] + (1 - marks[-1]) * k / 16 for k in range(1, 16)]
    cuts = scored.filter(fit).select(F.percentile_approx(-F.col("score"), marks, 100 * SLICES).alias("cuts")).first()["cuts"]
    # One function over an array: as a tree of half a thousand comparisons it would be compiled to a very large method on every executor.
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))])
    scored = scored.withColumn("slice", F.when(fit, F.size(F.filter(bounds, lambda b: b <= -F.col("score")))))
    before, total = {}, 0
    for r in sorted(scored.filter(fit).groupBy("slice").count().collect()):
        if total < drawn:
            before[r["slice"]] = total
        total += r["count"]
    offsets = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before) + 1)])
    near = F.col("slice") <= max(before)
    place = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("score"), F.asc("id"))) + F.get(offsets, F.col("slice"))
    ranked = scored.filter(near).withColumn("place", place).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", none)
    return ranked.select(*out).unionByName(rest.select(*out)).select(F.col("id").alias(id_col), *out[1:])
