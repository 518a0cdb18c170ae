"""Removal of byte strings that occur earlier, by sorted suffixes of the places where texts can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StructField, StructType

from gleanframe.llm.common import stage
from gleanframe.llm.decontaminate import bit_filter, passes
from gleanframe.llm.induced_sort import suffix_order
from gleanframe.llm.words import BASE, as_bytes, groups, mix, powers

#: Bytes of the seeds whose least hash stands for a window: about half of a window at most. Short seeds meet by chance, the more
#: often the more text there is, and every such meeting has to be sorted out; long seeds make more, shorter runs of windows.
SEED = 48
#: Bytes of texts, or of a long text, that are hashed at a time: eight bytes for each in a dozen arrays, which stay in a core's cache.
GROUP = 1 << 17
#: Bits for a place in a group of texts; the rest of 64 are the hash by which seeds are compared.
PLACE = np.uint64(21)
#: Bytes that a shard has at least before the next one begins.
SHARD_BYTES = 3 << 19
#: Bytes of text whose segments a task holds at a time.
BATCH_BYTES = 8 << 20
#: Contents of one key (a batch counts each once) beyond which its windows are sorted one by one over all tasks, so a shard has at most
#: so many contents beyond SHARD_BYTES.
HOT = 1 << 14

_value, _value2 = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE ^ x)) for x in (0x5DEECE66D, 0x2545F4914F6CDD1D))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - width + span], x[width - span :]) if span < width else x


def _segments(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, size, key, mark, mark2) of the longest runs of windows whose first least seed stands at one place, within the texts given by
    bounds; the key is that seed's hash, mixed again as least hashes crowd at the low end, the marks are two hashes of the content. No window occurs twice in a run, as its least seed would stand at two places."""
    n, seed = len(data), min(SEED, (length + 1) // 2)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_value[data] * up[:n], out=sums[1:])
    seeds = mix((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
    packed = (seeds >> PLACE << PLACE) | np.arange(len(seeds), dtype=np.uint64)
    least = (sliding_least(packed, length - seed + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    first, last = bounds[:-1], bounds[1:] - 1 - length
    inside = np.zeros(n + 2, dtype=np.int32)
    full = last >= first
    inside[first[full]] += 1
    inside[last[full] + 1] -= 1
    inside = np.cumsum(inside)[: len(least)] > 0
    new = ~inside
    new[0] = True
    new[1:] |= least[1:] != least[:-1]
    new[first[first < len(least)]] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(least)) - 1 + length
    keep = inside[start]
    start, stop = start[keep], stop[keep]
    mark = mix((sums[stop] - sums[start]) * down[start])
    np.cumsum(_value2[data] * up[:n], out=sums[1:])
    return start, stop - start, mix(seeds[least[start]]), mark, mix((sums[stop] - sums[start]) * down[start])


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, size, key, mark, mark2) for groups of texts. Equal windows of `length` bytes have equal keys. Long texts go in steps
    that overlap by length - 1 bytes; a step's end only splits a run."""
    for first, group in groups(texts, GROUP):
        if len(group) == 1 and len(group[0]) > GROUP:
            whole = np.frombuffer(group[0], dtype=np.uint8)
            pieces = [(at, whole[at : at + GROUP + length - 1]) for at in range(0, len(whole) - length + 1, GROUP)]
            for at, piece in pieces:
                data = np.append(piece, np.uint8(0))
                start, *rest = _segments(data, np.array([0, len(data)]), length)
                yield np.full(len(start), first), start + at, *rest
        else:
            data = np.frombuffer(b"\0".join(group) + b"\0", dtype=np.uint8)
            if len(data) > length:
                bounds = np.cumsum([0, *[len(t) + 1 for t in group]])
                start, *rest = _segments(data, bounds, length)
                text = np.searchsorted(bounds, start, side="right") - 1
                yield text + first, start - bounds[text], *rest


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about BATCH_BYTES of text, or one row; what is said of a batch below is said of such a part."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _batch_segments(batch: pa.RecordBatch, length: int):
    """The segments of a batch of (row, text) in the order of rows and starts, whether each is the batch's first of its content, texts."""
    order = np.argsort(batch.column(0).to_numpy(), kind="stable")
    rows = batch.column(0).to_numpy()[order]
    texts = [t or b"" for t in as_bytes(batch.column(1).take(pa.array(order)))]
    parts = list(segments(texts, length))
    if not parts:
        return None
    text, start, size, key, mark, mark2 = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(mix(key) ^ mark, kind="stable")
    first = np.ones(len(by), dtype=bool)
    first[by[1:]] = np.any([x[by[1:]] != x[by[:-1]] for x in (key, mark, mark2)], axis=0)
    # Marks only say which contents to compare.
    leader = np.empty(len(by), dtype=np.int64)
    leader[by] = by[np.maximum.accumulate(np.where(first[by], np.arange(len(by)), 0))]

    def content(i: int) -> bytes:
        return texts[text[i]][start[i] : start[i] + size[i]]

    for i in np.flatnonzero(~first).tolist():
        first[i] = content(i) != content(leader[i])
    return rows, texts, text, start, size, key, mark, mark2, first


def _digests(texts, text, start, size) -> np.ndarray:
    """128-bit digests of the given stretches, as two columns of 64 bits."""
    found = b"".join(hashlib.blake2b(texts[t][s : s + z], digest_size=16).digest() for t, s, z in zip(text.tolist(), start.tolist(), size.tolist()))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _key_counts(docs: DataFrame, length: int) -> DataFrame:
    """(key, n) of the keys with several contents or in several batches: a batch counts each content once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = _batch_segments(batch, length)
            if found is not None:
                key, n = np.unique(found[5][found[8]].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int32))], ["key", "n"])

    return docs.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by row and start, whose ends ascend in a row; those that touch become one."""
    if not len(row):
        return row, start, end
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return row[at], start[at], end[np.append(at[1:], len(row)) - 1]


def _places(docs: DataFrame, length: int, several, hot) -> DataFrame:
    """(key, mark, mark2, row, start, end, again): segments that are the first of their content in a batch, if their key is one of several and
    not hot; the marks are a digest of the content. Of a hot key every window stands by itself, and its digest is its key as well.
    again: spans of the others of the batch, which have their row for a key."""
    names = ["key", "mark", "mark2", "row", "start", "end", "again"]

    def places(key, digest, row, start, end, again):
        columns = [pa.array(x) for x in (key, digest[:, 0].copy(), digest[:, 1].copy(), row, start.astype(np.int32), end.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(key), again))], names)

    def spans(row, start, end):
        own = _merged(row, start, end)
        return places(own[0], np.zeros((len(own[0]), 2), dtype=np.int64), *own, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = _batch_segments(batch, length)
            if found is None:
                continue
            rows, texts, text, start, size, key, _, _, first = found
            again = ~first
            yield spans(rows[text[again]], start[again], start[again] + size[again])
            is_hot = passes(hot.value, key)
            at = np.flatnonzero(first & ~is_hot & passes(several.value, key))
            for own in np.split(at, range(1 << 16, len(at), 1 << 16)):
                yield places(key[own].view(np.int64), _digests(texts, text[own], start[own], size[own]), rows[text[own]], start[own], start[own] + size[own], False)
            at = np.flatnonzero(first & is_hot)
            for own in np.split(at, range(1 << 10, len(at), 1 << 10)):
                n = size[own] - length + 1
                begin = np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = rows[np.repeat(text[own], n)]
                digest = _digests(texts, np.repeat(text[own], n), begin, np.full(len(begin), length))
                new = np.zeros(len(begin), dtype=bool)
                new[np.unique(digest, axis=0, return_index=True)[1]] = True
                yield places(digest[new, 0].copy(), digest[new], row[new], begin[new], begin[new] + length, False)
                yield spans(row[~new], begin[~new], begin[~new] + length)

    return docs.mapInArrow(run, "key long, mark long, mark2 long, row long, start int, end int, again boolean")


def _contents(docs: DataFrame, length: int, keys, hot) -> DataFrame:
    """(key, mark, mark2, row, start, content) of the segments whose key passes the filter and is not hot, each content once a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = _batch_segments(batch, length)
            if found is None:
                continue
            rows, texts, text, start, size, key, mark, mark2, first = found
            at = np.flatnonzero(first & passes(keys.value, key) & ~passes(hot.value, key))
            for lo in range(0, len(at), 1 << 16):
                own = at[lo : lo + (1 << 16)]
                data = [texts[t][s : s + z] for t, s, z in zip(text[own].tolist(), start[own].tolist(), size[own].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[own].view(np.int64)) for x in (key, mark, mark2)), pa.array(rows[text[own]]),
                     pa.array(start[own].astype(np.int32)), pa.array(data, pa.binary())], ["key", "mark", "mark2", "row", "start", "content"])

    return docs.mapInArrow(run, "key long, mark long, mark2 long, row long, start int, content binary")


def shard_spans(rows: np.ndarray, starts: np.ndarray, contents: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) covered by windows of the contents that start earlier elsewhere in the shard."""
    order = np.lexsort((starts, rows))
    rows, starts, contents = rows[order], starts[order], [contents[i] for i in order]
    shard, pos, lcp = suffix_order(contents, length)
    group = np.cumsum(lcp < length)
    owner = np.searchsorted(shard.starts, pos, side="right") - 1
    sizes = np.array([len(c) for c in contents])
    whole = np.flatnonzero((owner < len(contents)) & (pos - shard.starts[owner] + length <= np.append(sizes, 0)[owner]))
    pos, group = pos[whole], group[whole]
    if not len(pos):
        return rows[:0], starts[:0], starts[:0]
    # Contents lie in the order of rows and starts, so the least position of a group is its earliest occurrence.
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    earliest = np.repeat(np.minimum.reduceat(pos, cuts), np.diff(np.append(cuts, len(pos))))
    later = np.sort(pos[pos != earliest])
    owner = np.searchsorted(shard.starts, later, side="right") - 1
    begin = starts[owner] + (later - shard.starts[owner])
    return _merged(rows[owner], begin.astype(np.int64), (begin + length).astype(np.int64))


def _sorted_shards(contents: DataFrame, length: int) -> DataFrame:
    """(row, start, end) from shards of contents, each key in one shard. A shard ends at the first key beyond SHARD_BYTES."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            if len(held) > 1:
                row, start, end = shard_spans(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["row", "start", "end"])

        for batch in batches:
            for key, mark, mark2, row, start, content in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if last is not None and last[0] != key and size >= SHARD_BYTES:
                    yield from flush()
                    held, size = [], 0
                if last != (key, content):  # of one content the first occurrence is enough; equal ones have equal marks
                    held.append((row, start, content))
                    size += len(content)
                last = (key, content)
        yield from flush()

    return contents.repartition("key").sortWithinPartitions("key", "mark", "mark2", "row", "start").mapInArrow(run, "row long, start int, end int")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): row is a whole number in the order of ids; the ids themselves where they are whole numbers, present and unique."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    if isinstance(docs.schema[id_col].dataType, (LongType, IntegerType, ShortType)):
        odd = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
        if not odd.take(1):
            return texts.select(F.col("id").cast("long").alias("row"), "id", "text")
    ordered = texts.repartitionByRange("id", F.md5("text")).sortWithinPartitions("id", F.md5("text"))
    return stage(ordered.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "documents")


def repeated_spans(numbered: DataFrame, length: int) -> DataFrame:
    """(row, start, end): every byte that a string of `length` bytes covers that starts earlier, too; spans may overlap.

    A window is known by the hash of its least seed, so equal windows have equal keys; runs of windows with one seed are segments. Keys are
    counted first, and a filter of fixed size keeps those out that occur once, which most do: nothing else of them is ever written. Of segments
    with equal content all but the first are spans as they are: first within a batch, compared byte by byte, before anything is shuffled, then
    among all, by a 128-bit digest. Keys with several contents are open: their segments are sent, each content once a batch, and the suffixes of a shard of them are sorted by external
    induction; windows with a common prefix of `length` stand together, and all but the earliest are spans. A key with more than HOT
    contents never meets in one task: each of its windows goes by its own 128-bit digest, as a segment does.
    """
    docs, spark = numbered.select("row", "text"), numbered.sparkSession
    counts = stage(_key_counts(docs, length), "keys")
    several, hot = (spark.sparkContext.broadcast(bit_filter(counts.filter(F.col("n") > least), "key")) for least in (1, HOT))
    by_key = Window.partitionBy("key", "again").orderBy("mark", "mark2", "row", "start")
    all_of = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = (F.lag("mark").over(by_key) == F.col("mark")) & (F.lag("mark2").over(by_key) == F.col("mark2"))
    differ = [F.min(c).over(all_of) != F.max(c).over(all_of) for c in ("mark", "mark2")]
    met = _places(docs, length, several, hot).withColumn("copy", F.col("again") | F.coalesce(same, F.lit(False))).withColumn("open", differ[0] | differ[1])
    met = stage(met.filter("copy OR open").select("key", "row", "start", "end", "copy", "open"), "segments")
    keys = spark.sparkContext.broadcast(bit_filter(met.filter("open"), "key"))
    contents = _contents(docs, length, keys, hot)
    return met.filter("copy").select("row", "start", "end").unionByName(_sorted_shards(contents, length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per document row: its id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a document with a smaller id, or earlier in the same document.
    Occurrences may overlap, never cross documents, and are judged on the input. n_spans counts maximal removed runs. Null counts as empty. Rows
    that repeat an id are documents of their own, ordered by the text's MD5; null ids come first. Other columns are not looked at. Texts
    shorter than `length` and empty tables are kept as they are.
    """
    numbered = _numbered(docs, id_col, text_col)
    spans = repeated_spans(numbered, length).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # bounded by the text
    joined = numbered.join(spans, "row", "left").select("id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out = []
                for text, starts, ends in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    size, kept, n, at = len(text), [], 0, 0
                    for s, e in sorted(zip(starts or (), ends or ())):
                        if s > at or (n == 0):
                            kept.append(text[at:s])
                            n += 1
                        at = max(at, e)
                    kept = b"".join([*kept, text[at:]])
                    out.append((size, size - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
                columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns[: 4 + with_text]], schema.names)

    return joined.mapInArrow(run, schema)
