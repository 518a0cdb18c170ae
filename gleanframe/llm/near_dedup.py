"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, verified overlaps, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import components, stage
from gleanframe.llm.decontaminate import bit_filter, passes
from gleanframe.llm.words import BASE, Words, as_bytes, mix, shingles, word_groups

BANDS, ROWS = 24, 5
TEXT_BITS = np.uint64(16)  #: a group holds fewer than 2^16 texts


def bags(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of every text of a group, sorted; a text with fewer than width words is one shingle."""
    text_of = np.repeat(np.arange(len(words.bounds) - 1, dtype=np.uint64), np.diff(words.bounds))
    at, hashes = shingles(words, width)
    texts = [text_of[at]]
    parts = [hashes]
    for size in range(1, width):
        short = np.flatnonzero(np.diff(words.bounds) == size)
        if len(short):
            total = np.zeros(len(short), dtype=np.uint64)
            for k in range(size):
                total = total * np.uint64(BASE) + words.hashes[words.bounds[short] + k]
            texts.append(short.astype(np.uint64))
            parts.append(mix(total + np.uint64(size)))
    keys = (np.concatenate(texts) << (np.uint64(64) - TEXT_BITS)) | (np.concatenate(parts) >> TEXT_BITS)
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> (np.uint64(64) - TEXT_BITS)).astype(np.int64), (keys << TEXT_BITS) >> TEXT_BITS, counts


def bag_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n bags given as sorted (text, element, weight) with whole weights from 1.

    Weights are discretised at the whole numbers; the levels are grouped in layers (0, 1], (1, 2], (2, 4], (4, 8] and so on. Each
    (element, layer) has a Poisson process whose rate is the layer's length, with points drawn in ascending order from a
    generator seeded by element and layer alone; a point belongs to one level of the layer and to one of m places. A bag's value
    at a place is the first point there whose level its weight reaches, so two bags agree at a place with the probability
    sum(min) / sum(max). A process ends for a bag when its next point is later than all of the bag's values. Of a layer
    that a weight covers in part, points of unreached levels are passed over; at most as many as the weight's lower layers make.
    """
    seeds, lows, tops, texts, rates = [], [], [], [], []
    layer, low, length = 0, 0, 1
    while True:
        reach = weight > low
        if not reach.any():
            break
        seeds.append(mix(element[reach] * np.uint64(BASE) + np.uint64(layer)))
        texts.append(text[reach])
        lows.append(np.full(int(reach.sum()), low, dtype=np.int64))
        rates.append(np.full(int(reach.sum()), float(length)))
        tops.append(weight[reach])
        layer, low, length = layer + 1, low + length, max(1, low + length)
    out = np.full(n * m, np.inf)
    if not seeds:
        return out.reshape(n, m)
    seed, text, low, top, rate = (np.concatenate(x) for x in (seeds, texts, lows, tops, rates))
    order = np.argsort(text, kind="stable")
    seed, text, low, top, rate = (x[order] for x in (seed, text, low, top, rate))
    time = np.zeros(len(seed))
    table = out.reshape(n, m)
    while len(seed):
        seed = seed + np.uint64(0xD1342543DE82EF95)
        draw = mix(seed)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        other = mix(draw)
        place = ((other >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        level = low + 1 + ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate).astype(np.int64)
        hit = level <= top
        np.minimum.at(out, text[hit] * m + place[hit].astype(np.int64), time[hit])
        firsts = np.flatnonzero(np.diff(text, prepend=-1))
        last = np.repeat(table[text[firsts]].max(axis=1), np.diff(np.append(firsts, len(text))))
        on = time < last
        seed, text, low, top, rate, time = (x[on] for x in (seed, text, low, top, rate, time))
    return table


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        total = mix(total * np.uint64(BASE) + bits[:, :, k])
    return total


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, bands) per row; the digest is the text's MD5, and a text without words has no bands."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), _digest(text_col), F.col(text_col).cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in word_groups(as_bytes(batch.column(2))):
                n = len(group.bounds) - 1
                text, element, count = bags(group, width)
                keys = band_keys(bag_min_hash(text, element, count, n, bands * rows), bands, rows).view(np.int64)
                full = np.diff(group.bounds) > 0
                offsets = np.cumsum([0, *(full * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, n), batch.column(1).slice(group.first, n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))], ["id", "digest", "bands"])

    return source.mapInArrow(run, f"id {kind}, digest binary, bands array<long>")


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))).alias("digest")


def overlaps(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, bag): for the wanted texts (node, digest) their shingles, each occurrence numbered, as distinct 64-bit values.

    A bit filter of fixed size keeps most other texts from being sent; a join on the digest does the rest. Equal texts are
    merged before the shuffle.
    """
    keys = wanted.select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long").alias("k"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.shiftleft("k", 8).alias("k")), "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(0).to_pylist()
            heads = np.array([int.from_bytes(d[:7], "big") << 8 for d in digests], dtype=np.uint64)
            chosen = np.flatnonzero(passes(bits.value, heads))
            seen: dict[bytes, int] = {digests[i]: i for i in chosen[::-1].tolist()}
            chosen = np.array(sorted(seen.values()), dtype=np.int64)
            texts = as_bytes(batch.column(1).take(pa.array(chosen)))
            for group in word_groups(texts):
                n = len(group.bounds) - 1
                text, element, count = bags(group, width)
                numbered = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                values = mix(np.repeat(element, count) * np.uint64(BASE) + numbered.astype(np.uint64)).view(np.int64)
                offsets = np.searchsorted(np.repeat(text, count), np.arange(n + 1)).astype(np.int32)
                own = chosen[group.first : group.first + n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["digest", "bag"])

    made = docs.select(_digest(text_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "digest binary, bag array<long>")
    return made.join(wanted, "digest").dropDuplicates(["node"]).select("node", "bag")


def _shared(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y))


def _similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, j): sum of minima over sum of maxima of the bags."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("n", _shared("x", "y"))
    return both.select("a", "b", (F.col("n") / (F.size("x") + F.size("y") - F.col("n"))).alias("j"))


def _untried(members: DataFrame, scored: DataFrame, root: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): similar pairs of one bucket that lie in different components.

    All such pairs are decided inside the join, so what comes out is links only. One minus the similarity is a metric: two texts whose
    distances to the bucket's centre differ by more than 1 - threshold are no link, which needs no look at their bags; nor do bags whose sizes differ too much.
    """
    own = members.join(root.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
    far = F.when(F.col("node") == F.col("centre"), 0.0).otherwise(1 - F.coalesce("j", F.lit(0.0)))
    open_ = own.join(mixed, "bucket").join(scored.toDF("node", "centre", "j"), ["node", "centre"], "left").withColumn("far", far)
    open_ = stage(open_.join(sets, "node").select("bucket", "node", "root", "far", "bag"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    least, most = F.least(F.size("x.bag"), F.size("y.bag")), F.greatest(F.size("x.bag"), F.size("y.bag"))
    shared = _shared("x.bag", "y.bag")
    near = ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root"))
            & (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - threshold + 1e-9) & (least >= threshold * most - 1e-9)
            & (shared >= threshold * (least + most - shared) - 1e-9))
    return x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: its id, class_id, class_size, kept.

    A class is a connected component of the relation "weighted Jaccard similarity of the bags of width-word shingles is at least
    threshold"; class_id is its smallest id (a null id only if it has no other), and one row of a class has kept = true. Equal texts are always in one class.
    A text of fewer than width words is one shingle; a text without words (null, empty) is similar to equal texts only, null
    counting as empty. Repeated rows count one by one. Other columns are not looked at.

    Texts are merged by digest, BagMinHash signatures put the distinct ones into bands * rows buckets (with 24 bands of 5, a pair
    at 0.8 shares no bucket with a probability below 0.0001, and less above). In a bucket every member is compared with a centre, the
    member whose buckets are fullest, as the text that copies were made from is. That leaves few components open; pairs of one bucket in different components are then
    all decided inside a join (see _untried), so no link is lost. That last step is quadratic only in members of one bucket that are near the
    threshold but similar to no centre. Overlaps are exact up to 48-bit hashes of shingles within a text.
    """
    sigs = stage(signatures(docs, id_col, text_col, width, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = stage(sigs.groupBy("digest").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
                  .withColumn("node", F.monotonically_increasing_id()), "texts")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    full = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = stage(member.join(full, "bucket"), "members")
    fullness = member.groupBy("node").agg(F.sum("n").alias("s"))
    centre = member.join(fullness, "node").groupBy("bucket").agg(F.max(F.struct("s", "node"))["node"].alias("centre"))
    member = stage(member.join(centre, "bucket").select("bucket", "node", "centre"), "members")
    wanted = member.select("node").distinct().join(nodes, "node").select("node", "digest")
    sets = stage(overlaps(docs, text_col, width, wanted), "bags")
    pairs = member.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    scored = stage(_similarity(pairs, sets), "scores")
    root = components(scored.filter(F.col("j") >= threshold - 1e-9))
    more = _untried(member, scored, root, sets, threshold)
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joined = components(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))

    top = nodes.select("digest", "node").join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("top"))
    classes = top.join(joined.toDF("top", "last"), "top", "left").select("digest", F.coalesce("last", "top").alias("class"))
    placed = stage(sigs.select("id", "row", "digest").join(classes, "digest").select("id", "row", "class"), "classes")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("best")
    whole = placed.groupBy("class").agg(best, F.count(F.lit(1)).alias("class_size"))
    return placed.join(whole, "class").select(
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))
