"""Spelling variants: words one edit apart, found by k-d trees over letter counts, and the form that each variant stands for."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import stage
from gleanframe.llm.words import as_bytes

LETTERS = "[A-Za-zÀ-ÿ]"
#: Coordinates of a word: a-z, and all other code points by their remainder.
DIMENSIONS, OTHERS = 32, 6
#: Counts beyond this count as this, which brings vectors no further apart.
MOST = 100
#: Characters of a text looked at in one step; distinct words a task holds before it hands their counts on.
STEP, HELD = 1 << 20, 200_000
#: Words that a cell holds, at most this many sampled words fit the cells, words in a leaf, queries searched for at a time.
CELL, SAMPLE, LEAF, BATCH = 4096, 200_000, 48, 1 << 14


def runs_of(text: str, pattern: re.Pattern, other: re.Pattern) -> Iterator[list[str]]:
    """All matches of pattern, in lists; long texts are cut where other matches, which ends any run."""
    at = 0
    while at < len(text):
        cut = other.search(text, at + STEP) if len(text) - at > STEP else None
        end = cut.start() if cut else len(text)
        yield pattern.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, noise: int | None) -> DataFrame:
    """(word, n): counted per text and per task, and then by word."""
    pattern, other = re.compile(LETTERS + "{%d,}" % least_length), re.compile(LETTERS.replace("[", "[^", 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                start = zlib.crc32(f"{key or ''}:".encode())
                # bytes.lower changes A-Z alone.
                for found in runs_of((text or b"").lower().decode("utf-8", "replace"), pattern, other):
                    for run, n in Counter(found).items():
                        if noise:
                            h = zlib.crc32(run.encode(), start)
                            if h % noise == 0:
                                gone = h % len(run)
                                run = run[:gone] + run[gone + 1 :]
                                if len(run) < least_length:
                                    continue
                        held[run] += n
                    if len(held) > HELD:
                        yield rows()
                        held.clear()
        yield rows()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """int8 (words, DIMENSIONS). One edit changes one coordinate by one, or two by one each: L1 distance at most two."""
    place = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % OTHERS).astype(np.int64)
    out = np.empty((len(codes), DIMENSIONS), dtype=np.int8)
    for at in range(0, len(codes), BATCH):
        part = place[at : at + BATCH] + np.arange(min(BATCH, len(codes) - at))[:, None] * DIMENSIONS
        out[at : at + BATCH] = np.minimum(np.bincount(part.ravel(), minlength=DIMENSIONS * (len(part))).reshape(-1, DIMENSIONS), MOST)
    return out


class Tree(NamedTuple):
    """A k-d tree. Node k holds counts[axis] <= cut to the left; a leaf has axis -1 and its number in left."""

    axis: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    members: list[np.ndarray]  #: of each leaf: the rows it was built from


def grow(counts: np.ndarray, leaf: int) -> Tree:
    """Splits the widest-spread coordinate nearest its median, down to leaf rows or rows that are all alike."""
    tree = Tree([], [], [], [], [])
    todo = [(np.arange(len(counts)), -1, False)]
    while todo:
        rows, parent, is_right = todo.pop()
        node = len(tree.axis)
        if parent >= 0:
            (tree.right if is_right else tree.left)[parent] = node
        axis = cut = -1
        if len(rows) > leaf:
            own = counts[rows]
            axis = int(np.argmax(own.astype(np.float32).var(axis=0)))
            values, n = np.unique(own[:, axis], return_counts=True)
            if len(values) > 1:
                cut = int(values[np.argmin(np.abs(np.cumsum(n)[:-1] - len(rows) / 2))])
            else:
                axis = -1
        for column, value in ((tree.axis, axis), (tree.cut, cut), (tree.right, -1)):
            column.append(value)
        if axis < 0:
            tree.left.append(len(tree.members))
            tree.members.append(rows)
            continue
        tree.left.append(-1)
        low = counts[rows, axis] <= cut
        todo += [(rows[low], node, False), (rows[~low], node, True)]
    return tree


def search(tree: Tree, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of counts) for every leaf whose box holds a vector with at most more added and less taken away."""
    whole = np.zeros(len(counts), dtype=np.int16)
    todo = [(0, np.arange(len(counts)), whole, whole, {}, {})]
    while todo:
        node, rows, up, down, low, high = todo.pop()
        axis, cut = tree.axis[node], tree.cut[node]
        if axis < 0:
            yield tree.left[node], rows
            continue
        own = counts[rows, axis].astype(np.int16)
        # What leads into a half adds to what led into the box, but for what this coordinate had needed already.
        gone = down + np.maximum(own - cut, 0) - (np.maximum(own - high[axis], 0) if axis in high else 0)
        come = up + np.maximum(cut + 1 - own, 0) - (np.maximum(low[axis] - own, 0) if axis in low else 0)
        fits = gone <= less
        if fits.any():
            todo.append((tree.left[node], rows[fits], up[fits], gone[fits], low, {**high, axis: cut}))
        fits = come <= more
        if fits.any():
            todo.append((tree.right[node], rows[fits], come[fits], down[fits], {**low, axis: cut + 1}, high))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, of which one may be a code point longer, differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    size = a.shape[1]

    def agreeing(same: np.ndarray) -> np.ndarray:
        return np.where(same.all(axis=1), size, np.argmin(same, axis=1))

    return agreeing(a == b[:, :size]) + agreeing((a == b[:, 1:])[:, ::-1]) >= size


def sharing_a_half(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that agree in their first or their last half: one edit leaves one of the two as it was."""
    size = min(a.shape[1], b.shape[1])
    half, found = size // 2, []
    for x, y in ((a[:, :half], b[:, :half]), (a[:, a.shape[1] - size + half :], b[:, b.shape[1] - size + half :])):
        keys = np.ascontiguousarray(np.concatenate([x, y]))
        key = np.unique(keys.view([("", keys.dtype)] * keys.shape[1]).ravel(), return_inverse=True)[1]
        own, theirs = key[: len(a)], key[len(a) :]
        order = np.argsort(theirs, kind="stable")
        first, last = np.searchsorted(theirs[order], own), np.searchsorted(theirs[order], own, side="right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found.append(np.stack([np.repeat(np.arange(len(a)), n), order[at]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


class Cell:
    """The words of one cell, all of one length, in a k-d tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words, self.n = [words[i] for i in order], n[order]
        self.codes = letters(self.words)
        self.counts = letter_counts(self.codes)
        self.tree = grow(self.counts, LEAF)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row of words, row of the cell) of all pairs one edit apart. words have one length."""
        codes = letters(words)
        counts, apart = letter_counts(codes), codes.shape[1] - self.codes.shape[1]
        mine, theirs = [], []
        for leaf, rows in search(self.tree, counts, int(apart <= 0), int(apart >= 0)):
            members = self.tree.members[leaf]
            if len(members) > LEAF:  # words of the same letters, which no box tells apart
                a, b = sharing_a_half(codes[rows], self.codes[members])
            else:
                far = np.abs(counts[rows][:, None] - self.counts[members]).sum(axis=2, dtype=np.int16)
                a, b = np.nonzero(far <= 2 - abs(apart))
            a, b = rows[a], members[b]
            fits = one_edit(codes[a], self.codes[b])
            mine.append(a[fits])
            theirs.append(b[fits])
        return np.concatenate(mine), np.concatenate(theirs)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    return {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}


def fit_cells(words: DataFrame, total: int) -> dict[int, Tree]:
    """A tree per word length, fitted on the at most SAMPLE words that come first in hash order."""
    some = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").collect()]
    leaf = max(16, CELL * len(some) // max(total, 1))
    trees = {}
    for size, own in by_length(some).items():
        tree = grow(letter_counts(letters([some[i] for i in own])), leaf)
        trees[size] = tree._replace(members=[])
    return trees


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(cell, asks, word, n): each word once in its own cell, and once as a query in every cell that a neighbour may lie in.

    A length that the sample lacks is one cell.
    """
    single = Tree([-1], [-1], [0], [-1], [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for size, own in by_length(names).items():
                for part in np.split(own, range(BATCH, len(own), BATCH)):
                    counts = letter_counts(letters([names[i] for i in part]))
                    for other in (size - 1, size, size + 1):
                        step = other - size
                        for leaf, rows in search(trees.get(other, single), counts, int(step >= 0), int(step <= 0)):
                            yield rows_of(batch, other, leaf, 1, part[rows])
                    for leaf, rows in search(trees.get(size, single), counts, 0, 0):
                        yield rows_of(batch, size, leaf, 0, part[rows])

    def rows_of(batch, size, leaf, asks, rows):
        cell = pa.array(np.full(len(rows), (size << 32) + leaf), pa.int64())
        taken = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([cell, pa.array(np.full(len(rows), asks), pa.int32()), *taken.columns], ["cell", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(deal, "cell long, asks int, word string, n long")


def neighbours(cells: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): what a word's query finds in one cell; the fullest neighbour, the smallest of ties."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, n, cell = None, [], [], None
        for batch in batches:
            ids, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if ids[a] != now:
                    now, words, n, cell = ids[a], [], [], None
                part, size = batch.slice(a, b - a), int(now) >> 32
                if not asks[a]:
                    words += part.column(2).to_pylist()
                    n.append(part.column(3).to_numpy())
                    continue
                if not words:
                    continue
                cell = cell or Cell(words, np.concatenate(n))
                names = part.column(2).to_pylist()
                for _, own in by_length(names).items():
                    for rows in np.split(own, range(BATCH, len(own), BATCH)):
                        asked = [names[i] for i in rows]
                        mine, theirs = cell.near(asked)
                        # The cell is in code-point order: of the fullest the first is the smallest.
                        order = np.lexsort((theirs, -cell.n[theirs], mine))
                        mine, theirs = mine[order], theirs[order]
                        first = np.flatnonzero(np.diff(mine, prepend=-1))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([asked[i] for i in mine[first]], pa.string()),
                            pa.array(np.diff(np.append(first, len(mine))), pa.int64()),
                            pa.array([cell.words[i] for i in theirs[first]], pa.string()),
                            pa.array(cell.n[theirs[first]], pa.int64())], ["word", "n_near", "form", "form_n"])

    return cells.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(
        look, "word string, n_near long, form string, form_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: pointers are doubled until none moves. Counts rise along a chain, so it ends."""
    links = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        step = links.join(links.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stage(step, "links")
        if not step.filter("moved").take(1):
            return step.select("word", "root")
        links = step.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                      times: int = 5, noise: int | None = None) -> DataFrame:
    """One row per distinct word of docs: word, n, n_near, form, form_n, root.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, of at least least_length code points
    and least_count occurrences. Two words are near if one code point inserted, deleted or replaced makes one the other. A word's
    form is its near word of largest n (ties: the smallest in code-point order) if that is at least times the word's n; root is
    the last of the chain of forms, the word itself without any. With noise, a run whose CRC-32 of "<id>:<run>" it divides loses
    one code point first, which plants misspellings.

    Null and empty texts have no words, a null id counts as empty, repeated rows count again, texts of any length are read in
    steps, an empty table gives an empty result; other columns are not looked at.

    Words are counted per task before they are shuffled. Letter counts (a-z, and six coordinates for all others) span a k-d tree
    per word length, fitted on a sample of at most SAMPLE words; every word goes to the cell it lies in, and as a query to the
    cells whose box is within its reach: one count up and one down for words of its length, one up or one down for those one
    longer or shorter. A cell's words form a tree of their own, whose boxes are pruned alike; at the leaves the letters' order is
    compared. Words of the same letters, which no box divides, meet on equal halves. Queries stream past a cell in batches; what
    a query finds is one row. A word's cells are disjoint, so no neighbour counts twice.
    """
    words = stage(word_counts(docs, id_col, text_col, least_length, least_count, noise), "words")
    total = words.count()
    cells = dealt(words.repartition(total // 30_000 + 1, "word"), fit_cells(words, total))
    none = [F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")]
    found = neighbours(cells).withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", "n", *none))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))))
    facts = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    form = -F.col("best.n") >= times * F.col("n")
    forms = stage(facts.select("word", "n", "n_near", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
