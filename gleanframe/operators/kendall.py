"""Kendall tau-b of many column pairs, exactly, without comparing rows pairwise.

First a bound: every column is cut into a few buckets, and the counts of all pairs of buckets, one scan for all pairs of columns,
tell how many pairs of rows are discordant at least. Only pairs of columns that can still reach what is asked for go on.

For those, rows collapse to distinct (x, y) with counts. Large pairs are cut into slices of x and slices of y. Two cells in one slice
of x are compared by merging there, in n log n; two in one slice of y but not of x are merged in that slice, where only the number of
the slice of x counts; the order of all others follows from the numbers of both their slices, so from one table of counts. Each pair
of cells is counted at exactly one of these. An x that fills a slice alone has nothing to count inside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.operators.materialise import spread_out, staged

# Distinct (x, y) that one task merges, and slices of a pair at most; beyond, slices grow.
SLICE_CELLS, MOST_SLICES = 1 << 20, 1024
# Buckets of a column for the bound, column pairs counted in one scan, and pairs whose rows are expanded at a time.
GRID, PAIRS_A_SCAN, PAIRS_AT_ONCE = 16, 5_000, 8


def discordant(grid: np.ndarray) -> np.ndarray:
    """Per GRID x GRID table of row counts: how many pairs of rows are surely discordant, x in a higher bucket and y in a lower."""
    lower_x = np.cumsum(grid, axis=1) - grid
    higher_y = np.cumsum(lower_x[:, :, ::-1], axis=2)[:, :, ::-1] - lower_x
    return (grid * higher_y).sum(axis=(1, 2))


def tau_bound(grid: np.ndarray) -> np.ndarray:
    """An upper bound of tau-b per table.

    Of the N pairs of rows, those untied in x are at most N, those untied in y too; let m be the lesser number. Then
    C - D <= m - 2 D, and tau-b, which divides by the geometric mean of the two numbers, is at most 1 - 2 D / m <= 1 - 2 D / N.
    """
    n = grid.sum(axis=(1, 2))
    return np.where(n > 1, 1 - 2 * discordant(grid) / np.maximum(n * (n - 1) / 2, 1), 0.0)


def within_reach(
    df: DataFrame, columns: Mapping[str, Column], pairs: Sequence[tuple[str, str]], at_least: float
) -> list[tuple[str, str]]:
    """The pairs whose bound leaves room for at_least. Two scans: bucket borders, and counts of pairs of buckets."""
    used = sorted({n for p in pairs for n in p})
    marks = [k / GRID for k in range(1, GRID)]
    cuts: dict[str, list] = {}
    for at in range(0, len(used), 100):
        batch = used[at : at + 100]
        row = df.agg(*[F.percentile_approx(columns[n], marks, 1000).alias(f"c{i}") for i, n in enumerate(batch)]).first()
        cuts |= {n: sorted(set(row[f"c{i}"] or [])) for i, n in enumerate(batch)}
    place = {n: i for i, n in enumerate(used)}
    # Values go to their buckets by numpy: as expressions, the borders of a dozen columns make a method too large to be compiled.
    values = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(used)])
    borders, wide = [np.array(cuts[n], dtype=float) for n in used], GRID + 1
    out: list[tuple[str, str]] = []
    for at in range(0, len(pairs), PAIRS_A_SCAN):
        batch = pairs[at : at + PAIRS_A_SCAN]
        sides = [(place[a], place[b]) for a, b in batch]

        def count(batches: Iterator[pa.RecordBatch], sides=sides) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(sides), wide * wide), dtype=np.int64)
            for rows in batches:
                code = []
                for c, own in zip(rows.columns, borders):
                    code.append(np.searchsorted(own, c.to_numpy(zero_copy_only=False), side="right"))
                    code[-1][c.is_null().to_numpy(zero_copy_only=False)] = GRID  # a bucket of its own, left out below
                for k, (a, b) in enumerate(sides):
                    total[k] += np.bincount(code[a] * wide + code[b], minlength=wide * wide)
            total = total.reshape(-1, wide, wide)[:, :GRID, :GRID].reshape(len(sides), GRID * GRID)
            pair, cell = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair, pa.int32()), "cell": pa.array(cell, pa.int32()), "n": pa.array(total[pair, cell])})

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                grid = np.zeros((rows.num_rows, GRID * GRID))
                for k, cells in enumerate(rows.column(1).to_pylist()):
                    for c in cells:
                        grid[k, c["cell"]] = c["n"]
                fits = tau_bound(grid.reshape(-1, GRID, GRID)) >= at_least - 1e-9
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(fits))], ["pair"])

        counts = values.mapInArrow(count, "pair int, cell int, n bigint").groupBy("pair", "cell").agg(F.sum("n").alias("n"))
        tables = counts.groupBy("pair").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
        out += [batch[k] for k in sorted(r["pair"] for r in tables.mapInArrow(bound, "pair int").collect())]
    return out


def kendall_tau(
    df: DataFrame, columns: Mapping[str, Column], pairs: Sequence[tuple[str, str]], n_rows: int | None = None, at_least: float | None = None,
) -> dict[tuple[str, str], float]:
    """tau-b over the rows where both columns are present; 0 where it is undefined.

    With at_least, pairs that provably stay below it are left out. The others' rows are expanded a few pairs at a time.
    """
    pairs = list(pairs)
    if at_least is not None and at_least > 0:
        pairs = within_reach(df, columns, pairs, at_least)
    out: dict[tuple[str, str], float] = {}
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        out |= _exact(df, columns, pairs[at : at + PAIRS_AT_ONCE])
    return out


def _exact(df, columns, pairs):
    used = sorted({n for p in pairs for n in p})
    alias = {n: f"c{i}" for i, n in enumerate(used)}
    slots = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(alias[a]), F.col(alias[b])
        slots.append(F.when(x.isNotNull() & y.isNotNull(),
                            F.struct(F.lit(i).alias("p"), x.alias("x"), y.alias("y"))))
    cells = staged(
        spread_out(df.select(*[columns[n].alias(alias[n]) for n in used]))
        .select(F.explode(F.array(*slots)).alias("s")).filter("s IS NOT NULL")
        .groupBy(F.col("s.p").alias("p"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Row counts squared pass 2^63, hence the decimals.
    def choose2(n: Column) -> Column:
        wide = n.cast("decimal(19,0)")
        return F.sum((wide * (wide - 1)).cast("decimal(38,0)"))

    sizes = {r["p"]: r for r in cells.groupBy("p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect()}
    ties_x, ties_y = ({r["p"]: r["t"] for r in cells.groupBy("p", c).agg(F.sum("n").alias("n")).groupBy("p").agg(choose2(F.col("n")).alias("t")).collect()}
                      for c in ("x", "y"))
    parts = _sliced(cells, max((r["cells"] for r in sizes.values()), default=0))
    scores: dict[int, Decimal] = {}
    for part in parts:
        for r in part.groupBy("p").agg(F.sum("s").alias("s")).collect():
            scores[r["p"]] = scores.get(r["p"], Decimal(0)) + r["s"]

    out = {}
    for i, pair in enumerate(pairs):
        n = Decimal(sizes[i]["n"] if i in sizes else 0)
        all_pairs = n * (n - 1) / 2
        # choose2 summed n(n-1), twice the number of tied pairs.
        rest = (all_pairs - (ties_x.get(i) or Decimal(0)) / 2) * (all_pairs - (ties_y.get(i) or Decimal(0)) / 2)
        out[pair] = float((scores.get(i) or Decimal(0)) / rest.sqrt()) if rest > 0 else 0.0
    return out


def _sliced(cells: DataFrame, largest: int) -> list[DataFrame]:
    """Tables of ``(p, s)`` whose sums are the concordant less the discordant pairs of rows of p."""
    n = min(MOST_SLICES, -(-largest // SLICE_CELLS))
    if n < 2:
        return [_inside(cells.withColumn("at", F.lit(0)))]
    marks, cuts = [k / n for k in range(1, n)], {}
    for r in cells.groupBy("p").agg(*[F.percentile_approx(c, marks, 20 * n).alias(c) for c in ("x", "y")]).collect():
        many = sorted({a for a, b in zip(r["x"], r["x"][1:]) if a == b})
        cuts[r["p"]] = sorted({*r["x"], *(math.nextafter(float(x), math.inf) for x in many)}), sorted(set(r["y"])), many
    placed = _placed(cells, cuts)
    # Of a slice of y, the cells of one y and one slice of x count as one, so a frequent y makes no large slice.
    beside = placed.groupBy("p", "at", "low", "y").agg(F.sum("n").alias("n")).select(
        "p", F.col("low").alias("at"), F.col("at").cast("double").alias("x"), "y", "n")
    return [_inside(placed.filter("NOT alone")), _inside(beside), _across(placed)]


def _placed(cells: DataFrame, cuts: Mapping[int, tuple[list, list, list]]) -> DataFrame:
    """cells with ``at`` and ``low``, the numbers of their slices of x and y, and ``alone``: x fills its slice."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, x, y = (batch.column(k).to_numpy() for k in range(3))
            at, low, alone = np.zeros(len(p), np.int32), np.zeros(len(p), np.int32), np.zeros(len(p), bool)
            for name in np.unique(p).tolist():
                own, (of_x, of_y, many) = p == name, cuts[name]
                at[own], low[own] = np.searchsorted(of_x, x[own], side="right"), np.searchsorted(of_y, y[own], side="right")
                alone[own] = np.isin(x[own], many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(low), pa.array(alone)], names)

    rows = cells.select("p", "x", "y", "n")
    names = [*rows.columns, "at", "low", "alone"]
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("at int, low int, alone boolean").fields])
    return rows.mapInArrow(place, schema)


def concordance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Concordant less discordant pairs of rows, where cell k stands for n[k] rows. Binary digits of x's position, highest first;
    the cells lie in (block, y) order throughout."""
    order = np.argsort(y, kind="stable")
    x, y, n = np.unique(x, return_inverse=True)[1][order], y[order], n[order]
    exact = n if float(n.sum()) < 2.0**31 else n.astype(object)
    total, rows = 0, np.arange(len(x))
    for level in reversed(range(int(x.max()).bit_length())):
        block, one = x >> (level + 1), ((x >> level) & 1) == 1
        zeros = np.where(one, 0, n)
        upto = np.cumsum(zeros)
        new_block = np.diff(block, prepend=-1) != 0
        new_y = new_block | (np.diff(y, prepend=y[0]) != 0)
        first_block, first_y = (np.maximum.accumulate(np.where(new, rows, 0)) for new in (new_block, new_y))
        last_block, last_y = (np.append(np.flatnonzero(new)[1:], len(x))[np.cumsum(new) - 1] - 1 for new in (new_block, new_y))
        earlier = upto - zeros
        lead = (earlier[first_y] - earlier[first_block]) - (upto[last_block] - upto[last_y])
        total += int(np.dot(exact[one], lead[one]))
        order = np.argsort(x >> level, kind="stable")
        x, y, n, exact = x[order], y[order], n[order], exact[order]
    return total


def _inside(cells: DataFrame) -> DataFrame:
    """``(p, s)``: per slice, its concordant less its discordant pairs of rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def score() -> Iterator[pa.RecordBatch]:
            if held:
                x, y, n = (np.concatenate(v) for v in zip(*held))
                yield pa.RecordBatch.from_pydict({"p": pa.array([now[0]], pa.int32()), "s": pa.array([str(concordance(x, y, n))])})

        for batch in batches:
            p, at, x, y, n = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(p)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if (name := (int(p[start]), int(at[start]))) != now:
                    yield from score()
                    now, held = name, []
                held.append((x[start:end], y[start:end], n[start:end]))
        yield from score()

    dealt = cells.select("p", "at", "x", "y", "n").repartition("p", "at").sortWithinPartitions("p", "at")
    return dealt.mapInArrow(merge, "p int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))


def grid_concordance(grid: np.ndarray) -> int:
    """Concordant less discordant pairs of rows that differ in both places of a table of row counts."""
    exact = grid if float(grid.sum()) < 2.0**31 else grid.astype(object)
    lower_x = np.cumsum(exact, axis=0) - exact
    upto_y = np.cumsum(lower_x, axis=1)
    return int((exact * (upto_y - lower_x - (upto_y[:, -1:] - upto_y))).sum())


def _across(placed: DataFrame) -> DataFrame:
    """``(p, s)``: concordant less discordant pairs of rows that differ in both slices; a task has the counts of one p."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            p, *rest = (c.to_numpy() for c in batch.columns)
            for name in np.unique(p).tolist():
                held.setdefault(name, []).append([c[p == name] for c in rest])
        for name, parts in held.items():
            at, low, n = (np.concatenate(c) for c in zip(*parts))
            grid = np.zeros((at.max() + 1, low.max() + 1), dtype=np.int64)
            grid[at, low] = n
            yield pa.RecordBatch.from_pydict({"p": pa.array([name], pa.int32()), "s": pa.array([str(grid_concordance(grid))])})

    counts = placed.groupBy("p", "at", "low").agg(F.sum("n").alias("n")).repartition("p")
    return counts.mapInArrow(score, "p int, s string").withColumn("s", F.col("s").cast("decimal(38,0)"))
