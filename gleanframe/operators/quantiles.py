"""Exact quantiles in bounded memory.

The built-in exact ``percentile`` keeps every distinct value of a column in one buffer. Here a
bounded sketch first brackets each wanted rank; then the rows below the bracket are counted and the
few distinct values inside it are counted one by one, which gives the exact order statistic. A
bracket that still holds too many rows is narrowed by further passes. A value with many copies
collapses to one counted row, so ties cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
# Distinct values that the last pass may bring to the driver, over all brackets together.
COLLECT_LIMIT = 200_000
COLUMNS_PER_PASS = 50
REFINE_POINTS = 500
# Grid points stay this many times coarser than the sketch's own rank error.
GRID_TO_ERROR = 8


@dataclass
class _Bracket:
    column: str
    rank: int
    lo: float
    hi: float
    n_inside: float
    slack: float = 1.0


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    collect_limit: int = COLLECT_LIMIT,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of double expressions; NULL cells take no part.

    Returns one list per column, aligned with ``probs``; None for a column without values.
    """
    out: dict[str, list[float | None]] = {}
    names = list(columns)
    for i in range(0, len(names), COLUMNS_PER_PASS):
        part = {n: columns[n] for n in names[i : i + COLUMNS_PER_PASS]}
        out.update(_quantiles_of(df, part, list(probs), accuracy, collect_limit))
    return out


def _quantiles_of(df, columns, probs, accuracy, collect_limit):
    names = list(columns)
    alias = {n: f"q{i}" for i, n in enumerate(names)}
    narrow = df.select(*[columns[n].cast("double").alias(alias[n]) for n in names])

    margin = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)} | {0.0, 1.0})
    point_list = F.array(*[F.lit(p) for p in points])
    first = narrow.agg(
        *[F.count(alias[n]).alias(f"n_{alias[n]}") for n in names],
        *[F.percentile_approx(alias[n], point_list, accuracy).alias(f"p_{alias[n]}") for n in names],
    ).first()

    wanted: dict[str, list[tuple[int, int, float]]] = {}
    brackets: dict[tuple[str, int], _Bracket] = {}
    for n in names:
        size = first[f"n_{alias[n]}"]
        wanted[n] = []
        for p in probs:
            if not size:
                continue
            position = p * (size - 1)
            k = math.floor(position)
            upper = min(k + 1, size - 1) if position > k else k
            wanted[n].append((k, upper, position - k))
            sketch = first[f"p_{alias[n]}"]
            lo = sketch[points.index(max(0.0, p - margin))]
            hi = sketch[points.index(min(1.0, p + margin))]
            for r in {k, upper}:
                inside = 0 if lo == hi else min(size, 4 * margin * size + 2)
                brackets.setdefault((n, r), _Bracket(n, r, lo, hi, inside))

    found: dict[tuple[str, int], float] = {}
    while brackets:
        boxes = sorted({(b.column, b.lo, b.hi) for b in brackets.values()})
        budget = collect_limit / max(1, len(boxes))
        if all(b.n_inside <= budget for b in brackets.values()):
            _settle(narrow, alias, boxes, brackets, found)
        else:
            _refine(narrow, alias, boxes, brackets, accuracy)

    result: dict[str, list[float | None]] = {}
    for n in names:
        if not first[f"n_{alias[n]}"]:
            result[n] = [None] * len(probs)
            continue
        values = []
        for k, upper, fraction in wanted[n]:
            a, b = found[(n, k)], found[(n, upper)]
            values.append(a if a == b else a + (b - a) * fraction)
        result[n] = values
    return result


def _settle(narrow, alias, boxes, brackets, found):
    """One scan: rows below each bracket, and a count for every distinct value inside it."""
    slots = []
    for i, (n, lo, hi) in enumerate(boxes):
        x = F.col(alias[n])
        slots.append(
            F.when(
                x <= F.lit(hi),
                F.struct(F.lit(i).alias("box"), F.when(x >= F.lit(lo), x).alias("value")),
            )
        )
    rows = (
        narrow.select(F.explode(F.array(*slots)).alias("s"))
        .filter("s IS NOT NULL")
        .groupBy(F.col("s.box").alias("box"), F.col("s.value").alias("value"))
        .count()
        .collect()
    )
    below = dict.fromkeys(range(len(boxes)), 0)
    inside: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(boxes))}
    for r in rows:
        if r["value"] is None:
            below[r["box"]] += r["count"]
        else:
            inside[r["box"]].append((r["value"], r["count"]))
    index = {box: i for i, box in enumerate(boxes)}
    for key, b in list(brackets.items()):
        i = index[(b.column, b.lo, b.hi)]
        seen = below[i]
        if b.rank < seen:
            brackets[key] = replace(b, lo=-math.inf, hi=b.lo, n_inside=seen + 1, slack=b.slack * 2)
            continue
        for value, count in sorted(inside[i]):
            seen += count
            if b.rank < seen:
                found[key] = value
                del brackets[key]
                break
        else:
            brackets[key] = replace(b, lo=b.hi, hi=math.inf, n_inside=math.inf, slack=b.slack * 2)


def _refine(narrow, alias, boxes, brackets, accuracy):
    """One scan: cut every bracket into finer ones by a sketch of the values inside it."""
    points = max(2, min(REFINE_POINTS, accuracy // GRID_TO_ERROR))
    grid_list = F.array(*[F.lit(i / points) for i in range(points + 1)])
    aggregates = []
    for i, (n, lo, hi) in enumerate(boxes):
        x = F.col(alias[n])
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggregates += [
            F.count_if(x < F.lit(lo)).alias(f"below_{i}"),
            F.count_if(inside).alias(f"inside_{i}"),
            F.percentile_approx(F.when(inside, x), grid_list, accuracy).alias(f"grid_{i}"),
        ]
    row = narrow.agg(*aggregates).first()
    index = {box: i for i, box in enumerate(boxes)}
    for key, b in list(brackets.items()):
        i = index[(b.column, b.lo, b.hi)]
        below, inside, values = row[f"below_{i}"], row[f"inside_{i}"], row[f"grid_{i}"]
        # A sketch that missed the rank sends the search to the other side, with wider margins.
        if b.rank < below:
            brackets[key] = replace(b, lo=-math.inf, hi=b.lo, n_inside=below + 1, slack=b.slack * 2)
        elif b.rank >= below + inside:
            brackets[key] = replace(b, lo=b.hi, hi=math.inf, n_inside=math.inf, slack=b.slack * 2)
        else:
            at = (b.rank - below) / inside * points
            lo = values[max(0, math.floor(at - b.slack))]
            hi = values[min(points, math.ceil(at + b.slack))]
            # No gain, or one value left: few distinct values with many copies, which collapse
            # when they are counted.
            done = lo == hi or (lo, hi) == (b.lo, b.hi)
            left = 0 if done else inside * (2 * b.slack + 2) / points
            brackets[key] = replace(b, lo=lo, hi=hi, n_inside=left)
