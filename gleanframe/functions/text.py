"""Text helpers: feature display names, name cleaning and Jaro similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def display_name(c: Column) -> Column:
    """A feature name on one line: line breaks become spaces, double spaces become single."""
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def clean_name(c: Column) -> Column:
    """Drop every ``(...)`` group and then one trailing space."""
    return F.regexp_replace(F.regexp_replace(c, r"\(.+?\)", ""), r" \z", "")


def jaro_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of aligned string lists.

    A character takes the first free equal one in its window. Equal characters compete only with each other, and windows move to
    the right, so two pointers over the positions in (character, position) order decide it: one step for all pairs of the batch
    at once, at most as many steps as both strings are long. An empty string is similar (1.0) only to an empty string.
    """
    k = len(left)
    if k == 0:
        return np.zeros(0)
    la = np.fromiter((len(s) for s in left), np.int64, k)
    lb = np.fromiter((len(s) for s in right), np.int64, k)
    wa, wb = max(int(la.max()), 1), max(int(lb.max()), 1)

    def codes(strings: list[str], width: int) -> np.ndarray:
        m = np.full((k, width), 1 << 30, np.int32)
        for i, s in enumerate(strings):
            if s:
                m[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        return m

    a, b = codes(left, wa), codes(right, wb)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    place_a, place_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    used_a, used_b = np.zeros((k, wa), bool), np.zeros((k, wb), bool)
    rows = np.flatnonzero((la > 0) & (lb > 0))
    i, j = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    while len(rows):
        at_a, at_b = place_a[rows, i], place_b[rows, j]
        step, apart = np.sign(a[rows, at_a] - b[rows, at_b]), at_b - at_a
        near = window[rows]
        step = np.where(step == 0, (apart < -near).astype(np.int32) - (apart > near), step)
        hit = step == 0
        used_a[rows[hit], at_a[hit]] = True
        used_b[rows[hit], at_b[hit]] = True
        i += step <= 0
        j += step >= 0
        more = (i < la[rows]) & (j < lb[rows])
        if not more.all():
            rows, i, j = rows[more], i[more], j[more]
    m = used_a.sum(axis=1)
    # Matched characters of each side moved to the front, in order, then compared by position.
    fa = np.take_along_axis(np.where(used_a, a, -3), np.argsort(~used_a, axis=1, kind="stable"), axis=1)
    fb = np.take_along_axis(np.where(used_b, b, -3), np.argsort(~used_b, axis=1, kind="stable"), axis=1)
    w = min(wa, wb)
    moved = (fa[:, :w] != fb[:, :w]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / la + m / lb + (m - moved) / m) / 3.0
    return np.where(m > 0, score, np.where((la == 0) & (lb == 0), 1.0, 0.0))


@F.pandas_udf(T.DoubleType())
def jaro_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Jaro similarity of two string columns, NULL when either is NULL."""
    for a, b in pairs:
        out = np.full(len(a), np.nan)
        ok = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        left, right = a.to_numpy(object), b.to_numpy(object)
        size = np.fromiter((len(left[i]) + len(right[i]) for i in ok), np.int64, len(ok))
        order = ok[np.argsort(size, kind="stable")]
        start = 0
        while start < len(order):
            # Pairs of like length together; a chunk holds at most about 4M matrix cells.
            stop = min(start + 4096, len(order))
            while stop - start > 1 and (stop - start) * max(
                len(left[order[stop - 1]]), len(right[order[stop - 1]])
            ) > 4_000_000:
                stop = start + (stop - start) // 2
            idx = order[start:stop]
            out[idx] = jaro_batch([left[i] for i in idx], [right[i] for i in idx])
            start = stop
        yield pd.Series(out).astype("Float64").where(~np.isnan(out), None)
