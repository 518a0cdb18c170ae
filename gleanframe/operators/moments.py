"""Pairwise-complete second moments of many column pairs in one scan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many pairs are plain aggregates; beyond, one pass of matrix products per task. Half a dozen sums a pair soon make a
# generated method that is too large to be compiled.
PAIRS_AS_AGGREGATES = 3
# Columns of a block, rows multiplied at a time, and bytes of sums that one task keeps.
BLOCK, ROWS, TILE_BYTES = 500, 1 << 14, 64 << 20
SUMS = ("n", "a", "b", "aa", "bb", "ab")
# A variance below this share of the second moment is rounding noise around a constant.
CONSTANT_SHARE = 1e-12


@dataclass(frozen=True)
class PairMoments:
    """Sums over the rows where both are present; both columns shifted by their centres."""

    n: float
    a: float
    b: float
    aa: float
    bb: float
    ab: float

    def covariance(self) -> float:
        """Sample covariance; 0 where undefined."""
        if self.n < 2:
            return 0.0
        value = (self.ab - self.a * self.b / self.n) / (self.n - 1)
        return value if math.isfinite(value) else 0.0

    def correlation(self) -> float:
        """Pearson correlation, at most 1 in size; 0 where undefined."""
        if self.n < 2:
            return 0.0
        va, vb = self.aa - self.a**2 / self.n, self.bb - self.b**2 / self.n
        if not (va > CONSTANT_SHARE * self.aa and vb > CONSTANT_SHARE * self.bb):
            return 0.0
        value = (self.ab - self.a * self.b / self.n) / math.sqrt(va) / math.sqrt(vb)
        return max(-1.0, min(1.0, value)) if math.isfinite(value) else 0.0


def pair_moments(
    df: DataFrame, columns: Mapping[str, tuple[Column, float, bool]], pairs: Sequence[tuple[str, str]],
    max_aggregates: int = PAIRS_AS_AGGREGATES,
) -> dict[tuple[str, str], PairMoments]:
    """``columns`` maps a name to (expression, centre, has NULLs)."""
    if not pairs:
        return {}
    used = sorted({n for p in pairs for n in p})
    alias = {n: f"x{i}" for i, n in enumerate(used)}
    shifted = df.select(*[(columns[n][0] - F.lit(columns[n][1])).alias(alias[n]) for n in used])
    if len(pairs) <= max_aggregates:
        return _by_aggregates(shifted, alias, {n: columns[n][2] for n in used}, pairs)
    return _by_products(shifted, alias, used, pairs)


def _by_aggregates(shifted, alias, nullable, pairs):
    aggregates = [F.count(F.lit(1)).alias("n")]
    for n, x in alias.items():
        if not nullable[n]:
            aggregates += [F.sum(x).alias(f"s_{x}"), F.sum(F.col(x) * F.col(x)).alias(f"ss_{x}")]
    for i, (p, q) in enumerate(pairs):
        a, b = F.col(alias[p]), F.col(alias[q])
        aggregates.append(F.sum(a * b).alias(f"ab{i}"))
        if nullable[p] or nullable[q]:
            both = a.isNotNull() & b.isNotNull()
            aggregates += [
                F.count(a * b).alias(f"n{i}"),
                F.sum(F.when(both, a)).alias(f"a{i}"), F.sum(F.when(both, b)).alias(f"b{i}"),
                F.sum(F.when(both, a * a)).alias(f"aa{i}"), F.sum(F.when(both, b * b)).alias(f"bb{i}"),
            ]
    row = shifted.agg(*aggregates).first()
    out = {}
    for i, (p, q) in enumerate(pairs):
        if nullable[p] or nullable[q]:
            values = [row[f"{k}{i}"] for k in ("n", "a", "b", "aa", "bb", "ab")]
        else:
            a, b = alias[p], alias[q]
            values = [row["n"], row[f"s_{a}"], row[f"s_{b}"], row[f"ss_{a}"], row[f"ss_{b}"], row[f"ab{i}"]]
        out[(p, q)] = PairMoments(*[float(v or 0) for v in values])
    return out


def _by_products(shifted, alias, used, pairs):
    at = {n: i for i, n in enumerate(used)}
    rows = _products(shifted.select(*[alias[n] for n in used]), len(used)).collect()
    got = {(r["i"], r["j"]): PairMoments(*[r[s] for s in SUMS]) for r in rows}
    out = {}
    for p, q in pairs:
        m = got.get((min(at[p], at[q]), max(at[p], at[q])), PairMoments(0, 0, 0, 0, 0, 0))
        out[(p, q)] = m if at[p] < at[q] else PairMoments(m.n, m.b, m.a, m.bb, m.aa, m.ab)
    return out


def strong_pairs(
    df: DataFrame, columns: Mapping[str, tuple[Column, float, bool]], method: str, at_least: float,
) -> dict[tuple[str, str], PairMoments]:
    """The pairs (earlier column, later column) whose correlation or covariance is at_least so large in size.

    They are found where the sums of a pair come together; the driver gets no others, however many columns there are.
    """
    used = list(columns)
    shifted = df.select(*[(columns[n][0] - F.lit(columns[n][1])).alias(f"x{i}") for i, n in enumerate(used)])
    rows = _products(shifted, len(used), method, at_least - 1e-6).collect()
    return {(used[r["i"]], used[r["j"]]): PairMoments(*[r[s] for s in SUMS]) for r in rows}


def _strong(method: str, at_least: float, n, a, b, aa, bb, ab) -> np.ndarray:
    """Which sums may belong to a reported pair; PairMoments decides."""
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = ab - a * b / n
        if method == "covariance":
            return ~(np.abs(joint / (n - 1)) < at_least)
        return ~(np.abs(joint) / np.sqrt((aa - a * a / n) * (bb - b * b / n)) < at_least)


def _products(shifted: DataFrame, k: int, method: str | None = None, at_least: float = 0.0) -> DataFrame:
    """``(i, j, n, a, b, aa, bb, ab)`` of the pairs i < j of k columns, or of the strong ones alone.

    Blocks of BLOCK columns: a task adds up matrix products of two blocks over its rows, one array per column and sum; arrays of
    the same column meet in one task. As many tiles as fit TILE_BYTES share a pass over the table.
    """
    blocks = -(-k // BLOCK)
    tiles = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    a_pass = max(1, TILE_BYTES // (len(SUMS) * 8 * min(k, BLOCK) ** 2))
    schema = "tile int, i int, " + ", ".join(f"{s} array<double>" for s in SUMS)
    out = None
    for at in range(0, len(tiles), a_pass):
        own = tiles[at : at + a_pass]

        def products(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            width = [min(k, (b + 1) * BLOCK) - b * BLOCK for b in range(blocks)]
            totals = [np.zeros((len(SUMS), width[i], width[j])) for i, j in own]
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    ready = {}
                    for b in {b for tile in own for b in tile}:
                        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[b * BLOCK : b * BLOCK + width[b]]])
                        seen = ~np.isnan(x)
                        v = np.where(seen, x, 0.0)
                        ready[b] = seen.astype(float), v, v * v
                    for total, (i, j) in zip(totals, own):
                        (m, v, vv), (mj, vj, vvj) = ready[i], ready[j]
                        total += np.stack([m.T @ mj, v.T @ mj, m.T @ vj, vv.T @ mj, m.T @ vvj, v.T @ vj])
            for number, (total, (i, _)) in enumerate(zip(totals, own)):
                yield pa.RecordBatch.from_pydict({
                    "tile": pa.array([number] * total.shape[1], pa.int32()), "i": pa.array(range(i * BLOCK, i * BLOCK + total.shape[1]), pa.int32()),
                    **{s: pa.array(list(v), pa.list_(pa.float64())) for s, v in zip(SUMS, total)}})

        def added(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            now, sums = None, None

            def found() -> Iterator[pa.RecordBatch]:
                if now is None:
                    return
                j = own[now[0]][1] * BLOCK + np.arange(sums.shape[1])
                keep = j > now[1]
                if method:
                    keep &= _strong(method, at_least, *sums) & (sums[0] >= 2)
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(np.full(keep.sum(), now[1]), pa.int32()), "j": pa.array(j[keep], pa.int32()),
                    **{s: pa.array(v[keep]) for s, v in zip(SUMS, sums)}})

            for batch in batches:
                for r in range(batch.num_rows):
                    key = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                    one = np.stack([batch.column(2 + s)[r].values.to_numpy() for s in range(len(SUMS))])
                    if key == now:
                        sums = sums + one
                    else:
                        yield from found()
                        now, sums = key, one
            yield from found()

        parts = shifted.mapInArrow(products, schema).repartition("tile", "i").sortWithinPartitions("tile", "i")
        pairs = parts.mapInArrow(added, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
        out = pairs if out is None else out.unionByName(pairs)
    return out
