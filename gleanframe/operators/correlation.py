"""Strongly related column pairs: Pearson, Spearman, Kendall tau-b and covariance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.functions.missing import DEFAULT_TOKENS, column, normalise_missing
from gleanframe.operators.features import raw_number, supported_columns
from gleanframe.operators.kendall import kendall_tau
from gleanframe.operators.materialise import spread_out, staged
from gleanframe.operators.moments import PAIRS_AS_AGGREGATES, PairMoments, pair_moments, strong_pairs
from gleanframe.operators.running import SLICE_ROWS, hot_lookup, running_totals

METHODS = ("spearman", "pearson", "kendall", "covariance", "none")
METHOD_IDS = {1: "spearman", 2: "pearson", 3: "kendall", 4: "covariance", 5: "none"}
REPORTED_FROM = 0.9
COVARIANCE_BELOW = -1.0

PAIR_SCHEMA = T.StructType([
    T.StructField("f1", T.StringType()), T.StructField("f2", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
# Rank tables up to this many rows are looked up by broadcast, as long as all of them together have no more than the second number.
BROADCAST_RANKS, BROADCAST_IN_ALL = 50_000, 1_000_000
# Pairs whose rows are expanded at a time.
PAIRS_AT_ONCE = 8


def method_name(method: str | int | None) -> str:
    if method is None:
        return "none"
    if isinstance(method, int):
        return METHOD_IDS.get(method, "none")
    if method not in METHODS:
        raise ValueError(f"unknown similarity method {method!r}")
    return method


@dataclass(frozen=True)
class _Column:
    name: str
    ordinal: int
    x: Column
    n_present: int
    mean: float


def _usable(df: DataFrame, names: Sequence[str]) -> tuple[list[_Column], int]:
    """Columns that can be reported at all: less than half missing, finite and not constant.

    The others have the value 0 against every column, which no filter lets through.
    """
    xs = {n: raw_number(df, n) for n in names}
    stats: dict[str, tuple] = {}
    n_rows = 0
    for at in range(0, len(names), 100):
        batch = names[at : at + 100]
        row = df.select(*[xs[n].alias(f"x{i}") for i, n in enumerate(batch)]).agg(
            F.count(F.lit(1)).alias("n"),
            *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(batch))
              for k, f in (("c", F.count), ("lo", F.min), ("hi", F.max), ("m", F.avg))],
        ).first()
        n_rows = row["n"]
        for i, n in enumerate(batch):
            stats[n] = tuple(row[f"{k}{i}"] for k in ("c", "lo", "hi", "m"))
    out = []
    for i, n in enumerate(names):
        present, lo, hi, mean = stats[n]
        finite = present and all(abs(v) != float("inf") for v in (lo, hi))
        if finite and (n_rows - present) < n_rows / 2 and lo < hi:
            out.append(_Column(n, i, xs[n], present, mean))
    return out, n_rows


def pair_values(
    df: DataFrame, method: str | int = "spearman", columns: Sequence[str] | None = None,
    key: Sequence[str] | None = None, tokens: Sequence[str] = DEFAULT_TOKENS, at_least: float | None = None,
) -> dict[tuple[str, str], float]:
    """The value of every usable pair (earlier column, later column), before the report filter.

    With ``at_least``, pairs below it (in size, for Pearson and covariance) may be left out before they reach the driver.
    """
    method = method_name(method)
    if method == "none":
        return {}
    names = supported_columns(df, columns)
    clean = normalise_missing(df, tokens)
    usable, n_rows = _usable(clean, names)
    if len(usable) < 2:
        return {}
    if method in ("pearson", "covariance"):
        spec = {c.name: (c.x, c.mean, c.n_present < n_rows) for c in usable}
        if at_least is not None and len(usable) * (len(usable) - 1) // 2 > PAIRS_AS_AGGREGATES:
            moments = strong_pairs(clean, spec, method, at_least)
        else:
            moments = pair_moments(clean, spec, list(combinations(spec, 2)))
        return {p: (m.correlation() if method == "pearson" else m.covariance()) for p, m in moments.items()}
    pairs = [(a.name, b.name) for a, b in combinations(usable, 2)]
    if method == "kendall":
        return kendall_tau(clean, {c.name: c.x for c in usable}, pairs, n_rows, at_least)
    if at_least is not None:
        pairs = _may_reach(clean, usable, n_rows, pairs, at_least)
        usable = [c for c in usable if any(c.name in p for p in pairs)]
    return _spearman(clean, usable, n_rows, pairs, key) if pairs else {}


def correlated_pairs(
    df: DataFrame, method: str | int | None = "spearman", columns: Sequence[str] | None = None,
    key: Sequence[str] | None = None, abs_value: bool = False, tokens: Sequence[str] = DEFAULT_TOKENS,
) -> DataFrame:
    """Reported pairs ``(f1 = later column, f2 = earlier column, value)``.

    Correlations are reported from 0.9 up (strong negative ones only with ``abs_value``), covariances
    from 0.9 up or -1 down.
    """
    method = method_name(method)
    ranked = method in ("spearman", "kendall")
    values = pair_values(df, method, columns, key, tokens, None if abs_value and ranked else REPORTED_FROM)
    order = {n: i for i, n in enumerate(supported_columns(df, columns))}
    rows = []
    for (earlier, later), v in values.items():
        if method == "covariance":
            keep = v >= REPORTED_FROM or v <= COVARIANCE_BELOW
        else:
            keep = (abs(v) if abs_value else v) >= REPORTED_FROM
        if keep:
            rows.append((later, earlier, v))
    rows.sort(key=lambda r: (order[r[0]], order[r[1]]))
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def _null_classes(df: DataFrame, nullable: list[_Column]) -> dict[str, str]:
    """Columns with the same missing rows, as {name: first column of its class}."""
    by_count: dict[int, list[_Column]] = {}
    for c in nullable:
        by_count.setdefault(c.n_present, []).append(c)
    candidates = [(a, b) for group in by_count.values() for a, b in combinations(group, 2)]
    leader = {c.name: c.name for c in nullable}
    for at in range(0, len(candidates), 200):
        batch = candidates[at : at + 200]
        row = df.agg(*[F.count_if(a.x.isNotNull() & b.x.isNotNull()).alias(f"c{i}")
                       for i, (a, b) in enumerate(batch)]).first()
        for i, (a, b) in enumerate(batch):
            if row[f"c{i}"] == a.n_present:
                leader[b.name] = min(leader[a.name], leader[b.name])
    return leader


def quadrant_bound(n: float, a1: float, b1: float, both: float) -> float:
    """An upper bound of Spearman's rho from one split of each column.

    Of n rows, ``a1`` lie above the first column's split, ``b1`` above the second's, ``both`` above
    both. Rows above one split only are far apart in rank on average: the k lowest ranks above a
    split add up to at least the k plain ranks that follow it (ties only even them out), likewise
    below. That bounds the sum of squared rank differences D from below, and
    rho = (SSa + SSb - D) / (2 sqrt(SSa SSb)). With ties the sums of squares SS are only known to lie
    between the split's own and the tie-free value; rho is largest at a corner of that box.
    """
    a0, b0 = n - a1, n - b1
    if min(a0, a1, b0, b1) <= 0:
        return 1.0
    d = 0.0
    for k, lead in ((a1 - both, a0 - b0), (b1 - both, b0 - a0)):
        if k > 0:
            d += max(0.0, lead + k) ** 2 * k
    free = (n**3 - n) / 12.0
    return max(
        (x + y - d) / (2.0 * (x * y) ** 0.5)
        for x in (free, n * a0 * a1 / 4.0) for y in (free, n * b0 * b1 / 4.0)
    )


def _may_reach(df, usable, n_rows, pairs, at_least):
    """Pairs whose quadrant counts around the means leave room for ``at_least``. One narrow scan."""
    spec = {
        c.name: (F.when(c.x.isNotNull(), (c.x > F.lit(c.mean)).cast("double")), 0.0, c.n_present < n_rows)
        for c in usable
    }
    counts = pair_moments(df, spec, pairs)
    return [p for p in pairs
            if quadrant_bound(counts[p].n, counts[p].a, counts[p].b, counts[p].ab) >= at_least - 1e-9]


def _spearman(df, usable, n_rows, pairs, key):
    """Average ranks over the rows where both columns of a pair are present, then their correlation.

    Which rows those are depends only on the missing patterns involved, so each (pattern, column) is
    ranked once. Ranks come from running totals over distinct values. A few pairs collapse to distinct
    (x, y) with counts, which meet the ranks (see _cross_sums). With more pairs than ranked columns the
    ranks go back to the rows by broadcast where a rank table is small, otherwise by a join in which hot
    values are split off.
    """
    by_name = {c.name: c for c in usable}
    leader = _null_classes(df, [c for c in usable if c.n_present < n_rows])
    groups: dict[tuple[frozenset, str], int] = {}
    pair_groups = {}
    for p, q in pairs:
        pattern = frozenset(leader[n] for n in (p, q) if n in leader)
        pair_groups[(p, q)] = tuple(groups.setdefault((pattern, n), len(groups)) for n in (p, q))

    needed = [c.x.alias(f"v{i}") for i, c in enumerate(usable)]
    at = {c.name: F.col(f"v{i}") for i, c in enumerate(usable)}
    if key:
        table = df.select(*[column(k).alias(f"_k{i}") for i, k in enumerate(key)], *needed)
        ids = [f"_k{i}" for i in range(len(key))]
    else:
        # Without a key the rows are numbered, and written once so that the numbers hold.
        table = staged(spread_out(df.select(*needed)).select(F.monotonically_increasing_id().alias("_k0"), "*"))
        ids = ["_k0"]

    def member(pattern: frozenset, name: str) -> Column:
        value = at[name]
        for other in pattern:
            value = F.when(at[other].isNotNull(), value)
        return value

    members = {g: member(pattern, name) for (pattern, name), g in groups.items()}

    def spread(wanted, *carried) -> DataFrame:
        slots = [F.struct(F.lit(g).alias("g"), members[g].alias("value")) for g in wanted]
        return (table.select(*carried, F.explode(F.array(*slots)).alias("s"))
                .select(*carried, "s.g", "s.value").filter("value IS NOT NULL"))

    counts = spread(members).groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    if n_rows > SLICE_ROWS:  # read several times then
        counts = staged(counts)
    ranks = staged(running_totals(counts, ["g"], ["value"], ["n"], at_most=n_rows).select(
        "g", "value", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")))
    sizes = {r["g"]: (r["d"], r["n"]) for r in ranks.groupBy("g").agg(
        F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect()}
    rank_pairs = sorted(set(pair_groups.values()))
    if len(rank_pairs) <= len(members):
        rows = {g: n for g, (_, n) in sizes.items()}
        own, cross = _cross_sums(table, members, ranks, rows, rank_pairs)
        return {p: PairMoments(rows.get(a, 0), 0.0, 0.0, own.get(a, 0.0), own.get(b, 0.0), cross.get((a, b), 0.0)).correlation()
                for p, (a, b) in pair_groups.items()}
    small, total = [], 0
    for g in sorted(members, key=lambda g: (sizes.get(g, (0, 0))[0], g)):
        total += sizes.get(g, (0, 0))[0]
        if sizes.get(g, (0, 0))[0] <= BROADCAST_RANKS and total <= BROADCAST_IN_ALL:
            small.append(g)
    large = [g for g in members if g not in small]

    small_ranks = ranks.select("g", "value", "rank") if small else None
    wide = table.select(*(ids if large else []), *[members[g].alias(f"m{g}") for g in small])
    for g in small:
        lookup = small_ranks.filter(F.col("g") == g).select(F.col("value").alias(f"m{g}"), F.col("rank").alias(f"r{g}"))
        wide = wide.join(F.broadcast(lookup), f"m{g}", "left")
    wide = wide.select(*(ids if large else []), *[f"r{g}" for g in small])
    if large:
        found = hot_lookup(spread(large, *ids), ranks.filter(F.col("g").isin(large)), ["g", "value"], "n", ["g"],
                           n_groups=len(large))
        from_small = [F.max(f"r{g}").alias(f"r{g}") for g in small]
        per_row = found.select(*ids, *[F.when(F.col("g") == g, F.col("rank")).alias(f"r{g}") for g in large])
        both = per_row.unionByName(wide, allowMissingColumns=True) if small else per_row
        wide = both.groupBy(*ids).agg(*from_small, *[F.max(f"r{g}").alias(f"r{g}") for g in large])

    spec = {}
    for (pattern, name), g in groups.items():
        n = sizes.get(g, (0, 0))[1]
        spec[g] = (F.col(f"r{g}"), (n + 1) / 2, bool(pattern) or by_name[name].n_present < n_rows)
    moments = pair_moments(wide, spec, rank_pairs)
    return {p: moments[g].correlation() for p, g in pair_groups.items()}


def _cross_sums(table, members, ranks, rows, rank_pairs):
    """The sum of squares of every group's centred ranks, and of the products of every pair's.

    Rows become distinct (x, y) with counts and look up the rank of x; the sums by y then meet the ranks of y one to one. Nothing
    is joined or grouped by row.
    """
    centre = F.create_map(*[F.lit(v) for g, n in rows.items() for v in (g, (n + 1) / 2)])[F.col("g")]
    ranks = ranks.withColumn("rank", F.col("rank") - centre) if rows else ranks
    own = {r["g"]: r["s"] for r in ranks.groupBy("g").agg(F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("s")).collect()}
    cross = {}
    for at in range(0, len(rank_pairs), PAIRS_AT_ONCE):
        slots = [F.when(members[a].isNotNull() & members[b].isNotNull(),
                        F.struct(F.lit(a).alias("g"), F.lit(b).alias("h"), members[a].alias("value"), members[b].alias("y")))
                 for a, b in rank_pairs[at : at + PAIRS_AT_ONCE]]
        spread = table.select(F.explode(F.array(*slots)).alias("s")).filter("s IS NOT NULL").select("s.*")
        cells = staged(spread.groupBy("g", "h", "value", "y").agg(F.count(F.lit(1)).alias("c")))
        found = hot_lookup(cells, ranks, ["g", "value"], "n", ["g"], n_groups=len(members))
        by_y = found.groupBy("g", "h", "y").agg(F.sum(F.col("c") * F.col("rank")).alias("s"))
        met = by_y.join(ranks.select(F.col("g").alias("h"), F.col("value").alias("y"), "rank"), ["h", "y"])
        for r in met.groupBy("g", "h").agg(F.sum(F.col("s") * F.col("rank")).alias("s")).collect():
            cross[(r["g"], r["h"])] = r["s"]
    return own, cross
