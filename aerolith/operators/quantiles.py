"""Exact, linearly interpolated quantiles per group that never hold a whole
group in one task (used by O-A19, O-A22, O-A25).

Spark's exact ``percentile`` merges a value -> count map of every distinct
value of a group in one task; for a group holding a third of the data with
free-form doubles that map is unbounded. Here the exact value is found by
selection instead:

1. a quantile sketch (``percentile_approx``, rank error <= n / accuracy)
   brackets each wanted rank with [lo, hi], together with the group size n;
2. one pass over the rows keeps, per group, the rows of each distinct value
   inside a bracket and, in counters of fixed width, how many rows lie below
   each bracket and the values next to it. All columns and ranks are counted
   in the update of one row, by a hash aggregation: no row is multiplied, and
   a hot group is combined map-side;
3. a running sum over those few buckets gives the values at ranks
   floor(h) and floor(h) + 1 with h = (n - 1) p, interpolated like pandas
   and ``quantile_cont``.

Only the bracket (about ``2 * margin * n / accuracy`` rows' distinct
values per quantile) is ever ordered; the largest value below and the
smallest above each bracket are kept too, so a bracket that ends one rank
short (sketch rounding on small groups) still yields the exact value. A
bracket missing by more raises an error; the sketch's rank guarantee and the
margin make that unreachable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.session import SMALL_ROWS, written_once

DEFAULT_ACCURACY = 1_000_000
DEFAULT_MARGIN = 4.0
#: A constant column of this name makes all rows one group.
ALL = "_all"


def _null_safe_on(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return cond


@dataclass(frozen=True)
class Selected:
    """Exact quantiles of several columns: ``stats`` has a row per group with ``_n{j}`` (non-null values of
    column j) and the moments asked for as ``{name}{j}``; ``quantiles`` (by, _j, _i, _q) the values at
    probability i of column j, where the column has any. ``small``: the groups were counted as few."""

    stats: DataFrame
    quantiles: DataFrame
    small: bool


def select(df: DataFrame, values: list[str], by: list[str], probs: list[float], moments: dict[str, Callable[[str], Column]] | None = None,
           accuracy: int = DEFAULT_ACCURACY, margin: float = DEFAULT_MARGIN) -> Selected:
    """Two passes over ``df``: sketches with ``moments`` of every column, then the counts around their brackets."""
    k, m, eps = len(probs), len(values), margin / accuracy
    d = df.select(*by, *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(values)])

    # 1. bracket every wanted rank; the group's size and moments come with it
    ranks = [max(0.0, p - eps) for p in probs] + [min(1.0, p + eps) for p in probs]
    aggs = [x for j in range(m) for x in (
        F.count(f"_v{j}").alias(f"_n{j}"), F.percentile_approx(f"_v{j}", ranks, accuracy).alias(f"_a{j}"),
        *[f(f"_v{j}").alias(f"{name}{j}") for name, f in (moments or {}).items()])]
    # a row per group, computed once: broadcast when counted small, so the rows stay where they are
    stats = written_once(d.groupBy(*by).agg(*aggs), "brackets")
    small = stats.count() <= SMALL_ROWS
    bounds = stats.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[c for j in range(m) for c in (f"_n{j}", f"_a{j}")])
    bounds = F.broadcast(bounds) if small else bounds
    only = bounds.head() if by == [ALL] else None

    def bounded(rows: DataFrame) -> DataFrame:
        """``rows`` with the brackets of their group; those of the one group of all rows are literals."""
        if by == [ALL]:
            held = only.asDict() if only else {}
            return rows.withColumns({c: F.lit(held.get(c)).cast(dict(bounds.dtypes)[c]) for c in bounds.columns if c != f"_k_{ALL}"})
        return rows.join(bounds, _null_safe_on(rows, bounds, by, "_k_"), "inner")

    # 2. one pass: a value inside a bracket is its own bucket; what lies below is counted.
    # As SQL text: hundreds of small expressions are slow to build one call at a time
    near = bounded(d)
    lo, hi = (lambda j, i: f"_a{j}[{i}]"), (lambda j, i: f"_a{j}[{k + i}]")
    inside = lambda x, j, i: f"{x} BETWEEN {lo(j, i)} AND {hi(j, i)}"
    bucket = [F.expr(f"CASE WHEN {' OR '.join(inside(f'_v{j}', j, i) for i in range(k))} THEN _v{j} END").alias(f"_b{j}") for j in range(m)]
    counters = [F.expr(x) for j in range(m) for i in range(k) for x in (
        f"count(CASE WHEN _v{j} < {lo(j, i)} THEN 1 END) AS _below{j}_{i}", f"max(CASE WHEN _v{j} < {lo(j, i)} THEN _v{j} END) AS _mx{j}_{i}",
        f"min(CASE WHEN _v{j} > {hi(j, i)} THEN _v{j} END) AS _mn{j}_{i}")]
    part = near.groupBy(*by, *bucket).agg(F.count(F.lit(1)).alias("_c"), *counters)

    # 3. these few rows by (group, column, rank): below, each value inside, above
    few = bounded(part)
    entry = lambda j, i, cls, b="null", c="0L", mx="null", mn="null": (
        f"named_struct('_j', {j}, '_i', {i}, '_cls', {cls}, '_n', _n{j}, '_b', CAST({b} AS DOUBLE), '_c', {c}, "
        f"'_mx', CAST({mx} AS DOUBLE), '_mn', CAST({mn} AS DOUBLE))")
    entries = ", ".join(e for j in range(m) for i in range(k) for e in (
        entry(j, i, 0, c=f"_below{j}_{i}", mx=f"_mx{j}_{i}"),
        entry(j, i, 1, b=f"_b{j}", c=f"CASE WHEN {inside(f'_b{j}', j, i)} THEN _c ELSE 0L END"),
        entry(j, i, 2, mn=f"_mn{j}_{i}")))
    told = F.expr(f"explode(filter(array({entries}), e -> e._c > 0 OR e._mn IS NOT NULL)) AS _e")
    buckets = (few.select(*by, told).select(*by, "_e.*").groupBy(*by, "_j", "_i", "_cls", "_n", "_b")
               .agg(F.sum("_c").alias("_c"), F.max("_mx").alias("_mx"), F.min("_mn").alias("_mn")))

    w = Window.partitionBy(*by, "_j", "_i").orderBy("_cls", "_b") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = buckets.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("_i") + 1)
    h = (F.col("_n") - 1) * p
    r0 = F.floor(h)
    r1 = F.least(r0 + 1, F.col("_n") - 1)

    def value_at(r: Column) -> Column:
        c = F.col("_cls")
        return (F.when((c == 1) & (F.col("_start") <= r) & (r < F.col("_end")), F.col("_b"))
                 .when((c == 0) & (r == F.col("_end") - 1), F.col("_mx"))
                 .when((c == 2) & (r == F.col("_start")), F.col("_mn")))

    per_q = (cum.withColumn("_h", h).withColumn("_r0", r0).withColumn("_r1", r1)
             .groupBy(*by, "_j", "_i")
             .agg(F.max(value_at(F.col("_r0"))).alias("_x0"),
                  F.max(value_at(F.col("_r1"))).alias("_x1"),
                  F.max("_h").alias("_h"), F.max("_r0").alias("_r0")))
    found = F.col("_x0") + (F.col("_h") - F.col("_r0")) * (F.col("_x1") - F.col("_x0"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket: raise the accuracy or the margin")).cast("double")
    per_q = per_q.select(*by, "_j", "_i", F.when(found.isNull(), missed).otherwise(found).alias("_q"))
    return Selected(stats, per_q, small)


def exact_quantiles(df: DataFrame, value: str, by: list[str], probs: list[float],
                    names: list[str] | None = None, accuracy: int = DEFAULT_ACCURACY,
                    margin: float = DEFAULT_MARGIN) -> DataFrame:
    """One row per group of ``by`` with one column per probability (default
    names ``q0, q1, ...``); null values are ignored, null keys form a group."""
    return grouped_quantiles(df, value, by, probs, names, accuracy, margin)[0]


def grouped_quantiles(df: DataFrame, value: str, by: list[str], probs: list[float], names: list[str] | None = None,
                      accuracy: int = DEFAULT_ACCURACY, margin: float = DEFAULT_MARGIN) -> tuple[DataFrame, bool]:
    """(``exact_quantiles``, whether its rows were counted as few enough to broadcast)."""
    names = names or [f"q{i}" for i in range(len(probs))]
    own = by or [ALL]
    rows = df.where(F.col(value).isNotNull())
    rows = rows if by else rows.withColumn(ALL, F.lit(0))
    s = select(rows, [value], own, probs, accuracy=accuracy, margin=margin)
    out = s.quantiles.groupBy(*own).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    return out.select(*by, *names), s.small


def quantile_columns(df: DataFrame, value: str, by: list[str], probs: list[float],
                     names: list[str], method: str = "exact") -> DataFrame:
    """Quantiles per group by ``method``: 'exact' (distributed selection,
    above), 'percentile' (Spark's exact aggregate, one map per group: only
    for groups of bounded distinct values) or 'approx' (sketch)."""
    if method == "exact":
        return exact_quantiles(df, value, by, probs, names)
    q = quantile_aggregate(F.col(value).cast("double"), probs, method)
    g = df.groupBy(*by).agg(q.alias("_q")) if by else df.agg(q.alias("_q"))
    return g.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def quantile_aggregate(x: Column, probs: list[float], method: str) -> Column:
    """Spark's own aggregate: 'percentile' or 'approx'."""
    if method == "percentile":
        return F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))
    if method == "approx":
        return F.percentile_approx(x, [float(p) for p in probs], DEFAULT_ACCURACY).cast("array<double>")
    raise ValueError(f"unknown quantile method: {method}")
