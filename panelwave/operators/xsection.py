"""Cross-sectional operators: exact ranks, quantiles and z-scores inside a group (usually a date).

Two exact plans exist for everything that needs an order inside a group:

* ``Bound.rows`` is a proven bound on rows per group and fits a task: one window / one aggregate, or for several columns
  at once one matrix of the group's rows (``matrix_columns``);
* otherwise the group is split into value buckets by a bounded-size sketch, counted per bucket and
  stitched together with prefix sums, so no task ever holds a whole group and ties are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwave.functions.expr import clip, div
from panelwave.operators.sizing import BROADCAST_BYTES, CELL_BYTES, WINDOW_ROWS, materialize, ship_package, spread

SALTS = 16


@dataclass(frozen=True)
class Bound:
    """Proven sizes: most rows in one group, and number of groups (None = unknown)."""

    rows: int | None = None
    groups: int | None = None


def _fits(bound: Bound, columns: int = 1) -> bool:
    """One task may hold a group: rows times columns are proven to stay under the limit. Results do not depend on it."""
    return bound.rows is not None and bound.rows * columns <= WINDOW_ROWS


def join_same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null, so that a group with a null key keeps its statistics."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in by])


def by_key(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each key, of batches in which equal keys follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)) for c in by]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            code = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new |= code[1:] != code[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            here = tuple(k[a].as_py() for k in keys)
            if held and here != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield held


def number(column: pa.Array) -> np.ndarray:
    """Values of a column, NaN for null; texts as numbers that are equal where they are."""
    if pa.types.is_string(column.type):
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(float)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def matrix_columns(df: DataFrame, by: Sequence[str], inputs: Sequence[str], outputs: Sequence[str],
                   fn: Callable[[np.ndarray], np.ndarray], dealt: bool = False,
                   kept: Iterable[str] | None = None) -> DataFrame:
    """df with the columns fn makes of each group's matrix (rows x inputs, NaN for null, texts numbered): one exchange on the group.

    For groups that are proven to fit a task. NaN and infinite results are null. ``dealt``: rows are on their group already.
    ``kept``: columns of df that stay (all by default).
    """
    by, inputs = list(by), list(inputs)
    own = [f for f in df.schema.fields if f.name not in outputs and (kept is None or f.name in kept)]
    schema = T.StructType(own + [T.StructField(c, T.DoubleType()) for c in outputs])
    kept = [f.name for f in own]

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [number(table.column(c).chunk(0)) for c in inputs]
        with np.errstate(invalid="ignore", divide="ignore"):
            made = fn(np.stack(columns, axis=1))
        arrays = [table.column(c).chunk(0) for c in kept]
        arrays += [pa.array(made[:, i], mask=~np.isfinite(made[:, i])) for i in range(len(outputs))]
        return pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(one, by_key(batches, by))

    ship_package(df.sparkSession)
    return (df if dealt else spread(df, *by)).sortWithinPartitions(*by).mapInArrow(run, schema)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """0-based average-tie ranks inside each column of a matrix without nulls."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    place = np.arange(n)[:, None]
    new = np.ones(x.shape, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    closes = np.ones(x.shape, bool)
    closes[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(closes, place, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2.0, axis=0)
    return out


def matrix_pct_rank(x: np.ndarray) -> np.ndarray:
    """Average-tie percentile rank among the values of each column."""
    out = np.full(x.shape, np.nan)
    for i in range(x.shape[1]):
        rows = np.flatnonzero(~np.isnan(x[:, i]))
        if len(rows):
            out[rows, i] = (average_ranks(x[rows, i : i + 1])[:, 0] + 1) / len(rows)
    return out


def matrix_median(x: np.ndarray) -> np.ndarray:
    """Median of the values of each column; NaN where there are none."""
    ordered, n = np.sort(x, axis=0), (~np.isnan(x)).sum(axis=0)  # NaN goes last
    at = lambda k: np.take_along_axis(ordered, np.maximum(k, 0)[None, :], axis=0)[0]
    return np.where(n > 0, at((n - 1) // 2) * 0.5 + at(n // 2) * 0.5, np.nan)


def matrix_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, mean, population deviation) of each column."""
    known = ~np.isnan(x)
    n = known.sum(axis=0)
    mean = np.where(known, x, 0.0).sum(axis=0) / n
    return n, mean, np.sqrt((np.where(known, x - mean, 0.0) ** 2).sum(axis=0) / n)


def matrix_robust_z(x: np.ndarray) -> np.ndarray:
    """(x - median) / (1.4826 MAD); population std where MAD ~ 0; 0.0 for a constant column."""
    med, sd = matrix_median(x), matrix_moments(x)[2]
    mad = matrix_median(np.abs(x - med))
    by = np.where(mad < 1e-8, np.where(sd == 0, np.nan, sd), 1.4826 * mad)
    return np.where((mad < 1e-8) & (sd < 1e-8), 0.0, (x - med) / by)


def ordered_counts(long: DataFrame, keys: Sequence[str], value: str, splits: int = 64) -> DataFrame:
    """Per distinct value of each group: n (ties), below (rows with a smaller value), total.

    The bucket bounds are approximate, the counts are exact: any bounds give the same result, as long as all rows meet the same
    ones. A sketch depends on the order in which its parts arrive, so values and bounds are written once.
    """
    keys = list(keys)
    counts = materialize(long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")))
    fractions = [i / splits for i in range(1, splits)]
    sketch = materialize(counts.groupBy(*keys).agg(F.percentile_approx(value, fractions, 1000).alias("_bounds")))
    bounds = sketch.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = (
        join_same(counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")), bounds, [*keys, "_salt"])
        .select(*keys, value, "n", F.size(F.filter("_bounds", lambda b: b < F.col(value))).alias("_bucket"))
    )
    per_bucket = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_in"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = per_bucket.select(
        *keys, "_bucket",
        (F.sum("_in").over(w) - F.col("_in")).alias("_offset"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    return join_same(placed, offsets, [*keys, "_bucket"]).select(
        *keys, value, "n",
        (F.col("_offset") + F.sum("n").over(inside) - F.col("n")).alias("below"),
        "total",
    )


def average_rank(x: Column, spec_by: Sequence[str]) -> Column:
    """1-based average-tie rank of a non-null value inside its group, one sort per column."""
    w = Window.partitionBy(*spec_by).orderBy(x.asc_nulls_first())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    nulls = F.count("*").over(whole) - F.count(x).over(whole)
    return F.when(x.isNotNull(), F.rank().over(w) - nulls + (F.count(x).over(peers) - 1) / 2.0)


def pct_rank(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], bound: Bound = Bound()) -> DataFrame:
    """Average-tie percentile rank (rank / non-null count) of ``cols[out] = in`` inside each group."""
    by = list(by)
    if len(cols) > 2 and _fits(bound, len(cols)):
        return matrix_columns(df, by, list(cols.values()), list(cols), matrix_pct_rank)
    if _fits(bound):
        whole = Window.partitionBy(*by)
        return df.withColumns(
            {out: average_rank(F.col(c), by) / F.count(F.col(c)).over(whole) for out, c in cols.items()}
        )
    for out, c in cols.items():
        ranks = ordered_counts(df.select(*by, c), by, c).select(
            *by, c, ((F.col("below") + (F.col("n") + 1) / 2.0) / F.col("total")).alias(out)
        )
        df = join_same(df, ranks, [*by, c], "left")
    return df


def percentile_rating(df: DataFrame, by, cols, bound=Bound(), rounded: bool = True) -> DataFrame:
    """Percentile rank mapped to 1..99; rounded half-even unless asked otherwise."""
    ranked = pct_rank(df, by, cols, bound)
    exprs = {}
    for out in cols:
        r = clip(F.col(out) * 98.0 + 1.0, 1.0, 99.0)
        exprs[out] = F.bround(r, 0) if rounded else r
    return ranked.withColumns(exprs)


def group_quantiles(
    df: DataFrame, by: Sequence[str], wanted: Mapping[str, tuple[str, float]], bound: Bound = Bound()
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``wanted[out] = (column, q)``."""
    by = list(by)
    if _fits(bound, len({c for c, _ in wanted.values()})):
        per_col: dict[str, list[tuple[str, float]]] = {}
        for out, (c, q) in wanted.items():
            per_col.setdefault(c, []).append((out, q))
        aggs, picks = [], {}
        for i, (c, items) in enumerate(per_col.items()):
            aggs.append(F.percentile(F.col(c), [q for _, q in items]).alias(f"_q{i}"))
            for k, (out, _) in enumerate(items):
                picks[out] = F.col(f"_q{i}")[k].alias(out)
        return df.groupBy(*by).agg(*aggs).select(*by, *[picks[o] for o in wanted])
    result = df.select(*by).distinct()
    for c in dict.fromkeys(c for c, _ in wanted.values()):
        oc = ordered_counts(df.select(*by, c), by, c)
        aggs = []
        for out, (cc, q) in wanted.items():
            if cc != c:
                continue
            pos = (F.col("total") - 1) * F.lit(float(q))
            lo, hi = F.floor(pos), F.ceil(pos)

            def at(i):
                return F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(c)))

            aggs.append((at(lo) + (at(hi) - at(lo)) * F.max(pos - F.floor(pos))).alias(out))
        result = join_same(result, oc.groupBy(*by).agg(*aggs), by, "left")
    return result


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str], bound: Bound = Bound()) -> DataFrame:
    """Join per-group statistics back (left, so groups without statistics keep their rows).

    Broadcast only when the number of groups is proven small; otherwise the optimizer picks the join.
    """
    small = bound.groups is not None and bound.groups * len(stats.columns) * CELL_BYTES <= BROADCAST_BYTES
    return join_same(df, F.broadcast(stats) if small else stats, list(by), "left")


def standard_z(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], *, sample: bool = False,
               center: Mapping[str, float] | None = None, floor: float = 1e-10,
               constant: float | None = 0.0, bound: Bound = Bound()) -> DataFrame:
    """(x - mean) / std per group through one mergeable aggregate.

    ``constant`` is the value of every row of a group whose std is below ``floor`` (0.0), or None to
    divide by 1 instead.
    """
    center = center or {}
    sd = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for i, c in enumerate(cols.values()):
        aggs += [F.avg(c).alias(f"_m{i}"), sd(c).alias(f"_s{i}")]
    joined = attach(df, df.groupBy(*by).agg(*aggs), by, bound)
    exprs = {}
    for i, (out, c) in enumerate(cols.items()):
        mid = F.lit(float(center[out])) if out in center else F.col(f"_m{i}")
        s = F.col(f"_s{i}")
        if constant is None:
            exprs[out] = (F.col(c) - mid) / F.when(s == 0, F.lit(1.0)).otherwise(s)
        else:
            exprs[out] = F.when(s < floor, F.lit(constant)).otherwise(div(F.col(c) - mid, s))
    return joined.withColumns(exprs).drop(*[f"_m{i}" for i in range(len(cols))], *[f"_s{i}" for i in range(len(cols))])


def robust_z(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], bound: Bound = Bound(),
             limit: float | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD); population std where MAD ~ 0; 0.0 for a constant group."""
    by = list(by)
    outs = list(cols.items())
    if _fits(bound, len(cols)):
        z = (lambda x: matrix_robust_z(x)) if limit is None else (lambda x: np.clip(matrix_robust_z(x), -limit, limit))
        return matrix_columns(df, by, list(cols.values()), list(cols), z)
    med = group_quantiles(df, by, {f"_med{i}": (c, 0.5) for i, (_, c) in enumerate(outs)}, bound)
    sds = df.groupBy(*by).agg(*[F.stddev_pop(c).alias(f"_sd{i}") for i, (_, c) in enumerate(outs)])
    step = attach(df, join_same(med, sds, by, "left"), by, bound)
    dev = step.withColumns({f"_dev{i}": F.abs(F.col(c) - F.col(f"_med{i}")) for i, (_, c) in enumerate(outs)})
    mad = group_quantiles(dev, by, {f"_mad{i}": (f"_dev{i}", 0.5) for i in range(len(outs))}, bound)
    full = attach(step, mad, by, bound)
    exprs = {}
    for i, (out, c) in enumerate(outs):
        num = F.col(c) - F.col(f"_med{i}")
        tight = F.col(f"_mad{i}") < 1e-8
        z = (
            F.when(tight & (F.col(f"_sd{i}") < 1e-8), F.lit(0.0))
            .when(tight, div(num, F.col(f"_sd{i}")))
            .otherwise(div(num, F.lit(1.4826) * F.col(f"_mad{i}")))
        )
        exprs[out] = z if limit is None else clip(z, -limit, limit)
    junk = [f"_{k}{i}" for k in ("med", "sd", "mad") for i in range(len(outs))]
    return full.withColumns(exprs).drop(*junk)


def winsorize(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], lo: float = 0.01, hi: float = 0.99,
              bound: Bound = Bound()) -> DataFrame:
    """Clip to the group's lo / hi quantiles."""
    wanted = {}
    for i, c in enumerate(cols.values()):
        wanted[f"_lo{i}"], wanted[f"_hi{i}"] = (c, lo), (c, hi)
    full = attach(df, group_quantiles(df, by, wanted, bound), by, bound)
    return full.withColumns(
        {out: clip(F.col(c), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, (out, c) in enumerate(cols.items())}
    ).drop(*wanted)


def group_z(df: DataFrame, by: Sequence[str], cols: Mapping[str, str], size: str, need: int = 3,
            bound: Bound = Bound()) -> DataFrame:
    """Sample z inside (date, group); NULL for groups with fewer than ``need`` declared members."""
    by = list(by)
    aggs = []
    for i, c in enumerate(cols.values()):
        aggs += [F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    full = attach(df, df.groupBy(*by).agg(*aggs), by, bound)
    return full.withColumns({
        out: F.when(F.col(size) >= need, div(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")))
        for i, (out, c) in enumerate(cols.items())
    }).drop(*[f"_{k}{i}" for k in "ms" for i in range(len(cols))])


def group_rank(df: DataFrame, by: Sequence[str], col: str, size: str, rank_out: str, pct_out: str,
               need: int = 2, bound: Bound = Bound()) -> DataFrame:
    """Rank 1 = largest (ties share the smallest rank) and rank / non-null count."""
    by = list(by)
    x = F.col(col)
    if _fits(bound):
        w = Window.partitionBy(*by).orderBy(x.desc_nulls_last())
        r = F.rank().over(w).cast("double")
        n = F.count(x).over(Window.partitionBy(*by))
        full = df.withColumns({"_r": r, "_n": n})
    else:
        oc = ordered_counts(df.select(*by, col), by, col).select(
            *by, col, (F.col("total") - F.col("below") - F.col("n") + 1).cast("double").alias("_r"),
            F.col("total").alias("_n"),
        )
        full = join_same(df, oc, [*by, col], "left")
    ok = x.isNotNull() & (F.col(size) >= need)
    return full.withColumns({
        rank_out: F.when(ok, F.col("_r")), pct_out: F.when(ok, F.col("_r") / F.col("_n")),
    }).drop("_r", "_n")


def top_share(df: DataFrame, by: Sequence[str], col: str, takes: Mapping[str, Column],
              bound: Bound = Bound()) -> DataFrame:
    """Sum of the n largest values over the sum of all, per group; NULL unless the total is positive.

    ``takes[out]`` is n as a column of ``total`` (non-null rows). Ties are counted, not collected.
    """
    by = list(by)
    if _fits(bound):
        vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*by).orderBy(F.col(col))
        oc = vals.select(
            *by, col, "n", (F.sum("n").over(w) - F.col("n")).alias("below"),
            F.sum("n").over(Window.partitionBy(*by)).alias("total"),
        )
    else:
        oc = ordered_counts(df.select(*by, col), by, col)
    above = F.col("total") - F.col("below") - F.col("n")
    aggs = [F.sum(F.col(col) * F.col("n")).alias("_all")]
    for out, n in takes.items():
        used = F.greatest(F.lit(0), F.least(F.col("n"), n - above))
        aggs.append(F.sum(F.col(col) * used).alias(out))
    got = oc.groupBy(*by).agg(*aggs)
    return got.select(*by, *[F.when(F.col("_all") > 0, F.col(o) / F.col("_all")).alias(o) for o in takes])
