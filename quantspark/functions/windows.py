"""Time-series building blocks over long tables: one row per entity and date.

All of them partition by the entity, so a table that is already partitioned that way is not
shuffled again.  Trailing windows are complete: null until the frame has ``n`` values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

#: Rows after which a value has no measurable part in an average of smoothing factor 0.039 or more.
EWMA_BLOCK = 1000


def by(entity: str | Sequence[str], date: str = "date") -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return W.partitionBy(*keys).orderBy(date)


def trailing(ws: WindowSpec, n: int) -> WindowSpec:
    return ws.rowsBetween(-(n - 1), 0)


def running(ws: WindowSpec) -> WindowSpec:
    return ws.rowsBetween(W.unboundedPreceding, 0)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(fn, x, ws: WindowSpec, n: int) -> Column:
    """``fn`` over the last ``n`` rows, null unless all ``n`` have a value."""
    w = trailing(ws, n)
    return F.when(F.count(_col(x)).over(w) == n, fn(_col(x)).over(w))


def trend(x, ws: WindowSpec, n: int, row: str = "rn") -> Column:
    """Least-squares slope over the last ``n`` rows, relative to their mean."""
    w, c = trailing(ws, n), _col(x)
    mean = F.avg(c).over(w)
    return F.when((F.count(c).over(w) == n) & (mean != 0), F.regr_slope(c, F.col(row).cast("double")).over(w) / mean)


def correlation(x, y, w: WindowSpec) -> Column:
    """Correlation of pairs without nulls in a frame; null where one side does not vary (the built-in function fails there under ANSI rules)."""
    spread = F.stddev_samp(_col(x)).over(w) * F.stddev_samp(_col(y)).over(w)
    return F.try_divide(F.covar_samp(_col(x), _col(y)).over(w), F.nullif(spread, F.lit(0.0)))


def change(x, ws: WindowSpec, rows: int) -> Column:
    """x / (x ``rows`` rows ago) - 1."""
    before = F.lag(_col(x), rows).over(ws)
    return F.try_divide(_col(x), F.nullif(before, F.lit(0.0))) - 1


def forward_fill(x, ws: WindowSpec) -> Column:
    return F.last(_col(x), ignorenulls=True).over(running(ws))


def fill_both_ways(x, ws: WindowSpec, default: float = 0.0) -> Column:
    """Last value, else the next one, else the default.  The next one is from the future of the row."""
    ahead = F.first(_col(x), ignorenulls=True).over(ws.rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(forward_fill(x, ws), ahead, F.lit(default))


def ewma(df: DataFrame, columns: Mapping[str, tuple[str, float]], entity: str = "stock_id", date: str = "date") -> DataFrame:
    """Add exponentially weighted means: ``{name: (input column, smoothing factor)}``.

    y[0] = x[0], y[t] = a x[t] + (1 - a) y[t - 1].  Unrolled, that is a sum with weights that grow by
    a power with each row; the powers restart every EWMA_BLOCK rows, so they stay in range for
    series of any length, and the block before gives the value to go on from.  Inputs must not have
    nulls.  Smoothing factors below 0.039 would need longer blocks and are refused.
    """
    ws = by(entity, date)
    rows = df.withColumn("__t", F.row_number().over(ws) - 1)
    rows = rows.withColumns({"__block": F.floor(F.col("__t") / EWMA_BLOCK), "__i": F.pmod("__t", F.lit(EWMA_BLOCK))})
    inside = running(W.partitionBy(entity, "__block").orderBy("__t"))
    earlier = ws.rowsBetween(W.unboundedPreceding, -1)
    local, final = {}, {}
    for name, (x, a) in columns.items():
        if not 0.039 <= a < 0.5:
            raise ValueError(f"smoothing factor {a} is outside [0.039, 0.5)")
        keep = F.lit(1.0 - a)
        weight = F.when(F.col("__t") == 0, F.lit(1.0)).otherwise(F.lit(a))
        local[f"__l_{name}"] = F.pow(keep, F.col("__i")) * F.sum(weight * F.col(x) * F.pow(keep, -F.col("__i"))).over(inside)
        last = F.last(F.when(F.col("__i") == EWMA_BLOCK - 1, F.col(f"__l_{name}")), ignorenulls=True).over(earlier)
        final[name] = F.col(f"__l_{name}") + F.when(F.col("__block") > 0, F.coalesce(last, F.lit(0.0)) * F.pow(keep, F.col("__i") + 1)).otherwise(0.0)
    return rows.withColumns(local).withColumns(final).drop("__t", "__block", "__i", *local)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], date: str = "date", values: Sequence[str] | None = None, right_date: str | None = None) -> DataFrame:
    """Left rows with the latest right row of the same keys whose date is not later.

    Both sides are stacked, and each left row takes the last right row before it: one shuffle by
    key, no join.  Without keys the right side must be small enough for one task.
    """
    values = list(values or [c for c in right.columns if c not in keys and c != date])
    packed = F.struct(*[F.col(v) for v in values], *([F.col(date).alias(right_date)] if right_date else []))
    names = values + ([right_date] if right_date else [])
    a = left.withColumns({"__right": F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType), "__side": F.lit(1)})
    b = right.select(*keys, F.col(date), packed.alias("__right"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(date, "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*left.columns, *[F.col(f"__found.{n}").alias(n) for n in names])


def calendar_fill(spine: DataFrame, series: DataFrame, date: str = "date") -> DataFrame:
    """As-of values of one small keyless series at every distinct date of ``spine``.

    The result has one row per date and is joined by equality.  One task sees the distinct dates
    and the series, which grow with the length of time only.
    """
    values = [c for c in series.columns if c != date]
    dates = spine.select(date).union(series.select(date)).distinct()
    w = W.orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    packed = series.select(date, F.struct(*values).alias("__s"))
    filled = dates.join(packed, date, "left").withColumn("__s", F.last("__s", ignorenulls=True).over(w))
    return filled.select(date, *[F.col(f"__s.{v}").alias(v) for v in values])


def latest_per_key(df: DataFrame, keys: Sequence[str], date: str = "date", ties: Sequence[str] = ()) -> DataFrame:
    """The row of the latest date for each key."""
    w = W.partitionBy(*keys).orderBy(F.desc(date), *ties)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
