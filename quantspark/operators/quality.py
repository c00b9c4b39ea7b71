"""Data-quality checks and exploratory statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by, correlation, rolling


def rsi_out_of_range(df: DataFrame, column: str = "rsi_14") -> DataFrame:
    return df.filter((F.col(column) < 0) | (F.col(column) > 100)).select("stock_id", "date", F.lit("rsi_range").alias("check"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def non_null_share(df: DataFrame, columns: Sequence[str]) -> Column:
    """Share of the columns that a row has a value in."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int")) / len(columns)


def null_explosion(df: DataFrame, columns: Sequence[str], least: float = 0.2) -> DataFrame:
    return df.withColumn("share", non_null_share(df, columns)).filter(F.col("share") < least).select("stock_id", "date", F.lit("null_explosion").alias("check"))


def warnings(technical: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All findings as (stock_id, date, check)."""
    twice = duplicate_keys(technical, ["stock_id", "date"]).select("stock_id", "date", F.lit("duplicate_key").alias("check"))
    return rsi_out_of_range(technical).unionByName(twice).unionByName(null_explosion(technical, columns))


def stale(stocks: DataFrame, bars: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Stocks without a price, or whose last price is more than ``days`` days before ``as_of``."""
    last = bars.groupBy("stock_id").agg(F.max("date").alias("last_date"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_date")
    return stocks.join(last, "stock_id", "left").filter(F.col("last_date").isNull() | (age > days)).select("stock_id", "ticker", "last_date")


def row_coverage(stocks: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table by stock; every table is grouped once."""
    out = stocks.select("stock_id", "ticker")
    for name, df in tables.items():
        out = out.join(df.groupBy("stock_id").agg(F.count(F.lit(1)).alias(name)), "stock_id", "left")
    return out.select("stock_id", "ticker", *[F.coalesce(n, F.lit(0)).alias(n) for n in tables])


def correlation_pairs(returns: DataFrame, key: str, value: str, block_dates: int = 256, tile: int = 512) -> DataFrame:
    """a, b, correlation of every two entities (a <= b) over dates that both have.

    Rows are dealt to blocks of dates and pairs of tiles of entities; a block's sums come from products
    of its matrix [date, entity] with itself, so before the products a row costs one copy per tile.
    Blocks hold at most about ``block_dates`` x 2 ``tile`` values; their sums are added up by pair.
    Repeated rows of an entity and date count once (the largest value), nulls do not count.
    """
    rows = returns.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("e"), "date").agg(F.max(F.col(value).cast("double")).alias("x"))
    sizes = returns.agg(F.approx_count_distinct("date").alias("dates"), F.approx_count_distinct(key).alias("entities")).first()
    blocks, tiles = (max(1, -(-n // size)) for n, size in ((sizes["dates"], block_dates), (sizes["entities"], tile)))
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("date"), F.lit(blocks)).cast("int"), "tile": F.pmod(F.xxhash64("e"), F.lit(tiles)).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        entities, col = np.unique(pdf["e"].to_numpy(), return_inverse=True)
        days, row = np.unique(pdf["date"].to_numpy(), return_inverse=True)
        x, has = np.zeros((len(days), len(entities))), np.zeros((len(days), len(entities)))
        x[row, col], has[row, col] = pdf["x"].to_numpy(), 1.0
        tile_of = np.zeros(len(entities), int)
        tile_of[col] = pdf["tile"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        n, once, square, both = has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x
        pair = (np.arange(len(entities))[:, None] <= np.arange(len(entities))) & (n > 0)
        if lo != hi:
            pair &= tile_of[:, None] != tile_of
        a, b = np.nonzero(pair)
        parts = (n[a, b], once[a, b], once[b, a], square[a, b], square[b, a], both[a, b])
        return pd.DataFrame({"a": entities[a], "b": entities[b], **dict(zip(sums, parts))})

    kind = returns.schema[key].dataType.simpleString()
    found = dealt.groupBy("block", "lo", "hi").applyInPandas(products, f"a {kind}, b {kind}, " + ", ".join(f"{s} double" for s in sums))
    c = found.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in sums])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    least = lambda s, ss: F.when(spread(s, ss) > 1e-12 * F.col("n") * F.col(ss), spread(s, ss))  # noqa: E731  null without spread
    return c.select("a", "b", ((F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(least("sa", "saa") * least("sb", "sbb"))).alias("correlation"))


def rolling_correlation(pairs: DataFrame, key: str, x: str, y: str, n: int = 90) -> DataFrame:
    ws = by(key)
    w = ws.rowsBetween(-(n - 1), 0)
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(w)
    return pairs.select(key, "date", F.when(both == n, correlation(x, y, w)).alias("correlation"))


def index_to_100(bars: DataFrame) -> DataFrame:
    """Closes as a percentage of the stock's first close."""
    from pyspark.sql import Window as W

    first = F.first("close").over(by("stock_id").rowsBetween(W.unboundedPreceding, 0))
    return bars.select("stock_id", "date", (F.col("close") / F.nullif(first, F.lit(0.0)) * 100).alias("indexed"))


def shape(df: DataFrame, key: str, x: str) -> DataFrame:
    """n, mean, std, and bias-corrected skewness and excess kurtosis of each group."""
    n = F.count(x).cast("double")
    spread = F.stddev_samp(x)
    skew = F.when((n > 2) & (spread > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when((n > 3) & (spread > 0), F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3)))
    return df.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), spread.alias("std"), skew.alias("skew"), kurt.alias("kurt"))


def percentile_of_score(df: DataFrame, key: str, x: str, score: str) -> DataFrame:
    """Mean of the strict and weak shares of values below the group's score, in percent."""
    strict = F.avg((F.col(x) < F.col(score)).cast("double"))
    weak = F.avg((F.col(x) <= F.col(score)).cast("double"))
    return df.groupBy(key).agg(((strict + weak) / 2 * 100).alias("percentile"))


def rolling_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    ws = by("stock_id")
    before = F.lag("close").over(ws)
    rows = bars.withColumn("r", F.ln(F.try_divide(F.col("close"), F.nullif(before, F.lit(0.0)))))
    return rows.select("stock_id", "date", (rolling(F.stddev_samp, "r", ws, n) * 252**0.5).alias("volatility"))


def histogram(df: DataFrame, key: str, x: str, bins: int = 100) -> DataFrame:
    """key, bin, low, high, n, density, normal: even bins between each group's least and largest value.

    Empty bins are left out; ``normal`` is the density of the normal distribution of the group's mean
    and deviation at the bin's middle.  A group of one value has one bin of no width and null densities.
    """
    ends = df.groupBy(key).agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("all"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.try_divide(F.col(x) - F.col("least"), F.col("most") - F.col("least")) * bins)))
    rows = df.filter(F.col(x).isNotNull()).join(ends, key).groupBy(key, F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "least", "most", "mean", "std", "all").agg(F.count(F.lit(1)).alias("n"))
    low, high = F.col("least") + F.col("bin") * width, F.col("least") + (F.col("bin") + 1) * width
    z = F.try_divide((low + high) / 2 - F.col("mean"), F.col("std"))
    normal = F.try_divide(F.exp(-z * z / 2), F.col("std") * (2 * math.pi) ** 0.5)
    return rows.select(key, "bin", low.alias("low"), high.alias("high"), "n", F.try_divide(F.col("n"), F.col("all") * width).alias("density"), normal.alias("normal"))


# Coefficients of a published rational approximation to the normal quantile (relative error about 1e-9).
_TAIL = 0.02425
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal lies with probability ``p``; null outside (0, 1)."""

    def polynomial(coefficients, x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    middle = p - 0.5
    tail = lambda q: polynomial(_C, F.sqrt(-2 * F.ln(q))) / polynomial(_D, F.sqrt(-2 * F.ln(q)))
    centre = polynomial(_A, middle * middle) * middle / polynomial(_B, middle * middle)
    return F.when((p <= 0) | (p >= 1), None).when(p < _TAIL, tail(p)).when(p > 1 - _TAIL, -tail(1 - p)).otherwise(centre)


def quantile_plot(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, rank, theoretical, sample, fitted: ordered values beside the normal quantiles of their median ranks and the line through them."""
    from pyspark.sql import Window as W

    ws = W.partitionBy(key)
    ranked = df.filter(F.col(x).isNotNull()).select(key, F.col(x).alias("sample"), F.row_number().over(ws.orderBy(x)).alias("rank"), F.count(F.lit(1)).over(ws).alias("n"))
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    share = F.when(F.col("rank") == F.col("n"), last).when(F.col("rank") == 1, 1 - last).otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))
    placed = ranked.withColumn("theoretical", normal_quantile(share))
    line = placed.groupBy(key).agg(F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept"))
    return placed.join(line, key).select(key, "rank", "theoretical", "sample", (F.col("slope") * F.col("theoretical") + F.col("intercept")).alias("fitted"))
