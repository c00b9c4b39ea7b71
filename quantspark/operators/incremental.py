"""Technical features of new bars from a carried state, so that a day's bars cost a day.

The state of a stock is its last REACH bars and, at the last of them, its exponential means and
running sums.  New bars are appended to those and the ordinary features are computed over this short
series; windows of up to REACH rows then see what they would see in the whole history.  What has no
end to its memory is put right in closed form: an exponential mean that starts elsewhere differs
from the full one by a term that shrinks by a fixed factor with each row, a running sum by a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.safe import div, gap
from ..functions.windows import by, trend
from . import technical as T

#: Bars that a state keeps: the longest window (252 rows) and one on top of another (200 and 10) fit.
REACH = 260
#: Smoothing factors of the means whose inputs are bars, as the features define them.
MEANS = {
    "ema_10": 2 / 11, "ema_20": 2 / 21, "ema_50": 2 / 51, "fast": 2 / 13, "slow": 2 / 27, "atr_14": 2 / 15,
    "gain_7": 1 / 7, "loss_7": 1 / 7, "gain_14": 1 / 14, "loss_14": 1 / 14,
}
SIGNAL = 2 / 10
SUMS = ("obv", "accumulation_distribution", "volume_price_trend")
CARRIED = (*MEANS, "macd_signal", *SUMS)
STATE_KEY = ["stock_id"]


def _series(df: DataFrame) -> DataFrame:
    """Features of a series of bars and the columns that a state carries."""
    return T.price_features(df)


def _state(rows: DataFrame, bar_columns: list[str], count: Column) -> DataFrame:
    """The state after the last row of each stock: ``rows`` (all its bars so far), carried values, ``bars`` (the last REACH)."""
    at = F.row_number().over(W.partitionBy("stock_id").orderBy(F.desc("date")))
    numbered = rows.withColumns({"__back": at, "__rows": count})
    bars = F.sort_array(F.collect_list(F.struct("date", *[c for c in bar_columns if c not in ("stock_id", "date")])))
    last = lambda c: F.max(F.when(F.col("__back") == 1, F.col(c)))
    kept = numbered.filter(F.col("__back") <= REACH).groupBy("stock_id")
    return kept.agg(last("__rows").alias("rows"), last("date").alias("last_date"), *[last(c).alias(c) for c in CARRIED], bars.alias("bars"))


def start_state(bars: DataFrame) -> DataFrame:
    """The state after a history of bars, one row a stock: one pass over all of it."""
    return _state(_series(bars), bars.columns, F.col("rn"))


def _mended(df: DataFrame) -> DataFrame:
    """Put the means, sums and what is made of them right in the rows after the state.

    ``__at`` is the row's number after the state (0 or less inside it), ``__true`` the carried values.
    """
    whole = W.partitionBy("stock_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = lambda c: F.max(F.when(F.col("__at") == 0, F.col(c))).over(whole)
    off = {c: F.coalesce(F.max(F.col(f"__true.{c}")).over(whole) - here(c), F.lit(0.0)) for c in (*MEANS, *SUMS, "macd_signal")}
    df = df.withColumns({f"__off_{c}": x for c, x in off.items()})
    n, at = F.greatest(F.col("__at"), F.lit(0)), lambda c: F.col(f"__off_{c}")
    shrunk = lambda c: at(c) * F.pow(F.lit(1 - MEANS[c]), n)
    keep = 1 - SIGNAL

    def through_signal(c: str) -> Column:
        """What the mean of a shrinking difference has gathered after n rows."""
        own = 1 - MEANS[c]
        return at(c) * SIGNAL * own * (F.pow(F.lit(own), n) - F.pow(F.lit(keep), n)) / (own - keep)

    signal = F.col("macd_signal") + at("macd_signal") * F.pow(F.lit(keep), n) + through_signal("fast") - through_signal("slow")
    after = lambda x: F.when(F.col("__at") >= 0, x)  # noqa: E731  earlier rows are not put right, and not used
    right = {c: after(F.col(c) + shrunk(c)) for c in MEANS} | {c: F.col(c) + at(c) for c in SUMS} | {"macd_signal": after(signal)}
    df = df.withColumns(right).withColumn("macd", F.col("fast") - F.col("slow"))
    return df.withColumns(
        {
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
            "rsi_14": T._rsi(14),
            "rsi_7": T._rsi(7),
            "ema50_vs_sma200": gap("ema_50", "sma_200"),
            "atr_pct": div("atr_14", "close"),
            "obv_trend": trend("obv", by("stock_id"), 20),
            **{f"price_vs_ema{k}": gap("close", f"ema_{k}") for k in (10, 20, 50)},
        }
    )


def advance(state: DataFrame, bars: DataFrame, benchmark: DataFrame, sector_funds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of ``bars``, all later than their stock's state, and the state after them.

    Stocks without a state start with their first bar; those without new bars keep their state.  Bars
    that are not later than the state are passed over.  Benchmark and funds may begin with the oldest bar of
    the states; beta needs its 60 shared dates among the state's bars.  The features are those that
    the whole history would give, but for rounding.
    """
    names = bars.columns
    carried = F.struct(*CARRIED).alias("__true")
    fresh = bars.join(state.select("stock_id", "rows", "last_date", carried), "stock_id", "left").filter(F.col("last_date").isNull() | (F.col("date") > F.col("last_date")))
    old = state.select("stock_id", "rows", "last_date", carried, F.explode("bars").alias("__bar")).select("stock_id", "rows", "last_date", "__true", "__bar.*")
    both = old.select(*names, "rows", "last_date", "__true").unionByName(fresh.select(*names, "rows", "last_date", "__true"))
    new = (F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).cast("int")
    both = both.withColumn("__at", F.sum(new).over(by("stock_id").rowsBetween(W.unboundedPreceding, 0)))  # 0 at the state's last row, as before it
    last = F.max(F.when(F.col("__at") == 0, F.col("date"))).over(W.partitionBy("stock_id"))
    both = both.withColumn("__at", F.when((F.col("__at") == 0) & (F.col("date") < last), F.lit(-1)).otherwise(F.col("__at")))
    df = _mended(T.relative_strength(_series(both), benchmark, sector_funds))
    count = F.coalesce("rows", F.lit(0)) + F.greatest(F.col("__at"), F.lit(0))
    features = df.filter((F.col("__at") > 0) & (count >= T.LEAST_ROWS)).join(T.beta_and_correlation(both.select(*names), benchmark), ["stock_id", "date"], "left")
    return features.select("stock_id", "date", *T.FEATURES), _state(df, names, count)
