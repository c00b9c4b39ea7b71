"""Blended class probabilities, signal columns, position weights, and the portfolio backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Midpoints of the four return classes, blend weights and thresholds.
MIDPOINTS = (-0.10, 0.0, 0.10, 0.25)
BLEND = (0.6, 0.4)
STRONG_BUY, STRONG_SELL = 0.60, 0.40
WIN, LOSS = 0.10, 0.05
CLASSES = range(4)
# Parts of the score (bull probability, expected return relative to the best class, conviction) and the least score and conviction of each action.
SCORE_PARTS = (50, 30, 20)
STRONG_BUY_AT, BUY_AT, SELL_AT, WATCH_AT = (75, 0.60), (60, 0.50), (25, 0.60), 45


def blend(df: DataFrame, first: str = "xgb", second: str | None = "lstm", weights: tuple[float, float] = BLEND) -> DataFrame:
    """Add prob_class_0..3: the weighted mix of ``<first>_prob_k`` and ``<second>_prob_k``, summing to 1.

    Without a second model, or where its probabilities are null, the first stands alone.
    """
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("blend weights must sum to 1")
    mixed = []
    for k in CLASSES:
        a = F.col(f"{first}_prob_{k}")
        mixed.append(F.coalesce(weights[0] * a + weights[1] * F.col(f"{second}_prob_{k}"), a) if second else a)
    total = mixed[0] + mixed[1] + mixed[2] + mixed[3]
    return df.withColumns({f"prob_class_{k}": mixed[k] / total for k in CLASSES})


def signal_columns(df: DataFrame) -> DataFrame:
    """Add expected_return, predicted_class (first on ties), conviction, strong_buy and strong_sell."""
    p = [F.col(f"prob_class_{k}") for k in CLASSES]
    top = F.greatest(*p)
    expected = sum((m * x for m, x in zip(MIDPOINTS[1:], p[1:])), MIDPOINTS[0] * p[0])
    return df.withColumns(
        {
            "expected_return": expected,
            "predicted_class": (F.array_position(F.array(*p), top) - 1).cast("int"),
            "conviction": top,
            "strong_buy": (p[2] + p[3]) > STRONG_BUY,
            "strong_sell": p[0] > STRONG_SELL,
        }
    )


def summary(df: DataFrame) -> DataFrame:
    """One row: counts and shares of strong signals, means, and the histogram of classes."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_signals"),
        F.sum(F.col("strong_buy").cast("long")).alias("n_strong_buy"),
        F.sum(F.col("strong_sell").cast("long")).alias("n_strong_sell"),
        F.avg(F.col("strong_buy").cast("double")).alias("pct_strong_buy"),
        F.avg(F.col("strong_sell").cast("double")).alias("pct_strong_sell"),
        F.avg("expected_return").alias("mean_expected_return"),
        F.avg("conviction").alias("mean_conviction"),
        *[F.sum((F.col("predicted_class") == k).cast("long")).alias(f"n_class_{k}") for k in CLASSES],
    )


def top_signals(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` strong buys with the highest expected return; ties go by ticker and date."""
    return df.filter("strong_buy").orderBy(F.desc("expected_return"), "ticker", "date").limit(n)


def score_and_action(df: DataFrame) -> DataFrame:
    """Add score (0 to 100) and action by the configured weights and thresholds."""
    bull = F.col("prob_class_2") + F.col("prob_class_3")
    bulls, returns, convictions = SCORE_PARTS
    scored = df.withColumn("score", bull * bulls + F.col("expected_return") * 100 / 25 * returns + F.col("conviction") * convictions)
    score, sure = F.col("score"), F.col("conviction")
    above = lambda at: (score >= at[0]) & (sure >= at[1])
    sell = (score <= SELL_AT[0]) & (sure >= SELL_AT[1])
    action = F.when(above(STRONG_BUY_AT), "strong_buy").when(above(BUY_AT), "buy").when(sell, "sell").when(score >= WATCH_AT, "watch").otherwise("hold")
    return scored.withColumn("action", action)


def kelly(p_win: Column, win: float = WIN, loss: float = LOSS) -> Column:
    """Kelly fraction (p b - q) / b with b = win / loss; 0 where a loss costs nothing."""
    if loss <= 0:
        return F.lit(0.0)
    b = win / loss
    return (p_win * b - (1 - p_win)) / b


def position_weights(df: DataFrame, cap: float = 0.10, gross: float = 1.0, half: bool = True) -> DataFrame:
    """ticker, date, weight of every row: 0 outside classes 2 and 3 or where Kelly is not positive.

    Weights of a date are scaled down together where they exceed ``gross``.
    """
    f = kelly(F.col("prob_class_2") + F.col("prob_class_3"))
    raw = F.when(F.col("predicted_class").isin(2, 3) & (f > 0), F.least(f * (0.5 if half else 1.0), F.lit(cap))).otherwise(0.0)
    total = F.sum("raw").over(W.partitionBy("date"))
    return df.withColumn("raw", raw).withColumn("weight", F.col("raw") * F.when(total > gross, gross / total).otherwise(1.0)).drop("raw")


def turnover(weights: DataFrame) -> DataFrame:
    """date, turnover: sum of absolute weight changes since the date before, over all tickers of either.

    A weight is compared with the ticker's weight of the date before; a ticker that is gone counts
    on the date after its last one.  No grid of dates and tickers is built.
    """
    dates = weights.select("date").distinct()
    calendar = dates.select("date", F.lag("date").over(W.orderBy("date")).alias("before"), F.lead("date").over(W.orderBy("date")).alias("after"))
    rows = weights.filter("weight <> 0").select("ticker", "date", "weight").join(F.broadcast(calendar), "date")  # one row per date
    seen = W.partitionBy("ticker").orderBy("date")
    rows = rows.withColumns({"last": F.lag("date").over(seen), "last_weight": F.lag("weight").over(seen), "next": F.lead("date").over(seen)})
    change = F.when(F.col("last") == F.col("before"), F.abs(F.col("weight") - F.col("last_weight"))).otherwise(F.abs("weight"))
    gone = F.col("after").isNotNull() & (F.col("next").isNull() | (F.col("next") != F.col("after")))
    moves = rows.select("date", change.alias("moved")).unionByName(rows.filter(gone).select(F.col("after").alias("date"), F.abs("weight").alias("moved")))
    return dates.join(moves.groupBy("date").agg(F.sum("moved").alias("turnover")), "date", "left").select("date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def equity_curve(signals: DataFrame, actual: DataFrame, cost_bps: float = 10.0, capital: float = 100_000.0, **weighting) -> DataFrame:
    """date, period_return, turnover, factor, equity.

    Every date's return is weight times actual return, less costs on turnover; equity is the running
    product of the factors.  The window sees one row per date; a factor of 0 or less ends in an
    ordered product by sign and logarithm.
    """
    merged = position_weights(signals.join(actual, ["ticker", "date"]), **weighting)
    gains = merged.groupBy("date").agg(F.sum(F.col("weight") * F.col("actual_return")).alias("period_return"))
    daily = gains.join(turnover(merged), "date").withColumn("factor", 1 + F.col("period_return") - F.col("turnover") * (cost_bps / 10_000))
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    zero = F.max((F.col("factor") == 0).cast("int")).over(w)
    sign = F.pow(F.lit(-1.0), F.sum((F.col("factor") < 0).cast("int")).over(w))
    size = F.exp(F.coalesce(F.sum(F.when(F.col("factor") != 0, F.ln(F.abs("factor")))).over(w), F.lit(0.0)))
    return daily.withColumn("equity", F.when(zero == 1, 0.0).otherwise(capital * sign * size))


def trades(signals: DataFrame, actual: DataFrame, **weighting) -> DataFrame:
    merged = position_weights(signals.join(actual, ["ticker", "date"]), **weighting)
    return merged.filter("weight > 0").select("date", "ticker", "weight", "actual_return", (F.col("weight") * F.col("actual_return")).alias("pnl_pct"), "predicted_class", "expected_return")


def drawdown(curve: DataFrame) -> DataFrame:
    """curve with drawdown: (equity - highest so far) / highest so far."""
    top = F.max("equity").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("drawdown", (F.col("equity") - top) / F.nullif(top, F.lit(0.0)))


def metrics(curve: DataFrame, made: DataFrame) -> DataFrame:
    """One row: total and annualised return, Sharpe, worst drawdown, win rate, numbers of trades and periods."""
    change = F.try_divide(F.col("equity"), F.nullif(F.lag("equity").over(W.orderBy("date")), F.lit(0.0))) - 1
    rows = drawdown(curve).withColumn("r", change)
    total = F.max_by("equity", "date") / F.min_by("equity", "date") - 1
    days = F.datediff(F.max("date"), F.min("date"))
    one = rows.agg(
        total.alias("total_return"),
        F.when(days > 0, F.pow(1 + total, F.lit(365.0) / F.nullif(days, F.lit(0))) - 1).otherwise(0.0).alias("annualized_return"),
        F.coalesce(F.when(F.stddev_samp("r") > 0, F.avg("r") / F.stddev_samp("r") * 252**0.5), F.lit(0.0)).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    won = made.agg(F.coalesce(F.avg((F.col("pnl_pct") > 0).cast("double")), F.lit(0.0)).alias("win_rate"), F.count(F.lit(1)).alias("n_trades"))
    return one.crossJoin(won)  # one row each


def against_benchmark(curve: DataFrame, benchmark: DataFrame) -> DataFrame:
    """date, portfolio, benchmark: both 100 at the first date; the benchmark compounds its returns and holds on gaps.

    ``benchmark`` is (date, benchmark_return).
    """
    w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    level = benchmark.select("date", (100 * F.exp(F.sum(F.ln(1 + F.coalesce("benchmark_return", F.lit(0.0)))).over(w))).alias("level"))
    both = curve.select("date", "equity").join(level, "date", "left").withColumn("level", F.last("level", ignorenulls=True).over(w))
    first = lambda c: F.first(c, ignorenulls=True).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.select("date", (F.col("equity") / first("equity") * 100).alias("portfolio"), (F.col("level") / first("level") * 100).alias("benchmark")).filter("benchmark is not null")
