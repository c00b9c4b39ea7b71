"""The 61 technical features, for all stocks and dates in one plan.

Input bars: stock_id, date, high, low, close (adjusted), volume, and for relative strength the
benchmark's and the sector fund's close.  All windows partition by stock, so one shuffle serves
them.  Spans called "10d" reach 9 rows back, as the source definitions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import div, gap, nonzero
from ..functions.windows import by, calendar_fill, asof_join, change, correlation, ewma, rolling, running, trailing, trend

def _ws():
    return by("stock_id")


#: Rows of history below which a stock has no features.
LEAST_ROWS = 20
YEAR = 252.0

FEATURES = (
    "sma_10 sma_20 sma_50 sma_100 sma_200 ema_10 ema_20 ema_50 price_vs_sma50 price_vs_sma200 sma50_vs_sma200 sma50_slope sma200_slope "
    "rsi_14 rsi_7 macd macd_signal macd_histogram stochastic_k stochastic_d williams_r momentum_10d momentum_30d momentum_90d "
    "bollinger_upper bollinger_lower bollinger_pct_b bollinger_bandwidth atr_14 realized_vol_20d realized_vol_60d vol_ratio "
    "volume_ratio_10d volume_ratio_30d volume_trend_20d obv obv_trend accumulation_distribution volume_price_trend "
    "relative_strength_vs_spy relative_strength_vs_sector beta_60d correlation_spy_60d "
    "price_vs_sma10 price_vs_sma20 price_vs_ema10 price_vs_ema20 price_vs_ema50 ema50_vs_sma200 momentum_5d momentum_180d "
    "roc_5d roc_10d roc_20d high_52w_pct low_52w_pct daily_return weekly_return cci_14 mfi_14 atr_pct"
).split()


def _base(bars: DataFrame) -> DataFrame:
    """Columns that several features share."""
    prior = F.lag("close").over(_ws())
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    first = bars.withColumns({"rn": F.row_number().over(_ws()), "prior": prior, "tp": typical, "v": F.col("volume").cast("double")})
    step = F.col("close") - F.col("prior")
    tp_step = F.col("tp") - F.lag("tp").over(_ws())
    spread = F.col("high") - F.col("low")
    return first.withColumns(
        {
            "gain": F.when(step > 0, step).otherwise(0.0),
            "loss": F.when(step < 0, -step).otherwise(0.0),
            "true_range": F.greatest(spread, F.abs(F.col("high") - F.col("prior")), F.abs(F.col("low") - F.col("prior"))),
            "log_return": F.ln(div("close", "prior")),
            "signed_volume": F.coalesce(F.signum(step) * F.col("v"), F.lit(0.0)),
            "flow": F.coalesce(div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread) * F.col("v"), F.lit(0.0)),
            "moved_volume": F.coalesce(div(step, "prior") * F.col("v"), F.lit(0.0)),
            "up_flow": F.when(tp_step > 0, F.col("tp") * F.col("v")).otherwise(0.0),
            "down_flow": F.when(tp_step < 0, F.col("tp") * F.col("v")).otherwise(0.0),
        }
    )


def moving_averages(df: DataFrame) -> DataFrame:
    sma = {f"sma_{n}": rolling(F.avg, "close", _ws(), n) for n in (10, 20, 50, 100, 200)}
    df = ewma(df.withColumns(sma), {f"ema_{n}": ("close", 2 / (n + 1)) for n in (10, 20, 50)})
    gaps = {f"price_vs_{m.replace('_', '')}": gap("close", m) for m in ("sma_10", "sma_20", "sma_50", "sma_200", "ema_10", "ema_20", "ema_50")}
    return df.withColumns(
        gaps
        | {
            "sma50_vs_sma200": gap("sma_50", "sma_200"),
            "ema50_vs_sma200": gap("ema_50", "sma_200"),
            "sma50_slope": trend("sma_50", _ws(), 10),
            "sma200_slope": trend("sma_200", _ws(), 10),
        }
    )


def _rsi(n: int) -> Column:
    return 100 - 100 / (1 + F.col(f"gain_{n}") / nonzero(f"loss_{n}"))


def momentum(df: DataFrame) -> DataFrame:
    inputs = {f"{side}_{n}": (side, 1 / n) for n in (7, 14) for side in ("gain", "loss")}
    df = ewma(df, inputs | {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)}).withColumn("macd", F.col("fast") - F.col("slow"))
    df = ewma(df, {"macd_signal": ("macd", 2 / 10)})
    low, high = rolling(F.min, "low", _ws(), 14), rolling(F.max, "high", _ws(), 14)
    df = df.withColumns({"low14": low, "high14": high, "macd_histogram": F.col("macd") - F.col("macd_signal"), "rsi_14": _rsi(14), "rsi_7": _rsi(7)})
    room = F.col("high14") - F.col("low14")
    df = df.withColumn("stochastic_k", F.when(room != 0, (F.col("close") - F.col("low14")) / nonzero(room) * 100))
    spans = {5: "momentum_5d", 10: "momentum_10d", 30: "momentum_30d", 90: "momentum_90d", 180: "momentum_180d"}
    return df.withColumns(
        {
            "stochastic_d": rolling(F.avg, "stochastic_k", _ws(), 3),
            "williams_r": (F.col("high14") - F.col("close")) / nonzero(room) * -100,
            **{name: change("close", _ws(), n - 1) for n, name in spans.items()},
            "roc_5d": change("close", _ws(), 4),
            "weekly_return": change("close", _ws(), 4),
            "roc_10d": change("close", _ws(), 9),
            "roc_20d": change("close", _ws(), 19),
            "daily_return": change("close", _ws(), 1),
        }
    )


def volatility(df: DataFrame) -> DataFrame:
    df = ewma(df, {"atr_14": ("true_range", 2 / 15)})
    df = df.withColumns(
        {
            "sd20": rolling(F.stddev_samp, "close", _ws(), 20),
            "m20": rolling(F.avg, "close", _ws(), 20),
            "realized_vol_20d": F.stddev_samp("log_return").over(trailing(_ws(), 20)) * YEAR**0.5,
            "realized_vol_60d": F.stddev_samp("log_return").over(trailing(_ws(), 60)) * YEAR**0.5,
        }
    )
    df = df.withColumns({"bollinger_upper": F.col("m20") + 2 * F.col("sd20"), "bollinger_lower": F.col("m20") - 2 * F.col("sd20")})
    width = F.col("bollinger_upper") - F.col("bollinger_lower")
    return df.withColumns(
        {
            "bollinger_pct_b": div(F.col("close") - F.col("bollinger_lower"), width),
            "bollinger_bandwidth": div(width, "m20"),
            "vol_ratio": div("realized_vol_20d", "realized_vol_60d"),
            "atr_pct": div("atr_14", "close"),
        }
    )


def volume(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {
            "obv": F.sum("signed_volume").over(running(_ws())),
            "accumulation_distribution": F.sum("flow").over(running(_ws())),
            "volume_price_trend": F.sum("moved_volume").over(running(_ws())),
            "volume_ratio_10d": div(nonzero("v"), rolling(F.avg, "v", _ws(), 10)),
            "volume_ratio_30d": div(nonzero("v"), rolling(F.avg, "v", _ws(), 30)),
            "volume_trend_20d": trend("v", _ws(), 20),
        }
    )
    return df.withColumn("obv_trend", trend("obv", _ws(), 20))


def extended(df: DataFrame) -> DataFrame:
    high, low = F.max("high").over(trailing(_ws(), 252)), F.min("low").over(trailing(_ws(), 252))
    typical = F.collect_list("tp").over(trailing(_ws(), 14))
    df = df.withColumns({"tp14": rolling(F.avg, "tp", _ws(), 14), "tps": typical})
    spread = F.aggregate("tps", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("tp14"))) / 14
    return df.withColumns(
        {
            "high_52w_pct": div(F.col("close") - high, high),
            "low_52w_pct": div(F.col("close") - low, low),
            "cci_14": div(F.col("tp") - F.col("tp14"), 0.015 * spread),
            "mfi_14": 100 - 100 / (1 + rolling(F.sum, "up_flow", _ws(), 14) / nonzero(rolling(F.sum, "down_flow", _ws(), 14))),
        }
    ).drop("tps")


def relative_strength(df: DataFrame, benchmark: DataFrame, sector_funds: DataFrame) -> DataFrame:
    """20-row returns against the benchmark and the sector fund, both as of the stock's dates."""
    at_dates = calendar_fill(df, benchmark.withColumnRenamed("close", "market"))
    funds = sector_funds.withColumnRenamed("close", "fund")
    # one as-of pass per sector and date, not per stock
    days = df.select("sector_id", "date").distinct()
    fund_at = asof_join(days, funds, ["sector_id"], values=["fund"])
    df = df.join(at_dates, "date", "left").join(fund_at, ["sector_id", "date"], "left")
    mine = change("close", _ws(), 19)
    return df.withColumns(
        {
            "relative_strength_vs_spy": div(mine, change("market", _ws(), 19)),
            "relative_strength_vs_sector": div(mine, change("fund", _ws(), 19)),
        }
    )


def beta_and_correlation(df: DataFrame, benchmark: DataFrame, pairs: int = 60) -> DataFrame:
    """Beta and correlation over the last ``pairs`` dates that stock and benchmark share."""
    market = benchmark.withColumn("market_return", change("close", by([]), 1)).select("date", "market_return")  # one row per date
    both = (
        df.select("stock_id", "date", change("close", _ws(), 1).alias("r"))
        .join(market, "date")
        .filter(F.col("r").isNotNull() & F.col("market_return").isNotNull())
    )
    w = trailing(_ws(), pairs)
    enough = F.count(F.lit(1)).over(w) == pairs
    spread = F.var_samp("market_return").over(w)
    return both.select(
        "stock_id",
        "date",
        F.when(enough & (spread != 0), F.covar_samp("r", "market_return").over(w) / nonzero(spread)).alias("beta_60d"),
        F.when(enough & (spread != 0), correlation("r", "market_return", w)).alias("correlation_spy_60d"),
    )


def price_features(bars: DataFrame) -> DataFrame:
    """Every feature that needs the stock's own bars only, for all dates with enough history."""
    df = extended(volume(volatility(momentum(moving_averages(_base(bars))))))
    return df


def technical_features(bars: DataFrame, benchmark: DataFrame, sector_funds: DataFrame) -> DataFrame:
    """stock_id, date and the 61 features for every date from a stock's 20th row on."""
    df = relative_strength(price_features(bars), benchmark, sector_funds)
    df = df.join(beta_and_correlation(bars, benchmark), ["stock_id", "date"], "left")
    return df.filter(F.col("rn") >= LEAST_ROWS).select("stock_id", "date", *FEATURES)
