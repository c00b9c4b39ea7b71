"""Training, inference and sequence datasets: point-in-time joins of the feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import asof_join, by, fill_both_ways, latest_per_key, trailing

# The 94 model features by source table, in model order.
TECHNICAL = (
    "rsi_14 rsi_7 macd macd_signal macd_histogram bollinger_pct_b bollinger_bandwidth realized_vol_20d realized_vol_60d "
    "volume_ratio_10d volume_ratio_30d volume_trend_20d momentum_10d momentum_30d momentum_90d relative_strength_vs_spy "
    "relative_strength_vs_sector beta_60d correlation_spy_60d price_vs_sma50 price_vs_sma200 sma50_vs_sma200 price_vs_sma20 "
    "price_vs_ema10 price_vs_ema20 atr_14 atr_pct stochastic_k stochastic_d williams_r cci_14 mfi_14 high_52w_pct low_52w_pct daily_return weekly_return"
).split()
SENTIMENT = (
    "reddit_mention_count_7d reddit_mention_change reddit_sentiment_avg_7d reddit_sentiment_std_7d reddit_bullish_ratio news_volume_7d "
    "news_sentiment_avg_7d news_sentiment_30d news_sentiment_momentum negative_news_flag insider_buy_count_30d insider_sell_count_30d "
    "insider_net_sentiment insider_dollar_volume wsb_mention_flag activist_filing_flag"
).split()
MACRO = (
    "vix_level vix_change_5d vix_percentile_1y yield_curve_slope treasury_10y treasury_2y fed_funds_rate fed_rate_change_3m credit_spread "
    "credit_spread_change gdp_growth unemployment_rate dollar_index dollar_change_30d sector_momentum_xlk sector_momentum_xlf growth_vs_value"
).split()
FUNDAMENTAL = (
    "pe_ratio pb_ratio ps_ratio earnings_yield fcf_yield ev_ebitda ev_revenue gross_margin operating_margin net_margin roe roa asset_turnover "
    "current_ratio debt_to_equity interest_coverage revenue_growth_yoy earnings_growth_yoy fcf_growth piotroski_f_score altman_z_score "
    "buyback_yield pe_vs_sector_avg roe_vs_sector net_margin_vs_sector"
).split()
# Columns of a sequence step and the table each comes from.
SEQUENCE = {
    "adj_close": "price", "volume": "price", "rsi_14": "technical", "macd": "technical", "macd_signal": "technical", "bollinger_pct_b": "technical",
    "realized_vol_20d": "technical", "volume_ratio_30d": "technical", "momentum_10d": "technical", "momentum_30d": "technical",
    "relative_strength_vs_spy": "technical", "insider_buy_count_30d": "sentiment", "insider_sell_count_30d": "sentiment",
    "reddit_sentiment_avg_7d": "sentiment", "news_sentiment_avg_7d": "sentiment", "vix_level": "macro", "yield_curve_slope": "macro", "credit_spread": "macro",
}
STEPS = 60


def feature_join(technical: DataFrame, stocks: DataFrame, sentiment: DataFrame, macro: DataFrame, fundamental: DataFrame) -> DataFrame:
    """Technical rows with sentiment of the same stock and date, macro of the date, and the latest fundamentals.

    Missing columns of a side are left out, so narrower feature tables join the same way.
    """
    pick = lambda df, names: [c for c in names if c in df.columns]
    base = technical.select("stock_id", "date", *pick(technical, TECHNICAL))
    base = asof_join(base, fundamental.withColumnRenamed("as_of", "date"), ["stock_id"], values=pick(fundamental, FUNDAMENTAL))
    base = base.join(sentiment.withColumnRenamed("as_of", "date").select("stock_id", "date", *pick(sentiment, SENTIMENT)), ["stock_id", "date"], "left")
    base = base.join(macro.select("date", *pick(macro, MACRO)), "date", "left")
    order = [c for c in (*TECHNICAL, *SENTIMENT, *MACRO, *FUNDAMENTAL) if c in base.columns]
    return base.join(F.broadcast(stocks.select("stock_id", "ticker")), "stock_id").select("stock_id", "ticker", "date", *order)


def training_set(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labelled feature rows; rows without a label are dropped."""
    return labels.filter(F.col("label").isNotNull()).join(features, ["stock_id", "date"])


def inference_set(features: DataFrame, as_of, tickers: Sequence[str] | None = None) -> DataFrame:
    """The latest feature row of each stock not later than ``as_of``."""
    rows = features.filter(F.col("date") <= F.lit(as_of))
    return latest_per_key(rows.filter(F.col("ticker").isin(list(tickers))) if tickers else rows, ["stock_id"])


def sequence_frame(price: DataFrame, technical: DataFrame, sentiment: DataFrame, macro: DataFrame) -> DataFrame:
    """One step per stock and date with the 18 sequence columns, null where a table has no row."""
    tables = {"technical": technical, "sentiment": sentiment.withColumnRenamed("as_of", "date")}
    out = price.withColumnRenamed("close", "adj_close").select("stock_id", "date", "adj_close", F.col("volume").cast("double").alias("volume"))
    for name, df in tables.items():
        out = out.join(df.select("stock_id", "date", *[c for c, t in SEQUENCE.items() if t == name and c in df.columns]), ["stock_id", "date"], "left")
    out = out.join(macro.select("date", *[c for c, t in SEQUENCE.items() if t == "macro" and c in macro.columns]), "date", "left")
    return out.select("stock_id", "date", *[c for c in SEQUENCE if c in out.columns])


def sequences(frame: DataFrame, columns: Sequence[str], steps: int = STEPS) -> DataFrame:
    """stock_id, date, sequence (steps x columns): the last ``steps`` rows of each stock and date.

    Gaps take the last value, else the next one, else 0; shorter histories are left out.
    """
    ws = by("stock_id")
    filled = frame.withColumns({c: fill_both_ways(c, ws) for c in columns})
    row = F.array(*[F.col(c).cast("float") for c in columns])
    out = filled.select("stock_id", "date", F.collect_list(row).over(trailing(ws, steps)).alias("sequence"))
    return out.filter(F.size("sequence") == steps)
