"""Declared schemas and keys of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from ..operators import fundamental, technical

_TYPES = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "date": T.DateType(), "ts": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType())}


def _schema(fields: str) -> T.StructType:
    """From ``name:type`` words; a bare name is a double."""
    out = T.StructType()
    for word in fields.split():
        name, _, kind = word.partition(":")
        out.add(name, _TYPES[kind or "d"])
    return out


MACRO = (
    "treasury_10y treasury_2y yield_curve_slope credit_spread credit_spread_change fed_funds_rate fed_rate_change_3m unemployment_rate unemployment_change cpi_yoy "
    "cpi_change_3m initial_claims initial_claims_4wk_avg m2_growth dollar_index dollar_change_30d vix_level vix_change_5d vix_percentile_1y market_breadth gdp_growth "
    "growth_vs_value " + " ".join(f"sector_{kind}_{s}" for kind in ("momentum", "relative_flow") for s in ("xlk", "xlf", "xlv", "xle", "xli", "xlp", "xly"))
)
SENTIMENT = (
    "reddit_mention_count_7d:l reddit_mention_change:l reddit_sentiment_avg_7d reddit_sentiment_std_7d reddit_bullish_ratio reddit_post_score_avg reddit_comment_ratio "
    "wsb_mention_flag:i news_volume_7d:l news_volume_change:l news_sentiment_avg_7d news_sentiment_30d news_sentiment_momentum negative_news_flag:i insider_buy_count_30d:l "
    "insider_sell_count_30d:l insider_net_sentiment insider_dollar_volume activist_filing_flag:i activist_stake_change:l material_event_count_30d:l negative_8k_flag:i"
)
_PROBABILITIES = " ".join(f"{m}_{k}" for m in ("prob_class", "xgb_prob", "lstm_prob") for k in range(4))

TABLES: dict[str, T.StructType] = {
    "stocks": _schema("id:l ticker:s cik:s company_name:s sector:s sector_etf:s industry:s is_active:i"),
    "daily_prices": _schema("stock_id:l date:date open high low close adj_close volume:l"),
    "sec_filings": _schema("stock_id:l accession_number:s form_type:s filed_date:date period_of_report:date raw_json:s processed:i is_negative_8k:i"),
    "insider_transactions": _schema("stock_id:l accession_number:s transaction_date:date insider_name:s insider_title:s transaction_type:s shares price_per_share total_value shares_owned_after"),
    "fundamental_features": _schema("stock_id:l date:date " + " ".join(fundamental.FEATURES)),
    "technical_features": _schema("stock_id:l date:date " + " ".join(technical.FEATURES)),
    "macro_features": _schema("date:date " + MACRO),
    "sentiment_features": _schema("stock_id:l date:date " + SENTIMENT),
    "predictions": _schema(f"stock_id:l prediction_date:date model_version:s {_PROBABILITIES} predicted_class:i confidence expected_return_pct bull_probability score action:s"),
    "positions": _schema("stock_id:l opened:date closed:date weight entry_price exit_price status:s"),
    "backtest_results": _schema("run_id:s date:date equity period_return turnover"),
    "pipeline_runs": _schema("run_id:s started:ts finished:ts status:s prices:l filings:l fundamental:l technical:l sentiment:l stale_tickers:strings qa_warnings:strings error_log:strings"),
    "model_runs": _schema(
        "version:s cutoff:date train_start:date validation_start:date trained_at:ts train_rows:l validation_rows:l rounds:ints accuracy log_loss sequence_accuracy folds:i top_features:strings"
    ),
    "schema_version": _schema("version:i description:s applied_at:ts"),
}

KEYS: dict[str, list[str]] = {
    "stocks": ["ticker"],
    "daily_prices": ["stock_id", "date"],
    "sec_filings": ["accession_number"],
    "fundamental_features": ["stock_id", "date"],
    "technical_features": ["stock_id", "date"],
    "macro_features": ["date"],
    "sentiment_features": ["stock_id", "date"],
    "predictions": ["stock_id", "prediction_date", "model_version"],
    "backtest_results": ["run_id", "date"],
    "schema_version": ["version"],
}

#: The column whose days tell the parts of a table apart; it is one of the table's keys.
DAYS: dict[str, str] = {
    "daily_prices": "date",
    "fundamental_features": "date",
    "technical_features": "date",
    "macro_features": "date",
    "sentiment_features": "date",
    "predictions": "prediction_date",
    "backtest_results": "date",
}
