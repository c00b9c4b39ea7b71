"""All registered queries of the market engine."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["technical", "fundamental", "market_context", "modelling", "storage"]


def _merged(attribute: str) -> dict:
    found: dict = {}
    for group in GROUPS:
        found |= getattr(import_module(f"quantspark.plans.{group}"), attribute)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")


def flagship(spark, sf_dir):
    """Sector, label, rows, and mean RSI and momentum of the labelled dates."""
    from pyspark.sql import functions as F

    from ..operators import labels as L
    from ..operators import technical as T
    from ..sources import market as M

    bars, stocks = M.bars(spark, sf_dir), M.stocks(spark, sf_dir)
    features = T.momentum(T.moving_averages(T._base(bars))).filter(F.col("rn") >= T.LEAST_ROWS).select("stock_id", "date", "rsi_14", "price_vs_sma50", "momentum_30d")
    rows = L.forward_returns(bars).filter("label is not null").join(features, ["stock_id", "date"]).join(F.broadcast(stocks), "stock_id")
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("rsi_14", "price_vs_sma50", "momentum_30d")]
    return rows.groupBy("sector", "label").agg(F.count(F.lit(1)).alias("n"), *means)
