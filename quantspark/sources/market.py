"""The market tables this engine works on, derived from the order tables at hand.

A nation is a stock and its region the sector; line items are trades.  Bars are one row per stock
and ship date; the benchmark trades everything; a sector fund trades its region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("stock_id"), F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")
    )


def _ohlcv() -> list:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return [
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    ]


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    return items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_id, sector_id, date, high, low, close, volume."""
    return _trades(spark, sf_dir).groupBy(F.col("n_nationkey").cast("long").alias("stock_id"), F.col("n_regionkey").alias("sector_id"), "date").agg(*_ohlcv())


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close of the whole market."""
    items = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("date"))
    return items.groupBy("date").agg(*_ohlcv()).select("date", "close")


def sector_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector_id, date, close."""
    return _trades(spark, sf_dir).groupBy(F.col("n_regionkey").alias("sector_id"), "date").agg(*_ohlcv()).select("sector_id", "date", "close")


def style_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, growth, value: mean closes of the stocks with even ids and of those with odd ids."""
    even = F.col("stock_id") % 2 == 0
    return bars(spark, sf_dir).groupBy("date").agg(F.avg(F.when(even, F.col("close"))).alias("growth"), F.avg(F.when(~even, F.col("close"))).alias("value"))


#: Statement metrics, as sums over a quarter's orders of a stock's customers: status and share of the price.
METRICS = {
    "revenue": ("F,O,P", 1.0),
    "cost": ("F", 0.5),
    "gross_profit": ("O,P", 0.8),
    "operating_income": ("O", 0.5),
    "ebit": ("O", 0.55),
    "net_income": ("O", 0.4),
    "interest_expense": ("P", 0.25),
    "research": ("P", 0.2),
    "total_assets": ("F,O,P", 3.0),
    "current_assets": ("F,O", 0.75),
    "current_liabilities": ("F,P", 0.625),
    "inventory": ("P", 1.0),
    "receivables": ("O", 0.25),
    "cash": ("F", 0.25),
    "equity": ("F,O", 1.25),
    "long_term_debt": ("F", 0.375),
    "retained_earnings": ("O", 0.875),
    "goodwill": ("P", 0.125),
    "intangibles": ("P", 0.0625),
    "shares_issued": ("F,O,P", 0.01),
    "operating_cash_flow": ("F,O", 0.375),
    "free_cash_flow": ("F", 0.3125),
    "capital_expenditure": ("P", -0.1875),
    "repurchase": ("P", -0.0625),
}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall statements: stock_id, metric, period_end (quarter end), value."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    quarter_end = F.date_sub(F.add_months(F.trunc("o_orderdate", "quarter"), 3), 1)
    by_status = (
        orders.select("o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), quarter_end.alias("period_end"))
        .join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("stock_id"), "period_end")
        .agg(*[F.sum(F.when(F.col("o_orderstatus") == s, F.col("amount"))).cast("double").alias(s) for s in "FOP"])
    )
    values = []
    for name, (statuses, share) in METRICS.items():
        parts = [F.col(s) for s in statuses.split(",")]
        total = sum(parts[1:], parts[0])
        values.append(F.struct(F.lit(name).alias("metric"), (total * F.lit(share)).alias("value")))
    return by_status.select("stock_id", "period_end", F.explode(F.array(*values)).alias("m")).select(
        "stock_id", F.col("m.metric").alias("metric"), "period_end", F.col("m.value").alias("value")
    )


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stock of the values a data vendor gives ready-made."""
    customers = table(spark, sf_dir, "customer")
    bal = F.col("balance")
    return (
        customers.groupBy(F.col("c_nationkey").cast("long").alias("stock_id"))
        .agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"), F.count(F.lit(1)).cast("double").alias("n"))
        .select(
            "stock_id",
            (bal / F.col("n") / 10000).alias("return_on_equity"),
            (bal / F.col("n") / 25000).alias("return_on_assets"),
            F.lit(None).cast("double").alias("tax_rate"),
            (bal * 2).alias("total_debt"),
            (bal * 50).alias("market_cap"),
            (bal * 55).alias("enterprise_value"),
            (F.col("n") * 1000).alias("shares"),
            (bal * 4).alias("ebitda"),
            (bal * 3).alias("free_cash_flow"),
            (bal / F.col("n") / 1000).alias("trailing_eps"),
            (F.col("n") + 5).alias("trailing_pe"),
            (F.col("n") + 4).alias("forward_pe"),
            (F.col("n") / 7).alias("price_to_book"),
            (F.col("n") / 11).alias("price_to_sales"),
            (F.col("n") / 5).alias("ev_to_ebitda"),
            (F.col("n") / 40).alias("peg"),
            F.lit(0.02).alias("dividend_yield"),
            (bal / F.col("n") / 100).alias("price"),
        )
    )


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tall macro series of four cadences: series_id, date, value."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), "o_orderpriority", "o_orderstatus")
    total, n = F.sum("amount").cast("double"), F.count(F.lit(1))

    def series(name: str, when, value, keep=None) -> DataFrame:
        rows = orders.filter(keep) if keep is not None else orders
        return rows.groupBy(when.alias("date")).agg(value.alias("value")).select(F.lit(name).alias("series_id"), "date", "value")

    day, week = F.col("day"), F.trunc("day", "week")
    month, quarter = F.trunc("day", "month"), F.trunc("day", "quarter")
    mean = total / n / 1000
    high, urgent = F.col("o_orderpriority") == "2-HIGH", F.col("o_orderpriority") == "1-URGENT"
    parts = [
        series("treasury_10y", day, mean / 30),
        series("treasury_2y", day, mean / 40, F.col("o_orderstatus") == "O"),
        series("fed_funds", month, mean / 50),
        series("aaa", day, mean / 45, high),
        series("baa", day, mean / 35, urgent),
        series("unemployment", month, mean / 25, urgent),
        series("cpi", month, total / 1000),
        series("initial_claims", week, n.cast("double")),
        series("m2", month, total / 500),
        series("dollar_index", day, mean),
        series("vix", day, mean / 8, F.col("o_orderstatus") == "F"),
        series("gdp", quarter, total / 100),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated events of stocks: stock_id, event_id, day, kind, amount, props.  User n is stock n mod 25."""
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(25)).alias("stock_id"), "event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), "props"
    )
