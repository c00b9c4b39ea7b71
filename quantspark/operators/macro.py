"""The 36 macro features of every date, from tall series of mixed cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.safe import div, nonzero
from ..functions.windows import asof_join, by, change, rolling, trailing

SECTORS = ("xlk", "xlf", "xlv", "xle", "xli", "xlp", "xly")


def asof_values(spine: DataFrame, series: DataFrame, days_ago: int = 0) -> DataFrame:
    """series_id, date, value: the latest value not later than ``days_ago`` days before each date.

    ``spine`` (date) is crossed with the few series ids, so each id is one partition of the stack.
    """
    wanted = spine.select(F.date_sub("date", days_ago).alias("date")).crossJoin(F.broadcast(series.select("series_id").distinct()))
    found = asof_join(wanted, series.select("series_id", "date", "value"), ["series_id"], values=["value"])
    return found.withColumn("date", F.date_add("date", days_ago))


def wide_asof(spine: DataFrame, series: DataFrame, names: list[str], days_ago: int = 0, suffix: str = "") -> DataFrame:
    values = asof_values(spine, series.filter(F.col("series_id").isin(names)), days_ago)
    return values.groupBy("date").agg(*[F.max(F.when(F.col("series_id") == n, F.col("value"))).alias(n + suffix) for n in names])


def credit_spread(series: DataFrame) -> DataFrame:
    """BAA less AAA on dates that either has; null where one is missing."""
    side = lambda n: series.filter(F.col("series_id") == n).select("date", F.col("value").alias(n))
    both = side("baa").join(side("aaa"), "date", "full")
    return both.select(F.lit("credit_spread").alias("series_id"), "date", (F.col("baa") - F.col("aaa")).alias("value"))


def over_own_rows(series: DataFrame) -> DataFrame:
    """Derived series at native cadence: year-on-year (11 steps, 13 rows), quarter growth, four-observation mean."""
    ws = by("series_id")
    count = F.count(F.lit(1)).over(ws.rowsBetween(W.unboundedPreceding, 0))
    before = F.lag("value", 11).over(ws)
    yoy = F.when(count >= 13, div(F.col("value") - before, F.abs(before)))
    last = F.lag("value", 1).over(ws)
    mean4 = F.coalesce(rolling(F.avg, "value", ws, 4), F.col("value"))
    rows = series.filter(F.col("series_id").isin("cpi", "m2", "gdp", "initial_claims")).withColumns(
        {"yoy": yoy, "annual": div(F.col("value") - last, F.abs(last)) * 4, "mean4": mean4}
    )
    name = F.when(F.col("series_id") == "cpi", "cpi_yoy").when(F.col("series_id") == "m2", "m2_growth").when(F.col("series_id") == "gdp", "gdp_growth").otherwise("initial_claims_4wk_avg")
    value = F.when(F.col("series_id").isin("cpi", "m2"), F.col("yoy")).when(F.col("series_id") == "gdp", F.col("annual")).otherwise(F.col("mean4"))
    return rows.select(name.alias("series_id"), "date", value.alias("value"))


def percentile_over_year(series: DataFrame, days: int = 365) -> DataFrame:
    """date, value, percentile: share of the last ``days`` days' values strictly below the current one."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    frame = W.partitionBy("series_id").orderBy("day").rangeBetween(-days, 0)
    seen = F.collect_list("value").over(frame)
    below = F.size(F.filter("seen", lambda x: x < F.col("value")))
    return series.withColumn("day", day).withColumn("seen", seen).select("series_id", "date", "value", (below / F.size("seen")).alias("percentile"))


def breadth(bars: DataFrame) -> DataFrame:
    """date, market_breadth: share of stocks with 200 rows whose close is above their 200-row mean."""
    sma = rolling(F.avg, "close", by("stock_id"), 200)
    rows = bars.select("date", "close", sma.alias("sma")).filter("sma is not null")
    return rows.groupBy("date").agg(F.round(F.avg((F.col("close") > F.col("sma")).cast("int")), 4).alias("market_breadth"))


def fund_momentum(funds: DataFrame, key: str, rows: int = 30) -> DataFrame:
    """key, date, momentum: return over ``rows - 1`` rows, six decimals."""
    return funds.select(key, "date", F.round(change("close", by(key), rows - 1), 6).alias("momentum"))


def relative_flow(funds: DataFrame, benchmark: DataFrame, key: str, rows: int = 30) -> DataFrame:
    """key, date, momentum, relative_flow: a fund's momentum less the benchmark's on the same date."""
    market = benchmark.select("date", F.round(change("close", by([]), rows - 1), 6).alias("market"))  # one row per date
    return fund_momentum(funds, key, rows).join(market, "date").select(key, "date", "momentum", F.round(F.col("momentum") - F.col("market"), 6).alias("relative_flow"))


def macro_features(spine: DataFrame, series: DataFrame, bars: DataFrame, funds: DataFrame, benchmark: DataFrame, style: DataFrame | None = None) -> DataFrame:
    """One row per date of ``spine`` with the 36 features.

    ``funds`` (fund, date, close) holds the sector funds by the names in SECTORS; ``style`` (date,
    growth, value) the two style funds, null features without it.
    """
    derived = series.unionByName(credit_spread(series)).unionByName(over_own_rows(series)).unionByName(
        percentile_over_year(series.filter("series_id = 'vix'")).select(F.lit("vix_percentile_1y").alias("series_id"), "date", F.col("percentile").alias("value"))
    )
    now = ["treasury_10y", "treasury_2y", "fed_funds", "unemployment", "initial_claims", "dollar_index", "vix", "credit_spread", "cpi"]
    more = ["cpi_yoy", "m2_growth", "gdp_growth", "initial_claims_4wk_avg", "vix_percentile_1y"]
    wide = wide_asof(spine, derived, now + more)
    for days, names in ((90, ["fed_funds", "unemployment", "cpi"]), (30, ["credit_spread", "dollar_index"]), (5, ["vix"])):
        wide = wide.join(wide_asof(spine, derived, names, days, f"_{days}"), "date", "left")

    def delta(name: str, days: int) -> Column:
        return F.col(name) - F.col(f"{name}_{days}")

    flow = relative_flow(funds, benchmark, "fund")
    sectors = flow.groupBy("date").agg(
        *[F.max(F.when(F.col("fund") == s, F.col("momentum"))).alias(f"sector_momentum_{s}") for s in SECTORS],
        *[F.max(F.when(F.col("fund") == s, F.col("relative_flow"))).alias(f"sector_relative_flow_{s}") for s in SECTORS],
    )
    out = wide.join(sectors, "date", "left").join(breadth(bars), "date", "left")
    if style is not None:
        tilt = F.round(change("growth", by([]), 29) - change("value", by([]), 29), 6)
        out = out.join(style.select("date", tilt.alias("growth_vs_value")), "date", "left")
    else:
        out = out.withColumn("growth_vs_value", F.lit(None).cast("double"))
    return out.select(
        "date",
        "treasury_10y",
        "treasury_2y",
        (nonzero("treasury_10y") - nonzero("treasury_2y")).alias("yield_curve_slope"),
        "credit_spread",
        delta("credit_spread", 30).alias("credit_spread_change"),
        F.col("fed_funds").alias("fed_funds_rate"),
        delta("fed_funds", 90).alias("fed_rate_change_3m"),
        F.col("unemployment").alias("unemployment_rate"),
        delta("unemployment", 90).alias("unemployment_change"),
        "cpi_yoy",
        delta("cpi", 90).alias("cpi_change_3m"),
        "initial_claims",
        "initial_claims_4wk_avg",
        "m2_growth",
        "dollar_index",
        delta("dollar_index", 30).alias("dollar_change_30d"),
        F.col("vix").alias("vix_level"),
        delta("vix", 5).alias("vix_change_5d"),
        "vix_percentile_1y",
        "market_breadth",
        "gdp_growth",
        "growth_vs_value",
        *[f"sector_momentum_{s}" for s in SECTORS],
        *[f"sector_relative_flow_{s}" for s in SECTORS],
    )
