"""The 69 fundamental features, from tall statements and vendor figures, as of any dates.

Statements (stock_id, metric, period_end, value) become one row per stock and as-of date whose
columns are ``metric_k``: the k-th newest quarter known at that date.  Peers are compared with
their newest row at the same date, the stock itself included, so no later data is seen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.safe import div, flag, growth, nonzero, number, or_else, safe_div
from ..functions.windows import asof_join

#: Positions of a metric that some formula reads: newest, the one before, two before, and a year ago.
POSITIONS = range(5)
MIN_PEERS = 3
US_TAX_RATE = 0.21

FEATURES = (
    "roe roa roic gross_margin operating_margin net_margin gross_margin_trend operating_margin_trend "
    "pe_ratio forward_pe pb_ratio ps_ratio ev_ebitda peg_ratio pe_vs_sector_avg "
    "revenue_growth_yoy revenue_growth_qoq revenue_acceleration earnings_growth_yoy book_value_growth fcf_growth "
    "debt_to_equity current_ratio interest_coverage accruals_ratio cash_vs_earnings_quality "
    "p_positive_net_income p_positive_operating_cf p_roa_increasing p_cf_greater_than_ni p_debt_ratio_decreasing "
    "p_current_ratio_increasing p_no_new_shares p_gross_margin_increasing p_asset_turnover_increasing piotroski_f_score altman_z_score "
    "asset_turnover inventory_turnover receivables_turnover days_sales_outstanding "
    "ev_revenue price_to_fcf earnings_yield fcf_yield dividend_yield price_to_tangible_book quick_ratio cash_ratio "
    "net_debt net_debt_ebitda fcf_to_debt interest_coverage_ttm ebitda_margin fcf_margin capex_ratio rd_intensity "
    "return_on_tangible_equity revenue_ttm gross_profit_ttm eps_ttm shares_outstanding "
    "roe_vs_sector roa_vs_sector net_margin_vs_sector revenue_growth_vs_sector "
    "net_income_growth operating_cf_growth buyback_yield"
).split()


def as_of_spine(rows: DataFrame, dates: DataFrame, *keys: str) -> DataFrame:
    """(keys, as_of): each key of ``rows`` at each of ``dates``, in proportion to the result."""
    every = dates.agg(F.collect_set("as_of")).scalar()
    return rows.select(*keys).distinct().withColumn("as_of", F.explode(every))


def statement_matrix(statements: DataFrame, dates: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """One row per stock and ``as_of`` of ``dates``: columns ``metric_0`` (newest) to ``metric_4``.

    Each statement row takes the four before it of its metric and is read at each date by an as-of
    join.  Stocks without a statement by that date have no row.
    """
    earlier = W.partitionBy("stock_id", "metric").orderBy("period_end")
    cells = F.struct(*[(F.lag("value", k).over(earlier) if k else F.col("value")).alias(f"_{k}") for k in POSITIONS])
    rows = statements.select("stock_id", "metric", F.col("period_end").alias("as_of"), cells.alias("cells"))
    found = asof_join(as_of_spine(statements, dates, "stock_id", "metric"), rows, ["stock_id", "metric"], date="as_of").filter("cells is not null")
    laid = [F.max(F.when(F.col("metric") == m, F.col(f"cells._{k}"))).alias(f"{m}_{k}") for m in metrics for k in POSITIONS]
    return found.groupBy("stock_id", "as_of").agg(*laid)


def _c(name: str, k: int = 0) -> Column:
    return F.col(f"{name}_{k}")


def _ratio(a: str, b: str, k: int = 0) -> Column:
    return safe_div(_c(a, k), _c(b, k))


def ttm(name: str) -> Column:
    """Sum of the last four quarters, null unless all four are known."""
    return sum((_c(name, k) for k in range(1, 4)), _c(name, 0))


def margins() -> dict[str, Column]:
    tax = or_else("tax_rate", US_TAX_RATE)
    capital = nonzero(_c("total_assets")) - _c("current_liabilities") - _c("cash")
    return {
        "roe": number("return_on_equity"),
        "roa": number("return_on_assets"),
        "roic": safe_div(_c("operating_income") * (1 - tax), capital),
        "gross_margin": _ratio("gross_profit", "revenue"),
        "operating_margin": _ratio("operating_income", "revenue"),
        "net_margin": _ratio("net_income", "revenue"),
        "gross_margin_trend": _ratio("gross_profit", "revenue") - _ratio("gross_profit", "revenue", 1),
        "operating_margin_trend": _ratio("operating_income", "revenue") - _ratio("operating_income", "revenue", 1),
    }


def growths() -> dict[str, Column]:
    def yoy(x: str) -> Column:
        return growth(_c(x), _c(x, 4))

    return {
        "revenue_growth_yoy": yoy("revenue"),
        "revenue_growth_qoq": growth(_c("revenue"), _c("revenue", 1)),
        "revenue_acceleration": growth(_c("revenue"), _c("revenue", 1)) - growth(_c("revenue", 1), _c("revenue", 2)),
        "earnings_growth_yoy": yoy("net_income"),
        "book_value_growth": yoy("equity"),
        "fcf_growth": yoy("free_cash_flow"),
        "net_income_growth": growth(nonzero(_c("net_income")), nonzero(_c("net_income", 4))),
        "operating_cf_growth": growth(nonzero(_c("operating_cash_flow")), nonzero(_c("operating_cash_flow", 4))),
    }


def piotroski() -> dict[str, Column]:
    """Nine yes-or-no signals; the comparisons are with the previous quarter."""
    signals = {
        "p_positive_net_income": flag(_c("net_income") > 0),
        "p_positive_operating_cf": flag(_c("operating_cash_flow") > 0),
        "p_roa_increasing": flag(_ratio("net_income", "total_assets") > _ratio("net_income", "total_assets", 1)),
        "p_cf_greater_than_ni": flag(_c("operating_cash_flow") > _c("net_income")),
        "p_debt_ratio_decreasing": flag(_ratio("long_term_debt", "total_assets") < _ratio("long_term_debt", "total_assets", 1)),
        "p_current_ratio_increasing": flag(_ratio("current_assets", "current_liabilities") > _ratio("current_assets", "current_liabilities", 1)),
        "p_no_new_shares": flag(_c("shares_issued") <= _c("shares_issued", 1)),
        "p_gross_margin_increasing": flag(_ratio("gross_profit", "revenue") > _ratio("gross_profit", "revenue", 1)),
        "p_asset_turnover_increasing": flag(_ratio("revenue", "total_assets") > _ratio("revenue", "total_assets", 1)),
    }
    return signals | {"piotroski_f_score": sum(signals.values(), F.lit(0))}


def altman() -> Column:
    """Altman Z with total debt as the liabilities; missing parts count as 0."""
    assets = nonzero(_c("total_assets"))
    part = lambda c: or_else(c, 0.0)
    working = part(_c("current_assets")) - part(_c("current_liabilities"))
    solvency = F.coalesce(safe_div(or_else("market_cap", 0.0), or_else("total_debt", 0.0)), F.lit(0.0))
    z = 1.2 * working / assets + 1.4 * part(_c("retained_earnings")) / assets + 3.3 * part(_c("ebit")) / assets + 0.6 * solvency + part(_c("revenue")) / assets
    return F.round(z, 4)


def quality() -> dict[str, Column]:
    return {
        "debt_to_equity": safe_div(or_else("total_debt", 0.0), _c("equity")),
        "current_ratio": _ratio("current_assets", "current_liabilities"),
        "interest_coverage": safe_div(_c("ebit"), F.abs(nonzero(_c("interest_expense")))),
        "accruals_ratio": safe_div(_c("net_income") - _c("operating_cash_flow"), _c("total_assets")),
        "cash_vs_earnings_quality": _ratio("operating_cash_flow", "net_income"),
        "altman_z_score": altman(),
    } | piotroski()


def turnovers() -> dict[str, Column]:
    mean = lambda x: (_c(x) + _c(x, 1)) / 2
    receivables = safe_div(_c("revenue"), mean("receivables"))
    return {
        "asset_turnover": _ratio("revenue", "total_assets"),
        "inventory_turnover": safe_div(_c("cost"), mean("inventory")),
        "receivables_turnover": receivables,
        "days_sales_outstanding": safe_div(F.lit(365.0), receivables),
    }


def _tangible() -> Column:
    return or_else(_c("equity"), 0.0) - or_else(_c("goodwill"), 0.0) - or_else(_c("intangibles"), 0.0)


def extended() -> dict[str, Column]:
    fcf = F.coalesce(nonzero("free_cash_flow"), number(_c("free_cash_flow")))
    price, shares, debt, revenue = nonzero("price"), nonzero("shares"), nonzero("total_debt"), nonzero(_c("revenue"))
    quick = F.coalesce(_c("current_assets") - _c("inventory"), _c("current_assets"))
    cap = number("market_cap")
    net_debt = debt - or_else(_c("cash"), 0.0)
    return {
        "forward_pe": number("forward_pe"),
        "ev_ebitda": number("ev_to_ebitda"),
        "peg_ratio": number("peg"),
        "pe_ratio": number("trailing_pe"),
        "pb_ratio": number("price_to_book"),
        "ps_ratio": number("price_to_sales"),
        "ev_revenue": safe_div("enterprise_value", _c("revenue")),
        "price_to_fcf": safe_div(cap, fcf),
        "earnings_yield": safe_div("trailing_eps", price),
        "fcf_yield": safe_div(safe_div(fcf, shares), price),
        "dividend_yield": number("dividend_yield"),
        "price_to_tangible_book": safe_div("price", safe_div(_tangible(), shares)),
        "quick_ratio": safe_div(quick, _c("current_liabilities")),
        "cash_ratio": _ratio("cash", "current_liabilities"),
        "net_debt": net_debt,
        "net_debt_ebitda": safe_div(net_debt, nonzero("ebitda")),
        "fcf_to_debt": safe_div(fcf, debt),
        "interest_coverage_ttm": safe_div(nonzero(_c("ebit")) * 4, F.abs(nonzero(_c("interest_expense"))) * 4),
        "ebitda_margin": safe_div(nonzero("ebitda"), revenue * 4),
        "fcf_margin": safe_div(nonzero(fcf), revenue * 4),
        "capex_ratio": safe_div(F.abs(nonzero(_c("capital_expenditure"))), _c("revenue")),
        "rd_intensity": safe_div(F.abs(nonzero(_c("research"))), _c("revenue")),
        "return_on_tangible_equity": safe_div(_c("net_income"), nonzero(_tangible())),
        "revenue_ttm": ttm("revenue"),
        "gross_profit_ttm": ttm("gross_profit"),
        "eps_ttm": number("trailing_eps"),
        "shares_outstanding": number("shares"),
        "buyback_yield": safe_div(F.abs(nonzero(_c("repurchase"))), nonzero("market_cap")),
    }


def last_price(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """stock_id, as_of, last_close: the last close not later than each as-of date."""
    closes = bars.select("stock_id", F.col("date").alias("as_of"), F.col("close").alias("last_close"))
    return asof_join(as_of_spine(bars, dates, "stock_id"), closes, ["stock_id"], date="as_of").filter(F.col("last_close").isNotNull())


def at_market_price() -> dict[str, Column]:
    """Ratios recomputed from the last close, where there is one, instead of the vendor's current price."""
    price, shares = F.col("last_close"), nonzero("shares")
    eps, sales = safe_div(ttm("net_income"), "shares"), ttm("revenue")
    book = safe_div(_c("equity"), shares)
    fcf = F.coalesce(nonzero(ttm("free_cash_flow")), number("free_cash_flow"))
    cap = price * shares
    ratios = {
        "pe_ratio": safe_div(price, F.when(eps > 0, eps)),
        "pb_ratio": safe_div(price, F.when(book > 0, book)),
        "ps_ratio": safe_div(cap, nonzero(sales)),
        "earnings_yield": safe_div(eps, price),
        "fcf_yield": safe_div(safe_div(fcf, shares), price),
        "price_to_fcf": safe_div(cap, nonzero(fcf)),
        "price_to_tangible_book": safe_div(price, safe_div(_tangible(), shares)),
    }
    return {name: F.when(price.isNotNull(), x).otherwise(F.col(name)) for name, x in ratios.items()}


def against_sector(df: DataFrame) -> DataFrame:
    """Ratios to the sector's median (returns, margins, growth) and mean positive PE, from three peers on."""
    medians = {"roe": "roe_vs_sector", "roa": "roa_vs_sector", "net_margin": "net_margin_vs_sector", "revenue_growth_yoy": "revenue_growth_vs_sector"}
    positive = F.when(F.col("pe_ratio") > 0, F.col("pe_ratio"))
    stats = [F.when(F.count(c) >= MIN_PEERS, F.percentile(c, 0.5)).alias(f"__m_{c}") for c in medians]
    stats.append(F.when(F.count(positive) >= MIN_PEERS, F.avg(positive)).alias("__mean_pe"))
    sector = df.groupBy("sector", "as_of").agg(*stats)
    out = df.join(sector, ["sector", "as_of"], "left")  # stocks without a sector stay
    return out.withColumns({name: safe_div(c, f"__m_{c}") for c, name in medians.items()} | {"pe_vs_sector_avg": safe_div("pe_ratio", "__mean_pe")})


def fundamental_features(statements: DataFrame, info: DataFrame, bars: DataFrame, stocks: DataFrame, dates: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """stock_id, as_of and the 69 features at each date of ``dates`` (as_of)."""
    wide = statement_matrix(statements, dates, metrics).join(info, "stock_id")
    wide = wide.join(last_price(bars, dates), ["stock_id", "as_of"], "left").join(F.broadcast(stocks.select("stock_id", "sector")), "stock_id")
    # vendor columns and statement columns are read before any feature takes the same name
    inputs = [c for c in wide.columns if c not in FEATURES]
    computed = margins() | growths() | quality() | turnovers() | extended()
    first = wide.select(*inputs, *[c.alias(name) for name, c in computed.items()])
    market = at_market_price()
    priced = first.select(*[c for c in first.columns if c not in market], *[c.alias(name) for name, c in market.items()])
    return against_sector(priced).select("stock_id", "as_of", *FEATURES)
