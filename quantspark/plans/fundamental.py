"""Registered queries over statements and vendor figures, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fundamental as U
from ..sources import market as M
from .technical import BARS, r6

#: As-of dates that the registered queries use, beside the registry's own choice of dates.
AS_OF = ("1998-03-31", "2001-09-30")

QUERIES, SQL = {}, {}

# --- SQL building blocks -------------------------------------------------------------------


def _metric_sql(name: str, statuses: str, share: float) -> str:
    return f"SELECT stock_id, period_end, '{name}' AS metric, ({' + '.join(statuses.split(','))}) * {share!r}::DOUBLE AS value FROM by_status"


STATEMENTS = f"""dates AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in AS_OF)}]) AS as_of),
by_status AS (SELECT c_nationkey::BIGINT AS stock_id, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
  {', '.join(f"(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = '{s}'))::DOUBLE AS {s}" for s in 'FOP')}
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
tall AS ({' UNION ALL '.join(_metric_sql(n, s, x) for n, (s, x) in M.METRICS.items())}),
placed AS (SELECT tall.*, as_of, row_number() OVER (PARTITION BY stock_id, as_of, metric ORDER BY period_end DESC) - 1 AS pos
  FROM tall JOIN dates ON period_end <= as_of)"""
_CELLS = ", ".join(f"max(value) FILTER (WHERE metric = '{m}' AND pos = {k}) AS {m}_{k}" for m in M.METRICS for k in U.POSITIONS)
WIDE = f"{STATEMENTS}, wide AS (SELECT stock_id, as_of, {_CELLS} FROM placed WHERE pos < 5 GROUP BY ALL)"
INFO = """i0 AS (SELECT c_nationkey::BIGINT AS stock_id, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS bal, count(*)::DOUBLE AS n FROM customer GROUP BY ALL),
info AS (SELECT stock_id, bal / n / 10000 AS return_on_equity, bal / n / 25000 AS return_on_assets, NULL::DOUBLE AS tax_rate, bal * 2 AS total_debt,
  bal * 50 AS market_cap, bal * 55 AS enterprise_value, n * 1000 AS shares, bal * 4 AS ebitda, bal * 3 AS free_cash_flow, bal / n / 1000 AS trailing_eps,
  n + 5 AS trailing_pe, n + 4 AS forward_pe, n / 7 AS price_to_book, n / 11 AS price_to_sales, n / 5 AS ev_to_ebitda, n / 40 AS peg,
  0.02::DOUBLE AS dividend_yield, bal / n / 100 AS price FROM i0)"""
STOCKS = "stocks AS (SELECT n_nationkey::BIGINT AS stock_id, n_name AS ticker, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey)"
FULL = f"""WITH {WIDE}, {INFO}, {BARS}, {STOCKS},
px AS (SELECT stock_id, as_of, arg_max(close, date) AS last_close FROM bars JOIN dates ON date <= as_of GROUP BY ALL),
f AS (SELECT wide.*, info.* EXCLUDE (stock_id), last_close, sector FROM wide JOIN info USING (stock_id) LEFT JOIN px USING (stock_id, as_of) JOIN stocks USING (stock_id))"""


def q(a: str, b: str) -> str:
    """Division that is null at 0."""
    return f"({a}) / nullif({b}, 0)"


def ratio(a: str, b: str, k: int = 0) -> str:
    return q(f"{a}_{k}", f"{b}_{k}")


def grown(x: str, a: int, b: int) -> str:
    return q(f"{x}_{a} - {x}_{b}", f"abs({x}_{b})")


def ttm(x: str) -> str:
    return " + ".join(f"{x}_{k}" for k in range(4))


def bit(condition: str) -> str:
    return f"coalesce(({condition})::INT, 0)"


def nz(x: str) -> str:
    return f"nullif({x}, 0)"


def dz(x: str) -> str:
    return f"coalesce({x}, 0)"


def select(pairs: dict[str, str], source: str = "f", whole: tuple[str, ...] = ()) -> str:
    columns = ", ".join(f"({s})::{'INT' if n in whole else 'DOUBLE'} AS {n}" if n in whole else f"{r6(f'({s})::DOUBLE')} AS {n}" for n, s in pairs.items())
    return f"{FULL} SELECT stock_id, as_of, {columns} FROM {source}"


# --- Spark side ----------------------------------------------------------------------------


def _dates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in AS_OF], "as_of string").select(F.to_date("as_of").alias("as_of"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.fundamental_features(M.statements(spark, sf_dir), M.company_info(spark, sf_dir), M.bars(spark, sf_dir), M.stocks(spark, sf_dir), _dates(spark), M.METRICS)


def _register(name: str, pairs: dict[str, str], whole: tuple[str, ...] = ()) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(spark, sf_dir).select("stock_id", "as_of", *[F.col(n) if n in whole else F.round(n, 6).alias(n) for n in pairs])

    QUERIES[name], SQL[name] = query, select(pairs, whole=whole)


def statements_pivot(spark, sf_dir):
    wide = U.statement_matrix(M.statements(spark, sf_dir), _dates(spark), ["revenue", "net_income"])
    return wide.select("stock_id", "as_of", *[F.round(f"{m}_{k}", 4).alias(f"{m}_{k}") for m in ("revenue", "net_income") for k in U.POSITIONS])


QUERIES["statements_pivot"] = statements_pivot
SQL["statements_pivot"] = f"WITH {WIDE} SELECT stock_id, as_of, {', '.join(f'round({m}_{k}, 4) AS {m}_{k}' for m in ('revenue', 'net_income') for k in U.POSITIONS)} FROM wide"

_register(
    "margins",
    {
        "roe": "return_on_equity",
        "roa": "return_on_assets",
        "roic": q("operating_income_0 * (1 - 0.21::DOUBLE)", f"{nz('total_assets_0')} - current_liabilities_0 - cash_0"),
        "gross_margin": ratio("gross_profit", "revenue"),
        "operating_margin": ratio("operating_income", "revenue"),
        "net_margin": ratio("net_income", "revenue"),
        "gross_margin_trend": f"{ratio('gross_profit', 'revenue')} - {ratio('gross_profit', 'revenue', 1)}",
        "operating_margin_trend": f"{ratio('operating_income', 'revenue')} - {ratio('operating_income', 'revenue', 1)}",
    },
)
_register(
    "growth",
    {
        "revenue_growth_yoy": grown("revenue", 0, 4),
        "revenue_growth_qoq": grown("revenue", 0, 1),
        "revenue_acceleration": f"{grown('revenue', 0, 1)} - {grown('revenue', 1, 2)}",
        "earnings_growth_yoy": grown("net_income", 0, 4),
        "book_value_growth": grown("equity", 0, 4),
        "fcf_growth": grown("free_cash_flow", 0, 4),
        "net_income_growth": q(f"{nz('net_income_0')} - {nz('net_income_4')}", "abs(net_income_4)"),
        "operating_cf_growth": q(f"{nz('operating_cash_flow_0')} - {nz('operating_cash_flow_4')}", "abs(operating_cash_flow_4)"),
    },
)
SIGNALS = {
    "p_positive_net_income": "net_income_0 > 0",
    "p_positive_operating_cf": "operating_cash_flow_0 > 0",
    "p_roa_increasing": f"{ratio('net_income', 'total_assets')} > {ratio('net_income', 'total_assets', 1)}",
    "p_cf_greater_than_ni": "operating_cash_flow_0 > net_income_0",
    "p_debt_ratio_decreasing": f"{ratio('long_term_debt', 'total_assets')} < {ratio('long_term_debt', 'total_assets', 1)}",
    "p_current_ratio_increasing": f"{ratio('current_assets', 'current_liabilities')} > {ratio('current_assets', 'current_liabilities', 1)}",
    "p_no_new_shares": "shares_issued_0 <= shares_issued_1",
    "p_gross_margin_increasing": f"{ratio('gross_profit', 'revenue')} > {ratio('gross_profit', 'revenue', 1)}",
    "p_asset_turnover_increasing": f"{ratio('revenue', 'total_assets')} > {ratio('revenue', 'total_assets', 1)}",
}
_bits = {n: bit(s) for n, s in SIGNALS.items()}
_register("piotroski", _bits | {"piotroski_f_score": " + ".join(_bits.values())}, whole=(*_bits, "piotroski_f_score"))
_register(
    "quality",
    {
        "debt_to_equity": q(dz("total_debt"), "equity_0"),
        "current_ratio": ratio("current_assets", "current_liabilities"),
        "interest_coverage": q("ebit_0", "abs(interest_expense_0)"),
        "accruals_ratio": q("net_income_0 - operating_cash_flow_0", "total_assets_0"),
        "cash_vs_earnings_quality": ratio("operating_cash_flow", "net_income"),
    },
)
_assets = nz("total_assets_0")
_register(
    "altman",
    {
        "altman_z_score": f"round(1.2::DOUBLE * ({dz('current_assets_0')} - {dz('current_liabilities_0')}) / {_assets} + 1.4::DOUBLE * {dz('retained_earnings_0')} / {_assets}"
        f" + 3.3::DOUBLE * {dz('ebit_0')} / {_assets} + 0.6::DOUBLE * {dz(q(dz('market_cap'), 'total_debt'))} + {dz('revenue_0')} / {_assets}, 4)"
    },
)
_rec = q("revenue_0", "(receivables_0 + receivables_1) / 2")
_register(
    "turnover_ratios",
    {
        "asset_turnover": ratio("revenue", "total_assets"),
        "inventory_turnover": q("cost_0", "(inventory_0 + inventory_1) / 2"),
        "receivables_turnover": _rec,
        "days_sales_outstanding": q("365.0::DOUBLE", _rec),
    },
)
_fcf = f"coalesce({nz('free_cash_flow')}, free_cash_flow_0)"
_tang = f"({dz('equity_0')} - {dz('goodwill_0')} - {dz('intangibles_0')})"
_debt = f"({nz('total_debt')} - {dz('cash_0')})"
_register(
    "extended_ratios",
    {
        "forward_pe": "forward_pe",
        "ev_ebitda": "ev_to_ebitda",
        "peg_ratio": "peg",
        "ev_revenue": q("enterprise_value", "revenue_0"),
        "dividend_yield": "dividend_yield",
        "quick_ratio": q("coalesce(current_assets_0 - inventory_0, current_assets_0)", "current_liabilities_0"),
        "cash_ratio": ratio("cash", "current_liabilities"),
        "net_debt": _debt,
        "net_debt_ebitda": q(_debt, "ebitda"),
        "fcf_to_debt": q(_fcf, "total_debt"),
        "interest_coverage_ttm": q(f"{nz('ebit_0')} * 4", "abs(interest_expense_0) * 4"),
        "ebitda_margin": q(nz("ebitda"), "revenue_0 * 4"),
        "fcf_margin": q(nz(_fcf), "revenue_0 * 4"),
        "capex_ratio": q(f"abs({nz('capital_expenditure_0')})", "revenue_0"),
        "rd_intensity": q(f"abs({nz('research_0')})", "revenue_0"),
        "return_on_tangible_equity": q("net_income_0", _tang),
        "shares_outstanding": "shares",
        "eps_ttm": "trailing_eps",
        "buyback_yield": q(f"abs({nz('repurchase_0')})", "market_cap"),
    },
)
_register("ttm", {"revenue_ttm": ttm("revenue"), "gross_profit_ttm": ttm("gross_profit")})
_eps, _book = q(ttm("net_income"), "shares"), q("equity_0", "shares")
_fcf4 = f"coalesce({nz(ttm('free_cash_flow'))}, free_cash_flow)"
_pe = f"CASE WHEN last_close IS NULL THEN trailing_pe WHEN {_eps} > 0 THEN {q('last_close', _eps)} END"
_register(
    "overrides",
    {
        "pe_ratio": _pe,
        "pb_ratio": f"CASE WHEN last_close IS NULL THEN price_to_book WHEN {_book} > 0 THEN {q('last_close', _book)} END",
        "ps_ratio": f"CASE WHEN last_close IS NULL THEN price_to_sales ELSE {q('last_close * shares', ttm('revenue'))} END",
        "earnings_yield": f"CASE WHEN last_close IS NULL THEN {q('trailing_eps', 'price')} ELSE {q(_eps, 'last_close')} END",
        "fcf_yield": f"CASE WHEN last_close IS NULL THEN {q(q(_fcf, 'shares'), 'price')} ELSE {q(q(_fcf4, 'shares'), 'last_close')} END",
        "price_to_fcf": f"CASE WHEN last_close IS NULL THEN {q('market_cap', _fcf)} ELSE {q('last_close * shares', _fcf4)} END",
        "price_to_tangible_book": f"CASE WHEN last_close IS NULL THEN {q('price', q(_tang, 'shares'))} ELSE {q('last_close', q(_tang, 'shares'))} END",
    },
)

_SECTOR = f"""{FULL}, s AS (SELECT *, return_on_equity AS roe, return_on_assets AS roa, {ratio('net_income', 'revenue')} AS nm, {grown('revenue', 0, 4)} AS rg, {_pe} AS pe FROM f),
m AS (SELECT sector, as_of, {', '.join(f'CASE WHEN count({c}) >= 3 THEN quantile_cont({c}, 0.5) END AS m_{c}' for c in ('roe', 'roa', 'nm', 'rg'))},
  CASE WHEN count(*) FILTER (WHERE pe > 0) >= 3 THEN avg(pe) FILTER (WHERE pe > 0) END AS m_pe FROM s GROUP BY ALL)
SELECT stock_id, as_of, """


def _sector_query(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(spark, sf_dir).select("stock_id", "as_of", *[F.round(n, 6).alias(n) for n in names])

    return query


_rel = {"roe_vs_sector": ("roe", "m_roe"), "roa_vs_sector": ("roa", "m_roa"), "net_margin_vs_sector": ("nm", "m_nm"), "revenue_growth_vs_sector": ("rg", "m_rg")}
QUERIES["sector_median"] = _sector_query(*_rel)
SQL["sector_median"] = _SECTOR + ", ".join(f"{r6(q(a, b))} AS {n}" for n, (a, b) in _rel.items()) + " FROM s JOIN m USING (sector, as_of)"
QUERIES["sector_pe"] = _sector_query("pe_vs_sector_avg")
SQL["sector_pe"] = _SECTOR + f"{r6(q('pe', 'm_pe'))} AS pe_vs_sector_avg FROM s JOIN m USING (sector, as_of)"
