"""Registered queries over bars and technical features, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental as N
from ..operators import technical as T
from ..sources import market as M
from ..sources.scratch import written

# --- SQL building blocks -------------------------------------------------------------------

OHLCV = """max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity) AS close, sum(l_quantity) AS volume"""
TRADES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
BARS = f"""bars AS (SELECT n_nationkey::BIGINT AS stock_id, n_regionkey AS sector_id, l_shipdate::DATE AS date, {OHLCV}
  FROM {TRADES} GROUP BY ALL)"""
BENCH = f"bench AS (SELECT l_shipdate::DATE AS date, {OHLCV} FROM lineitem GROUP BY ALL)"
FUNDS = f"funds AS (SELECT n_regionkey AS sector_id, l_shipdate::DATE AS date, {OHLCV} FROM {TRADES} GROUP BY ALL)"
BASE = f"""WITH {BARS},
b0 AS (SELECT *, (high + low + close) / 3 AS tp, row_number() OVER w AS rn, lag(close) OVER w AS prior
  FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
b AS (SELECT *, close - prior AS step, tp - lag(tp) OVER w AS tp_step, ln(close / nullif(prior, 0)) AS log_return
  FROM b0 WINDOW w AS (PARTITION BY stock_id ORDER BY date))"""
KEEP = "rn >= 20"


def over(n: int | None = None) -> str:
    frame = "ROWS UNBOUNDED PRECEDING" if n is None else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY stock_id ORDER BY date {frame})"


def full(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {fn}({x}) {over(n)} END"


def lagged(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY stock_id ORDER BY date)"


def changed(x: str, n: int) -> str:
    return f"{x} / nullif({lagged(x, n)}, 0) - 1"


def trended(x: str, n: int) -> str:
    mean = f"avg({x}) {over(n)}"
    return f"CASE WHEN count({x}) {over(n)} = {n} AND {mean} <> 0 THEN regr_slope({x}, rn) {over(n)} / {mean} END"


def averaged(x: str, a: str) -> str:
    """Exponential mean by folding the list of all values so far."""
    return f"list_reduce(list({x}) {over()}, lambda acc, x: (1 - {a}) * acc + {a} * x)"


def gapped(a: str, b: str) -> str:
    return f"(nullif({a}, 0) - nullif({b}, 0)) / nullif({b}, 0)"


def r6(sql: str) -> str:
    """Six decimals, without a negative zero."""
    return f"CASE WHEN abs({sql}) < 5e-7 THEN 0.0::DOUBLE ELSE round({sql}, 6) END"


def rounded(pairs: dict[str, str]) -> str:
    return ", ".join(f"{r6(sql)} AS {name}" for name, sql in pairs.items())


def final(source: str, pairs: dict[str, str], keep: str = KEEP) -> str:
    return f"SELECT stock_id, date, {rounded(pairs)} FROM {source} WHERE {keep}"


# --- Spark side ----------------------------------------------------------------------------


def price_query(build, *names: str):
    """A query of the named features that ``build`` adds to the base columns."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(T._base(M.bars(spark, sf_dir)))
        return df.filter(F.col("rn") >= T.LEAST_ROWS).select("stock_id", "date", *[F.round(n, 6).alias(n) for n in names])

    return query


QUERIES, SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def bars_daily(spark, sf_dir):
    return M.bars(spark, sf_dir).select("stock_id", "date", "high", "low", "close", "volume")


register("bars_daily", bars_daily, f"WITH {BARS} SELECT stock_id, date, high, low, close, volume FROM bars")

sma = {f"sma_{n}": full("avg", "close", n) for n in (10, 20, 50, 100, 200)}
register("sma_all", price_query(T.moving_averages, *sma), f"{BASE} {final('b', sma)}".replace(f"WHERE {KEEP}", f"QUALIFY {KEEP}"))

SMAS = f"{BASE}, s AS (SELECT *, {', '.join(f'{q} AS {n}' for n, q in sma.items())} FROM b)"
gaps = {"price_vs_sma10": gapped("close", "sma_10"), "price_vs_sma20": gapped("close", "sma_20"), "price_vs_sma50": gapped("close", "sma_50")}
gaps |= {"price_vs_sma200": gapped("close", "sma_200"), "sma50_vs_sma200": gapped("sma_50", "sma_200")}
register("price_gaps", price_query(T.moving_averages, *gaps), f"{SMAS} {final('s', gaps)}")
slopes = {"sma50_slope": trended("sma_50", 10), "sma200_slope": trended("sma_200", 10), "volume_trend_20d": trended("volume", 20)}
register(
    "slopes",
    price_query(lambda df: T.volume(T.moving_averages(df)), *slopes),
    f"{SMAS}, t AS (SELECT stock_id, date, rn, {', '.join(f'{q} AS {n}' for n, q in slopes.items())} FROM s) {final('t', {n: n for n in slopes})}",
)

EMAS = f"{BASE}, e AS (SELECT *, {', '.join(f'{averaged('close', f'(2.0/{n + 1})')} AS ema_{n}' for n in (10, 20, 50))}, {full('avg', 'close', 200)} AS sma_200 FROM b)".replace("2.0/", "2.0::DOUBLE/")
ema = {"ema_10": "ema_10", "ema_20": "ema_20", "ema_50": "ema_50", "price_vs_ema10": gapped("close", "ema_10"), "price_vs_ema20": gapped("close", "ema_20")}
ema |= {"price_vs_ema50": gapped("close", "ema_50"), "ema50_vs_sma200": gapped("ema_50", "sma_200")}
register("ema_all", price_query(T.moving_averages, *ema), f"{EMAS} {final('e', ema)}")

MACD = f"""{BASE}, m0 AS (SELECT *, {averaged('close', '(2.0::DOUBLE/13)')} - {averaged('close', '(2.0::DOUBLE/27)')} AS macd FROM b),
m AS (SELECT *, {averaged('macd', '(0.2::DOUBLE)')} AS macd_signal FROM m0)"""
macd = {"macd": "macd", "macd_signal": "macd_signal", "macd_histogram": "macd - macd_signal"}
register("macd", price_query(T.momentum, *macd), f"{MACD} {final('m', macd)}")

GAINS = f"{BASE}, g AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0.0::DOUBLE END AS gain, CASE WHEN step < 0 THEN -step ELSE 0.0::DOUBLE END AS loss FROM b)"
rsi_sql = lambda n: f"100 - 100 / (1 + {averaged('gain', f'(1.0::DOUBLE/{n})')} / nullif({averaged('loss', f'(1.0::DOUBLE/{n})')}, 0))"
RSI = f"{GAINS}, r AS (SELECT *, {rsi_sql(14)} AS rsi_14, {rsi_sql(7)} AS rsi_7 FROM g)"
register("rsi", price_query(T.momentum, "rsi_14", "rsi_7"), f"{RSI} {final('r', {'rsi_14': 'rsi_14', 'rsi_7': 'rsi_7'})}")

TR = f"{BASE}, g AS (SELECT *, greatest(high - low, abs(high - prior), abs(low - prior)) AS tr FROM b), a AS (SELECT *, {averaged('tr', '(2.0::DOUBLE/15)')} AS atr_14 FROM g)"
register("atr", price_query(T.volatility, "atr_14", "atr_pct"), f"{TR} {final('a', {'atr_14': 'atr_14', 'atr_pct': 'atr_14 / nullif(close, 0)'})}")

STOCH = f"""{BASE}, s0 AS (SELECT *, {full('min', 'low', 14)} AS lo, {full('max', 'high', 14)} AS hi FROM b),
s1 AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS k, (hi - close) / nullif(hi - lo, 0) * -100 AS wr FROM s0),
s AS (SELECT *, {full('avg', 'k', 3)} AS d FROM s1)"""
register("stochastic_williams", price_query(T.momentum, "stochastic_k", "stochastic_d", "williams_r"), f"{STOCH} {final('s', {'stochastic_k': 'k', 'stochastic_d': 'd', 'williams_r': 'wr'})}")

mom = {f"momentum_{n}d": changed("close", n - 1) for n in (5, 10, 30, 90, 180)} | {"roc_5d": changed("close", 4), "weekly_return": changed("close", 4)}
mom |= {"roc_10d": changed("close", 9), "roc_20d": changed("close", 19), "daily_return": changed("close", 1)}
MOM = f"{BASE}, m AS (SELECT stock_id, date, rn, {', '.join(f'{q} AS {n}' for n, q in mom.items())} FROM b)"
register("momentum", price_query(T.momentum, *mom), f"{MOM} {final('m', {n: n for n in mom})}")

BB = f"""{BASE}, m AS (SELECT *, {full('avg', 'close', 20)} AS m20, {full('stddev_samp', 'close', 20)} AS s20 FROM b),
u AS (SELECT *, m20 + 2 * s20 AS up, m20 - 2 * s20 AS lo FROM m)"""
bb = {"bollinger_upper": "up", "bollinger_lower": "lo", "bollinger_pct_b": "(close - lo) / nullif(up - lo, 0)", "bollinger_bandwidth": "(up - lo) / nullif(m20, 0)"}
register("bollinger", price_query(T.volatility, *bb), f"{BB} {final('u', bb)}")

RV = f"""{BASE}, v AS (SELECT *, stddev_samp(log_return) {over(20)} * sqrt(252) AS v20, stddev_samp(log_return) {over(60)} * sqrt(252) AS v60 FROM b)"""
register(
    "realized_vol",
    price_query(T.volatility, "realized_vol_20d", "realized_vol_60d", "vol_ratio"),
    f"{RV} {final('v', {'realized_vol_20d': 'v20', 'realized_vol_60d': 'v60', 'vol_ratio': 'v20 / nullif(v60, 0)'})}",
)

vr = {f"volume_ratio_{n}d": f"nullif(volume, 0) / nullif({full('avg', 'volume', n)}, 0)" for n in (10, 30)}
VR = f"{BASE}, v AS (SELECT stock_id, date, rn, {', '.join(f'{q} AS {n}' for n, q in vr.items())} FROM b)"
register("volume_ratios", price_query(T.volume, *vr), f"{VR} {final('v', {n: n for n in vr})}")

OBV = f"""{BASE}, o AS (SELECT *, sum(coalesce(sign(step) * volume, 0)) {over()} AS obv,
  sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0)) {over()} AS ad,
  sum(coalesce(step / nullif(prior, 0) * volume, 0)) {over()} AS vpt FROM b), t AS (SELECT *, {trended('obv', 20)} AS obv_trend FROM o)"""
register("obv", price_query(T.volume, "obv", "obv_trend"), f"{OBV} {final('t', {'obv': 'obv', 'obv_trend': 'obv_trend'})}")
register("acc_dist", price_query(T.volume, "accumulation_distribution"), f"{OBV} {final('t', {'accumulation_distribution': 'ad'})}")
register("vpt", price_query(T.volume, "volume_price_trend"), f"{OBV} {final('t', {'volume_price_trend': 'vpt'})}")

HL = f"{BASE}, y AS (SELECT *, max(high) {over(252)} AS hi, min(low) {over(252)} AS lo FROM b)"
register("high_low_52w", price_query(T.extended, "high_52w_pct", "low_52w_pct"), f"{HL} {final('y', {'high_52w_pct': '(close - hi) / nullif(hi, 0)', 'low_52w_pct': '(close - lo) / nullif(lo, 0)'})}")

CCI = f"""{BASE}, c AS (SELECT *, {full('avg', 'tp', 14)} AS m, list(tp) {over(14)} AS tps FROM b),
d AS (SELECT *, list_sum(list_transform(tps, lambda x: abs(x - m))) / 14 AS mad FROM c)"""
register("cci", price_query(T.extended, "cci_14"), f"{CCI} {final('d', {'cci_14': '(tp - m) / nullif(0.015 * mad, 0)'})}")

MFI = f"""{BASE}, f AS (SELECT *, CASE WHEN tp_step > 0 THEN tp * volume ELSE 0 END AS up, CASE WHEN tp_step < 0 THEN tp * volume ELSE 0 END AS dn FROM b),
g AS (SELECT *, {full('sum', 'up', 14)} AS su, {full('sum', 'dn', 14)} AS sd FROM f)"""
register("mfi", price_query(T.extended, "mfi_14"), f"{MFI} {final('g', {'mfi_14': '100 - 100 / (1 + su / nullif(sd, 0))'})}")


def rel_strength(spark, sf_dir):
    df = T.relative_strength(T._base(M.bars(spark, sf_dir)), M.benchmark(spark, sf_dir), M.sector_funds(spark, sf_dir))
    return df.filter(F.col("rn") >= T.LEAST_ROWS).select("stock_id", "date", *[F.round(n, 6).alias(n) for n in ("relative_strength_vs_spy", "relative_strength_vs_sector")])


REL = f"""{BASE}, {BENCH}, {FUNDS},
j AS (SELECT b.*, m.close AS market FROM b ASOF LEFT JOIN bench m ON b.date >= m.date),
k AS (SELECT j.*, f.close AS fund FROM j ASOF LEFT JOIN funds f ON j.sector_id = f.sector_id AND j.date >= f.date),
r AS (SELECT *, {changed('close', 19)} AS mine, {changed('market', 19)} AS theirs, {changed('fund', 19)} AS peers FROM k)"""
register("rel_strength", rel_strength, f"{REL} {final('r', {'relative_strength_vs_spy': 'mine / nullif(theirs, 0)', 'relative_strength_vs_sector': 'mine / nullif(peers, 0)'})}")


def beta_corr(spark, sf_dir):
    df = T.beta_and_correlation(M.bars(spark, sf_dir), M.benchmark(spark, sf_dir))
    return df.select("stock_id", "date", *[F.round(n, 6).alias(n) for n in ("beta_60d", "correlation_spy_60d")])


BETA = f"""{BASE}, {BENCH}, mr AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS m FROM bench),
p AS (SELECT b.stock_id, b.date, step / nullif(prior, 0) AS r, m FROM b JOIN mr USING (date) WHERE prior IS NOT NULL AND m IS NOT NULL),
q AS (SELECT stock_id, date, count(*) {over(60)} AS n, covar_samp(r, m) {over(60)} AS cv, var_samp(m) {over(60)} AS vs, corr(r, m) {over(60)} AS co FROM p)
SELECT stock_id, date, round(CASE WHEN n = 60 AND vs <> 0 THEN cv / vs END, 6) AS beta_60d, round(CASE WHEN n = 60 AND vs <> 0 THEN co END, 6) AS correlation_spy_60d FROM q"""
register("beta_corr", beta_corr, BETA)


def technical_all(spark, sf_dir):
    """All 61 features of the last date of each stock."""
    from ..functions.windows import latest_per_key

    df = T.technical_features(M.bars(spark, sf_dir), M.benchmark(spark, sf_dir), M.sector_funds(spark, sf_dir))
    return latest_per_key(df, ["stock_id"]).select("stock_id", "date", *[F.round(n, 6).alias(n) for n in T.FEATURES])


#: Every technical feature of every date, from the statements above.
_PARTS = (
    "sma_all price_gaps slopes ema_all macd rsi atr stochastic_williams momentum bollinger realized_vol volume_ratios obv acc_dist vpt high_low_52w cci mfi rel_strength"
).split()
_ALL = "FROM " + " ".join(f"{'JOIN ' if i else ''}({SQL[q]}) {q}{' USING (stock_id, date)' if i else ''}" for i, q in enumerate(_PARTS)) + f" LEFT JOIN ({BETA}) beta_corr USING (stock_id, date)"
register("technical_latest", technical_all, f"SELECT stock_id, date, {', '.join(T.FEATURES)} {_ALL} QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) = 1")

STATE_AT = "2001-06-30"
#: Features with an endless memory, some made of them, and some of the longest windows.
_CARRIED = "ema_10 ema_20 ema_50 price_vs_ema20 ema50_vs_sma200 rsi_14 rsi_7 macd macd_signal macd_histogram atr_14 atr_pct obv obv_trend sma200_slope high_52w_pct low_52w_pct momentum_180d relative_strength_vs_spy beta_60d".split()


def incremental_features(spark, sf_dir):
    """Features of all bars after STATE_AT, from the state at that date."""
    bars = M.bars(spark, sf_dir)
    state = written(N.start_state(bars.filter(F.col("date") <= STATE_AT)), "feature-state")[0]
    found = N.advance(state, bars.filter(F.col("date") > STATE_AT), M.benchmark(spark, sf_dir), M.sector_funds(spark, sf_dir))[0]
    return found.select("stock_id", "date", *[F.round(c, 6).alias(c) for c in _CARRIED])


register("incremental_features", incremental_features, f"SELECT stock_id, date, {', '.join(_CARRIED)} {_ALL} WHERE date > DATE '{STATE_AT}'")
