"""Registered queries: labels, macro, sentiment, joins, nested data, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import asof_join, by, calendar_fill, latest_per_key
from ..operators import labels as L
from ..operators import macro as C
from ..operators import sentiment as S
from ..sources import market as M
from .fundamental import STOCKS
from .technical import BARS, BENCH, FUNDS, changed, full, r6

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


# --- labels --------------------------------------------------------------------------------

BUCKET = "CASE WHEN fr <= -0.05 THEN 0 WHEN fr <= 0.05 THEN 1 WHEN fr <= 0.15 THEN 2 WHEN fr IS NOT NULL THEN 3 END"
LABELS = f"""WITH {BARS}, fwd AS (SELECT *, lead(close, 63) OVER (PARTITION BY stock_id ORDER BY date) / nullif(close, 0) - 1 AS fr FROM bars),
labelled AS (SELECT stock_id, sector_id, date, fr, ({BUCKET})::INT AS label FROM fwd)"""


@register("forward_return", f"{LABELS} SELECT stock_id, date, {r6('fr')} AS forward_return FROM labelled")
def forward_return(spark, sf_dir):
    return L.forward_returns(M.bars(spark, sf_dir)).select("stock_id", "date", F.round("forward_return", 6).alias("forward_return"))


@register("label_bucket", f"{LABELS} SELECT stock_id, date, label FROM labelled")
def label_bucket(spark, sf_dir):
    return L.forward_returns(M.bars(spark, sf_dir)).select("stock_id", "date", "label")


@register("class_distribution", f"{LABELS}, {STOCKS} SELECT sector, label, count(*) AS n FROM labelled JOIN stocks USING (stock_id) WHERE label IS NOT NULL GROUP BY ALL")
def class_distribution(spark, sf_dir):
    labelled = L.forward_returns(M.bars(spark, sf_dir)).join(F.broadcast(M.stocks(spark, sf_dir)), "stock_id")
    return L.class_distribution(labelled, ["sector"])


@register(
    "walk_forward",
    f"""WITH RECURSIVE {BARS}, span AS (SELECT min(date) AS lo, max(date) AS hi FROM bars),
fold AS (SELECT 0 AS fold, lo AS train_start, hi FROM span UNION ALL SELECT fold + 1, (train_start + INTERVAL 3 MONTH)::DATE, hi FROM fold WHERE train_start < hi),
ends AS (SELECT fold, train_start, (train_start + INTERVAL 36 MONTH)::DATE AS train_end, hi FROM fold),
vals AS (SELECT *, (train_end + INTERVAL 1 MONTH)::DATE AS val_start FROM ends),
done AS (SELECT *, (val_start + INTERVAL 3 MONTH)::DATE AS val_end FROM vals)
SELECT fold, train_start, train_end, val_start, val_end FROM done WHERE val_end <= hi""",
)
def walk_forward(spark, sf_dir):
    return L.walk_forward(M.bars(spark, sf_dir).select("date"))


# --- macro ---------------------------------------------------------------------------------

_RAW = {
    "treasury_10y": ("day", "mean / 30", "TRUE"), "treasury_2y": ("day", "mean / 40", "o_orderstatus = 'O'"), "fed_funds": ("month", "mean / 50", "TRUE"),
    "aaa": ("day", "mean / 45", "o_orderpriority = '2-HIGH'"), "baa": ("day", "mean / 35", "o_orderpriority = '1-URGENT'"),
    "unemployment": ("month", "mean / 25", "o_orderpriority = '1-URGENT'"), "cpi": ("month", "total / 1000", "TRUE"), "initial_claims": ("week", "n", "TRUE"),
    "m2": ("month", "total / 500", "TRUE"), "dollar_index": ("day", "mean", "TRUE"), "vix": ("day", "mean / 8", "o_orderstatus = 'F'"), "gdp": ("quarter", "total / 100", "TRUE"),
}
_ONE = """SELECT '{name}' AS series_id, date, {value} AS value FROM (SELECT date_trunc('{unit}', o_orderdate)::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total,
  count(*)::DOUBLE AS n, total / n / 1000 AS mean FROM orders WHERE {keep} GROUP BY 1)"""
SERIES = "series AS (" + " UNION ALL ".join(_ONE.format(name=n, unit=u, value=v, keep=k) for n, (u, v, k) in _RAW.items()) + ")"
SPINE = "spine AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)"


def _spine(spark, sf_dir):
    return M.benchmark(spark, sf_dir).select("date")


@register(
    "yield_spread",
    f"""WITH {SERIES}, {SPINE}, a AS (SELECT s.date, t.value AS t10 FROM spine s ASOF LEFT JOIN (FROM series WHERE series_id = 'treasury_10y') t ON s.date >= t.date),
b AS (SELECT a.*, t.value AS t2 FROM a ASOF LEFT JOIN (FROM series WHERE series_id = 'treasury_2y') t ON a.date >= t.date)
SELECT date, t10 AS treasury_10y, t2 AS treasury_2y, nullif(t10, 0) - nullif(t2, 0) AS yield_curve_slope FROM b""",
)
def yield_spread(spark, sf_dir):
    wide = C.wide_asof(_spine(spark, sf_dir), M.macro_series(spark, sf_dir), ["treasury_10y", "treasury_2y"])
    slope = C.nonzero("treasury_10y") - C.nonzero("treasury_2y")
    return wide.select("date", "treasury_10y", "treasury_2y", slope.alias("yield_curve_slope"))


@register(
    "asof_delta_90d",
    f"""WITH {SERIES}, {SPINE}, f AS (FROM series WHERE series_id = 'fed_funds'), a AS (SELECT s.date, f.value AS now FROM spine s ASOF LEFT JOIN f ON s.date >= f.date),
b AS (SELECT a.*, f.value AS old FROM (SELECT *, date - 90 AS before FROM a) a ASOF LEFT JOIN f ON a.before >= f.date)
SELECT date, {r6('now')} AS fed_funds_rate, {r6('now - old')} AS fed_rate_change_3m FROM b""",
)
def asof_delta_90d(spark, sf_dir):
    spine, series = _spine(spark, sf_dir), M.macro_series(spark, sf_dir)
    now, old = C.wide_asof(spine, series, ["fed_funds"]), C.wide_asof(spine, series, ["fed_funds"], 90, "_90")
    return now.join(old, "date").select("date", F.round("fed_funds", 6).alias("fed_funds_rate"), F.round(F.col("fed_funds") - F.col("fed_funds_90"), 6).alias("fed_rate_change_3m"))


@register(
    "full_outer_spread",
    f"""WITH {SERIES} SELECT date, {r6('b.value - a.value')} AS credit_spread FROM (FROM series WHERE series_id = 'baa') b
FULL JOIN (FROM series WHERE series_id = 'aaa') a USING (date)""",
)
def full_outer_spread(spark, sf_dir):
    return C.credit_spread(M.macro_series(spark, sf_dir)).select("date", F.round("value", 6).alias("credit_spread"))


@register(
    "yoy",
    f"""WITH {SERIES}, l AS (SELECT *, lag(value, 11) OVER w AS b, row_number() OVER w AS n FROM series WHERE series_id IN ('cpi', 'm2')
WINDOW w AS (PARTITION BY series_id ORDER BY date)) SELECT CASE series_id WHEN 'cpi' THEN 'cpi_yoy' ELSE 'm2_growth' END AS series_id, date,
{r6('CASE WHEN n >= 13 THEN (value - b) / nullif(abs(b), 0) END')} AS value FROM l""",
)
def yoy(spark, sf_dir):
    return C.over_own_rows(M.macro_series(spark, sf_dir)).filter("series_id in ('cpi_yoy', 'm2_growth')").select("series_id", "date", F.round("value", 6).alias("value"))


@register(
    "four_obs_avg",
    f"""WITH {SERIES}, s AS (FROM series WHERE series_id IN ('initial_claims', 'gdp')),
l AS (SELECT *, lag(value) OVER w AS b, avg(value) OVER f AS m, count(*) OVER f AS n FROM s WINDOW w AS (PARTITION BY series_id ORDER BY date),
f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT CASE series_id WHEN 'gdp' THEN 'gdp_growth' ELSE 'initial_claims_4wk_avg' END AS series_id, date,
{r6("CASE WHEN series_id = 'gdp' THEN (value - b) / nullif(abs(b), 0) * 4 WHEN n = 4 THEN m ELSE value END")} AS value FROM l""",
)
def four_obs_avg(spark, sf_dir):
    rows = C.over_own_rows(M.macro_series(spark, sf_dir)).filter("series_id in ('initial_claims_4wk_avg', 'gdp_growth')")
    return rows.select("series_id", "date", F.round("value", 6).alias("value"))


@register(
    "percentile_1y",
    f"""WITH {SERIES}, v AS (SELECT date, value, list(value) OVER (ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS seen
FROM series WHERE series_id = 'vix') SELECT date, {r6('len(list_filter(seen, lambda x: x < value))::DOUBLE / len(seen)')} AS vix_percentile_1y FROM v""",
)
def percentile_1y(spark, sf_dir):
    vix = M.macro_series(spark, sf_dir).filter("series_id = 'vix'")
    return C.percentile_over_year(vix).select("date", F.round("percentile", 6).alias("vix_percentile_1y"))


@register(
    "breadth",
    f"""WITH {BARS}, s AS (SELECT date, close, {full('avg', 'close', 200)} AS sma, stock_id FROM bars)
SELECT date, round(avg((close > sma)::INT), 4) AS market_breadth FROM s WHERE sma IS NOT NULL GROUP BY date""",
)
def breadth(spark, sf_dir):
    return C.breadth(M.bars(spark, sf_dir))


_MOM = "lag(close, 29) OVER (PARTITION BY sector_id ORDER BY date)"


@register("sector_momentum", f"WITH {FUNDS} SELECT sector_id, date, {r6(f'close / nullif({_MOM}, 0) - 1')} AS momentum FROM funds")
def sector_momentum(spark, sf_dir):
    return C.fund_momentum(M.sector_funds(spark, sf_dir), "sector_id")


@register(
    "relative_flow",
    f"""WITH {FUNDS}, {BENCH}, m AS (SELECT sector_id, date, round(close / nullif({_MOM}, 0) - 1, 6) AS mom FROM funds),
k AS (SELECT date, round(close / nullif(lag(close, 29) OVER (ORDER BY date), 0) - 1, 6) AS mk FROM bench)
SELECT sector_id, date, {r6('mom - mk')} AS relative_flow FROM m JOIN k USING (date)""",
)
def relative_flow(spark, sf_dir):
    return C.relative_flow(M.sector_funds(spark, sf_dir), M.benchmark(spark, sf_dir), "sector_id").select("sector_id", "date", "relative_flow")


def macro_all(spark, sf_dir) -> DataFrame:
    """The 36 macro features of every trading day."""
    names = F.element_at(F.array(*map(F.lit, C.SECTORS)), F.col("sector_id").cast("int") + 1)
    funds = M.sector_funds(spark, sf_dir).select(names.alias("fund"), "date", "close")
    benchmark = M.benchmark(spark, sf_dir)
    return C.macro_features(benchmark.select("date"), M.macro_series(spark, sf_dir), M.bars(spark, sf_dir), funds, benchmark, M.style_funds(spark, sf_dir))


_DELTAS = {"credit_spread_change": ("spread", 30), "unemployment_change": ("unemployment", 90), "cpi_change_3m": ("cpi", 90), "dollar_change_30d": ("dollar_index", 30), "vix_change_5d": ("vix", 5)}


def _delta_sql(name: str, series: str, days: int) -> str:
    """A table of dates and a series' change over a number of days."""
    rows = f"(FROM all_series WHERE series_id = '{series}')"
    return f"""{name} AS (SELECT a.date, a.now, a.now - o.value AS change FROM (SELECT s.date, s.date - {days} AS before, n.value AS now FROM spine s ASOF LEFT JOIN {rows} n ON s.date >= n.date) a
ASOF LEFT JOIN {rows} o ON a.before >= o.date)"""


_STYLE = "({0} / nullif(lag({0}, 29) OVER (ORDER BY date), 0) - 1)"


@register(
    "macro_changes",
    f"""WITH {SERIES}, {SPINE}, {BARS}, all_series AS (SELECT series_id, date, value FROM series UNION ALL
  SELECT 'spread', date, b.value - a.value FROM (FROM series WHERE series_id = 'baa') b FULL JOIN (FROM series WHERE series_id = 'aaa') a USING (date)),
style AS (SELECT date, avg(close) FILTER (WHERE stock_id % 2 = 0) AS growth, avg(close) FILTER (WHERE stock_id % 2 = 1) AS val FROM bars GROUP BY date),
tilt AS (SELECT date, {_STYLE.format('growth')} - {_STYLE.format('val')} AS tilt FROM style),
{', '.join(_delta_sql(n, *d) for n, d in _DELTAS.items())}
SELECT s.date, {r6('unemployment_change.now')} AS unemployment_rate, {', '.join(f'{r6(f"{n}.change")} AS {n}' for n in _DELTAS)}, {r6('tilt')} AS growth_vs_value
FROM spine s LEFT JOIN tilt USING (date) {' '.join(f'JOIN {n} ON s.date = {n}.date' for n in _DELTAS)}""",
)
def macro_changes(spark, sf_dir):
    return macro_all(spark, sf_dir).select("date", *[F.round(c, 6).alias(c) for c in ("unemployment_rate", *_DELTAS, "growth_vs_value")])


# --- sentiment -----------------------------------------------------------------------------

AS_OF_DAYS = ("2024-01-10", "2024-01-20", "2024-01-30")
SSPINE = f"""spine AS (SELECT n_nationkey::BIGINT AS stock_id, as_of FROM nation, (SELECT unnest([{', '.join(f"DATE '{d}'" for d in AS_OF_DAYS)}]) AS as_of))"""
EVENTS = "ev AS (SELECT (user_id % 25)::BIGINT AS stock_id, event_id, ts::DATE AS day, event_type AS kind, value AS amount, props FROM events)"


def near(days: int, kind: str) -> str:
    return f"near AS (SELECT s.*, e.* EXCLUDE (stock_id), s.as_of - e.day AS age FROM spine s JOIN ev e USING (stock_id) WHERE s.as_of - e.day BETWEEN 0 AND {days} AND kind IN ({kind}))"


def sentiment_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([(d,) for d in AS_OF_DAYS], "d string").select(F.to_date("d").alias("as_of"))
    return M.stocks(spark, sf_dir).select("stock_id").crossJoin(F.broadcast(days))  # three as-of dates


def post_events(spark, sf_dir):
    rows = M.activity(spark, sf_dir).filter(F.col("kind").isin("click", "view"))
    board = F.when(F.col("kind") == "click", "wallstreetbets").otherwise("stocks")
    return rows.select(
        "stock_id", "day", F.col("amount").alias("score"), F.get_json_object("props", "$.k").cast("double").alias("comments"), ((F.col("amount") - 50) / 50).alias("compound"), board.alias("board")
    )


POSTS = f"""WITH {SSPINE}, {EVENTS}, {near(14, "'click', 'view'")},
p AS (SELECT stock_id, as_of, age <= 7 AS wk, amount AS score, json_extract_string(props, '$.k')::DOUBLE AS comments, (amount - 50) / 50 AS compound, kind = 'click' AS wsb FROM near),
g AS (SELECT stock_id, as_of, count(*) FILTER (WHERE wk) AS n7, count(*) FILTER (WHERE NOT wk) AS n14, avg(compound) FILTER (WHERE wk) AS m, stddev_samp(compound) FILTER (WHERE wk) AS sd,
  avg((compound > 0.05)::INT) FILTER (WHERE wk) AS bull, avg(score) FILTER (WHERE wk) AS sc, avg(comments) FILTER (WHERE wk) AS cm, max((wk AND wsb)::INT) AS wsb FROM p GROUP BY ALL)"""


@register(
    "mentions_7d",
    f"""{POSTS} SELECT stock_id, as_of, coalesce(n7, 0) AS reddit_mention_count_7d, coalesce(n7 - n14, 0) AS reddit_mention_change, coalesce(wsb, 0) AS wsb_mention_flag
FROM spine LEFT JOIN g USING (stock_id, as_of)""",
)
def mentions_7d(spark, sf_dir):
    return S.posts(sentiment_spine(spark, sf_dir), post_events(spark, sf_dir)).select("stock_id", "as_of", "reddit_mention_count_7d", "reddit_mention_change", "wsb_mention_flag")


_STATS = {"reddit_sentiment_avg_7d": "m", "reddit_sentiment_std_7d": "sd", "reddit_bullish_ratio": "bull", "reddit_post_score_avg": "sc", "reddit_comment_ratio": "cm"}


@register(
    "sentiment_stats",
    f"{POSTS} SELECT stock_id, as_of, {', '.join(f'{r6(f'coalesce({c}, 0)')} AS {n}' for n, c in _STATS.items())} FROM spine LEFT JOIN g USING (stock_id, as_of)",
)
def sentiment_stats(spark, sf_dir):
    return S.posts(sentiment_spine(spark, sf_dir), post_events(spark, sf_dir)).select("stock_id", "as_of", *[F.round(n, 6).alias(n) for n in _STATS])


def news_events(spark, sf_dir):
    rows = M.activity(spark, sf_dir).filter("kind = 'view'")
    return rows.select("stock_id", F.when(F.pmod("event_id", F.lit(50)) != 0, F.col("day")).alias("day"), ((F.col("amount") - 50) / 53).alias("sentiment"))


@register(
    "news_momentum",
    f"""WITH {SSPINE}, {EVENTS}, e AS (SELECT stock_id, CASE WHEN event_id % 50 <> 0 THEN day END AS day, (amount - 50) / 53 AS sentiment FROM ev WHERE kind = 'view'),
x AS (SELECT s.*, sentiment, day IS NULL OR as_of - day <= 7 AS wk FROM spine s JOIN e USING (stock_id) WHERE day IS NULL OR as_of - day BETWEEN 0 AND 30),
g AS (SELECT stock_id, as_of, count(*) FILTER (WHERE wk) AS n7, count(*) AS n30, coalesce(avg(sentiment) FILTER (WHERE wk), 0) AS m7, avg(sentiment) AS m30, max((wk AND sentiment < -0.5)::INT) AS neg FROM x GROUP BY ALL)
SELECT stock_id, as_of, coalesce(n7, 0) AS news_volume_7d, coalesce(n7 - greatest(0, n30 - n7), 0) AS news_volume_change, coalesce(round(m7, 4), 0) AS news_sentiment_avg_7d,
  coalesce(round(m30, 4), 0) AS news_sentiment_30d, coalesce(round(m7 - m30, 4), 0) AS news_sentiment_momentum, coalesce(neg, 0) AS negative_news_flag FROM spine LEFT JOIN g USING (stock_id, as_of)""",
)
def news_momentum(spark, sf_dir):
    return S.news(sentiment_spine(spark, sf_dir), news_events(spark, sf_dir))


def insider_events(spark, sf_dir):
    rows = M.activity(spark, sf_dir).filter(F.col("kind").isin("purchase", "signup"))
    return rows.select("stock_id", "day", F.when(F.col("kind") == "purchase", "P").otherwise("S").alias("code"), "amount")


@register(
    "insider_30d",
    f"""WITH {SSPINE}, {EVENTS}, {near(30, "'purchase', 'signup'")},
g AS (SELECT stock_id, as_of, count(*) FILTER (WHERE kind = 'purchase') AS p, count(*) FILTER (WHERE kind = 'signup') AS s, sum(amount) FILTER (WHERE kind = 'purchase') AS v FROM near GROUP BY ALL)
SELECT stock_id, as_of, coalesce(p, 0) AS insider_buy_count_30d, coalesce(s, 0) AS insider_sell_count_30d, coalesce(round((p - s)::DOUBLE / nullif(p + s, 0), 4), 0) AS insider_net_sentiment,
  {r6('coalesce(v, 0)')} AS insider_dollar_volume FROM spine LEFT JOIN g USING (stock_id, as_of)""",
)
def insider_30d(spark, sf_dir):
    out = S.insiders(sentiment_spine(spark, sf_dir), insider_events(spark, sf_dir))
    return out.withColumn("insider_dollar_volume", F.round("insider_dollar_volume", 6))


def filing_events(spark, sf_dir):
    rows = M.activity(spark, sf_dir)
    form = F.when(F.col("kind") == "error", "8-K").when(F.pmod("event_id", F.lit(40)) == 0, "SC 13D").when(F.pmod("event_id", F.lit(40)) == 1, "SC 13G/A").otherwise("10-Q")
    return rows.select("stock_id", "day", form.alias("form"), ((F.col("kind") == "error") & (F.col("amount") > 90)).cast("int").alias("negative"))


FILINGS = f"""WITH {SSPINE}, {EVENTS}, {near(90, "'error', 'click', 'view', 'purchase', 'signup'")},
k AS (SELECT *, CASE WHEN kind = 'error' THEN '8-K' WHEN event_id % 40 = 0 THEN 'SC 13D' WHEN event_id % 40 = 1 THEN 'SC 13G/A' ELSE '10-Q' END AS form, (kind = 'error' AND amount > 90) AS neg FROM near),
g AS (SELECT stock_id, as_of, max((form = 'SC 13D')::INT) AS a, count(*) FILTER (WHERE form LIKE 'SC 13%') AS st, count(*) FILTER (WHERE form = '8-K' AND age <= 30) AS m, max((form = '8-K' AND age <= 30 AND neg)::INT) AS n FROM k GROUP BY ALL)"""


@register("activist_90d", f"{FILINGS} SELECT stock_id, as_of, coalesce(a, 0) AS activist_filing_flag, coalesce(st, 0) AS activist_stake_change FROM spine LEFT JOIN g USING (stock_id, as_of)")
def activist_90d(spark, sf_dir):
    return S.filings(sentiment_spine(spark, sf_dir), filing_events(spark, sf_dir)).select("stock_id", "as_of", "activist_filing_flag", "activist_stake_change")


@register("events_30d", f"{FILINGS} SELECT stock_id, as_of, coalesce(m, 0) AS material_event_count_30d, coalesce(n, 0) AS negative_8k_flag FROM spine LEFT JOIN g USING (stock_id, as_of)")
def events_30d(spark, sf_dir):
    return S.filings(sentiment_spine(spark, sf_dir), filing_events(spark, sf_dir)).select("stock_id", "as_of", "material_event_count_30d", "negative_8k_flag")


_WORDS = "|".join(S.NEGATIVE_8K)


@register("negative_scan", f"SELECT doc_id, coalesce(regexp_matches(lower(text), '{_WORDS}')::INT, 0) AS is_negative FROM documents")
def negative_scan(spark, sf_dir):
    return M.table(spark, sf_dir, "documents").select("doc_id", S.is_negative_filing(F.col("text")).alias("is_negative"))


# --- joins, latest rows, nested data -------------------------------------------------------


@register("universe", f"WITH {STOCKS} SELECT stock_id, ticker, sector FROM stocks")
def universe(spark, sf_dir):
    return M.stocks(spark, sf_dir)


@register(
    "star_join",
    f"""WITH {BARS}, {STOCKS}, {BENCH} SELECT b.stock_id, ticker, sector, b.date, b.close, m.close AS market FROM bars b JOIN stocks USING (stock_id) LEFT JOIN bench m ON b.date = m.date""",
)
def star_join(spark, sf_dir):
    market = M.benchmark(spark, sf_dir).withColumnRenamed("close", "market")
    rows = M.bars(spark, sf_dir).select("stock_id", "date", "close").join(F.broadcast(M.stocks(spark, sf_dir)), "stock_id")
    return rows.join(market, "date", "left").select("stock_id", "ticker", "sector", "date", "close", "market")


@register("anti_new_rows", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def anti_new_rows(spark, sf_dir):
    seen = M.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(seen, "o_orderkey", "left_anti")


@register("semi_common", "SELECT c_custkey, c_nationkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) ON o_custkey = c_custkey")
def semi_common(spark, sf_dir):
    buyers = M.table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return M.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(buyers, "c_custkey", "left_semi")


@register("latest_per_key", f"WITH {BARS} SELECT stock_id, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) = 1")
def latest(spark, sf_dir):
    return latest_per_key(M.bars(spark, sf_dir).select("stock_id", "date", "close"), ["stock_id"])


_QUARTERS = """qs AS (SELECT c_nationkey::BIGINT AS stock_id, date_trunc('quarter', o_orderdate)::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@register("asof_fundamental", f"WITH {BARS}, {_QUARTERS} SELECT b.stock_id, b.date, round(q.revenue, 4) AS revenue FROM bars b ASOF LEFT JOIN qs q ON b.stock_id = q.stock_id AND b.date >= q.date")
def asof_fundamental(spark, sf_dir):
    orders, customers = M.table(spark, sf_dir, "orders"), M.table(spark, sf_dir, "customer")
    quarters = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("long").alias("stock_id"), F.to_date(F.trunc("o_orderdate", "quarter")).alias("date"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    )
    found = asof_join(M.bars(spark, sf_dir).select("stock_id", "date"), quarters, ["stock_id"], values=["revenue"])
    return found.select("stock_id", "date", F.round("revenue", 4).alias("revenue"))


@register("reindex_ffill", f"WITH {BENCH}, {SERIES} SELECT b.date, {r6('s.value')} AS initial_claims FROM bench b ASOF LEFT JOIN (FROM series WHERE series_id = 'initial_claims') s ON b.date >= s.date")
def reindex_ffill(spark, sf_dir):
    claims = M.macro_series(spark, sf_dir).filter("series_id = 'initial_claims'").select("date", F.col("value").alias("initial_claims"))
    spine = _spine(spark, sf_dir)
    return calendar_fill(spine, claims).join(spine, "date").select("date", F.round("initial_claims", 6).alias("initial_claims"))


@register(
    "parallel_arrays",
    """WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS supps FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS partkey, unnest(supps) AS suppkey FROM a""",
)
def parallel_arrays(spark, sf_dir):
    """Rows from columns kept as arrays side by side, as filing lists are."""
    item = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    orders = M.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(item.alias("items"))
    arrays = orders.select("l_orderkey", F.col("items.l_partkey").alias("partkey"), F.col("items.l_suppkey").alias("suppkey"))
    rows = arrays.select("l_orderkey", F.posexplode(F.arrays_zip("partkey", "suppkey")).alias("pos", "x"))
    return rows.select("l_orderkey", (F.col("pos") + 1).cast("long").alias("pos"), "x.partkey", "x.suppkey")


@register("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return M.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@register("keyword_flag", "SELECT page_id, (contains(lower(html), '<table') OR contains(lower(html), '<nav'))::INT AS flagged FROM pages")
def keyword_flag(spark, sf_dir):
    return M.table(spark, sf_dir, "pages").select("page_id", F.lower("html").rlike("<table|<nav").cast("int").alias("flagged"))


@register("pad_key", "SELECT c_custkey, lpad(ltrim(trim(c_custkey::VARCHAR), '0'), 10, '0') AS cik FROM customer")
def pad_key(spark, sf_dir):
    return M.table(spark, sf_dir, "customer").select("c_custkey", F.expr("lpad(ltrim('0', trim(cast(c_custkey as string))), 10, '0')").alias("cik"))


@register(
    "ordered_turns",
    "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id",
)
def ordered_turns(spark, sf_dir):
    turns = M.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"), F.max_by("text", "turn").alias("last_text"))
    return turns.select("conv_id", F.size("t").cast("long").alias("turns"), F.array_join("t.role", ">").alias("roles"), "last_text")
