"""Registered queries: datasets, preprocessing, signals, backtest, quality, with the SQL that states each result."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import div
from ..functions.windows import by, change, latest_per_key
from ..operators import boosting as B
from ..operators import dataset as D
from ..operators import fundamental as U
from ..operators import labels as L
from ..operators import macro as C
from ..operators import models as A
from ..operators import preprocess as P
from ..operators import quality as Q
from ..operators import sentiment as S
from ..operators import signals as G
from ..operators import technical as T
from ..sources import market as M
from ..sources.scratch import written
from . import training as R
from .fundamental import STOCKS
from .market_context import BUCKET, EVENTS, LABELS, SERIES, filing_events, insider_events, macro_all, news_events, post_events
from .technical import BARS, BENCH, changed, full, lagged, over, r6

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


# --- datasets ------------------------------------------------------------------------------


def _technical(spark, sf_dir) -> DataFrame:
    """The features of the dataset queries, from a stock's 20th row on."""
    df = T.volume(T.volatility(T.momentum(T._base(M.bars(spark, sf_dir)))))
    return df.filter(F.col("rn") >= T.LEAST_ROWS).select("stock_id", "date", "momentum_10d", "momentum_30d", "bollinger_pct_b", "volume_ratio_30d", "realized_vol_20d")


def _macro(spark, sf_dir) -> DataFrame:
    spine = M.benchmark(spark, sf_dir).select("date")
    wide = C.wide_asof(spine, M.macro_series(spark, sf_dir), ["vix", "treasury_10y"])
    return wide.select("date", F.col("vix").alias("vix_level"), "treasury_10y")


def _fundamental(spark, sf_dir) -> DataFrame:
    rev = F.max(F.when(F.col("metric") == "revenue", F.col("value")))
    gross = F.max(F.when(F.col("metric") == "gross_profit", F.col("value")))
    return M.statements(spark, sf_dir).groupBy("stock_id", F.col("period_end").alias("as_of")).agg(div(gross, rev).alias("gross_margin"))


def _sentiment(spark, sf_dir) -> DataFrame:
    """Insider features at the days on which insiders traded."""
    events = insider_events(spark, sf_dir)
    return S.insiders(events.select("stock_id", F.col("day").alias("as_of")).distinct(), events)


def features(spark, sf_dir) -> DataFrame:
    return D.feature_join(_technical(spark, sf_dir), M.stocks(spark, sf_dir), _sentiment(spark, sf_dir), _macro(spark, sf_dir), _fundamental(spark, sf_dir))


MODEL = ("realized_vol_20d", "volume_ratio_30d", "momentum_10d", "momentum_30d", "bollinger_pct_b", "vix_level", "treasury_10y", "gross_margin")
FEATURES = f"""{LABELS}, {STOCKS}, {SERIES},
t0 AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn, {changed('close', 9)} AS momentum_10d, {changed('close', 29)} AS momentum_30d,
  {full('avg', 'close', 20)} AS m20, {full('stddev_samp', 'close', 20)} AS s20, nullif(volume, 0) / nullif({full('avg', 'volume', 30)}, 0) AS volume_ratio_30d,
  ln(close / nullif({lagged('close', 1)}, 0)) AS lr FROM bars),
t1 AS (SELECT *, (close - (m20 - 2 * s20)) / nullif((m20 + 2 * s20) - (m20 - 2 * s20), 0) AS bollinger_pct_b, stddev_samp(lr) {over(20)} * sqrt(252) AS realized_vol_20d FROM t0),
t AS (FROM t1 WHERE rn >= 20),
gm AS (SELECT c_nationkey::BIGINT AS stock_id, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS date,
  (sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS fs, (sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'O'))::DOUBLE AS os,
  (sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'P'))::DOUBLE AS ps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f0 AS (SELECT t.*, (os + ps) * 0.8::DOUBLE / nullif((fs + os + ps) * 1.0, 0) AS gross_margin FROM t ASOF LEFT JOIN gm ON t.stock_id = gm.stock_id AND t.date >= gm.date),
f1 AS (SELECT f0.*, v.value AS vix_level FROM f0 ASOF LEFT JOIN (FROM series WHERE series_id = 'vix') v ON f0.date >= v.date),
f2 AS (SELECT f1.*, v.value AS treasury_10y FROM f1 ASOF LEFT JOIN (FROM series WHERE series_id = 'treasury_10y') v ON f1.date >= v.date),
features AS (SELECT f2.*, ticker FROM f2 JOIN stocks USING (stock_id))"""
#: Ratios of decimals, the same double in any engine; their sixth decimal is often a tie, so they are not rounded.
EXACT = ("vix_level", "treasury_10y")
_MODEL_SQL = ", ".join(c if c in EXACT else f"{r6(c)} AS {c}" for c in MODEL)


def _model(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[F.col(c) if c in EXACT else F.round(c, 6).alias(c) for c in MODEL])


@register("training_set", f"{FEATURES} SELECT stock_id, ticker, date, l.label, {_MODEL_SQL} FROM features JOIN labelled l USING (stock_id, date) WHERE l.label IS NOT NULL")
def training_set(spark, sf_dir):
    labelled = L.forward_returns(M.bars(spark, sf_dir)).select("stock_id", "date", "label")
    return _model(D.training_set(labelled, features(spark, sf_dir)), "stock_id", "ticker", "date", "label")


INFER_AT = "2000-06-30"


@register(
    "inference_set",
    f"{FEATURES} SELECT stock_id, ticker, date, {_MODEL_SQL} FROM features WHERE date <= DATE '{INFER_AT}' QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) = 1",
)
def inference_set(spark, sf_dir):
    return _model(D.inference_set(features(spark, sf_dir), INFER_AT), "stock_id", "ticker", "date")


def _steps(spark, sf_dir) -> DataFrame:
    return D.sequence_frame(M.bars(spark, sf_dir), _technical(spark, sf_dir), _sentiment(spark, sf_dir), _macro(spark, sf_dir))


@register(
    "lstm_frame",
    f"""{FEATURES}, ff AS (SELECT b.stock_id, b.date, b.close AS adj_close, b.volume, f.momentum_10d, f.momentum_30d, x.vix_level FROM bars b
LEFT JOIN features f USING (stock_id, date) LEFT JOIN (SELECT DISTINCT date, vix_level FROM (SELECT d.date, v.value AS vix_level FROM (SELECT DISTINCT date FROM bars) d
ASOF LEFT JOIN (FROM series WHERE series_id = 'vix') v ON d.date >= v.date)) x ON b.date = x.date)
SELECT stock_id, date, adj_close, volume, vix_level, {', '.join(f'{r6(c)} AS {c}' for c in ('momentum_10d', 'momentum_30d'))} FROM ff""",
)
def lstm_frame(spark, sf_dir):
    return _steps(spark, sf_dir).select("stock_id", "date", "adj_close", "volume", "vix_level", *[F.round(c, 6).alias(c) for c in ("momentum_10d", "momentum_30d")])


@register(
    "sequences",
    f"""WITH {BARS}, s AS (SELECT stock_id, date, list(volume::FLOAT) {over(60)} AS v, count(*) {over(60)} AS n FROM bars)
SELECT stock_id, date, n AS steps, v[1]::DOUBLE AS first_volume, v[60]::DOUBLE AS last_volume, list_sum(v)::DOUBLE AS sum_volume FROM s WHERE n = 60""",
)
def sequences(spark, sf_dir):
    found = D.sequences(M.bars(spark, sf_dir).select("stock_id", "date", "close", "volume"), ["close", "volume"])
    v = F.transform("sequence", lambda row: row[1].cast("double"))
    return found.select(
        "stock_id", "date", F.size("sequence").cast("long").alias("steps"), v[0].alias("first_volume"), v[59].alias("last_volume"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("sum_volume")
    )


# --- the same datasets with all 94 model features and all 18 columns of a step: no SQL ---------


def _all_technical(spark, sf_dir) -> DataFrame:
    return T.technical_features(M.bars(spark, sf_dir), M.benchmark(spark, sf_dir), M.sector_funds(spark, sf_dir))


def _all_sentiment(spark, sf_dir) -> DataFrame:
    """The 22 features at the days on which a stock has events."""
    spine = M.activity(spark, sf_dir).select("stock_id", F.col("day").alias("as_of")).distinct()
    return S.sentiment_features(spine, *[build(spark, sf_dir) for build in (post_events, news_events, insider_events, filing_events)])


def _all_fundamental(spark, sf_dir) -> DataFrame:
    """The 69 features at the ends of the quarters."""
    statements = M.statements(spark, sf_dir)
    dates = statements.select(F.col("period_end").alias("as_of")).distinct()
    return U.fundamental_features(statements, M.company_info(spark, sf_dir), M.bars(spark, sf_dir), M.stocks(spark, sf_dir), dates, M.METRICS)


def all_features(spark, sf_dir) -> DataFrame:
    return D.feature_join(_all_technical(spark, sf_dir), M.stocks(spark, sf_dir), _all_sentiment(spark, sf_dir), macro_all(spark, sf_dir), _all_fundamental(spark, sf_dir))


@register("training_set_wide")
def training_set_wide(spark, sf_dir):
    return D.training_set(L.forward_returns(M.bars(spark, sf_dir)).select("stock_id", "date", "label"), all_features(spark, sf_dir))


@register("inference_set_wide")
def inference_set_wide(spark, sf_dir):
    return D.inference_set(all_features(spark, sf_dir), INFER_AT)


@register("lstm_frame_wide")
def all_steps(spark, sf_dir):
    return D.sequence_frame(M.bars(spark, sf_dir), _all_technical(spark, sf_dir), _all_sentiment(spark, sf_dir), macro_all(spark, sf_dir))


# --- training: a window that ends at TRAIN_UNTIL, its last four months held out -------------

TRAIN_UNTIL = date(2000, 6, 30)
TRAIN_FROM, HOLD_FROM = R.months_before(TRAIN_UNTIL, 36), R.months_before(TRAIN_UNTIL, R.VALIDATION_MONTHS)
_NEAR = f"""near AS (FROM bars WHERE date BETWEEN DATE '{TRAIN_FROM}' AND DATE '{TRAIN_UNTIL}' + 150),
win AS (SELECT stock_id, date, lead(close, 63) OVER (PARTITION BY stock_id ORDER BY date) / nullif(close, 0) - 1 AS fr FROM near),
win_labels AS (SELECT stock_id, date, fr, ({BUCKET})::INT AS label FROM win WHERE date <= DATE '{TRAIN_UNTIL}' AND fr IS NOT NULL)"""
_WINDOW = f"{LABELS}, {_NEAR}"


def _window_labels(spark, sf_dir) -> DataFrame:
    return L.labels_between(M.bars(spark, sf_dir), TRAIN_FROM, TRAIN_UNTIL)


@register("labels_window", f"{_WINDOW} SELECT stock_id, date, {r6('fr')} AS forward_return, label FROM win_labels")
def labels_window(spark, sf_dir):
    return _window_labels(spark, sf_dir).select("stock_id", "date", F.round("forward_return", 6).alias("forward_return"), "label")


@register("train_split", f"{_WINDOW} SELECT date >= DATE '{HOLD_FROM}' AS held_out, label, count(*) AS n, min(date) AS first, max(date) AS last FROM win_labels GROUP BY ALL")
def train_split(spark, sf_dir):
    rows = R.split(_window_labels(spark, sf_dir), TRAIN_FROM, TRAIN_UNTIL, HOLD_FROM)
    return rows.groupBy("held_out", "label").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def _train_data(spark, sf_dir) -> DataFrame:
    labelled = _window_labels(spark, sf_dir).select("stock_id", "date", "label")
    return R.split(D.training_set(labelled, features(spark, sf_dir)), TRAIN_FROM, TRAIN_UNTIL, HOLD_FROM)


def _saved_train_data(spark, sf_dir) -> DataFrame:
    """The rows that models are fitted on, written once."""
    return written(_train_data(spark, sf_dir), "train-data")[0]


_TALL = " UNION ALL ".join(f"SELECT label, '{c}' AS feature, coalesce({c}, 0)::DOUBLE AS x FROM train" for c in MODEL)


@register(
    "boosting_histogram",
    f"""{FEATURES}, {_NEAR},
train AS (SELECT l.label, {', '.join(MODEL)} FROM features JOIN win_labels l USING (stock_id, date) WHERE date >= DATE '{TRAIN_FROM}' AND date < DATE '{HOLD_FROM}'),
tall AS ({_TALL}), b AS (SELECT feature, min(x) AS lo, max(x) AS hi, count(*) AS rows FROM tall GROUP BY feature),
c AS (SELECT feature, label, rows, least(4095, greatest(0, floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 4096)))::BIGINT AS cell FROM tall JOIN b USING (feature)),
u AS (SELECT feature, cell, rows, sum(count(*)) OVER (PARTITION BY feature ORDER BY cell) AS up_to FROM c GROUP BY feature, cell, rows),
ends AS (SELECT DISTINCT feature, cell FROM (SELECT feature, i, min(cell) AS cell FROM u, range(1, 64) t(i) WHERE up_to * 64 >= i * rows GROUP BY feature, i)),
numbered AS (SELECT feature, label, cell, (SELECT count(*) FROM ends e WHERE e.feature = c.feature AND e.cell < c.cell)::INT AS bin FROM c)
SELECT k::INT AS class, feature, bin, sum(((0.25::DOUBLE - (label = k)::INT) * 1048576)::BIGINT)::BIGINT AS gradient, count(*) * 393216 AS hessian, count(*) AS n
FROM numbered, range(4) t(k) GROUP BY ALL""",
)
def boosting_histogram(spark, sf_dir):
    """Sums of gradients from which the first trees take their first splits."""
    return B.root_histogram(_saved_train_data(spark, sf_dir).filter("not held_out"), MODEL)


def _boosted(spark, sf_dir):
    return R.fit_trees(_saved_train_data(spark, sf_dir), rounds=20, depth=3, patience=10)


@register("boosted_scores")
def boosted_scores(spark, sf_dir):
    """Probabilities of the held-out rows by boosted trees over the training rows."""
    return _boosted(spark, sf_dir)[2].select("stock_id", "date", "label", *[f"xgb_prob_{k}" for k in range(4)], "predicted_class")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """Each feature's total gain over the nodes of the trees."""
    return B.total_gain(_boosted(spark, sf_dir)[1], spark)


@register("sequence_scores")
def sequence_scores(spark, sf_dir):
    """Probabilities of the held-out sequences by the recurrent network, over the five step columns that have SQL."""
    labelled = written(_window_labels(spark, sf_dir).select("stock_id", "date", "label"), "window-labels")[0]
    held = R.fit_steps(_steps(spark, sf_dir), labelled, TRAIN_FROM, TRAIN_UNTIL, HOLD_FROM, A.RecurrentParams(hidden=24, layers=1, epochs=5, rate=3e-3))[2]
    return held.select("stock_id", "date", "label", *[f"lstm_prob_{k}" for k in range(4)], "predicted_class")


@register("trading_day_offset", f"WITH {BARS} SELECT stock_id, date, date + 94 AS horizon_end, date - 94 AS horizon_start FROM bars")
def trading_day_offset(spark, sf_dir):
    return M.bars(spark, sf_dir).select("stock_id", "date", L.trading_days_later("date", L.HORIZON).alias("horizon_end"), L.trading_days_later("date", -L.HORIZON).alias("horizon_start"))


# --- preprocessing: parts as rows, brands as sectors -----------------------------------------

PARTS = "parts AS (SELECT p_partkey, p_brand AS sector, p_retailprice AS pe_ratio, p_size::DOUBLE AS rsi_14, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice / p_size END AS atr_14 FROM part)"
_COLS = ("pe_ratio", "rsi_14", "atr_14")


def _parts(spark, sf_dir) -> DataFrame:
    ratio = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") / F.col("p_size"))
    return M.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("pe_ratio"), F.col("p_size").cast("double").alias("rsi_14"), ratio.alias("atr_14"))


_BOUNDS = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _COLS)
CLIPPED = f"""{PARTS}, b AS (SELECT {_BOUNDS} FROM parts),
k AS (SELECT p_partkey, sector, {', '.join(f'coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, hi_{c}), lo_{c}) END, 0) AS {c}' for c in _COLS)} FROM parts, b)"""


@register("winsor_bounds", f"WITH {CLIPPED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'lo_{c}')} AS lo, {r6(f'hi_{c}')} AS hi FROM b" for c in _COLS))
def winsor_bounds(spark, sf_dir):
    return P.FeatureScaler.fit(_parts(spark, sf_dir), _COLS).parameters.select("feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _z(c: str, by_sector: bool) -> str:
    w = "OVER (PARTITION BY sector)" if by_sector else "OVER ()"
    return r6(f"({c} - avg({c}) {w}) / CASE WHEN stddev_samp({c}) {w} > 0 THEN stddev_samp({c}) {w} ELSE 1 END")


@register("zscore_global", f"WITH {CLIPPED} SELECT p_partkey, {', '.join(f'{_z(c, False)} AS {c}' for c in _COLS)} FROM k")
def zscore_global(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return P.FeatureScaler.fit(parts, _COLS).transform(parts).select("p_partkey", *[F.round(c, 6).alias(c) for c in _COLS])


@register("zscore_sector", f"WITH {CLIPPED} SELECT p_partkey, {', '.join(f'{_z(c, c in P.SECTOR_FEATURES)} AS {c}' for c in _COLS)} FROM k")
def zscore_sector(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return P.FeatureScaler.fit(parts, _COLS, "sector").transform(parts).select("p_partkey", *[F.round(c, 6).alias(c) for c in _COLS])


@register(
    "coverage",
    f"WITH {PARTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg(({c} IS NOT NULL)::INT) * 100')} AS non_null_pct, count(*) FILTER (WHERE {c} IS NULL) AS nulls, {r6(f'avg({c})')} AS mean, "
        f"{r6(f'stddev_samp({c})')} AS std, {r6(f'quantile_cont({c}, 0.01)')} AS p01, {r6(f'quantile_cont({c}, 0.99)')} AS p99 FROM parts" for c in _COLS
    ),
)
def coverage(spark, sf_dir):
    found = P.coverage(_parts(spark, sf_dir), _COLS)
    return found.select("feature", "nulls", *[F.round(c, 6).alias(c) for c in ("non_null_pct", "mean", "std", "p01", "p99")])


# --- scaling by fold: bounds and moments of each fold's training rows, purged of labels that reach into validation

_FOLD_COLS = ("momentum_10d", "momentum_30d", "volume_ratio_30d", "realized_vol_20d")


def _fold_training(spark, sf_dir) -> DataFrame:
    bars = M.bars(spark, sf_dir)
    ends = bars.select("stock_id", "date", F.lead("date", L.HORIZON).over(by("stock_id")).alias("label_end"))
    rows = _technical(spark, sf_dir).select("stock_id", "date", *_FOLD_COLS).join(ends, ["stock_id", "date"])
    return written(L.purged_training(rows, L.walk_forward(bars.select("date"))), "fold-training")[0]


_FOLDS = f"""WITH RECURSIVE {BARS},
t0 AS (SELECT stock_id, date, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn, lead(date, 63) OVER (PARTITION BY stock_id ORDER BY date) AS label_end,
  {changed('close', 9)} AS momentum_10d, {changed('close', 29)} AS momentum_30d, nullif(volume, 0) / nullif({full('avg', 'volume', 30)}, 0) AS volume_ratio_30d,
  ln(close / nullif({lagged('close', 1)}, 0)) AS lr FROM bars),
t1 AS (SELECT *, stddev_samp(lr) {over(20)} * sqrt(252) AS realized_vol_20d FROM t0), t AS (FROM t1 WHERE rn >= 20),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM bars),
fold AS (SELECT 0 AS fold, lo AS train_start, hi FROM span UNION ALL SELECT fold + 1, (train_start + INTERVAL 3 MONTH)::DATE, hi FROM fold WHERE train_start < hi),
ends AS (SELECT fold, train_start, (train_start + INTERVAL 36 MONTH)::DATE AS train_end, hi FROM fold),
folds AS (SELECT *, (train_end + INTERVAL 1 MONTH)::DATE AS val_start FROM ends WHERE (train_end + INTERVAL 1 MONTH + INTERVAL 3 MONTH)::DATE <= hi),
tr AS (SELECT fold, {', '.join(_FOLD_COLS)} FROM t JOIN folds ON t.date >= train_start AND t.date < train_end AND label_end < val_start),
tall AS ({' UNION ALL '.join(f"SELECT fold, '{c}' AS feature, {c} AS x FROM tr" for c in _FOLD_COLS)}),
b AS (SELECT fold, feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM tall GROUP BY ALL),
k AS (SELECT fold, feature, lo, hi, coalesce(CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END, 0) AS x FROM tall JOIN b USING (fold, feature))"""


@register("fold_bounds", f"{_FOLDS} SELECT fold, feature, {r6('lo')} AS lo, {r6('hi')} AS hi, {r6('avg(x)')} AS mean, {r6('stddev_samp(x)')} AS std, count(*) AS n FROM k GROUP BY fold, feature, lo, hi")
def fold_bounds(spark, sf_dir):
    found = P.FoldScaler.fit(_fold_training(spark, sf_dir), _FOLD_COLS).parameters
    return found.select("fold", "feature", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "std")], "n")


# --- signals: probabilities are fixed functions of bars --------------------------------------

_SHAPES = {"xgb": (7, 3), "lstm": (5, 11)}


def _probabilities(spark, sf_dir) -> DataFrame:
    """Two models' class probabilities for every bar with a return, from its volume and row number."""
    rows = M.bars(spark, sf_dir).withColumn("rn", F.row_number().over(by("stock_id")) - 1).withColumn("actual_return", F.lead("close", 5).over(by("stock_id")) / F.col("close") - 1)
    rows = rows.filter("actual_return is not null").join(F.broadcast(M.stocks(spark, sf_dir)), "stock_id")
    cols, v = {}, F.col("volume").cast("long")
    for model, (a, b) in _SHAPES.items():
        raw = [F.pmod(v * a + F.col("rn") * b + k * k * a, F.lit(10 + k)) + 1 for k in range(4)]
        total = raw[0] + raw[1] + raw[2] + raw[3]
        cols |= {f"{model}_prob_{k}": raw[k] / total for k in range(4)}
    return rows.select("ticker", "date", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), "actual_return")).alias("actual_return"), *[c.alias(n) for n, c in cols.items()])


def _raw_sql(model: str) -> str:
    a, b = _SHAPES[model]
    terms = [f"((volume::BIGINT * {a} + rn * {b} + {k * k * a}) % {10 + k} + 1)" for k in range(4)]
    return ", ".join(f"{t}::DOUBLE / ({' + '.join(terms)}) AS {model}_prob_{k}" for k, t in enumerate(terms))


_MID = " + ".join(f"({m}::DOUBLE) * p{k}" for k, m in enumerate(G.MIDPOINTS))
SIGNALS = f"""WITH {BARS}, {STOCKS}, r0 AS (SELECT *, row_number() OVER w - 1 AS rn, lead(close, 5) OVER w / close - 1 AS ar FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
r AS (SELECT ticker, date, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, ar)) AS actual_return, {_raw_sql('xgb')}, {_raw_sql('lstm')} FROM r0 JOIN stocks USING (stock_id) WHERE ar IS NOT NULL),
m AS (SELECT *, {', '.join(f'0.6::DOUBLE * xgb_prob_{k} + 0.4::DOUBLE * lstm_prob_{k} AS q{k}' for k in range(4))} FROM r),
p AS (SELECT *, {', '.join(f'q{k} / (q0 + q1 + q2 + q3) AS p{k}' for k in range(4))} FROM m),
s AS (SELECT *, {_MID} AS er, greatest(p0, p1, p2, p3) AS top, (list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1)::INT AS cls, p2 + p3 > 0.60::DOUBLE AS sb, p0 > 0.40::DOUBLE AS ss FROM p),
w0 AS (SELECT *, CASE WHEN cls IN (2, 3) AND ((p2 + p3) * 2.0::DOUBLE - (1 - (p2 + p3))) / 2.0::DOUBLE > 0 THEN least(((p2 + p3) * 2.0::DOUBLE - (1 - (p2 + p3))) / 2.0::DOUBLE * 0.5::DOUBLE, 0.1::DOUBLE) ELSE 0 END AS raw FROM s),
w AS (SELECT *, raw * CASE WHEN sum(raw) OVER (PARTITION BY date) > 1 THEN 1 / sum(raw) OVER (PARTITION BY date) ELSE 1 END AS weight FROM w0)"""


def _signals(spark, sf_dir) -> DataFrame:
    return G.signal_columns(G.blend(_probabilities(spark, sf_dir)))


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    both = _signals(spark, sf_dir)
    return both.drop("actual_return"), both.select("ticker", "date", "actual_return")


@register("ensemble_blend", f"{SIGNALS} SELECT ticker, date, {', '.join(f'{r6(f'p{k}')} AS prob_class_{k}' for k in range(4))} FROM p")
def ensemble_blend(spark, sf_dir):
    return G.blend(_probabilities(spark, sf_dir)).select("ticker", "date", *[F.round(f"prob_class_{k}", 6).alias(f"prob_class_{k}") for k in range(4)])


# expected returns often end in a five at the seventh decimal, so they are given to ten
@register("signal_columns", f"{SIGNALS} SELECT ticker, date, round(er, 10) AS expected_return, cls AS predicted_class, {r6('top')} AS conviction, sb AS strong_buy, ss AS strong_sell FROM s")
def signal_columns(spark, sf_dir):
    return _signals(spark, sf_dir).select("ticker", "date", F.round("expected_return", 10).alias("expected_return"), "predicted_class", F.round("conviction", 6).alias("conviction"), "strong_buy", "strong_sell")


@register(
    "signal_summary",
    f"""{SIGNALS} SELECT count(*) AS n_signals, count(*) FILTER (WHERE sb) AS n_strong_buy, count(*) FILTER (WHERE ss) AS n_strong_sell, {r6('avg(sb::INT)')} AS pct_strong_buy,
{r6('avg(ss::INT)')} AS pct_strong_sell, {r6('avg(er)')} AS mean_expected_return, {r6('avg(top)')} AS mean_conviction, {', '.join(f'count(*) FILTER (WHERE cls = {k}) AS n_class_{k}' for k in range(4))} FROM s""",
)
def signal_summary(spark, sf_dir):
    found = G.summary(_signals(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@register("top_signals", f"{SIGNALS} SELECT ticker, date, {r6('er')} AS expected_return FROM s WHERE sb ORDER BY er DESC, ticker, date LIMIT 15")
def top_signals(spark, sf_dir):
    return G.top_signals(_signals(spark, sf_dir), 15).select("ticker", "date", F.round("expected_return", 6).alias("expected_return"))


@register("kelly_weights", f"{SIGNALS} SELECT ticker, date, {r6('weight')} AS weight FROM w")
def kelly_weights(spark, sf_dir):
    return G.position_weights(_signals(spark, sf_dir)).select("ticker", "date", F.round("weight", 6).alias("weight"))


TURNOVER = f"""{SIGNALS}, d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM w)),
moves AS (SELECT d.date, ticker, weight AS now, 0::DOUBLE AS old FROM d JOIN w USING (date) UNION ALL SELECT d.date, ticker, 0, weight FROM d JOIN w ON w.date = d.before),
net AS (SELECT date, ticker, abs(sum(now) - sum(old)) AS moved FROM moves GROUP BY ALL), tn AS (SELECT date, sum(moved) AS turnover FROM net GROUP BY date)"""


@register("turnover", f"{TURNOVER} SELECT date, {r6('turnover')} AS turnover FROM tn")
def turnover(spark, sf_dir):
    return G.turnover(G.position_weights(_signals(spark, sf_dir))).select("date", F.round("turnover", 6).alias("turnover"))


EQUITY = f"""{TURNOVER}, g AS (SELECT date, sum(weight * actual_return) AS pr FROM w GROUP BY date),
e AS (SELECT date, pr, turnover, 1 + pr - turnover * 0.001::DOUBLE AS factor FROM g JOIN tn USING (date)),
curve AS (SELECT *, 100000 * exp(sum(ln(factor)) OVER (ORDER BY date)) AS equity FROM e)"""


@register("equity_curve", f"{EQUITY} SELECT date, {r6('pr')} AS period_return, round(equity, 4) AS equity FROM curve")
def equity_curve(spark, sf_dir):
    return G.equity_curve(*_split(spark, sf_dir)).select("date", F.round("period_return", 6).alias("period_return"), F.round("equity", 4).alias("equity"))


@register("drawdown", f"{EQUITY} SELECT date, {r6('equity / max(equity) OVER (ORDER BY date) - 1')} AS drawdown FROM curve")
def drawdown(spark, sf_dir):
    return G.drawdown(G.equity_curve(*_split(spark, sf_dir))).select("date", F.round("drawdown", 6).alias("drawdown"))


@register(
    "backtest_metrics",
    f"""{EQUITY}, c AS (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM curve),
o AS (SELECT arg_max(equity, date) / arg_min(equity, date) - 1 AS tr, max(date) - min(date) AS days, avg(r) AS m, stddev_samp(r) AS sd, min(dd) AS dd, count(*) AS n FROM c),
t AS (SELECT avg((weight * actual_return > 0)::INT) AS wr, count(*) AS nt FROM w WHERE weight > 0)
SELECT {r6('tr')} AS total_return, {r6('CASE WHEN days > 0 THEN pow(1 + tr, 365.0::DOUBLE / days) - 1 ELSE 0 END')} AS annualized_return,
{r6('coalesce(CASE WHEN sd > 0 THEN m / sd * sqrt(252) END, 0)')} AS sharpe_ratio, {r6('dd')} AS max_drawdown, n AS n_periods, {r6('coalesce(wr, 0)')} AS win_rate, nt AS n_trades FROM o, t""",
)
def backtest_metrics(spark, sf_dir):
    signals, actual = _split(spark, sf_dir)
    found = G.metrics(G.equity_curve(signals, actual), G.trades(signals, actual))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@register(
    "benchmark_compare",
    f"""{EQUITY}, {BENCH}, br AS (SELECT date, least(0.1::DOUBLE, greatest(-0.1::DOUBLE, close / lag(close) OVER (ORDER BY date) - 1)) AS r FROM bench),
lv AS (SELECT date, 100 * exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS level FROM br),
j AS (SELECT c.date, c.equity, last_value(level IGNORE NULLS) OVER (ORDER BY c.date) AS level FROM curve c LEFT JOIN lv USING (date))
SELECT date, {r6('equity / first_value(equity) OVER (ORDER BY date) * 100')} AS portfolio, {r6('level / first_value(level) OVER (ORDER BY date) * 100')} AS benchmark FROM j WHERE level IS NOT NULL""",
)
def benchmark_compare(spark, sf_dir):
    market = M.benchmark(spark, sf_dir).select("date", F.least(F.lit(0.1), F.greatest(F.lit(-0.1), change("close", by([]), 1))).alias("benchmark_return"))
    market = market.withColumn("benchmark_return", F.when(F.row_number().over(by([])) > 1, F.col("benchmark_return")))
    found = G.against_benchmark(G.equity_curve(*_split(spark, sf_dir)), market)
    return found.select("date", F.round("portfolio", 6).alias("portfolio"), F.round("benchmark", 6).alias("benchmark"))


# --- quality and exploration -----------------------------------------------------------------


@register("qa_rsi", f"WITH {BARS} SELECT stock_id, date, 'rsi_range' AS \"check\" FROM bars WHERE volume < 0 OR volume > 100")
def qa_rsi(spark, sf_dir):
    return Q.rsi_out_of_range(M.bars(spark, sf_dir), "volume")


@register("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def duplicates(spark, sf_dir):
    return Q.duplicate_keys(M.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "null_explosion",
    f"WITH {BARS}, x AS (SELECT stock_id, date, {changed('close', 9)} AS a, {changed('close', 29)} AS b, {changed('close', 89)} AS c FROM bars) SELECT stock_id, date, 'null_explosion' AS \"check\" FROM x WHERE a IS NULL AND b IS NULL AND c IS NULL",
)
def null_explosion(spark, sf_dir):
    ws = by("stock_id")
    rows = M.bars(spark, sf_dir).select("stock_id", "date", change("close", ws, 9).alias("a"), change("close", ws, 29).alias("b"), change("close", ws, 89).alias("c"))
    return Q.null_explosion(rows, ["a", "b", "c"])


STALE_AT = "2001-12-01"


@register(
    "stale",
    f"WITH {BARS}, {STOCKS}, x AS (SELECT stock_id, max(date) AS last_date FROM bars GROUP BY 1) SELECT stock_id, ticker, last_date FROM stocks LEFT JOIN x USING (stock_id) WHERE last_date IS NULL OR DATE '{STALE_AT}' - last_date > 3",
)
def stale(spark, sf_dir):
    return Q.stale(M.stocks(spark, sf_dir), M.bars(spark, sf_dir), STALE_AT)


@register(
    "row_coverage",
    f"""WITH {BARS}, {STOCKS}, {EVENTS}, a AS (SELECT stock_id, count(*) AS n FROM bars GROUP BY 1), b AS (SELECT stock_id, count(*) AS n FROM ev GROUP BY 1)
SELECT stock_id, ticker, coalesce(a.n, 0) AS prices, coalesce(b.n, 0) AS events FROM stocks LEFT JOIN a USING (stock_id) LEFT JOIN b USING (stock_id)""",
)
def row_coverage(spark, sf_dir):
    return Q.row_coverage(M.stocks(spark, sf_dir), {"prices": M.bars(spark, sf_dir), "events": M.activity(spark, sf_dir)})


@register(
    "corr_matrix",
    f"""WITH {BARS}, r AS (SELECT stock_id, date, {changed('close', 1)} AS r FROM bars), v AS (FROM r WHERE r IS NOT NULL)
SELECT x.stock_id AS a, y.stock_id AS b, {r6('corr(x.r, y.r)')} AS correlation FROM v x JOIN v y ON x.date = y.date AND x.stock_id <= y.stock_id GROUP BY ALL""",
)
def corr_matrix(spark, sf_dir):
    returns = M.bars(spark, sf_dir).select("stock_id", "date", change("close", by("stock_id"), 1).alias("r")).filter("r is not null")
    return Q.correlation_pairs(returns, "stock_id", "r").select("a", "b", F.round("correlation", 6).alias("correlation"))


@register(
    "rolling_corr",
    f"""WITH {BARS}, r AS (SELECT stock_id, date, {changed('close', 1)} AS r, volume FROM bars),
c AS (SELECT stock_id, date, CASE WHEN count(r) {over(90)} = 90 THEN corr(r, volume) {over(90)} END AS c FROM r) SELECT stock_id, date, {r6('c')} AS correlation FROM c""",
)
def rolling_corr(spark, sf_dir):
    rows = M.bars(spark, sf_dir).select("stock_id", "date", change("close", by("stock_id"), 1).alias("r"), "volume")
    return Q.rolling_correlation(rows, "stock_id", "r", "volume").withColumn("correlation", F.round("correlation", 6))


@register("index_100", f"WITH {BARS} SELECT stock_id, date, {r6('close / first_value(close) OVER (PARTITION BY stock_id ORDER BY date) * 100')} AS indexed FROM bars")
def index_100(spark, sf_dir):
    return Q.index_to_100(M.bars(spark, sf_dir)).withColumn("indexed", F.round("indexed", 6))


@register(
    "skew_kurt",
    f"""WITH {BARS}, r AS (SELECT stock_id, ln(close / nullif({lagged('close', 1)}, 0)) AS r FROM bars)
SELECT stock_id, count(r) AS n, {r6('avg(r)')} AS mean, {r6('stddev_samp(r)')} AS std, {r6('skewness(r)')} AS skew, {r6('kurtosis(r)')} AS kurt FROM r GROUP BY stock_id""",
)
def skew_kurt(spark, sf_dir):
    before = F.lag("close").over(by("stock_id"))
    rows = M.bars(spark, sf_dir).select("stock_id", F.ln(div("close", before)).alias("r"))
    found = Q.shape(rows, "stock_id", "r")
    return found.select("stock_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skew", "kurt")])


_LOG_RETURNS = f"r AS (SELECT stock_id, x FROM (SELECT stock_id, ln(close / nullif({lagged('close', 1)}, 0)) AS x FROM bars) WHERE x IS NOT NULL)"


def _log_returns(spark, sf_dir) -> DataFrame:
    return M.bars(spark, sf_dir).select("stock_id", F.ln(div("close", F.lag("close").over(by("stock_id")))).alias("x")).filter("x is not null")


@register(
    "return_histogram",
    f"""WITH {BARS}, {_LOG_RETURNS},
e AS (SELECT stock_id, min(x) AS least, max(x) AS most, avg(x) AS mean, stddev_samp(x) AS std, count(*) AS n_all, (max(x) - min(x)) / 100 AS width FROM r GROUP BY 1),
b AS (SELECT stock_id, least(99, greatest(0, coalesce(floor((x - least) / nullif(most - least, 0) * 100), 0)))::INT AS bin, least, mean, std, n_all, width, count(*) AS n FROM r JOIN e USING (stock_id) GROUP BY ALL),
c AS (SELECT *, least + bin * width AS low, least + (bin + 1) * width AS high FROM b), d AS (SELECT *, ((low + high) / 2 - mean) / nullif(std, 0) AS z FROM c)
SELECT stock_id, bin, {r6('low')} AS low, {r6('high')} AS high, n, {r6('n / nullif(n_all * width, 0)')} AS density, {r6('exp(-z * z / 2) / (std * sqrt(2 * pi()))')} AS normal FROM d""",
)
def return_histogram(spark, sf_dir):
    found = Q.histogram(_log_returns(spark, sf_dir), "stock_id", "x")
    return found.select("stock_id", "bin", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "density", "normal")])


def _polynomial(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _tail(q: str) -> str:
    x = f"sqrt(-2 * ln({q}))"
    return f"{_polynomial(Q._C, x)} / {_polynomial(Q._D, x)}"


@register(
    "quantile_plot",
    f"""WITH {BARS}, {_LOG_RETURNS}, k AS (SELECT stock_id, x, row_number() OVER (PARTITION BY stock_id ORDER BY x)::INT AS rank, count(*) OVER (PARTITION BY stock_id) AS n FROM r),
p AS (SELECT *, CASE WHEN rank = n THEN pow(0.5::DOUBLE, 1 / n) WHEN rank = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n) ELSE (rank - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM k),
h AS (SELECT *, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS m FROM p),
t AS (SELECT stock_id, rank, x, CASE WHEN p < {Q._TAIL} THEN {_tail('p')} WHEN p > 1 - {Q._TAIL}::DOUBLE THEN -{_tail('(1 - p)')} ELSE {_polynomial(Q._A, 'm')} * (p - 0.5::DOUBLE) / {_polynomial(Q._B, 'm')} END AS z FROM h),
l AS (SELECT stock_id, regr_slope(x, z) AS slope, regr_intercept(x, z) AS icept FROM t GROUP BY 1)
SELECT stock_id, rank, {r6('z')} AS theoretical, {r6('x')} AS sample, {r6('slope * z + icept')} AS fitted FROM t JOIN l USING (stock_id)""",
)
def quantile_plot(spark, sf_dir):
    found = Q.quantile_plot(_log_returns(spark, sf_dir), "stock_id", "x")
    return found.select("stock_id", "rank", *[F.round(c, 6).alias(c) for c in ("theoretical", "sample", "fitted")])


@register(
    "rolling_volatility",
    f"""WITH {BARS}, r AS (SELECT stock_id, date, ln(close / nullif({lagged('close', 1)}, 0)) AS r FROM bars), v AS (SELECT stock_id, date, {full('stddev_samp', 'r', 20)} * sqrt(252) AS v FROM r)
SELECT stock_id, date, {r6('v')} AS volatility FROM v""",
)
def rolling_volatility(spark, sf_dir):
    return Q.rolling_volatility(M.bars(spark, sf_dir)).withColumn("volatility", F.round("volatility", 6))


@register(
    "filings_summary",
    f"""WITH {STOCKS}, {EVENTS} SELECT ticker, kind, count(*) AS n, count(*) FILTER (WHERE kind = 'error' AND amount > 90) AS negative FROM ev JOIN stocks USING (stock_id) GROUP BY ALL""",
)
def filings_summary(spark, sf_dir):
    bad = F.coalesce(((F.col("kind") == "error") & (F.col("amount") > 90)).cast("long"), F.lit(0))
    rows = M.activity(spark, sf_dir).join(F.broadcast(M.stocks(spark, sf_dir)), "stock_id")
    return rows.groupBy("ticker", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("negative"))


@register("model_accuracy", f"{SIGNALS}, a AS (SELECT (cls = CASE WHEN actual_return <= -0.05::DOUBLE THEN 0 WHEN actual_return <= 0.05::DOUBLE THEN 1 WHEN actual_return <= 0.15::DOUBLE THEN 2 ELSE 3 END)::INT AS hit FROM s) SELECT count(*) AS n, {r6('avg(hit)')} AS accuracy FROM a")
def model_accuracy(spark, sf_dir):
    rows = _signals(spark, sf_dir).select((F.col("predicted_class") == L.bucket(F.col("actual_return"))).cast("double").alias("hit"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"))
