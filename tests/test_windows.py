"""Time-series building blocks against pandas on small series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.functions import windows as X
from quantspark.operators import labels as L
from quantspark.operators import technical as T


def frame(spark, series: dict[int, list[float]]):
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(i), float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "stock_id long, date date, close double")


@pytest.mark.parametrize("alpha", [0.04, 1 / 7, 0.2, 0.3])
def test_ewma_equals_pandas_beyond_several_blocks(spark, alpha, monkeypatch):
    rng = np.random.default_rng(1)
    values = {1: rng.normal(100, 5, 3500), 2: rng.normal(50, 1, 30)}
    out = X.ewma(frame(spark, values), {"e": ("close", alpha)}).orderBy("stock_id", "date").toPandas()
    for s, v in values.items():
        want = pd.Series(v).ewm(alpha=alpha, adjust=False).mean()
        np.testing.assert_allclose(out[out.stock_id == s]["e"], want, rtol=1e-9)


def test_ewma_refuses_slow_factors(spark):
    with pytest.raises(ValueError):
        X.ewma(frame(spark, {1: [1, 2]}), {"e": ("close", 0.01)})


def test_rolling_is_null_until_full(spark):
    df = frame(spark, {1: [1, 2, 3, 4]}).withColumn("m", X.rolling(F.avg, "close", X.by("stock_id"), 3))
    assert [r.m for r in df.orderBy("date").collect()] == [None, None, 2.0, 3.0]


def test_trend_is_slope_over_mean(spark):
    df = frame(spark, {1: [1, 2, 3, 4]}).withColumn("rn", F.row_number().over(X.by("stock_id")))
    got = [r.t for r in df.withColumn("t", X.trend("close", X.by("stock_id"), 3)).orderBy("date").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.5) and got[3] == pytest.approx(1 / 3)


def test_fill_both_ways(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, day + dt.timedelta(i), v) for i, v in enumerate([None, 2.0, None, 5.0])] + [(2, day, None)]
    df = spark.createDataFrame(rows, "stock_id long, date date, close double")
    got = df.withColumn("f", X.fill_both_ways("close", X.by("stock_id"))).orderBy("stock_id", "date").collect()
    assert [r.f for r in got] == [2.0, 2.0, 2.0, 5.0, 0.0]


def test_asof_takes_same_day_and_never_later(spark):
    d = lambda n: dt.date(2020, 1, n)
    left = spark.createDataFrame([(1, d(1)), (1, d(5)), (1, d(9)), (2, d(5))], "k long, date date")
    right = spark.createDataFrame([(1, d(5), 10.0), (1, d(8), 20.0)], "k long, date date, v double")
    got = {(r.k, r.date): (r.v, r.at) for r in X.asof_join(left, right, ["k"], values=["v"], right_date="at").collect()}
    assert got == {(1, d(1)): (None, None), (1, d(5)): (10.0, d(5)), (1, d(9)): (20.0, d(8)), (2, d(5)): (None, None)}


def test_forward_returns_and_classes(spark):
    df = L.forward_returns(frame(spark, {1: [100, 105, 110, 115]}), horizon=2)
    got = [(r.forward_return, r.label) for r in df.orderBy("date").collect()]
    assert got[0] == (pytest.approx(0.10), 2) and got[1] == (pytest.approx(115 / 105 - 1), 2) and got[2:] == [(None, None)] * 2
    edges = spark.createDataFrame([(x,) for x in (-0.2, -0.05, -0.04, 0.05, 0.06, 0.15, 0.16)], "r double")
    assert [r.b for r in edges.select(L.bucket(F.col("r")).alias("b")).collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_folds_are_chained_and_clipped(spark):
    dates = spark.createDataFrame([(dt.date(2015, 1, 31),), (dt.date(2020, 1, 1),)], "date date")
    folds = L.walk_forward(dates).orderBy("fold").collect()
    assert folds[0].train_end == dt.date(2018, 1, 31) and folds[0].val_start == dt.date(2018, 2, 28) and folds[0].val_end == dt.date(2018, 5, 28)
    assert folds[1].train_start == dt.date(2015, 4, 30) and all(f.val_end <= dt.date(2020, 1, 1) for f in folds)


def bars(spark, closes, high=None, low=None, volume=None):
    day = dt.date(2020, 1, 1)
    rows = [(1, 1, day + dt.timedelta(i), float(high[i] if high else c), float(low[i] if low else c), float(c), float(volume[i] if volume else 100)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "stock_id long, sector_id int, date date, high double, low double, close double, volume double")


def last(spark, closes, *names):
    df = T.price_features(bars(spark, closes)).orderBy(F.desc("date")).select(*names).first()
    return df.asDict()


def test_rsi_directions(spark):
    assert last(spark, [100 * 0.99**i for i in range(40)], "rsi_14")["rsi_14"] < 30
    rng = np.random.default_rng(0)
    up = 100 + np.cumsum(np.where(rng.random(40) < 0.9, 1.5, -0.1))
    assert last(spark, up.tolist(), "rsi_14")["rsi_14"] > 60
    flat = last(spark, [100.0] * 30, "rsi_14", "bollinger_pct_b", "stochastic_k", "cci_14", "mfi_14")
    assert set(flat.values()) == {None}


def test_bollinger_up_trend_and_pandas(spark):
    closes = list(range(80, 105))
    got = last(spark, closes, "bollinger_pct_b", "bollinger_upper")
    s = pd.Series(closes, dtype=float)
    mid, sd = s.rolling(20).mean().iloc[-1], s.rolling(20).std().iloc[-1]
    assert got["bollinger_pct_b"] > 0.5 and got["bollinger_upper"] == pytest.approx(mid + 2 * sd)


def test_features_do_not_see_later_rows(spark):
    rng = np.random.default_rng(3)
    closes = (100 + np.cumsum(rng.normal(0, 1, 80))).tolist()
    names = ["sma_50", "ema_20", "rsi_14", "macd_signal", "obv_trend", "cci_14", "momentum_30d", "atr_14"]
    whole = T.price_features(bars(spark, closes)).filter("rn = 60").select(names).first()
    cut = T.price_features(bars(spark, closes[:60])).filter("rn = 60").select(names).first()
    assert whole == cut


def test_zero_volume_and_equal_high_low(spark):
    n = 30
    df = T.price_features(bars(spark, [100.0 + i % 3 for i in range(n)], volume=[0.0] * n))
    row = df.orderBy(F.desc("date")).select("volume_ratio_10d", "obv", "accumulation_distribution", "volume_trend_20d").first()
    assert row.volume_ratio_10d is None and row.obv == 0.0 and row.accumulation_distribution == 0.0 and row.volume_trend_20d is None
