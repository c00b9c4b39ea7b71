"""Fundamental, preprocessing, signal and backtest rules on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.functions.safe import safe_div
from quantspark.operators import fundamental as U
from quantspark.operators import models, quality
from quantspark.operators import preprocess as P
from quantspark.operators import sentiment as S
from quantspark.operators import signals as G


def test_safe_division(spark):
    nan = float("nan")
    cases = [(10.0, 2.0), (10.0, 0.0), (None, 5.0), (5.0, None), (5.0, nan), (-10.0, 2.0), (-10.0, -2.0)]
    df = spark.createDataFrame(cases, "n double, d double")
    assert [r.q for r in df.select(safe_div("n", "d").alias("q")).collect()] == [5.0, None, None, None, None, -5.0, 5.0]
    assert df.limit(1).select(safe_div(F.lit(1.0), F.lit(0.0), 0).alias("q")).first().q == 0.0


def test_statements_by_position_and_date(spark):
    ends = [dt.date(2024, 9, 30), dt.date(2024, 6, 30), dt.date(2024, 3, 31), dt.date(2023, 12, 31)]
    rows = [(1, m, e, v) for m, vs in {"revenue": (100, 90, 85, 80), "net_income": (25, 22, 20, 18)}.items() for e, v in zip(ends, map(float, vs))]
    statements = spark.createDataFrame(rows, "stock_id long, metric string, period_end date, value double")
    dates = spark.createDataFrame([(dt.date(2024, 9, 30),), (dt.date(2024, 6, 30),), (dt.date(2020, 1, 1),)], "as_of date")
    got = {r.as_of: r for r in U.statement_matrix(statements, dates, ["revenue", "net_income", "equity"]).collect()}
    assert got[dt.date(2024, 9, 30)].revenue_0 == 100 and got[dt.date(2024, 9, 30)].revenue_4 is None
    assert got[dt.date(2024, 6, 30)].revenue_0 == 90 and got[dt.date(2024, 6, 30)].equity_0 is None
    assert dt.date(2020, 1, 1) not in got


def test_winsor_bounds_and_unseen(spark):
    rng = np.random.default_rng(42)
    xs = rng.normal(50, 10, 200).tolist() + [9999.0, -9999.0]
    df = spark.createDataFrame([(float(x), "Technology") for x in xs], "rsi_14 double, sector string")
    fitted = P.FeatureScaler.fit(df, ["rsi_14"], "sector", 0.01)
    p = fitted.parameters.first()
    assert p.lo == pytest.approx(np.quantile(xs, 0.01)) and p.hi == pytest.approx(np.quantile(xs, 0.99))
    out = fitted.transform(spark.createDataFrame([(9999.0, 100.0, "Other")], "rsi_14 double, unknown double, sector string")).first()
    assert out.unknown == 100.0 and out.rsi_14 == pytest.approx((p.hi - p.mean) / p.std)
    z = fitted.transform(df).agg(F.avg("rsi_14").alias("m"), F.stddev_samp("rsi_14").alias("s")).first()
    assert abs(z.m) < 0.05 and abs(z.s - 1) < 0.1


def test_sector_scaling_nulls_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(float(x), "Technology") for x in rng.normal(30, 3, 150)] + [(float(x), "Financials") for x in rng.normal(10, 2, 150)] + [(None, "Financials")]
    df = spark.createDataFrame(rows, "pe_ratio double, sector string")
    fitted = P.FeatureScaler.fit(df.na.drop(), ["pe_ratio"], "sector")
    means = {r.sector: r["mean"] for r in fitted.parameters.collect()}
    assert means["Technology"] == pytest.approx(30, abs=2) and means["Financials"] == pytest.approx(10, abs=2)
    assert fitted.transform(df).filter("pe_ratio is null").count() == 0
    fitted.save(str(tmp_path / "scaler"))
    again = P.FeatureScaler.load(spark, str(tmp_path / "scaler"))
    assert again.features == ["pe_ratio"] and again.sector_col == "sector"
    assert sorted(map(tuple, again.transform(df).collect()), key=str) == sorted(map(tuple, fitted.transform(df).collect()), key=str)


def test_coverage_orders_by_share(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, 3.0, None)], "a double, b double, c double")
    got = P.coverage(df, ["a", "b", "c"]).collect()
    assert [(r.feature, r.non_null_pct, r.nulls) for r in got] == [("c", 0.0, 2), ("b", 50.0, 1), ("a", 100.0, 0)]


def test_kelly_and_ties(spark):
    df = spark.createDataFrame([(0.6,), (0.4,), (1 / 3,)], "p double").select(G.kelly(F.col("p")).alias("k"))
    a, b, c = [r.k for r in df.collect()]
    assert a > b > 0 and abs(c) < 1e-12 and G.kelly(F.lit(0.5), 0.1, 0.0) is not None
    tie = spark.createDataFrame([("x", dt.date(2020, 1, 1), 0.3, 0.3, 0.2, 0.2)], "ticker string, date date, prob_class_0 double, prob_class_1 double, prob_class_2 double, prob_class_3 double")
    assert G.signal_columns(tie).first().predicted_class == 0


def signals(spark, rows):
    schema = "ticker string, date date, prob_class_0 double, prob_class_1 double, prob_class_2 double, prob_class_3 double"
    return G.signal_columns(spark.createDataFrame(rows, schema))


def test_backtest_against_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(7 * i) for i in range(12)]
    rows, actual = [], []
    for d in days:
        for t in "ABCDEFGHIJKLMNOPQRSTUVWX":
            if rng.random() < 0.8:
                p = rng.dirichlet([1, 1, 2, 2])
                rows.append((t, d, *map(float, p)))
                actual.append((t, d, float(rng.normal(0.01, 0.1))))
    s = signals(spark, rows)
    a = spark.createDataFrame(actual, "ticker string, date date, actual_return double")
    got = [r.equity for r in G.equity_curve(s, a).orderBy("date").collect()]
    lookup, held, equity, want = {(t, d): r for t, d, r in actual}, {}, 100_000.0, []
    by_day = {d: [r for r in rows if r[1] == d] for d in days}
    for d in days:
        weights = {}
        for t, _, *p in by_day[d]:
            win = p[2] + p[3]
            f = (win * 2 - (1 - win)) / 2
            if int(np.argmax(p)) in (2, 3) and f > 0:
                weights[t] = min(f * 0.5, 0.10)
        total = sum(weights.values())
        if total > 1:
            weights = {t: w / total for t, w in weights.items()}
        moved = sum(abs(weights.get(t, 0) - held.get(t, 0)) for t in set(weights) | set(held))
        equity *= 1 + sum(w * lookup[(t, d)] for t, w in weights.items()) - moved * 0.001
        want.append(equity)
        held = weights
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_drawdown_and_blend_rules(spark):
    rows = [(dt.date(2020, 1, i + 1), float(e)) for i, e in enumerate((100, 80, 90, 70))]
    worst = G.drawdown(spark.createDataFrame(rows, "date date, equity double")).agg(F.min("drawdown").alias("d")).first().d
    assert worst == pytest.approx(-0.30)
    with pytest.raises(ValueError):
        G.blend(spark.range(1), weights=(0.5, 0.4))
    schema = ", ".join(f"{m}_prob_{k} double" for m in ("xgb", "lstm") for k in range(4))
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, None, None, None, None)], schema)
    assert G.blend(df).first().prob_class_3 == pytest.approx(0.4)


def test_sentiment_windows_end_at_the_as_of_date(spark):
    d = lambda n: dt.date(2024, 1, n)
    spine = spark.createDataFrame([(1, d(20)), (2, d(20))], "stock_id long, as_of date")
    events = spark.createDataFrame([(1, d(20), "P", 10.0), (1, d(21), "P", 10.0), (1, d(1), "S", 5.0)], "stock_id long, day date, code string, amount double")
    got = {r.stock_id: r for r in S.insiders(spine, events).collect()}
    assert (got[1].insider_buy_count_30d, got[1].insider_sell_count_30d, got[1].insider_net_sentiment, got[1].insider_dollar_volume) == (1, 1, 0.0, 10.0)
    assert (got[2].insider_buy_count_30d, got[2].insider_dollar_volume) == (0, 0.0)
    undated = spark.createDataFrame([(1, None, -0.9), (1, d(1), 0.5)], "stock_id long, day date, sentiment double")
    n = {r.stock_id: r for r in S.news(spine, undated).collect()}[1]
    assert (n.news_volume_7d, n.negative_news_flag, n.news_sentiment_avg_7d) == (1, 1, -0.9)


def test_quality_checks(spark):
    d = dt.date(2024, 1, 5)
    df = spark.createDataFrame([(1, d, 101.0, None), (1, d, 50.0, 1.0), (2, d, None, None)], "stock_id long, date date, rsi_14 double, x double")
    found = sorted((r.stock_id, r.check) for r in quality.warnings(df, ["rsi_14", "x"]).collect())
    assert found == [(1, "duplicate_key"), (1, "rsi_range"), (2, "null_explosion")]


def test_models_give_four_probabilities(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(y), int(2 * (x > 0) + (y > 0))) for x, y in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = models.fit_forest(df, ["a", "b"], trees=10)
    scored = models.probabilities(model, df, "xgb")
    total = scored.select(sum(F.col(f"xgb_prob_{k}") for k in range(4)).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1) and len(models.importances(model)) == 2
    seq = df.withColumn("sequence", F.array(F.array(F.col("a").cast("float"), F.col("b").cast("float"))))
    net = models.fit_sequences(seq, 2, hidden=(8,), rounds=30)
    p = models.probabilities(net, models.flatten_sequences(seq), "lstm")
    predicted = G.signal_columns(p.select("label", *[F.col(f"lstm_prob_{k}").alias(f"prob_class_{k}") for k in range(4)]))
    assert models.accuracy(predicted) > 0.6


def test_wide_datasets_carry_every_feature(spark, smallest):
    from quantspark.operators import dataset as D
    from quantspark.plans import registry

    q = registry.queries()
    names = [*D.TECHNICAL, *D.SENTIMENT, *D.MACRO, *D.FUNDAMENTAL]
    wide, narrow = q["training_set_wide"](spark, smallest), q["training_set"](spark, smallest)
    assert len(names) == 94 and wide.columns == ["stock_id", "date", "label", "ticker", *names]
    assert q["lstm_frame_wide"](spark, smallest).columns == ["stock_id", "date", *D.SEQUENCE]
    same = ["stock_id", "date", "label"]
    shared = ["momentum_30d", "bollinger_pct_b", "vix_level", "gross_margin"]
    got = {tuple(r[:3]): r[3:] for r in wide.select(*same, *shared).collect()}
    want = {tuple(r[:3]): r[3:] for r in narrow.select(*same, *shared).collect()}
    assert got.keys() == want.keys()
    for k, row in want.items():
        for a, b in zip(got[k][:3], row[:3]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-5))


def test_trading_day_offset(spark):
    from quantspark.operators import labels as L

    day = spark.range(1).select(F.lit(dt.date(2024, 1, 31)).alias("d"))
    got = day.select(L.trading_days_later("d", 63).alias("a"), L.trading_days_later("d", -5).alias("b"), L.trading_days_later("d", 0).alias("c")).first()
    assert tuple(got) == (dt.date(2024, 5, 4), dt.date(2024, 1, 24), dt.date(2024, 1, 31))


def test_folds_are_scaled_by_their_own_purged_rows(spark):
    from quantspark.operators import labels as L

    rng = np.random.default_rng(11)
    day = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=n)
    rows = [(i, day(n), day(n + 90) if n < 1900 else None, float(rng.lognormal()) * (1 + n / 500), float(rng.normal()) if rng.random() < 0.7 else None, None) for n in range(0, 2000, 3) for i in (1, 2)]
    df = spark.createDataFrame(rows, "stock_id long, date date, label_end date, a double, b double, c double")
    folds = L.walk_forward(df.select("date"), train=24, gap=1, validate=3, step=9)
    training = L.purged_training(df, folds)
    of = {f.fold: f for f in folds.collect()}
    kept = {k: [r for r in rows if f.train_start <= r[1] < f.train_end and r[2] is not None and r[2] < f.val_start] for k, f in of.items()}
    assert len(of) > 3 and all(r.label_end < of[r.fold].val_start for r in training.collect())
    for accuracy in (10_000, 100):
        got = {(r.fold, r.feature): r.quantiles for r in P.grouped_quantiles(training, "fold", ["a", "b", "c"], (0.01, 0.4, 0.99), accuracy).collect()}
        for k, mine in kept.items():
            for at, c in ((3, "a"), (4, "b")):
                assert got[k, c] == pytest.approx(np.quantile([r[at] for r in mine if r[at] is not None], (0.01, 0.4, 0.99)))
            assert got[k, "c"] is None or got[k, "c"] == [None] * 3
    scaler = P.FoldScaler.fit(training, ["a", "b", "c"])
    scaled = scaler.transform(training).filter("fold = 1").collect()
    x = np.array([r[3] for r in kept[1]])
    x = np.clip(x, *np.quantile(x, (0.01, 0.99)))
    assert sorted(r.a for r in scaled) == pytest.approx(sorted((x - x.mean()) / x.std(ddof=1))) and {r.c for r in scaled} == {0.0}
    assert {r.n for r in scaler.parameters.filter("fold = 1").collect()} == {len(kept[1])}


def test_scaler_parameters_are_local_and_survive_saving(spark, tmp_path):
    rows = [(float(i), float(i % 7) if i % 5 else None, "xy"[i % 2], None) for i in range(200)]
    df = spark.createDataFrame(rows, "rsi_14 double, pe_ratio double, sector string, atr_14 double")
    scaler = P.FeatureScaler.fit(df, ["rsi_14", "pe_ratio", "atr_14"], "sector")
    scaled = scaler.transform(df)
    scaler.save(str(tmp_path / "scaler"))
    assert sorted(map(str, P.FeatureScaler.load(spark, str(tmp_path / "scaler")).transform(df).collect())) == sorted(map(str, scaled.collect()))
    pe = np.array([r[1] if r[1] is not None else 0.0 for r in rows])
    x = [r.pe_ratio for r in scaled.filter("sector = 'x'").collect()]
    assert sorted(x) == pytest.approx(sorted((pe[::2] - pe[::2].mean()) / pe[::2].std(ddof=1)))
    assert {r.atr_14 for r in scaled.collect()} == {0.0}
    assert "Exchange" not in scaled.select("rsi_14")._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_in_brackets_equal_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.lognormal(size=30_000), np.where(rng.random(30_000) < 0.4, 7.0, rng.normal(size=30_000))
    df = spark.createDataFrame([(float(x), float(y) if i % 9 else None, None, float(i % 3)) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double, d double")
    got = {r.feature: r.quantiles for r in P.exact_quantiles(df, ["a", "b", "c", "d"], (0.01, 0.5, 0.99), accuracy=1000).collect()}
    kept = np.array([y for i, y in enumerate(b) if i % 9])
    for name, values in (("a", a), ("b", kept), ("d", np.arange(30_000) % 3)):
        assert got[name] == pytest.approx(np.quantile(values, (0.01, 0.5, 0.99)), rel=1e-12), name
    assert got["c"] == [None, None, None]
    few = {r.feature: r.quantiles for r in P.exact_quantiles(df.limit(7), ["a"], (0.0, 0.3, 1.0)).collect()}["a"]
    assert few == pytest.approx(np.quantile(a[:7], (0.0, 0.3, 1.0)))
