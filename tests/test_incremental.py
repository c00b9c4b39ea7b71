"""Features from a carried state against features of the whole history."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.operators import incremental as N
from quantspark.operators import technical as T
from quantspark.sources.scratch import written


@pytest.fixture(scope="module")
def bars(spark):
    """Four stocks of 330 days: one begins late, one has holes and ends early, one has flat stretches."""
    rng = np.random.default_rng(9)
    rows = []
    for stock in range(4):
        close = 100.0
        for day in range(330):
            if (stock == 1 and day < 290) or (stock == 2 and (day % 7 == 0 or day > 280)):
                continue
            close *= float(np.exp(0.02 * rng.normal())) if stock != 3 or day % 20 < 15 else 1.0
            wide = abs(float(rng.normal())) if stock != 3 or day % 20 < 15 else 0.0
            rows.append((stock, stock % 2, dt.date(2020, 1, 1) + dt.timedelta(days=day), close + wide, close - wide, close, float(rng.integers(0, 1000))))
    return written(spark.createDataFrame(rows, "stock_id long, sector_id int, date date, high double, low double, close double, volume double"), "bars")[0]


def test_days_by_state_equal_the_whole_history(spark, bars):
    market = bars.groupBy("date").agg(F.avg("close").alias("close"))
    funds = bars.groupBy("sector_id", "date").agg(F.avg("close").alias("close"))
    full = {(r.stock_id, r.date): r for r in T.technical_features(bars, market, funds).collect()}
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    state = written(N.start_state(bars.filter(F.col("date") <= day(275))), "state")[0]
    assert state.count() == 3 and state.selectExpr("max(size(bars))").first()[0] == N.REACH
    seen = 0
    for first, last in ((276, 276), (277, 312), (313, 329)):
        new = bars.filter(F.col("date").between(F.lit(day(first)), F.lit(day(last))))
        again = bars.filter(F.col("date") == F.lit(day(270)))  # older than the state: passed over
        features, after = N.advance(state, new.unionByName(again), market.filter(F.col("date") <= F.lit(day(last))), funds)
        got = features.collect()
        want = {k for k in full if day(first) <= k[1] <= day(last)}
        assert {(r.stock_id, r.date) for r in got} == want and len(got) == len(want)
        for r in got:
            for c in T.FEATURES:
                expected = full[r.stock_id, r.date][c]
                assert (r[c] is None and expected is None) or r[c] == pytest.approx(expected, rel=1e-6, abs=1e-7), (c, r.stock_id, r.date)
        seen += len(got)
        state = written(after, "state")[0]
    assert seen > 130
    rows = {r.stock_id: (r["rows"], r.last_date) for r in state.collect()}
    assert rows == {r.stock_id: (r.n, r.last) for r in bars.groupBy("stock_id").agg(F.count("date").alias("n"), F.max("date").alias("last")).collect()}


def test_nothing_new_keeps_the_state(spark, bars):
    market = bars.groupBy("date").agg(F.avg("close").alias("close"))
    funds = bars.groupBy("sector_id", "date").agg(F.avg("close").alias("close"))
    state = written(N.start_state(bars.filter("stock_id in (2, 3)")), "state")[0]
    features, after = N.advance(state, bars.limit(0), market, funds)
    assert features.collect() == []
    for a, b in zip(state.orderBy("stock_id").collect(), after.orderBy("stock_id").collect()):
        assert a.bars == b.bars and a["rows"] == b["rows"]
        assert all(a[c] == pytest.approx(b[c], rel=1e-9) for c in N.CARRIED)
