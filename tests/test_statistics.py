"""Text scores, correlations, histograms and quantile plots against plain versions."""

import datetime as dt
import math
import random
import re
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.operators import quality as Q
from quantspark.operators import textscore as X


def plain_score(text, lexicon=X.LEXICON):
    """The rules, word by word."""
    text = text or ""
    words = [w for w in (re.sub(X.EDGES, "", w) for w in re.split(X.SPACE, text)) if w]
    caps = [bool(re.match(X.CAPS, w)) for w in words]
    mixed = not all(caps)
    lower = [w.lower() for w in words]
    but = lower.index("but") if "but" in lower else None
    total = 0.0
    for i, w in enumerate(lower):
        if w not in lexicon:
            continue
        v = lexicon[w]
        sign = math.copysign(1.0, v)
        worth = v + (sign * X.CAPITALS if mixed and caps[i] else 0)
        for k in (1, 2, 3):
            if i < k:
                continue
            boost = X.BOOSTERS.get(lower[i - k], 0.0)
            if boost:
                worth += (boost * sign + (sign * X.CAPITALS if mixed and caps[i - k] else 0)) * (1.0, 0.95, 0.9)[k - 1]
            if lower[i - k] in X.NEGATIONS:
                worth *= X.NEGATE
        if but is not None:
            worth *= X.BEFORE_BUT if i < but else X.AFTER_BUT if i > but else 1
        total += worth
    asked = text.count("?")
    more = min(4, text.count("!")) * X.EXCLAIM + (X.MOST_QUESTION if asked > 3 else asked * X.QUESTION if asked > 1 else 0)
    total += (total > 0) * more - (total < 0) * more
    return total / math.sqrt(total * total + 15)


def test_text_scores_follow_the_rules(spark):
    rng = random.Random(2)
    words = ["gains", "LOSS", "Great", "not", "very", "VERY", "hardly", "but", "BUT", "bad!", "(weak)", "isn't", "the", "THE", "good??", "é", "—", "profit.", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) + rng.choice(["", "!", "!!!!!!", "?", "??", "?????"]) for _ in range(600)]
    texts += [None, "", "   ", "GREAT GAINS", "not very good", "good but bad", "\tgood\n\nnews", "so-so", "good" * 3, "good " * 5000] + ["good news"] * 50
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, title string, compound string")
    got = {r.id: r.score for r in X.score_texts(df, F.col("title"), "score").collect()}
    assert len(got) == len(texts) and all(got[i] == pytest.approx(plain_score(t)) for i, t in enumerate(texts))
    assert got[texts.index("not very good")] < 0 < got[texts.index("GREAT GAINS")] and got[texts.index("good but bad")] < 0
    own = spark.createDataFrame([("moon", 3.0), ("moon", 1.0)], "word string, valence double").coalesce(1)
    assert abs(X.score_texts(df.limit(1).withColumn("title", F.lit("to the moon")), F.col("title"), "score", own).first().score) > 0.2
    assert X.score_texts(df.limit(0), F.col("title"), "score").collect() == []


def test_lexicon_and_inflections():
    assert X.inflections("rally") == ["rally", "rallies", "rallied", "rallying"] and X.inflections("rise")[3] == "rising" and X.inflections("miss")[1] == "misses"
    assert all(w == w.lower() and v for w, v in X.LEXICON.items()) and not set(X.BOOSTERS) & set(X.NEGATIONS)


def test_correlations_in_blocks_equal_numpy(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=300)
    rows, series = [], {}
    for e in range(9):
        values = {d: float(common[d] * (e % 3) + rng.normal()) for d in range(300) if rng.random() < 0.8}
        series[e] = values
        rows += [(e, dt.date(2020, 1, 1) + dt.timedelta(days=d), v) for d, v in values.items()]
    rows += [(20, dt.date(2020, 1, 1), None), (21, dt.date(2020, 1, 2), 1.0), (21, dt.date(2020, 1, 3), 1.0), (22, dt.date(2031, 1, 1), 5.0)] + rows[:5]
    df = spark.createDataFrame(rows, "stock_id int, date date, r double")
    for options in ({}, {"block_dates": 40, "tile": 2}):
        got = {(r.a, r.b): r.correlation for r in Q.correlation_pairs(df, "stock_id", "r", **options).collect()}
        for a in range(9):
            for b in range(a, 9):
                both = sorted(series[a].keys() & series[b].keys())
                assert got[a, b] == pytest.approx(np.corrcoef([series[a][d] for d in both], [series[b][d] for d in both])[0, 1], abs=1e-9)
        assert got[21, 21] is None and got[22, 22] is None and (20, 20) not in got and (0, 22) not in got and (1, 0) not in got


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(7)
    values = {1: rng.normal(size=500), 2: rng.lognormal(size=40), 3: np.array([4.0, 4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [(4, None), (1, None)], "k int, x double")
    got = Q.histogram(df, "k", "x", 20).collect()
    for k in (1, 2):
        counts, edges = np.histogram(values[k], 20)
        density = np.histogram(values[k], 20, density=True)[0]
        mine = {r.bin: r for r in got if r.k == k}
        assert {b: r.n for b, r in mine.items()} == {b: n for b, n in enumerate(counts) if n}
        for b, r in mine.items():
            assert (r.low, r.high, r.density) == pytest.approx((edges[b], edges[b + 1], density[b]))
            assert r.normal == pytest.approx(NormalDist(values[k].mean(), values[k].std(ddof=1)).pdf((r.low + r.high) / 2))
    assert [(r.k, r.bin, r.n, r.density) for r in got if r.k > 2] == [(3, 0, 2, None)]


def test_quantile_plot(spark):
    shares = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.98, 0.9999999]
    row = spark.range(1).select(*[Q.normal_quantile(F.lit(p)).alias(f"q{i}") for i, p in enumerate([*shares, 0.0, 1.0])]).first()
    assert list(row[:8]) == pytest.approx([NormalDist().inv_cdf(p) for p in shares], abs=1e-7) and row[8] is None and row[9] is None
    values = np.random.default_rng(8).normal(3.0, 2.0, size=101)
    df = spark.createDataFrame([("a", float(x)) for x in values] + [("a", None), ("b", 1.0)], "k string, x double")
    got = sorted(((r.rank, r.theoretical, r.sample, r.fitted) for r in Q.quantile_plot(df, "k", "x").filter("k = 'a'").collect()))
    assert [g[2] for g in got] == sorted(values)
    last = 0.5 ** (1 / 101)
    want = [NormalDist().inv_cdf(p) for p in (1 - last, *[(i - 0.3175) / 101.365 for i in range(2, 101)], last)]
    assert [g[1] for g in got] == pytest.approx(want, abs=1e-7)
    slope, icept = np.polyfit(want, sorted(values), 1)
    assert [g[3] for g in got] == pytest.approx([slope * z + icept for z in want], abs=1e-6)
