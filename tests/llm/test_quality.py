import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import quality as Q


def plain_ftrl(rows, passes, alpha, beta, l1, l2):
    """FTRL-proximal one coordinate at a time; ``rows`` are ({slot: value}, label)."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(passes):
        for values, label in rows:
            w = {i: weight(i) for i in values}
            miss = 1 / (1 + math.exp(-sum(w[i] * v for i, v in values.items()))) - label
            for i, v in values.items():
                g = miss * v
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return {i: weight(i) for i in z if weight(i)}


def plain_features(text, bits):
    """Slot: value, from words cut into runs of letters or digits and of other marks."""
    tokens = [zlib.crc32(run.encode()) for word in text.split() for run in re.findall(r"[^\W_]+|[\W_]+", word)]
    mix, odd, full = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64 - 1
    keys = tokens + [a * odd + b for a, b in zip(tokens, tokens[1:])]
    keys += [0x51ED270B35A1C9D7 for a, b in zip(tokens, tokens[1:]) if a == b] + [0xA24BAED4963EE407 for a, b in zip(tokens, tokens[2:]) if a == b]
    counts = Counter(((k & full) * mix & full) >> (64 - bits) for k in keys)
    return {i: 10.0 * c / len(keys) for i, c in counts.items()} | {1 << bits: 1.0}


def test_quality_training_and_scores_equal_a_plain_loop(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("the river, stone stone BUY now!! now x_1 über".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "another text of the same id"), (None, "no id")]
    labels = [(i, i % 2) for i in range(0, 62)] + [(4, 1), (5, None), (None, 1), (900, 1)]
    docs = spark.createDataFrame(rows, "k long, body string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    turn = {r.k: r.t for r in docs.selectExpr("k", "xxhash64(k) t").collect()}
    mark = {r.body: r.m for r in docs.selectExpr("body", "xxhash64(coalesce(body, '')) m").collect()}
    best, bits = {}, 12
    for i, q in labels:
        if q is not None and i is not None and i in turn and zlib.crc32(str(i).encode()) % 4 != 2:
            best[i] = min(q, best.get(i, q))
    text = {i: min((t for k, t in rows if k == i), key=mark.get) or "" for i in best}

    def plain(order):
        total, seen = Counter(), 0
        for learner in range(2):
            mine = [(plain_features(text[i], bits), best[i]) for i in order if turn[i] % 2 == learner]
            for i, w in plain_ftrl(mine, 3, 3.0, 1.0, 0.05, 0.0).items():
                total[i] += len(mine) * w
            seen += len(mine)
        return {i: w / seen for i, w in total.items()}

    options = {"learners": 2, "passes": 3, "bits": bits, "id_col": "k", "text_col": "body"}
    order = sorted(best, key=lambda i: (turn[i], i))
    for some, more in ((order, {}), (order[:11], {"max_rows": 11})):
        want = plain(some)
        got = Q.train_quality(docs, marks, **options, **more)
        assert len(got) == 2**bits + 1 and {i: float(got[i]) for i in np.flatnonzero(got)} == pytest.approx(want, abs=1e-5)
    widths = np.cumsum([len(plain_features(text[i], bits)) for i in order])
    got = Q.train_quality(docs, marks, max_features=int(widths[7]), **options)
    assert {i: float(got[i]) for i in np.flatnonzero(got)} == pytest.approx(plain(order[:8]), abs=1e-5)
    want = plain(order)
    for r in Q.classify_quality(docs, marks, **options).join(docs.selectExpr("k as doc_id", "body"), "doc_id").filter("doc_id <> 3").collect():
        value = sum(want.get(i, 0.0) * v for i, v in plain_features(r.body or "", bits).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-value)), abs=1e-5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b"), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([r for r in docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text"))).collect()], "doc_id long, text string")
    assert (Q.train_quality(docs, labels, max_rows=2) == Q.train_quality(once, labels, max_rows=2)).all()
