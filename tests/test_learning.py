"""Boosted trees and the recurrent network: against plain loops, across layouts, and on held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.operators import boosting as B
from quantspark.operators import models
from quantspark.operators import recurrent as R


@pytest.fixture(scope="module")
def waves(spark):
    """Four classes by two features and their product, a constant and a null-ridden one; a quarter held out."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    score = x[:, 0] + 0.6 * x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=3000)
    label = np.digitize(score, [-0.9, 0.0, 0.9])
    rows = [(*map(float, r), 1.0, float(r[0]) if i % 3 else None, int(k), i % 4 == 0) for i, (r, k) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, gaps double, label int, held_out boolean")


NAMES = ["a", "b", "c", "flat", "gaps"]
QUICK = B.BoostParams(rounds=12, depth=3, step=0.3, patience=4, bins=16)


@pytest.fixture(scope="module")
def fitted(waves):
    return B.fit_boosted_trees(waves, NAMES, held_out="held_out", params=QUICK, refresh=5)


def same(a: B.BoostedTrees, b: B.BoostedTrees) -> bool:
    pairs = [(x, y) for g, h in zip(a.trees, b.trees) for x, y in zip(g, h)]
    return len(a.trees) == len(b.trees) and a.losses == b.losses and all(np.array_equal(getattr(x, k), getattr(y, k)) for x, y in pairs for k in ("feature", "bin", "value", "gain", "rows"))


def test_boosting_goes_on_while_held_out_loss_falls(waves, fitted):
    losses = [held for _, held in fitted.losses]
    assert fitted.best_round > 5 and losses[0] == pytest.approx(np.log(4), abs=1e-5)
    assert min(losses) == losses[fitted.best_round] < 0.85 < losses[1]
    stump = B.fit_boosted_trees(waves, NAMES, held_out="held_out", params=B.BoostParams(rounds=1, depth=1, step=0.3, bins=16))
    held = B.boosted_probabilities(fitted, waves.filter("held_out"), "xgb").withColumn("predicted_class", models.most_likely("xgb"))
    assert models.log_loss(held, "xgb") == pytest.approx(losses[fitted.best_round], abs=1e-5) and losses[fitted.best_round] < stump.losses[1][1] - 0.2
    assert models.accuracy(held) > 0.65 and sum(fitted.probabilities(np.array([[0.0] * 5]))[0]) == pytest.approx(1)


def test_trees_do_not_depend_on_the_layout(waves, fitted):
    assert same(fitted, B.fit_boosted_trees(waves.repartition(7), NAMES, held_out="held_out", params=QUICK, refresh=3))


def test_noise_stops_after_patience_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), int(rng.integers(4)), bool(i % 2)) for i, x in enumerate(rng.normal(size=600))]
    model = B.fit_boosted_trees(spark.createDataFrame(rows, "a double, label int, held_out boolean"), ["a"], held_out="held_out", params=B.BoostParams(rounds=40, depth=3, step=0.5, patience=3, min_hessian=1.0))
    assert len(model.losses) == model.best_round + 4 < 41 and len(model.trees) == model.best_round


def test_first_splits_equal_a_plain_search(spark, waves):
    p = B.BoostParams(rounds=1, depth=2, bins=16, row_share=1.0, column_share=1.0, patience=1)
    model = B.fit_boosted_trees(waves.drop("held_out"), NAMES, params=p)
    rows = waves.na.fill(0.0).collect()
    values, label = np.array([[r[c] for c in NAMES] for r in rows]), np.array([r.label for r in rows])
    bins = model.bins.numbers(values)
    assert model.best_round == 1
    for i, c in enumerate(NAMES):  # about equally many rows in each bin
        counts = np.bincount(bins[:, i])
        assert len(counts) <= 16 and (c in ("flat", "gaps") or counts.max() <= 1.3 * len(rows) / 16)
        assert all((bins[:, i] > b).tolist() == (values[:, i] > model.bins.threshold(i, b)).tolist() for b in range(len(counts) - 1))

    def plain(at, k):
        g = np.where(label[at] == k, -0.75, 0.25)
        h = np.full(len(at), 0.375)
        worth = lambda m: np.sign(g[m].sum()) * max(abs(g[m].sum()) - p.l1, 0)
        part = lambda m: worth(m) ** 2 / (h[m].sum() + p.l2)
        whole, best = np.ones(len(at), bool), (0.0, None, None)
        for f in range(len(NAMES)):
            for b in range(15):
                left = bins[at, f] <= b
                if min(h[left].sum(), h[~left].sum()) >= p.min_hessian and part(left) + part(~left) - part(whole) > best[0] + 1e-9:
                    best = (part(left) + part(~left) - part(whole), f, b)
        return best, -p.step * worth(whole) / (h.sum() + p.l2)

    for k, tree in enumerate(model.trees[0]):
        every = np.arange(len(rows))
        for node, at in ((0, every), (1, every[bins[:, tree.feature[0]] <= tree.bin[0]]), (2, every[bins[:, tree.feature[0]] > tree.bin[0]])):
            (gain, feature, cut), value = plain(at, k)
            assert (tree.feature[node], tree.bin[node], tree.rows[node]) == (feature, cut, len(at))
            assert tree.gain[node] == pytest.approx(gain, abs=1e-3) and tree.value[node] == pytest.approx(value, abs=1e-5)
    sums = {(r["class"], r.feature, r.bin): (r.gradient, r.hessian, r.n) for r in B.root_histogram(waves, NAMES, params=B.BoostParams(row_share=1.0, bins=16)).collect()}
    assert sums[2, "a", 3] == tuple(int(x) for x in (np.where(label == 2, -0.75, 0.25)[bins[:, 0] == 3].sum() * B.UNIT, 0.375 * (bins[:, 0] == 3).sum() * B.UNIT, (bins[:, 0] == 3).sum()))


def test_total_gain_equals_a_walk_of_the_trees(spark, fitted, tmp_path):
    want = {c: [0.0, 0] for c in NAMES}

    def walk(tree, node):
        if tree.feature[node] >= 0:
            mine = want[NAMES[tree.feature[node]]]
            mine[0], mine[1] = mine[0] + tree.gain[node], mine[1] + 1
            assert tree.rows[node] == tree.rows[2 * node + 1] + tree.rows[2 * node + 2]
            walk(tree, 2 * node + 1)
            walk(tree, 2 * node + 2)

    for group in fitted.trees[: fitted.best_round]:
        for tree in group:
            walk(tree, 0)
    got = {r.feature: (r.gain, r.splits) for r in B.total_gain(fitted, spark).collect()}
    assert got.keys() == want.keys() and all(got[c] == (pytest.approx(g), n) for c, (g, n) in want.items())
    assert got["flat"] == (0.0, 0) and max(got, key=lambda c: got[c][0]) == "a"
    assert models.importances(fitted, 1)[0] == ("a", pytest.approx(want["a"][0] / sum(g for g, _ in want.values())))
    fitted.save(spark, str(tmp_path / "trees"))
    again = models.load_flat(spark, str(tmp_path / "trees"))
    values = np.random.default_rng(2).normal(size=(50, 5))
    assert np.array_equal(again.probabilities(values), fitted.probabilities(values)) and again.losses == fitted.losses


def test_boosting_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (None, 2), (float("nan"), 1)], "a double, label int")
    model = B.fit_boosted_trees(df, ["a"], params=B.BoostParams(rounds=2, depth=2))
    assert model.best_round == 2 and len(model.losses) == 3
    empty = B.fit_boosted_trees(df.limit(0), ["a"], params=QUICK)
    assert empty.best_round == 0 and empty.probabilities(np.array([[3.0]])).tolist() == [[0.25] * 4]
    assert B.boosted_probabilities(model, df.limit(0), "xgb").collect() == []


# --- recurrent network ---------------------------------------------------------------------


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    p = R.RecurrentParams(hidden=5, layers=2, classes=4, dropout=0.4)
    x, labels = rng.normal(size=(7, 6, 3)), rng.integers(0, 4, 7)
    w = R.first_weights(3, p).astype(np.float64)
    draw = lambda: np.random.default_rng(9)  # noqa: E731  the same drops each time
    loss, gradient = R.loss_and_gradient(w, x, labels, p, draw())
    for i in rng.choice(len(w), 60, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (R.loss_and_gradient(up, x, labels, p, draw())[0] - R.loss_and_gradient(down, x, labels, p, draw())[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-8)
    assert loss == pytest.approx(R.loss_and_gradient(w, x, labels, p, draw())[0])


@pytest.fixture(scope="module")
def marks(spark):
    """The class is the sign pattern at the last marked step, wherever that is."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2400):
        x = rng.normal(size=(15, 3)) * 0.7
        x[:, 2] = 0.0
        at = rng.choice(15, 2, replace=False)
        x[at, 2] = 1.0
        a, b = x[at.max(), :2]
        rows.append((i, int(2 * (a > 0) + (b > 0)), i % 4 == 0, x.tolist()))
    return spark.createDataFrame(rows, "id long, label int, held_out boolean, sequence array<array<double>>")


SMALL = R.RecurrentParams(hidden=16, layers=1, dropout=0.0, rate=1e-2, epochs=10, slice_rows=110, learners=4, batch=16)


@pytest.fixture(scope="module")
def network(marks):
    return R.fit_recurrent(marks, ["id"], held_out="held_out", params=SMALL)


def test_network_remembers_what_a_perceptron_does_not(marks, network):
    held = models.probabilities(network, marks.filter("held_out"), "lstm")
    loss = models.log_loss(held, "lstm")
    assert loss == pytest.approx(min(h for _, h, _ in network.history), abs=2e-4)
    flat = models.fit_sequences(marks.filter("not held_out"), 45, hidden=(32, 16), rounds=60)
    plain = models.log_loss(models.probabilities(flat, models.flatten_sequences(marks.filter("held_out")), "p"), "p")
    assert loss < plain - 0.2 and loss < 1.0
    assert held.columns == [*marks.columns, *[f"lstm_prob_{k}" for k in range(4)]]


def test_network_does_not_depend_on_the_layout(marks):
    p = R.RecurrentParams(**{**vars(SMALL), "epochs": 2, "dropout": 0.2, "layers": 2, "hidden": 6})
    one, other = (R.fit_recurrent(df, ["id"], held_out="held_out", params=p) for df in (marks.coalesce(1), marks.repartition(9, "label")))
    assert np.array_equal(one.weights, other.weights) and [h[0] for h in one.history] == [h[0] for h in other.history]
    assert [h[1] for h in one.history] == pytest.approx([h[1] for h in other.history], abs=1e-6)


def test_rate_halves_on_plateaus_and_training_stops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(4)), i % 2 == 0, rng.normal(size=(3, 2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, label int, held_out boolean, sequence array<array<double>>")
    model = R.fit_recurrent(df, ["id"], held_out="held_out", params=R.RecurrentParams(hidden=8, layers=1, rate=0.05, epochs=40, patience=7, plateau=2))
    rates = [r for *_, r in model.history]
    assert len(model.history) < 40 and rates[0] == 0.05 and rates[-1] <= 0.0125
    best = int(np.argmin([h for _, h, _ in model.history]))
    assert len(model.history) - 1 - best >= 6


def test_network_of_nulls_and_of_nothing(spark, network, tmp_path):
    df = spark.createDataFrame([(1, 2, [[None, 1.0], [float("nan"), 0.0]]), (2, None, [[1.0, 1.0]] * 2), (3, 1, None)], "id long, label int, sequence array<array<double>>")
    p = R.RecurrentParams(hidden=3, layers=1, epochs=1)
    model = R.fit_recurrent(df, ["id"], params=p)
    assert (model.steps, model.inputs, len(model.history)) == (2, 2, 1)
    scored = R.recurrent_probabilities(model, df.filter("sequence is not null"), "lstm").collect()
    assert all(sum(r[f"lstm_prob_{k}"] for k in range(4)) == pytest.approx(1) for r in scored)
    assert R.fit_recurrent(df.limit(0), ["id"], params=p).history == []
    network.save(spark, str(tmp_path / "net"))
    again, x = R.RecurrentModel.load(spark, str(tmp_path / "net")), np.random.default_rng(1).normal(size=(4, 15, 3)).astype(np.float32)
    assert np.array_equal(again.probabilities(x), network.probabilities(x)) and again.params == network.params
