"""Gradient boosting of all classes together: softmax loss, histogram trees, patience on held-out loss.

Features become small bin numbers once.  A tree is grown level by level; for a level every task adds
up, for all classes at once, gradients by (class, node, feature, bin), Spark sums the cells, and the
driver picks each node's split.  What the driver sees is bounded by classes x nodes x features x
bins, whatever the rows.  Gradients are whole numbers of 2**-20, so sums do not depend on how rows
are dealt, and neither do trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, written

#: Gradients are rounded to this fraction.
UNIT = 1 << 20
#: Even cells of a feature's range, from which bins are made.
CELLS = 4096
#: Cells that carry the loss, beside those of histograms: training rows, held-out rows.
LOSS = {False: -2, True: -1}
NODES = "round int, class int, node int, feature string, bin int, threshold double, value double, gain double, hessian double, rows long"


@dataclass(frozen=True)
class BoostParams:
    """The settings of the model that this one stands in for."""

    classes: int = 4
    rounds: int = 500
    depth: int = 6
    step: float = 0.05
    min_hessian: float = 5.0
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    patience: int = 50
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    hessian: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after at most ``levels`` splits."""
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            split = self.feature[at]
            right = bins[every, np.maximum(split, 0)] > self.bin[at]
            at = np.where(split >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class BoostedTrees:
    """A fitted ensemble: ``trees[round][class]``, of which the first ``best_round`` count."""

    features: list[str]
    bins: "Bins"
    trees: list[list[Tree]]
    params: BoostParams
    best_round: int = 0
    losses: list[tuple[float, float | None]] = field(default_factory=list)  # training and held-out loss after each round

    def margins(self, bins: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Sum of the trees of rounds ``first`` to ``last - 1`` by row and class."""
        out = np.zeros((len(bins), self.params.classes))
        for group in self.trees[first:last]:
            for k, tree in enumerate(group):
                out[:, k] += tree.value[tree.place(bins, self.params.depth)]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Class probabilities of rows of feature values; a missing value is 0."""
        return _softmax(self.margins(self.bins.numbers(values), 0, self.best_round))

    def feature_gain(self) -> list[float]:
        """Each feature's gain over all splits of the rounds that count."""
        gain = np.zeros(len(self.features))
        for group in self.trees[: self.best_round]:
            for t in group:
                np.add.at(gain, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return gain.tolist()

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row for each node of the rounds that count: its split (null for a leaf), value, gain and rows."""
        rows = []
        for r, group in enumerate(self.trees[: self.best_round]):
            for k, t in enumerate(group):
                for i in np.flatnonzero(t.rows > 0):
                    f = int(t.feature[i])
                    split = (self.features[f], int(t.bin[i]), self.bins.threshold(f, t.bin[i])) if f >= 0 else (None, None, None)
                    rows.append((r, k, int(i), *split, float(t.value[i]), float(t.gain[i]), float(t.hessian[i]), int(t.rows[i])))
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        """``<path>/nodes``, one row a node, and ``<path>/state``, one row."""
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        state = json.dumps({"features": self.features, "low": self.bins.low.tolist(), "high": self.bins.high.tolist(), "ends": [e.tolist() for e in self.bins.ends], "params": vars(self.params), "best_round": self.best_round, "losses": self.losses})
        spark.createDataFrame([(state,)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        s = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        p = BoostParams(**s["params"])
        trees = [[Tree.empty(p.depth) for _ in range(p.classes)] for _ in range(s["best_round"])]
        number = {c: i for i, c in enumerate(s["features"])}
        bins = Bins(np.array(s["low"]), np.array(s["high"]), [np.array(e, np.int64) for e in s["ends"]])
        for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():  # the model: rounds x classes x nodes
            t, i = trees[r["round"]][r["class"]], r["node"]
            if r["feature"] is not None:
                t.feature[i], t.bin[i] = number[r["feature"]], r["bin"]
            t.value[i], t.gain[i], t.hessian[i], t.rows[i] = r["value"], r["gain"], r["hessian"], r["rows"]
        return cls(s["features"], bins, trees, p, s["best_round"], [tuple(x) for x in s["losses"]])


def total_gain(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """``feature, gain, splits``: each feature's gain over all its splits, unused features last with 0."""
    splits = model.nodes(spark).filter("feature is not null")
    found = splits.groupBy("feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    every = spark.createDataFrame([(c,) for c in model.features], "feature string")
    return every.join(found, "feature", "left").na.fill({"gain": 0.0, "splits": 0}).orderBy(F.desc("gain"), "feature")


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by row and class, in whole UNITs (the second doubled, the usual bound)."""
    p = _softmax(margins)
    g = p.copy()
    g[np.arange(len(p)), labels] -= 1.0
    return np.rint(g * UNIT), np.rint(np.maximum(2.0 * p * (1.0 - p), 1e-6) * UNIT)


@dataclass
class Bins:
    """How values become bin numbers: a feature's range is cut into CELLS even cells, and a bin ends with each cell in ``ends``."""

    low: np.ndarray
    high: np.ndarray
    ends: list[np.ndarray]

    def cells(self, values: np.ndarray) -> np.ndarray:
        """Cell of each value; missing values are 0, values beyond the range are in the outer cells."""
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        at = np.floor((np.nan_to_num(values, nan=0.0) - self.low) / span * CELLS)
        return np.clip(at, 0, CELLS - 1).astype(np.int64)

    def numbers(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value: the ends below its cell."""
        cells = self.cells(values)
        return np.stack([np.searchsorted(e, cells[:, i], "left") for i, e in enumerate(self.ends)], axis=1).astype(np.uint8)

    def threshold(self, feature: int, bin_: int) -> float:
        """The upper border of a bin."""
        return float(self.low[feature] + (self.ends[feature][bin_] + 1) * (self.high[feature] - self.low[feature]) / CELLS)


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))


def _filled(features: Sequence[str]) -> list[Column]:
    """Features as doubles, null as 0."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]


def fit_bins(df: DataFrame, features: Sequence[str], bins: int) -> Bins:
    """At most ``bins`` bins a feature of about equally many rows, from exact counts of cells.

    A bin ends with the first cell at which the rows up to it reach each of the shares i / bins.  The
    driver gets a row a feature, then at most CELLS counts a feature.
    """
    rows = df.select(*_filled(features))
    names = rows.columns
    ends = rows.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names]).first()
    found = Bins(*(np.array([ends[c][x] if ends[c][x] is not None else 0.0 for c in names]) for x in ("low", "high")), [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * CELLS, np.int64)
        for batch in batches:
            total += np.bincount((found.cells(_matrix(batch, names)) + np.arange(len(names)) * CELLS).ravel(), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["cell", "n"])

    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * CELLS, np.int64)
    counts[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    for up_to in np.cumsum(counts.reshape(len(names), CELLS), axis=1):
        wanted = -(-np.arange(1, bins) * up_to[-1] // bins)  # rounded up
        found.ends.append(np.unique(np.searchsorted(up_to, wanted, "left"))[: bins - 1] if up_to[-1] else np.zeros(0, np.int64))
    return found


def binned(rows: DataFrame, features: Sequence[str], bins: Bins, *kept: Column) -> DataFrame:
    """``bins`` (bytes, one a feature) beside the ``kept`` columns."""
    names = [f"f{i}" for i in range(len(features))]
    given = rows.select(*kept, *_filled(features))
    others = given.drop(*names).schema
    beside = others.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = bins.numbers(_matrix(batch, names)) if batch.num_rows else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in numbers], pa.binary()), *[batch.column(c) for c in beside]], ["bins", *beside])

    return given.mapInArrow(number, "bins binary, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others))


def _hash_share(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row keys."""
    with np.errstate(over="ignore"):
        h = (key.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


def _columns_of(p: BoostParams, features: int, round_: int) -> list[np.ndarray]:
    """Each class's features in a round."""
    rng = np.random.default_rng((p.seed, round_))
    some = max(1, round(p.column_share * features))
    return [np.sort(rng.choice(features, some, replace=False)) for _ in range(p.classes)]


def level_sums(state: DataFrame, model: BoostedTrees, since: int, growing: list[Tree], level: int, round_: int, columns: list[np.ndarray]) -> DataFrame:
    """``cell, g, h, n`` of the nodes of one level of the growing trees, and the loss before them in the cells of LOSS.

    ``state`` has margins of the rounds before ``since``; later trees are walked.  A cell's number is
    ((class x nodes + node) x features + feature) x bins + bin.
    """
    p, model_features = model.params, model.features
    sent = state.sparkSession.sparkContext.broadcast((model.trees[since:], growing))  # at most the rounds between two writes

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, trees = sent.value
        recent = BoostedTrees(model_features, Bins(None, None, []), done, p)
        width, n_features = 1 << level, len(model_features)
        cells = p.classes * width * n_features * p.bins
        total = {x: np.zeros(cells, np.int64) for x in ("g", "h", "n")}
        loss = {False: [0, 0], True: [0, 0]}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, n_features)
            labels, key = batch.column("label").to_numpy(), batch.column("key").to_numpy()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            margins = np.stack([batch.column(f"m{k}").to_numpy() for k in range(p.classes)], axis=1) + recent.margins(bins)
            if level == 0:
                own = -np.log(np.maximum(_softmax(margins)[np.arange(n), labels], 1e-15))
                for side in loss:
                    loss[side][0] += int(np.rint(own[held == side] * UNIT).sum())
                    loss[side][1] += int((held == side).sum())
            g, h = gradients(margins, labels)
            used = ~held & (_hash_share(key, p.seed * 1_000_003 + round_) < p.row_share)
            for k, tree in enumerate(trees):
                node = tree.place(bins, level) - (width - 1)  # negative: in a leaf above this level
                rows = np.flatnonzero(used & (node >= 0))
                some = columns[k]
                cell = (((k * width + node[rows, None]) * n_features + some) * p.bins + bins[np.ix_(rows, some)]).ravel()
                for x, weight in (("g", g[rows, k]), ("h", h[rows, k]), ("n", None)):
                    w = None if weight is None else np.repeat(weight, len(some))
                    total[x] += np.bincount(cell, w, cells).astype(np.int64)
        full = np.flatnonzero(total["n"])
        out = {"cell": full, **{x: total[x][full] for x in total}}
        extra = [(LOSS[side], s, 0, c) for side, (s, c) in loss.items() if c]
        arrays = [np.append(out[x], [e[i] for e in extra]).astype(np.int64) for i, x in enumerate(("cell", "g", "h", "n"))]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["cell", "g", "h", "n"])

    parts = state.mapInArrow(sums, "cell long, g long, h long, n long")
    return parts.groupBy("cell").agg(*[F.sum(x).alias(x) for x in ("g", "h", "n")])


def start_state(rows: DataFrame, features: Sequence[str], bins: Bins, label: str, held_out: Column, classes: int) -> DataFrame:
    """What a fit reads: bins, label, held_out, a key for sampling and margins of 0."""
    key = F.xxhash64(*[F.col(c) for c in features], F.col(label)).alias("key")
    return binned(rows, features, bins, F.col(label).cast("int").alias("label"), held_out.alias("held_out"), key, *[F.lit(0.0).alias(f"m{k}") for k in range(classes)])


def root_histogram(df: DataFrame, features: Sequence[str], label: str = "label", params: BoostParams = BoostParams(row_share=1.0)) -> DataFrame:
    """``class, feature, bin, gradient, hessian, n``: what the first split of each class's first tree is chosen from, in whole UNITs."""
    features, p = list(features), params
    model = BoostedTrees(features, fit_bins(df, features, p.bins), [], p)
    state = start_state(df, features, model.bins, label, F.lit(False), p.classes)
    sums = level_sums(state, model, 0, [Tree.empty(p.depth) for _ in range(p.classes)], 0, 0, [np.arange(len(features))] * p.classes).filter("cell >= 0")
    per_class = len(features) * p.bins
    names = F.array(*[F.lit(c) for c in features])
    place = lambda by, modulo: F.pmod(F.floor(F.col("cell") / by), F.lit(modulo)).cast("int")
    return sums.select(place(per_class, p.classes).alias("class"), F.get(names, place(p.bins, len(features))).alias("feature"), place(1, p.bins).alias("bin"), F.col("g").alias("gradient"), F.col("h").alias("hessian"), "n")


def _thresholded(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: BoostParams) -> dict[str, np.ndarray]:
    """For histograms [node, feature, bin]: each node's sums, its best split and the sums to its left; gain 0 without a split.

    Ties go to the first feature and bin.
    """
    every, most = np.arange(len(n)), n.sum(axis=2).argmax(axis=1)  # features left out of a tree have no sums
    g_all, h_all, n_all = (x.sum(axis=2)[every, most] for x in (g, h, n))
    left_g, left_h, left_n = (np.cumsum(x, axis=2)[:, :, :-1] for x in (g, h, n))
    worth = lambda a, b: _thresholded(a, p.l1) ** 2 / (b + p.l2)
    right_h = h_all[:, None, None] - left_h
    gain = worth(left_g, left_h) + worth(g_all[:, None, None] - left_g, right_h) - worth(g_all, h_all)[:, None, None]
    gain = np.where((left_h >= p.min_hessian) & (right_h >= p.min_hessian), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    feature, cut = np.divmod(at, gain.shape[2])
    found = {"g": g_all, "h": h_all, "n": n_all, "gain": np.maximum(flat[every, at], 0.0), "feature": feature, "bin": cut}
    return found | {f"left_{x}": a[every, feature, cut] for x, a in (("g", left_g), ("h", left_h), ("n", left_n))}


def _grow(trees: list[Tree], level: int, sums: dict[str, np.ndarray], features: int, p: BoostParams) -> bool:
    """Split the nodes of one level of the trees by their sums; False if none was split."""
    width = 1 << level
    shape = (p.classes, width, features, p.bins)
    dense = {x: np.zeros(int(np.prod(shape)), np.int64) for x in ("g", "h", "n")}
    real = sums["cell"] >= 0
    for x in dense:
        dense[x][sums["cell"][real]] = sums[x][real]
    grew = False
    for k, tree in enumerate(trees):
        g, h, n = (dense[x].reshape(shape)[k] for x in ("g", "h", "n"))
        best = best_splits(g / UNIT, h / UNIT, n, p)

        def fill(node: int, g: float, h: float, n: int) -> None:
            tree.rows[node], tree.hessian[node], tree.value[node] = n, h, -p.step * float(_thresholded(g, p.l1)) / (h + p.l2)

        for i in np.flatnonzero(best["n"]):
            node = width - 1 + i
            if level == 0:
                fill(node, best["g"][i], best["h"][i], best["n"][i])
            if best["gain"][i] > 1e-6:
                tree.feature[node], tree.bin[node], tree.gain[node], grew = best["feature"][i], best["bin"][i], best["gain"][i], True
                left = [best[f"left_{x}"][i] for x in ("g", "h", "n")]
                fill(2 * node + 1, *left)
                fill(2 * node + 2, *[best[x][i] - y for x, y in zip(("g", "h", "n"), left)])
    return grew


def fit_boosted_trees(df: DataFrame, features: Sequence[str], label: str = "label", held_out: str | None = None, params: BoostParams = BoostParams(), refresh: int = 16) -> BoostedTrees:
    """Fit on the rows of ``df`` with a label (0 to classes - 1) that are not ``held_out`` (a boolean column).

    With held-out rows the fit ends once their loss has not fallen for ``patience`` rounds, and the
    rounds up to the best count; without any, all rounds do.  Null features are 0.  Without training
    rows the model has no trees and gives every class the same probability.  ``refresh`` rounds lie
    between two writes of the margins.  The result does not depend on the order or place of rows.
    """
    spark, features, p = df.sparkSession, list(features), params
    side = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = df.filter(F.col(label).isNotNull())
    model = BoostedTrees(features, fit_bins(rows.filter(~side), features, p.bins), [], p)
    state, path = written(start_state(rows, features, model.bins, label, side, p.classes), "boosting")
    since, best, grew = 0, float("inf"), True
    try:
        for round_ in range(p.rounds + 1):
            if round_ - since >= refresh:
                newer, newer_path = written(_with_margins(state, model, since), "boosting")
                remove(spark, path)
                state, path, since = newer, newer_path, round_
            trees, columns = [Tree.empty(p.depth) for _ in range(p.classes)], _columns_of(p, len(features), round_)
            for level in range(p.depth):
                table = level_sums(state, model, since, trees, level, round_, columns).toArrow()
                sums = {x: table.column(x).to_numpy() for x in table.column_names}
                if level == 0:
                    at = {int(c): (g / UNIT / n) for c, g, n in zip(sums["cell"], sums["g"], sums["n"]) if c < 0}
                    model.losses.append((at.get(LOSS[False]), at.get(LOSS[True])))
                    watched = at.get(LOSS[True], -round_ if LOSS[False] in at else None)
                    if watched is not None and watched < best:
                        best, model.best_round = watched, round_
                    if watched is None or round_ == p.rounds or round_ - model.best_round >= p.patience:
                        model.trees = model.trees[: model.best_round]
                        return model
                if not _grow(trees, level, sums, len(features), p):
                    break
            model.trees.append(trees)
        return model
    finally:
        remove(spark, path)


def _with_margins(state: DataFrame, model: BoostedTrees, since: int) -> DataFrame:
    """``state`` with the trees from ``since`` on added to its margins."""
    p, width = model.params, len(model.features)
    sent = state.sparkSession.sparkContext.broadcast(model.trees[since:])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = BoostedTrees([], Bins(None, None, []), sent.value, p)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)
            more = recent.margins(bins)
            for k in range(p.classes):
                at = batch.schema.get_field_index(f"m{k}")
                batch = batch.set_column(at, f"m{k}", pa.array(batch.column(at).to_numpy() + more[:, k]))
            yield batch

    return state.mapInArrow(add, state.schema)


def boosted_probabilities(model: BoostedTrees, df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``<name>_prob_0`` and so on; null features are 0."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(values: pd.Series) -> pd.Series:
        rows = np.array(values.tolist(), dtype=float).reshape(len(values), len(sent.value.features))
        return pd.Series(list(sent.value.probabilities(rows)))

    given = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features])
    scored = df.select("*", score(given).alias("__scores"))
    return scored.select(*df.columns, *[F.col("__scores")[k].alias(f"{name}_prob_{k}") for k in range(model.params.classes)])
