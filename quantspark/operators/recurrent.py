"""A recurrent classifier of sequences: stacked LSTM layers trained by synchronised learners.

Rows are dealt by a hash of their key to slices and learners, once, and packed: one row of a written
table holds what one learner sees of one slice.  An epoch goes through the slices; in each, every
learner starts from the same weights, takes its mini-batches with Adam on clipped gradients that
reach back through all steps, and the results are averaged, weighted by rows, before the next slice.
So the work between two averages is bounded, and the outcome depends on the rows and not on where
they lie.  The rate is halved where held-out loss does not fall, and training stops where it does
not fall for longer; the best weights count.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, written

UNIT = 1 << 20


@dataclass(frozen=True)
class RecurrentParams:
    """The settings of the model that this one stands in for; then how training is dealt out."""

    hidden: int = 128
    layers: int = 2
    classes: int = 4
    dropout: float = 0.3
    rate: float = 1e-3
    batch: int = 64
    epochs: int = 100
    patience: int = 10
    least_gain: float = 1e-4
    plateau: int = 5
    clip: float = 1.0
    seed: int = 42
    slice_rows: int = 512  # rows of a learner between two averages
    learners: int = 64  # at most; fewer for few rows


def weight_shapes(inputs: int, p: RecurrentParams) -> list[tuple[int, ...]]:
    """Input weights, recurrent weights and bias of each layer, then weights and bias of the classes."""
    shapes = []
    for layer in range(p.layers):
        shapes += [(inputs if layer == 0 else p.hidden, 4 * p.hidden), (p.hidden, 4 * p.hidden), (4 * p.hidden,)]
    return [*shapes, (p.hidden, p.classes), (p.classes,)]


def first_weights(inputs: int, p: RecurrentParams) -> np.ndarray:
    """Uniform within 1 / sqrt(hidden), as one vector."""
    size = sum(math.prod(s) for s in weight_shapes(inputs, p))
    bound = 1 / math.sqrt(p.hidden)
    return np.random.default_rng(p.seed).uniform(-bound, bound, size).astype(np.float32)


def _unpacked(flat: np.ndarray, inputs: int, p: RecurrentParams) -> list[np.ndarray]:
    out, at = [], 0
    for shape in weight_shapes(inputs, p):
        out.append(flat[at : at + math.prod(shape)].reshape(shape))
        at += math.prod(shape)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _layer(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """Outputs of one layer over [step, row, input], and what going back needs."""
    steps, rows, _ = x.shape
    size = wh.shape[0]
    gates = x @ wx + b
    cells, outs = np.zeros((steps + 1, rows, size), x.dtype), np.zeros((steps + 1, rows, size), x.dtype)
    for t in range(steps):
        z = gates[t]
        z += outs[t] @ wh
        z[:, : 2 * size] = _sigmoid(z[:, : 2 * size])  # in, forget
        z[:, 2 * size : 3 * size] = np.tanh(z[:, 2 * size : 3 * size])
        z[:, 3 * size :] = _sigmoid(z[:, 3 * size :])  # out
        cells[t + 1] = z[:, size : 2 * size] * cells[t] + z[:, :size] * z[:, 2 * size : 3 * size]
        outs[t + 1] = z[:, 3 * size :] * np.tanh(cells[t + 1])
    return outs, (x, gates, cells, outs)


def _layer_back(d_outs: np.ndarray, kept, wx: np.ndarray, wh: np.ndarray):
    """Gradients of the inputs and the weights of one layer, given those of its outputs."""
    x, gates, cells, outs = kept
    steps, rows, size = d_outs.shape
    dz = np.empty_like(gates)
    d_out, d_cell = np.zeros((rows, size), x.dtype), np.zeros((rows, size), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, g, o = (gates[t][:, k * size : (k + 1) * size] for k in range(4))
        squashed = np.tanh(cells[t + 1])
        d = d_outs[t] + d_out
        d_cell = d_cell + d * o * (1 - squashed**2)
        dz[t][:, :size] = d_cell * g * i * (1 - i)
        dz[t][:, size : 2 * size] = d_cell * cells[t] * f * (1 - f)
        dz[t][:, 2 * size : 3 * size] = d_cell * i * (1 - g**2)
        dz[t][:, 3 * size :] = d * squashed * o * (1 - o)
        d_cell = d_cell * f
        d_out = dz[t] @ wh.T
    flat = dz.reshape(-1, 4 * size)
    return dz @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, outs[:-1].reshape(-1, size).T @ flat, flat.sum(axis=0)


def class_logits(flat: np.ndarray, x: np.ndarray, p: RecurrentParams, rng: np.random.Generator | None = None):
    """Logits of sequences [row, step, input]; with ``rng`` outputs of layers are dropped at random.  Also what going back needs."""
    w = _unpacked(flat, x.shape[2], p)
    inner, kept = np.ascontiguousarray(x.transpose(1, 0, 2)), []
    for layer in range(p.layers):
        outs, state = _layer(inner, *w[3 * layer : 3 * layer + 3])
        inner = outs[1:] if layer < p.layers - 1 else outs[-1]
        mask = None
        if rng is not None and p.dropout:
            mask = ((rng.random(inner.shape) >= p.dropout) / (1 - p.dropout)).astype(x.dtype)
            inner = inner * mask
        kept.append((state, mask))
    return inner @ w[-2] + w[-1], (kept, inner)


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, labels: np.ndarray, p: RecurrentParams, rng: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a batch and its gradient through all steps."""
    w, n = _unpacked(flat, x.shape[2], p), len(x)
    logits, (kept, last) = class_logits(flat, x, p, rng)
    probs = _softmax(logits)
    loss = -np.log(np.maximum(probs[np.arange(n), labels], 1e-15)).mean()
    d = probs
    d[np.arange(n), labels] -= 1
    d /= n
    grads = [None] * len(w)
    grads[-2], grads[-1] = last.T @ d, d.sum(axis=0)
    d_last = d @ w[-2].T
    for layer in range(p.layers - 1, -1, -1):
        state, mask = kept[layer]
        if mask is not None:
            d_last = d_last * mask
        if layer == p.layers - 1:  # only the last step is used
            d_outs = np.zeros_like(state[3][1:])
            d_outs[-1] = d_last
        else:
            d_outs = d_last
        d_last, *grads[3 * layer : 3 * layer + 3] = _layer_back(d_outs, state, *w[3 * layer : 3 * layer + 2])
    return float(loss), np.concatenate([g.ravel() for g in grads])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class _State:
    """Weights, Adam's two moments and its number of steps."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0


def _learn(state: _State, x: np.ndarray, labels: np.ndarray, rate: float, p: RecurrentParams, seed: tuple[int, ...]) -> tuple[_State, float]:
    """One learner's pass over its rows, in an order and with drops that ``seed`` fixes; the state after it and the sum of losses."""
    rng, total = np.random.default_rng(seed), 0.0
    w, m, v, t = state.weights.copy(), state.first.copy(), state.second.copy(), state.steps
    order = rng.permutation(len(x))
    for at in range(0, len(x), p.batch):
        rows = order[at : at + p.batch]
        loss, g = loss_and_gradient(w, x[rows], labels[rows], p, rng)
        total += loss * len(rows)
        g *= min(1.0, p.clip / (float(np.sqrt((g.astype(np.float64) ** 2).sum())) + 1e-6))
        t += 1
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(w.dtype)
    return _State(w, m.astype(np.float32), v.astype(np.float32), t), total


@dataclass
class RecurrentModel:
    """Fitted weights; ``history`` has training loss, held-out loss and rate of each epoch."""

    weights: np.ndarray
    steps: int
    inputs: int
    params: RecurrentParams
    history: list[tuple[float, float | None, float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray, piece: int = 256) -> np.ndarray:
        parts = [_softmax(class_logits(self.weights, x[i : i + piece], self.params)[0]) for i in range(0, len(x), piece)]
        return np.concatenate(parts) if parts else np.zeros((0, self.params.classes))

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of Parquet."""
        state = {"steps": self.steps, "inputs": self.inputs, "params": vars(self.params), "history": self.history, "weights": base64.b64encode(self.weights.astype("<f4").tobytes()).decode()}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RecurrentModel":
        s = json.loads(spark.read.parquet(path).first()["state"])
        return cls(np.frombuffer(base64.b64decode(s["weights"]), "<f4"), s["steps"], s["inputs"], RecurrentParams(**s["params"]), [tuple(h) for h in s["history"]])


def _packed_column(column: str):
    """A sequence as bytes of floats; missing values are 0."""

    @F.pandas_udf("binary")
    def pack(flat: pd.Series) -> pd.Series:
        return flat.map(lambda v: np.nan_to_num(np.asarray(v, dtype="<f4"), nan=0.0).tobytes())

    return pack(F.transform(F.flatten(column), lambda x: x.cast("float")))


def _unpack_rows(values: Sequence[bytes], steps: int, inputs: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f4").reshape(-1, steps, inputs)


def fit_recurrent(df: DataFrame, keys: Sequence[str], label: str = "label", held_out: str | None = None, column: str = "sequence", params: RecurrentParams = RecurrentParams()) -> RecurrentModel:
    """Fit on the rows of ``df`` with a label that are not ``held_out``; ``column`` has steps x inputs of numbers, the same for all rows.

    ``keys`` name a row: they alone decide its slice and learner.  Without held-out rows all epochs
    are run; without training rows the first weights stay.  The driver gets one state per learner.
    """
    spark, p = df.sparkSession, params
    side = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = df.filter(F.col(label).isNotNull() & F.col(column).isNotNull())
    packed, path = written(rows.select(F.xxhash64(*keys).alias("turn"), F.col(label).cast("int").alias("label"), side.alias("held_out"), F.size(column).alias("steps"), _packed_column(column).alias("x")), "sequences")
    paths = [path]
    try:
        sizes = {r["held_out"]: r for r in packed.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.first("steps").alias("steps"), F.first(F.length("x")).alias("bytes")).collect()}
        one = next(iter(sizes.values()), None)
        steps, inputs = (one["steps"], one["bytes"] // 4 // max(1, one["steps"])) if one else (1, 1)
        n = sizes[False]["n"] if False in sizes else 0
        learners = max(1, min(p.learners, n // (4 * p.slice_rows)))
        slices = max(1, math.ceil(n / (learners * p.slice_rows)))
        model = RecurrentModel(first_weights(inputs, p), steps, inputs, p)
        if not n:
            return model

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["turn", "label", "x"], kind="stable")
            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "learner": pdf["learner"].iloc[:1], "x": [b"".join(pdf["x"])], "y": [pdf["label"].to_numpy().astype("<i4").tobytes()]})

        dealt = packed.filter("not held_out").withColumns({"slice": F.pmod("turn", F.lit(slices)).cast("int"), "learner": F.pmod(F.shiftright("turn", 20), F.lit(learners)).cast("int")})
        cells, path = written(dealt.groupBy("slice", "learner").applyInPandas(pack, "slice int, learner int, x binary, y binary"), "sequence-cells", "slice", "learner")
        paths.append(path)
        state = _State(model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights))
        best, best_loss, since_best, since_halved, plateau_best, rate = state.weights, math.inf, 0, 0, math.inf, p.rate
        for epoch in range(p.epochs):
            total = 0.0
            for part in range(slices):
                state, loss = _slice_pass(cells.filter(F.col("slice") == part), state, rate, p, (p.seed, epoch, part), steps, inputs)
                total += loss
            model.weights = state.weights
            held = mean_loss(packed.filter("held_out"), model) if True in sizes else None
            model.history.append((total / n, held, rate))
            if held is None:
                best = state.weights
                continue
            since_best, since_halved = since_best + 1, since_halved + 1
            if held < plateau_best * (1 - 1e-4):
                plateau_best, since_halved = held, 0
            if held < best_loss - p.least_gain:
                best, best_loss, since_best = state.weights, held, 0
            if since_halved > p.plateau:
                rate, since_halved = rate / 2, 0
            if since_best >= p.patience:
                break
        model.weights = best
        return model
    finally:
        for path in paths:
            remove(spark, path)


def _slice_pass(cells: DataFrame, state: _State, rate: float, p: RecurrentParams, seed: tuple[int, ...], steps: int, inputs: int) -> tuple[_State, float]:
    """All learners' passes over one slice, and the mean of their states, weighted by rows."""
    sent = cells.sparkSession.sparkContext.broadcast(state)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                labels = np.frombuffer(r.y, "<i4")
                after, loss = _learn(sent.value, _unpack_rows([r.x], steps, inputs), labels, rate, p, (*seed, int(r.learner)))
                vectors = {k: [getattr(after, k).astype("<f4").tobytes()] for k in ("weights", "first", "second")}
                yield pd.DataFrame({"learner": [r.learner], "n": [len(labels)], "steps": [after.steps], "loss": [loss], **vectors})

    found = cells.mapInPandas(learn, "learner int, n long, steps double, loss double, weights binary, first binary, second binary").collect()  # one row per learner
    sent.unpersist()
    found.sort(key=lambda r: r["learner"])
    if not found:
        return state, 0.0
    n = sum(r["n"] for r in found)
    mean = lambda k: (sum(r["n"] * np.frombuffer(r[k], "<f4").astype(np.float64) for r in found) / n).astype(np.float32)
    return _State(mean("weights"), mean("first"), mean("second"), sum(r["n"] * r["steps"] for r in found) / n), sum(r["loss"] for r in found)


def mean_loss(packed: DataFrame, model: RecurrentModel) -> float | None:
    """Mean cross-entropy over rows of packed sequences (x, label), each rounded to a UNIT; only the last digits depend on how rows are batched."""
    sent = packed.sparkSession.sparkContext.broadcast(model)

    def lose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, total, n = sent.value, 0, 0
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                probs = m.probabilities(_unpack_rows(part["x"], m.steps, m.inputs))
                own = probs[np.arange(len(part)), part["label"].to_numpy()]
                total, n = total + int(np.rint(-np.log(np.maximum(own, 1e-15)) * UNIT).sum()), n + len(part)
        yield pd.DataFrame({"loss": [total], "n": [n]})

    found = packed.select("x", "label").mapInPandas(lose, "loss long, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    sent.unpersist()
    return found["loss"] / UNIT / found["n"] if found["n"] else None


def recurrent_probabilities(model: RecurrentModel, df: DataFrame, name: str, column: str = "sequence") -> DataFrame:
    """``df`` with ``<name>_prob_0`` and so on."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(values: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series(list(m.probabilities(_unpack_rows(values, m.steps, m.inputs)).astype(float)))

    scored = df.select("*", score(_packed_column(column)).alias("__scores"))
    return scored.select(*df.columns, *[F.col("__scores")[k].alias(f"{name}_prob_{k}") for k in range(model.params.classes)])
