"""Language-model scores by a log-bilinear neural model, beside an exact word-count baseline.

Corpus counts (one scan): every training document adds its words and one end token; the full table
of word counts stays in Spark.

Model: every word has a class, as output and as context.  The end token and the most frequent words
have one each; all other words of the corpus, seen or not, are classed by their last two bytes (the
endings with most tokens, and one class for what is left).  A class is predicted from the two tokens before it: their vectors, each
weighted per position and dimension, are added and multiplied with the vector of each class, plus a
bias.  It is trained in numpy over all training documents with noise-contrastive estimation: the
nearer context first, on the counts of all pairs of classes; then both, by learners that go over the
text in rounds and are averaged, by tokens, after each.

Scores are normalised: batched matrix products give the normaliser of every pair of context
classes, so a token's log-probability is its score less a looked-up normaliser.  A word that shares
its class adds its smoothed share of the class's tokens, unknown words having one share, so the
probabilities of a class sum to one.  Words that are not broadcast are counted per document in the scan, matched
with the count table by a join, and added up; only the most frequent words are broadcast, at most
``known_words`` of at most 64 bytes each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _delete, carried_id, id_crc32_mod, materialize, restored_id, shared_dir, text_or_empty

LONGEST_KNOWN = 64
ENDING = 2  # bytes


def _words(text: str) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes split at exactly the separators."""
    return text.encode().lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, count) over ``training`` (text), without end tokens.  Tasks add up before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update(_words(text))
                if len(found) > 400_000:
                    yield pd.DataFrame({"word": list(found.keys()), "count": list(found.values())})
                    found.clear()
        if found:
            yield pd.DataFrame({"word": list(found.keys()), "count": list(found.values())})

    return training.mapInPandas(count, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class LogBilinear:
    """Parameters: context vectors, their weights by position, class vectors and biases."""

    context: np.ndarray  # classes x dims
    mix: np.ndarray  # 2 x dims
    target: np.ndarray  # classes x dims
    bias: np.ndarray  # classes

    @classmethod
    def start(cls, prior: np.ndarray, dims: int, seed: int = 5) -> "LogBilinear":
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(draw(len(prior), dims), np.ones((2, dims), np.float32), draw(len(prior), dims), np.log(prior).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int, dims: int) -> "LogBilinear":
        cut = np.cumsum([classes * dims, 2 * dims, classes * dims])
        a, b, c, d = np.split(flat.astype(np.float32), cut)
        return cls(a.reshape(classes, dims), b.reshape(2, dims), c.reshape(classes, dims), d)

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.context[far] * self.mix[0] + self.context[near] * self.mix[1]

    def normalisers(self) -> np.ndarray:
        """log of the sum over all classes, for every pair (far, near) of context classes."""
        n = len(self.bias)
        out = np.empty((n, n), np.float32)
        near = self.context * self.mix[1]
        for far in range(n):  # one matrix product of all contexts with all classes
            s = (self.context[far] * self.mix[0] + near) @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out[far] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        return out


def _spread(at: np.ndarray, grad: np.ndarray, rows: int) -> np.ndarray:
    """Sum of gradient rows by index, as a dense table."""
    order = np.argsort(at, kind="stable")
    keys, first = np.unique(at[order], return_index=True)
    out = np.zeros((rows, grad.shape[1]), np.float32)
    out[keys] = np.add.reduceat(grad[order], first, axis=0)
    return out


class NoiseContrastive:
    """Noise-contrastive training with noise shared by a batch, and per-parameter step sizes."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, samples: int, rate: float, seed: int):
        self.model, self.samples, self.rate = model, samples, rate
        self.log_noise, self.cumulative = np.log(noise).astype(np.float32), np.cumsum(noise)
        self.rng = np.random.default_rng(seed)
        self.seen = [np.full_like(x, 1e-2) for x in vars(model).values()]

    @classmethod
    def resumed(cls, state: np.ndarray, noise: np.ndarray, dims: int, samples: int, rate: float, seed: int) -> "NoiseContrastive":
        """Training that goes on from a state: parameters, then the squared gradients seen so far."""
        of = lambda x: LogBilinear.of(x.copy(), len(noise), dims)
        fit = cls(of(state[0]), noise, samples, rate, seed)
        fit.seen = list(vars(of(state[1])).values())
        return fit

    def state(self) -> np.ndarray:
        return np.stack([self.model.flat(), np.concatenate([x.ravel() for x in self.seen])])

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        m, k, n = self.model, self.samples, len(word)
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(k) * self.cumulative[-1]), len(self.cumulative) - 1)
        guess = m.predicted(far, near)
        mine, other = m.target[word], m.target[drawn]
        # P(data | score) with k noise words for each true one
        log_k = math.log(k)
        up = _sigmoid(np.einsum("ij,ij->i", guess, mine) + m.bias[word] - self.log_noise[word] - log_k) - 1.0
        down = _sigmoid(guess @ other.T + m.bias[drawn] - self.log_noise[drawn] - log_k)
        g_guess = up[:, None] * mine + down @ other
        g_target = _spread(word, up[:, None] * guess, len(m.bias))
        np.add.at(g_target, drawn, down.T @ guess)
        g_bias = np.bincount(word, up, len(m.bias)) + np.bincount(drawn, down.sum(axis=0), len(m.bias))
        g_context = _spread(far, g_guess * m.mix[0], len(m.bias)) + _spread(near, g_guess * m.mix[1], len(m.bias))
        g_mix = np.stack([(g_guess * m.context[far]).sum(axis=0), (g_guess * m.context[near]).sum(axis=0)])
        for x, seen, g in zip(vars(m).values(), self.seen, (g_context, g_mix, g_target, g_bias.astype(np.float32))):
            g = g / n
            seen += g * g
            x -= self.rate * g / np.sqrt(seen)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Classes of words: 0 is the end, 1 words of rare endings, then the most frequent words, then endings.

    ``words`` are the listed words by falling count; ``endings`` has (tokens, distinct words) of
    every ending in the corpus.  ``tokens`` and ``share`` are by class: all tokens, and log10 of the
    denominator of a word's share in it (0 where a class is one word).
    """

    def __init__(self, words: list[tuple[bytes, int]], endings: dict[bytes, tuple[int, int]], classes: int):
        self.number = {w: i for i, (w, _) in enumerate(words)}
        self.get = self.number.get
        self.counts = np.array([n for _, n in words], dtype=np.float64)
        own = min(len(words), classes - 2 - (classes - 2) // 2)
        rest = dict(endings)
        for w, n in words[:own]:
            tokens, kinds = rest[w[-ENDING:]]
            rest[w[-ENDING:]] = (tokens - n, kinds - 1)
        ranked = sorted((e for e, (tokens, _) in rest.items() if tokens), key=lambda e: (-rest[e][0], e))
        self.ending = {e: 2 + own + k for k, e in enumerate(ranked[: classes - 2 - own])}
        self.tokens, kinds = np.zeros(classes), np.zeros(classes)
        self.tokens[2 : 2 + own] = self.counts[:own]
        for e, (n, k) in rest.items():
            at = self.ending.get(e, 1)
            self.tokens[at] += n
            kinds[at] += k
        self.share = np.log10(self.tokens + 0.5 * (kinds + 1))
        self.share[0] = 0.0
        self.share[2 : 2 + own] = 0.0
        self.alone = own
        self.class_of = np.array([2 + i if i < own else self.ending.get(w[-ENDING:], 1) for i, (w, _) in enumerate(words)] + [1], np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or the number of listed words for others."""
        none = len(self.number)
        return np.fromiter((self.get(w, none) for w in words), np.int32, len(words))

    def classed(self, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """Class of each word of a text, and the end."""
        out = np.append(self.class_of[numbers], 0).astype(np.int32)
        for i in np.flatnonzero(numbers == len(self.number)):
            out[i] = self.ending.get(words[i][-ENDING:], 1)
        return out


def _contexts(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes two and one places before each token of a text; the end token stands before the first."""
    far, near = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
    near[1:], far[2:] = tokens[:-1], tokens[:-2]
    return far, near


def encode(training: DataFrame, vocabulary, learners: int, rounds: int) -> tuple[DataFrame, str]:
    """Class sequences of all rows of ``training``, written: ``classes`` (two bytes a token), by ``round`` and ``learner``.

    Rows are dealt evenly whatever they are, so no document, however often repeated, fills one learner.
    """

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        for pdf in batches:
            split = [_words(t) for t in pdf["text"]]
            yield pd.DataFrame({"classes": [v.classed(w, v.numbers(w)).astype("<u2").tobytes() for w in split]})

    dealt = training.mapInPandas(classed, "classes binary").repartition(learners * rounds)
    place = F.spark_partition_id()
    path = shared_dir(training.sparkSession, "lm-classes")
    dealt.withColumns({"round": F.pmod(place, F.lit(rounds)), "learner": F.pmod(F.floor(place / rounds), F.lit(learners)).cast("int")}).write.partitionBy("round", "learner").parquet(path)
    return training.sparkSession.read.schema("classes binary, round int, learner int").parquet(path), path


def pair_counts(encoded: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each other one, over all of ``encoded``; ``classes`` squared sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(classes * classes, np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                seqs = [np.frombuffer(x, "<u2").astype(np.int64) for x in pdf["classes"].iloc[lo : lo + 1024]]
                total += np.bincount(np.concatenate([_contexts(q)[1] * classes + q for q in seqs]), minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"pair": used, "n": total[used]})

    found = encoded.select("classes").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(classes * classes)
    out[found["pair"].to_numpy()] = found["n"]
    return out.reshape(classes, classes)


def fit_pairs(model: LogBilinear, pairs: np.ndarray, noise: np.ndarray, samples: int = 200, turns: int = 240, rate: float = 0.03, decay: float = 2.0) -> None:
    """Noise-contrastive estimation of the nearer context over all pairs at once, by exact expectations instead of drawn noise.

    A pair's score gains its count times log P(data) and ``samples`` noise pairs' times log P(noise).
    ``decay`` pulls vectors towards 0 as if by so many tokens.  Steps are Adam's with a falling rate.
    """
    tokens = max(1.0, pairs.sum())
    data = (pairs / tokens).astype(np.float32)
    drawn = (samples * data.sum(axis=1, keepdims=True) * noise).astype(np.float32)
    offset = (np.log(noise) + math.log(samples)).astype(np.float32)
    params = (model.context, model.target, model.bias)
    first, second = ([np.zeros_like(x) for x in params] for _ in range(2))
    for turn in range(1, turns + 1):
        g = (data + drawn) * _sigmoid(model.context @ model.target.T + (model.bias - offset)) - data
        grads = (g @ model.target + decay / tokens * model.context, g.T @ model.context + decay / tokens * model.target, g.sum(axis=0))
        for x, m, v, d in zip(params, first, second, grads):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (1 - turn / (turns + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)


def train_model(training: DataFrame, tokens: int, vocabulary, prior: np.ndarray, dims: int, samples: int, rate: float, batch: int, merge: int, slice_tokens: int = 400_000, most_learners: int = 256, most_rounds: int = 24) -> LogBilinear:
    """NCE over all rows of ``training`` (text), which have ``tokens`` tokens.

    First the nearer context is fitted to the counts of all class pairs.  Then learners go over the
    text in rounds: in each, all start from the same state (parameters and step sizes), train on their
    slice, and the states are averaged by tokens.  The tokens set how many learners and rounds there
    are, not the input's partitions: a learner has at least ``slice_tokens`` a round, and 8 rounds or
    more.  ``merge`` tasks average before the driver does.
    """
    classes = len(prior)
    start = LogBilinear.start(prior, dims)
    if not tokens:
        return start
    slices = -(-tokens // slice_tokens)
    learners = max(1, min(most_learners, slices // 8))
    rounds = min(most_rounds, -(-slices // learners))
    encoded, path = encode(training, vocabulary, learners, rounds)
    fit_pairs(start, pair_counts(encoded, classes), prior)
    start.mix[0] = 0.1
    state = np.stack([start.flat(), np.full_like(start.flat(), 1e-2)])
    for turn in range(rounds):
        state = _round(encoded.filter(F.col("round") == turn), state, turn, prior, dims, samples, rate, batch, merge)
    _delete(training.sparkSession, path)
    return LogBilinear.of(state[0], classes, dims)


def _round(slices: DataFrame, state: np.ndarray, turn: int, prior: np.ndarray, dims: int, samples: int, rate: float, batch: int, merge: int) -> np.ndarray:
    """All learners' training on their slices of a round, and the mean of their states, weighted by tokens."""
    sent = slices.sparkSession.sparkContext.broadcast(state)  # twice the parameters, whatever the input
    shape = state.shape

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict[int, tuple[NoiseContrastive, list]] = {}
        for pdf in batches:
            for learner, packed in pdf.groupby("learner")["classes"]:
                fit, done = fits.get(learner) or fits.setdefault(int(learner), (NoiseContrastive.resumed(sent.value, prior, dims, samples, rate, seed=turn * 1_000_003 + int(learner)), [0]))
                packed = list(packed)
                for lo in range(0, len(packed), 256):
                    seqs = [np.frombuffer(x, "<u2").astype(np.int32) for x in packed[lo : lo + 256]]
                    pairs = [_contexts(q) for q in seqs]
                    far, near, word = (np.concatenate(x) for x in ([p[0] for p in pairs], [p[1] for p in pairs], seqs))
                    order = fit.rng.permutation(len(word))
                    for at in np.array_split(order, max(1, round(len(order) / batch))):
                        fit.step(far[at], near[at], word[at])
                    done[0] += len(word)
        for learner, (fit, done) in fits.items():
            yield pd.DataFrame({"learner": [learner], "tokens": [done[0]], "state": [fit.state().astype("<f4").tobytes()]})

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["learner", "tokens"], kind="stable")
        total = sum(n * np.frombuffer(x, "<f4").astype(float) for n, x in zip(pdf["tokens"], pdf["state"]))
        n = int(pdf["tokens"].sum())
        return pd.DataFrame({"tokens": [n], "state": [(total / n).astype("<f4").tobytes()]})

    trained = slices.mapInPandas(train, "learner int, tokens long, state binary")
    merged = trained.groupBy(F.pmod("learner", F.lit(merge)).alias("group")).applyInPandas(average, "tokens long, state binary").collect()  # at most ``merge`` rows of fixed size
    sent.unpersist()
    if not merged:
        return state
    total = sum(r["tokens"] * np.frombuffer(r["state"], "<f4").astype(float) for r in merged)
    return (total / sum(r["tokens"] for r in merged)).astype(np.float32).reshape(shape)


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words of at most LONGEST_KNOWN bytes, by falling count and then by bytes.

    Counts are binned by their logarithm (at most 64 times 64 bins), and the fullest set of upper
    bins that fits is fetched, so that tasks send no more rows than the driver keeps.
    """
    short = counts.filter(F.length("word") <= LONGEST_KNOWN).withColumn("bin", F.floor(F.log2("count") * 64))
    sizes = sorted(short.groupBy("bin").count().collect(), reverse=True)
    taken, least = 0, None
    for bin_, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, bin_
    rows = short.filter(F.col("bin") >= least).select("word", "count").collect() if taken else []
    return sorted(((bytes(w), n) for w, n in rows), key=lambda x: (-x[1], x[0]))


SCORED = "doc_id long, nameless boolean, held_out boolean, n_tokens long, n_known long, base double, score double, rare map<binary,bigint>"


def score_language(
    docs: DataFrame,
    known_words: int = 200_000,
    classes: int = 768,
    dims: int = 16,
    samples: int = 24,
    rate: float = 0.05,
    batch: int = 1024,
    merge: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32(id) mod 5 is 1 are held out.  Scores are log10 probabilities of whole texts,
    the end token included.  Null texts are empty; null ids count as an empty id; repeated rows are
    scored each.  Without training rows all tokens are unknown and both scores are the uniform one.
    """
    spark = docs.sparkSession
    rows = docs.select(*carried_id(id_col), (id_crc32_mod(id_col, 5) == 1).alias("held_out"), text_or_empty(text_col).alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = materialize(word_counts(training), "lm-counts")
    ends = training.count()
    in_words, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = in_words + ends, distinct + (ends > 0)

    by_ending = counts.groupBy(F.substring("word", -ENDING, ENDING).alias("ending")).agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("kinds"))
    endings = {bytes(r["ending"]): (r["tokens"], r["kinds"]) for r in by_ending.collect()}  # at most 256 + 65 536
    v = Vocabulary(_most_frequent(counts, known_words), endings, classes)
    vocabulary = spark.sparkContext.broadcast(v)
    prior = v.tokens + 0.5
    prior[0] += ends
    prior /= prior.sum()
    model = train_model(training, tokens, vocabulary, prior, dims, samples, rate, batch, merge)
    sent = spark.sparkContext.broadcast((model, model.normalisers()))

    base_total = math.log10(tokens + 0.5 * (kinds + 1))
    end_base = math.log10(ends + 0.5) - base_total
    ln10 = math.log(10.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, (m, norm) = vocabulary.value, sent.value
        base_of = np.append(np.log10(v.counts + 0.5) - base_total, 0.0)
        log_counts = np.append(np.log10(v.counts + 0.5), 0.0)  # those of other words are joined
        log_counts[: v.alone] = 0.0
        none = len(v.counts)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part, out = pdf.iloc[lo : lo + 256], []
                split = [_words(t) for t in part["text"]]
                numbers = [v.numbers(w) for w in split]
                seqs = [v.classed(w, n) for w, n in zip(split, numbers)]
                pairs = [_contexts(s) for s in seqs]
                far, near, word = (np.concatenate(x) for x in ([p[0] for p in pairs], [p[1] for p in pairs], seqs))
                logs = (np.einsum("ij,ij->i", m.predicted(far, near), m.target[word]) + m.bias[word] - norm[far, near]) / ln10 - v.share[word]
                sums = np.add.reduceat(logs, np.concatenate([[0], np.cumsum([len(s) for s in seqs])[:-1]]), dtype=np.float64)
                for words, n, total in zip(split, numbers, sums):
                    odd = np.flatnonzero(n == none)
                    rare = Counter(words[i] for i in odd)
                    out.append((len(n) + 1, len(n) - len(odd) + (ends > 0), base_of[n].sum() + end_base, float(total) + log_counts[n].sum(), dict(rare)))
                found = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "score", "rare"])
                yield found.assign(**{c: part[c].to_numpy() for c in ("doc_id", "nameless", "held_out")})[["doc_id", "nameless", "held_out", "n_tokens", "n_known", "base", "score", "rare"]]

    scored = restored_id(rows.mapInPandas(score, SCORED))
    scored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    unlisted = scored.select("uid", F.explode("rare").alias("word", "n")).join(counts, "word", "left")
    c = F.coalesce("count", F.lit(0))
    added = unlisted.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(c + 0.5) - F.lit(base_total))).alias("more_base"),
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("more_score"),
    )
    return scored.join(added, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
