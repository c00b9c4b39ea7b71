"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is split at white space; each word gives a token for its letters and digits and one for the
punctuation after or before them, case kept.  Features are hashed token 1-grams and 2-grams, and
marks for repeated tokens, with their relative frequency in the text as value, so a score is a sparse dot product that texts of
any length can share.  Labels only pick and mark training rows; language, source and id are never
features.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, id_crc32_mod, materialize, text_or_empty

HASH_BITS = 18
_RUNS = re.compile(r"[^\W_]+|[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class TokenHasher:
    """Hashes of a text's tokens; words are cached up to ``keep``."""

    def __init__(self, keep: int = 300_000):
        self._words: dict[str, bytes] = {}
        self._keep = keep

    def _word(self, word: str) -> bytes:
        codes = [zlib.crc32(run.encode()) for run in _RUNS.findall(word)]
        found = np.array(codes, dtype="<u4").tobytes()
        if len(word) <= 48:
            self._words[word] = found
        return found

    def tokens(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self._words) > self._keep:
            self._words.clear()
        get = self._words.get
        return np.frombuffer(b"".join([get(w) or self._word(w) for w in words]), dtype="<u4").astype(np.uint64)


#: What stands for an n-gram whose last token is the one before, or the one before that.
_AGAIN = (np.uint64(0x51ED270B35A1C9D7), np.uint64(0xA24BAED4963EE407))


def feature_slots(tokens: np.ndarray, bits: int = HASH_BITS) -> np.ndarray:
    """Slot of each 1-gram and 2-gram, repeats included.

    N-grams that repeat a token also count under one slot for all tokens, so that stuttering text
    is known by its form whatever its words are.
    """
    if not len(tokens):
        return np.zeros(0, dtype=np.int64)
    one = tokens * _MIX
    two = (tokens[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + tokens[1:]) * _MIX
    again = [np.full(int((tokens[k:] == tokens[:-k]).sum()), _AGAIN[k - 1] * np.ones(1, np.uint64) * _MIX) for k in (1, 2)]
    return (np.concatenate([one, two, *again]) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float):
    """FTRL-proximal over sparse rows (slots, values, label): weights and bias."""
    size = (1 << bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(passes):
        for slots, values, label in rows:
            zi, ni = z[slots], n[slots]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (_sigmoid(float(w @ values)) - label) * values
            more = ni + g * g
            z[slots] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[slots] = more
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _trainer(bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float):
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for slots, counts, label in pdf.sort_values(["turn", "id"], kind="stable")[["slots", "counts", "quality"]].itertuples(index=False):
            slots, counts = np.frombuffer(slots, "<i4").astype(np.int64), np.frombuffer(counts, "<i4")
            values = SCALE * counts / max(1, counts.sum())
            rows.append((np.append(slots, 1 << bits), np.append(values, 1.0), int(label)))
        w = train_ftrl(rows, bits, passes, alpha, beta, l1, l2).astype("<f4")
        used = np.flatnonzero(w).astype("<i4")
        return pd.DataFrame({"rows": [len(rows)], "slots": [used.tobytes()], "weights": [w[used].tobytes()]})

    return train


def _counted_features(bits: int):
    """Each text as its distinct slots and their counts, so that no training task holds whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = TokenHasher()
        for pdf in batches:
            found = [np.unique(feature_slots(hasher.tokens(text), bits), return_counts=True) for text in pdf["text"]]
            yield pdf[["id", "turn", "quality"]].assign(
                slots=[s.astype("<i4").tobytes() for s, _ in found], counts=[c.astype("<i4").tobytes() for _, c in found], width=[len(s) + 1 for s, _ in found]
            )

    return count


#: Values are relative frequencies times this, so that a weight of 1 on half a text counts.
SCALE = 10.0


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 8192,
    learners: int = 4,
    passes: int = 4,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.0,
    bits: int = HASH_BITS,
    max_features: int = 1 << 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> np.ndarray:
    """Weights (``2**bits`` and a bias) learnt from at most ``max_rows`` labelled documents.

    ``labels`` has ``doc_id`` and ``quality``.  Training rows are those with a label whose crc32(id)
    mod 4 is not 2; where there are more than ``max_rows``, those with the smallest hash of the id
    are taken, and of these, in the same order, as many as have ``max_features`` distinct features
    in sum, which bounds what a learner holds however long texts are.  They are dealt to
    ``learners`` tasks, whose weights are averaged.

    Null ids, null labels and labels without a document are left out.  Of several labels of an id
    the least counts; of several documents with an id, the text with the least hash.  Null texts
    count as empty and teach the bias alone.  Without training rows all weights are 0.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = (
        marked.filter(id_crc32_mod("id", 4) != 2)
        .withColumn("turn", F.xxhash64("id"))
        .orderBy("turn", "id")
        .limit(max_rows)  # the bound on training rows
    )
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")
    once = texts.groupBy("id", "turn", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    wide = materialize(once.mapInPandas(_counted_features(bits), f"id {once.schema['id'].dataType.simpleString()}, turn long, quality int, slots binary, counts binary, width long"), "quality-features")
    # a window over at most max_rows narrow rows
    so_far = wide.select("id", F.sum("width").over(W.orderBy("turn", "id").rowsBetween(W.unboundedPreceding, 0)).alias("so_far"))
    rows = wide.join(F.broadcast(so_far.filter(F.col("so_far") <= max_features)), "id").withColumn("learner", F.pmod("turn", F.lit(learners)))
    fit = rows.groupBy("learner").applyInPandas(_trainer(bits, passes, alpha, beta, l1, l2), "rows long, slots binary, weights binary")
    total, seen = np.zeros((1 << bits) + 1), 0
    for r in fit.collect():  # one row per learner
        total[np.frombuffer(r["slots"], "<i4")] += r["rows"] * np.frombuffer(r["weights"], "<f4").astype(float)
        seen += r["rows"]
    return (total / max(1, seen)).astype(np.float32)


def quality_score(spark, weights: np.ndarray):
    """A column function from texts to the probability of label 1, over whole texts.

    Null texts count as empty; an empty text has the score of the bias alone.
    """
    bits = (len(weights) - 1).bit_length() - 1
    sent = spark.sparkContext.broadcast(weights)  # 2**bits + 1 floats, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hasher = sent.value, TokenHasher()
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                slots = feature_slots(hasher.tokens(text), bits)
                out[i] = w[-1] + (SCALE * float(w[slots].sum(dtype=np.float64)) / len(slots) if len(slots) else 0.0)
            yield pd.Series(_sigmoid(out))

    return lambda text_col="text": score(text_or_empty(text_col))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Every row is scored by its whole text alone, so rows of equal text have equal scores whatever
    their id; null texts count as empty, and an empty text has the score of the bias.  A null id
    is kept (its remainder is that of an empty text).  A score equal to ``threshold`` is a 1.
    """
    score = quality_score(docs.sparkSession, train_quality(docs, labels, id_col=id_col, text_col=text_col, **options))
    scored = docs.select(F.col(id_col).alias("doc_id"), (id_crc32_mod(id_col, 4) == 2).alias("held_out"), score(text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that the classifier accepts.

    Repeated rows are all kept or all rejected; null and empty texts share one score.
    """
    score = quality_score(docs.sparkSession, train_quality(docs, labels, id_col=id_col, text_col=text_col, **options))
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, score(text_col)).filter(F.col(name) >= threshold).drop(name)
