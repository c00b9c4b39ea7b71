"""Language identification of whole texts and of the spans inside them.

A word is a run of letters of one script.  The scripts a language is written in narrow a word's
candidates; hashed character n-grams, with the word's ends as characters, score it for each of them.
Viterbi with a penalty for changing the language then labels the words of a text, so that a foreign
passage gets a span of its own and a single odd word does not.

Counts are gathered over all training texts: tasks add up numpy arrays, Spark adds up their rows by
language and slot.  The driver gets ``2**bits`` sums a language at most, whatever the input.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32_mod, text_or_empty

UNKNOWN = "und"
# Unicode ranges of scripts; letters outside them form one more script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x3134F),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)
#: Counters behind the slots of n-grams: letters, words, then letters of each script.
LETTERS, WORDS, BY_SCRIPT = 0, 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(1)  # stands for the end of a word; its start is 0
#: Code points that a task works on at a time.
CHUNK = 1 << 20
GROUP = 1 << 22
#: Score of a language whose script a word is not written in.
IMPOSSIBLE = np.float32(-1e4)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 no letter, 1 letter, 2 mark; its script; its lower case."""
    every = range(0x110000)
    kind = np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in every), np.uint8, 0x110000)
    script = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(kind == 1):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kind, script, lower


@dataclass
class Words:
    """The words of several texts: where each begins in ``codes``, its length and letters, its script, and the text it is in."""

    codes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    text: np.ndarray
    text_start: np.ndarray


def find_words(texts: list[str]) -> Words:
    """All words of ``texts``, in order; runs of marks without a letter are no words."""
    kinds, scripts, lower = _letters()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    text_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kind, script = kinds[codes], scripts[codes]
    lead = np.maximum.accumulate(np.where(kind != 2, np.arange(len(codes)), 0))  # a mark has the script of its letter
    script = script[lead]
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (script[1:] != script[:-1])
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(~inside)
    end = np.minimum(np.append(start[1:], len(codes)), stops[np.searchsorted(stops, start)]) if len(start) else start
    before = np.concatenate([[0], np.cumsum(kind == 1)])
    letters = before[end] - before[start]
    kept = letters > 0
    start, end = start[kept], end[kept]
    text = np.searchsorted(text_start, start, "right") - 1
    return Words(lower[codes], start, end - start, letters[kept], script[start], text, text_start)


def _slots(mark: int, *parts, bits: int) -> np.ndarray:
    """Slots of n-grams given by the mark of their kind and their characters."""
    h = np.full(len(parts[-1]), mark, np.uint64)
    for p in parts:
        h = (h ^ p) * _MIX
        h = h ^ (h >> np.uint64(29))
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def ngrams(words: Words, first: int, last: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Slots of words ``first`` to ``last - 1``: four arrays over their letters (1- to 4-grams that end there), three over words (2- to 4-grams that end with the word), and each word's offset in the former."""
    length = words.length[first:last]
    offset = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], length)  # of a letter in its word
    at = np.repeat(words.start[first:last], length) + place
    c = words.codes[at].astype(np.uint64) + np.uint64(2)
    back = [c]
    for k in (1, 2, 3):
        b = np.zeros_like(c)
        b[k:] = c[:-k]
        b[place < k] = 0
        back.append(b)
    inner = [_slots(k, *back[:k], bits=bits) for k in (1, 2, 3, 4)]
    tail = offset[1:] - 1
    ends = [_slots(4 + k, _END, *[b[tail] for b in back[:k]], bits=bits) for k in (1, 2, 3)]
    return inner, ends, offset[:-1]


def _pieces(words: Words, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about ``size`` letters; a longer word is a range of its own."""
    ends, first = np.cumsum(words.length), 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield first, last
        first = last


def _groups(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` code points; a longer text is a range of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def count_ngrams(docs: DataFrame, bits: int) -> DataFrame:
    """``lang, slot, n`` over all rows of ``docs`` (lang, text): n-grams, then the counters behind them."""
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(size + BY_SCRIPT + len(SCRIPT_NAMES), np.int64))
                texts = list(texts)
                for a, b in _groups(texts, GROUP):
                    words = find_words(texts[a:b])
                    total[size + LETTERS] += words.length.sum()
                    total[size + WORDS] += len(words.length)
                    total[size + BY_SCRIPT :] += np.bincount(words.script, words.letters, len(SCRIPT_NAMES)).astype(np.int64)
                    for first, last in _pieces(words, CHUNK):
                        inner, ends, _ = ngrams(words, first, last, bits)
                        for slots in (*inner, *ends):
                            total[:size] += np.bincount(slots, minlength=size)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": used.astype(np.int32), "n": total[used]})

    return docs.mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """``weights[slot, language]``: evidence of an n-gram in nats; ``prior``: share of each language's letters; ``written[script, language]``."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    written: np.ndarray
    bits: int

    def scores(self, words: Words) -> np.ndarray:
        """Evidence of each word for each language: its n-grams' weights, averaged over their orders."""
        out = np.zeros((len(words.start), len(self.languages)), np.float32)
        for first, last in _pieces(words, max(1 << 14, 4 * CHUNK // (4 + len(self.languages)))):
            inner, ends, offset = ngrams(words, first, last, self.bits)
            letters = sum(self.weights[s] for s in inner)
            out[first:last] = np.add.reduceat(letters, offset) / len(inner) + sum(self.weights[s] for s in ends) / len(ends)
        allowed = self.written[words.script]
        out[~allowed & allowed.any(axis=1, keepdims=True)] = IMPOSSIBLE
        return out


def train_languages(docs: DataFrame, bits: int = 17, blend: float = 0.02, doubt: float = 2.0, least_share: float = 0.01) -> LanguageModel:
    """A model of the languages in ``docs`` (lang, text; rows without either do not count).

    An n-gram's weight is the logarithm of its share in the language over its mean share, blended with
    ``blend`` of the mean so that no n-gram rules a language out, and lowered where all its counts
    together are of the order of ``doubt``.  A script belongs to a language from ``least_share`` of its letters.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"))
    found = count_ngrams(known, bits).toPandas()  # at most 2**bits rows a language
    size, languages = 1 << bits, sorted(found["lang"].unique())
    counts = np.zeros((size + BY_SCRIPT + len(SCRIPT_NAMES), len(languages)))
    counts[found["slot"], found["lang"].map({x: i for i, x in enumerate(languages)})] = found["n"]
    grams, letters, scripts = counts[:size], counts[size + LETTERS], counts[size + BY_SCRIPT :]
    share = grams / np.maximum(letters, 1)
    mean = share.mean(axis=1, keepdims=True) if languages else np.ones((size, 1))
    seen = grams.sum(axis=1, keepdims=True)
    weights = np.log((1 - blend) * share / np.where(mean > 0, mean, 1) + blend) * (seen / (seen + doubt))
    prior = np.log(np.maximum(letters, 1) / max(1.0, letters.sum()))
    return LanguageModel([str(x) for x in languages], weights.astype(np.float32), prior, scripts >= least_share * np.maximum(scripts.sum(axis=0), 1), bits)


def viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the best path of each text.

    Text d has the ``length[d]`` rows of ``scores`` from ``first[d]`` on.  A path gains its words'
    scores and ``start`` of its first language, and pays ``switch`` for each change.  All texts take
    a step at a time together, longest first; ties keep the language, then go to the first one.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # texts with more words than t
    best = np.zeros((len(first), len(start)))
    stays = np.ones(scores.shape, bool)
    leader = np.zeros(len(scores), np.int16)
    for t in range(steps):
        n = active[t]
        at, value = first[:n] + t, best[:n]
        if t == 0:
            value += start
        else:
            top = value.argmax(axis=1)
            jump = value[np.arange(n), top][:, None] - switch
            stays[at] = value >= jump
            leader[at] = top
            np.maximum(value, jump, out=value)
        value += scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1) if len(start) else np.zeros(len(first), int)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at, now = first[:n] + t, state[:n]
        labels[at] = now
        state[:n] = np.where(stays[at, now], now, leader[at])
    return labels


def _label(texts: list[str], model: LanguageModel, switch: float, spans: bool) -> pd.DataFrame:
    """Language, score and spans of each text."""
    words, names = find_words(texts), model.languages
    scores = model.scores(words)
    first = np.searchsorted(words.text, np.arange(len(texts)))
    length = np.searchsorted(words.text, np.arange(len(texts)), "right") - first
    labels = viterbi(scores, first, length, model.prior, switch)
    cell = words.text * len(names) + labels
    letters = np.bincount(cell, words.letters, len(texts) * len(names)).reshape(len(texts), len(names))
    chosen = letters.argmax(axis=1)
    # confidence in the chosen language over the words that carry it
    mine = labels == chosen[words.text]
    evidence = np.stack([np.bincount(words.text[mine], scores[mine, k], len(texts)) for k in range(len(names))], axis=1) + model.prior
    odds = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    sure = odds[np.arange(len(texts)), chosen] / odds.sum(axis=1)
    score = np.where(length > 0, letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1) * sure, 0.0)
    out = pd.DataFrame({"lang_pred": [names[k] if n else UNKNOWN for k, n in zip(chosen, length)], "score": np.clip(score, 0.0, 1.0)})
    if spans:
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(labels)) - 1
        begin, stop = words.start[heads] - words.text_start[words.text[heads]], words.start[tails] + words.length[tails] - words.text_start[words.text[tails]]
        parts: list[list] = [[] for _ in texts]
        for d, b, e, k in zip(words.text[heads], begin, stop, labels[heads]):
            parts[d].append({"start": int(b), "end": int(e), "lang": names[k]})
        out["spans"] = parts
    return out


def language_labels(spark, model: LanguageModel, switch: float = 8.0, spans: bool = False):
    """A column function from texts to ``lang_pred, score`` and, if asked, ``spans`` (start and end in code points, language)."""
    sent = spark.sparkContext.broadcast(model)  # 2**bits floats a language

    @F.pandas_udf("lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else ""))
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = list(texts)
            if not sent.value.languages:
                none = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                yield none.assign(spans=[[] for _ in texts]) if spans else none
                continue
            order = np.argsort([-len(t) for t in texts], kind="stable")  # texts of like length share their steps
            texts = [texts[i] for i in order]
            parts = [_label(texts[a:b], sent.value, switch, spans) for a, b in _groups(texts, GROUP)]
            if parts:
                yield pd.concat(parts, ignore_index=True).set_index(order).sort_index()

    return lambda text_col="text": label(text_or_empty(text_col))


def identify_language(docs: DataFrame, model: LanguageModel | None = None, switch: float = 8.0, spans: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score`` and, if asked, ``spans``.

    Without a model one is learnt from the rows whose crc32(id) mod 5 is not 0 (a null id counts as
    empty text) and whose language is known.  ``lang_pred`` is the language of most letters, ``und``
    for null texts, texts without a letter, and where nothing was learnt; ``score`` is its share of
    the letters times the odds of its words (0 for ``und``).  Ties go to the first language by code
    point.  Repeated rows each count and come out alike.
    """
    held_out = id_crc32_mod(id_col, 5) == 0
    if model is None:
        model = train_languages(docs.filter(~held_out).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    label = language_labels(docs.sparkSession, model, switch, spans)
    marked = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), label(text_col).alias("label"))
    return marked.select("doc_id", "held_out", "label.*")
